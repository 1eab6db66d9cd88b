"""Secret scan with corpus-wide ownership frequency, in DataFrame functions alone.

Candidates are found per document by regular expressions; their places follow from
the lengths of the pieces between the matches. Base kinds are assign, access and hex.
The method's own kind, ``live``, is a candidate value (20 characters or more of the
credential alphabet with a lower-case letter, an upper-case letter and a digit) that
the corpus holds as a credential would be held: by few owners. Values are hashed and
pre-aggregated by (hash, owner, repository), then (hash, owner), then hash, so that a
value that fills a third of the corpus reaches a reducer as one row a map task. A
value of more than ``max_owners`` owners is a widely copied example: as a base span it
stays and is counted in n_shared, as a ``live`` candidate it is dropped.

Null text is empty; null owner or repository is a name of its own; repeated ids and
rows give a row each; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, with_key

# The patterns of the base kinds and the least length of what they match.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs of [0-9a-f]+ of 24 characters or more
LIVE = r"[A-Za-z0-9+/_=-]{20,}"  # kept with a digit, an upper- and a lower-case letter
KINDS = ("assign", "access", "hex", "live")
SPANS = "array<struct<start:int,end:int,rank:int,value:string>>"


def _found(text: Column, kind: str) -> Column:
    """Array of (start, end, kind's rank, value) of a kind's matches that are long enough."""
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "live": LIVE}[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(between, matches, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"), m.alias("match")))
    nothing = F.array().cast(SPANS)

    def value(match: Column) -> Column:
        return F.regexp_extract(match, pattern, 2) if kind == "assign" else match

    def fits(v: Column) -> Column:
        if kind != "live":
            return F.length(v) >= {"assign": 6, "access": 20, "hex": 24}[kind]
        return v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")

    def step(acc: Column, s: Column) -> Column:
        start, got = acc["at"] + s["gap"], value(s["match"])
        end = start + s["size"]
        one = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("rank"), got.alias("value")))
        return F.struct(end.alias("at"), F.when(fits(got), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(
        F.filter(steps, lambda s: s["match"].isNotNull()),
        F.struct(F.lit(0).alias("at"), nothing.alias("out")),
        step,
        lambda acc: acc["out"],
    )
    # A cheap search first: most texts hold no match.
    some = F.contains(text, F.lit("AKIA")) if kind == "access" else text.rlike(pattern)
    return F.when(some, spans).otherwise(nothing)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, owner, repo and the array ``found`` of candidate spans."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[id_col].alias("doc_id"),
        (F.lit(None) if owner is None else owner).cast("string").alias("owner"),
        (F.lit(None) if repo is None else repo).cast("string").alias("repo"),
        text.alias("text"),
    )
    found = F.concat(*(_found(F.col("text"), kind) for kind in KINDS))
    return rows.select("row", "doc_id", "owner", "repo", found.alias("found"))


def ownership(occurrences: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners, n_found) of (hash, owner, repo) rows, aggregated a level at a time."""
    by_repo = occurrences.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_found"))


def scan(
    docs: DataFrame,
    owner: Column | None = None,
    repo: Column | None = None,
    max_owners: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: row, doc_id, spans (sorted array of start, rank, end, shared), kinds by :data:`KINDS`."""
    found = materialize(candidates(docs, id_col, text_col, owner, repo), "secret-candidates")
    each = found.select("row", "owner", "repo", F.explode("found").alias("s")).select(
        "row", "owner", "repo", "s.start", "s.end", "s.rank", F.sha2("s.value", 256).alias("hash")
    )
    stats = ownership(each)
    judged = each.join(stats, "hash").select("row", "start", "rank", "end", (F.col("n_owners") > max_owners).alias("shared"))
    kept = judged.where((F.col("rank") < KINDS.index("live")) | ~F.col("shared"))
    per_row = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "shared"))).alias("spans"))
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int,shared:boolean>>")
    return found.select("row", "doc_id").join(per_row, "row", "left").withColumn("spans", F.coalesce("spans", nothing))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", owner: Column | None = None, repo: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of their texts replaced by ``mark`` (overlapping spans once).

    Base spans follow from the text alone; only texts that may hold a ``live`` value wait for the
    corpus's verdict, so only these are joined."""
    rows, key = with_key(docs, id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    may = text.rlike(LIVE)
    base = F.array_sort(F.transform(F.concat(*(_found(text, k) for k in KINDS[:3])), lambda s: F.struct(s["start"], s["end"])))
    found = scan(rows, owner, repo, id_col=key, text_col=text_col).where(F.size("spans") > 0)
    same, spans = (free_name(rows.columns, name) for name in ("__key", "__spans"))
    found = found.select(F.col("doc_id").alias(same), F.transform("spans", lambda s: F.struct(s["start"], s["end"])).alias(spans))
    plain = rows.where(~may).withColumn(spans, base)
    live = rows.where(may).join(found, rows[key] == F.col(same), "left").drop(same)
    live = live.withColumn(spans, F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")))
    cut = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
            .otherwise(acc["out"])
            .alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(F.col(text_col)))),
    )
    both = plain.unionByName(live)
    return both.withColumn(text_col, F.when(F.size(spans) == 0, F.col(text_col)).otherwise(cut)).select(docs.columns)
