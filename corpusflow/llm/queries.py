"""Registered queries of this subpackage: ``opN_<name>`` over whole driver tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontam, importance, isolation, jaccard_join, maxent, merkle, order_minhash, packing, pretoken, run_index, secrets, token_count

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        SPARK[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_maxent_scores")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scores(table(spark, sf_dir, "documents"))


@query("op2_isolation_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", *isolation.COUNTS[:5], "base_failed", "kept", "anomaly"
    )


@query("op3_benchmark_leaks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), pretoken.default_path("word_bpe_49k.json"))


def _secrets_sql() -> str:
    patterns = (secrets.ASSIGN, secrets.ACCESS, r"[0-9a-f]+", r"[A-Za-z0-9+/_=-]+")
    quoted = ["'" + p.replace("'", "''") + "'" for p in patterns]
    found = " UNION ALL ".join(
        f"SELECT r, {k} AS rank, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p})"
        for k, p in enumerate(quoted)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
k AS ({found}),
e AS (SELECT r, rank, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS i FROM k),
p AS (SELECT r, rank, m, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r, rank ORDER BY i) AS BIGINT) AS stop FROM e),
v AS (SELECT r, rank, stop - length(m) AS start, stop, CASE WHEN rank = 0 THEN regexp_extract(m, {quoted[0]}, 2) ELSE m END AS v FROM p),
c AS (SELECT * FROM v WHERE CASE rank WHEN 0 THEN length(v) >= 6 WHEN 1 THEN length(v) >= 20 WHEN 2 THEN length(v) >= 24
  ELSE length(v) >= 20 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') END),
o AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) > 2 AS shared FROM c JOIN d USING (r) GROUP BY v),
j AS (SELECT r, rank, start, ['assign', 'access', 'hex', 'live'][rank + 1] || ':' || start || ':' || stop AS s, shared
  FROM c JOIN o USING (v) WHERE rank < 3 OR NOT shared),
g AS (SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(s, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(s, ',' ORDER BY start, rank) AS spans,
  count(*) FILTER (rank < 3 AND shared) AS n_shared FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_shared, 0) AS n_shared
FROM d LEFT JOIN g USING (r)"""


@query("op5_secret_ownership", _secrets_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
        F.size(F.filter(base, lambda s: s["shared"])).cast("long").alias("n_shared"),
    )


@query("op6_importance_sample")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_near_duplicates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


@query("op8_packed_pieces")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), pretoken.default_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# The escape adds a character to each control string of a role or a text.
CHATS_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g'), '\', '\\'), chr(10), '\n') AS r,
  regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g') AS t FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(t) + 23) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op9_chat_masks", CHATS_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    more = more.select(*(F.col(c).cast(chats.schema[c].dataType) for c in chats.columns))
    return chat.digests(chat.format_chats(chats.unionByName(more), pretoken.default_path("byte_bpe_50k.json")))


@query("op10_repeated_bytes")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_index.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


# crc32 of the decimal id, by the table of its polynomial; a proof has a digest a level, leaf to root.
MANIFEST_SQL = """
WITH RECURSIVE poly AS (SELECT list(c ORDER BY k) AS table_ FROM (SELECT k, list_reduce([k, 1, 2, 3, 4, 5, 6, 7, 8],
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(k))),
d AS (SELECT row_number() OVER () AS r, *, coalesce('=' || lang, '') AS tree,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, table_[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, poly),
f AS (SELECT r, doc_id, tree, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS n_more, coalesce(strlen(text) || ':' || text, '-') AS tail, crc FROM d),
h AS (SELECT r, doc_id, tree, sha256(head || n || tail) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256(head || n_more || tail) ELSE sha256(head || n || tail) END AS shown FROM f),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM h),
nodes AS (SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS width FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(width) + 1) // 2 FROM nodes WHERE width > 1 GROUP BY tree, level, pos // 2),
subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM nodes WHERE width = 1),
outer_nodes AS (SELECT 0 AS level, place AS pos, subroot AS digest, count(*) OVER () AS width FROM subroots
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(width) + 1) // 2 FROM outer_nodes WHERE width > 1 GROUP BY level, pos // 2),
steps AS (SELECT l.r, n.level AS k, any_value(l.pos >> n.level) AS own, max(n.pos) FILTER (n.pos <> l.pos >> n.level) AS other, max(n.digest) FILTER (n.pos <> l.pos >> n.level) AS sibling
  FROM leaves l JOIN nodes n ON n.tree = l.tree AND n.width > 1 AND n.pos // 2 = l.pos >> (n.level + 1) GROUP BY l.r, n.level
  UNION ALL SELECT l.r, 100 + n.level, any_value(s.place >> n.level), max(n.pos) FILTER (n.pos <> s.place >> n.level), max(n.digest) FILTER (n.pos <> s.place >> n.level)
  FROM leaves l JOIN subroots s USING (tree) JOIN outer_nodes n ON n.width > 1 AND n.pos // 2 = s.place >> (n.level + 1) GROUP BY l.r, n.level),
numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS i FROM steps),
folded AS (SELECT r, 0 AS i, shown AS digest FROM leaves
  UNION ALL SELECT f.r, n.i, CASE WHEN n.sibling IS NULL THEN sha256(f.digest) WHEN n.other > n.own THEN sha256(f.digest || n.sibling) ELSE sha256(n.sibling || f.digest) END
  FROM folded f JOIN numbered n ON n.r = f.r AND n.i = f.i + 1),
last_ AS (SELECT r, arg_max(digest, i) AS folded_root FROM folded GROUP BY r),
proofs AS (SELECT r, sha256(coalesce(string_agg(sibling, '' ORDER BY i), '')) AS proof_sha256 FROM numbered GROUP BY r)
SELECT l.doc_id, l.leaf, s.subroot, o.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = o.digest AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN last_ e USING (r) LEFT JOIN proofs p USING (r) CROSS JOIN (SELECT digest FROM outer_nodes WHERE width = 1) o"""


@query("op11_merkle_manifest", MANIFEST_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = fields[:3] + [docs["n_chars"].cast("decimal(21,0)") + 1] + fields[4:]
    shown = F.when(F.crc32(docs["doc_id"].cast("string")) % 7 == 0, merkle.leaf(*more))
    found = merkle.manifest(docs, fields, shown)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


AUDIT_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN least < doc_id THEN 16 ELSE 0 END AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, i, 1 << (ascii(o[i]) - 65) AS bit, CAST(coalesce(list_sum(list_transform(range(1, i), lambda k: 1 << (ascii(o[k]) - 65))), 0) AS INTEGER) AS past FROM o, range(1, 6) t(i)),
r AS (SELECT part, o, i, bit, sum(n) FILTER (fails & bit = 0 AND fails & past = 0) AS kept, sum(n) FILTER (fails & bit <> 0 AND fails & past = 0) AS removed,
  sum(n) FILTER (fails & bit <> 0 AND fails & past <> 0) AS redundant, sum(n) FILTER (fails = bit) AS unique_fails,
  sum(good) FILTER (fails & bit <> 0 AND fails & past = 0) AS good_lost, sum(toxic) FILTER (fails & bit <> 0 AND fails & past = 0) AS toxic_lost
  FROM c, s GROUP BY part, o, i, bit)
SELECT part, o AS filter_order, CAST(i AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""


@query("op12_filter_audit", AUDIT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# All pairs of linked documents by a plain inverted index, then least ids by reachability.
JACCARD_SQL = """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT r, len(s) AS n, unnest(s) AS x FROM s),
k AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT r, r AS t FROM s UNION SELECT reach.r, k.b FROM reach JOIN k ON k.a = reach.t)
SELECT any_value(o.doc_id) AS doc_id, CAST(any_value(len(o.s)) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM reach JOIN s o USING (r) JOIN s t ON t.r = reach.t GROUP BY o.r"""


@query("op13_jaccard_components", JACCARD_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))
