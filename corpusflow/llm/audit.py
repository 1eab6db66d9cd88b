"""Filter interaction audit: what each of five filters removes in every order of them.

A document fails filter A (few words), B (repeated words), C (capitals), D (marks) or E (an
exact copy of a document with a smaller id). E is an existential self-join: documents, left-semi
joined on the text's hash, the exact text and a smaller id. The ids that it marks are united
with those that fail the other filters; what is left to do depends only on how many documents
have each of the 32 combinations of failures, so all orders come out of those counts.

Only documents whose hash occurs again take part in the join (a bitmap of those hashes keeps
the others' texts where they are). The join's right side is one document a hash, that of least
id: a smaller id with the text exists if and only if that one is smaller. A text that a large
share of all documents holds is dealt over many tasks.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, may_match, with_key
from .hot import spread_join

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
COPY = 1 << FILTERS.index("E")


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    few = n < 100
    repeated = 100 * F.size(F.array_distinct(words)) < 80 * n
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long")
    marks = F.regexp_like(text, F.lit(r"[#$%&*|]"))
    return sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate((few, repeated, capitals, marks))), F.lit(0)).cast("int")


def copies(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(key) of the rows that have the exact text of a row with a smaller id.

    ``texts``: key, id, hash, text; ``rows``: the same rows without text, stored."""
    groups = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")).where("size > 1")
    groups = materialize(groups, "audit-groups", force=True)
    again = may_match(texts.select("key", "id", "hash", "text"), "hash", groups, "hash").where("__may").drop("__may")
    again = materialize(again, "audit-repeated", force=True)
    least = again.join(groups.select("hash", F.col("least").alias("id")), ["hash", "id"], "left_semi").dropDuplicates(["hash", "id"])
    least = least.select("hash", F.col("id").alias("least"), F.col("text").alias("same")).join(groups.select("hash", "size"), "hash")
    met = spread_join(again, least, "hash", "size", "key")
    return met.where("text = same AND least < id").select("key")


def combinations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, fails, docs, good, toxic): documents with each combination of failures (bits of A to E).

    Null text is empty, a null part is the empty string. Null ids are neither smaller nor larger than
    others and have no labels; of a repeated id all rows count, and none is a copy of the other. A
    document is good or toxic if any of its label rows says so."""
    rows, key = with_key(docs, id_col)
    text = F.coalesce(rows[text_col].cast("string"), F.lit(""))
    texts = rows.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("hash"), text.alias("text"))
    base = materialize(texts.select("key", "id", "part", "hash", failures(F.col("text")).alias("fails")), "audit-base", force=True)
    none = [F.lit(None).cast(base.schema[c].dataType).alias(c) for c in ("id", "part")]
    copied = copies(texts, base.select("key", "id", "hash")).select("key", *none, F.lit(COPY).alias("fails"))
    all_ = base.select("key", "id", "part", "fails").unionByName(copied).groupBy("key")
    all_ = all_.agg(F.max("id").alias("id"), F.max("part").alias("part"), F.bit_or("fails").alias("fails"))
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    count = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return all_.join(said, "id", "left").groupBy("part", "fails").agg(F.count(F.lit(1)).alias("docs"), count("good"), count("toxic"))


def orders(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step in it, from the counts of :func:`combinations`.

    kept (after the step), removed (in it), redundant (fail the step's filter, removed earlier),
    unique_fails (fail only that filter), good_lost and toxic_lost (removed in it), and shapley (what
    the filter removes, summed over all orders: of the k filters that a document fails, each is the
    first in 1 / k of them)."""
    steps = [(o, i + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(e) for e in o[:i])) for o in map("".join, permutations(FILTERS)) for i, f in enumerate(o)]
    all_steps = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","i":{i},"bit":{b},"past":{p}}}' for o, i, b, p in steps) + "]"), "array<struct<o:string,i:int,bit:int,past:int>>")
    rows = counts.select("*", F.explode(all_steps).alias("s"))  # 600 rows for each of 32 combinations a part
    fails, bit, past = F.col("fails"), F.col("s.bit"), F.col("s.past")
    hit, gone = fails.bitwiseAND(bit) != 0, fails.bitwiseAND(past) != 0
    total = lambda name, test, value="docs": F.sum(F.when(test, F.col(value)).otherwise(0)).cast("long").alias(name)
    share = F.when(hit, F.col("docs") * F.expr("120 div bit_count(fails)")).otherwise(0)
    return rows.groupBy("part", F.col("s.o").alias("filter_order"), F.col("s.i").alias("step")).agg(
        total("kept", ~hit & ~gone),
        total("removed", hit & ~gone),
        total("redundant", hit & gone),
        total("unique_fails", fails == bit),
        total("good_lost", hit & ~gone, "good"),
        total("toxic_lost", hit & ~gone, "toxic"),
        F.sum(share).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """:func:`orders` of :func:`combinations`; no documents give no rows."""
    return orders(materialize(combinations(docs, labels, id_col, text_col, part_col), "audit-combinations", force=True))
