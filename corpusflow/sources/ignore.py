"""A4: ignore-pattern exclusion as a Spark job.

Patterns (``.gitignore`` syntax) are rows (corpus_id, ord, pattern). Each is
compiled to an anchored Java regex by a small per-row helper (a pandas UDF over
the rule rows only). Every file is exploded into itself plus its ancestor
directories; candidates are joined to the rules of their corpus (equi-join on
corpus_id, regex as the residual condition); the last matching rule decides
(``max_by(negated, ord)``). A file is dropped when it, or any directory above
it, is ignored - a file under an ignored directory cannot be re-included.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from corpusflow import options as O
from corpusflow.operators.joins import salted_join


def glob_to_regex(pattern: str) -> tuple[str | None, bool, bool]:
    """Compile one ignore line to (regex, negated, dir_only); regex None for a
    blank or comment line."""
    p = pattern.rstrip("\n").rstrip("\r")
    # trailing spaces are ignored unless escaped
    while p.endswith(" ") and not p.endswith("\\ "):
        p = p[:-1]
    if not p or p.startswith("#"):
        return None, False, False
    neg = False
    if p.startswith("!"):
        neg, p = True, p[1:]
    elif p.startswith("\\!") or p.startswith("\\#"):
        p = p[1:]
    dir_only = p.endswith("/")
    p = p.rstrip("/")
    if not p:
        return None, False, False
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = [], 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out.append("/.*")
            i += 3
        elif p.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            j = p.find("]", i + 1)
            if j == -1:
                out.append(re.escape(c))
                i += 1
            else:
                body = p[i + 1:j]
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + re.sub(r"([\\\[&])", r"\\\1", body) + "]")  # no class within a class
                i = j + 1
        elif c == "\\" and i + 1 < len(p):
            out.append(re.escape(p[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    body = "".join(out)
    head = "^" if anchored else "^(?:.*/)?"
    return head + body + "$", neg, dir_only


_RULE_T = TT.StructType([TT.StructField("regex", TT.StringType()),
                         TT.StructField("negated", TT.BooleanType()),
                         TT.StructField("dir_only", TT.BooleanType())])


@F.pandas_udf(_RULE_T)
def _compile(patterns: pd.Series) -> pd.DataFrame:
    rows = [glob_to_regex(p if isinstance(p, str) else "") for p in patterns]
    return pd.DataFrame(rows, columns=["regex", "negated", "dir_only"])


def compile_rules(rules: DataFrame) -> DataFrame:
    """(corpus_id, ord, pattern) -> (corpus_id, ord, regex, negated, dir_only), comments dropped."""
    c = rules.select("corpus_id", "ord", _compile(F.col("pattern")).alias("r"))
    return c.select("corpus_id", "ord", "r.regex", "r.negated", "r.dir_only").where(F.col("regex").isNotNull())


def default_rules(corpora: DataFrame) -> DataFrame:
    """The directories a walk always skips, as rules for every corpus."""
    pats = F.array(*[F.lit(p) for p in O.ALWAYS_IGNORED])
    return corpora.select("corpus_id", F.posexplode(pats).alias("ord", "pattern")) \
                  .withColumn("ord", F.col("ord") - len(O.ALWAYS_IGNORED))


def ignore_verdicts(files: DataFrame, rules: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Per file: ignored flag and the deciding candidate (the file or a directory)."""
    compiled = compile_rules(rules)
    if ignore_case:
        compiled = compiled.withColumn("regex", F.concat(F.lit("(?iu)"), "regex"))
    segs = F.split("path", "/")
    n = F.size(segs)
    cand = files.select("corpus_id", "path", F.explode(F.sequence(F.lit(1), n)).alias("k"), segs.alias("_s"), n.alias("_n"))
    cand = cand.select("corpus_id", "path", F.array_join(F.slice("_s", F.lit(1), F.col("k")), "/").alias("cand"),
                       (F.col("k") < F.col("_n")).alias("is_dir"))
    # many candidates per corpus against a few rules per corpus: salt the corpus key
    m = salted_join(cand, compiled, ["corpus_id"]).where(F.regexp_like(F.col("cand"), F.col("regex")) & (~F.col("dir_only") | F.col("is_dir")))
    last = m.groupBy("corpus_id", "path", "cand").agg(F.max_by("negated", "ord").alias("neg"))
    hit = last.where(~F.col("neg")).groupBy("corpus_id", "path").agg(F.min("cand").alias("ignored_by"))
    return files.select("corpus_id", "path").join(hit, ["corpus_id", "path"], "left") \
                .withColumn("ignored", F.col("ignored_by").isNotNull())


def filter_ignored(files: DataFrame, rules: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Keep files that no rule ignores (directly or through a directory)."""
    v = ignore_verdicts(files, rules, ignore_case).where(F.col("ignored")).select("corpus_id", "path")
    return files.join(v, ["corpus_id", "path"], "left_anti")
