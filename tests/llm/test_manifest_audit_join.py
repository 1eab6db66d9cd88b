"""Merkle manifest, filter audit and Jaccard join against plain Python."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from corpusflow.llm import audit, jaccard_join, merkle
from pyspark.sql import functions as F

from rows import SCHEMA, prose

MORE = "key long, hash string, fails int, n long, at long, tree string, block long, part string, size long, same string, claimed string, digest string"


def clashing(df):
    """The same rows with further columns that carry an operator's own names."""
    return df.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in MORE.split(", ")])


# -- Merkle manifest -----------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    return [lv[(at >> k) ^ 1] for k, lv in enumerate(tree[:-1]) if (at >> k) ^ 1 < len(lv)]


def plain_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof) of (doc_id, source, lang, n_chars, text) rows."""
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf_of(r), r[0]) for r in rows if r[2] == lang))
        trees[lang] = (mine, levels([m[2] for m in mine]))
    outer = levels([trees[x][1][-1][0] for x in langs])
    out = []
    for place, lang in enumerate(langs):
        mine, tree = trees[lang]
        for at, m in enumerate(mine):
            out.append((m[3], m[2], tree[-1][0], outer[-1][0], "".join(siblings(tree, at) + siblings(outer, place))))
    return sorted(out, key=repr)


def manifest_of(df, claimed=None):
    return merkle.manifest(df, [df[c] for c in ("doc_id", "source", "lang", "n_chars", "text")], claimed)


@pytest.mark.parametrize("sizes", [[1], [2, 1], [3], [5, 8, 1, 257], [256, 512, 600]])
def test_manifest_of_trees_of_any_size(spark, sizes):
    rows = [(i * 7 % 1009, "s", f"l{k}" if k else None, i, "t" * (i % 5)) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], SCHEMA)
    found = manifest_of(df).collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in found], key=repr) == plain_manifest(rows)
    assert all(r.verified and r.folded_root == r.root for r in found)


def test_manifest_of_odd_rows(spark, docs, odd_docs, no_docs):
    for df in (docs, clashing(docs), odd_docs.select(*docs.columns)):
        rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.select(*docs.columns).collect()]
        found = manifest_of(df).collect()
        assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in found], key=repr) == plain_manifest(rows)
    assert manifest_of(odd_docs).count() == 5
    assert manifest_of(no_docs).collect() == []


def test_a_changed_row_does_not_verify(docs):
    shown = F.when(F.col("doc_id") == 3, merkle.leaf(F.lit("something else"))).when(F.col("doc_id") == 4, F.lit(None))
    found = {r.doc_id: r for r in manifest_of(docs, shown).collect()}
    assert [i for i, r in found.items() if not r.verified] == [3]
    assert found[3].folded_root != found[3].root


def test_a_block_keeps_only_a_short_queue():
    block, longest = merkle.Block(12), 0

    def digests():
        nonlocal longest
        for i in range(1 << 12):
            longest = max(longest, len(block.queue))
            yield sha(str(i))

    top = block.forward(digests())
    assert top == levels([sha(str(i)) for i in range(1 << 12)])[-1][0] and longest <= 14


# -- filter audit --------------------------------------------------------------


def plain_audit(rows, labels):
    fails = []
    for doc_id, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any((x or "") == t and i is not None and doc_id is not None and i < doc_id for i, x, _ in rows),
        }
        fails.append((part or "", f, (doc_id, "quality") in labels, (doc_id, "toxic") in labels))
    out = []
    for part in sorted({p for p, *_ in fails}):
        mine = [x for x in fails if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        some = []
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                alive = [x for x in mine if not any(x[1][e] for e in order[: step - 1])]
                hit = [x for x in alive if x[1][f]]
                total[f] += len(hit)
                gone = sum(x[1][f] for x in mine) - len(hit)
                only = sum(x[1][f] and sum(x[1].values()) == 1 for x in mine)
                some.append((part, order, step, len(alive) - len(hit), len(hit), gone, only, sum(x[2] for x in hit), sum(x[3] for x in hit)))
        out += [(*x, total[x[1][x[2] - 1]]) for x in some]
    return sorted(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_counting_by_hand(spark, corpus, docs, no_docs):
    rng = random.Random(3)
    rows = [(i, t, lang) for i, t, lang, *_ in corpus]
    rows += [(200 + i, rows[i % 3][1], rng.choice(["en", "xx", None])) for i in range(60)]  # texts with many copies
    rows += [(300, "A B# $ " * 50, "en"), (301, "Word" * 3, "xx"), (None, rows[0][1], "en"), (None, None, None), (9, rows[0][1], "en"), (9, rows[0][1], "en")]
    said = [(i, int(i % 2), int(i % 3 == 0)) for i in range(0, 260, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    marks = {(i, "quality") for i, q, _ in said if q and i is not None} | {(i, "toxic") for i, _, x in said if x and i is not None}
    df = clashing(spark.createDataFrame([(i, t, p, "s", 1) for i, t, p in rows], SCHEMA).repartition(4))
    df = df.drop("part").withColumn("part", F.lit("x"))
    found = audit.audit(df, labels)
    assert sorted(tuple(r[c] for c in AUDIT) for r in found.collect()) == plain_audit(rows, marks)
    assert audit.audit(no_docs, labels).collect() == []


def test_a_text_that_most_rows_share(spark):
    """One text in two thirds of all rows is dealt over many salts, and only its least id is no copy."""
    rows = [(i, "the same text" if i % 3 else f"text {i}", "en", "s", 1) for i in range(9000)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = audit.combinations(spark.createDataFrame(rows, SCHEMA), labels)
    assert {(r.fails, r.docs) for r in found.collect()} == {(1, 3001), (17, 5999)}


# -- Jaccard join --------------------------------------------------------------


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain_join(rows, percent=90):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def joined(df, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(df, **kw).collect()), key=repr)


def variants(rng, words, n, edits):
    """Copies with words replaced: chains of near copies around the threshold."""
    out = []
    for _ in range(n):
        copy = list(words)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
        out.append(copy)
        if rng.random() < 0.3:
            words = copy  # a chain: its ends are not linked themselves
    return [" ".join(c) for c in out]


def join_rows(corpus):
    rng = random.Random(11)
    rows = [(i, t) for i, t, *_ in corpus]
    for k, (length, edits) in enumerate([(60, 2), (90, 3), (200, 6), (400, 14), (12, 1), (3, 1)]):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(300)) for _ in range(length)]
        rows += [(1000 * (k + 1) + i, t) for i, t in enumerate(variants(rng, words, 40, edits))]
    stock = prose(rng, 60)  # a passage that many documents share
    rows += [(9000 + i, stock + prose(rng, 12 + i % 20)) for i in range(40)]
    rows += [(9100 + i, stock) for i in range(30)] + [(9200, "Two WORDS"), (9201, "two words"), (9202, "two"), (9203, "\x1f é")]
    return rows


@pytest.mark.parametrize("small", [8, 1024])
def test_join_equals_all_pairs(spark, corpus, monkeypatch, small):
    """With SMALL = 8 regions go through pivots and rings for several rounds."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "SPOKES", 8)
    rows = join_rows(corpus)
    df = clashing(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3))
    assert joined(df) == plain_join(rows)


def test_a_pair_of_many_regions_is_made_once(spark):
    """Sets 1, 2 and 3 meet in nine regions, 1 and 4 in another: a region makes the pairs that have no lesser one."""
    sign = bytes(jaccard_join.SIGN_BITS // 8)
    regions = {1: list(range(10)), 2: list(range(9)), 3: list(range(9)), 4: [9]}
    rows = [(r, i, 50, i, sign, [x for x in own if x < r]) for i, own in regions.items() for r in own]
    df = spark.createDataFrame(rows, "region long, doc_id long, n int, root long, sign binary, others array<long>")
    assert sorted(map(tuple, jaccard_join.within(df.repartition(4), 90).collect())) == [(1, 2), (1, 3), (1, 4), (2, 3)]


def test_sets_that_meet_by_chance_leave_before_the_first_round(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW", 4)
    sign = lambda k: bytes([255 * (j // 16 == k) for j in range(jaccard_join.SIGN_BITS // 8)])
    signs = spark.createDataFrame([(i, 100, sign(k)) for i, k in enumerate([0, 1, 2, 2, 3])], "doc_id long, n int, sign binary")
    rows = [(1, [0, 1]), (2, [0, 1, 2, 3]), (3, [0, 1, 2, 3, 4])]
    members = spark.createDataFrame([(i, 100, 111.0, r, len(some)) for r, some in rows for i in some], "doc_id long, n int, most double, region long, size long")
    found = jaccard_join.hopeful(members, signs, 90)
    assert sorted((r.region, r.doc_id) for r in found.collect()) == [(2, 2), (2, 3), *((3, i) for i in range(5))]


def test_rarity_tells_crowded_classes_apart(spark):
    """100 and 120 documents a class are not one rank, as they are by whole powers of two."""
    each = (1 << jaccard_join.CLASS_BITS) // jaccard_join.SLICES
    parts = [np.full(each, 100 + 20 * (k == 3), np.int64).tobytes() for k in range(jaccard_join.SLICES)]
    counts = spark.createDataFrame([(k, p) for k, p in enumerate(parts)], "slice int, counts binary")
    powers = jaccard_join.rarity(counts)
    assert len(powers) == 1 << jaccard_join.CLASS_BITS and powers[0] < powers[3 * each] and powers[0] == powers[-1]


def test_join_at_another_threshold(spark, corpus):
    rows = join_rows(corpus)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert joined(df, percent=60) == plain_join(rows, 60)


def test_join_of_odd_rows(spark, odd_docs, no_docs):
    assert joined(odd_docs) == plain_join([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert joined(no_docs) == []


def test_words_that_polynomial_hashes_confuse():
    """Thue-Morse words of 1,024 letters have one hash modulo 2**64 whatever the odd multiplier."""
    import numpy as np

    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = "".join("ba"[bin(i).count("1") % 2] for i in range(1024))
    data = np.frombuffer(f"x y {a}x y {b}".encode(), np.uint8)
    one, other = jaccard_join.shingles(data, np.array([0, 4 + 1024, len(data)]))
    assert one[0] != other[0]


def test_a_text_of_a_million_words(spark):
    long = " ".join(f"w{i % 50021}" for i in range(10**6))
    rows = [(1, long), (2, long + " end"), (3, "short text here")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert joined(df) == [(1, 50021, 1), (2, 50022, 1), (3, 1, 3)]
    assert audit.audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 600
    assert manifest_of(df).where("verified").count() == 3
