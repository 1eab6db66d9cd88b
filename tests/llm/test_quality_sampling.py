import collections
import re

import numpy as np
import pytest
from corpusflow.llm import importance, isolation

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_rule_counts_match_brute_force(docs, corpus):
    got = {r.doc_id: tuple(r[c] for c in isolation.COUNTS[:5]) for r in isolation.statistics(docs).collect()}
    assert got == {i: brute(t) for i, t, *_ in corpus}


def thue_morse(k, a, b):
    s = a
    for _ in range(k):
        s += s.translate(str.maketrans(a + b, b + a))
    return s


def test_strings_that_a_polynomial_takes_as_equal_are_told_apart(spark):
    one, two = thue_morse(11, "a", "b"), thue_morse(11, "b", "a")
    rows = [(1, f"{one}\n{two}"), (2, f"{one}\n{one}"), (3, f"{one} {two} " * 3)]
    got = {r.doc_id: tuple(r[c] for c in isolation.COUNTS[:5]) for r in isolation.statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in rows} and got[1][3] == 0 and got[2][3] == 1


def labels_of(spark, good, bad):
    rows = [(i, 1, 0) for i in good] + [(i, 0, 0) for i in bad]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def mixed(spark, corpus):
    """Clean prose, and one in twenty documents of shouted or marked words."""
    clean = [(i, t) for i, t, *_ in corpus if t and len(t.split()) > 20 and i < 100]
    rows, bad = [], []
    for k in range(200):
        i, t = clean[k % len(clean)]
        t = " ".join(t.split()[k % 7 :])
        if k % 20 == 0:
            t = " ".join(w + "$$$" for w in t.split()) if k % 40 else " ".join(w.upper() + "!!" for w in t.split())
            bad.append(k)
        rows.append((k, t))
    return spark.createDataFrame(rows, "doc_id long, text string"), bad


def test_forest_rejects_odd_texts_and_keeps_clean_ones(spark, mixed):
    docs, bad = mixed
    good = [k for k in range(200) if k not in bad]
    rows = {r.doc_id: r for r in isolation.judge(docs, labels_of(spark, good[::2], bad[:5]), keep_share=0.98).collect()}
    assert len(rows) == 200
    assert sum(rows[k].kept for k in good) >= 0.97 * len(good)
    assert sum(rows[k].kept for k in bad) <= 0.2 * len(bad)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in rows.values())


def test_paths_are_short_where_points_are_alone():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (500, 2)), [[9, 9]]])
    scores = isolation.grow(x).scores(x)
    assert scores.argmax() == 500 and scores[500] > 0.6 > np.median(scores)


def test_judging_odd_and_empty_tables(spark, odd_docs, no_docs):
    none = labels_of(spark, [], [])
    rows = isolation.judge(odd_docs, none).collect()
    assert len(rows) == 5 and all(r.kept != r.base_failed for r in rows)
    assert isolation.judge(no_docs, none).count() == 0


def test_weights_match_brute_force(spark, mixed):
    docs, bad = mixed
    labels = labels_of(spark, [k for k in range(200) if k not in bad], bad)
    rows = importance.resample(docs, labels).collect()
    raw, target, hashed = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS), {}
    for i, t in docs.collect():
        data = np.frombuffer(t.encode(), np.uint8)
        hashed[i], _ = importance.hashed(data, np.array([0, len(data)]))
        raw += np.bincount(hashed[i], minlength=importance.BUCKETS)
        target += np.bincount(hashed[i], minlength=importance.BUCKETS) * (i not in bad)
    table = importance.log_ratio(raw, target)
    assert all(abs(r.log_weight - table[hashed[r.doc_id]].sum()) < 1e-6 and r.n_features == len(hashed[r.doc_id]) for r in rows)
    k = round(200 * (200 - len(bad)) / 200)
    keys = sorted((r.gumbel_key for r in rows), reverse=True)
    assert {r.doc_id for r in rows if r.selected} == {r.doc_id for r in rows if r.gumbel_key >= keys[k - 1]}
    assert sum(r.selected for r in rows if r.doc_id in bad) <= 2


@pytest.mark.parametrize("k", [1, 3, 500, 999, 1000])
def test_kth_largest(spark, k):
    values = [float(v) for v in np.round(np.random.default_rng(k).normal(0, 50, 1000), 1)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_repeated_rows_are_drawn_one_by_one(spark):
    rows = [(1, "one and the same row")] * 6 + [(i, f"another row {i}") for i in range(2, 12)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), labels_of(spark, [1], []), share=3 / 16).collect()
    assert len(got) == 16 and sum(r.selected for r in got) == 3
    assert len({r.gumbel_key for r in got}) == 16


def test_resampling_odd_and_empty_tables(spark, odd_docs, no_docs):
    assert importance.resample(odd_docs, labels_of(spark, [7], [])).count() == 5
    rows = importance.resample(odd_docs, labels_of(spark, [], [])).collect()
    assert {r.log_weight for r in rows} == {0.0} and all(r.selected for r in rows)
    assert importance.resample(no_docs, labels_of(spark, [1], [])).count() == 0
