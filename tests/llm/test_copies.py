import hashlib
import random

import numpy as np
import pytest
from corpusflow.llm import common, decontam, order_minhash, run_index


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_matches_the_full_table():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 30))]
        b = a[:]
        for _ in range(rng.randint(0, 10)):
            i = rng.randint(0, len(b))
            rng.choice([lambda: b.insert(i, rng.randint(0, 4)), lambda: b[i : i + 1] and b.pop(i), lambda: b.__setitem__(slice(i, i + 1), [rng.randint(0, 4)])])()
        d = distance(a, b)
        for most in (0, 1, 3, 8, 40):
            got = order_minhash.edit_distance(np.array(a, np.uint32), np.array(b, np.uint32), most)
            assert got == (d if d <= most else None)


def test_sketches_keep_order_and_occurrences():
    runs = np.arange(1000, 1400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    same = order_minhash.sketches(runs) == order_minhash.sketches(runs[::-1].copy())
    assert not same.any()
    one, _ = order_minhash.labelled(np.full(9, 5, np.uint64), np.zeros(9, np.int64), np.array([9]))
    assert len(one) == len(set(one.tolist())) == 5


def near_classes(rows):
    """Connected components of edit similarity 0.8 or more, by all pairs."""
    import re

    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) or [t or ""] for i, t in rows}
    root = {i: i for i in words}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(words)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = words[a], words[b]
            longer = max(len(x), len(y))
            if abs(len(x) - len(y)) <= 0.2 * longer and (x == y or longer < 400 and len(set(x) & set(y)) > 0.3 * longer and distance(x, y) <= int(0.2 * longer + 1e-9)):
                i, j = sorted((find(a), find(b)))
                root[j] = i
    return {i: find(i) for i in ids}


def test_classes_match_all_pairs(spark, docs, corpus):
    got = order_minhash.classes(docs).collect()
    want = near_classes([(i, t) for i, t, *_ in corpus])
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert want[100] == want[101] == 0 and want[102] == want[103]


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = base[:]
        w[rng.randrange(120)] = f"x{i}"
        w[rng.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"v{i}_{j}" for j in range(60)) + " " + " ".join(base[:40])) for i in range(60)]  # only a shared passage
    got = order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got if r.doc_id < 150} == {0}
    assert all(r.kept for r in got if r.doc_id >= 200)


def test_classes_of_odd_and_empty_tables(odd_docs, no_docs):
    rows = order_minhash.classes(odd_docs).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 4  # the repeated row joins its copy
    assert order_minhash.classes(no_docs).count() == 0


def covered(rows, length):
    """{id: (removed flags, bytes)} by looking at every string of ``length`` bytes in order."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen.add(s)
        out[i] = gone, b
    return out


def check_repeats(df, rows):
    want = covered(rows, run_index.LENGTH)
    got = {r.doc_id: r for r in run_index.without_repeats(df).collect()}
    assert len(got) == len(want)
    for i, (gone, b) in want.items():
        assert got[i].n_bytes == len(b)
        assert hashlib.sha256(got[i].kept).digest() == hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).digest(), i
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        assert [(s.start, s.end) for s in got[i].spans] == list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def test_keys_are_looked_up_without_a_python_worker(spark):
    """A worker beside that of a function over the rows doubles what an executor's workers hold."""
    rows = spark.range(5000).selectExpr("IF(id = 0, NULL, id) AS k", "id AS __at", "CAST(id AS string) AS __word")
    some = spark.range(0, 5000, 7).selectExpr("CAST(id AS int) AS x").where("x > 0").unionByName(spark.sql("SELECT CAST(NULL AS int) AS x"))
    flagged = common.may_match(rows, "k", some, "x", name="may")
    assert flagged.columns == ["k", "__at", "__word", "may"]
    assert "Python" not in flagged._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.may for r in flagged.collect()}
    assert len(got) == 5000 and all(got[k] for k in range(7, 5000, 7)) and got[None]
    assert sum(got.values()) < 720 + 20  # 715 keys and a few that share a bit
    assert not common.may_match(rows, "k", some.limit(0), "x").where("__may").count()


def test_repeats_match_brute_force(docs, corpus):
    check_repeats(docs, [(i, t) for i, t, *_ in corpus])


def test_repeats_among_few_letters_and_crowds(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ") for _ in range(260))
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 160))) + passage + str(i) * 90) for i in range(150)]
    rows += [(1000 + i, "ab" * rng.randint(40, 400)) for i in range(6)] + [(2000, "a" * 99), (2001, "a" * 100), (2002, "é" * 300)]
    rng.shuffle(rows)
    # more than LOCAL_CROWD contexts of one key in a chunk: the windows' own path
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rows)
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), rows)


@pytest.mark.parametrize("seed", range(5))
def test_run_index_statistics(seed):
    rng = np.random.default_rng(seed)
    items = np.append(rng.integers(0, 3, 200), 99)
    index = run_index.RunIndex(items, 201)
    order = sorted(range(201), key=lambda i: items[i:].tolist())
    assert index.order.tolist() == order
    shared = index.statistics()
    for a, b in zip(order, order[1:]):
        x, y = items[a:].tolist(), items[b:].tolist()
        n = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert shared[b] == n
    assert len(index.runs) < len(items)


def test_repeats_of_odd_and_empty_tables(odd_docs, no_docs):
    rows = run_index.without_repeats(odd_docs).collect()
    assert len(rows) == 5 and sorted(len(r.kept) == 0 for r in rows) == [False, False, False, True, True]
    assert run_index.without_repeats(no_docs).count() == 0


def local_score(text, item):
    best, row = 0, [0] * (len(text) + 1)
    for y in item:
        new = [0]
        for j, x in enumerate(text, 1):
            new.append(max(0, row[j - 1] + (1 if x == y else -1), row[j] - 1, new[-1] - 1))
            best = max(best, new[-1])
        row = new
    return best


def test_alignment_matches_the_full_table():
    rng = random.Random(3)
    for _ in range(200):
        text = [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
        item = [rng.randint(0, 6) for _ in range(rng.randint(1, 20))]
        score, start, end, matched = decontam.align(np.array(text, np.uint64), np.array(item, np.uint64))
        assert score == local_score(text, item)
        if score:
            assert local_score(text[start:end], item) == score and matched >= score


def test_alignment_in_windows_matches_the_full_table():
    rng = random.Random(4)
    for _ in range(100):
        text = [rng.randint(0, 6) for _ in range(rng.randint(0, 200))]
        item = [rng.randint(0, 6) for _ in range(rng.randint(1, 12))]
        score, start, end, _ = decontam.align(np.array(text, np.uint64), np.array(item, np.uint64), part=12)
        assert score == local_score(text, item) and (not score or local_score(text[start:end], item) == score)


def test_a_copy_behind_two_million_words_is_aligned():
    item = np.arange(1, 13, dtype=np.uint64)
    text = np.full((1 << 21) + 50, 99, np.uint64)
    text[(1 << 21) + 5 : (1 << 21) + 17] = item
    assert decontam.align(text, item) == (12, (1 << 21) + 5, (1 << 21) + 17, 12)


@pytest.fixture(scope="module")
def items(spark, corpus):
    rng = random.Random(9)
    own = [" ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{k}{j}" for j in range(25)) for k in range(4)]
    table = spark.createDataFrame([*enumerate(own), (4, None), (5, "two words"), (6, own[0])], "item_id long, text string")
    return own, table


def test_leaks_are_found_and_clean_texts_left_alone(spark, corpus, items):
    own, table = items
    edited = own[1].split()
    edited[5], edited[14] = "other", "else"
    clean = [(i, t) for i, t, *_ in corpus]
    planted = [
        (500, corpus[0][1] + " " + own[0].upper().replace(" ", "!! ") + " " + corpus[1][1]),
        (501, corpus[2][1] + " " + " ".join(edited)),
        (502, own[2]),
        (503, corpus[4][1] + " " + " ".join(own[3].split()[:6])),  # a quarter of an item is no leak
    ]
    rows = decontam.leaks(spark.createDataFrame(clean + planted, "doc_id long, text string"), table).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(500, 0), (500, 6), (501, 1), (502, 2)}
    got = {(r.doc_id, r.item_id): r for r in rows}
    assert got[502, 2].score == 25 and (got[502, 2].start_word, got[502, 2].end_word) == (0, 25)
    assert got[501, 1].score == 21 and got[501, 1].matched == 23


def test_leaks_of_odd_and_empty_tables(spark, odd_docs, no_docs, items):
    own, table = items
    assert decontam.leaks(no_docs, table).count() == 0
    assert decontam.leaks(odd_docs, table.limit(0)).count() == 0
    more = odd_docs.unionByName(odd_docs.limit(1).selectExpr("CAST(NULL AS long) AS doc_id", f"'{own[0]}' AS text", *odd_docs.columns[2:]))
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(more, table.where("item_id = 0")).collect()] == [(None, 0)]
