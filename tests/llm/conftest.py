"""Small tables with the hard cases of every operator: null, empty, long, repeated."""

import random

import pytest

from rows import SCHEMA, prose

@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars) rows with planted copies, and null, empty, repeated and long ones."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(30, 200)) for _ in range(40)]
    edited = texts[0].split(" ")
    edited[7] = "changed"
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [
        (100, texts[0], "en", "src1", 0),  # an exact copy
        (101, " ".join(edited), "en", "src2", 0),  # a near copy
        (102, None, "en", "src0", 0),
        (103, "", None, None, None),
        (104, " \n\t ", "en", "src0", 0),
        (105, "Ünï cödé 漢字 🙂 <|endoftext|> don't İ " + "\x1c" + " Σας é", "xx", "src0", 0),
        (106, "ab" * 700 + " " + "z" * 300, "en", "src3", 0),  # repeats within itself
        (107, "same line here now ok\n" * 30, "en", "src3", 0),
        (108, prose(rng, 9000), "en", "src0", 0),  # long
        (109, "one two", "en", "src0", 0),
        (110, prose(rng, 20) + texts[3][:300] + prose(rng, 20), "en", "src0", 0),  # a shared passage
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd_docs(spark, corpus):
    """Null and repeated ids, a repeated row, and further columns with an operator's own names."""
    rows = [(None, corpus[0][1]), (7, corpus[1][1]), (7, corpus[1][1]), (7, corpus[2][1]), (None, None)]
    more = "n_tokens long, spans string, kept string, row long, seeds long, doc long, hash long, score long, member long, words long"
    return spark.createDataFrame([(i, t, "en", "src0", 1, *[9] * 1, "x", "x", *[9] * 7) for i, t in rows], f"{SCHEMA}, {more}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
