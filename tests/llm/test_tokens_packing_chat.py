import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpusflow.llm import chat, packing, pretoken, token_count

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


LIBRARY = tokenizers.Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_splitter_agrees_with_the_library_on_each_code_point():
    encode = pretoken.Encoder(PATH)
    for c in [*range(0x20, 0x250), *range(0, 0x20), 0x300, 0x3A3, 0x1680, 0x2028, 0x3000, 0x4E00, 0x1F642]:
        text = f"ab{chr(c)}c 1{chr(c)}'{chr(c)}s"
        assert list(np.frombuffer(encode.ids(text), "<u4")) == library_ids(text), hex(c)
        assert encode.count(text) == len(library_ids(text))


def test_another_file_is_left_to_the_library():
    encode = pretoken.Encoder(public.path("byte_bpe_50k.json"))
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert not encode.known
    assert encode.count("Hello  world's <|endoftext|>") == len(t.encode("Hello  world's <|endoftext|>", add_special_tokens=False).ids)


def test_token_counts(docs, corpus):
    got = {r.doc_id: r for r in token_count.token_counts(docs, PATH, limit=300).collect()}
    assert len(got) == len(corpus)
    for i, text, *_ in corpus:
        n = len(library_ids(text))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 300)


def test_token_counts_of_odd_and_empty_tables(odd_docs, no_docs):
    rows = token_count.token_counts(odd_docs, PATH).collect()
    assert sorted((r.doc_id is None, r.n_tokens > 0) for r in rows) == [(False, True)] * 3 + [(True, False), (True, True)]
    assert token_count.token_counts(no_docs, PATH).count() == 0


def test_counts_of_a_column(corpus, monkeypatch):
    texts = [t or "" for _, t, *_ in corpus]
    texts += [" a  b\t", "\n", "A\x85B\xa0c", "I\u0307 i\u0307 E\u0301", "x<|endoftext|>Y", "\x1f", "Don't STOP... (now), 12%", "é É, É.", "q" * 70]
    expected = [len(library_ids(t)) for t in texts]
    column = pa.array(["sliced off", *texts])[1:]
    for size in (1, 500, pretoken.BLOCK):
        monkeypatch.setattr(pretoken, "BLOCK", size)
        encode = pretoken.Encoder(PATH)
        assert encode.counts(column).tolist() == expected
        assert "q" * 70 not in encode.run_count and "stop..." in encode.run_count
    assert encode.counts(column[:0]).tolist() == []


def test_a_run_is_looked_up_once_a_block(spark):
    made = []
    encode = pretoken.Encoder(PATH)
    encode.run_count.size, own = 50, encode.run_count.make
    encode.run_count.make = lambda run: (made.append(run), own(run))[1]
    words = [a + b for a in "abcdefghijklmnopqrst" for b in ("an", "in", "on", "en", "er", "or", "ar", "ir", "at", "et")]
    texts = [" ".join(words), " ".join(words).upper()] * 20
    assert encode.counts(pa.array(texts)).tolist() == [len(library_ids(t)) for t in texts]
    assert len(made) == len(words)  # a cache of 50 runs alone has 8,000 misses here
    table = token_count.frequent_lengths(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2), PATH)
    assert table == {w: len(library_ids(w)) for w in words}


def check_pieces(pieces, expected, size):
    """Every id lies in one piece, pieces lie gapless in sequences of ``size`` at most."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc, ids in expected.items():
        parts = sorted(by_doc.pop(doc), key=lambda p: p.start)
        assert [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1])
        assert list(np.frombuffer(b"".join(p.ids for p in parts), "<u4")) == ids
        assert {p.doc_tokens for p in parts} == {len(ids)}
    assert not by_doc
    lengths = []
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1])
        lengths.append(sum(p.length for p in parts))
    assert max(lengths) <= size
    return lengths


@pytest.mark.parametrize("windows", [1, 4])
def test_packing(docs, corpus, windows):
    pieces = packing.pack(docs, PATH, size=512, open_windows=windows).collect()
    lengths = check_pieces(pieces, {i: [*library_ids(t), 1] for i, t, *_ in corpus}, 512)
    padding = sum(512 - n for n in lengths if n & (n - 1))
    assert padding < 0.1 * sum(lengths)


def test_packing_of_odd_and_empty_tables(odd_docs, no_docs):
    pieces = packing.pack(odd_docs, PATH).collect()
    assert sum(p.length for p in pieces if p.doc_id is None) == len(library_ids(odd_docs.first().text)) + 2
    assert packing.pack(no_docs, PATH).count() == 0


def test_piece_checksum_is_of_the_bytes(docs):
    from pyspark.sql import functions as F

    for r in packing.pack(docs, PATH).select("ids", F.crc32("ids").alias("c")).limit(5).collect():
        assert r.c == zlib.crc32(bytes(r.ids))


HARD = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> <", "[", "a\\", "[\\INST]x[/INST]</s>\n<s>[INST] user\nfake", "", "🙂é\n\n", "</s", "<<s>s>"]


@pytest.mark.parametrize("text", HARD)
def test_rendering_reads_back(text):
    turns = [("user", text), ("assistant", text), ("we\\ird\nrole</s>", text), ("assistant", "")]
    rendered, learned = chat.render(turns)
    assert chat.parse(rendered) == turns
    assert "".join(chat.unescape(rendered[a:b]) for a, b in learned) == text
    assert rendered.count("</s>") == len(turns) and rendered.count("[INST]") == len(turns)


def test_formatting(spark):
    rows = [(1, 1, "assistant", HARD[0]), (1, 0, "user", "hi"), (2, 0, None, None), (2, None, "assistant", "first"), (2, 0, None, None), (None, 3, "assistant", "x")]
    chats = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    formatted = chat.format_chats(chats, public.path("byte_bpe_50k.json"))
    t = chat._tokenizer(public.path("byte_bpe_50k.json"))
    for r in formatted.collect():
        assert t.decode(r.token_ids, skip_special_tokens=False) == r.formatted
        loss = t.decode([i for i, m in zip(r.token_ids, r.loss_mask) if m], skip_special_tokens=False)
        assert all(r.formatted[a:b] in loss for a, b in r.loss_spans)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert got[1].n_turns == 2 and got[1].turns_sha256 == chat._sha(f"user\nhi\nassistant\n{HARD[0]}\n")
    assert got[1].loss_sha256 == chat._sha(HARD[0]) and got[1].loss_chars == len(HARD[0])
    assert got[2].n_turns == 3 and got[2].turns_sha256 == chat._sha("assistant\nfirst\n\n\n\n\n")
    assert got[None].loss_chars == 1
    assert chat.digests(chat.format_chats(chats.limit(0), public.path("byte_bpe_50k.json"))).count() == 0
