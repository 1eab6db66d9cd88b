"""Edge goldens for the scalar functions."""

from pyspark.sql import functions as F

from corpusflow.functions import text as T


def one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_normalize_hash_lines_tokens(spark):
    rows = [(bytearray(b""),), (bytearray(b"x\n"),), (bytearray(b"a\r\nb\rc"),), (bytearray(b"a\xffb"),)]
    df = spark.createDataFrame(rows, "raw binary").select(T.normalize_text("raw").alias("c"))
    out = df.select("c", T.line_count("c").alias("n"), T.proxy_tokens("c").alias("t"),
                    T.content_hash("c").alias("h")).collect()
    assert [r.c for r in out] == ["", "x\n", "a\nb\rc", "a�b"]
    assert [r.n for r in out] == [1, 2, 2, 1]
    assert [r.t for r in out] == [0, 1, 2, 2]
    assert out[0].h == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_extension_rules(spark):
    names = ["a/.gitignore", "a.", "a.tar.gz", "..a", "X.SQL", "Makefile", "dir.d/file", "b.Py"]
    got = one(spark, T.extension("p"), [(n,) for n in names], "p string")
    assert got == ["", ".", ".gz", ".a", ".sql", "", "", ".py"]


def test_paths(spark):
    rows = [("a.py",), ("src/a.py",), ("src/p1/a.py",)]
    df = spark.createDataFrame(rows, "p string")
    out = df.select(T.dir_of("p"), T.base_name("p"), T.next_segment("p", F.lit("")),
                    T.next_segment("p", F.lit("src/")), T.state_key(T.dir_of("p"))).collect()
    assert [tuple(r) for r in out] == [(".", "a.py", "__root__", "__root__", "."),
                                      ("src", "a.py", "src", "__root__", "src"),
                                      ("src/p1", "a.py", "src", "p1", "src__p1")]
    assert one(spark, T.normalize_path("p"), [(".\\src\\a.py",), ("/x/y",)], "p string") == ["src/a.py", "x/y"]


def test_render_file_and_turn(spark):
    df = spark.createDataFrame([("a.py", "x\ny", 2)], "path string, content string, n long")
    assert df.select(T.render_file("path", "content", "n")).first()[0] == "--- a.py (lines 1-2) ---\n1\tx\n2\ty"
    assert df.select(T.render_file("path", "content", "n", F.lit("UPDATED"))).first()[0].startswith(
        "--- a.py [UPDATED] (lines 1-2)")
    t = spark.createDataFrame([("T", "q", None, None)], "tree string, q string, scope string, ft array<string>")
    assert t.select(T.render_query_turn("tree", "q", "scope", "ft")).first()[0] == "Directory tree:\nT\n\n\nQuery: q"
    t2 = spark.createDataFrame([("T", "q", "src", [".py", ".ts"], "s1", 3)],
                               "tree string, q string, scope string, ft array<string>, sid string, n long")
    txt = t2.select(T.render_query_turn("tree", "q", "scope", "ft", "sid", "n")).first()[0]
    assert txt == "[shard: s1, 3 shards in all]\n\nDirectory tree:\nT\n\nSearch scope: src\nFile types: .py, .ts\n\nQuery: q"


def test_clean_range_edges(spark):
    rows = [(5.0, 2.0, 10), (0.0, 0.0, 10), (2.5, 4.0, 10), (12.0, 15.0, 10), (8.0, 30.0, 10), (-3.0, 1.4, 10)]
    df = spark.createDataFrame(rows, "s double, e double, n long")
    s, e, ok = T.clean_range("s", "e", "n")
    out = [tuple(r) for r in df.select(s, e, ok).collect()]
    assert out == [(2, 5, True), (1, 1, True), (3, 4, True), (12, 10, False), (8, 10, True), (1, 1, True)]


def test_scope_status_backoff_ratio(spark):
    rows = [("", "x"), ("src/", "src"), ("src/", "src/"), ("src/a/", "src"), ("lib/", "src"), ("src/", None),
            ("src/", "src/a/b")]
    got = one(spark, T.scope_matches("p", "s"), rows, "p string, s string")
    assert got == [True, True, True, True, False, True, True]
    codes = one(spark, T.is_retryable("c"), [(None,), (429,), (500,), (503,), (400,), (401,)], "c int")
    assert codes == [True, True, True, True, False, False]
    b = spark.createDataFrame([(1, 0.0), (2, 0.0), (4, 0.0), (5, 0.999), (1, 0.5)], "a int, j double")
    assert [r[0] for r in b.select(T.backoff_ms("a", "j")).collect()] == [1000, 2000, 8000, 11996, 1250]
    h = spark.createDataFrame([(5, 10), (0, 0), (3, None)], "h long, p long")
    assert [r[0] for r in h.select(T.hit_ratio("h", "p")).collect()] == [0.5, 0.0, 0.0]
