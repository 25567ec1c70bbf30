from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pvspark.functions import stats, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x"))
    return row.first()["x"]


def test_tokenize_edges(spark):
    got = one(spark, text.tokenize(F.col("t")), t="9abc _x9 a Été FOO")
    assert got == ["abc", "_x9", "foo"]


def test_tokenize_samples(spark):
    expected = {
        "": [],
        "a b cc": ["cc"],
        "x1_y 2z_ _": ["x1_y", "z_"],
        "Kelvin \u212a k\u212ax": ["kelvin"],
        "na\u00efve caf\u00e9_au lait": ["na", "ve", "caf", "_au", "lait"],
        "A1 b2 C3d": ["a1", "b2", "c3d"],
    }
    rows = spark.createDataFrame([(s,) for s in expected], "t string")
    got = rows.select("t", text.tokenize(F.col("t"))).collect()
    assert dict(map(tuple, got)) == expected


def test_decode_drops_invalid_bytes(spark):
    assert one(spark, text.decode_source(F.col("b")), b=bytearray(b"fo\xffo")) == "foo"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.binary(max_size=24), min_size=40, max_size=60))
def test_decode_equals_python_ignore(spark, blobs):
    pieces = [b"\xe2\x82", b"\xed\xa0\x80", b"\xf0\x9f\x98\x80", b"\xc3\xa9", b"\xf4\x90\x80\x80"]
    blobs = blobs + [b + p + b for b in blobs for p in pieces]
    rows = [(i, bytearray(b)) for i, b in enumerate(blobs)]
    df = spark.createDataFrame(rows, "i int, b binary")
    got = dict(map(tuple, df.select("i", text.decode_source(F.col("b"))).collect()))
    assert got == {i: b.decode("utf-8", "ignore") for i, b in enumerate(blobs)}


def test_repo_name(spark):
    urls = {"https://h/foo.github.io": "foohub.io", "https://h/r.git": "r", "https://h/r/": ""}
    for url, name in urls.items():
        assert one(spark, text.repo_name(F.col("u")), u=url) == name


def test_strip_takes_all_whitespace(spark):
    assert one(spark, text.strip(F.col("u")), u="\t u v \r") == "u v"


def test_tag_prefix(spark):
    df = spark.createDataFrame([("p", "a/b"), ("", "a/b"), (None, "a/b")], "p string, f string")
    got = [r[0] for r in df.select(text.make_tag(F.col("p"), F.col("f"))).collect()]
    assert got == ["p/a/b", "a/b", "a/b"]


def test_extensions_once_per_file_and_case_sensitive(spark):
    paths = ["x/a.test.js", "a.JS", ".js", "x.js/readme", "b.jsx", "b.tsx"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = text.filter_extensions(df, [".js", ".test.js", ".[jt]sx"])
    assert [r.path for r in got.collect()] == ["x/a.test.js", ".js", "b.jsx", "b.tsx"]


def test_source_dir_is_a_whole_component(spark):
    df = spark.createDataFrame([("src1/x",), ("src10/x",)], "path string")
    assert [r.path for r in text.filter_source_dir(df, "src1").collect()] == ["src1/x"]
    assert text.filter_source_dir(df, "absent").count() == 0
    assert text.filter_source_dir(df, None).count() == 2


def test_length_filter(spark):
    five, six = " ".join(["tok"] * 5), " ".join(["tok"] * 6)
    df = spark.createDataFrame([("a", five), ("b", six)], "path string, t string")
    docs = text.prepare_documents(df, F.col("t"), F.lit("p"), F.col("path"))
    assert [(r.tag, len(r.words)) for r in docs.collect()] == [("p/b", 6)]


def test_documents_are_tokenized_once(spark):
    df = spark.createDataFrame([("a", "x")], "path string, t string")
    docs = text.prepare_documents(df, F.col("t"), F.lit("p"), F.col("path"))
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_pct(spark):
    pairs = [(1, 32), (0, 0), (5, 0), (1, 3), (7, 7)]
    df = spark.createDataFrame(pairs, "k int, n int")
    got = [r[0] for r in df.select(stats.pct(F.col("k"), F.col("n"))).collect()]
    assert got == [round(k / n * 100, 2) if n else 0.0 for k, n in pairs]
    many = spark.range(120 * 121).select(
        F.floor(F.col("id") / 120).alias("k"), (F.col("id") % 120 + 1).alias("n")
    )
    for k, n, p in many.select("k", "n", stats.pct(F.col("k"), F.col("n"))).collect():
        assert p == round(k / n * 100, 2)
