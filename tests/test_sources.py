import os

import pytest
from pyspark.sql import functions as F

from pvspark.functions.text import decode_source
from pvspark.functions.vectors import to_wide
from pvspark.sources import sinks, tables, trees


def plant(root, files):
    for name, content in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)


HIDDEN = ["pkg/__init__.py", "pkg/a.py", ".hid/b.py", "_priv/c.py", ".d.py"]


def test_hidden_files_are_read(spark, tmp_path):
    plant(tmp_path, {name: name.encode() for name in HIDDEN} | {"pkg/deep/er/x.txt": b"no"})
    os.makedirs(tmp_path / "dir.py")  # a directory whose name matches
    os.symlink(tmp_path, tmp_path / "loop")
    rows = trees.read_source_tree(spark, str(tmp_path), [".py"]).collect()
    assert {r.path: bytes(r.content).decode() for r in rows} == {n: n for n in HIDDEN}


def test_names_with_spaces_and_bad_bytes(spark, tmp_path):
    plant(tmp_path, {"a b%20c/é.py": b"fo\xffo"})
    files = trees.read_source_tree(spark, str(tmp_path), [".py"])
    row = files.select("path", decode_source(F.col("content")).alias("t")).first()
    assert tuple(row) == ("a b%20c/é.py", "foo")


def test_snapshots_and_sub_directory(spark, tmp_path):
    plant(tmp_path / "v1", {"src1/x.py": b"1", "src10/y.py": b"2"})
    plant(tmp_path / "v2", {"other/z.py": b"3"})
    roots = {v: str(tmp_path / v) for v in ("v1", "v2", "absent")}
    with pytest.raises(FileNotFoundError):
        trees.read_snapshots(spark, roots, [".py"])
    rows = trees.read_snapshots(spark, roots, [".py"], skip_missing=True).collect()
    assert {(r.version, r.path) for r in rows} == {
        ("v1", "src1/x.py"), ("v1", "src10/y.py"), ("v2", "other/z.py")
    }
    del roots["absent"]
    rows = trees.read_snapshots(spark, roots, [".py"], "src1").collect()
    assert [(r.version, r.path) for r in rows] == [("v1", "src1/x.py")]


def test_unreadable_file_is_an_error_or_null(spark, tmp_path):
    plant(tmp_path, {"a.py": b"x"})
    os.symlink(tmp_path / "gone", tmp_path / "b.py")
    rows = trees.read_source_tree(spark, str(tmp_path), [".py"], skip_missing=True).collect()
    assert {r.path: r.content and bytes(r.content) for r in rows}["a.py"] == b"x"
    assert all(r.content is None for r in rows if r.path == "b.py")


def test_repo_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("\t u \r\n\n  \nhttps://h/v.git\n")
    got = [r.url for r in tables.read_repo_list(spark, str(tmp_path / "list.txt")).collect()]
    assert got == ["u", "https://h/v.git"]


def test_embeddings_csv_keeps_header_order_and_quotes(spark, tmp_path):
    rows = [('a,"b".py', [0.1, -2.5e-7, 3.0]), ("plain", [1.0, 2.0, 1 / 3])]
    df = spark.createDataFrame(rows, "file_path string, embedding array<double>")
    path = str(tmp_path / "x_embeddings.csv")
    sinks.write_embeddings_csv(df, path, 3)
    back = {r.file_path: r.embedding for r in tables.read_embeddings_csv(spark, path).collect()}
    assert back == dict(rows)
    (tmp_path / "y.csv").write_text("dim_1,file_path,dim_0\n2.0,p,1.0\n")
    row = tables.read_embeddings_csv(spark, str(tmp_path / "y.csv")).first()
    assert tuple(row) == ("p", [2.0, 1.0])
    assert to_wide(df, 2).columns == ["file_path", "dim_0", "dim_1"]


@pytest.mark.parametrize(
    "name, label",
    [("/x/lib_1.0_embeddings.csv", "lib_1.0"), ("a_embeddings_embeddings.csv", "a"), ("v1.2.csv", "v1.2")],
)
def test_version_label(spark, name, label):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(tables.version_label(F.col("n"))).first()[0] == label


def test_pairs_written_only_when_there_are_any(spark, tmp_path):
    schema = "pair int, file_a string, file_b string, similarity double"
    some = spark.createDataFrame([(1, "a", "b", 1.0), (3, "a", "c", 0.99)], schema)
    assert sinks.write_pairs(some.drop("pair"), str(tmp_path / "p.csv"))
    assert not sinks.write_pairs(some.drop("pair").limit(0), str(tmp_path / "none.csv"))
    assert not (tmp_path / "none.csv").exists()
    sinks.write_boundary_pairs(some, str(tmp_path / "b.csv"))
    assert sorted(d for d in os.listdir(tmp_path / "b.csv") if "=" in d) == ["pair=1", "pair=3"]


def test_metadata_leaves_out_missing_fields(spark, tmp_path):
    sinks.write_metadata(sinks.metadata_row(spark, a=1, version=None), str(tmp_path / "m.json"))
    assert spark.read.json(str(tmp_path / "m.json")).columns == ["a"]
