import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pvspark.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    """The small corpus with planted secrets and a benchmark passage, as the tables of a pipeline."""
    root = str(tmp_path_factory.mktemp("tables"))
    passage = " ".join(f"item{k} word{k}" for k in range(15))
    more = docs.limit(1).select(
        *[
            F.lit(v).cast(t).alias(c)
            for c, t in docs.dtypes
            for v in [{"doc_id": 300, "text": f"le la {passage} de", "lang": "fr", "source": "s1"}.get(c, "1")]
        ]
    )
    secret = docs.filter("doc_id = 10").withColumns(
        {"doc_id": F.lit(301).cast("long"), "text": F.concat(F.lit("le des pour que token = abcdef0123 dans les une "), "text")}
    )
    docs.unionByName(more).unionByName(secret).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, tables):
    before = docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        extra = ["sample_probability"] if name == "mixture" else []
        assert docs.columns == [*before.columns, *extra]
        docs = docs.cache()
        kept.append({r.doc_id: r.text for r in docs.collect()})
    language, near, clean, marked, mixed = kept
    assert {240, 241, 242, 243}.isdisjoint(language) and 245 in language
    assert 244 not in near and 7 in near
    assert set(near) - set(clean) == {300}
    assert "[SECRET]" in marked[301] and "abcdef0123" not in marked[301]
    assert set(marked) == set(clean) and set(mixed) < set(marked)


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert 0 < out.count() < 250
    r = out.filter("doc_id = 301").first()
    assert r is None or r.n_chars == len(r.text)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("query", [q for q in queries.QUERIES if q.__name__ != "pipeline"])
def test_registered_query_runs_on_the_smallest_tables(spark, query):
    out = query(spark, SF)
    assert out.count() > 0


def test_batches_for_python_are_bounded_by_bytes(spark):
    """Ten thousand texts were one batch, whatever their length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "one two three four five six", "en", "s", 27)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        corpus_pipeline.near_duplicates(spark, docs, "")
        long = spark.range(60).select(F.expr("repeat('x', 1000000)").alias("text"))
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
        assert max(r.n for r in long.coalesce(1).mapInArrow(sizes, "n long").collect()) <= 6_000_000
    finally:
        spark.conf.set(key, before)
