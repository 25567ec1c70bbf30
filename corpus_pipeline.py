"""Preparing ``documents`` for training: five stages, each over all that the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame with the columns
of ``docs`` (the last adds ``sample_probability``). ``run`` writes each result
to the shared scratch folder and reads it back, so a lost executor costs one
stage at most and no plan spans two stages. No stage can be told in SQL as a
whole: the first learns its model, and the others build on its decisions.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.llm import decontaminate, jaccard, langid, mixing, secrets
from pvspark.llm.common import drop, store, table
from pvspark.session import bounded_batches

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language is rejected: no letters, or less sure than clean texts of its length."""
    bounded_batches(spark)
    return langid.keep_known(docs, langid.train(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by sets of five-word shingles with a Jaccard of 0.8 or more."""
    bounded_batches(spark)
    return jaccard.keep_one(docs, jaccard.Params(words=5, num=4, den=5))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of ``benchmark``."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_marks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, all documents stay; ``n_chars`` follows the text."""
    before = docs.withColumn("__n", F.length("text"))
    clean = secrets.redact(before)
    now = F.length("text")
    changed = F.when(now != F.col("__n"), now).otherwise(F.col("n_chars"))
    kind = dict(docs.dtypes)["n_chars"]
    return clean.withColumn("n_chars", changed.cast(kind)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half the words, raked to flatter shares of sources and languages."""
    return mixing.sample(docs).withColumnRenamed("__probability", "sample_probability")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secret_marks", secret_marks),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = store(stage(spark, docs, sf_dir), name)
        if at:
            drop(spark, at)
        at = path
    return docs
