"""Duplicate analysis of one or two embedding sets."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.operators.duplicates import NearDuplicates, near_duplicates, two_sets
from pvspark.operators.similarity import DEFAULT_THRESHOLD
from pvspark.sources import sinks
from pvspark.sources.tables import read_embeddings_csv, version_label


@dataclass
class DuplicateAnalysis:
    found: NearDuplicates
    versions: tuple[str, str] | None = None  # labels of the two sets

    def pairs(self) -> DataFrame:
        return self.found.sorted_pairs()

    def report(self) -> DataFrame:
        """One row; of two labelled sets it begins with their labels."""
        row = self.found.report()
        if not self.versions:
            return row
        a, b = self.versions
        return row.select(F.lit(a).alias("version_a"), F.lit(b).alias("version_b"), "*")

    def save(self, prefix: str) -> None:
        """Pairs as CSV (only if there are any) and the report as JSON."""
        none = self.found.links.isEmpty()
        sinks.write_pairs(self.pairs(), f"{prefix}_duplicates.csv", empty=none)
        sinks.write_metadata(self.report(), f"{prefix}_metadata.json")


def analyze_duplicates(
    embeddings: DataFrame, threshold: float = DEFAULT_THRESHOLD, **kw
) -> DuplicateAnalysis:
    """``embeddings``: ``file_path, embedding``."""
    return DuplicateAnalysis(near_duplicates(embeddings, threshold, **kw))


def analyze_cross(
    set_a: DataFrame, set_b: DataFrame, threshold: float = DEFAULT_THRESHOLD, **kw
) -> DuplicateAnalysis:
    return DuplicateAnalysis(two_sets(set_a, set_b, threshold, **kw))


def analyze_csv(
    spark: SparkSession,
    embeddings: str,
    embeddings_b: str | None = None,
    threshold: float = DEFAULT_THRESHOLD,
) -> DuplicateAnalysis:
    """The same on wide CSV files: one set, or two when ``embeddings_b`` is given."""
    first = read_embeddings_csv(spark, embeddings)
    if embeddings_b is None:
        return analyze_duplicates(first, threshold)
    found = analyze_cross(first, read_embeddings_csv(spark, embeddings_b), threshold)
    found.versions = tuple(labels(spark, embeddings, embeddings_b))
    return found


def labels(spark: SparkSession, *paths: str) -> list[str]:
    """Version labels of CSV paths."""
    columns = [version_label(F.lit(p.rstrip("/"))) for p in paths]
    return list(spark.range(1).select(*columns).first())
