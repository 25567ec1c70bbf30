"""Ordered versions: selection, per-version pairs and the leakage report.

``versions`` tables have one row per version (``version, ord, files``); they
are small by nature and the only place where an unpartitioned window is used.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pvspark.functions.stats import pct
from pvspark.functions.versioning import matches_tag, version_key
from pvspark.operators.duplicates import NearDuplicates


def select_versions(
    df: DataFrame, tag_regex: str, max_versions: int | None = None, version: str = "version"
) -> DataFrame:
    """Distinct versions matching the regex, in version order, with ``ord`` from 0."""
    if max_versions is not None and max_versions < 0:
        raise ValueError("max_versions must not be negative")
    names = df.select(F.col(version).alias("version")).distinct()
    matching = names.filter(matches_tag(F.col("version"), tag_regex))
    order = W.orderBy(version_key(F.col("version")), "version")
    ranked = matching.withColumn("ord", F.row_number().over(order) - 1)
    return ranked.filter(F.col("ord") < max_versions) if max_versions else ranked


def files_per_version(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents per version; a version without documents stays with 0."""
    counts = documents.groupBy("version").agg(F.count("*").alias("files"))
    return versions.join(counts, "version", "left").withColumn(
        "files", F.coalesce(F.col("files"), F.lit(0))
    )


def versions_with_documents(counted: DataFrame) -> DataFrame:
    """Versions with at least one document, renumbered without gaps."""
    return counted.filter(F.col("files") > 0).withColumn(
        "ord", F.row_number().over(W.orderBy("ord")) - 1
    )


def boundaries(versions: DataFrame) -> DataFrame:
    """Each version with its successor: ``train_ord, version_a, version_b, ...``."""
    order = W.orderBy("ord")
    return (
        versions.select(
            F.col("ord").alias("train_ord"),
            F.col("version").alias("version_a"),
            F.lead("version").over(order).alias("version_b"),
            F.lead("ord").over(order).alias("test_ord"),
            F.col("files").alias("files_a"),
            F.lead("files").over(order).alias("files_b"),
            F.sum("files").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("train_files"),
        )
        .filter(F.col("test_ord").isNotNull())
    )


# ---- pair lists ---------------------------------------------------------


def version_pairs(dups: NearDuplicates) -> DataFrame:
    """Pairs between different versions, earlier version first."""
    return dups.pairs(lambda earlier, later: earlier < later)


def consecutive_pairs(dups: NearDuplicates) -> DataFrame:
    return dups.pairs(lambda earlier, later: later == earlier + 1)


def within_version_pairs(dups: NearDuplicates) -> DataFrame:
    return dups.pairs(lambda earlier, later: earlier == later)


def leakage_pairs(dups: NearDuplicates) -> DataFrame:
    """Train x test pairs; ``pair`` is the 1-based boundary.

    A pair of two versions leaks at exactly one boundary: the one whose test
    set is the later version.
    """
    return version_pairs(dups).withColumn("pair", F.col("ord_b"))


def boundary_intervals(dups: NearDuplicates, n_versions: int) -> DataFrame:
    """Every pair once, with the boundaries (1-based) it belongs to.

    ``leaks_at``: the boundary whose test set is its later version, null inside
    one version. ``train_from, train_to``: the boundaries whose training set
    holds both files, null if there is none. A pair enters with its later version and
    stays for all later boundaries, so two numbers stand for any number of them.
    """
    last = F.lit(n_versions - 1)
    trained = F.col("ord_b") < last
    return dups.pairs().select(
        "*",
        F.when(F.col("ord_a") < F.col("ord_b"), F.col("ord_b")).alias("leaks_at"),
        F.when(trained, F.col("ord_b") + 1).alias("train_from"),
        F.when(trained, last).alias("train_to"),
    )


def at_boundaries(intervals: DataFrame) -> DataFrame:
    """Training pairs of ``boundary_intervals``, one row per boundary (``pair``)."""
    held = intervals.filter(F.col("train_from").isNotNull())
    return held.withColumn("pair", F.explode(F.sequence("train_from", "train_to")))


def train_duplicate_pairs(dups: NearDuplicates, n_versions: int) -> DataFrame:
    """Pairs inside the training set of each boundary (``pair`` is 1-based)."""
    last = n_versions - 1
    pairs = dups.pairs(lambda earlier, later: later < last)
    return pairs.withColumn("pair", F.explode(F.sequence(F.col("ord_b") + 1, F.lit(last))))


# ---- statistics ---------------------------------------------------------


def file_counts_by_version(dups: NearDuplicates) -> DataFrame:
    """Distinct files per boundary, keyed by the test version ``ord``.

    ``leaking``: files of that version similar to any earlier file.
    ``paired``: files of that version or the one before with a partner in the
    other. Each group only needs the set of versions its partners occur in.
    """
    o, seen = F.col("ord"), F.col("seen")
    use = lambda name, at: F.struct(F.lit(name).alias("use"), at.alias("at"))
    uses = F.array(
        F.when(F.array_min(seen) < o, use("leaking", o)),
        F.when(F.array_contains(seen, o - 1), use("paired", o)),
        F.when(F.array_contains(seen, o + 1), use("paired", o + 1)),
    )
    used = (
        dups.members.join(dups.partners(), ["side", "gid"])
        .select("file", F.inline(F.array_compact(uses)))
        .distinct()
    )
    return used.groupBy(F.col("at").alias("ord")).agg(
        F.count_if(F.col("use") == "leaking").alias("leaking"),
        F.count_if(F.col("use") == "paired").alias("paired"),
    )


def leakage_report(dups: NearDuplicates, versions: DataFrame) -> DataFrame:
    """One row per boundary: duplicate report of the two versions plus leakage.

    Boundaries without any pair keep a row of zeros.
    """
    numbers = dups.pair_numbers().join(file_counts_by_version(dups), "ord", "full_outer")
    zero = F.lit(0).cast("long")
    filled = ["within", "earlier", "consecutive", "consecutive_exact", "leaking", "paired"]
    per_version = versions.select("ord").join(numbers, "ord", "left")
    per_version = per_version.select("ord", *[F.coalesce(F.col(c), zero).alias(c) for c in filled])
    so_far = W.orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    per_version = per_version.withColumn(
        "train_pairs", F.coalesce(F.sum(F.col("within") + F.col("earlier")).over(so_far), zero)
    ).withColumnRenamed("ord", "test_ord")
    total = F.col("files_a") + F.col("files_b")
    return (
        boundaries(versions)
        .join(per_version, "test_ord")
        .select(
            "version_a",
            "version_b",
            total.alias("total_files"),
            F.col("consecutive").alias("duplicate_pairs"),
            F.col("consecutive_exact").alias("exact_duplicate_pairs"),
            F.col("paired").alias("files_with_duplicates"),
            pct(F.col("paired"), total).alias("percentage_files_with_duplicates"),
            F.lit(dups.threshold).alias("threshold"),
            F.col("train_files").alias("training_set_size"),
            F.col("train_pairs").alias("training_duplicate_pairs"),
            F.col("files_b").alias("test_set_size"),
            F.col("leaking").alias("test_entries_with_leakage"),
            pct(F.col("leaking"), F.col("files_b")).alias("test_leakage_percentage"),
            F.col("earlier").alias("leakage_pairs"),
            "test_ord",
        )
        .orderBy("test_ord")
        .drop("test_ord")
    )


REPORT_COLUMNS = [
    "version_a",
    "version_b",
    "total_files",
    "duplicate_pairs",
    "exact_duplicate_pairs",
    "files_with_duplicates",
    "percentage_files_with_duplicates",
    "threshold",
]


def consecutive_report(dups: NearDuplicates, versions: DataFrame) -> DataFrame:
    """The duplicate report of every pair of consecutive versions."""
    return leakage_report(dups, versions).select(*REPORT_COLUMNS)


def overall_result(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("total_pairs_analyzed"),
        F.coalesce(F.sum("duplicate_pairs"), F.lit(0)).alias("total_duplicate_pairs"),
    )


def pair_totals(dups: NearDuplicates) -> DataFrame:
    """``within_pairs, cross_pairs`` over all versions."""
    return dups.pair_numbers().agg(
        F.coalesce(F.sum("within"), F.lit(0)).alias("within_pairs"),
        F.coalesce(F.sum("earlier"), F.lit(0)).alias("cross_pairs"),
    )
