"""Session defaults and the shared scratch area used to cut lineage."""

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def builder(app_name: str = "pvspark"):
    """A session builder with this library's defaults; callers add master and sizes."""
    b = SparkSession.builder.appName(app_name)
    for key, value in DEFAULTS.items():
        b = b.config(key, value)
    return b


def local_session(cpus: int, memory: str = "8g", app_name: str = "pvspark-local"):
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    return (
        builder(app_name)
        .master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python workers hold at most 4 MB, however long texts are; a setting of the cluster stays.

    Spark's 10,000 rows of texts are some 34 MB, and it keeps the buffers it has grown for them.
    """
    if spark.sparkContext.getConf().get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(4 << 20))


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary directory, since executors elsewhere cannot see it.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    fallback = tempfile.mkdtemp(prefix="pvspark-")
    sc.setCheckpointDir(fallback)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(
    df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str | None = None
) -> DataFrame:
    """Write ``df`` once to the scratch area and return the table read back.

    Used where a result feeds several jobs or a loop: a lost executor then
    costs a re-read of files, not a re-run of the loop.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", compression) if compression else df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for table in tables:
        discard_folder(table.sparkSession, table.scratch)


def discard_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the scratch area that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the files of shuffles that nothing refers to any more.

    It does so when the driver collects garbage, which may be half an hour away;
    a loop that shuffles much asks for it where a step's results are stored.
    """
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Use every core for a CPU-heavy narrow stage over an input of few splits.

    Decided on the optimizer's size estimate, so no job runs and no plan is
    built: an input of more than a split a core is left alone.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df
