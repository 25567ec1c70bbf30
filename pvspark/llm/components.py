"""Connected components of a link table by repeated contraction, in DataFrame operations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import drop, store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node that has a link; equal labels are one component.

    Each round every node moves to its smallest neighbour and the links move
    along; rounds end when all links have become loops. Sums of a hot node are
    combined before the shuffle. Nothing passes through the driver.
    """
    spark = links.sparkSession
    edges, edges_at = store(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct(), "links"
    )
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    labels, labels_at = store(nodes.withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        moved, moved_at = store(
            both.groupBy(F.col("u").alias("old"))
            .agg(F.min("v").alias("least"))
            .select("old", F.least("old", "least").alias("new")),
            "moved",
        )
        step = labels.join(moved, F.col("label") == F.col("old"), "left")
        labels_next, at = store(step.select("node", F.coalesce("new", "label").alias("label")), "labels")
        to = lambda name: moved.withColumnsRenamed({"old": f"{name}_old", "new": f"{name}_new"})
        onward = (
            edges.join(to("u"), F.col("u") == F.col("u_old"))
            .join(to("v"), F.col("v") == F.col("v_old"))
            .select(
                F.least("u_new", "v_new").alias("u"),
                F.greatest("u_new", "v_new").alias("v"),
            )
            .filter("u != v")
            .distinct()
        )
        edges_next, edges_next_at = store(onward, "links")
        drop(spark, labels_at, edges_at, moved_at)
        labels, labels_at, edges, edges_at = labels_next, at, edges_next, edges_next_at
    return labels
