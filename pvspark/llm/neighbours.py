"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Equal vectors are one node, so a vector that a third of the rows share costs one.

Graph. Lists of ``k`` neighbours start from exact search inside small random
blocks (sign codes of random projections, several tables). Each round of
NN-descent is a Spark join: every node gathers its neighbours and a sample of
the nodes that list it, compares them with each other - pairs with at least one
side new since the last round - and offers each the best it has not got; the
offers are merged into the lists. Vectors travel as one byte per component with
a scale; this affects only which candidates are found.

Search. A query starts from its own list. Each round it expands the ``expand``
best nodes of its beam that are not expanded yet, by joins with the graph. What
is reached is brought together by query, compared there, and the ``beam`` best
stay; the search ends when no beam holds a node to expand. The survivors are
scored in double precision on the original vectors, and equal vectors are
expanded to row ids.

Results: ``query_id, rank, vec_id, score``, fewer rows where there are fewer
candidates. Null, zero and empty vectors and those with null or non-finite
components take no part, nor do null ids. Vectors of another length than a
query's are no candidates of it: each length is searched on its own. Repeated
ids are kept as separate rows. Empty tables give empty results. Extra columns
are ignored.
"""

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvspark.llm.common import drop, store, whole_groups
from pvspark.session import bounded_batches

LISTS = "node long, ids array<long>, sims array<float>, old array<boolean>"


@dataclass(frozen=True)
class Params:
    k: int = 40
    tables: int = 4
    block: int = 400
    settled: float = 0.001  # the graph is done when a round changes less than this share of its entries
    reverse: int = 32
    offers: int = 12
    beam: int = 128
    expand: int = 32
    top: int = 20
    seed: int = 5


def _sorted(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(0).to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), size)


def _best(node, ids, sims, old, k: int):
    """The ``k`` best distinct ids of each node, as Arrow columns of ``LISTS``."""
    order = np.lexsort((~old, ids, node))
    node, ids, sims, old = node[order], ids[order], sims[order], old[order]
    first = np.ones(len(node), bool)
    first[1:] = (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])
    node, ids, sims, old = node[first], ids[first], sims[first], old[first]
    order = np.lexsort((ids, -sims, node))
    node, ids, sims, old = node[order], ids[order], sims[order], old[order]
    start = np.searchsorted(node, node)
    top = np.arange(len(node)) - start < k
    node, ids, sims, old = node[top], ids[top], sims[top], old[top]
    keys, begin = np.unique(node, return_index=True)
    at = pa.array(np.append(begin, len(node)).astype(np.int32))
    lists = lambda v: pa.ListArray.from_arrays(at, pa.array(v))
    return [pa.array(keys), lists(ids), lists(sims.astype(np.float32)), lists(old)]


def _merge(rows: DataFrame, k: int) -> DataFrame:
    """Lists of ``LISTS`` rows with the same node merged into one of the ``k`` best."""

    def run(batches):
        for table in whole_groups(batches):
            ids, row = _flat(table.column(1))
            sims, _ = _flat(table.column(2))
            old, _ = _flat(table.column(3))
            node = table.column(0).to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                _best(node, ids, sims, old.astype(bool), k), ["node", "ids", "sims", "old"]
            )

    # offers of one task are cut to the best before they are dealt out
    return _sorted(rows, "node").mapInArrow(run, LISTS)


def _codes(vectors: DataFrame) -> DataFrame:
    """``node, code, scale``: a byte per component."""

    def run(batches):
        for batch in batches:
            values, row = _flat(batch.column(1))
            values = values.astype(np.float64)
            most = np.maximum.reduceat(np.abs(values), np.searchsorted(row, np.arange(len(batch)))) if len(batch) else values
            code = np.rint(values / most[row] * 127).astype(np.int8)
            cut = np.searchsorted(row, np.arange(len(batch) + 1))
            made = [code[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made, pa.binary()), pa.array((most / 127).astype(np.float32))],
                ["node", "code", "scale"],
            )

    return vectors.select("node", "v").mapInArrow(run, "node long, code binary, scale float")


def _matrix(codes, scales) -> np.ndarray:
    m = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(codes), -1)
    return m.astype(np.float32) * scales.to_numpy()[:, None]


def _blocks(codes: DataFrame, n: int, dim: int, p: Params) -> DataFrame:
    """First lists: exact neighbours inside random blocks of about ``block`` nodes, several times over."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / p.block)))))
    planes = np.random.default_rng(p.seed).normal(size=(p.tables, bits, dim)).astype(np.float32)
    k = p.k

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column(1), batch.column(2)) if len(batch) else np.zeros((0, dim), np.float32)
            for t in range(len(planes)):
                code = ((x @ planes[t].T > 0) * (1 << np.arange(bits))).sum(axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code * len(planes) + t), *(batch.column(i) for i in range(3))],
                    ["block", "node", "code", "scale"],
                )

    placed, placed_at = store(codes.mapInArrow(place, "block long, node long, code binary, scale float"), "blocks")
    # a crowded code is dealt out at random into parts of the wanted size
    parts = placed.groupBy("block").agg(F.ceil(F.count("*") / F.lit(2 * p.block)).alias("parts"))
    part = F.pmod(F.xxhash64("node", "block"), F.col("parts"))
    dealt = placed.join(parts, "block").select("block", part.alias("part"), "node", "code", "scale")

    def search(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("code"), table.column("scale"))
        node = table.column("node").to_numpy()
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        m = min(k, len(node) - 1)
        if m < 1:
            top = np.zeros((len(node), 0), np.int64)
        else:
            top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
        at = pa.array((np.arange(len(node) + 1) * max(m, 0)).astype(np.int32))
        lists = lambda v: pa.ListArray.from_arrays(at, pa.array(v.ravel()))
        return pa.table(
            {
                "node": pa.array(node),
                "ids": lists(node[top]),
                "sims": lists(np.take_along_axis(sims, top, axis=1) if m > 0 else np.zeros((0,), np.float32)),
                "old": lists(np.zeros(top.shape, bool)),
            }
        )

    return _merge(dealt.groupBy("block", "part").applyInArrow(search, LISTS), k), placed_at


def _local_join(graph: DataFrame, codes: DataFrame, p: Params, turn: int) -> DataFrame:
    """Offers: neighbours of one node as neighbours of each other."""
    listed = graph.select(
        F.col("node").alias("centre"), F.inline(F.arrays_zip("ids", "old")).alias("m", "old")
    )
    known = F.pmod(F.xxhash64(F.lit(turn), "centre", "m"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    often = listed.groupBy("m").agg(F.count("*").alias("often"))
    back = listed.join(often, "m").filter(known < F.lit(float(p.reverse)) / F.col("often"))
    members = listed.union(back.select(F.col("m").alias("centre"), F.col("centre").alias("m"), "old"))
    # a list that is not full takes any offer
    worst = F.when(F.size("ids") < p.k, F.lit(float("-inf"))).otherwise(F.array_min("sims"))
    nodes = codes.join(graph.select("node", worst.cast("float").alias("worst")), "node")
    rows = members.join(nodes, F.col("m") == F.col("node")).select(
        "centre", "m", "old", "code", "scale", "worst"
    )
    offers = p.offers

    def run(batches):
        for table in whole_groups(batches):
            table = table.combine_chunks()
            centre, m = table.column(0).to_numpy(), table.column(1).to_numpy()
            old = table.column(2).to_numpy(zero_copy_only=False).astype(bool)
            x, worst = _matrix(table.column(3), table.column(4)), table.column(5).to_numpy()
            cut = np.flatnonzero(np.diff(centre, prepend=centre[0] - 1, append=centre[-1] + 1))
            who, ids, sims = [], [], []
            for a, b in zip(cut[:-1], cut[1:]):
                _, one = np.unique(m[a:b], return_index=True)
                one += a
                s = x[one] @ x[one].T
                s[old[one][:, None] & old[one][None, :]] = -np.inf
                np.fill_diagonal(s, -np.inf)
                s[s <= worst[one][:, None]] = -np.inf
                few = min(offers, len(one))
                top = np.argpartition(-s, few - 1, axis=1)[:, :few]
                value = np.take_along_axis(s, top, axis=1)
                i, j = np.nonzero(value > -np.inf)
                who.append(m[one][i])
                ids.append(m[one][top[i, j]])
                sims.append(value[i, j])
            who, ids, sims = np.concatenate(who), np.concatenate(ids), np.concatenate(sims)
            if len(who):
                yield pa.RecordBatch.from_arrays(
                    _best(who, ids, sims, np.zeros(len(who), bool), 4 * offers), ["node", "ids", "sims", "old"]
                )

    return _sorted(rows, "centre").mapInArrow(run, LISTS)


def build(vectors: DataFrame, n: int, dim: int, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """``vectors``: ``node, v`` without equal vectors. The graph and the codes, both stored."""
    spark = vectors.sparkSession
    codes, _ = store(_codes(vectors), "codes")
    first, placed_at = _blocks(codes, n, dim, p)
    graph, at = store(first, "graph")
    drop(spark, placed_at)
    # lists only get better, so this ends
    for turn in itertools.count():
        offers = _local_join(graph, codes, p, turn)
        aged = graph.withColumn("old", F.transform("ids", lambda x: F.lit(True)))
        merged, merged_at = store(_merge(aged.union(offers), p.k), "graph")
        new = merged.agg(F.sum(F.size(F.filter("old", lambda x: ~x)))).first()[0] or 0
        drop(spark, at)
        graph, at = merged, merged_at
        if new <= p.settled * n * p.k:
            break
    return graph, codes


def search(graph: DataFrame, codes: DataFrame, queries: DataFrame, p: Params = Params()) -> DataFrame:
    """``node, ids``: the beam of each query node after greedy search."""
    spark = graph.sparkSession
    # here ``old`` marks the expanded ones
    asked, asked_at = store(queries.select("node").distinct(), "asked")
    beam, at = store(
        graph.join(asked, "node").withColumn("old", F.transform("ids", lambda x: F.lit(False))), "beam"
    )
    near = graph.select(F.col("node").alias("via"), F.col("ids").alias("next"))
    own = codes.join(asked, "node").select("node", F.col("node").alias("y"), "code", "scale")
    target = codes.select(F.col("node").alias("y"), "code", "scale")

    def compare(batches):
        """Rows sorted by query; the query's own code is the row where both ids are equal."""
        for table in whole_groups(batches):
            table = table.combine_chunks()
            node, y = table.column(0).to_numpy(), table.column(1).to_numpy()
            x = _matrix(table.column(2), table.column(3))
            mine = np.flatnonzero(node == y)
            others = np.flatnonzero(node != y)
            if not len(others):
                continue
            mine = mine[np.searchsorted(node[mine], node[others])]
            sims = np.einsum("ij,ij->i", x[mine], x[others])
            yield pa.RecordBatch.from_arrays(
                _best(node[others], y[others], sims, np.zeros(len(others), bool), p.beam),
                ["node", "ids", "sims", "old"],
            )

    # a node leaves a beam only for better ones, so it is expanded once for a query, and this ends
    while True:
        waiting = F.filter(F.arrays_zip("ids", "old"), lambda x: ~x["old"])
        # lists are ordered, the best first
        front = beam.withColumn("front", F.slice(F.transform(waiting, lambda x: x["ids"]), 1, p.expand))
        going = front.filter(F.size("front") > 0)
        if going.isEmpty():
            drop(spark, asked_at)
            return beam
        # at most ``expand`` lists of ``k`` a query
        reached = (
            going.select("node", "ids", F.explode("front").alias("via"))
            .join(near, "via")
            .groupBy("node")
            .agg(F.first("ids").alias("ids"), F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
            .select("node", F.explode(F.array_except("next", "ids")).alias("y"))
            .filter("node != y")
        )
        scored = _sorted(
            reached.join(target, "y").select("node", "y", "code", "scale").union(own), "node"
        ).mapInArrow(compare, LISTS)
        done = front.withColumn(
            "old", F.transform(F.arrays_zip("ids", "old"), lambda x: x["old"] | F.array_contains("front", x["ids"]))
        ).select("node", "ids", "sims", "old")
        merged, merged_at = store(_merge(done.union(scored), p.beam), "beam")
        drop(spark, at)
        beam, at = merged, merged_at


def _usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, p: Params = Params()) -> DataFrame:
    """``vectors``: ``vec_id, embedding``; queries are the rows where ``is_query`` (on vec_id) holds."""
    bounded_batches(vectors.sparkSession)
    rows, _ = store(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter(
            F.col("vec_id").isNotNull() & _usable(F.col("embedding"))
        ),
        "vectors",
    )
    sizes = [r[0] for r in rows.select(F.size("v")).distinct().collect()]
    found = [_nearest(rows.filter(F.size("v") == d), is_query, d, p) for d in sizes]
    out = found[0] if found else rows.select(
        F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")
    ).limit(0)
    for more in found[1:]:
        out = out.union(more)
    return out


def _nearest(rows: DataFrame, is_query: Column, dim: int, p: Params) -> DataFrame:
    # the number of a node is fixed once written
    named, _ = store(
        rows.groupBy("v").count().select("v", F.monotonically_increasing_id().alias("node")), "nodes"
    )
    owned, _ = store(rows.join(named.select("v", "node"), "v").select("vec_id", "node"), "owned")
    n = named.count()
    graph, codes = build(named, n, dim, p)
    queries, _ = store(owned.filter(is_query), "queries")
    beam = search(graph, codes, queries, p)
    asked = queries.select("node").distinct()
    pairs = beam.select("node", F.explode("ids").alias("y")).union(asked.select("node", F.col("node").alias("y")))
    vec = named.select("node", "v")
    product = F.aggregate(
        F.zip_with("q", "w", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    scored = (
        pairs.join(vec.withColumnRenamed("v", "q"), "node")
        .join(vec.withColumnsRenamed({"node": "y", "v": "w"}), "y")
        .select("node", "y", product.alias("score"))
    )
    # at most top + 1 ids of a vector can be needed; the limit acts before the shuffle too
    by_id = Window.partitionBy("node").orderBy("vec_id")
    first = owned.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= p.top + 1)
    members = first.groupBy("node").agg(F.collect_list("vec_id").alias("members"))
    answer = (
        scored.join(members.withColumnRenamed("node", "y"), "y")
        .select("node", "score", F.explode("members").alias("vec_id"))
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("all"))
        .select("node", F.slice("all", 1, p.top + 1).alias("all"))
    )
    given = queries.withColumnRenamed("vec_id", "query_id").join(answer, "node")
    # of several rows with the query's id only one is the query's own
    own = F.array_position(F.transform("all", lambda s: s["vec_id"]), F.col("query_id"))
    others = F.when(own > 0, F.concat(F.slice("all", F.lit(1), (own - 1).cast("int")), F.slice("all", (own + 1).cast("int"), F.lit(p.top + 1)))).otherwise(F.col("all"))
    return given.select("query_id", F.posexplode(F.slice(others, 1, p.top)).alias("i", "s")).select(
        "query_id",
        (F.col("i") + 1).cast("int").alias("rank"),
        F.col("s.vec_id").alias("vec_id"),
        (-F.col("s.s")).alias("score"),
    )
