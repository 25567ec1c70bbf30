"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic). Raking scales the
cells until the totals of each dimension meet its targets; the ratio of fitted
to observed tokens is a cell's weight. Sampling probabilities are
``min(1, c * weight)`` with ``c`` calibrated so that the expected number of
tokens is the budget. A document is drawn by a hash of its id and text, so the
draw repeats, and equal rows share their fate.

The topic is a column expression of the caller; ``form`` below tells tables,
shouting, number lists, symbol noise and prose apart.

Targets are given as weights per value, or as an exponent on the observed share
(below 1 flattens a hot source). Values without a given target keep their
observed share; both are normalised to 1.

Results: one row per input row. Nulls of a dimension are a value of their own.
Null and empty texts have 0 tokens; cells without tokens get weight 1.
Empty tables give empty results. Extra columns are ignored or, in ``sample``,
kept. Up to ``local_cells`` cells (counted first) are raked and calibrated in one
place; beyond that the cells and the fitted factor of each value are distributed tables, and
each new factor table is written, so that lineage stays short.
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import drop, store, text_hash

DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Params:
    #: dimension -> exponent on the observed share, or {value: weight}
    targets: dict = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 1.0})
    keep: float = 0.5  # share of all tokens that is expected to stay
    sweeps: int = 20  # at most
    error: float = 1e-6  # of all tokens, in any value's total
    local_cells: int = 20_000  # so many cells are raked in one place, more by joins
    seed: int = 17


def tokens(text: Column) -> Column:
    """Words: runs without white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def form(text: Column) -> Column:
    """A coarse topic from the shape of a text."""
    t = F.coalesce(text, F.lit(""))
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / F.greatest(F.length(t), F.lit(1))
    return (
        F.when(share("[|]") > 0.02, "table")
        .when(share("[!]") > 0.05, "shouting")
        .when(share("[0-9]") > 0.1, "numbers")
        .when(share("[#$%&*]") > 0.1, "noise")
        .otherwise("prose")
    )


def _keys(docs: DataFrame, topic: Column) -> list[Column]:
    cols = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}
    # a null is marked by a leading sign that values get too
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    return [mark(cols[d]).alias(f"__{d}") for d in DIMENSIONS]


def _targets(values: DataFrame, dim: str, target, total: float) -> DataFrame:
    """``__<dim>, share_<dim>``: the wanted share of each value; values: the cells, with ``tokens``."""
    values = values.groupBy(f"__{dim}").agg((F.sum("tokens") / F.lit(total)).alias("observed"))
    if isinstance(target, dict):
        given = F.create_map(*[F.lit(x) for k, v in target.items() for x in (f"={k}", float(v))])
        wanted = F.coalesce(given[F.col(f"__{dim}")], F.col("observed"))
    else:
        wanted = F.pow("observed", F.lit(float(target)))
    values = values.select(f"__{dim}", wanted.alias("wanted"))
    norm = values.agg(F.sum("wanted").alias("all"))
    share = (F.col("wanted") / F.col("all")).alias(f"share_{dim}")
    return values.join(F.broadcast(norm)).select(f"__{dim}", share)


def _target_rows(codes: np.ndarray, names: list[str], tokens: np.ndarray, target, total: float) -> np.ndarray:
    """The same shares over rows of cells; codes: the place in ``names`` of each cell's value."""
    observed = np.bincount(codes, tokens, len(names)) / total
    if isinstance(target, dict):
        given = {f"={k}": float(v) for k, v in target.items()}
        wanted = np.array([given.get(name, seen) for name, seen in zip(names, observed)])
    else:
        wanted = observed ** float(target)
    return wanted / wanted.sum()


def rake(docs: DataFrame, topic: Column, p: Params = Params()) -> DataFrame:
    """``__source, __lang, __topic, tokens, docs, weight``: fitted over observed tokens of each cell."""
    spark = docs.sparkSession
    counted = docs.select(*_keys(docs, topic), tokens(F.col("text")).alias("n"))
    cells, first = store(
        counted.groupBy(*[f"__{d}" for d in DIMENSIONS]).agg(
            F.sum("n").alias("tokens"), F.count("*").alias("docs")
        ),
        "cells",
    )
    full = cells.filter("tokens > 0")
    total, n = full.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return cells.withColumn("weight", F.lit(1.0))
    total = float(total)
    if n <= p.local_cells:
        fitted = _rake_rows(full, p, total)
        return cells.join(fitted, [f"__{d}" for d in DIMENSIONS], "left").fillna({"weight": 1.0})
    shares = [_targets(full, d, p.targets.get(d, 1.0), total) for d in DIMENSIONS]
    for d, share in zip(DIMENSIONS, shares):
        full = full.join(share, f"__{d}")
    full, _ = store(full.withColumn("w", F.col("tokens") / F.lit(total)), "cell-targets")
    factors: dict[str, tuple[DataFrame, str]] = {}

    def fitted() -> DataFrame:
        """The cells under the factors so far; every factor table is a written one."""
        now = full
        for d, (table, _) in factors.items():
            now = now.join(table, f"__{d}").withColumn("w", F.col("w") * F.col(f"f_{d}")).drop(f"f_{d}")
        return now

    for _ in range(p.sweeps):
        worst = 0.0
        for d in DIMENSIONS:
            # the sums are combined before the shuffle, so a hot value is no hot task
            sums = fitted().groupBy(f"__{d}").agg(F.sum("w").alias("sum"), F.first(f"share_{d}").alias("share"))
            old = factors.get(d)
            if old:
                sums = sums.join(old[0], f"__{d}")
            before = F.col(f"f_{d}") if old else F.lit(1.0)
            factor = before * F.col("share") / F.col("sum")
            table, path = store(
                sums.select(f"__{d}", factor.alias(f"f_{d}"), F.abs(F.col("sum") - F.col("share")).alias("off")),
                "factors",
            )
            worst = max(worst, table.agg(F.max("off")).first()[0])
            factors[d] = table.drop("off"), path
            if old:
                drop(spark, old[1])
        if worst < p.error:
            break
    weight = (F.col("w") * F.lit(total) / F.col("tokens")).alias("weight")
    keys = [f"__{d}" for d in DIMENSIONS]
    return cells.join(fitted().select(*keys, weight), keys, "left").fillna({"weight": 1.0})


def _rake_rows(full: DataFrame, p: Params, total: float) -> DataFrame:
    """The same sweeps over the rows of a cell table whose size was checked."""
    rows = full.orderBy(*[f"__{d}" for d in DIMENSIONS]).toPandas()
    count = rows["tokens"].to_numpy()
    w = count / total
    sides = []
    for d in DIMENSIONS:
        codes, values = pd.factorize(rows[f"__{d}"])
        sides.append((codes, _target_rows(codes, list(values), count, p.targets.get(d, 1.0), total)))
    for _ in range(p.sweeps):
        worst = 0.0
        for codes, target in sides:
            now = np.bincount(codes, w, len(target))
            worst = max(worst, float(np.abs(now - target).max()))
            w *= (target / now)[codes]
        if worst < p.error:
            break
    keys = [f"__{d}" for d in DIMENSIONS]
    # an Arrow table becomes a local relation; of other rows Spark makes an RDD that starts Python workers of its own
    weights = pa.table({**{k: pa.array(rows[k], pa.string()) for k in keys}, "weight": pa.array(w * total / count)})
    return full.sparkSession.createDataFrame(weights)


def calibrate(cells: DataFrame, keep: float, local_cells: int = Params.local_cells) -> float:
    """``c`` for which the expected share of tokens is ``keep``; the cells are asked 15 values a time.

    Up to ``local_cells`` cells with tokens are asked in one place, since each question is a plan to compile for Spark.
    """
    if keep >= 1:
        least = cells.agg(F.min("weight")).first()[0]
        return 1 / least if least else 1.0
    full = cells.filter("tokens > 0").select("tokens", "weight")
    total, n = full.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return 1.0
    if n <= local_cells:
        rows = full.orderBy("tokens", "weight").toPandas()
        count, weight = rows["tokens"].to_numpy(), rows["weight"].to_numpy()
        expect = lambda cs: [float((count * np.fmin(1.0, weight * c)).sum()) for c in cs]
    else:
        expect = lambda cs: full.agg(
            *[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * c)).alias(f"e{i}") for i, c in enumerate(cs)]
        ).first()
    lo, hi = 0.0, 1.0
    for _ in range(60):
        if expect([hi])[0] >= keep * total:
            break
        lo, hi = hi, hi * 4
    for _ in range(12):
        cs = [lo + (hi - lo) * k / 16 for k in range(1, 16)]
        below = [c for c, e in zip(cs, expect(cs)) if e < keep * total]
        lo, hi = (below[-1] if below else lo), (cs[len(below)] if len(below) < len(cs) else hi)
        if hi - lo <= 1e-12 * hi:
            break
    return hi


def probabilities(docs: DataFrame, topic: Column | None = None, p: Params = Params()) -> DataFrame:
    """All rows and columns of ``docs`` and ``__topic, __weight, __probability, __kept``."""
    topic = form(F.col("text")) if topic is None else topic
    cells, _ = store(rake(docs, topic, p), "cell-weights")
    c = calibrate(cells, p.keep, p.local_cells)
    keys = [f"__{d}" for d in DIMENSIONS]
    tagged = docs.select("*", *_keys(docs, topic))
    weighed = tagged.join(cells.select(*keys, F.col("weight").alias("__weight")), keys, "left")
    probability = F.least(F.lit(1.0), F.col("__weight") * F.lit(c))
    span = 1 << 52
    draw = F.pmod(F.xxhash64(F.lit(p.seed), "doc_id", text_hash(F.col("text"))), F.lit(span)) / F.lit(float(span))
    return weighed.select(
        *[docs[x] for x in docs.columns],
        F.expr("substr(__topic, 2)").alias("__topic"),
        "__weight",
        probability.alias("__probability"),
        (draw < probability).alias("__kept"),
    )


def sample(docs: DataFrame, topic: Column | None = None, p: Params = Params()) -> DataFrame:
    """The drawn rows with their columns and ``__probability``."""
    return probabilities(docs, topic, p).filter("__kept").drop("__topic", "__weight", "__kept")
