"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is one or two runs of words at a fixed distance, a mask; what lies
between is ignored. The masks follow from the rule below, so that any places of
the substitutions it allows leave a seed whole: cut into blocks of equal length,
a window keeps at least two blocks, and the masks pair a block with the next
ones (15 words with 3 substitutions: 5 blocks of 3, so 4 masks of 6 words).
Items shorter than a window have masks of their own length. Seeds of all
benchmark positions are joined on their hash with seeds of every ``stride``-th
document position (all). A hit fixes an alignment (document,
item, shift). Each alignment is verified word by word: there must be ``window``
consecutive item words (all of a shorter item) of which a share ``least`` stand
at the same shifted places of the document.

Items of fewer than ``sure`` words act only if they are rare: the matches to be
expected by chance in ``span`` words, were these drawn one by one with the
frequencies counted in the documents, must be at most ``chance``. This is a rate:
an item that acts on a table acts on any number of copies of it as well. ``unsearchable`` lists
the other ones ("yes", "of the"); nothing is dropped for them.

Results: ``leaks`` gives one row per document row-value and item that verify,
with the most matching words found in one window. Words are runs without white
space in lower case. Null and empty texts and items give nothing. Repeated rows count once
in ``leaks`` and are all dropped by ``keep_clean``; null ids match themselves.
Extra columns are ignored.
"""

import math
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import store, text_hash


@dataclass(frozen=True)
class Params:
    stride: int = 1
    window: int = 15
    least: float = 0.8
    sure: int = 10
    chance: float = 0.01
    span: int = 20_000  # words of a long document
    broadcast_rows: int = 200_000  # of about 40 bytes each


def words(text: Column) -> Column:
    parts = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    return F.array_remove(parts, "")


def masks(size: int, wrong: int) -> list[tuple[int, tuple[int, ...]]]:
    """Masks ``(words of a block, offsets of blocks)``: with ``wrong`` words of ``size`` replaced, one is whole."""
    if wrong <= 0:
        return [(size, (0,))]
    block = size // (wrong + 2)
    if block < 2 and wrong == 1:  # too short for blocks: all words but one
        return [(1, tuple(k for k in range(size) if k != gone)) for gone in range(size)]
    if block < 1:
        return [(1, (0,))]
    blocks = size // block
    # of blocks - wrong whole ones, two neighbours are at most so many blocks apart
    furthest = (blocks - 1) // (blocks - wrong - 1)
    return [(block, (0, block * k)) for k in range(1, furthest + 1)]


def _needed(size: int, p: Params) -> list[tuple[int, tuple[int, ...]]]:
    return masks(size, size - math.ceil(size * p.least))


def _seeds(rows: DataFrame, used: list[tuple[int, tuple[int, ...]]], stride: int, keep: list[str]) -> DataFrame:
    """``keep, place, seed`` from rows with a column ``text``."""
    # the generators keep each array from being computed again for every element
    split = rows.select(*keep, F.explode(F.array(words(F.col("text")))).alias("w")).filter(F.size("w") > 0)
    hashed = split.select(*keep, F.explode(F.array(F.transform("w", lambda w: F.xxhash64(w)))).alias("h"))
    # a row for each place: from here on there are no lambdas, so seeds are made and looked up in generated code
    shortest = min(b + offsets[-1] for b, offsets in used)
    places = F.when(F.size("h") >= shortest, F.sequence(F.lit(0), F.size("h") - shortest, F.lit(stride)))
    placed = hashed.select(*keep, "h", F.explode(places).alias("place"))

    def seed(b, offsets):
        parts = [F.get("h", F.col("place") + F.lit(k + i)) for k in offsets for i in range(b)]
        made = F.xxhash64(F.lit(crc32(f"{b} {offsets}".encode())), *parts)
        return made if b + offsets[-1] == shortest else F.when(F.col("place") + F.lit(b + offsets[-1]) <= F.size("h"), made)

    seeds = placed.select(*keep, "place", F.explode(F.array(*[seed(*mask) for mask in used])).alias("seed"))
    return seeds.filter(F.col("seed").isNotNull())


def _small(df: DataFrame, limit: int) -> DataFrame:
    """A broadcast hint for a stored table of at most ``limit`` rows; larger ones meet by shuffle."""
    return F.broadcast(df) if df.count() <= limit else df


def _matches(doc: str, item: str, shift: str) -> Column:
    """0 or 1 for every item word, whether the document has it at the shifted place."""
    n = F.size(item)
    same = lambda k: F.get(doc, k + F.col(shift)) == F.get(item, k)
    return F.transform(
        F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(same(k), F.lit(False)).cast("int")
    )


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()


def unsearchable(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """``item_id, text, expected``: items of under ``sure`` words that ordinary text may hold by chance.

    ``expected`` counts matches in ``span`` words. A word that no document holds matches nothing.
    """
    items = _items(benchmark).withColumn("w", words(F.col("text")))
    short = items.filter((F.size("w") > 0) & (F.size("w") < p.sure))
    vocabulary = short.select(F.explode("w").alias("word")).distinct()
    # the generator keeps each text from being cut again
    texts = docs.select(F.explode(F.array(words(F.col("text")))).alias("d"))
    counts = (
        texts.select(F.explode("d").alias("word"))
        .join(_small(vocabulary, p.broadcast_rows), "word")
        .groupBy("word")
        .agg(F.count("*").alias("c"))
    )
    total = texts.agg(F.sum(F.size("d"))).first()[0] or 0
    share = F.coalesce("c", F.lit(0)) / F.lit(max(total, 1) * 1.0)
    size, ways = F.size("shares"), F.lit(1.0)
    needed = {n: math.ceil(n * p.least) for n in range(1, p.sure)}
    kept = F.lit(0)
    for n, k in needed.items():
        kept = F.when(size == n, k).otherwise(kept)
        ways = F.when(size == n, float(math.comb(n, k))).otherwise(ways)
    # of the words that have to stand, the most frequent ones
    product = F.aggregate(F.slice(F.sort_array("shares", asc=False), F.lit(1), kept), F.lit(1.0), lambda a, x: a * x)
    return (
        short.select("item_id", "text", F.explode("w").alias("word"))
        .join(counts, "word", "left")
        .groupBy("item_id", "text")
        .agg(F.collect_list(share).alias("shares"))
        .select("item_id", "text", (product * ways * float(p.span)).alias("expected"))
        .filter(F.col("expected") > p.chance)
    )


def leaks(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, hash, item_id, matched, of``: words of the best window and its length."""
    items = _items(benchmark).withColumn("size", F.least(F.lit(p.window), F.size(words(F.col("text")))))
    if not items.filter((F.col("size") > 0) & (F.col("size") < p.sure)).isEmpty():
        common, _ = store(unsearchable(docs, benchmark, p).select(F.col("text").alias("common")), "common-items")
        items = items.join(common.distinct(), F.col("text") == F.col("common"), "left_anti")
    # at most ``window`` sizes
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect() if r["size"]) or [p.window]
    used = list(dict.fromkeys(mask for size in sizes for mask in _needed(size, p)))
    seeds = [_seeds(items.filter(F.col("size") == size), _needed(size, p), 1, ["item_id"]) for size in sizes]
    index, _ = store(
        reduce(DataFrame.unionByName, seeds).select("item_id", F.col("place").alias("item_place"), "seed"),
        "benchmark-seeds",
    )
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    rows = rows.withColumn("hash", text_hash(F.col("text")))
    met = _seeds(rows, used, p.stride, ["doc_id", "hash"]).join(_small(index, p.broadcast_rows), "seed")
    hits, _ = store(
        met.select("doc_id", "hash", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct(),
        "benchmark-hits",
    )
    h = _small(hits, p.broadcast_rows)
    found = (
        rows.join(
            h.withColumnsRenamed({"doc_id": "hit_id", "hash": "hit_hash"}),
            F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("hash") == F.col("hit_hash")),
        )
        .select("doc_id", "hash", "item_id", "shift", F.explode(F.array(words(F.col("text")))).alias("d"))
        .join(
            items.select("item_id", words(F.col("text")).alias("w")).withColumnRenamed("item_id", "i"),
            F.col("item_id").eqNullSafe(F.col("i")),
        )
        .select("doc_id", "hash", "item_id", F.explode(F.array(_matches("d", "w", "shift"))).alias("m"))
    )
    size = F.least(F.lit(p.window), F.size("m"))
    sums = F.transform(
        F.sequence(F.lit(0), F.size("m") - size),
        lambda s: F.aggregate(F.slice("m", s + 1, size), F.lit(0), lambda a, x: a + x),
    )
    best = found.select("doc_id", "hash", "item_id", F.array_max(sums).alias("matched"), size.alias("of"))
    return (
        best.filter(F.col("matched") >= F.ceil(F.col("of") * F.lit(p.least)))
        .groupBy("doc_id", "hash", "item_id")
        .agg(F.max("matched").alias("matched"), F.max("of").alias("of"))
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows and columns of ``docs`` that hold no passage of the benchmark."""
    bad, _ = store(leaks(docs, benchmark, p).select("doc_id", "hash").distinct(), "leaking")
    bad = bad.withColumnsRenamed({"doc_id": "bad_id", "hash": "bad_hash"})
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (text_hash(docs["text"]) == bad["bad_hash"])
    return docs.join(_small(bad, p.broadcast_rows), same, "left_anti")
