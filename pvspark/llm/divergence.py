"""How far the sources of each language lie apart in their words.

Documents are counted with in-mapper stripes: a task folds whole documents into
one hash table from (language, term) to a stripe, that is for each source the
number of occurrences and of documents. A table past its bound is handed to the
shuffle (a spill) and begun anew. Stripes of one key meet once, and their sums
are the merged stripe: no pair of a document and a term is ever shuffled.

A language keeps the V terms that at least ``least`` of its documents hold. With
N the occurrences of kept terms, a group's share of a term with count c is
p = 1 + floor(1000000000 * (c + 2) / (N + 2 * V)), and two shares p, q lie
floor((p - q)^2 / (p + q)) apart, all in integers. The kept stripes, dealt by
language and a hash of the term, emit the distances directly: for two sources
what a block of terms adds to their sum, and per group the terms it uses more
than its language.

Null text, language and source count as empty ones. A term is a run of ASCII
letters and of characters above 0x7F, A to Z as lower case. Repeated rows count
as documents of their own. A language without kept terms has distances of 0; a
group without terms has its row for every other source. Very long texts are
folded like others. An empty table gives no rows; ``doc_id`` and other columns
are not looked at.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pvspark.llm.common import drop, pieces, store

HELD_CELLS = 400_000  # (language, term, source) cells in a task's table
LOOSE_CELLS = 400_000  # cells folded at a time
BLOCK_TERMS = 2048
DENSE_CELLS = 1 << 18  # shares held at once
_KEY = ["lang", "term", "source"]
_EMITTED = pa.schema([(c, pa.string()) for c in ("lang", "part", "source", "item")] + [("value", pa.int64())])


@dataclass(frozen=True)
class Params:
    least: int = 10
    top: int = 10


# fixed value: bytes of a term are ASCII letters and all above 0x7F
_TERM = np.full(256, 0x20, np.uint8)
_TERM[0x41:0x5B] = np.arange(0x61, 0x7B)
_TERM[0x61:0x7B] = np.arange(0x61, 0x7B)
_TERM[0x80:] = np.arange(0x80, 0x100)


def _fold(cells: list[pa.Table]) -> pa.Table:
    """Cells of equal key added up."""
    table = pa.concat_tables(cells)
    added = table.group_by(_KEY).aggregate([("n", "sum"), ("docs", "sum")])
    return added.rename_columns([*_KEY, "n", "docs"])


def cells_of(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """``lang, term, source, n, docs`` of some documents, about 1 MB of text at a time."""
    lang, source = (pc.fill_null(batch.column(c), "") for c in ("lang", "source"))
    for row, data, at in pieces(batch.column("text")):
        texts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(_TERM[data]))
        split = pc.split_pattern(texts, " ")
        of_doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
        terms = split.flatten().dictionary_encode()
        words = len(terms.dictionary)
        # how often each document holds each of its terms
        key, n = np.unique(of_doc * words + terms.indices.to_numpy(), return_counts=True)
        doc, term = key // max(words, 1), key % max(words, 1)
        some = pc.not_equal(terms.dictionary, "").to_numpy(zero_copy_only=False)[term]
        doc, term, n = doc[some], term[some], n[some]
        groups = zip(*(c.slice(row, len(texts)).to_pylist() for c in (lang, source)))
        named: dict[tuple, int] = {}
        number = np.array([named.setdefault(g, len(named)) for g in groups])
        cell, first = np.unique(number[doc] * max(words, 1) + term, return_inverse=True)
        of_cell = list(named)
        index = pa.array(cell // max(words, 1))
        yield pa.table(
            {
                "lang": pa.array([g[0] for g in of_cell], pa.string()).take(index),
                "term": terms.dictionary.take(pa.array(cell % max(words, 1))).cast(pa.string()),
                "source": pa.array([g[1] for g in of_cell], pa.string()).take(index),
                "n": np.bincount(first, n, len(cell)).astype(np.int64),
                "docs": np.bincount(first, minlength=len(cell)),
            }
        )


def _as_stripes(cells: pa.Table) -> Iterator[pa.RecordBatch]:
    """One row per language and term, its cells in lists."""
    cells = cells.sort_by([("lang", "ascending"), ("term", "ascending")]).combine_chunks()
    if not len(cells):
        return
    lang, term = (cells.column(c).dictionary_encode().combine_chunks().indices.to_numpy() for c in ("lang", "term"))
    new = np.flatnonzero((np.diff(lang, prepend=-1) != 0) | (np.diff(term, prepend=-1) != 0))
    heads, offsets = cells.take(pa.array(new)), pa.array(np.append(new, len(cells)), pa.int32())
    lists = [
        pa.ListArray.from_arrays(offsets, cells.column(c).combine_chunks().cast(kind))
        for c, kind in (("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64()))
    ]
    columns = [heads.column("lang").combine_chunks(), heads.column("term").combine_chunks(), *lists]
    yield from pa.table(columns, names=["lang", "term", "sources", "ns", "docs"]).to_batches(1 << 15)


def spilled_stripes(docs: DataFrame) -> DataFrame:
    """``lang, term, sources, ns, docs``: the tables of all tasks, a key once for each table it was in."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, loose, n = None, [], 0
        for batch in batches:
            for cells in cells_of(batch):
                loose.append(cells)
                n += len(cells)
                if n < LOOSE_CELLS:
                    continue
                held, loose, n = _fold([*([held] if held else []), *loose]), [], 0
                if len(held) > HELD_CELLS:
                    yield from _as_stripes(held)
                    held = None
        if held or loose:
            yield from _as_stripes(_fold([*([held] if held else []), *loose]))

    schema = "lang string, term string, sources array<string>, ns array<long>, docs array<long>"
    return docs.select("lang", "source", "text").mapInArrow(fold, schema)


def merged_stripes(docs: DataFrame, least: int) -> DataFrame:
    """``lang, term, cells``: kept terms with ``(source, n)`` of every source that holds them.

    One exchange by (language, term); the sums by source stay on its partitions.
    """
    cell = F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("ns").alias("n"), F.col("docs").alias("docs")))
    return (
        spilled_stripes(docs)
        .repartition("lang", "term")
        .select("lang", "term", cell)
        .toDF("lang", "term", "source", "n", "docs")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("df"), F.collect_list(F.struct("source", "n")).alias("cells"))
        .filter(F.col("df") >= least)
        .select("lang", "term", "cells")
    )


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(1000000000 * count / total) for count <= total below 9e15, by long division."""
    rest, found = count, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        step = rest // total
        rest = rest - step * total
        found = found * 1000 + step
    return found + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    difference = p - q
    return difference * difference // (p + q)


def _block(stripes: pa.Table, groups: pa.Table, top: int) -> Iterator[pa.RecordBatch]:
    """What a block of terms of one language adds: pair sums and leading terms of each group."""
    groups = groups.sort_by("source").combine_chunks()
    sources = groups.column("source").combine_chunks()
    total = groups.column("total").to_numpy()  # N + 2 V of each group
    whole, lang = groups.column("lang_total")[0].as_py(), groups.column("lang")[0].as_py()
    terms = stripes.column("term").combine_chunks()
    cells = stripes.column("cells").combine_chunks()
    of_term = np.repeat(np.arange(len(terms)), pc.list_value_length(cells).to_numpy())
    flat = cells.flatten()
    at = pc.index_in(flat.field("source"), sources).to_numpy()
    n = flat.field("n").to_numpy()
    s, t = len(sources), len(terms)

    def rows(part: str, source: np.ndarray, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        same = lambda text: pa.array([text] * len(source), pa.string())
        columns = [same(lang), same(part), sources.take(pa.array(source)), item, pa.array(value)]
        return pa.RecordBatch.from_arrays(columns, schema=_EMITTED)

    # a term's leading groups: those that use it more than the language does
    of_lang = share(np.bincount(of_term, n, t).astype(np.int64) + 2, np.int64(whole))
    p = share(n + 2, total[at])
    more = np.flatnonzero(p > of_lang[of_term])
    value = apart(p[more], of_lang[of_term[more]])
    name = terms.take(pa.array(of_term[more]))
    by = pa.table({"at": at[more], "value": -value, "term": name, "row": np.arange(len(more))})
    by = by.sort_by([("at", "ascending"), ("value", "ascending"), ("term", "ascending")])
    group = by.column("at").to_numpy()
    lead = np.arange(len(group)) - np.searchsorted(group, group) < top
    chosen = by.column("row").to_numpy()[lead]
    yield rows("term", at[more][chosen], name.take(pa.array(chosen)), value[chosen])

    # pair sums, a few sources with each one before them
    none = share(np.full(s, 2, np.int64), total)
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(s + 1))
    columns = max(1, DENSE_CELLS // max(t, 1))
    for low in range(0, s, columns):
        high = min(s, low + columns)
        # shares of a few sources for all terms of the block
        here = order[bounds[low] : bounds[high]]
        dense = np.repeat(none[low:high, None], t, axis=1)
        dense[at[here] - low, of_term[here]] = p[here]
        for a in range(high):
            mine = order[bounds[a] : bounds[a + 1]]
            full = np.full(t, none[a])
            full[of_term[mine]] = p[mine]
            b = np.arange(max(low, a + 1), high)
            if len(b):
                sums = apart(full, dense[b - low]).sum(axis=1)
                yield rows("pair", np.full(len(b), a), sources.take(pa.array(b)), sums)


def divergences(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``lang, source, part, item, value, rank``."""
    spark = docs.sparkSession
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(empty("lang"), empty("source"), "text")
    stripes, stripes_at = store(merged_stripes(docs, params.least), "stripes")
    groups, groups_at = store(_groups(docs, stripes), "groups")
    found, _ = store(_emitted(stripes, groups, params.top), "divergences")
    drop(spark, stripes_at, groups_at)
    group = ["lang", "source"]
    # a pair is emitted once: its sum stands in both groups
    ends = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    sums = found.filter(F.col("part") == "pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", F.inline(ends), "value").select(*group, F.lit("pair").alias("part"), "item", "value")
    terms = found.filter(F.col("part") == "term").select(*group, "part", "item", "value")
    rank = F.row_number().over(W.partitionBy(*group, "part").orderBy(F.desc("value"), "item"))
    ranked = pairs.unionByName(terms).withColumn("rank", rank)
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= params.top))


def _groups(docs: DataFrame, stripes: DataFrame) -> DataFrame:
    """Every ``lang, source`` with its ``total`` and its language's (N + 2 V), and the language's ``blocks``."""
    groups = docs.select("lang", "source").distinct()
    counts = stripes.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = stripes.groupBy("lang").agg(F.count("*").alias("terms"))
    by_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    zero = F.lit(0).cast("long")
    of_groups = (
        groups.join(counts, ["lang", "source"], "left")
        .join(kept, "lang", "left")
        .join(by_lang, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "terms", "lang_n")])
    )
    smoothed = lambda c: F.col(c) + 2 * F.col("terms")
    return of_groups.select(
        "lang",
        "source",
        smoothed("n").alias("total"),
        smoothed("lang_n").alias("lang_total"),
        F.ceil(F.col("terms") / BLOCK_TERMS).cast("int").alias("blocks"),
    )


def _emitted(stripes: DataFrame, sized: DataFrame, top: int) -> DataFrame:
    """Pair sums and leading terms of every block of terms."""
    # a language's terms are dealt to its blocks, so a hot one is many tasks
    blocks = sized.select("lang", "blocks").distinct()
    dealt = stripes.join(blocks, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "term", "cells"
    )
    spread = sized.filter(F.col("blocks") > 0).select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "lang_total"
    )

    def run(stripes: pa.Table, groups: pa.Table) -> pa.Table:
        found = _block(stripes, groups, top) if len(stripes) else ()
        return pa.Table.from_batches(list(found), _EMITTED)

    schema = "lang string, part string, source string, item string, value long"
    found = dealt.groupBy("lang", "block").cogroup(spread.groupBy("lang", "block")).applyInArrow(run, schema)
    # languages without kept terms: all distances are 0
    bare = sized.filter(F.col("blocks") == 0).select("lang", "source")
    other = bare.select("lang", F.col("source").alias("item"))
    still = bare.join(other, "lang").filter(F.col("source") < F.col("item"))
    return found.unionByName(
        still.select("lang", F.lit("pair").alias("part"), "source", "item", F.lit(0).cast("long").alias("value"))
    )
