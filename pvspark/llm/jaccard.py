"""Similarity join on word n-gram sets by rare-first prefix filtering.

A document's set holds its distinct ``words``-word shingles as 64-bit hashes.
Two documents link when ``den * |intersection| >= num * |union|``. Linked sets
share a shingle within their prefixes: the first ``|x| - ceil(num|x|/den) + 1``
shingles under one order of all shingles. That order begins with a fixed part
of the hash space (the universe, ``universe`` prefixes wide), rarest first by
exact document counts, then takes the rest by hash; so counting and ranking
touch only that part of all shingles, whatever the size, and no result changes.

1. Documents with equal sets are one class, represented by its first row.
2. Shingles of the universe are counted over all classes; those of one class
   can match nothing and only use up prefix places.
3. The prefixes' other shingles are joined. Pairs pass the length filter, the
   positional filter and the suffix filter (counts of both sets in ranges of the
   hash space bound their intersection), and are verified once on full sets.
4. A group of n documents is not expanded into its n^2/2 pairs: each round
   compares a group with one pivot, merges what links and takes the pivot out of
   the group, so chance groups of few documents are soon used up. Then documents that
   share a prefix shingle and are still in different components are all tested,
   in blocks of bounded size, each at its first shared shingle and with finer
   ranges, and what passes the filters is verified, so that no link between
   components is missed.

Results: one row per input row with the set's size and the smallest id its links
reach. Null and empty texts, and those without words, have no set and link with
nothing. Null ids take part in links but are no one's smallest id, unless all
are null. Repeated rows are linked by their equal sets. Empty tables give empty
results; extra columns are ignored.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import drop, pieces, store, text_hash, whole_groups
from pvspark.llm.components import components
from pvspark.llm.words import distinct, mix, shingles, word_hashes
from pvspark.session import release

RANGES = 32
FINE = 256  # ranges of the last test; a multiple of RANGES
KNOWN = 64  # prefix shingles of a document that tell whether a pair has met before


@dataclass(frozen=True)
class Params:
    words: int = 5
    num: int = 4
    den: int = 5
    universe: float = 1.5  # width of the counted part of the hash space, in prefixes
    pivot_rounds: int = 3
    chunk: int = 512  # documents of one shingle on a side of a block
    broadcast_rows: int = 1_000_000  # of 16 to 40 bytes


def _sets(texts: pa.Array, words: int):
    """Distinct shingles (ascending) of all texts of a column, with offsets, piece by piece."""
    for _, data, at in pieces(texts):
        hashed, cut = word_hashes(data, at)
        yield distinct(*shingles(hashed, cut, words))


def _ceil(a, b):
    return -(-a // b)


def _long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return total[at[1:]] - total[at[:-1]]


def _profile(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per set, how many members fall in each fine range of the hash space, modulo 256."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    slot = text * FINE + (values >> np.uint64(64 - FINE.bit_length() + 1)).astype(np.int64)
    return np.bincount(slot, minlength=(len(at) - 1) * FINE).astype(np.uint8).reshape(-1, FINE)


def _coarse(fine: np.ndarray) -> np.ndarray:
    return fine.reshape(-1, RANGES, FINE // RANGES).sum(axis=2, dtype=np.uint8)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least size of the symmetric difference of sets with these profiles."""
    off = x - y  # wraps, so the smaller way round is a lower bound
    return np.minimum(off, -off).sum(axis=-1, dtype=np.int64)


def _base(docs: DataFrame, p: Params) -> DataFrame:
    """Per row: size, set signature, profiles, shingles of the universe, further prefix shingles."""
    share = min(1.0, p.universe * (1 - p.num / p.den))
    bound = np.uint64(min(int(share * 2.0**64), 2**64 - 1))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            row = 0
            for values, at in _sets(batch.column(2), p.words):
                m, n = len(at) - 1, np.diff(at)
                inside = values < bound
                known = np.concatenate([[0], np.cumsum(inside)])
                u = known[at[1:]] - known[at[:-1]]
                prefix = np.where(n > 0, n - _ceil(p.num * n, p.den) + 1, 0)
                further = np.maximum(prefix - u, 0)
                place = np.arange(len(values)) - np.repeat(at[:-1] + u, n)
                more = ~inside & (place < np.repeat(further, n))
                more_at = np.concatenate([[0], np.cumsum(further)])
                u_at = np.concatenate([[0], np.cumsum(u)])
                fine = _profile(values, at)
                mixed = mix(values ^ np.uint64(0xA0761D6478BD642F))
                lists = lambda v, c: pa.ListArray.from_arrays(pa.array(c.astype(np.int32)), _long(v))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, m),
                        batch.column(1).slice(row, m),
                        pa.array(n),
                        pa.array(prefix),
                        _long(_sum(mixed, at)),
                        _long(_sum(mix(mixed + np.uint64(1)), at)),
                        _binary(_coarse(fine)),
                        _binary(fine),
                        lists(values[inside], u_at),
                        lists(values[more], more_at),
                    ],
                    ["doc_id", "hash", "n", "prefix", "s1", "s2", "profile", "fine", "counted", "further"],
                )
                row += m

    chosen = docs.select("doc_id", text_hash(F.col("text")).alias("hash"), "text")
    return chosen.mapInArrow(
        run,
        f"doc_id {kind}, hash long, n long, prefix long, s1 long, s2 long, profile binary, "
        "fine binary, counted array<long>, further array<long>",
    )


def _small(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def _postings(reps: DataFrame) -> DataFrame:
    """``h, row, n, pos, profile``: the prefix shingles that can match."""
    counted = reps.select("row", F.explode("counted").alias("h"))
    often = counted.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = (
        counted.join(often, "h")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    )
    with_meta = reps.withColumn("u", F.size("counted")).drop("counted").join(ranked, "row", "left")
    shared = F.coalesce("shared", F.array().cast("array<struct<df:bigint,h:bigint>>"))
    # shingles of this document alone come first and fill places of the prefix
    alone = F.col("u") - F.size(shared)
    ours = F.slice(shared, F.lit(1), F.greatest(F.col("prefix") - alone, F.lit(0)).cast("int"))
    placed = F.concat(
        F.transform(ours, lambda s, i: F.struct((i + alone).cast("long").alias("pos"), s["h"].alias("h"))),
        F.transform("further", lambda h, i: F.struct((i + F.col("u")).cast("long").alias("pos"), h.alias("h"))),
    )
    rows = with_meta.select("row", "n", "profile", F.inline(placed))
    return rows.select("h", "row", "n", "pos", "profile")


def _needed(p: Params, x, y):
    """Least intersection of linked sets of these sizes."""
    return F.ceil((F.lit(p.num) * (x + y)) / F.lit(p.den + p.num))


def _may_link(p: Params):
    """Length and positional filter on joined postings ``x_*`` and ``y_*``."""
    c = F.col
    length = F.lit(p.den) * F.least("x_n", "y_n") >= F.lit(p.num) * F.greatest("x_n", "y_n")
    most = F.least("x_pos", "y_pos") + 1 + F.least(c("x_n") - c("x_pos"), c("y_n") - c("y_pos")) - 1
    return length & (most >= _needed(p, c("x_n"), c("y_n")))


def _suffix_filter(pairs: DataFrame, p: Params) -> DataFrame:
    """``a, b`` of the pairs whose profiles leave room for the needed intersection."""

    def run(batches):
        for batch in batches:
            get = lambda name: batch.column(batch.schema.names.index(name))
            n = get("x_n").to_numpy() + get("y_n").to_numpy()
            side = lambda name: np.frombuffer(b"".join(get(name).to_pylist()), np.uint8).reshape(-1, RANGES)
            ok = (n - _apart(side("x_profile"), side("y_profile"))) // 2 >= _ceil(p.num * n, p.den + p.num)
            a, b = get("x_row").to_numpy()[ok], get("y_row").to_numpy()[ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"]
            )

    return pairs.select("x_row", "y_row", "x_n", "y_n", "x_profile", "y_profile").mapInArrow(
        run, "a long, b long"
    )


def _all_pairs(left: DataFrame, fine: DataFrame, p: Params) -> DataFrame:
    """``a, b`` of all pairs in different components that share a prefix shingle and pass every filter.

    A shingle's documents are cut into chunks and each two chunks meet in one
    block of bounded size, where pairs are tested without being listed. Each
    document brings its first ``KNOWN`` shingles: a pair with a common one
    before the block's own shingle is left to the block of that one. Pairs
    that share none of these may come more than once.
    """
    sizes = left.groupBy("h").agg(F.ceil(F.count("*") / F.lit(p.chunk)).cast("int").alias("chunks"))
    # a row for each document meets its ranges; only then its shingles part
    whole = left.groupBy("row", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("all"))
    whole = whole.withColumn("known", F.slice("all", 1, KNOWN)["h"]).join(fine, "row")
    left = whole.select("row", "n", "comp", "known", "fine", F.inline("all"))
    own = F.pmod(F.xxhash64("row", "h"), F.col("chunks")).cast("int")
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    dealt = (
        left.join(sizes, "h")
        .withColumn("own", own)
        .withColumn("other", F.explode(others))
        .select(
            F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")).alias("block"),
            F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
            (F.col("own") == F.col("other")).alias("inner"),
            "h",
            "row",
            "n",
            "pos",
            "comp",
            "known",
            "fine",
        )
    )
    num, den = p.num, p.den

    def meet(rows: dict[str, np.ndarray]):
        """Pairs of one block."""
        found_a, found_b = [], []
        first = np.flatnonzero(rows["side"] == 0)
        for x in first:
            # inside a chunk each pair once, between chunks all of the other side
            y = first[first > x] if rows["inner"][x] else np.flatnonzero(rows["side"] == 1)
            n = rows["n"][x] + rows["n"][y]
            least, most = np.minimum(rows["n"][x], rows["n"][y]), np.maximum(rows["n"][x], rows["n"][y])
            need = _ceil(num * n, den + num)
            front = np.minimum(rows["pos"][x], rows["pos"][y])
            rest = np.minimum(rows["n"][x] - rows["pos"][x], rows["n"][y] - rows["pos"][y])
            ok = (rows["comp"][x] != rows["comp"][y]) & (rows["h"][x] == rows["h"][y])
            ok &= (den * least >= num * most) & (front + rest >= need)
            y, n, need = y[ok], n[ok], need[ok]
            for kind in ("coarse", "fine"):
                ok = (n - _apart(rows[kind][y], rows[kind][x])) // 2 >= need
                y, n, need = y[ok], n[ok], need[ok]
            mine = rows["known"][x]
            own = np.flatnonzero(mine == rows["h"][x])
            before = mine[: own[0]] if len(own) else mine
            y = y[~np.isin(rows["known"][y], before[before != 0]).any(axis=1)]
            found_a.append(np.full(len(y), rows["row"][x]))
            found_b.append(rows["row"][y])
        return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else None

    def run(batches):
        names = ["side", "inner", "h", "row", "n", "pos", "comp"]
        for table in whole_groups(batches):
            table = table.combine_chunks()
            block = table.column("block").to_numpy()
            columns = {c: table.column(c).to_numpy() for c in names}
            columns["fine"] = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
            columns["coarse"] = _coarse(columns["fine"])
            lists = table.column("known").combine_chunks()
            n = lists.value_lengths().to_numpy()
            columns["known"] = np.zeros((len(n), KNOWN), np.int64)
            columns["known"][np.arange(KNOWN) < n[:, None]] = lists.flatten().to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            for s, e in zip(cut[:-1], cut[1:]):
                pairs = meet({c: v[s:e] for c, v in columns.items()}) if e - s > 1 else None
                if pairs and len(pairs[0]):
                    a, b = pairs
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"]
                    )

    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def _pivot(turn: int, what: Column | None = None) -> Column:
    """The aggregate of a group's first row in the order of a turn, or ``what`` of that row.

    Another pivot each turn; the first is the first row, the same for most shingles of a group.
    """
    if turn == 0:
        return F.min("row") if what is None else F.min_by(what, "row")
    return F.min_by(F.col("row") if what is None else what, F.struct(F.xxhash64(F.lit(turn), "row"), "row"))


def _after_turn(left: DataFrame, turn: int) -> DataFrame:
    """``left`` without the postings that have nothing left to show.

    These are the shingles whose documents are all in one component, and each
    shingle's pivot of the turn, as it was compared with all the others.
    """
    groups = left.groupBy("h").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), _pivot(turn).alias("pivot")
    )
    open_ones = groups.filter("lo != hi and size > 2").select("h", "pivot")
    return left.join(open_ones, "h").filter(F.col("row") != F.col("pivot")).drop("pivot")


def _side(postings: DataFrame, name: str) -> DataFrame:
    return postings.withColumnsRenamed({c: f"{name}_{c}" for c in postings.columns if c != "h"})


def _verify(pairs: DataFrame, docs: DataFrame, rows: DataFrame, p: Params) -> DataFrame:
    """The links among stored pairs ``a, b``: sets are made again from whole texts and compared."""
    ids = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    wanted, wanted_at = store(ids.join(rows.select("row", "doc_id", "hash"), "row"), "wanted")
    wanted = wanted.withColumnsRenamed({"doc_id": "w_id", "hash": "w_hash"})
    texts = docs.select("doc_id", "text", text_hash(F.col("text")).alias("hash")).join(
        _small(wanted, p.broadcast_rows),
        F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("hash") == F.col("w_hash")),
    )

    def members(batches):
        for batch in batches:
            row = 0
            for values, at in _sets(batch.column(1), p.words):
                found = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), _long(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(found)), found], ["row", "set"])
                row += len(found)

    sets, sets_at = store(texts.select("row", "text").mapInArrow(members, "row long, set array<long>"), "sets")

    # two sets a pair would make large Arrow batches, so they are compared where they are joined
    both = F.size(F.array_intersect("x", "y"))
    joined = (
        pairs.join(sets.withColumnsRenamed({"row": "a", "set": "x"}), "a")
        .join(sets.withColumnsRenamed({"row": "b", "set": "y"}), "b")
        .filter(F.lit(p.den) * both >= F.lit(p.num) * (F.size("x") + F.size("y") - both))
    )
    links, _ = store(joined.select("a", "b").distinct(), "links")
    drop(docs.sparkSession, wanted_at, sets_at)
    return links


def _merged(links: DataFrame) -> DataFrame:
    return components(links).withColumnsRenamed({"node": "row", "label": "comp"})


def join_classes(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``row, doc_id, hash, n, comp``: the stored rows and a label of their component."""
    docs = docs.select("doc_id", "text")
    # row numbers are fixed once written
    base, _ = store(_base(docs, p).withColumn("row", F.monotonically_increasing_id()), "shingle-base")
    classes, _ = store(
        base.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("rep")), "set-classes"
    )
    reps = base.join(_small(classes.select(F.col("rep").alias("row")), p.broadcast_rows), "row", "left_semi")
    postings, postings_at = store(
        _postings(reps.select("row", "n", "prefix", "profile", "counted", "further")), "postings"
    )
    met = postings.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1").select("h")
    grouped, grouped_at = store(postings.join(met, "h"), "grouped")
    drop(docs.sparkSession, postings_at)
    rows = base.select("row", "doc_id", "hash")
    fine = base.select("row", "fine")
    links = comp = None
    left, left_at = grouped.withColumn("comp", F.col("row")), grouped_at
    turn = 0
    while not left.isEmpty():
        exhaustive = turn >= p.pivot_rounds
        if exhaustive:
            found = _all_pairs(left, fine, p)
        else:
            whole = F.struct(*[F.col(c) for c in left.columns if c != "h"])
            pivots = left.groupBy("h").agg(_pivot(turn, whole).alias("v"))
            pivots = pivots.select("h", *[F.col(f"v.{c}").alias(f"x_{c}") for c in left.columns if c != "h"])
            met = pivots.join(_side(left, "y"), "h").filter(F.col("x_row") != F.col("y_row"))
            found = _suffix_filter(met.filter((F.col("x_comp") != F.col("y_comp")) & _may_link(p)), p)
        # pairs that were tried and do not link may be tried again: a row of a pivot each at most
        pairs, pairs_at = store(found.distinct(), "pairs")
        if not pairs.isEmpty():
            new = _verify(pairs, docs, rows, p)
            links = new if links is None else links.union(new)
            comp = _merged(links)
            left = left.drop("comp").join(comp, "row", "left").withColumn("comp", F.coalesce("comp", "row"))
        if exhaustive:
            drop(docs.sparkSession, pairs_at, left_at)
            break
        after, after_at = store(_after_turn(left, turn), "left")
        turn = p.pivot_rounds if pairs.isEmpty() else turn + 1
        drop(docs.sparkSession, pairs_at, left_at)
        left, left_at = after, after_at
        release(docs.sparkSession)  # shuffles, broadcasts and plans of the turn
    all_rows = base.select("row", "doc_id", "hash", "n", "s1", "s2")
    labelled = all_rows.join(classes, ["s1", "s2", "n"], "left").withColumn("rep", F.coalesce("rep", "row"))
    if links is None:
        labelled = labelled.withColumn("comp", F.col("rep"))
    else:
        labelled = labelled.join(comp.withColumnRenamed("row", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    out, _ = store(labelled.select("row", "doc_id", "hash", "n", "comp"), "joined")
    return out


def join(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, n_shingles, component_id``."""
    rows = join_classes(docs, p)
    least = rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows and columns of ``docs`` without all but one document of each component.

    The one with the smallest id stays (nulls last; then the smallest text hash).
    Rows equal in id and text are one document: the first of them stays.
    """
    rows = join_classes(docs, p)
    first = rows.groupBy("comp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("f")
    )
    kept, _ = store(
        first.select(F.col("f.doc_id").alias("k_id"), F.col("f.hash").alias("k_hash")).distinct(), "kept"
    )
    same = docs["doc_id"].eqNullSafe(kept["k_id"]) & (text_hash(docs["text"]) == kept["k_hash"])
    found = docs.join(_small(kept, p.broadcast_rows), same, "left_semi")
    repeats = rows.groupBy("doc_id", "hash").count().filter("count > 1")
    if repeats.isEmpty():
        return found
    # several rows with one id and one text: only these meet by a shuffle
    again, _ = store(repeats.select(F.col("doc_id").alias("r_id"), F.col("hash").alias("r_hash")), "repeats")
    twice = found["doc_id"].eqNullSafe(again["r_id"]) & (text_hash(found["text"]) == again["r_hash"])
    again = _small(again, p.broadcast_rows)
    single = found.join(again, twice, "left_anti")
    return single.union(found.join(again, twice, "left_semi").dropDuplicates(["doc_id", "text"]))
