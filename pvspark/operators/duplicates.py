"""Near-duplicate pairs and reports over copy groups.

``NearDuplicates`` starts from two stored tables:

* ``members``: one row per input file with its copy group ``gid``,
* ``groups``: one row per copy group with its vector, size and members per
  version.

Reports read ``summary``, which the similarity join fills without listing any
pair, so neither exact copies nor large clusters of near copies blow it up.
Only the pair lists use ``links``: pairs of groups at or above the threshold,
and a link of a group to itself when it has two or more members. A link of
groups with m and n members stands for m*n file pairs.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pvspark.functions.stats import EXACT_SIMILARITY, pct
from pvspark.operators.similarity import (
    DEFAULT_THRESHOLD,
    PAIR_NUMBERS,
    BlockPairs,
    block_pairs,
    distinct_vectors,
    similar_groups,
    similar_summary,
    with_unit_vectors,
)
from pvspark.session import materialize

CHUNK = 1024  # members of one group joined by one key


def _pair_order() -> list:
    return [F.desc("similarity"), "ord_a", "pos_a", "ord_b", "pos_b"]


def _at(counts: Column, ord: Column) -> Column:
    return F.coalesce(F.try_element_at(counts, ord), F.lit(0).cast("long"))


def _before(counts: Column, ord: Column) -> Column:
    return F.aggregate(
        F.map_entries(counts),
        F.lit(0).cast("long"),
        lambda total, e: total + F.when(e["key"] < ord, e["value"]).otherwise(F.lit(0)),
    )


@dataclass
class NearDuplicates:
    members: DataFrame  # file, pos, ord, side, gid, uid
    groups: DataFrame  # side, gid, copies, ords, ns [, unit, self_sim]
    threshold: float
    cross: bool = False
    block_rows: int | None = None

    @cached_property
    def _blocks(self) -> BlockPairs | None:
        """Vectors in stored blocks, written once for links and summary."""
        return block_pairs(self.groups, self.threshold, self.cross, self.block_rows)

    @cached_property
    def links(self) -> DataFrame:
        """Stored ``gid_a, gid_b, similarity``."""
        links = similar_groups(self._blocks, self.threshold, self.groups.sparkSession)
        own = self._own().select(
            F.col("gid").alias("gid_a"), F.col("gid").alias("gid_b"), "self_sim"
        )
        return materialize(links.unionAll(own), "links")

    @cached_property
    def summary(self) -> DataFrame:
        """Stored rows of ``similar_summary``, with the pairs inside copy groups added.

        If the links are already there the join does not run a second time.
        """
        if "links" in self.__dict__:
            return materialize(summary_of_links(self.links, self.groups, self.cross), "summary")
        found = similar_summary(self._blocks, self.threshold, self.groups.sparkSession)
        own = self._own().select("gid", "side", "ords", "ns", F.col("self_sim").alias("similarity"))
        return materialize(found.unionByName(own_summary(own)), "summary")

    def _own(self) -> DataFrame:
        """Copy groups whose members are pairs among themselves."""
        inside = F.lit(False) if self.cross else F.col("self_sim") >= self.threshold
        return self.groups.filter((F.col("copies") > 1) & inside)

    # ---- expansion ------------------------------------------------------

    def _version_links(self, where: Callable[[Column, Column], Column] | None) -> DataFrame:
        """Links once per pair of versions that hold members: ``gid_a, ord_a, n_a, gid_b, ord_b, n_b``.

        ``where`` sees the earlier and the later version and acts here, on version
        lists, before any member is read.
        """
        right_side = 1 if self.cross else 0
        cells = F.arrays_zip(F.col("ords").alias("ord"), F.col("ns").alias("n"))
        a = self.groups.filter(F.col("side") == 0).select(F.col("gid").alias("gid_a"), cells.alias("a"))
        b = self.groups.filter(F.col("side") == right_side).select(F.col("gid").alias("gid_b"), cells.alias("b"))
        own = F.lit(False) if self.cross else F.col("gid_a") == F.col("gid_b")
        linked = self.links.join(a, "gid_a").join(b, "gid_b")
        split = linked.withColumn("a", F.explode("a")).withColumn("b", F.explode("b"))
        ord_a, ord_b = F.col("a.ord"), F.col("b.ord")
        split = split.filter(~own | (ord_a <= ord_b))
        if where is not None:
            split = split.filter(where(F.least(ord_a, ord_b), F.greatest(ord_a, ord_b)))
        return split.select(
            "gid_a", ord_a.alias("ord_a"), F.col("a.n").alias("n_a"),
            "gid_b", ord_b.alias("ord_b"), F.col("b.n").alias("n_b"), "similarity",
        )

    def _linked(self) -> DataFrame:
        """Distinct ``side, gid`` of groups that have a link."""
        right_side = 1 if self.cross else 0
        ends = F.array(
            F.struct(F.lit(0).alias("side"), F.col("gid_a").alias("gid")),
            F.struct(F.lit(right_side).alias("side"), F.col("gid_b").alias("gid")),
        )
        return self.links.select(F.inline(ends)).distinct()

    def _expand(self, links: DataFrame, members: DataFrame) -> DataFrame:
        """File pairs of version links; ``members`` carry ``n``, the members of their group and version.

        Members of a large group are hashed into chunks and a link is repeated
        per pair of chunks, so no join key carries a whole group.
        """
        same = F.lit(False) if self.cross else (F.col("gid_a") == F.col("gid_b")) & (F.col("ord_a") == F.col("ord_b"))
        chunks = lambda c: F.ceil(F.col(c) / F.lit(CHUNK)).cast("int")
        spread = links.withColumn("chunk_a", F.explode(F.sequence(F.lit(0), chunks("n_a") - 1))).withColumn(
            "chunk_b",
            F.explode(F.sequence(F.when(same, F.col("chunk_a")).otherwise(F.lit(0)), chunks("n_b") - 1)),
        )
        right_side = 1 if self.cross else 0
        sized = members.withColumn("chunk", F.pmod(F.xxhash64("uid"), chunks("n")).cast("int")).withColumn(
            "at", F.struct("ord", "pos", "uid")
        )

        def end(suffix: str, side: int) -> DataFrame:
            return sized.filter(F.col("side") == side).select(
                *[F.col(c).alias(f"{c}_{suffix}") for c in ("gid", "ord", "chunk", "file", "at")]
            )

        joined = spread.join(end("a", 0), ["gid_a", "ord_a", "chunk_a"]).join(
            end("b", right_side), ["gid_b", "ord_b", "chunk_b"]
        )
        same_chunk = same & (F.col("chunk_a") == F.col("chunk_b"))
        joined = joined.filter(~same_chunk | (F.col("at_a") < F.col("at_b")))
        flip = F.lit(False) if self.cross else F.col("at_a") > F.col("at_b")
        pick = lambda x, y: F.when(flip, F.col(x)).otherwise(F.col(y))
        oriented = joined.select(
            pick("file_b", "file_a").alias("file_a"),
            pick("file_a", "file_b").alias("file_b"),
            pick("at_b", "at_a").alias("at_a"),
            pick("at_a", "at_b").alias("at_b"),
            "similarity",
        )
        return oriented.select(
            F.col("at_a.ord").alias("ord_a"),
            F.col("at_b.ord").alias("ord_b"),
            "file_a",
            "file_b",
            "similarity",
            F.col("at_a.pos").alias("pos_a"),
            F.col("at_b.pos").alias("pos_b"),
        )

    def pairs(self, where: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """Every file pair: earlier file first, by (version order, position).

        ``where`` restricts the pairs by their earlier and later version; what it
        leaves out is never expanded.
        """
        cell = F.explode(F.arrays_zip(F.col("ords").alias("ord"), F.col("ns").alias("n")))
        sizes = (
            self.groups.join(self._linked(), ["side", "gid"], "left_semi")
            .select("side", "gid", cell.alias("cell"))
            .select("side", "gid", "cell.ord", "cell.n")
        )
        members = self.members.join(sizes, ["side", "gid", "ord"])
        return self._expand(self._version_links(where), members)

    def compressed(self) -> tuple[DataFrame, DataFrame]:
        """The pair list without expansion: ``links`` and ``membership``.

        ``gid_a, gid_b, similarity, versions_a, versions_b``: every file of the one
        group is this similar to every file of the other (of a group linked to
        itself: any two of its files); the versions are bitmaps, 64 versions a
        word. ``file, ord, side, gid`` names the files. Rows are as many as links
        and files, however many pairs they stand for.
        """
        words = F.sequence(F.lit(0), F.shiftright(F.array_max("ords"), 6))
        inside = lambda w: F.filter("ords", lambda o: F.shiftright(o, 6) == w)
        bit = lambda o: F.call_function("shiftleft", F.lit(1).cast("long"), o.bitwiseAND(63))
        bitmap = F.transform(
            words, lambda w: F.aggregate(inside(w), F.lit(0).cast("long"), lambda all_, o: all_.bitwiseOR(bit(o)))
        )
        right_side = 1 if self.cross else 0
        of = lambda side, suffix: self.groups.filter(F.col("side") == side).select(
            F.col("gid").alias(f"gid_{suffix}"), bitmap.alias(f"versions_{suffix}")
        )
        links = self.links.join(of(0, "a"), "gid_a").join(of(right_side, "b"), "gid_b")
        return (
            links.select("gid_a", "gid_b", "similarity", "versions_a", "versions_b"),
            self.members.select("file", "ord", "side", "gid"),
        )

    def sorted_pairs(self) -> DataFrame:
        """``file_a, file_b, similarity`` by similarity, ties in input order."""
        return (
            self.pairs()
            .orderBy(*_pair_order())
            .select("file_a", "file_b", "similarity")
        )

    def top(self, k: int = 10) -> DataFrame:
        """First ``k`` rows of ``sorted_pairs`` without building the rest.

        Any pair among the first k of its link uses one of the first k + 1
        members of each group, and only the k links whose first pair comes
        earliest can contribute.
        """
        right_side = 1 if self.cross else 0
        at = F.struct("ord", "pos", "uid")
        # first two members of each group, without ordering whole groups
        linked = self.members.join(self._linked(), ["side", "gid"], "left_semi")
        heads = linked.groupBy("side", "gid").agg(F.min(at).alias("head"))
        seconds = (
            linked.join(heads, ["side", "gid"])
            .filter(at > F.col("head"))
            .groupBy("side", "gid")
            .agg(F.min(at).alias("second"))
        )
        firsts = heads.join(seconds, ["side", "gid"], "left")

        def end(suffix: str, side: int) -> DataFrame:
            return firsts.filter(F.col("side") == side).select(
                F.col("gid").alias(f"gid_{suffix}"),
                F.col("head").alias(f"head_{suffix}"),
                F.col("second").alias(f"second_{suffix}"),
            )

        ranked = self.links.join(end("a", 0), "gid_a").join(end("b", right_side), "gid_b")
        if self.cross:
            earlier, later = F.col("head_a"), F.col("head_b")
        else:
            own = F.col("gid_a") == F.col("gid_b")
            earlier = F.least("head_a", "head_b")
            later = F.when(own, F.col("second_a")).otherwise(F.greatest("head_a", "head_b"))
        best = ranked.orderBy(F.desc("similarity"), earlier, later).limit(k)
        best = materialize(best.select("gid_a", "gid_b", "similarity"), "top-links")
        one = F.lit(1).cast("long")
        ends = best.select(
            F.inline(
                F.array(
                    F.struct(F.lit(0).alias("side"), F.col("gid_a").alias("gid")),
                    F.struct(F.lit(right_side).alias("side"), F.col("gid_b").alias("gid")),
                )
            )
        ).distinct()
        # the rank limit is applied per partition before the shuffle
        few = (
            linked.join(ends, ["side", "gid"], "left_semi")
            .withColumn(
                "rank", F.row_number().over(W.partitionBy("side", "gid").orderBy("ord", "pos", "uid"))
            )
            .filter(F.col("rank") <= k + 1)
            .withColumn("n", one)
        )
        cells = few.select("side", "gid", "ord").distinct()
        of = lambda side, suffix: cells.filter(F.col("side") == side).select(
            F.col("gid").alias(f"gid_{suffix}"), F.col("ord").alias(f"ord_{suffix}")
        )
        links = best.join(of(0, "a"), "gid_a").join(of(right_side, "b"), "gid_b")
        if not self.cross:
            links = links.filter((F.col("gid_a") != F.col("gid_b")) | (F.col("ord_a") <= F.col("ord_b")))
        links = links.withColumns({"n_a": one, "n_b": one})
        return (
            self._expand(links, few)
            .orderBy(*_pair_order())
            .limit(k)
            .select("file_a", "file_b", "similarity")
        )

    # ---- statistics -----------------------------------------------------

    def pair_numbers(self) -> DataFrame:
        """Pair numbers per later version ``ord``."""
        return (
            self.summary.filter(F.col("gid").isNull())
            .groupBy("ord")
            .agg(*[F.sum(n).alias(n) for n in PAIR_NUMBERS])
        )

    def partners(self) -> DataFrame:
        """``side, gid, seen``: versions that hold a partner of the group."""
        return (
            self.summary.filter(F.col("gid").isNotNull())
            .groupBy("side", "gid")
            .agg(F.collect_set("ord").alias("seen"))
        )

    def pair_counts(self) -> DataFrame:
        """One row: ``duplicate_pairs, exact_duplicate_pairs``."""
        return self.pair_numbers().agg(
            F.coalesce(F.sum(F.col("within") + F.col("earlier")), F.lit(0)).alias("duplicate_pairs"),
            F.coalesce(F.sum("exact"), F.lit(0)).alias("exact_duplicate_pairs"),
        )

    def files_in_duplicates(self) -> DataFrame:
        """Distinct file names that take part in a pair, compared as strings."""
        return (
            self.members.join(self.partners(), ["side", "gid"], "left_semi").select("file").distinct()
        )

    def report(self) -> DataFrame:
        """The six duplicate statistics as one row."""
        zero = F.lit(0).cast("long")
        parts = self.pair_counts().select(
            "duplicate_pairs",
            "exact_duplicate_pairs",
            zero.alias("files_with_duplicates"),
            zero.alias("total_files"),
        )
        files = self.files_in_duplicates().agg(F.count("*").alias("files"))
        total = self.members.agg(F.count("*").alias("files"))
        parts = parts.unionAll(files.select(zero, zero, F.col("files"), zero)).unionAll(
            total.select(zero, zero, zero, F.col("files"))
        )
        summed = parts.agg(*[F.sum(c).alias(c) for c in parts.columns])
        return summed.select(
            "total_files",
            "duplicate_pairs",
            "exact_duplicate_pairs",
            "files_with_duplicates",
            pct(F.col("files_with_duplicates"), F.col("total_files")).alias(
                "percentage_files_with_duplicates"
            ),
            F.lit(self.threshold).alias("threshold"),
        )


def own_summary(own: DataFrame) -> DataFrame:
    """Summary rows of pairs inside copy groups (``gid, side, ords, ns, similarity``)."""
    counts = F.map_from_arrays("ords", "ns")
    rows = own.withColumn("counts", counts).withColumn("ord", F.explode("ords"))
    o = F.col("ord")
    here = _at(F.col("counts"), o)
    return _summary_rows(
        rows,
        within=F.try_divide(here * (here - 1), F.lit(2)).cast("long"),
        earlier=here * _before(F.col("counts"), o),
        consecutive=here * _at(F.col("counts"), o - F.lit(1)),
        seen=own.select("gid", "side", F.explode("ords").alias("ord")),
    )


def _summary_rows(rows, within, earlier, consecutive, seen) -> DataFrame:
    """Bring per-version numbers of ``rows`` and the ``seen`` rows into summary form."""
    exact = F.col("similarity") >= EXACT_SIMILARITY
    zero = F.lit(0).cast("long")
    numbers = rows.select(
        F.lit(None).cast("binary").alias("gid"),
        F.lit(None).cast("int").alias("side"),
        "ord",
        within.alias("within"),
        earlier.alias("earlier"),
        consecutive.alias("consecutive"),
        F.when(exact, within + earlier).otherwise(zero).alias("exact"),
        F.when(exact, consecutive).otherwise(zero).alias("consecutive_exact"),
    )
    empty = [F.lit(None).cast("long").alias(n) for n in PAIR_NUMBERS]
    return numbers.unionByName(seen.select("gid", "side", "ord", *empty))


def summary_of_links(links: DataFrame, groups: DataFrame, cross: bool = False) -> DataFrame:
    """Summary rows for links that are already known (self-links included)."""
    right_side = 1 if cross else 0
    profile = groups.select("gid", "side", F.map_from_arrays("ords", "ns").alias("c"))
    a = profile.filter(F.col("side") == 0).select(F.col("gid").alias("gid_a"), F.col("c").alias("a"))
    b = profile.filter(F.col("side") == right_side).select(F.col("gid").alias("gid_b"), F.col("c").alias("b"))
    # equal groups of two sets are a link like others
    own = F.lit(False) if cross else F.col("gid_a") == F.col("gid_b")
    joined = links.filter(~own).join(a, "gid_a").join(b, "gid_b")
    rows = joined.withColumn("ord", F.explode(F.array_union(F.map_keys("a"), F.map_keys("b"))))
    a, b, o = F.col("a"), F.col("b"), F.col("ord")
    previous = o - F.lit(1)
    ends = F.array(
        F.struct(F.col("gid_a").alias("gid"), F.lit(0).alias("side"), F.map_keys("b").alias("ords")),
        F.struct(F.col("gid_b").alias("gid"), F.lit(right_side).alias("side"), F.map_keys("a").alias("ords")),
    )
    crossing = _summary_rows(
        rows,
        within=_at(a, o) * _at(b, o),
        earlier=_at(a, o) * _before(b, o) + _at(b, o) * _before(a, o),
        consecutive=_at(a, o) * _at(b, previous) + _at(b, o) * _at(a, previous),
        seen=joined.select(F.inline(ends)).select("gid", "side", F.explode("ords").alias("ord")),
    )
    inside = links.filter(own).select(F.col("gid_a").alias("gid"), "similarity")
    return crossing.unionByName(
        own_summary(inside.join(groups.select("gid", "side", "ords", "ns"), "gid"))
    )


def near_duplicates(
    items: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    file: str = "file_path",
    embedding: str = "embedding",
    pos: Column | None = None,
    ord: Column | None = None,
    cross: bool = False,
    block_rows: int | None = None,
) -> NearDuplicates:
    """Prepare the similarity join of ``items``; it runs when first asked for.

    ``pos`` is the input order used for orientation and ties (default: file
    name). ``ord`` is the version order; with ``cross`` it must be 0 or 1 and
    only pairs between the two sets are searched.
    """
    order = ord if ord is not None else F.lit(0)
    rows = items.select(
        F.col(file).alias("file"),
        (pos if pos is not None else F.col(file)).alias("pos"),
        order.cast("int").alias("ord"),
        (order.cast("int") if cross else F.lit(0)).alias("side"),
        F.col(embedding).alias("embedding"),
    )
    stored = materialize(
        with_unit_vectors(rows).withColumn("uid", F.monotonically_increasing_id()), "members"
    )
    by_version = ord is not None and not cross
    return NearDuplicates(
        members=stored.select("file", "pos", "ord", "side", "gid", "uid"),
        groups=materialize(distinct_vectors(stored, by_version), "distinct"),
        threshold=threshold,
        cross=cross,
        block_rows=block_rows,
    )


def duplicate_pairs(items: DataFrame, threshold: float = DEFAULT_THRESHOLD, **kw) -> DataFrame:
    """All pairs of one set with cosine >= threshold, most similar first."""
    return near_duplicates(items, threshold, **kw).sorted_pairs()


def two_sets(
    set_a: DataFrame,
    set_b: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    file: str = "file_path",
    pos: str | None = None,
    embedding: str = "embedding",
    **kw,
) -> NearDuplicates:
    """Similarity join between two sets; no pair inside one set."""
    columns = [F.col(file).alias("file_path"), F.col(pos or file).alias("pos"), F.col(embedding).alias("embedding")]
    both = set_a.select(*columns, F.lit(0).alias("ord")).unionByName(
        set_b.select(*columns, F.lit(1).alias("ord"))
    )
    return near_duplicates(both, threshold, pos=F.col("pos"), ord=F.col("ord"), cross=True, **kw)


def cross_pairs(set_a: DataFrame, set_b: DataFrame, threshold: float = DEFAULT_THRESHOLD, **kw):
    return two_sets(set_a, set_b, threshold, **kw).sorted_pairs()
