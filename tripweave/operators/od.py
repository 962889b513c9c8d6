"""Origin-destination pairs and the trips that run through them.

Three different questions, kept apart:

* by index: the first visit of O comes before the first visit of D (J3 on vertices, J4 on edges);
* by scan: some visit of D comes after the first visit of O (J7);
* unordered: the trip uses an edge leaving O and an edge entering D, in any order (J6).

All pairs are answered in one job.  What the listed pairs need is filtered first, then spread by trip
once.  Grouping within trips stays in those partitions, so a hot vertex is spread over all of them, and pairs are
matched as lists: rows are made only for the pairs that a trip has.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .lists import BLOCK_BITS, id_blocks

#: Longs of the filter of pairs: 512 KB, sent to every task; good for half a million pairs.
FILTER_WORDS = 1 << 16
_WORD = 64


def od_count(endpoints: DataFrame) -> DataFrame:
    """Trips per (o_id, d_id) (A1)."""
    return endpoints.groupBy("o_id", "d_id").agg(F.count(F.lit(1)).alias("n"))


def by_count(counts: DataFrame) -> DataFrame:
    """Most frequent first, ties by pair."""
    return counts.orderBy(F.col("n").desc(), "o_id", "d_id")


def frequent_od(counts: DataFrame, min_count: int = 100) -> DataFrame:
    """Pairs counted strictly more than ``min_count`` times."""
    return counts.where(F.col("n") > min_count)


def _pairs(od: DataFrame) -> DataFrame:
    return od.select("o_id", "d_id").distinct()


def _endpoints(pairs: DataFrame, name: str) -> DataFrame:
    """Every vertex that is an O or a D of some pair."""
    return pairs.select(F.explode(F.array("o_id", "d_id")).alias(name)).distinct()


def _by_trip(df: DataFrame) -> DataFrame:
    """One exchange by trip for all grouping and joining within trips.

    A trip's few rows turn into a row for each of its pairs, so the partitions must not be merged by their bytes.
    """
    return spread(df, "traj_id")


def _bits() -> list[Column]:
    """The bits of the pair (o_id, d_id) in the filter: two, from two hashes."""
    hashes = F.xxhash64("o_id", "d_id"), F.xxhash64("d_id", "o_id")
    return [F.pmod(h, F.lit(FILTER_WORDS * _WORD).cast("bigint")) for h in hashes]


def _pair_filter(pairs: DataFrame) -> Column:
    """Bloom filter of the pairs: a list of ``FILTER_WORDS`` longs, one value for all rows of a plan.

    It is full with millions of pairs, and then lets more through to the exact join.
    """
    zeros = pairs.sparkSession.range(FILTER_WORDS).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("m"))
    bit = pairs.select(F.explode(F.array(*_bits())).alias("bit"))
    set_bits = bit.select(F.shiftright("bit", 6).alias("w"), F.expr(f"shiftleft(1L, cast(bit % {_WORD} AS int))").alias("m"))
    words = set_bits.unionByName(zeros).groupBy("w").agg(F.bit_or("m").alias("m"))
    return words.agg(F.sort_array(F.collect_list(F.struct("w", "m"))).alias("l")).select(F.col("l.m")).scalar()


def _match(at: DataFrame, pairs: DataFrame, ordered: bool = True) -> DataFrame:
    """(o_id, d_id, traj_id, s_site, e_site) for listed pairs whose O and D are met in the same trip.

    ``at`` (traj_id, o_id, s_site, d_id, e_site) is spread by trip and has one row per trip and place, NULL where the
    place is no O or no D.  A trip's Os and Ds come together in one grouping.  Its own combinations, in order where
    ``ordered``, are tested against a filter of all pairs right there, however many Ds an O has, and what passes meets the pairs.
    """
    met = at.groupBy("traj_id").agg(
        F.collect_list(F.when(F.col("o_id").isNotNull(), F.struct("o_id", "s_site"))).alias("_o"),
        F.collect_list(F.when(F.col("d_id").isNotNull(), F.struct("d_id", "e_site"))).alias("_d"),
    )
    both = met.select("traj_id", "_d", F.inline("_o")).select("traj_id", "o_id", "s_site", F.inline("_d"))
    if ordered:
        both = both.where(F.col("s_site") < F.col("e_site"))
    sieve = _pair_filter(pairs)
    hit = reduce(and_, [F.bit_get(F.get(sieve, F.shiftright(b, 6).cast("int")), (b % _WORD).cast("int")) == 1 for b in _bits()])
    return both.where(hit).join(pairs, ["o_id", "d_id"]).select("o_id", "d_id", "traj_id", "s_site", "e_site")


def od_by_vertex_index(postings: DataFrame, od: DataFrame) -> DataFrame:
    """(o_id, d_id, traj_id, s_site, e_site) with s_site < e_site, from a vertex index."""
    pairs = _pairs(od)
    met = _by_trip(postings.join(_endpoints(pairs, "key_id"), "key_id", "left_semi"))
    at = met.select(
        "traj_id", F.col("key_id").alias("o_id"), F.col("site").alias("s_site"),
        F.col("key_id").alias("d_id"), F.col("site").alias("e_site"),
    )
    return _match(at, pairs)


def _uses(postings: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(traj_id, o_id, s_site, d_id, e_site) by trip: the first edge out of each O and the first into each D.

    A row is for one O or for one D; the other one is NULL.
    """
    o = pairs.select("o_id").distinct()
    d = pairs.select("d_id").distinct()
    ends = (
        edges.join(o, edges["s_id"] == o["o_id"], "left")
        .join(d, edges["e_id"] == d["d_id"], "left")
        .where(F.col("o_id").isNotNull() | F.col("d_id").isNotNull())
        .select(F.col("edge_id").alias("key_id"), "o_id", "d_id")
    )
    uses = _by_trip(postings.join(ends, "key_id").select("traj_id", "site", "o_id", "d_id"))
    either = F.array(
        F.struct(F.col("o_id").alias("v"), F.lit(True).alias("is_o")),
        F.struct(F.col("d_id").alias("v"), F.lit(False).alias("is_o")),
    )
    first = (
        uses.select("traj_id", "site", F.inline(either))
        .where(F.col("v").isNotNull())
        .groupBy("traj_id", "v", "is_o")
        .agg(F.min("site").alias("s_site"))
    )
    return first.select(
        "traj_id", F.when(F.col("is_o"), F.col("v")).alias("o_id"), "s_site",
        F.when(~F.col("is_o"), F.col("v")).alias("d_id"), F.col("s_site").alias("e_site"),
    )


def od_by_edge_index(postings: DataFrame, edges: DataFrame, od: DataFrame) -> DataFrame:
    """(o_id, d_id, traj_id, s_site, e_site) with s_site < e_site, from an edge index.

    s_site is the first edge leaving O, e_site the first edge entering D, so a trip that goes from O to D
    over a single edge is not found.
    """
    pairs = _pairs(od)
    return _match(_uses(postings, edges, pairs), pairs)


def od_traj_ids(located: DataFrame) -> DataFrame:
    """Trips per pair without their sites (J5).  (o_id, d_id, traj_id) is already unique."""
    return located.select("o_id", "d_id", "traj_id")


def od_unordered(postings: DataFrame, edges: DataFrame, od: DataFrame) -> DataFrame:
    """(o_id, d_id, traj_id) for trips with an edge out of O and an edge into D, in any order."""
    pairs = _pairs(od)
    return _match(_uses(postings, edges, pairs), pairs, ordered=False).select("o_id", "d_id", "traj_id")


def od_unordered_sets(bitmap: DataFrame, edges: DataFrame, od: DataFrame) -> DataFrame:
    """(o_id, d_id, bucket, bits): the trips of :func:`od_unordered` as bit sets, from those of edges (J6, U1 on A5).

    The sets of the edges out of O are united, so are those into D, and both intersected, bucket by bucket; no id is listed.
    A pair's sets spread over its buckets, and a row is 4 KB however many trips it holds.
    """
    pairs = _pairs(od)

    def united(end: str, key: str) -> DataFrame:
        ends = edges.select("edge_id", F.col(end).alias(key)).join(pairs.select(key).distinct(), key, "left_semi")
        return bitmap.join(ends, "edge_id").groupBy(key, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    out, into = united("s_id", "o_id"), united("e_id", "d_id").withColumnRenamed("bits", "_into")
    both = pairs.join(out, "o_id").join(into, ["d_id", "bucket"])
    sets = both.select("o_id", "d_id", "bucket", F.explode(F.array("bits", "_into")).alias("bits"))
    met = sets.groupBy("o_id", "d_id", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return met.where(F.bitmap_count("bits") > 0)


def od_by_scan(traj_vertices: DataFrame, od: DataFrame) -> DataFrame:
    """(o_id, d_id, traj_id) for trips where some visit of D follows the first visit of O.

    Needs no pass over every (pair, trip): containment is first_site(O) < last_site(D) per trip.
    """
    pairs = _pairs(od)
    met = _by_trip(
        traj_vertices.select("traj_id", "site", "vertex_id").join(_endpoints(pairs, "vertex_id"), "vertex_id", "left_semi")
    )
    at = met.groupBy("traj_id", F.col("vertex_id").alias("o_id")).agg(
        F.min("site").alias("s_site"), F.max("site").alias("e_site")
    )
    return _match(at.withColumn("d_id", F.col("o_id")), pairs).select("o_id", "d_id", "traj_id")


def od_traj_counts(od_trajs: DataFrame) -> DataFrame:
    """Number of trips per pair, most first."""
    return by_count(od_count(od_trajs))


def od_traj_lists(od_trajs: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(o_id, d_id, block, n, trajs): trip ids per pair in bounded blocks.

    ``od_traj_counts`` has the size of each pair.
    """
    return id_blocks(od_trajs, ["o_id", "d_id"], "traj_id", "trajs", block_bits)
