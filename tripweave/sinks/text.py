"""Text layouts for other tools.

Every formatter gives one ``value`` column, and a hot key spreads over several lines of bounded length
(see ``operators.lists``).  The parsers in ``sources.text`` read all of them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_text
from ..operators.lists import BLOCK_BITS, block_of


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.select("value").write.mode(mode).text(path)


def format_index(postings: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``key|traj,site,traj,site,`` (K1)."""
    blocks = postings.groupBy("key_id", block_of(F.col("traj_id"), block_bits).alias("_b")).agg(
        F.sort_array(F.collect_list(F.struct("traj_id", "site"))).alias("_l")
    )
    pairs = F.transform("_l", lambda x: F.concat_ws(",", x["traj_id"].cast("string"), x["site"].cast("string"), F.lit("")))
    return blocks.select(F.concat(F.col("key_id").cast("string"), F.lit("|"), F.array_join(pairs, "")).alias("value"))


def format_od_counts(counts: DataFrame) -> DataFrame:
    """``((o,d),n)``, most frequent first (K3)."""
    return counts.orderBy(F.col("n").desc(), "o_id", "d_id").select(
        F.format_string("((%d,%d),%d)", "o_id", "d_id", "n").alias("value")
    )


def format_od_trajs(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """``(n,((o,d),CompactBuffer(t1, t2)))`` per block of a pair, largest pair first (K4).

    ``blocks`` and ``counts`` are the outputs of ``od_traj_lists`` and ``od_traj_counts``; n is the number of all
    trips of the pair, which may have several lines.
    """
    sizes = counts.select("o_id", "d_id", F.col("n").alias("_total"))
    ids = F.array_join(F.col("trajs").cast("array<string>"), ", ")
    text = F.format_string("(%d,((%d,%d),CompactBuffer(%s)))", F.col("_total"), F.col("o_id"), F.col("d_id"), ids)
    ordered = blocks.join(sizes, ["o_id", "d_id"]).orderBy(F.col("_total").desc(), "o_id", "d_id", "block")
    return ordered.select(text.alias("value"))


def format_od_routes(routes: DataFrame) -> DataFrame:
    """``((o,d),n_routes,(freq,edge_id:e1,e2,...))``, one line per route (K5)."""
    return routes.select(
        F.format_string(
            "((%d,%d),%d,(%d,edge_id:%s))", F.col("o_id"), F.col("d_id"), F.col("n_routes"), F.col("freq"),
            path_text(F.col("edges")),
        ).alias("value")
    )


def format_restored(points: DataFrame) -> DataFrame:
    """``traj_id,x|y|0|t|0,...`` per trip in travel order (K7); t is 0 where the trip has no times."""
    t = F.coalesce(F.col("t"), F.lit(0)) if "t" in points.columns else F.lit(0)
    point = F.concat_ws("|", *[c.cast("string") for c in (F.col("x"), F.col("y"), F.lit(0), t, F.lit(0))])
    trips = points.groupBy("traj_id").agg(F.sort_array(F.collect_list(F.struct("site", point.alias("p")))).alias("_l"))
    return trips.select(F.concat_ws(",", F.col("traj_id").cast("string"), F.col("_l.p")).alias("value"))


def format_edges(edges: DataFrame) -> DataFrame:
    """``edge_id<TAB>s_id<TAB>e_id<TAB>length`` (K8)."""
    return edges.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("edge_id", "s_id", "e_id", "length")]).alias("value"))


def format_expansions(expansions: DataFrame) -> DataFrame:
    """``(o,d)|path,freq[x_o,x_d,x_route|]``, one line per expansion (K9)."""
    return expansions.select(
        F.format_string(
            "(%d,%d)|%s,%d[%d,%d,%d|]", F.col("o_id"), F.col("d_id"), path_text(F.col("edges")), F.col("freq"),
            F.col("x_o_id"), F.col("x_d_id"), F.col("x_route_id"),
        ).alias("value")
    )


def format_counted_routes(expanded: DataFrame, expansions: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``(o,d)|path,freq[x_o,x_d,x_route|x_o,...|]`` of every route, own or created, with its expansions (K9).

    A route without expansions has an empty list, one with very many has several lines.
    """
    of = expansions.select("o_id", "d_id", "edges", "x_o_id", "x_d_id", "x_route_id")
    listed = of.groupBy("o_id", "d_id", "edges", block_of(F.col("x_route_id"), block_bits).alias("_b")).agg(
        F.sort_array(F.collect_list(F.struct("x_o_id", "x_d_id", "x_route_id"))).alias("_x")
    )
    items = F.transform("_x", lambda x: F.concat(F.concat_ws(",", *[x[c].cast("string") for c in ("x_o_id", "x_d_id", "x_route_id")]), F.lit("|")))
    text = F.coalesce(F.array_join(items, ""), F.lit(""))
    return expanded.join(listed, ["o_id", "d_id", "edges"], "left").select(
        F.format_string("(%d,%d)|%s,%d[%s]", F.col("o_id"), F.col("d_id"), path_text(F.col("edges")), F.col("freq"), text).alias("value")
    )


def format_vertex_trajs(blocks: DataFrame) -> DataFrame:
    """``vertex|t1,t2,`` sorted by vertex (K10); ``blocks`` is the output of ``vertex_postings``."""
    ids = F.array_join(F.transform(F.col("trajs").cast("array<string>"), lambda x: F.concat(x, F.lit(","))), "")
    return blocks.orderBy("vertex_id", "block").select(
        F.concat(F.col("vertex_id").cast("string"), F.lit("|"), ids).alias("value")
    )


def format_histogram(histogram: DataFrame) -> DataFrame:
    """``(n_edges,n)``, rarest length first."""
    return histogram.orderBy("n", "n_edges").select(F.format_string("(%d,%d)", "n_edges", "n").alias("value"))
