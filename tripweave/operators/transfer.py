"""Transfer matrices: how often each edge is used on the way to a destination (A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arrivals(postings: DataFrame, edges: DataFrame, destinations: DataFrame) -> DataFrame:
    """(d_id, traj_id, last_site): where each trip first enters each destination.

    Spread by trip, which is how ``transfer_matrix`` joins it.
    """
    into = edges.join(
        destinations.select(F.col("d_id").alias("e_id")).distinct(), "e_id", "left_semi"
    ).select(F.col("edge_id").alias("key_id"), F.col("e_id").alias("d_id"))
    entered = postings.join(into, "key_id").select("d_id", "traj_id", "site").repartition("traj_id")
    return entered.groupBy("d_id", "traj_id").agg(F.min("site").alias("last_site"))


def transfer_matrix(
    traj_edges: DataFrame, postings: DataFrame, edges: DataFrame, destinations: DataFrame
) -> DataFrame:
    """(d_id, s_id, e_id, edge_id, num) for all destinations at once.

    ``num`` counts the uses of the edge up to and including the first arrival at d_id.  Uses are counted
    per (d_id, edge_id) with map-side combine right where they are joined; the ends of an edge are looked
    up afterwards, once per counted pair.
    """
    reached = arrivals(postings, edges, destinations)
    used = (
        traj_edges.join(reached, "traj_id")
        .where(F.col("site") <= F.col("last_site"))
        .groupBy("d_id", "edge_id")
        .agg(F.count(F.lit(1)).alias("num"))
    )
    return used.join(edges.select("edge_id", "s_id", "e_id"), "edge_id").select(
        "d_id", "s_id", "e_id", "edge_id", "num"
    )
