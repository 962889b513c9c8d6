"""Trips, networks and points derived from the given tables.

Trips are made from order and event histories: the supplier nation (or region) of consecutive shipments
is the place a trip visits.  Every frame covers its whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.operators import paths
from tripweave.session import cut_lineage, tune

EDGE_BASE = 1000


def edge_between(s: str, e: str):
    return (F.col(s) * EDGE_BASE + F.col(e)).alias("edge_id")


class Fixtures:
    """Lazy input frames over one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = False):
        """With ``stored``, trips and networks are written once, for queries that read them in several branches."""
        self.spark = tune(spark)
        self.dir = sf_dir
        self._keep = cut_lineage if stored else (lambda df: df)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # fa: long paths over five vertices, repeats kept
    @cached_property
    def fa_points(self) -> DataFrame:
        code = (
            F.when(F.col("event_type") == "click", 1)
            .when(F.col("event_type") == "error", 2)
            .when(F.col("event_type") == "purchase", 3)
            .when(F.col("event_type") == "signup", 4)
            .otherwise(5)
            .cast("bigint")
        )
        visits = self.table("events").select(
            F.col("user_id").alias("traj_id"), "ts", F.col("event_id"), code.alias("vertex_id"),
            F.col("event_id").alias("t"),
        )
        return paths.number_sites(visits, ["ts", "event_id"])

    # fb: long paths over 25 vertices, collapsed
    @cached_property
    def fb_vertices(self) -> DataFrame:
        line = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
        visits = (
            line.join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .withColumn("traj_id", F.col("o_custkey"))
            .withColumn("vertex_id", (F.col("s_nationkey") + 1).cast("bigint"))
        )
        return self._keep(
            paths.collapse_repeats(
                visits, order_by=["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
            )
        )

    # fc: short paths over five vertices with much repetition, collapsed
    def _fc(self, line: DataFrame) -> DataFrame:
        visits = (
            line.join(self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
            .withColumn("traj_id", F.col("l_orderkey"))
            .withColumn("vertex_id", (F.col("n_regionkey") + 1).cast("bigint"))
        )
        return paths.collapse_repeats(visits, order_by=["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"])

    @cached_property
    def _line(self) -> DataFrame:
        return self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")

    @cached_property
    def fc_vertices(self) -> DataFrame:
        return self._keep(self._fc(self._line))

    def fc_edges_of_status(self, open_orders: bool) -> DataFrame:
        """fc trips split into two batches by whether their order is still open; together they are all of fc."""
        is_open = F.col("o_orderstatus") == "O"
        orders = self.table("orders").where(is_open if open_orders else ~is_open)
        line = self._line.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
        return self.edges_of(self._fc(line))

    @staticmethod
    def edges_of(vertices: DataFrame) -> DataFrame:
        return paths.vertex_to_edge_rows(vertices, edge_between("vertex_id", "next_id"))

    @staticmethod
    def network_of(edges: DataFrame) -> DataFrame:
        return edges.select("edge_id").distinct().select(
            "edge_id",
            F.expr(f"edge_id div {EDGE_BASE}").alias("s_id"),
            (F.col("edge_id") % EDGE_BASE).alias("e_id"),
        )

    @cached_property
    def fb_edges(self) -> DataFrame:
        return self._keep(self.edges_of(self.fb_vertices))

    @cached_property
    def fb_network(self) -> DataFrame:
        return self._keep(self.network_of(self.fb_edges))

    @cached_property
    def fc_edges(self) -> DataFrame:
        return self._keep(self.edges_of(self.fc_vertices))

    @cached_property
    def fc_network(self) -> DataFrame:
        return self._keep(self.network_of(self.fc_edges))

    # fn: a road network with duplicate positions
    @cached_property
    def fn_vertices(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("vertex_id"),
            (F.lit(116.3) + (k % 8).cast("double") * F.lit(0.004)).alias("lng"),
            (F.lit(39.9) + (k % 6).cast("double") * F.lit(0.003)).alias("lat"),
        )

    @cached_property
    def fn_edges(self) -> DataFrame:
        a = self.table("supplier").select(F.col("s_suppkey").alias("s_id"), F.abs("s_acctbal").alias("length"))
        b = self.table("supplier").select(F.col("s_suppkey").alias("e_id"))
        pairs = a.select("*", F.explode(F.array(F.col("s_id") + 1, F.col("s_id") + 3)).alias("e_id")).join(b, "e_id")
        return pairs.select((F.col("s_id") * 1000000 + F.col("e_id")).alias("edge_id"), "s_id", "e_id", "length")

    # fp: points to snap
    @cached_property
    def fp_points(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("point_id"),
            (F.lit(116.3) + (k % 97).cast("double") * F.lit(0.0003)).alias("lng"),
            (F.lit(39.9) + (k % 89).cast("double") * F.lit(0.0002)).alias("lat"),
        )

    # fg: coordinates of the vertices of fb
    @cached_property
    def fg_vertices(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            (k + 1).cast("bigint").alias("vertex_id"),
            (F.lit(116.3) + k.cast("double") * F.lit(0.0125)).alias("lng"),
            (F.lit(39.9) + k.cast("double") * F.lit(0.00625)).alias("lat"),
        )
