"""Columnar tables.

Tables that are looked up by key are range-partitioned and sorted by it: a filter on the key then skips
files and row groups, and as the sort goes on with the trip or path, a hot key spreads over many files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_sorted(df: DataFrame, path: str, by: Sequence[str], mode: str = "errorifexists") -> None:
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, by: str, buckets: int, sort: Sequence[str] = ()) -> None:
    """A table at ``path``, named ``name`` in the session's catalog, dealt by ``by`` into ``buckets`` files or so, sorted in each.

    A join or grouping on ``by`` needs no exchange on this side, and a filter on one value reads its bucket only.
    """
    rows = df.repartition(buckets, by)
    rows.write.bucketBy(buckets, by).sortBy(by, *sort).option("path", path).saveAsTable(name)


def write_postings(postings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Edge or vertex index (K1, K2): sorted by key, not one file per key.

    Sorted files spread a hot key; :func:`write_bucketed` suits lookups and joins on keys that fit a task.
    """
    write_sorted(postings.select("key_id", "traj_id", "site"), path, ["key_id", "traj_id"], mode)


def write_od_counts(counts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """OD counts (K3)."""
    write_table(counts, path, mode)


def write_od_trajs(od_trajs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Trips per pair (K4), as rows."""
    write_sorted(od_trajs.select("o_id", "d_id", "traj_id"), path, ["o_id", "d_id", "traj_id"], mode)


def write_od_routes(routes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Routes per pair with the pair's number of routes (K5)."""
    write_sorted(routes, path, ["o_id", "d_id", "route_id"], mode)


def write_transfer_matrix(matrix: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per destination with ``s_id,e_id,edge_id,num`` rows (K6).

    Rows are spread by range over destination and edge, so a folder has few files and a busy
    destination still has several writers.
    """
    by = ["d_id", "s_id", "e_id", "edge_id"]
    matrix.select("d_id", "s_id", "e_id", "edge_id", "num").repartitionByRange(*by).write.mode(mode).partitionBy(
        "d_id"
    ).csv(path)


def write_routes(routes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Routes, scored or not (K9, K12): sorted by pair."""
    write_sorted(routes, path, ["o_id", "d_id", "route_id"], mode)


def write_expansions(expansions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Route expansions (K9), one row each."""
    write_sorted(expansions, path, ["o_id", "d_id", "x_route_id"], mode)


def write_route_counts(counts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Number of routes per pair (K9), as a number."""
    write_table(counts, path, mode)


def write_trie(nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Trie nodes (K12), sorted by origin and depth."""
    write_sorted(nodes, path, ["o_id", "depth", "node_hi", "node_lo"], mode)


def write_histogram(histogram: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Path-length histogram."""
    write_table(histogram, path, mode)
