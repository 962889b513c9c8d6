"""Prefix tree of routes as a table of nodes.

A node is a different prefix (o_id, v1, ..., vk) of some route from o_id.  Writing prefixes out would
make L routes of length L cost L^2, so a node is named by a 120-bit fingerprint instead: the running XOR
of one hash per (depth, element).  It is scanned along the path inside the route's row, and routes that share
a prefix meet at the same name and combine before the shuffle.  As names hang on the prefix alone, the nodes
of a new batch of routes are simply added to stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest_halves

ROOT = 0


def trie_nodes(routes: DataFrame, path_col: str = "vertices", skip_first: bool = True) -> DataFrame:
    """Nodes below the root of every origin.

    Columns: o_id, depth, element, node_hi, node_lo, parent_hi, parent_lo, end_freq, pass_freq.
    ``end_freq`` is the number of trips that end exactly at the node, ``pass_freq`` of those that reach
    it.  Vertex paths skip their first element, which is the root; edge paths pass ``skip_first=False``.
    ``routes`` are merged routes, so route_id names one path of its pair.
    """
    path = F.slice(path_col, 2, F.size(path_col)) if skip_first else F.col(path_col)
    named = routes.select("o_id", "freq", F.size(path).cast("bigint").alias("_n"), F.inline(_prefixes(path)))
    ends_here = F.when(F.col("depth") == F.col("_n"), F.col("freq")).otherwise(F.lit(0))
    return _added(named.select(*KEY, ends_here.alias("end_freq"), F.col("freq").alias("pass_freq")))


KEY = ["o_id", "depth", "element", "node_hi", "node_lo", "parent_hi", "parent_lo"]


def _prefixes(path: Column) -> Column:
    """(depth, element, node_hi, node_lo, parent_hi, parent_lo) of every prefix of the path."""
    zero = F.lit(ROOT).cast("bigint")
    digest = F.transform(path, lambda x, i: F.struct((i + 1).cast("bigint").alias("depth"), x.alias("x"), F.md5(F.concat_ws("|", (i + 1).cast("string"), x.cast("string"))).alias("m")))

    def halves(e: Column) -> Column:
        hi, lo = digest_halves(e["m"])
        return F.struct(e["depth"].alias("depth"), e["x"].alias("x"), hi.alias("hi"), lo.alias("lo"))

    def node(depth: Column, x: Column, hi: Column, lo: Column, parent_hi: Column, parent_lo: Column) -> Column:
        return F.struct(
            depth.alias("depth"), x.alias("element"), hi.alias("node_hi"), lo.alias("node_lo"),
            parent_hi.alias("parent_hi"), parent_lo.alias("parent_lo"),
        )

    root = node(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), zero, zero, zero, zero)

    def step(seen: Column, e: Column) -> Column:
        # the one-element array binds the node before
        last = F.slice(seen, -1, 1)
        return F.concat(seen, F.transform(last, lambda p: node(
            e["depth"], e["x"], p["node_hi"].bitwiseXOR(e["hi"]), p["node_lo"].bitwiseXOR(e["lo"]), p["node_hi"], p["node_lo"],
        )))

    return F.slice(F.aggregate(F.transform(digest, halves), F.array(root), step), F.lit(2), F.size(path))


def _added(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(*KEY).agg(F.sum("end_freq").cast("bigint").alias("end_freq"), F.sum("pass_freq").cast("bigint").alias("pass_freq"))


def add_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored nodes plus those of new routes: what the nodes of all routes together are.

    The new routes are of new trips; no route is read again.
    """
    return _added(stored.unionByName(new.select(*stored.columns)))


def trie_leaves(nodes: DataFrame) -> DataFrame:
    """Nodes where some trip ends; a node can be an end and have children."""
    return nodes.where(F.col("end_freq") > 0)


def trie_children(nodes: DataFrame) -> DataFrame:
    """Number of children per node that has any (the root of an origin is named 0, 0)."""
    return nodes.groupBy(
        "o_id", F.col("parent_hi").alias("node_hi"), F.col("parent_lo").alias("node_lo")
    ).agg(F.count(F.lit(1)).alias("n_children"))
