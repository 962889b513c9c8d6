"""Routes: the different edge sequences between an origin and a destination, with frequencies.

A route row is (o_id, d_id, route_id, path columns, freq).  Path columns are ``edges`` and, where known,
``vertices`` (starts plus the last end) and ``ends`` (end vertex of every edge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fingerprints
from ..functions import paths as fp
from .od import od_by_scan
from .paths import packed_trips, restrict_trips, sub_trajectory

PATH_COLUMNS = ("edges", "vertices", "ends")


def trip_routes(traj_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """Every trip as a route of frequency 1 between its ends, numbered by trip."""
    p = packed_trips(traj_edges, edges)
    return p.select(
        F.get("starts", F.lit(0)).alias("o_id"),
        F.element_at("ends", -1).alias("d_id"),
        F.col("traj_id").alias("route_id"),
        "edges",
        F.concat("starts", F.slice("ends", -1, 1)).alias("vertices"),
        "ends",
        F.lit(1).cast("bigint").alias("freq"),
    )


def merge_routes(routes: DataFrame, named: bool = False) -> DataFrame:
    """One row per different path of an OD pair; frequencies add, the smallest id stays.

    Equal paths combine before the shuffle, and rows are spread by pair *and* path, so a hot pair is not
    one task.  With ``named`` the paths are told apart by 16-byte names (:func:`fingerprints.names`) and left out of the
    result, where ``route_id`` stands for them: a row moves few bytes however long its path.
    """
    paths = [c for c in PATH_COLUMNS if c in routes.columns]
    keys = fingerprints.names(*map(F.col, paths)) if named else paths
    merged = routes.groupBy("o_id", "d_id", *keys).agg(
        F.min("route_id").alias("route_id"), F.sum("freq").cast("bigint").alias("freq")
    )
    return merged.select("o_id", "d_id", "route_id", "freq") if named else merged


def routes_between(traj_edges: DataFrame, edges: DataFrame, od_trajs: DataFrame) -> DataFrame:
    """Merged routes of every listed pair, cut out of the trips that run through it.

    Only these trips are packed (J12).
    """
    parts = sub_trajectory(packed_trips(restrict_trips(traj_edges, od_trajs), edges), od_trajs)
    return merge_routes(
        parts.select("o_id", "d_id", F.col("traj_id").alias("route_id"), "edges", F.lit(1).cast("bigint").alias("freq"))
    )


def add_vertices(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """``routes`` with ``vertices`` (the starts, then the last end) and ``ends`` of their edges.

    Both are NULL where an edge is not in the network, and empty where there is no edge.  Route_id names one path of its pair.
    """
    key = ["o_id", "d_id", "route_id"]
    sites = routes.select(*key, F.posexplode("edges").alias("site", "edge_id"))
    met = sites.join(edges.select("edge_id", "s_id", "e_id"), "edge_id", "left")
    known = F.min(F.col("s_id").isNotNull() & F.col("e_id").isNotNull())
    lists = met.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("site", "s_id", "e_id"))).alias("_l"), known.alias("_known"))
    ends = F.when(F.col("_known"), F.col("_l.e_id")).when(F.size("edges") == 0, F.array().cast("array<bigint>"))
    vertices = F.when(F.col("_known"), F.concat("_l.s_id", F.slice(F.col("_l.e_id"), -1, 1))).otherwise(ends)
    rest = [c for c in routes.columns if c not in ("vertices", "ends")]
    return routes.join(lists, key, "left").select(*rest, vertices.alias("vertices"), ends.alias("ends"))


def route_counts(routes: DataFrame) -> DataFrame:
    """Number of routes per pair."""
    return routes.groupBy("o_id", "d_id").agg(F.count(F.lit(1)).alias("n_routes"))


def od_routes(routes: DataFrame) -> DataFrame:
    """Routes with their pair's number of routes (A9): one row per route, not one list per pair."""
    return routes.join(route_counts(routes), ["o_id", "d_id"])


def od_trips(routes: DataFrame) -> DataFrame:
    """Trips per pair: the sum of its routes' frequencies."""
    return routes.groupBy("o_id", "d_id").agg(F.sum("freq").cast("bigint").alias("n"))


def routes_to_destination(routes: DataFrame, od: DataFrame) -> DataFrame:
    """Routes of the listed pairs."""
    return routes.join(od.select("o_id", "d_id"), ["o_id", "d_id"], "left_semi")


def renumber_routes(routes: DataFrame, path_col: str = "edges") -> DataFrame:
    """Number all routes 0, 1, 2, ... without gaps.

    Rows are spread over 4096 buckets by a digest of pair and path, numbered inside each bucket, and
    shifted by the sizes of the buckets before it.  The only single-task step sees one row per bucket.
    """
    text = F.concat_ws("|", F.col("o_id").cast("string"), F.col("d_id").cast("string"), fp.path_text(F.col(path_col)))
    keyed = routes.withColumn("_bucket", F.substring(F.md5(text), 1, 3))
    sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_bucket").orderBy("o_id", "d_id", path_col)
    numbered = keyed.withColumn("_rn", F.row_number().over(inside)).join(offsets, "_bucket")
    rest = [c for c in routes.columns if c != "route_id"]
    return numbered.select(*rest, (F.col("_off") + F.col("_rn") - 1).cast("bigint").alias("route_id"))


def add_routes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored routes plus new ones: frequencies add, the older (smaller) id stays."""
    return merge_routes(stored.unionByName(new.select(*stored.columns)))


def _containing(routes: DataFrame) -> DataFrame:
    """(o_id, d_id, x_o_id, x_d_id, x_route_id): this route of another pair runs through O and then D of a pair that has routes."""
    visits = routes.select(F.struct("o_id", "d_id", "route_id").alias("traj_id"), F.posexplode("vertices").alias("site", "vertex_id"))
    return (
        od_by_scan(visits, routes)
        .select("o_id", "d_id", *(F.col(f"traj_id.{c}").alias(f"x_{c}") for c in ("o_id", "d_id", "route_id")))
        .where((F.col("x_o_id") != F.col("o_id")) | (F.col("x_d_id") != F.col("d_id")))
    )


def route_expansions(routes: DataFrame) -> DataFrame:
    """For every pair, the routes of other pairs that contain one of its routes.

    A route F of another pair that runs through O and then D contains, as its expansion base,

    * the shortest own route of (O, D) that lies in F as one run from the first occurrence of its first
      edge (ties by edges), or
    * if no own route does, F's own part from its first O to the next D, a new route of frequency 0.

    One row per (pair, F): o_id, d_id, edges, freq, created, x_o_id, x_d_id, x_route_id.  Route_id names one path of its
    pair, so F is told by all three.

    Containment is not tested route by route.  F can only contain an own route as a run that starts
    where it leaves O for the first time by some edge, has the length of an own route and ends in D.
    Those few runs are named by 16-byte fingerprints, each in constant time from those of F's prefixes, and
    meet the own routes by name; no list of edges is a key.
    """
    pair, x, words = ["o_id", "d_id"], ["x_o_id", "x_d_id", "x_route_id"], ("hi", "lo")
    hi, lo = fingerprints.whole(F.col("edges"))
    own = routes.select(*pair, hi.alias("hi"), lo.alias("lo"), F.size("edges").alias("k"), F.col("edges").alias("run"), F.col("freq").alias("own_freq"))
    up = fingerprints.powers(F.col("k"))
    lengths = (
        routes.select(*pair, F.size("edges").alias("k")).distinct()
        .groupBy(*pair).agg(F.collect_list(F.struct("k", up[0].alias("hi"), up[1].alias("lo"))).alias("lens"))
    )
    hi, lo = fingerprints.prefixes(F.col("edges"))
    f = routes.select(
        *(F.col(c).alias(f"x_{c}") for c in ("o_id", "d_id", "route_id")),
        "edges", "vertices", "ends", hi.alias("seen_hi"), lo.alias("seen_lo"),
    )
    cand = _containing(routes).join(lengths, pair).join(f, x)
    o, d, edges, n = F.col("o_id"), F.col("d_id"), F.col("edges"), F.size("edges")
    leaves = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda p: (F.get("vertices", p) == o) & (F.array_position(edges, F.get(edges, p)) == p + 1),
    )

    def runs(p: Column) -> Column:
        fits = F.filter("lens", lambda l: (p + l["k"] <= n) & (F.get("ends", p + l["k"] - 1) == d))
        return F.transform(fits, lambda l: F.struct(*(
            F.struct(F.get(f"seen_{w}", p).alias("before"), F.get(f"seen_{w}", p + l["k"]).alias("end"), l[w].alias("power")).alias(w) for w in words
        )))

    at = fp.first_site(F.col("vertices"), o)
    reach = F.array_position(fp.tail_after(F.col("vertices"), at), d)
    part = F.slice(edges, (at + 1).cast("int"), reach.cast("int"))
    tried = cand.select(*pair, *x, part.alias("part"), F.posexplode_outer(F.flatten(F.transform(leaves, runs))).alias("pos", "try"))
    tried = tried.select(
        *pair, *x, F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("part")).alias("part"),
        *(fingerprints.run(*(F.col(f"try.{w}.{c}") for c in ("before", "end", "power"))).alias(w) for w in words),
    )
    found = (
        tried.join(own, [*pair, "hi", "lo"], "left")
        .groupBy(*pair, *x)
        .agg(
            F.min(F.when(F.col("own_freq").isNotNull(), F.struct("k", "run", "own_freq"))).alias("m"),
            F.first("part", ignorenulls=True).alias("part"),
        )
    )
    return found.select(
        *pair,
        F.coalesce("m.run", "part").alias("edges"),
        F.coalesce("m.own_freq", F.lit(0)).cast("bigint").alias("freq"),
        F.col("m").isNull().alias("created"),
        *x,
    )


def expanded_routes(routes: DataFrame, expansions: DataFrame) -> DataFrame:
    """Own routes plus those that expansion created (frequency 0): o_id, d_id, edges, freq."""
    created = expansions.where("created").select("o_id", "d_id", "edges", "freq").distinct()
    return routes.select("o_id", "d_id", "edges", "freq").unionByName(created)
