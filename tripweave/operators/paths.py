"""Trips as rows and as arrays.

The long form (traj_id, site, id) is the working form: every step on it is linear in the number of
rows.  The array form is one row per trip and is used where the result itself is a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as fp

DEFAULT_MIN_LEN = 10


def number_sites(visits: DataFrame, order_by: list[str], id_col: str = "vertex_id") -> DataFrame:
    """0-based position of every visit within its trip."""
    w = Window.partitionBy("traj_id").orderBy(*order_by)
    site = (F.row_number().over(w) - 1).cast("bigint")
    rest = [c for c in visits.columns if c not in {"traj_id", "site", id_col, *order_by}]
    return visits.select("traj_id", site.alias("site"), id_col, *rest)


def collapse_repeats(seq: DataFrame, id_col: str = "vertex_id", order_by: list[str] | None = None) -> DataFrame:
    """Drop visits equal to the one just before them and renumber (O1).

    The new site is the running number of kept visits, so one exchange and one sort do it all.
    """
    w = Window.partitionBy("traj_id").orderBy(*(order_by or ["site"]))
    prev = F.lag(id_col).over(w)
    new = F.when(prev.isNull() | (prev != F.col(id_col)), 1).otherwise(0)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        seq.withColumn("_new", new)
        .withColumn("_kept", F.sum("_new").over(upto))
        .where(F.col("_new") == 1)
        .select("traj_id", (F.col("_kept") - 1).cast("bigint").alias("site"), id_col)
    )


def pack(seq: DataFrame, id_col: str, path_col: str = "path") -> DataFrame:
    """One row per trip with its ids in travel order."""
    items = F.sort_array(F.collect_list(F.struct("site", id_col)))
    return seq.groupBy("traj_id").agg(items.alias("_l")).select(
        "traj_id", F.transform("_l", lambda x: x[id_col]).alias(path_col)
    )


def unpack(packed: DataFrame, path_col: str, id_col: str) -> DataFrame:
    """Long form of packed trips."""
    return packed.select("traj_id", F.posexplode(path_col).alias("site", id_col)).select(
        "traj_id", F.col("site").cast("bigint").alias("site"), id_col
    )


def longer_than(packed: DataFrame, path_col: str, min_len: int = DEFAULT_MIN_LEN) -> DataFrame:
    """Packed trips with strictly more than ``min_len`` elements (O2)."""
    return packed.where(F.size(path_col) > min_len)


def shorter_than(packed: DataFrame, path_col: str, cap: int) -> DataFrame:
    """Packed paths with fewer than ``cap`` elements."""
    return packed.where(F.size(path_col) < cap)


def vertex_to_edge_rows(traj_vertices: DataFrame, edge_id: Column) -> DataFrame:
    """Edge form of a vertex path; ``edge_id`` is an expression over ``vertex_id`` and ``next_id``."""
    w = Window.partitionBy("traj_id").orderBy("site")
    return (
        traj_vertices.withColumn("next_id", F.lead("vertex_id").over(w))
        .where(F.col("next_id").isNotNull())
        .select("traj_id", "site", edge_id.alias("edge_id"))
    )


def vertex_path(traj_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """Start vertex of every edge, then the end vertex of the last edge (O3).

    Gaps between consecutive edges are not repaired.  A trip with an edge the network lacks is left out whole;
    :func:`rejected_trips` lists these.
    """
    w = Window.partitionBy("traj_id").orderBy("site")
    known = F.min(F.col("s_id").isNotNull() & F.col("e_id").isNotNull()).over(Window.partitionBy("traj_id"))
    ends = traj_edges.join(edges.select("edge_id", "s_id", "e_id"), "edge_id", "left").withColumn("_known", known).where("_known")
    last = F.lead("site").over(w).isNull()
    here = F.struct(F.col("site"), F.col("s_id").alias("vertex_id"))
    after = F.struct((F.col("site") + 1).alias("site"), F.col("e_id").alias("vertex_id"))
    return ends.withColumn("_last", last).select(
        "traj_id", F.inline(F.when(F.col("_last"), F.array(here, after)).otherwise(F.array(here)))
    )


def rejected_trips(traj_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """Trips with an edge the network lacks, and each such edge: (traj_id, edge_id)."""
    whole = edges.where("s_id IS NOT NULL AND e_id IS NOT NULL")
    return traj_edges.select("traj_id", "edge_id").join(whole.select("edge_id"), "edge_id", "left_anti").select("traj_id", "edge_id").distinct()


def od_endpoints(traj_vertices: DataFrame) -> DataFrame:
    """First and last vertex of every trip (O4); combines before the shuffle."""
    return traj_vertices.groupBy("traj_id").agg(
        F.min_by("vertex_id", "site").alias("o_id"), F.max_by("vertex_id", "site").alias("d_id")
    )


def path_length_histogram(traj_edges: DataFrame) -> DataFrame:
    """Number of trips per path length, rarest length first."""
    lengths = traj_edges.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return lengths.groupBy("n_edges").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "n_edges")


def packed_trips(traj_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per trip: edges with their start and end vertices, as parallel arrays.

    A trip with an edge the network lacks is left out whole; :func:`rejected_trips` lists these.
    """
    rows = traj_edges.join(edges.select("edge_id", "s_id", "e_id"), "edge_id", "left")
    items = F.sort_array(F.collect_list(F.struct("site", "edge_id", "s_id", "e_id")))
    known = F.min(F.col("s_id").isNotNull() & F.col("e_id").isNotNull())
    return rows.groupBy("traj_id").agg(items.alias("_l"), known.alias("_known")).where("_known").select(
        "traj_id",
        F.col("_l.edge_id").alias("edges"),
        F.col("_l.s_id").alias("starts"),
        F.col("_l.e_id").alias("ends"),
    )


def slice_by_site(packed: DataFrame, spans: DataFrame, path_col: str = "path") -> DataFrame:
    """Part of each trip between two sites, both included.

    ``spans`` has traj_id, s_site and e_site plus any key columns; one output row per span.  There are many spans to
    a trip, so the trips are hashed, a partition at a time, and the spans stream past them unsorted.
    """
    keys = [c for c in spans.columns if c not in {"traj_id", "s_site", "e_site"}]
    part = fp.slice_sites(F.col(path_col), F.col("s_site"), F.col("e_site"))
    return spans.join(packed.select("traj_id", path_col).hint("shuffle_hash"), "traj_id").select(*keys, "traj_id", part.alias(path_col))


def sub_trajectory(packed: DataFrame, od_trajs: DataFrame) -> DataFrame:
    """Part of each trip from its first edge leaving O to the first edge at or after it entering D.

    Where D is never entered the part runs to the end of the trip; where O is never left it is empty.
    ``packed`` is the output of ``packed_trips``; ``od_trajs`` lists (o_id, d_id, traj_id).
    """
    n = F.size("edges").cast("bigint")
    at = fp.first_site(F.col("starts"), F.col("o_id"))
    joined = od_trajs.select("o_id", "d_id", "traj_id").join(packed, "traj_id").withColumn("_i", at)
    ahead = F.slice("ends", (F.col("_i") + 1).cast("int"), F.size("ends"))
    hit = F.array_position(ahead, F.col("d_id"))
    last = F.when(hit > 0, F.col("_i") + hit - 1).otherwise(n - 1)
    part = F.when(F.col("_i") >= 0, fp.slice_sites(F.col("edges"), F.col("_i"), last)).otherwise(
        F.array().cast("array<bigint>")
    )
    return joined.select("o_id", "d_id", "traj_id", part.alias("edges"))


def containing_vertex(traj_vertices: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vertex_id, traj_id) for every trip that visits a wanted vertex."""
    return (
        traj_vertices.join(wanted.select("vertex_id").distinct(), "vertex_id", "left_semi")
        .select("vertex_id", "traj_id")
        .distinct()
    )


def restrict_trips(trips: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the trips whose traj_id is listed.

    A trip may be listed for hundreds of pairs; each id is kept once before the join sorts them.
    """
    return trips.join(ids.select("traj_id").distinct(), "traj_id", "left_semi")


# Fixed value: what an edge without a distance counts as.
FAR = 900000000.0


def suffix_min(traj_edges: DataFrame, distances: DataFrame) -> DataFrame:
    """Smallest distance over each edge and everything after it on the trip.

    The window runs from the end of the trip backwards, which keeps it linear.
    """
    w = Window.partitionBy("traj_id").orderBy(F.col("site").desc())
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = F.least(F.lit(FAR), F.min("dist").over(w))
    return traj_edges.join(distances.select("edge_id", "dist"), "edge_id", "left").select(
        "traj_id", "site", "edge_id", low.alias("dist")
    )


def overall_min(traj_edges: DataFrame, distances: DataFrame) -> DataFrame:
    """Smallest distance over the whole trip."""
    return (
        traj_edges.join(distances.select("edge_id", "dist"), "edge_id", "left")
        .groupBy("traj_id")
        .agg(F.least(F.lit(FAR), F.min("dist")).alias("dist"))
    )
