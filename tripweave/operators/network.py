"""Jobs on the road network itself: clean-up, coordinates, neighbourhoods, snapping, grid density."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import geo, geohash
from ..session import cut_lineage, spread

DEFAULT_RADIUS_M = 500.0
_MARGIN = 1 + 1e-9
_POLAR = 89.9


def duplicate_vertices(vertices: DataFrame) -> DataFrame:
    """(vertex_id, canonical_id) for vertices that share an exact position.

    Positions are counted with map-side combine; the members then look their position up, and no list of
    a position's vertices is ever built.
    """
    shared = (
        vertices.groupBy("lng", "lat")
        .agg(F.min("vertex_id").alias("canonical_id"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select("lng", "lat", "canonical_id")
    )
    return vertices.join(shared, ["lng", "lat"]).select("vertex_id", "canonical_id")


def unify_edges(edges: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Edges with both ends replaced by the canonical vertex of their position."""
    # Only ids that really change need looking up.
    moved = duplicates.where(F.col("vertex_id") != F.col("canonical_id"))
    s = moved.select(F.col("vertex_id").alias("s_id"), F.col("canonical_id").alias("_s"))
    e = moved.select(F.col("vertex_id").alias("e_id"), F.col("canonical_id").alias("_e"))
    rest = [c for c in edges.columns if c not in {"edge_id", "s_id", "e_id"}]
    return edges.join(s, "s_id", "left").join(e, "e_id", "left").select(
        "edge_id", F.coalesce("_s", "s_id").alias("s_id"), F.coalesce("_e", "e_id").alias("e_id"), *rest
    )


def restore_coordinates(traj_vertices: DataFrame, vertices: DataFrame, found: Observation | None = None) -> DataFrame:
    """Coordinates of every visit in 1e-7 degrees, cut to whole numbers (J8); unknown vertices drop out.

    ``found``, where given, counts the visits that are kept (``kept``) and dropped (``dropped``) as the result is made, without
    another pass.  :func:`unknown_vertices` lists what is dropped.
    """
    x = (F.col("lng") * F.lit(10000000.0)).cast("bigint").alias("x")
    y = (F.col("lat") * F.lit(10000000.0)).cast("bigint").alias("y")
    rest = [c for c in traj_vertices.columns if c not in {"traj_id", "site", "vertex_id"}]
    if found is None:
        return traj_vertices.join(vertices, "vertex_id").select("traj_id", "site", x, y, *rest)
    located = traj_vertices.join(vertices.withColumn("_known", F.lit(True)), "vertex_id", "left")
    located = located.observe(found, F.count("_known").alias("kept"), F.count_if(F.col("_known").isNull()).alias("dropped"))
    return located.where("_known").select("traj_id", "site", x, y, *rest)


def unknown_vertices(traj_vertices: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vertex_id, n): visits of vertices without coordinates, which :func:`restore_coordinates` drops.

    Visits are counted per vertex before they meet the vertices, so a place that many trips visit is one row.
    """
    visits = traj_vertices.groupBy("vertex_id").agg(F.count(F.lit(1)).alias("n"))
    return visits.join(vertices.select("vertex_id"), "vertex_id", "left_anti")


def vertex_degree(edges: DataFrame) -> DataFrame:
    """(vertex_id, in_deg, out_deg) (A19); one pass over the edges, combined before the shuffle."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("s_id").alias("vertex_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("e_id").alias("vertex_id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        )
    )
    return ends.groupBy("vertex_id").agg(
        F.sum("i").cast("bigint").alias("in_deg"), F.sum("o").cast("bigint").alias("out_deg")
    )


def edge_lengths(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with the great-circle distance between their ends."""
    located = _with_ends(edges, vertices)
    return located.select(
        *edges.columns, geo.haversine(F.col("s_lng"), F.col("s_lat"), F.col("e_lng"), F.col("e_lat")).alias("metres")
    )


def _with_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    s = vertices.select(F.col("vertex_id").alias("s_id"), F.col("lng").alias("s_lng"), F.col("lat").alias("s_lat"))
    e = vertices.select(F.col("vertex_id").alias("e_id"), F.col("lng").alias("e_lng"), F.col("lat").alias("e_lat"))
    return edges.join(s, "s_id").join(e, "e_id")


def _row(lat: Column, radius_m: float) -> Column:
    return F.floor(lat / F.lit(geo.half_height_deg(radius_m)))


def _col(lng: Column, row: Column, radius_m: float) -> Column:
    """Grid column within a row; columns widen toward the poles as the box does.

    A column is at least as wide as the half-width of any box centred in the row above or below.
    """
    step = geo.half_height_deg(radius_m)
    far = F.least(F.greatest(F.abs(row - 1), F.abs(row + 2)) * F.lit(step), F.lit(_POLAR))
    return F.floor(lng / geo.half_width_deg(far, radius_m))


def _home_cell(df: DataFrame, lng: str, lat: str, radius_m: float) -> DataFrame:
    return df.withColumn("_row", _row(F.col(lat), radius_m)).withColumn(
        "_col", _col(F.col(lng), F.col("_row"), radius_m)
    )


def _cells_of_box(df: DataFrame, west: Column, east: Column, south: Column, north: Column, radius_m: float) -> DataFrame:
    """Every cell that the box touches."""
    rows = df.withColumn("_row", F.explode(F.sequence(_row(south, radius_m), _row(north, radius_m))))
    lo = _col(F.greatest(west, F.lit(-180.0)), F.col("_row"), radius_m)
    hi = _col(F.least(east, F.lit(180.0)), F.col("_row"), radius_m)
    return rows.withColumn("_col", F.explode(F.sequence(lo, hi)))


def _near_cells(df: DataFrame, lng: str, lat: str, radius_m: float) -> DataFrame:
    """Every cell that the box around the row's position can touch: about 3 rows of 3 columns.

    The box is taken a hair larger than it is, so that rounding cannot lose a cell.
    """
    h = F.lit(geo.half_height_deg(radius_m) * _MARGIN)
    w = geo.half_width_deg(F.col(lat), radius_m) * F.lit(_MARGIN)
    x, y = F.col(lng), F.col(lat)
    return _cells_of_box(df, x - w, x + w, y - h, y + h, radius_m)


def region_vertices(centres: DataFrame, vertices: DataFrame, radius_m: float = DEFAULT_RADIUS_M) -> DataFrame:
    """(centre_id, vertex_id) for vertices in the box of half-width ``radius_m`` around each centre (G1).

    ``centres`` has centre_id, lng, lat.  An equi-join on grid cells finds the candidates, the exact box
    decides; every pair is met in exactly one cell.
    """
    c = _near_cells(
        centres.select("centre_id", F.col("lng").alias("c_lng"), F.col("lat").alias("c_lat")), "c_lng", "c_lat", radius_m
    )
    v = _home_cell(vertices.select("vertex_id", "lng", "lat"), "lng", "lat", radius_m)
    inside = geo.in_box(F.col("lng"), F.col("lat"), F.col("c_lng"), F.col("c_lat"), radius_m)
    return c.join(v, ["_row", "_col"]).where(inside).select("centre_id", "vertex_id")


def edges_within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in a set of vertices."""
    ids = ids.select("vertex_id")
    return edges.join(ids.withColumnRenamed("vertex_id", "s_id"), "s_id", "left_semi").join(
        ids.withColumnRenamed("vertex_id", "e_id"), "e_id", "left_semi"
    ).select(*edges.columns)


def region_edges(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(centre_id, edge_id) for edges wholly inside each centre's region."""
    s = regions.select("centre_id", F.col("vertex_id").alias("s_id"))
    e = regions.select("centre_id", F.col("vertex_id").alias("e_id"))
    return (
        edges.select("edge_id", "s_id", "e_id")
        .join(s, "s_id")
        .join(e, ["centre_id", "e_id"], "left_semi")
        .select("centre_id", "edge_id")
    )


def nearest_edges(
    points: DataFrame, edges: DataFrame, vertices: DataFrame, radius_m: float = DEFAULT_RADIUS_M, digits: int = 6
) -> DataFrame:
    """(point_id, edge_id, metres): the nearest edge of every point, however far.

    Distances are compared after rounding to ``digits``; ties go to the smaller edge_id.  Points without a position,
    and edges with an end that has none, are left out; an edge is shorter than 17,000 km.

    Edges are filed under the cells within ``radius_m`` of them, and a nearest edge inside that distance is final.
    The positions left go down a pyramid of cells (:func:`_nearest_far`).  Cells are cubes of space, so poles and the
    date line need no care.  Results of both are written (:func:`cut_lineage`), so this runs jobs.

    Points at the same position and edges with the same geometry are taken once, so copies never multiply.
    Candidates go straight into a map-side minimum and are not shuffled.
    """
    shape = ["s_lng", "s_lat", "e_lng", "e_lat"]
    located = _with_ends(edges.select("edge_id", "s_id", "e_id"), vertices).dropna(subset=shape)
    segments = cut_lineage(
        located.groupBy(*shape).agg(F.min("edge_id").alias("edge_id")).withColumn("_c", geo.haversine(*map(F.col, shape)))
    )
    spots = spread(points.select("lng", "lat").dropna().distinct(), "lng", "lat")
    side = radius_m / geo.EARTH_RADIUS_M
    met = _with_cell(spots, "lng", "lat", side).join(_cells_around(segments, radius_m, side), _CELL, "left")
    near = cut_lineage(_nearest_of(met, digits))
    final = F.coalesce(F.col("metres") <= radius_m, F.lit(False))
    left = near.where(~final).select("lng", "lat")
    found = near.where(final)
    if not left.isEmpty():
        found = found.unionByName(_nearest_far(left, segments, radius_m, digits))
    return points.join(found, ["lng", "lat"]).select("point_id", "edge_id", "metres")


_CELL = ["_i", "_j", "_k"]
_WIDEN = 8  # a power of two, so that a cell of one level lies in one of the next


def _with_cell(df: DataFrame, lng: str, lat: str, side: float) -> DataFrame:
    """``df`` with the cube that each position lies in; ``side`` is in radii of the earth."""
    at = geo.unit_vector(F.col(lng), F.col(lat))
    return df.withColumns({c: F.floor(v / side) for c, v in zip(_CELL, at)})


def _cells_around(segments: DataFrame, radius_m: float, side: float) -> DataFrame:
    """Every cube with a position within ``radius_m`` of the segment, as :func:`geo.point_to_segment` measures it.

    A segment is cut along its great circle into pieces of a radius at most, so a long one files cubes in proportion to its
    length.  A piece files the cubes that meet both the ball around it and the surface.  The measured height is less than
    the true one on a long segment, most in its middle, which widens the ball.
    """
    ends = [geo.unit_vector(F.col(f"{e}_lng"), F.col(f"{e}_lat")) for e in "se"]
    omega = F.col("_c") / F.lit(geo.EARTH_RADIUS_M)
    n = F.greatest(F.ceil(F.col("_c") / F.lit(radius_m)), F.lit(1))
    df = segments.withColumns({f"_{e}{x}": v for e, at in zip("se", ends) for x, v in zip("xyz", at)}).withColumn("_n", n)
    df = df.withColumn("_f", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).withColumn("_f", (F.col("_f") + 0.5) / F.col("_n"))
    long = F.col("_n") > 1
    w = [F.when(long, F.sin(part * omega)).otherwise(F.lit(1.0)) for part in (1 - F.col("_f"), F.col("_f"))]
    df = df.withColumns({"_ws": w[0], "_we": w[1]})
    df = df.withColumns({f"_{x}": F.col("_ws") * F.col(f"_s{x}") + F.col("_we") * F.col(f"_e{x}") for x in "xyz"})
    size = F.sqrt(sum((F.col(f"_{x}") * F.col(f"_{x}") for x in "xyz"), F.lit(0.0)))
    half = F.least(omega / 2, F.lit(1.4))
    low = F.when(half > 1e-6, F.sqrt(F.tan(half) / half)).otherwise(F.lit(1.0))
    reach = (F.col("_c") / (2 * F.col("_n")) + F.lit(radius_m + 1) * low) / F.lit(geo.EARTH_RADIUS_M)
    df = df.withColumns({**{f"_{x}": F.col(f"_{x}") / size for x in "xyz"}, "_reach": reach})
    apart, near, far = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for c, x in zip(_CELL, (F.col("_x"), F.col("_y"), F.col("_z"))):
        df = df.withColumn(c, F.explode(F.sequence(F.floor((x - F.col("_reach")) / side), F.floor((x + F.col("_reach")) / side))))
        lo, hi = F.col(c) * F.lit(side), (F.col(c) + 1) * F.lit(side)
        apart += _gap(x, lo, hi) ** 2
        near += _gap(F.lit(0.0), lo, hi) ** 2
        far += F.greatest(lo * lo, hi * hi)
    met = (apart <= F.col("_reach") * F.col("_reach")) & (near <= 1 + 1e-9) & (far >= 1 - 1e-9)
    return df.where(met).select(*segments.columns, *_CELL).dropDuplicates(["edge_id", *_CELL])


def _gap(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo - x, x - hi, F.lit(0.0))


def _nearest_of(met: DataFrame, digits: int) -> DataFrame:
    """(lng, lat, edge_id, metres): the nearest of the segments that each position has met, NULL if there is none."""
    to_start = geo.haversine(F.col("lng"), F.col("lat"), F.col("s_lng"), F.col("s_lat"))
    to_end = geo.haversine(F.col("lng"), F.col("lat"), F.col("e_lng"), F.col("e_lat"))
    # distances to the ends are columns, since the height names them again and again
    met = met.select("lng", "lat", "edge_id", "_c", to_start.alias("_a"), to_end.alias("_b"))
    metres = F.round(geo.point_to_segment(F.col("_a"), F.col("_b"), F.col("_c")), digits)
    best = F.when(F.col("edge_id").isNotNull(), F.struct(metres.alias("metres"), "edge_id"))
    return (
        met.select("lng", "lat", best.alias("_best")).groupBy("lng", "lat").agg(F.min("_best").alias("_best"))
        .select("lng", "lat", "_best.edge_id", "_best.metres")
    )


def _nearest_far(spots: DataFrame, segments: DataFrame, radius_m: float, digits: int) -> DataFrame:
    """(lng, lat, edge_id, metres) by branch and bound down a pyramid of cells.

    A segment lies in the cell of its start, on the level whose cells are about as wide as it is long.  With a the
    distance to the start and c the length, the measured distance is between a - c - 10 m and a.  So a
    cell's box and longest segment bound it from below, and any start inside from above.  On each level a
    position keeps the cells that its surest cell cannot beat, and meets the cells inside those on the next.
    """
    sides = [radius_m / geo.EARTH_RADIUS_M]
    while sides[-1] < 2:
        sides.append(sides[-1] * _WIDEN)
    top = len(sides) - 1
    own = F.least(F.greatest(F.ceil(F.log(F.col("_c") / F.lit(radius_m)) / F.log(F.lit(float(_WIDEN)))), F.lit(0)), F.lit(top))
    start = dict(zip(("_x", "_y", "_z"), geo.unit_vector(F.col("s_lng"), F.col("s_lat"))))
    # the logarithm of 0 is NULL
    filed = cut_lineage(segments.withColumns({**start, "_level": F.coalesce(own, F.lit(0)).cast("int")}))
    places = spots.withColumns(dict(zip(("_px", "_py", "_pz"), geo.unit_vector(F.col("lng"), F.col("lat"))))).withColumn("_most", F.lit(math.inf))
    corner = F.explode(F.array(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")))
    kept, leaves = places.withColumn("_i", corner).withColumn("_j", corner).withColumn("_k", corner), []
    per_spot = Window.partitionBy("lng", "lat")
    for level in range(top, -1, -1):
        side = sides[level]
        at = {c: F.floor(F.col(x) / side) for c, x in zip(_CELL, ("_x", "_y", "_z"))}
        boxes = [f(x).alias(f"{n}{x}") for x in ("_x", "_y", "_z") for f, n in ((F.min, "_lo"), (F.max, "_hi"))]
        cells = filed.where(F.col("_level") <= level).withColumns(at).groupBy(*_CELL).agg(
            *boxes, F.max("_c").alias("_long"), F.max(F.when(F.col("_level") == level, F.col("_c"))).alias("_own"),
            F.min(F.struct("_x", "_y", "_z")).alias("_start"),
        )
        if level < top:  # the cells inside those that are kept
            inside = [F.floor(F.col(c) / _WIDEN).alias(f"{c}up") for c in _CELL]
            kept = kept.withColumnsRenamed({c: f"{c}up" for c in _CELL}).join(cells.select("*", *inside), [f"{c}up" for c in _CELL])
        else:
            kept = kept.join(cells, _CELL)
        low = sum((_gap(F.col(f"_p{x}"), F.col(f"_lo_{x}"), F.col(f"_hi_{x}")) ** 2 for x in "xyz"), F.lit(0.0))
        high = sum(((F.col(f"_p{x}") - F.col(f"_start._{x}")) ** 2 for x in "xyz"), F.lit(0.0))
        kept = kept.withColumns({"_least": _arc(low) - geo.SNAP_M - 1, "_sure": _arc(high) + 1})
        kept = kept.withColumn("_most", F.least(F.col("_most"), F.min("_sure").over(per_spot)))
        kept = cut_lineage(
            kept.where(F.col("_least") - F.col("_long") <= F.col("_most"))
            .select("lng", "lat", "_px", "_py", "_pz", "_most", *_CELL, (F.col("_least") - F.col("_own")).alias("_least"))
        )
        found = kept.where(F.col("_least") <= F.col("_most")).select("lng", "lat", *_CELL)
        leaves.append(found.join(filed.where(F.col("_level") == level).withColumns(at), _CELL).select("lng", "lat", *segments.columns))
    return cut_lineage(_nearest_of(reduce(DataFrame.unionByName, leaves), digits))


def _arc(chord_squared: Column) -> Column:
    """Metres on the surface between points whose distance through the earth, in its radii, is given squared."""
    return F.lit(2 * geo.EARTH_RADIUS_M) * F.asin(F.least(F.sqrt(chord_squared) / 2, F.lit(1.0)))


def geohash_cells(vertices: DataFrame, precision: int = geohash.PRECISION) -> DataFrame:
    """Vertices with their grid cell."""
    n_lng, n_lat = geohash.axis_bits(precision)
    return vertices.withColumn("_x", geohash.cell_number(F.col("lng"), 180.0, n_lng)).withColumn(
        "_y", geohash.cell_number(F.col("lat"), 90.0, n_lat)
    )


def geohash_density(vertices: DataFrame, precision: int = geohash.PRECISION) -> DataFrame:
    """(cell, n, lat, lng): vertices per grid cell with the cell's centre.

    Counted on the two cell numbers; codes and centres are written once per cell.
    """
    n_lng, n_lat = geohash.axis_bits(precision)
    counts = geohash_cells(vertices, precision).groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        geohash.cell_code(F.col("_x"), F.col("_y"), precision).alias("cell"),
        "n",
        geohash.cell_centre(F.col("_y"), 90.0, n_lat).alias("lat"),
        geohash.cell_centre(F.col("_x"), 180.0, n_lng).alias("lng"),
    )
