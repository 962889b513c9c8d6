from __future__ import annotations

import math

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import rows
from tripweave.functions import geohash
from tripweave.operators import network


def literal_box(lat, radius):
    degree = (24901 * 1609) / 360.0
    return 1 / degree * radius, radius / (degree * math.cos(lat * math.pi / 180))


@pytest.mark.parametrize("lat0", [0.0, 39.9, -39.9, 78.0, 89.7, -89.95])
def test_region_join_is_the_literal_box(spark, rng, lat0):
    h, w = literal_box(lat0, 500)
    spot = lambda: (116.3 + rng.uniform(-4, 4) * w, min(max(lat0 + rng.uniform(-4, 4) * h, -90), 90))
    vertices = [(i, *spot()) for i in range(150)]
    centres = [(i, *spot()) for i in range(40)]
    got = network.region_vertices(
        spark.createDataFrame(centres, "centre_id long, lng double, lat double"),
        spark.createDataFrame(vertices, "vertex_id long, lng double, lat double"),
    )
    want = []
    for c, x, y in centres:
        bh, bw = literal_box(y, 500)
        want += [(c, v) for v, a, b in vertices if x - bw <= a <= x + bw and y - bh <= b <= y + bh]
    assert rows(got, "*") == sorted(want) and want


def test_region_edges_need_both_ends(spark):
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 3)], "edge_id long, s_id long, e_id long")
    inside = spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "centre_id long, vertex_id long")
    assert rows(network.region_edges(edges, inside), "*") == [(7, 1), (8, 3)]
    assert rows(network.edges_within(edges, inside.where("centre_id = 7")), "edge_id") == [(1,)]


def literal_distance(p, q):
    dlat, dlng = math.radians(p[1] - q[1]), math.radians(p[0] - q[0])
    a = math.sin(dlat / 2) ** 2 + math.cos(math.radians(q[1])) * math.cos(math.radians(p[1])) * math.sin(dlng / 2) ** 2
    return 6378137 * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def literal_to_segment(p, s, e):
    """The foot of the height lies ``along`` metres from the start; beyond an end, that end counts."""
    a, b, c = literal_distance(p, s), literal_distance(p, e), literal_distance(s, e)
    if min(a, b) < 10:
        return 0.0
    along = (a * a + c * c - b * b) / (2 * c) if c >= 10 else 0.0
    if along <= 0:
        return a
    return b if along >= c else math.sqrt(max(a * a - along * along, 0.0))


@pytest.mark.parametrize("lat0", [-0.01, 39.9, -39.9, 75.0, 89.88])
def test_nearest_edge_is_the_literal_search(spark, rng, lat0):
    spread = 0.015 / math.cos(math.radians(lat0))
    spot = lambda: (116.3 + rng.uniform(0, spread), lat0 + rng.uniform(0, 0.02))
    at = {i: spot() for i in range(60)}
    at[60] = at[0]
    ends = [(i, rng.randrange(61), rng.randrange(61)) for i in range(300)]
    points = [(i, *spot()) for i in range(80)]
    points += [(80 + i, *at[i]) for i in range(10)]
    got = network.nearest_edges(
        spark.createDataFrame(points, "point_id long, lng double, lat double"),
        spark.createDataFrame(ends, "edge_id long, s_id long, e_id long"),
        spark.createDataFrame([(i, *p) for i, p in at.items()], "vertex_id long, lng double, lat double"),
    )
    result = {p: (e, m) for p, e, m in rows(got, "point_id", "edge_id", "metres")}
    assert len(result) == len(points)
    for i, x, y in points:
        far = {k: literal_to_segment((x, y), at[s], at[e]) for k, s, e in ends}
        edge, metres = result[i]
        assert metres == pytest.approx(min(far.values()), abs=1e-3) and far[edge] == pytest.approx(metres, abs=1e-3)


def _snap(spark, points, edges, at):
    got = network.nearest_edges(
        spark.createDataFrame(points, "point_id long, lng double, lat double"),
        spark.createDataFrame(edges, "edge_id long, s_id long, e_id long"),
        spark.createDataFrame(at, "vertex_id long, lng double, lat double"),
    )
    return rows(got, "point_id", "edge_id", "metres")


def test_nearest_edge_may_be_long(spark):
    at = [(1, 116.28, 39.9), (2, 116.32, 39.9), (3, 116.3, 39.9028), (4, 116.3004, 39.9028)]
    got = _snap(spark, [(1, 116.3, 39.9), (2, 116.31, 39.9)], [(10, 1, 2), (11, 3, 4)], at)
    assert [(p, e) for p, e, _ in got] == [(1, 10), (2, 10)] and all(m < 0.5 for *_, m in got)


def test_nearest_edge_may_be_far(spark, rng):
    at = [(i, 116.3 + rng.uniform(0, 0.5), 39.9 + rng.uniform(0, 0.5)) for i in range(20)]
    edges = [(i, rng.randrange(20), rng.randrange(20)) for i in range(15)]
    points = [(1, 116.4, 40.0), (2, 117.9, 41.0), (3, 80.0, 10.0), (4, -60.0, -40.0), (5, None, 1.0)]
    got = {p: m for p, _, m in _snap(spark, points, edges, at)}
    where = {i: q for i, *q in at}
    for i, x, y in points[:4]:
        assert got[i] == pytest.approx(min(literal_to_segment((x, y), where[s], where[e]) for _, s, e in edges), abs=1e-2)
    assert len(got) == 4 and _snap(spark, points, [(1, 98, 99)], at) == []


def test_nearest_edge_anywhere_on_the_globe(spark, rng):
    """Points beyond every radius, at the poles and across the date line; edges of a few metres and of thousands of km."""
    spot = lambda: (rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1))))
    at, edges = {}, []
    for i in range(120):
        x, y = spot()
        size = 10.0 ** rng.uniform(-4, 1.3)
        at[2 * i], at[2 * i + 1] = (x, y), (x + rng.uniform(-size, size), max(-90.0, min(90.0, y + rng.uniform(-size, size))))
        edges.append((i, 2 * i, 2 * i + 1))
    points = [(i, *spot()) for i in range(200)] + [(300, 10.0, 90.0), (301, -77.0, -90.0), (302, 180.0, 0.0), (303, -180.0, 0.0)]
    points += [(400 + i, at[2 * i][0] + 0.001, at[2 * i][1]) for i in range(100)]
    got = {p: (e, m) for p, e, m in _snap(spark, points, edges, [(i, *q) for i, q in at.items()])}
    assert len(got) == len(points)
    for i, x, y in points:
        best = min(literal_to_segment((x, y), at[s], at[e]) for _, s, e in edges)
        assert got[i][1] == pytest.approx(best, abs=0.5, rel=1e-6), i


def test_far_points_meet_few_edges(spark, rng):
    """Points a thousand km from a town: each meets a small share of its edges."""
    at = [(i, 116.3 + rng.uniform(0, 0.4), 39.9 + rng.uniform(0, 0.4)) for i in range(2000)]
    edges = [(i, i, rng.randrange(2000)) for i in range(2000)]
    short = [(i, s, e) for i, s, e in edges if math.dist(at[s][1:], at[e][1:]) < 0.05]
    town = network._with_ends(
        spark.createDataFrame(short, "edge_id long, s_id long, e_id long"),
        spark.createDataFrame(at, "vertex_id long, lng double, lat double"),
    ).select("s_lng", "s_lat", "e_lng", "e_lat", "edge_id")
    from tripweave.functions import geo

    segments = town.withColumn("_c", geo.haversine(*map(F.col, ["s_lng", "s_lat", "e_lng", "e_lat"])))
    spots = spark.createDataFrame([(120.0 + i, 30.0 + i) for i in range(10)], "lng double, lat double")
    met = []
    real = network._nearest_of
    network._nearest_of = lambda df, digits: met.append(df.count()) or real(df, digits)
    try:
        assert network._nearest_far(spots, segments, 500.0, 6).count() == 10
    finally:
        network._nearest_of = real
    assert len(short) > 20 and met[0] < 10 * len(short) / 2


def literal_code(lat, lng, precision):
    symbols, box, code, out = geohash.SYMBOLS, {"x": [-180.0, 180.0], "y": [-90.0, 90.0]}, 0, ""
    for step in range(5 * precision):
        axis, value = ("x", lng) if step % 2 == 0 else ("y", lat)
        mid = sum(box[axis]) / 2
        up = value > mid
        box[axis][0 if up else 1] = mid
        code = 2 * code + up
        if step % 5 == 4:
            out, code = out + symbols[code], 0
    return out, sum(box["y"]) / 2, sum(box["x"]) / 2


@pytest.mark.parametrize("precision", [1, 5, 8, 15])
def test_geohash_is_the_literal_halving(spark, rng, precision):
    edge_cases = [(x, y) for x in (-180.0, -45.0, 0.0, 45.0, 90.0, 180.0) for y in (-90.0, -22.5, 0.0, 11.25, 90.0)]
    n_lng, _ = geohash.axis_bits(precision)
    boundary = [(-180 + 360 * rng.randrange(1 << n_lng) / (1 << n_lng), 12.3) for _ in range(100)]
    nudged = [(math.nextafter(x, rng.choice([-200, 200])), y) for x, y in boundary]
    spots = edge_cases + boundary + nudged + [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(200)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "vertex_id long, lng double, lat double")
    cells = network.geohash_cells(df, precision).select("vertex_id", geohash.cell_code(F.col("_x"), F.col("_y"), precision).alias("c"))
    got = dict(rows(cells, "vertex_id", "c"))
    assert got == {i: literal_code(y, x, precision)[0] for i, (x, y) in enumerate(spots)}
    density = {r.cell: r for r in network.geohash_density(df, precision).collect()}
    assert sum(r.n for r in density.values()) == len(spots)
    for i, (x, y) in enumerate(spots):
        code, lat, lng = literal_code(y, x, precision)
        cell = density[code]
        digits = lambda err: max(1, math.floor(-math.log10(err) + 0.5)) - 1
        bits = geohash.axis_bits(precision)
        for value, mid, err in ((cell.lat, lat, 90 / 2 ** bits[1]), (cell.lng, lng, 180 / 2 ** bits[0])):
            base = 10.0 ** -digits(err)
            assert value == pytest.approx(mid - math.fmod(mid, base), abs=1e-12)


def test_unify(spark):
    vertices = spark.createDataFrame(
        [(5, 1.0, 1.0), (3, 1.0, 1.0), (9, 1.0, 1.0), (4, 2.0, 1.0)], "vertex_id long, lng double, lat double"
    )
    dup = network.duplicate_vertices(vertices)
    assert rows(dup, "*") == [(3, 3), (5, 3), (9, 3)]
    edges = spark.createDataFrame([(1, 5, 4, 2.5), (2, 9, 5, 1.0), (3, 4, 77, 0.0)], "edge_id long, s_id long, e_id long, length double")
    assert rows(network.unify_edges(edges, dup), "*") == [(1, 3, 4, 2.5), (2, 3, 3, 1.0), (3, 4, 77, 0.0)]


def test_restore_truncates_and_drops_unknown(spark):
    seq = spark.createDataFrame([(1, 0, 1, 50), (1, 1, 2, 60), (1, 2, 99, 70)], "traj_id long, site long, vertex_id long, t long")
    vertices = spark.createDataFrame([(1, 116.39999999, -1.23456789), (2, 0.0, 1.0)], "vertex_id long, lng double, lat double")
    assert rows(network.restore_coordinates(seq, vertices), "traj_id", "site", "x", "y", "t") == [
        (1, 0, int(116.39999999 * 10000000), int(-1.23456789 * 10000000), 50), (1, 1, 0, 10000000, 60),
    ]


def test_what_restoring_drops(spark):
    seq = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 99), (2, 0, 99), (2, 1, 98)], "traj_id long, site long, vertex_id long")
    vertices = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0)], "vertex_id long, lng double, lat double")
    found = Observation("restore")
    got = rows(network.restore_coordinates(seq, vertices, found), "traj_id", "site")
    assert got == [(1, 0), (1, 1)] == rows(network.restore_coordinates(seq, vertices), "traj_id", "site")
    assert found.get == {"kept": 2, "dropped": 3}
    assert rows(network.unknown_vertices(seq, vertices), "vertex_id", "n") == [(98, 1), (99, 2)]


def test_degree_counts_a_loop_twice(spark):
    edges = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "edge_id long, s_id long, e_id long")
    assert rows(network.vertex_degree(edges), "vertex_id", "in_deg", "out_deg") == [(1, 1, 2), (2, 1, 0)]
