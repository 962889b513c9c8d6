from __future__ import annotations

from pyspark.sql import functions as F

from conftest import rows
from tripweave.functions import paths as fp
from tripweave.operators import paths


def long_form(spark, trips, id_col="vertex_id"):
    data = [(t, i, x) for t, p in trips.items() for i, x in enumerate(p)]
    return spark.createDataFrame(data, f"traj_id long, site long, {id_col} long")


def test_collapse_repeats(spark):
    seq = long_form(spark, {1: [1, 1, 2, 2, 1], 2: [3, 3, 3], 3: [4]})
    assert rows(paths.collapse_repeats(seq), "traj_id", "site", "vertex_id") == [
        (1, 0, 1), (1, 1, 2), (1, 2, 1), (2, 0, 3), (3, 0, 4),
    ]


def test_collapse_column(spark):
    df = spark.createDataFrame([([0, 0, 5, 5, 0, 6],), ([],)], "a array<long>")
    plain, after_zero = fp.collapse(F.col("a")), fp.collapse(F.col("a"), before=F.lit(0))
    got = df.select(plain.alias("p"), after_zero.alias("z")).collect()
    assert [list(r.p) for r in got] == [[0, 5, 0, 6], []]
    assert [list(r.z) for r in got] == [[5, 0, 6], []]


def test_length_rules_are_strict(spark):
    packed = paths.pack(long_form(spark, {10: list(range(10)), 11: list(range(11))}), "vertex_id")
    assert rows(paths.longer_than(packed, "path", 10), "traj_id") == [(11,)]
    assert rows(paths.shorter_than(packed, "path", 11), "traj_id") == [(10,)]


def test_pack_and_unpack(spark, walks):
    packed = paths.pack(walks.traj_edges, "edge_id")
    assert {t: list(p) for t, p in rows(packed, "traj_id", "path")} == walks.edges
    assert rows(paths.unpack(packed, "path", "edge_id"), "*") == rows(walks.traj_edges, "*")


def test_vertex_path_keeps_gaps(spark, walks):
    got = rows(paths.vertex_path(walks.traj_edges, walks.network), "traj_id", "site", "vertex_id")
    assert got == sorted((t, i, v) for t, p in walks.vertices.items() for i, v in enumerate(p))


def test_length_histogram_counts_rarest_first(spark, walks):
    got = [tuple(r) for r in paths.path_length_histogram(walks.traj_edges).collect()]
    assert got == sorted(got, key=lambda r: (r[1], r[0])) and sum(n for _, n in got) == len(walks.edges)


def literal_sub(path, net, o, d):
    out, found = [], False
    for e in path:
        if not found and net[e][0] == o:
            found = True
        if found:
            out.append(e)
            if net[e][1] == d:
                break
    return out


def test_sub_trajectory_is_the_literal_scan(spark, walks):
    all_od = walks.od.crossJoin(spark.createDataFrame([(t,) for t in walks.edges], "traj_id long"))
    got = paths.sub_trajectory(paths.packed_trips(walks.traj_edges, walks.network), all_od)
    want = sorted(
        (o, d, t, tuple(literal_sub(p, walks.net, o, d))) for (o, d) in walks.pairs for t, p in walks.edges.items()
    )
    assert rows(got, "o_id", "d_id", "traj_id", "edges") == want


def literal_order(vertices, o, d):
    seen = False
    for v in vertices:
        if seen and v == d:
            return True
        seen = seen or v == o
    return False


def literal_contains(edges, sub):
    if not sub or sub[0] not in edges:
        return False
    at = edges.index(sub[0])
    return edges[at:at + len(sub)] == sub


def test_array_predicates(spark, rng):
    data = []
    for _ in range(400):
        path = [rng.randint(1, 4) for _ in range(rng.randint(1, 8))]
        sub = [rng.randint(1, 4) for _ in range(rng.randint(0, 3))]
        data.append((path, sub, rng.randint(1, 5), rng.randint(1, 5)))
    df = spark.createDataFrame(data, "p array<long>, s array<long>, o long, d long")
    got = df.select(
        "*",
        fp.visits_in_order(F.col("p"), F.col("o"), F.col("d")).alias("ordered"),
        fp.contains_sub_route(F.col("p"), F.col("s")).alias("sub"),
    ).collect()
    for r in got:
        assert r.ordered == literal_order(r.p, r.o, r.d), r
        assert r.sub == literal_contains(r.p, r.s), r


def test_sub_route_only_at_first_occurrence(spark):
    df = spark.createDataFrame([([1, 2, 1, 3], [1, 3])], "p array<long>, s array<long>")
    assert df.select(fp.contains_sub_route(F.col("p"), F.col("s"))).first()[0] is False


def test_edge_count_prefers_vertices(spark):
    df = spark.createDataFrame([([1, 2], [1, 2, 3, 4]), ([1, 2], None)], "e array<long>, v array<long>")
    assert [r[0] for r in df.select(fp.edge_count(F.col("e"), F.col("v"))).collect()] == [3, 2]


def test_suffix_min(spark):
    trips = long_form(spark, {1: [1, 2, 3, 9], 2: [9]}, "edge_id")
    dist = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 4.0)], "edge_id long, dist double")
    assert rows(paths.suffix_min(trips, dist), "traj_id", "site", "dist") == [
        (1, 0, 1.0), (1, 1, 1.0), (1, 2, 4.0), (1, 3, 900000000.0), (2, 0, 900000000.0),
    ]
    assert rows(paths.overall_min(trips, dist), "traj_id", "dist") == [(1, 1.0), (2, 900000000.0)]


def test_a_trip_with_an_unknown_edge_is_left_out_whole(spark):
    trips = spark.createDataFrame([(1, 0, 12), (1, 1, 23), (1, 2, 34), (2, 0, 12)], "traj_id long, site long, edge_id long")
    network = spark.createDataFrame([(12, 1, 2), (34, 3, 4)], "edge_id long, s_id long, e_id long")
    assert sorted(map(tuple, paths.vertex_path(trips, network).select("traj_id", "site", "vertex_id").collect())) == [(2, 0, 1), (2, 1, 2)]
    assert [r.traj_id for r in paths.packed_trips(trips, network).collect()] == [2]
    assert [tuple(r) for r in paths.rejected_trips(trips, network).collect()] == [(1, 23)]
