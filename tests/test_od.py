from __future__ import annotations

from conftest import rows
from test_paths import literal_order
from tripweave.operators import index, od, paths, transfer

SITES = ["o_id", "d_id", "traj_id", "s_site", "e_site"]


def test_scan_is_the_literal_theta_join(spark, walks):
    want = sorted((o, d, t) for o, d in walks.pairs for t, p in walks.vertices.items() if literal_order(p, o, d))
    assert rows(od.od_by_scan(walks.traj_vertices, walks.od), "*") == want


def test_vertex_index_compares_first_visits(spark, walks):
    got = od.od_by_vertex_index(index.vertex_index(walks.traj_vertices), walks.od)
    want = sorted(
        (o, d, t, p.index(o), p.index(d))
        for o, d in walks.pairs for t, p in walks.vertices.items()
        if o in p and d in p and p.index(o) < p.index(d)
    )
    assert rows(got, *SITES) == want


def literal_located(walks):
    out = []
    for o, d in walks.pairs:
        for t, p in walks.edges.items():
            s = [i for i, e in enumerate(p) if walks.net[e][0] == o]
            e = [i for i, x in enumerate(p) if walks.net[x][1] == d]
            if s and e and s[0] < e[0]:
                out.append((o, d, t, s[0], e[0]))
    return sorted(out)


def test_edge_index_join(spark, walks):
    got = od.od_by_edge_index(index.edge_index(walks.traj_edges), walks.network, walks.od)
    assert rows(got, *SITES) == literal_located(walks)


def test_unordered_contains_ordered(spark, walks):
    postings = index.edge_index(walks.traj_edges)
    loose = set(rows(od.od_unordered(postings, walks.network, walks.od), "o_id", "d_id", "traj_id"))
    want = {
        (o, d, t) for o, d in walks.pairs for t, p in walks.edges.items()
        if any(walks.net[e][0] == o for e in p) and any(walks.net[e][1] == d for e in p)
    }
    assert loose == want
    tight = set(rows(od.od_traj_ids(od.od_by_edge_index(postings, walks.network, walks.od)), "*"))
    assert tight <= loose


def test_one_edge_trip(spark):
    net = spark.createDataFrame([(12, 1, 2)], "edge_id long, s_id long, e_id long")
    trip = spark.createDataFrame([(7, 0, 12)], "traj_id long, site long, edge_id long")
    pair = spark.createDataFrame([(1, 2)], "o_id long, d_id long")
    vertices = paths.vertex_path(trip, net)
    assert rows(od.od_by_edge_index(index.edge_index(trip), net, pair), "traj_id") == []
    assert rows(od.od_by_vertex_index(index.vertex_index(vertices), pair), "traj_id") == [(7,)]
    assert rows(od.od_by_scan(vertices, pair), "traj_id") == [(7,)]


def test_same_origin_and_destination_needs_two_visits(spark):
    seq = spark.createDataFrame(
        [(1, 0, 5), (1, 1, 6), (2, 0, 5), (2, 1, 6), (2, 2, 5)], "traj_id long, site long, vertex_id long"
    )
    pair = spark.createDataFrame([(5, 5), (5, 99)], "o_id long, d_id long")
    assert rows(od.od_by_scan(seq, pair), "*") == [(5, 5, 2)]


def test_many_pairs_at_one_origin(spark, monkeypatch):
    """100,000 pairs at one O, no broadcast: only the pairs a trip has become rows, also where the filter of pairs is full."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pair = spark.range(100_000).selectExpr("1L AS o_id", "id + 2 AS d_id")
        seq = spark.range(200).selectExpr("id AS traj_id", "explode(array(1L, 2 + id * 7, 3 + id * 11, 500000L)) AS vertex_id")
        seq = seq.selectExpr("traj_id", "CASE WHEN vertex_id = 1 THEN 0L ELSE vertex_id END AS site", "vertex_id")
        want = sorted({(1, d, t) for t in range(200) for d in (2 + t * 7, 3 + t * 11)})
        for words in (1, 1 << 20):
            monkeypatch.setattr(od, "FILTER_WORDS", words)
            assert rows(od.od_by_scan(seq, pair), "*") == want
            assert rows(od.od_by_vertex_index(index.vertex_index(seq), pair), "o_id", "d_id", "traj_id") == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_threshold_is_strict(spark):
    counts = spark.createDataFrame([(1, 2, 100), (1, 3, 101)], "o_id long, d_id long, n long")
    assert rows(od.frequent_od(counts), "d_id") == [(3,)]


def test_counts_add_up_and_are_sorted(spark, walks):
    got = [tuple(r) for r in od.by_count(od.od_count(paths.od_endpoints(walks.traj_vertices))).collect()]
    assert sum(n for *_, n in got) == len(walks.vertices)
    assert got == sorted(got, key=lambda r: (-r[2], r[0], r[1]))


def test_lists_are_bounded_and_whole(spark):
    hot = spark.range(10000).selectExpr("1L AS o_id", "2L AS d_id", "id AS traj_id")
    lists = od.od_traj_lists(hot, block_bits=8).collect()
    assert max(len(r.trajs) for r in lists) == 256
    assert sorted(t for r in lists for t in r.trajs) == list(range(10000))


def test_repeats_stay_in_posting_lists(spark, walks):
    got = index.edge_postings(walks.traj_edges, block_bits=3).collect()
    listed = sorted((r.edge_id, t) for r in got for t in r.trajs)
    assert listed == sorted((e, t) for t, p in walks.edges.items() for e in p)
    assert all(r.n == len(r.trajs) and all(t >> 3 == r.block for t in r.trajs) for r in got)


def test_bitmap_counts_each_trip_once(spark, walks):
    got = dict(rows(index.bitmap_sizes(index.vertex_bitmap(walks.traj_vertices)), "vertex_id", "n"))
    assert got == {v: sum(v in p for p in walks.vertices.values()) for v in got}


def test_transfer_matrix_is_the_literal_count(spark, walks):
    got = transfer.transfer_matrix(
        walks.traj_edges, index.edge_index(walks.traj_edges), walks.network, walks.od.select("d_id")
    )
    want: dict = {}
    for d in {d for _, d in walks.pairs}:
        for p in walks.edges.values():
            into = [i for i, e in enumerate(p) if walks.net[e][1] == d]
            for e in p[: into[0] + 1] if into else []:
                want[(d, *walks.net[e], e)] = want.get((d, *walks.net[e], e), 0) + 1
    assert rows(got, "d_id", "s_id", "e_id", "edge_id", "num") == sorted((*k, n) for k, n in want.items())


def test_unknown_destination_is_empty(spark, walks):
    nowhere = spark.createDataFrame([(999,)], "d_id long")
    assert transfer.transfer_matrix(walks.traj_edges, index.edge_index(walks.traj_edges), walks.network, nowhere).count() == 0


def test_bit_sets_hold_the_same_trips(spark, rng):
    """Ids of many buckets, zero and below."""
    trips = rng.sample(range(-70_000, 200_000), 300) + [0, 1, 32768, 32769, -32768, -32767]
    seq = [(t, i, e) for t in trips for i, e in enumerate(rng.sample([102, 203, 301, 103, 201], 3))]
    edges = spark.createDataFrame([(e, e // 100, e % 100) for e in (102, 203, 301, 103, 201)], "edge_id long, s_id long, e_id long")
    traj = spark.createDataFrame(seq, "traj_id long, site long, edge_id long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 2), (3, 1), (9, 1)], "o_id long, d_id long")
    sets = od.od_unordered_sets(index.edge_bitmap(traj), edges, pairs)
    want = rows(od.od_unordered(index.edge_index(traj), edges, pairs), "o_id", "d_id", "traj_id")
    assert want and rows(index.bitmap_ids(sets, "o_id", "d_id"), "o_id", "d_id", "id") == want
