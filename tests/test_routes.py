from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import Walks, rows
from test_paths import literal_contains, literal_order, literal_sub
from tripweave.functions import fingerprints
from tripweave.operators import od, paths, routes, scan, trie


def literal_routes(walks):
    merged: dict = {}
    for t, p in walks.edges.items():
        v = walks.vertices[t]
        key = (v[0], v[-1], tuple(p))
        n, low = merged.get(key, (0, t))
        merged[key] = (n + 1, min(low, t))
    return merged


@pytest.fixture
def short_walks(spark, rng):
    return Walks(spark, rng, trips=150, vertices=4, longest=5)


def merged_of(walks):
    return routes.merge_routes(routes.trip_routes(walks.traj_edges, walks.network))


def test_merge(spark, short_walks):
    got = rows(merged_of(short_walks), "o_id", "d_id", "edges", "freq", "route_id")
    assert got == sorted((*k, n, low) for k, (n, low) in literal_routes(short_walks).items())
    assert sum(r[3] for r in got) == len(short_walks.edges)


def test_merge_keeps_vertices_of_gapped_trips(spark, short_walks):
    by_id = {r.route_id: list(r.vertices) for r in merged_of(short_walks).collect()}
    assert by_id == {t: short_walks.vertices[t] for t in by_id}


def test_routes_between(spark, walks):
    through = od.od_by_scan(walks.traj_vertices, walks.od)
    want = Counter(
        (o, d, tuple(literal_sub(p, walks.net, o, d)))
        for o, d in walks.pairs for t, p in walks.edges.items() if literal_order(walks.vertices[t], o, d)
    )
    found = routes.routes_between(walks.traj_edges, walks.network, through)
    assert rows(found, "o_id", "d_id", "edges", "freq") == sorted((*k, n) for k, n in want.items())
    counted = rows(routes.od_routes(found), "o_id", "d_id", "n_routes")
    per_pair = Counter((o, d) for o, d, _ in want)
    assert all(per_pair[(o, d)] == n for o, d, n in counted) and len(counted) == len(want)


def literal_expansions(walks):
    merged = literal_routes(walks)
    groups: dict = {}
    for (o, d, e), (n, low) in merged.items():
        groups.setdefault((o, d), []).append((len(e), e, n))
    out = []
    for (o, d), own in groups.items():
        for (fo, fd, fe), (_, fid) in merged.items():
            fv = walks.vertices[fid]
            if (fo, fd) == (o, d) or not literal_order(fv, o, d):
                continue
            hits = sorted(r for r in own if literal_contains(list(fe), list(r[1])))
            if hits:
                out.append((o, d, hits[0][1], hits[0][2], False, fo, fd, fid))
            else:
                i = fv.index(o)
                out.append((o, d, fe[i:fv.index(d, i + 1)], 0, True, fo, fd, fid))
    return sorted(out)


@pytest.mark.parametrize("gap", [0.0, 0.3])
def test_expansion_is_the_literal_scan(spark, rng, gap):
    walks = Walks(spark, rng, trips=150, vertices=4, longest=6, gap=gap)
    merged = merged_of(walks)
    got = routes.route_expansions(merged)
    want = literal_expansions(walks)
    assert rows(got, "o_id", "d_id", "edges", "freq", "created", "x_o_id", "x_d_id", "x_route_id") == want
    assert any(w[4] for w in want) and not all(w[4] for w in want)
    created = {(o, d, e) for o, d, e, _, c, *_ in want if c}
    per_pair = Counter((o, d) for o, d, _ in created | set(literal_routes(walks)))
    counts = routes.route_counts(routes.expanded_routes(merged, got))
    assert rows(counts, "o_id", "d_id", "n_routes") == sorted((*k, n) for k, n in per_pair.items())


def test_routes_of_different_pairs_may_share_an_id(spark, rng):
    """Route_id names one path of its pair, as routes cut out of one trip show."""
    walks = Walks(spark, rng, trips=80, vertices=4, longest=6)
    numbered, wants = [], {}
    seen: Counter = Counter()
    for (o, d, e), (n, low) in sorted(literal_routes(walks).items()):
        numbered.append((o, d, seen[o, d], list(e), walks.vertices[low], [walks.net[x][1] for x in e], n))
        wants[low] = seen[o, d]
        seen[o, d] += 1
    given = spark.createDataFrame(
        numbered, "o_id long, d_id long, route_id long, edges array<long>, vertices array<long>, ends array<long>, freq long"
    )
    want = sorted((*w[:7], wants[w[7]]) for w in literal_expansions(walks))
    got = rows(routes.route_expansions(given), "o_id", "d_id", "edges", "freq", "created", "x_o_id", "x_d_id", "x_route_id")
    assert got == want and max(Counter(r[2] for r in numbered).values()) > 1


def test_fingerprints_name_runs(spark):
    """Every run of every path against a literal polynomial: equal names for equal runs and for no others."""
    r = random.Random(5)
    given = [[r.choice([1, 2, 3, -7, 1 << 62]) for _ in range(n)] for n in (0, 1, 2, 7, 30, 30)] + [[4] * 12]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(given)], "id long, path array<long>")
    hi, lo = fingerprints.prefixes(F.col("path"))
    ends = df.select("id", "path", hi.alias("hi"), lo.alias("lo"), F.explode(F.sequence(F.lit(0), F.size("path"))).alias("p"))
    runs = ends.select("*", F.explode(F.sequence(F.lit(0), F.size("path") - F.col("p"))).alias("k"))
    up = fingerprints.powers(F.col("k"))
    whole = fingerprints.whole(F.slice("path", F.col("p") + 1, F.col("k")))
    got = runs.select(
        "id", "p", "k", *(fingerprints.run(F.get(c, F.col("p")), F.get(c, F.col("p") + F.col("k")), u).alias(f"r_{c}") for c, u in zip(("hi", "lo"), up)),
        *(w.alias(f"w_{c}") for c, w in zip(("hi", "lo"), whole)),
    ).collect()
    assert len(got) == sum((len(p) + 1) * (len(p) + 2) // 2 for p in given)
    assert all((g.r_hi, g.r_lo) == (g.w_hi, g.w_lo) for g in got)
    names = {}
    for g in got:
        names.setdefault(tuple(given[g.id][g.p : g.p + g.k]), set()).add((g.r_hi, g.r_lo))
    assert all(len(v) == 1 for v in names.values())
    assert len(set().union(*names.values())) == len(names)
    hashes = {x.x: x.h for x in spark.createDataFrame([(x,) for p in given for x in p], "x long").selectExpr("x", "xxhash64(x, 1) AS h").collect()}
    a, b = fingerprints.BASES[1]
    for run, ((_, low),) in names.items():
        high_half = low_half = 0
        for x in run:
            h = hashes[x] % (1 << 64)
            high_half = (high_half * a + h % (1 << 31)) % fingerprints.PRIME
            low_half = (low_half * b + (h >> 31) % (1 << 31)) % fingerprints.PRIME
        assert low == (high_half << 31) + low_half


def test_renumbering_has_no_gaps_and_no_repeats(spark, walks):
    merged = merged_of(walks)
    numbered = routes.renumber_routes(merged)
    n = merged.count()
    assert [r[0] for r in rows(numbered, "route_id")] == list(range(n))
    assert rows(numbered, "o_id", "d_id", "edges", "freq") == rows(merged, "o_id", "d_id", "edges", "freq")


def test_adding_routes(spark, walks):
    trips = routes.trip_routes(walks.traj_edges, walks.network)
    old = routes.merge_routes(trips.where("route_id <= 25"))
    new = routes.merge_routes(trips.where("route_id > 25"))
    columns = ["o_id", "d_id", "edges", "route_id", "freq"]
    assert rows(routes.add_routes(old, new), *columns) == rows(routes.merge_routes(trips), *columns)


DEMO = [
    ([1, 2, 3, 4, 5], 2), ([1, 2, 3, 5], 4), ([1, 2, 3, 2, 1, 5], 1), ([1, 2, 3, 222, 5], 1),
    ([1, 2, 3, 222, 4], 2), ([1, 2, 3, 4], 1), ([1, 2, 4, 3], 1), ([1, 3, 5, 4], 1),
]


@pytest.fixture
def demo(spark):
    data = [(p[0], p[-1], i, p, n) for i, (p, n) in enumerate(DEMO)]
    return spark.createDataFrame(data, "o_id long, d_id long, route_id long, vertices array<long>, freq long")


def literal_nodes(paths_with_freq):
    ends, passes = Counter(), Counter()
    for p, n in paths_with_freq:
        for k in range(1, len(p) + 1):
            passes[tuple(p[:k])] += n
        ends[tuple(p)] += n
    return ends, passes


def test_trie_demo(spark, demo):
    nodes = trie.trie_nodes(demo)
    ends, passes = literal_nodes([(p[1:], n) for p, n in DEMO])
    assert nodes.count() == 16 == len(passes)
    got = Counter((r.depth, r.element, r.end_freq, r.pass_freq) for r in nodes.collect())
    assert got == Counter((len(k), k[-1], ends[k], n) for k, n in passes.items())
    leaves = trie.trie_leaves(nodes).groupBy("element").agg(F.count("*").alias("n"), F.sum("end_freq").alias("f"))
    assert rows(leaves, "element", "n", "f") == [(3, 1, 1), (4, 3, 4), (5, 4, 8)]
    inner_end = [r for r in trie.trie_leaves(nodes).collect() if (r.depth, r.element, r.end_freq) == (3, 4, 1) and r.pass_freq > 1]
    assert len(inner_end) == 1
    kids = trie.trie_children(nodes).collect()
    assert sum(r.n_children for r in kids) == 16
    assert {(r.node_hi, r.node_lo) for r in kids} <= {(r.node_hi, r.node_lo) for r in nodes.collect()} | {(0, 0)}


def test_trie_of_one_very_long_route(spark):
    long_path = [[1] + [i % 7 for i in range(20000)]]
    df = spark.createDataFrame([(1, 1, 1, p, 3) for p in long_path], "o_id long, d_id long, route_id long, vertices array<long>, freq long")
    nodes = trie.trie_nodes(df)
    total = nodes.agg(F.count("*"), F.countDistinct("node_hi", "node_lo"), F.sum("end_freq"), F.sum("pass_freq")).first()
    assert tuple(total) == (20000, 20000, 3, 60000)


def test_destination_routes(spark, demo):
    to_4 = spark.createDataFrame([(1, 4)], "o_id long, d_id long")
    assert rows(routes.routes_to_destination(demo, to_4), "vertices", "freq") == [
        ((1, 2, 3, 4), 1), ((1, 2, 3, 222, 4), 2), ((1, 3, 5, 4), 1),
    ]
    assert dict((d, n) for _, d, n in rows(routes.od_trips(demo), "o_id", "d_id", "n")) == {5: 8, 4: 4, 3: 1}


def test_long_trips_are_scanned_in_ranges(spark):
    """One trip with half of all rows, ranges of every size, gaps between sites."""
    r = random.Random(3)
    trips = {1: [r.choice([5, 5, 5, 6, 7]) for _ in range(400)], 2: [5] * 50, 3: [6], 4: [5, 6] * 40, 5: [r.choice([6, 7]) for _ in range(200)]}
    seq = spark.createDataFrame([(t, 3 * i, v) for t, p in trips.items() for i, v in enumerate(p)], "traj_id long, site long, vertex_id long")
    want = sorted((t, i, v) for t, p in trips.items() for i, (v, _) in enumerate(itertools.groupby(p)))
    dist = spark.createDataFrame([(5, 3.0), (6, None), (7, 1.0)], "edge_id long, dist double")
    net = spark.createDataFrame([(5, 1, 2), (6, 2, 3), (7, 3, 1)], "edge_id long, s_id long, e_id long")
    along = seq.withColumnRenamed("vertex_id", "edge_id")
    mins = rows(paths.suffix_min(along, dist), "traj_id", "site", "edge_id", "dist")
    for segment in (1, 7, 64, 1 << 16):
        assert rows(scan.collapse_repeats(seq, segment=segment), "traj_id", "site", "vertex_id") == want
        assert rows(scan.suffix_min(along, dist, segment), "traj_id", "site", "edge_id", "dist") == mins
    assert rows(scan.vertex_path(along, net), "*") == rows(paths.vertex_path(along, net), "*")
    assert rows(scan.vertex_path(along, net.where("edge_id < 7")), "*") == rows(paths.vertex_path(along, net.where("edge_id < 7")), "*")


def test_vertices_of_routes(spark):
    net = spark.createDataFrame([(12, 1, 2), (23, 2, 3)], "edge_id long, s_id long, e_id long")
    given = spark.createDataFrame([(1, 3, 7, [12, 23], 2.0), (1, 9, 8, [12, 29], 1.0), (4, 4, 9, [], 0.0)], "o_id long, d_id long, route_id long, edges array<long>, score double")
    got = rows(routes.add_vertices(given, net), "route_id", "score", "vertices", "ends")
    assert got == [(7, 2.0, (1, 2, 3), (2, 3)), (8, 1.0, None, None), (9, 0.0, (), ())]


def test_names_tell_paths_apart_as_the_paths_do(spark):
    """NULL elements, empty paths and NULL paths too."""
    paths = [[1, 2], [1, 2], [2, 1], [1], [1, None], [None, 1], [None], [], [], None, None, [1, None]]
    df = spark.createDataFrame([(5, 6, i, p, 1) for i, p in enumerate(paths)], "o_id long, d_id long, route_id long, vertices array<long>, freq long")
    key = ["o_id", "d_id", "route_id", "freq"]
    assert rows(routes.merge_routes(df, named=True), *key) == rows(routes.merge_routes(df), *key)
    assert len(rows(routes.merge_routes(df, named=True), *key)) == 8
