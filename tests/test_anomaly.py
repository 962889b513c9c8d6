from __future__ import annotations

import hashlib
import math

import pytest

from conftest import Walks, rows
from tripweave.operators import anomaly, index, od, paths
from tripweave.plans import jobs

OD = "o_id long, d_id long"


def h60(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def literal_count(route, o, d, trial, sample, trips, p):
    """The trial as a loop: pick, intersect, count, until few are left."""
    key = hashlib.md5(",".join(map(str, route)).encode()).hexdigest()
    left, count = set(sample), 0
    while True:
        count += 1
        edge = route[h60(p.seed, "p", o, d, key, trial, count) % len(route)]
        left = {t for t in left if edge in trips[t]}
        if count == p.max_steps or len(left) <= p.end_size:
            return count


def literal_sample(pool, o, d, trial, p):
    numbered = [t for _, t in sorted((h60(p.seed, "n", t) % 4096, t) for t in pool)]
    taken = set()
    for j in range(max(len(pool) - p.sample, 0), len(pool)):
        t = h60(p.seed, "s", o, d, trial, j) % (j + 1)
        taken.add(j if t in taken else t)
    return [numbered[i] for i in taken]


@pytest.mark.parametrize(
    "params",
    [
        anomaly.IsolationParams(trials=4, sample=20, max_steps=12, end_size=3, seed=1),
        anomaly.IsolationParams(trials=3, sample=130, max_steps=60, end_size=3, seed=2),
        anomaly.IsolationParams(trials=2, sample=5, max_steps=1, end_size=1, seed=3),
    ],
)
def test_counts_are_the_literal_loop(spark, rng, params):
    walks = Walks(spark, rng, trips=300, vertices=4, longest=10, gap=0.0)
    pairs = spark.createDataFrame([(1, 2), (3, 4), (2, 2)], OD)
    given = jobs.scoring_input(walks.traj_edges, walks.network, pairs)
    pool = {}
    for o, d, t in rows(given.pool, "o_id", "d_id", "traj_id"):
        pool.setdefault((o, d), []).append(t)
    got = {
        (o, d, r, t): c
        for o, d, r, t, c in rows(
            anomaly.isolation_counts(given.routes, given.pool, given.postings, params),
            "o_id", "d_id", "route_id", "trial", "cnt",
        )
    }
    want = {}
    for o, d, r, edges in rows(given.routes, "o_id", "d_id", "route_id", "edges"):
        for trial in range(params.trials):
            sample = literal_sample(pool[(o, d)], o, d, trial, params)
            want[(o, d, r, trial)] = literal_count(edges, o, d, trial, sample, walks.edges, params)
    assert got == want
    samples = anomaly.draw_samples(given.pool, params)
    assert rows(samples, "o_id", "d_id", "trial", "traj_id") == sorted(
        (*k, trial, t) for k, ids in pool.items() for trial in range(params.trials) for t in literal_sample(ids, *k, trial, params)
    )


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_demo_isolates_at_once_for_every_seed(spark, seed):
    trips = {1: [1, 2, 3], 2: [8, 2, 3], 3: [1, 2, 7], 4: [4, 5, 6]}
    postings = spark.createDataFrame(
        [(e, t, i) for t, p in trips.items() for i, e in enumerate(p)], "key_id long, traj_id long, site long"
    )
    pool = spark.createDataFrame([(1, 9, t) for t in trips], f"{OD}, traj_id long")
    route = spark.createDataFrame([(1, 9, 1, [1, 2, 3], 1)], f"{OD}, route_id long, edges array<long>, freq long")
    p = anomaly.IsolationParams(trials=1, sample=256, seed=seed)
    score = anomaly.anomaly_scores(route, pool, postings, p).first().score
    c = 2 * (math.log(3) + 0.57721566) - 2 * 3 / 4
    assert c == pytest.approx(1.8516559) and score == pytest.approx(2 ** (-1 / c)) == pytest.approx(0.6877, abs=1e-4)


def test_expected_depth(spark):
    df = spark.createDataFrame([(1,), (256,)], "n long")
    got = [r[0] for r in df.select(anomaly.expected_depth(df.n)).collect()]
    assert got[0] is None and got[1] == pytest.approx(10.2447709)


def test_pool_of_three_counts_one_and_scores_stay_in_range(spark, walks):
    scored = jobs.score_pairs(walks.traj_edges, walks.network, walks.od, anomaly.IsolationParams(trials=3, sample=16))
    assert all(r.score is None or 0 < r.score < 1 for r in scored.collect())


def test_cap_drops_routes_but_not_their_trips(spark):
    trips = {t: [100 + i for i in range(9)] for t in range(5)}
    trips[9] = [100, 101, 108]
    net = {100 + i: (i, i + 1) for i in range(9)}
    seq = spark.createDataFrame([(t, i, e) for t, p in trips.items() for i, e in enumerate(p)], "traj_id long, site long, edge_id long")
    edges = spark.createDataFrame([(e, *v) for e, v in net.items()], "edge_id long, s_id long, e_id long")
    given = jobs.scoring_input(seq, edges, spark.createDataFrame([(0, 9)], OD), cap=9)
    assert rows(given.routes, "edges", "freq") == [((100, 101, 108), 1)]
    assert given.pool.count() == 6
