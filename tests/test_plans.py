"""What the plans must not contain, and whole results on skewed data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from workload.queries import QUERIES
from conftest import rows
from tripweave import schemas
from tripweave.operators import anomaly, index, network, od, paths, routes, trie
from tripweave.sinks import tables as stored
from tripweave.session import cut_lineage
from tripweave.sources import tables

SF_DIR = "/root/testdata/sf0.001"
BANNED = ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "InArrow"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not [b for b in BANNED if b in plan]


def nodes(df):
    """(name, rows out) of every node of the plan that ran, adaptive stages unfolded; None where a node counts no rows."""
    df.write.format("noop").mode("overwrite").save()
    frame = df.select("*")
    frame.collect()
    found = []

    def walk(node):
        name = node.nodeName()
        inside = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan"}
        if name.split(" ")[0] in inside:
            return walk(getattr(node, inside[name.split(" ")[0]])())
        metric = node.metrics().get("shuffleRecordsWritten" if name == "Exchange" else "numOutputRows")
        found.append((name, node.toString(), metric.get().value() if metric.isDefined() else None))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    return found


def test_samples_are_drawn_inside_a_row(spark):
    """Pairs x trials rows go into the draw, whatever the pool: no row for each trip of the pool and trial."""
    pool = spark.range(4000).selectExpr("id % 2 AS o_id", "2L AS d_id", "id AS traj_id")
    ran = nodes(anomaly.draw_samples(pool, anomaly.IsolationParams(trials=3, sample=8)))
    written = [n for name, text, n in ran if name == "Exchange" and "trial" in text.split("\n")[0]]
    assert written and max(written) <= 2 * 3 * 8
    made = [n for name, _, n in ran if name == "Generate"]
    assert made and max(made) <= 2 * 3 * 8


def test_a_trip_brings_only_its_own_pairs_to_the_join(spark, no_broadcast):
    """All places of a trip are ends of pairs, but few two of them are a pair: few rows reach the exact join."""
    pair = spark.range(20_000).selectExpr("id AS o_id", "id + 100000 AS d_id")
    seq = spark.range(400).selectExpr("id AS traj_id", "explode(sequence(0L, 39L)) AS site")
    seq = seq.selectExpr("traj_id", "site", "IF(site = 39, traj_id * 7 + 100000, (traj_id * 7 + site * 13) % 20000 + site % 2 * 100000) AS vertex_id")
    combined = 400 * 40 * 39 // 2
    got = od.od_by_scan(seq, pair)
    have = got.count()
    by_pair = [n for name, text, n in nodes(got) if name == "Exchange" and "hashpartitioning(o_id" in text.split("\n")[0]]
    assert have >= 400 and min(by_pair) <= have + 0.01 * combined


def test_trials_run_inside_the_rows_of_routes(spark, walks):
    """No exchange has a row for each pick of a trial."""
    from tripweave.plans import jobs

    p = anomaly.IsolationParams(trials=50, sample=16)
    given = jobs.scoring_input(walks.traj_edges, walks.network, walks.od)
    n = given.routes.count()
    sites = given.routes.select(F.explode(F.array_distinct("edges"))).count()
    edges = given.routes.select("o_id", "d_id", F.explode("edges")).distinct().count()
    got = anomaly.anomaly_scores(given.routes, given.pool, given.postings, p)
    by_route = [n for name, text, n in nodes(got) if name == "Exchange" and "route_id" in text.split("\n")[0].split("hashpartitioning(")[-1].split(")")[0]]
    assert by_route and max(by_route) <= max(n, sites) < n * p.trials
    drawn = given.pool.groupBy("o_id", "d_id").agg(F.least(F.count("*"), F.lit(16)).alias("n")).agg(F.sum("n")).first()[0] * p.trials
    assert max(n or 0 for name, _, n in nodes(got) if name == "Exchange") <= (drawn * 9 + edges * p.trials)


@pytest.fixture
def no_broadcast(spark):
    """Shuffle joins and tiny split sizes, as on large data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    frame = df.select("*")
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def hot_trips(spark, n=6000):
    """A third of all trips take one edge, the others spread over many."""
    net = spark.range(400).selectExpr("id AS edge_id", "id AS s_id", "id + 1000 AS e_id")
    trips = spark.range(n).select(
        F.col("id").alias("traj_id"), F.lit(0).cast("long").alias("site"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 400).cast("long").alias("edge_id"),
    )
    return trips.repartition(8), net


def test_hot_edge_is_split_in_the_network_join(spark, no_broadcast):
    trips, net = hot_trips(spark)
    got = paths.vertex_path(trips, net)
    assert got.count() == 12000
    joined = trips.join(net.select("edge_id", "s_id"), "edge_id")
    assert "skewed=true" in final_plan(joined) or "skew=true" in final_plan(joined)


def test_hot_keys_keep_every_row(spark, no_broadcast):
    trips, net = hot_trips(spark)
    postings = index.edge_index(trips)
    assert postings.count() == 6000
    hot = postings.where("key_id = 7").count()
    blocks = index.edge_postings(trips, block_bits=8)
    assert blocks.where("edge_id = 7").agg(F.sum("n")).first()[0] == hot
    assert blocks.agg(F.max(F.size("trajs"))).first()[0] <= 256
    vertices = paths.vertex_path(trips, net)
    pair = spark.createDataFrame([(7, 1007)], "o_id long, d_id long")
    assert od.od_by_scan(vertices, pair).count() == hot


def test_a_place_with_a_third_of_all_vertices(spark, no_broadcast):
    vertices = spark.range(3000).selectExpr(
        "id AS vertex_id", "IF(id % 3 = 0, 116.3D, 116.3D + id * 0.001D) AS lng", "39.9D AS lat"
    )
    duplicates = network.duplicate_vertices(vertices)
    assert duplicates.agg(F.count("*"), F.max("canonical_id")).first() == (1000, 0)


def test_hot_route_expansion_keeps_every_row(spark, no_broadcast):
    """Every other pair's route runs over one popular edge."""
    data = [(1, 2, 0, [12], [1, 2], [2], 1)]
    data += [(1000 + i, 2000 + i, 1 + i, [5000 + i, 12, 6000 + i], [1000 + i, 1, 2, 2000 + i], [1, 2, 2000 + i], 1) for i in range(3000)]
    merged = spark.createDataFrame(
        data, "o_id long, d_id long, route_id long, edges array<long>, vertices array<long>, ends array<long>, freq long"
    )
    got = routes.route_expansions(merged)
    assert got.where("o_id = 1 AND d_id = 2 AND NOT created").count() == 3000 == got.count()


def test_scores_with_shuffle_joins(spark, no_broadcast, walks):
    from tripweave.plans import jobs

    p = anomaly.IsolationParams(trials=2, sample=16)
    given = jobs.scoring_input(walks.traj_edges, walks.network, walks.od)
    columns = ["o_id", "d_id", "route_id", "trial", "cnt"]
    split = rows(anomaly.isolation_counts(given.routes, given.pool, given.postings, p), *columns)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    assert rows(anomaly.isolation_counts(given.routes, given.pool, given.postings, p), *columns) == split


def exchanges(df):
    return [text.split("\n")[0] for name, text, _ in nodes(df) if name == "Exchange"]


def test_bucketed_tables_are_not_exchanged(spark, no_broadcast, walks, tmp_path):
    """A join on the bucketed column moves the other side only, a grouping nothing, a lookup reads one bucket."""
    postings = index.vertex_index(walks.traj_vertices)
    stored.write_bucketed(walks.traj_edges, "trips_by_id", f"{tmp_path}/trips", "traj_id", 8, ["site"])
    stored.write_bucketed(postings, "postings_by_key", f"{tmp_path}/postings", "key_id", 8)
    for name in ("trips_by_id", "postings_by_key"):
        spark.sql(f"DROP TABLE {name}")
    trips = tables.open_bucketed(spark, "trips_again", f"{tmp_path}/trips", schemas.TRAJ_EDGES, "traj_id", 8, ["site"])
    keys = tables.open_bucketed(spark, "postings_again", f"{tmp_path}/postings", schemas.POSTINGS, "key_id", 8)
    ids = spark.range(5, 25).selectExpr("id AS traj_id")
    got = paths.restrict_trips(trips, ids)
    assert rows(got, "*") == rows(walks.traj_edges.where("traj_id BETWEEN 5 AND 24"), "*")
    moved = exchanges(got)
    assert len(moved) == 1 and "site" not in moved[0]
    assert exchanges(paths.pack(trips, "edge_id")) == []
    wanted = spark.createDataFrame([(2,), (4,)], "key_id long")
    assert rows(index.lookup_postings(keys, wanted), "*") == rows(postings.where("key_id IN (2, 4)"), "*")
    assert len(exchanges(index.lookup_postings(keys, wanted))) == 1
    one = index.postings_of(keys, 3)
    in_bucket = postings.where("pmod(hash(key_id), 8) = pmod(hash(3L), 8)").count()
    assert [n for name, _, n in nodes(one) if name.startswith("Scan parquet")] == [in_bucket] and in_bucket < postings.count()
    assert rows(one, "*") == rows(postings.where("key_id = 3"), "*")
    for name in ("trips_again", "postings_again"):
        spark.sql(f"DROP TABLE {name}")


def test_tree_has_no_window_and_one_exchange(spark, walks):
    merged = spark.createDataFrame(
        [(1, 2, 0, [1, 5, 2], 3), (1, 3, 1, [1, 5, 3], 1)], "o_id long, d_id long, route_id long, vertices array<long>, freq long"
    )
    ran = nodes(trie.trie_nodes(merged))
    assert not [name for name, *_ in ran if name == "Window"] and len([n for n, *_ in ran if n == "Exchange"]) == 1


def test_pairs_on_bit_sets_list_no_ids(spark, walks):
    text = od.od_unordered_sets(index.edge_bitmap(walks.traj_edges), walks.network, walks.od)._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in text


def test_route_expansion_joins_on_names(spark, no_broadcast, walks):
    """Runs meet own routes by 16 bytes: no list is a key of a join, and candidates carry their part once."""
    merged = cut_lineage(routes.merge_routes(routes.trip_routes(walks.traj_edges, walks.network)))
    ran = nodes(routes.route_expansions(merged))
    joins = [text.split("\n")[0] for name, text, _ in ran if name.endswith("Join")]
    assert any("hi#" in j and "lo#" in j for j in joins)
    assert not any(c in j for j in joins for c in ("run#", "edges#", "part#"))


def test_spans_stream_past_their_trips_unsorted(spark, no_broadcast):
    """Many spans of a trip meet its path without a sort of the spans."""
    packed = spark.range(40).selectExpr("id AS traj_id", "sequence(id, id + 30) AS path")
    spans = packed.selectExpr("traj_id", "explode(sequence(0L, 19L)) AS s_site").selectExpr("7L AS o_id", "s_site AS d_id", "traj_id", "s_site", "s_site + 2 AS e_site")
    got = paths.slice_by_site(packed, spans)
    assert rows(got, "traj_id", "d_id", "path") == [(t, s, (t + s, t + s + 1, t + s + 2)) for t in range(40) for s in range(20)]
    joins = [text.split("\n")[0] for name, text, _ in nodes(got) if "Join" in name]
    assert joins and all("ShuffledHashJoin" in j and "BuildRight" in j for j in joins)


def test_counted_routes_move_names_and_not_paths(spark, walks):
    from tripweave.plans import jobs

    whole = jobs.pair_vertex_routes(walks.traj_vertices, walks.od)
    named = jobs.pair_vertex_routes(walks.traj_vertices, walks.od, named=True)
    key = ["o_id", "d_id", "route_id", "freq"]
    assert rows(whole, *key) == rows(named, *key) and len(rows(named, *key)) > 100
    counted = routes.od_trips(named)
    assert rows(counted, "*") == rows(routes.od_trips(whole), "*")
    moved = [text.split("\n")[0] for name, text, _ in nodes(counted) if name == "Exchange"]
    assert moved and not [m for m in moved if "vertices" in m]


def test_a_listed_trip_is_sorted_once(spark, no_broadcast):
    """A trip listed for many pairs: its id goes once from a task to the join."""
    trips = spark.range(200).selectExpr("id % 100 AS traj_id", "id DIV 100 AS site", "id AS edge_id")
    ids = spark.range(20_000).selectExpr("id % 50 AS traj_id", "id AS d_id")
    got = paths.restrict_trips(trips, ids)
    assert rows(got, "edge_id") == [(e,) for e in range(200) if e % 100 < 50]
    moved = [n for name, _, n in nodes(got) if name == "Exchange"]
    assert moved and max(moved) <= 50 * ids.rdd.getNumPartitions()


def test_matching_of_pairs_is_not_merged_by_bytes(spark, walks):
    """Few bytes of a trip become many rows of pairs: the step keeps all partitions, also where its input is small."""
    postings = index.edge_index(walks.traj_edges)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert n > 1
    assert od.od_unordered(postings, walks.network, walks.od).rdd.getNumPartitions() == n
    assert od.od_by_scan(walks.traj_vertices, walks.od).rdd.getNumPartitions() == n
