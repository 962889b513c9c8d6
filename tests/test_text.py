from __future__ import annotations

import pytest
from pyspark.sql import Observation

from conftest import rows
from tripweave.operators import index, network, od, paths, routes, transfer, trie
from tripweave.sinks import tables, text as out
from tripweave.sources import tables as stored, text as src


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def samples(*edges):
    return ",".join(f"x|{e}|y" for e in edges)


def test_edge_lines(spark):
    eleven = list(range(1, 12))
    df = lines(
        spark,
        f"1,{samples(*eleven)}",                      # 11 edges
        f"2,{samples(*eleven[:10])}",                 # 11 fields, but 10 edges
        f"3,{samples(*eleven)},,,",                   # empty fields at the end
        f"4,{samples(0, 0, *eleven)}",                # edge 0 in front vanishes
        f"5,{samples(1, 1, *eleven, 5, 5)}",          # repeats collapse
        f"6,{samples(*range(9))}",                    # too few samples
        f"7,{samples(*eleven)},x",                    # no edge field
        f"a,{samples(*eleven)}",
    )
    assert rows(src.parse_edge_trajectories(df), "traj_id", "edges") == [
        (1, tuple(eleven)), (3, tuple(eleven)), (4, tuple(eleven)), (5, (*eleven, 5)),
    ]
    assert len(rows(src.parse_edge_trajectories(df, rejected=True), "value")) == 2
    assert rows(src.parse_edge_trajectories(df, min_samples=5, min_edges=5), "traj_id") == [(i,) for i in range(1, 7)]


def test_timed_lines_trust_the_declared_count(spark):
    df = lines(spark, "1,11,5,100,6,110", "2,10,5,100", "3,12,7,1,8", "4,x,1,2", "5,11,1,2,q,3", "6")
    got = src.parse_timed_trajectories(df)
    assert {tuple(r) for r in got.collect()} == {(1, 0, 5, 100), (1, 1, 6, 110), (3, 0, 7, 1), (3, 1, 8, None)}
    assert rows(src.parse_timed_trajectories(df, rejected=True), "value") == [("4,x,1,2",), ("5,11,1,2,q,3",), ("6",)]


def test_vertex_lines(spark):
    df = lines(spark, "1,11,5,6,7", "2,10,5,6", "3,11,5,6,,", "4,11,5,?")
    assert rows(src.parse_vertex_trajectories(df), "*") == [(1, (5, 6, 7)), (3, (5, 6))]
    assert rows(src.parse_vertex_trajectories(df, min_count=9), "traj_id") == [(1,), (2,), (3,)]
    assert rows(src.parse_od_endpoints(df), "*") == [(1, 5, 7), (2, 5, 6), (3, 5, 6)]
    assert rows(src.parse_od_endpoints(df, rejected=True), "value") == [("4,11,5,?",)]


def test_network_lines(spark):
    df = lines(spark, "1\t116.5\t39.5", "2\tx\t39.5", "3\t116.5")
    assert rows(src.parse_vertices(df), "*") == [(1, 116.5, 39.5)]
    assert rows(src.parse_vertices(df, lat_first=True), "*") == [(1, 39.5, 116.5)]
    assert len(rows(src.parse_vertices(df, rejected=True), "value")) == 2
    df = lines(spark, "1\t2\t3\t4.5", "5\t6\t7", "8\t9")
    assert sorted(src.parse_edges(df).select("edge_id", "s_id", "e_id").collect()) == [(1, 2, 3), (5, 6, 7)]
    assert rows(src.parse_edges(df, with_length=True), "*") == [(1, 2, 3, 4.5)]


def test_index_lines(spark):
    df = lines(spark, "7|1,0,2,5,", "7|3,1", "8|", "9", "x|1,2", "9|1,2,3", "9|1,b")
    assert rows(src.parse_index(df), "*") == [(7, 1, 0), (7, 2, 5), (7, 3, 1)]
    assert rows(src.parse_index(df, rejected=True), "value") == [("9|1,2,3",), ("9|1,b",), ("x|1,2",)]


def test_od_lines(spark):
    df = lines(spark, "((1,2),30)", "((1,2),3", "((a,2),3)", "(2,((1,2),CompactBuffer(5, 6)))")
    assert rows(src.parse_od_counts(df), "*") == [(1, 2, 30)]
    assert rows(src.parse_od_trajs(df), "*") == [(1, 2, 5), (1, 2, 6)]
    assert len(rows(src.parse_od_trajs(df, rejected=True), "value")) == 3


@pytest.fixture
def postings(walks):
    return index.edge_index(walks.traj_edges)


def test_index_round_trip(spark, walks, postings, tmp_path):
    want = rows(postings, "key_id", "traj_id", "site")
    out.write_lines(out.format_index(postings, block_bits=2), f"{tmp_path}/text")
    assert rows(src.parse_index(src.read_lines(spark, f"{tmp_path}/text")), "*") == want
    tables.write_postings(postings, f"{tmp_path}/table")
    back = stored.read_postings(spark, f"{tmp_path}/table")
    assert rows(back, "*") == want
    assert rows(index.postings_of(back, 102), "*") == [r for r in want if r[0] == 102]
    plan = index.postings_of(back, 102)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key_id,102)" in plan


def test_posting_files(spark, tmp_path):
    (tmp_path / "5.txt").write_text("1,0\r\n2,3\r\n")
    (tmp_path / "6.txt").write_text("9,1\n")
    assert rows(src.read_posting_files(spark, str(tmp_path)), "*") == [(5, 1, 0), (5, 2, 3), (6, 9, 1)]
    assert rows(src.read_posting_files(spark, str(tmp_path), 6), "*") == [(6, 9, 1)]


def test_od_round_trips(spark, walks, tmp_path):
    counts = od.od_count(paths.od_endpoints(walks.traj_vertices))
    out.write_lines(out.format_od_counts(counts), f"{tmp_path}/counts")
    assert rows(src.parse_od_counts(src.read_lines(spark, f"{tmp_path}/counts")), "*") == rows(counts, "*")
    through = od.od_by_scan(walks.traj_vertices, walks.od)
    formatted = out.format_od_trajs(od.od_traj_lists(through, block_bits=3), od.od_traj_counts(through))
    out.write_lines(formatted, f"{tmp_path}/trajs")
    assert rows(src.parse_od_trajs(src.read_lines(spark, f"{tmp_path}/trajs")), "*") == rows(through, "*")
    tables.write_od_trajs(through, f"{tmp_path}/table")
    assert rows(spark.read.parquet(f"{tmp_path}/table"), "o_id", "d_id", "traj_id") == rows(through, "*")
    tables.write_od_counts(counts, f"{tmp_path}/count_table")
    assert rows(spark.read.parquet(f"{tmp_path}/count_table"), "*") == rows(counts, "*")


def test_route_sinks(spark, walks, tmp_path):
    merged = routes.merge_routes(routes.trip_routes(walks.traj_edges, walks.network))
    tables.write_routes(merged, f"{tmp_path}/routes")
    columns = ["o_id", "d_id", "route_id", "edges", "vertices", "ends", "freq"]
    assert rows(stored.read_routes(spark, f"{tmp_path}/routes"), *columns) == rows(merged, *columns)
    one = stored.read_routes(spark, f"{tmp_path}/routes", o_id=1)
    assert rows(one, *columns) == [r for r in rows(merged, *columns) if r[0] == 1]
    missing = stored.read_routes(spark, f"{tmp_path}/nothing")
    assert missing.count() == 0 and set(columns) <= set(missing.columns)

    expansions = routes.route_expansions(merged)
    tables.write_expansions(expansions, f"{tmp_path}/expansions")
    assert rows(spark.read.parquet(f"{tmp_path}/expansions"), *expansions.columns) == rows(expansions, *expansions.columns)
    assert out.format_expansions(expansions).count() == expansions.count()
    counts = routes.route_counts(routes.expanded_routes(merged, expansions))
    tables.write_route_counts(counts, f"{tmp_path}/n")
    assert rows(spark.read.parquet(f"{tmp_path}/n"), *counts.columns) == rows(counts, *counts.columns)

    nodes = trie.trie_nodes(merged)
    tables.write_trie(nodes, f"{tmp_path}/trie")
    assert rows(spark.read.parquet(f"{tmp_path}/trie"), *nodes.columns) == rows(nodes, *nodes.columns)

    per_pair = routes.od_routes(merged)
    tables.write_od_routes(per_pair, f"{tmp_path}/od_routes")
    assert spark.read.parquet(f"{tmp_path}/od_routes").count() == per_pair.count()
    r = per_pair.orderBy("route_id").first()
    first = out.format_od_routes(per_pair.where(per_pair.route_id == r.route_id)).first().value
    assert first == f"(({r.o_id},{r.d_id}),{r.n_routes},({r.freq},edge_id:{','.join(map(str, r.edges))}))"


def test_matrix_folders(spark, walks, postings, tmp_path):
    matrix = transfer.transfer_matrix(walks.traj_edges, postings, walks.network, walks.od)
    tables.write_transfer_matrix(matrix, f"{tmp_path}/m")
    for d in range(1, 7):
        got = src.parse_transfer_matrix(src.read_lines(spark, f"{tmp_path}/m/d_id={d}"))
        assert rows(got, "*") == rows(matrix.where(f"d_id = {d}"), "s_id", "e_id", "edge_id", "num")


def test_small_texts(spark, walks, tmp_path):
    seq = spark.createDataFrame([(1, 0, 1, 50), (1, 1, 2, 60)], "traj_id long, site long, vertex_id long, t long")
    places = spark.createDataFrame([(1, 116.5, 39.25), (2, -1.0, 1.0)], "vertex_id long, lng double, lat double")
    restored = network.restore_coordinates(seq, places)
    assert out.format_restored(restored).first().value == "1,1165000000|392500000|0|50|0,-10000000|10000000|0|60|0"
    assert out.format_restored(restored.drop("t")).first().value == "1,1165000000|392500000|0|0|0,-10000000|10000000|0|0|0"
    edges = spark.createDataFrame([(1, 2, 3, 4.5)], "edge_id long, s_id long, e_id long, length double")
    assert out.format_edges(edges).first().value == "1\t2\t3\t4.5"
    listed = [r.value for r in out.format_vertex_trajs(index.vertex_postings(walks.traj_vertices, 3)).collect()]
    assert [int(v.split("|")[0]) for v in listed] == sorted(int(v.split("|")[0]) for v in listed)
    again = sorted((int(v.split("|")[0]), int(t)) for v in listed for t in v.split("|")[1].split(",")[:-1])
    assert again == sorted((v, t) for t, p in walks.vertices.items() for v in p)
    histogram = paths.path_length_histogram(walks.traj_edges)
    assert [r.value for r in out.format_histogram(histogram).collect()] == [f"({a},{b})" for a, b in histogram.collect()]
    tables.write_histogram(histogram, f"{tmp_path}/h")
    assert rows(spark.read.parquet(f"{tmp_path}/h"), "*") == rows(histogram, "*")


def test_counted_routes_with_and_without_expansions(spark):
    expanded = spark.createDataFrame([(1, 2, [12], 3), (1, 2, [13, 32], 0), (4, 5, [], 1)], "o_id long, d_id long, edges array<long>, freq long")
    expansions = spark.createDataFrame([(1, 2, [12], 7, 8, 9), (1, 2, [12], 7, 8, 10), (1, 2, [12], 6, 8, 5000)], "o_id long, d_id long, edges array<long>, x_o_id long, x_d_id long, x_route_id long")
    lines = out.format_counted_routes(expanded, expansions)
    assert sorted(r.value for r in lines.collect()) == ["(1,2)|12,3[6,8,5000|]", "(1,2)|12,3[7,8,9|7,8,10|]", "(1,2)|13,32,0[]", "(4,5)|,1[]"]
    bad = spark.createDataFrame([("(1,2)|12,3[7,8|]",), ("x",), ("(1,2)|1,,2,x[]",)], "value string")
    got = src.parse_counted_routes(lines.unionByName(bad))
    assert sorted((r.o_id, tuple(r.edges), r.freq, r.x_o_id, r.x_d_id, r.x_route_id) for r in got.where("x_o_id IS NOT NULL").collect()) == [(1, (12,), 3, 6, 8, 5000), (1, (12,), 3, 7, 8, 9), (1, (12,), 3, 7, 8, 10)]
    assert got.where("x_o_id IS NULL").count() == 2 and src.parse_counted_routes(bad, rejected=True).count() == 3


def test_lines_that_other_parsers_reject(spark):
    lines = spark.createDataFrame([("((1,2),3,(4,edge_id:5,6))",), ("((1,2),3,(4,edge_id:))",), ("(5,6)",), ("7|8,9,8,",), ("7|x,",), ("1,2|3|0|4|0,5|6|0|7|0",), ("1,2|3",), ("",)], "value string")
    assert rows(src.parse_od_routes(lines), "freq", "edges") == [(4, ()), (4, (5, 6))]
    assert rows(src.parse_histogram(lines), "*") == [(5, 6)]
    assert (7, 9) in rows(src.parse_vertex_trajs(lines), "*") and rows(src.parse_vertex_trajs(lines, rejected=True).where("value = '7|x,'"), "value") == [("7|x,",)]
    assert (1, 1, 5, 6, 7) in rows(src.parse_restored(lines), "*") and ("1,2|3",) in rows(src.parse_restored(lines, rejected=True), "value")


PARSERS = [
    (src.parse_edge_trajectories, {"min_samples": 2, "min_edges": 1}), (src.parse_timed_trajectories, {"min_count": 1}),
    (src.parse_vertex_trajectories, {"min_count": 1}), (src.parse_od_endpoints, {}), (src.parse_vertices, {}), (src.parse_vertices, {"lat_first": True}),
    (src.parse_edges, {}), (src.parse_edges, {"with_length": True}), (src.parse_index, {}), (src.parse_posting_lines, {}), (src.parse_od_counts, {}),
    (src.parse_od_trajs, {}), (src.parse_od_routes, {}), (src.parse_restored, {}), (src.parse_counted_routes, {}), (src.parse_vertex_trajs, {}),
    (src.parse_histogram, {}),
]


@pytest.mark.parametrize("parse,how", PARSERS)
def test_kept_and_rejected_lines_from_one_pass(spark, parse, how):
    """Lines of every layout, so each parser meets some that it reads, some that it rejects and some that it leaves out."""
    df = lines(
        spark, "1,11,5,100,6,110", "2,1,5", "3,12,7,1,8", "4,11,q,3", "6", "", f"8,{samples(3, 3)}", f"1,{samples(1, 2, 3)}", f"a,{samples(1, 2, 3)}",
        "1\t116.5\t39.5", "1\t2\t3\t4.5", "2\tx\t39.5", "7|1,0,2,5,", "8|", "9|1,2,3", "9|1,b", "5,6", "((1,2),30)", "((1,2),3",
        "(2,((1,2),CompactBuffer(5, 6)))", "((1,2),3,(4,edge_id:5,6))", "((1,2),3,(4,edge_id:))", "(5,6)", "1,2|3|0|4|0,5|6|0|7|0", "1,2|3",
        "(1,2)|12,3[6,8,5000|7,8,9|]", "(1,2)|13,32,0[]", "(1,2)|12,3[7,8|]",
    ).unionByName(spark.createDataFrame([(None,)], "value string"))
    seen = Observation()
    good, bad = src.read_once(parse, df, seen, **how)
    text = lambda frame: sorted(str(tuple(r)) for r in frame.collect())
    plain, out_of = parse(df, **how), parse(df, rejected=True, **how)
    assert good.columns == plain.columns and text(good) == text(plain) and good.count() > 0
    assert text(bad) == text(out_of) and bad.count() > 0
    assert seen.get == {"kept": good.count(), "rejected": bad.count()}
