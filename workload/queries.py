"""Registered queries: one per operator or operator group, each over its whole input tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave import schemas
from tripweave.functions.paths import contains_sub_route, edge_count, path_text, same_route
from tripweave.operators import anomaly, index, network, od, paths, routes, scan, transfer, trie
from tripweave.plans import jobs
from tripweave.session import shared_folder
from tripweave.sinks import tables as stored
from tripweave.sinks import text as out
from tripweave.sources import tables
from tripweave.sources import text as src
from tripweave.streaming import route_store
from tripweave.streaming.commit_log import CommitLog

from .fixtures import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

FB_MIN_COUNT = 2
FC_MIN_COUNT = 100
PARAMS = anomaly.IsolationParams(trials=100, sample=256)


def query(build: Callable[[Fixtures], DataFrame]):
    """Register a query that reads its trips once."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Fixtures(spark, sf_dir))
    return build


def branching_query(build: Callable[[Fixtures], DataFrame]):
    """Register a query that reads its trips in several branches of the plan, from a table written once."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Fixtures(spark, sf_dir, stored=True))
    return build


def r6(column: str):
    return F.round(column, 6).alias(column)


def ids_text(column: str):
    return path_text(F.col(column)).alias(column)


def _lines(seq: DataFrame, item, *head) -> DataFrame:
    """One text line per trip: traj_id, extra head fields, items in travel order."""
    packed = seq.groupBy("traj_id").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("site", item.alias("x")))).alias("l")
    )
    return packed.select(F.concat_ws(",", F.col("traj_id").cast("string"), *head, F.col("l.x")).alias("value"))


def _text(*columns):
    return [F.col(c).cast("string") for c in columns]


def _new_folder(f: Fixtures, name: str) -> str:
    return f"{shared_folder(f.spark).rstrip('/')}/tripweave/{f.spark.conf.get('spark.app.id')}/{name}-{uuid.uuid4().hex}"


def _through_text(f: Fixtures, lines: DataFrame, name: str) -> DataFrame:
    """Lines written as text files and read back."""
    path = _new_folder(f, name)
    out.write_lines(lines, path)
    return src.read_lines(f.spark, path)


def fb_pairs(f: Fixtures) -> DataFrame:
    return jobs.frequent_pairs(f.fb_vertices, FB_MIN_COUNT)


def fc_pairs(f: Fixtures) -> DataFrame:
    return jobs.frequent_pairs(f.fc_vertices, FC_MIN_COUNT)


def fc_routes(f: Fixtures) -> DataFrame:
    return routes.merge_routes(routes.trip_routes(f.fc_edges, f.fc_network))


# --- text sources -------------------------------------------------------------------------------


@query
def load_edge_trajectories(f):
    lines = _lines(f.fa_points, F.concat_ws("|", *_text("t", "vertex_id")))
    return src.parse_edge_trajectories(lines).select(
        "traj_id", F.size("edges").cast("bigint").alias("n_edges"), path_text(F.col("edges")).alias("path")
    )


@query
def load_timed_trajectories(f):
    return src.parse_timed_trajectories(_lines(f.fa_points, F.concat_ws(",", *_text("vertex_id", "t")), *_text("n")))


@query
def load_with_rejected(f):
    """Timed lines, some with an unreadable time: kept trips and rejected lines from one pass."""
    unread = (F.col("traj_id") % 5 == 0) & (F.col("site") == 2)
    t = F.when(unread, F.lit("?")).otherwise(F.col("t").cast("string"))
    lines = _lines(f.fa_points, F.concat_ws(",", F.col("vertex_id").cast("string"), t), *_text("n"))
    good, bad = src.read_once(src.parse_timed_trajectories, lines)
    kept = good.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"), F.lit(False).alias("rejected"))
    fields = F.split("value", ",")
    return kept.unionByName(bad.select(
        F.get(fields, F.lit(0)).cast("bigint").alias("traj_id"), F.get(fields, F.lit(1)).cast("bigint").alias("n"), F.lit(True).alias("rejected")
    ))


@query
def load_vertex_trajectories(f):
    trips = src.parse_vertex_trajectories(_lines(f.fb_vertices, F.col("vertex_id").cast("string"), *_text("n")))
    return trips.select(
        "traj_id",
        F.get("vertices", F.lit(0)).alias("o_id"),
        F.element_at("vertices", -1).alias("d_id"),
        F.size("vertices").cast("bigint").alias("n"),
    )


@query
def load_od_endpoints(f):
    return src.parse_od_endpoints(_lines(f.fb_vertices, F.col("vertex_id").cast("string"), *_text("n")))


@query
def load_vertices(f):
    lines = f.fn_vertices.select(F.concat_ws("\t", *_text("vertex_id", "lng", "lat")).alias("value"))
    return src.parse_vertices(lines).select("vertex_id", r6("lng"), r6("lat"))


@query
def load_vertices_lat_first(f):
    lines = f.fn_vertices.select(F.concat_ws("\t", *_text("vertex_id", "lat", "lng")).alias("value"))
    return src.parse_vertices(lines, lat_first=True).select("vertex_id", r6("lng"), r6("lat"))


@query
def load_edges(f):
    lines = f.fn_edges.select(F.concat_ws("\t", *_text("edge_id", "s_id", "e_id")).alias("value"))
    return src.parse_edges(lines).select("edge_id", "s_id", "e_id")


@query
def load_edges_with_length(f):
    lines = out.format_edges(f.fn_edges)
    return src.parse_edges(lines, with_length=True).select("edge_id", "s_id", "e_id", r6("length"))


@query
def load_index(f):
    return src.parse_index(out.format_index(index.edge_index(f.fc_edges))).select("key_id", "traj_id", "site")


@branching_query
def lookup_postings(f):
    origins = fb_pairs(f).select(F.col("o_id").alias("s_id"))
    keys = f.fb_network.join(origins, "s_id", "left_semi").select(F.col("edge_id").alias("key_id"))
    return index.lookup_postings(index.edge_index(f.fb_edges), keys)


@query
def load_od_counts(f):
    lines = out.format_od_counts(od.od_count(paths.od_endpoints(f.fc_vertices)))
    return od.frequent_od(src.parse_od_counts(lines), FC_MIN_COUNT)


@branching_query
def load_od_trajs(f):
    through = od.od_by_scan(f.fc_vertices, fc_pairs(f))
    return src.parse_od_trajs(out.format_od_trajs(od.od_traj_lists(through), od.od_traj_counts(through)))


# --- paths --------------------------------------------------------------------------------------


@query
def collapse_repeats(f):
    return paths.collapse_repeats(f.fa_points)


@query
def long_paths(f):
    packed = paths.longer_than(paths.pack(f.fb_vertices, "vertex_id"), "path")
    return packed.select("traj_id", F.size("path").cast("bigint").alias("n"), ids_text("path"))


@branching_query
def path_vertices(f):
    return paths.vertex_path(f.fc_edges, f.fc_network)


@query
def od_endpoints(f):
    return paths.od_endpoints(f.fb_vertices)


@query
def path_length_histogram(f):
    return paths.path_length_histogram(f.fb_edges)


@branching_query
def slice_by_site(f):
    spans = od.od_by_vertex_index(index.vertex_index(f.fb_vertices), fb_pairs(f))
    return paths.slice_by_site(paths.pack(f.fb_vertices, "vertex_id"), spans).select(
        "o_id", "d_id", "traj_id", ids_text("path")
    )


@branching_query
def sub_trajectory(f):
    through = od.od_by_scan(f.fc_vertices, fc_pairs(f))
    cut = paths.sub_trajectory(paths.packed_trips(f.fc_edges, f.fc_network), through)
    return cut.select("o_id", "d_id", "traj_id", path_text(F.col("edges")).alias("path"))


@branching_query
def contains_vertex(f):
    return paths.containing_vertex(f.fb_vertices, fb_pairs(f).select(F.col("d_id").alias("vertex_id")))


@branching_query
def contains_ordered(f):
    return od.od_by_scan(f.fb_vertices, fb_pairs(f))


@branching_query
def suffix_min(f):
    dist = f.fc_network.select("edge_id", (F.col("edge_id") % 97).cast("double").alias("dist"))
    return paths.suffix_min(f.fc_edges, dist).select("traj_id", "site", "dist")


@branching_query
def trip_min(f):
    dist = f.fc_network.select("edge_id", (F.col("edge_id") % 97).cast("double").alias("dist"))
    return paths.overall_min(f.fc_edges, dist)


# --- indexes ------------------------------------------------------------------------------------


@query
def edge_index(f):
    return index.edge_index(f.fb_edges)


@query
def vertex_index(f):
    return index.vertex_index(f.fb_vertices)


@query
def edge_postings(f):
    return index.edge_postings(f.fb_edges).select("edge_id", "block", "n", ids_text("trajs"))


@query
def vertex_postings(f):
    return index.vertex_postings(f.fb_vertices).select("vertex_id", "block", "n", ids_text("trajs"))


@query
def vertex_bitmap(f):
    return index.bitmap_sizes(index.vertex_bitmap(f.fb_vertices))


@query
def adjacency_out(f):
    return index.adjacency_out(f.fn_edges).select("vertex_id", "block", "n", ids_text("edges"))


@query
def adjacency_in(f):
    return index.adjacency_in(f.fn_edges).select("vertex_id", "block", "n", ids_text("edges"))


@query
def incident_edges(f):
    return index.incident_edges(f.fn_edges, f.fn_vertices)


# --- OD pairs -----------------------------------------------------------------------------------


@query
def od_count(f):
    return od.by_count(od.od_count(paths.od_endpoints(f.fc_vertices)))


@query
def frequent_od(f):
    return od.frequent_od(od.od_count(paths.od_endpoints(f.fc_vertices)), FC_MIN_COUNT)


@branching_query
def od_by_vertex_index(f):
    return od.od_by_vertex_index(index.vertex_index(f.fb_vertices), fb_pairs(f))


def _fb_located(f):
    return od.od_by_edge_index(index.edge_index(f.fb_edges), f.fb_network, fb_pairs(f))


@branching_query
def od_by_edge_index(f):
    return _fb_located(f)


@branching_query
def od_traj_ids(f):
    return od.od_traj_ids(_fb_located(f))


@branching_query
def od_unordered(f):
    found = od.od_unordered(index.edge_index(f.fb_edges), f.fb_network, fb_pairs(f))
    return od.od_traj_lists(found).select("o_id", "d_id", "block", "n", ids_text("trajs"))


@branching_query
def od_by_scan(f):
    found = od.od_by_scan(f.fb_vertices, fb_pairs(f))
    return od.od_traj_lists(found).select("o_id", "d_id", "block", "n", ids_text("trajs"))


@branching_query
def od_traj_counts(f):
    return od.od_traj_counts(od.od_by_scan(f.fc_vertices, fc_pairs(f)))


@branching_query
def restrict_trips(f):
    unordered = od.od_unordered(index.edge_index(f.fb_edges), f.fb_network, fb_pairs(f))
    return paths.restrict_trips(f.fb_edges, unordered)


# --- routes -------------------------------------------------------------------------------------


@branching_query
def trip_routes(f):
    return routes.trip_routes(f.fc_edges, f.fc_network).select(
        "o_id", "d_id", "route_id", path_text(F.col("vertices")).alias("path"),
        edge_count(F.col("edges"), F.col("vertices")).alias("n_edges"), "freq",
    )


@branching_query
def merged_routes(f):
    return fc_routes(f).select("o_id", "d_id", "route_id", path_text(F.col("edges")).alias("path"), "freq")


@branching_query
def renumbered_routes(f):
    return routes.renumber_routes(fc_routes(f)).select(
        "o_id", "d_id", "route_id", path_text(F.col("edges")).alias("path"), "freq"
    )


@branching_query
def od_routes(f):
    found = jobs.frequent_pair_routes(f.fc_vertices, f.fc_edges, f.fc_network, FC_MIN_COUNT)
    return found.select("o_id", "d_id", "n_routes", "freq", path_text(F.col("edges")).alias("path"))


@branching_query
def routes_to_destination(f):
    return routes.routes_to_destination(fc_routes(f), fc_pairs(f)).select(
        "o_id", "d_id", path_text(F.col("vertices")).alias("path"), "freq"
    )


@branching_query
def od_trips(f):
    return routes.od_trips(fc_routes(f))


@branching_query
def expand_routes(f):
    found = jobs.count_routes(f.fc_edges, f.fc_network).expansions
    return found.select(
        "o_id", "d_id", path_text(F.col("edges")).alias("path"), "freq", "x_o_id", "x_d_id", "x_route_id"
    )


@branching_query
def route_counts(f):
    return routes.route_counts(jobs.count_routes(f.fc_edges, f.fc_network).expanded)


@branching_query
def sub_route_trips(f):
    """Routes of a pair that contain the pair's most used route as a sub-route, and whether they equal it."""
    merged = fc_routes(f).select("o_id", "d_id", "route_id", "edges", "freq")
    top = merged.groupBy("o_id", "d_id").agg(F.max(F.struct("freq", (-F.col("route_id")).alias("neg"))).alias("t"))
    best = top.select("o_id", "d_id", (-F.col("t.neg")).alias("route_id")).join(
        merged.select("route_id", F.col("edges").alias("top_edges")), "route_id"
    )
    pair = merged.join(best.select("o_id", "d_id", "top_edges"), ["o_id", "d_id"])
    return pair.where(contains_sub_route(F.col("edges"), F.col("top_edges"))).select(
        "o_id", "d_id", "route_id", same_route(F.col("edges"), F.col("top_edges")).cast("bigint").alias("same")
    )


@branching_query
def trie_nodes(f):
    return trie.trie_nodes(fc_routes(f))


@branching_query
def trie_edge_nodes(f):
    return trie.trie_nodes(fc_routes(f), "edges", skip_first=False)


@branching_query
def trie_leaves(f):
    return trie.trie_leaves(trie.trie_nodes(fc_routes(f))).groupBy("o_id", F.col("element").alias("d_id")).agg(
        F.count(F.lit(1)).alias("n_routes"), F.sum("end_freq").cast("bigint").alias("n")
    )


@branching_query
def pair_tries(f):
    return trie.trie_nodes(jobs.pair_vertex_routes(f.fc_vertices, fc_pairs(f)))


@branching_query
def pair_trips(f):
    return routes.od_trips(jobs.pair_vertex_routes(f.fb_vertices, fb_pairs(f), named=True))


@branching_query
def trie_merge(f):
    stored = routes.merge_routes(routes.trip_routes(f.fc_edges_of_status(False), f.fc_network))
    new = routes.merge_routes(routes.trip_routes(f.fc_edges_of_status(True), f.fc_network))
    return routes.add_routes(stored, new).select(
        "o_id", "d_id", "route_id", path_text(F.col("edges")).alias("path"), "freq"
    )


# --- destinations -------------------------------------------------------------------------------


@branching_query
def transfer_matrix(f):
    return jobs.transfer_matrices(f.fb_edges, f.fb_network, fb_pairs(f))


@branching_query
def arrivals(f):
    return transfer.arrivals(index.edge_index(f.fb_edges), f.fb_network, fb_pairs(f))


# --- isolation ----------------------------------------------------------------------------------


@branching_query
def trial_samples(f):
    given = jobs.scoring_input(f.fc_edges, f.fc_network, fc_pairs(f))
    return anomaly.draw_samples(given.pool, PARAMS).select(
        "o_id", "d_id", F.col("trial").cast("bigint").alias("trial"), "traj_id"
    )


@branching_query
def isolation_counts(f):
    given = jobs.scoring_input(f.fc_edges, f.fc_network, fc_pairs(f))
    counts = anomaly.isolation_counts(given.routes, given.pool, given.postings, PARAMS)
    return counts.select("o_id", "d_id", "route_id", F.col("trial").cast("bigint").alias("trial"), "cnt")


@branching_query
def anomaly_score(f):
    scored = jobs.score_pairs(f.fc_edges, f.fc_network, fc_pairs(f), PARAMS)
    return scored.select("o_id", "d_id", path_text(F.col("edges")).alias("path"), "freq", r6("score"))


@branching_query
def load_scored_routes(f):
    """Scored routes written as a table and read back."""
    path = _new_folder(f, "routes")
    scored = jobs.score_pairs(f.fc_edges, f.fc_network, fc_pairs(f), PARAMS)
    stored.write_routes(routes.add_vertices(scored, f.fc_network), path)
    read = tables.read_routes(f.spark, path)
    return read.select("o_id", "d_id", path_text(F.col("edges")).alias("path"), "freq", r6("score"))


# --- network ------------------------------------------------------------------------------------


@query
def duplicate_vertices(f):
    return network.duplicate_vertices(f.fn_vertices)


@query
def unify_edges(f):
    return network.unify_edges(f.fn_edges, network.duplicate_vertices(f.fn_vertices)).select(
        "edge_id", "s_id", "e_id", r6("length")
    )


@query
def restore_coordinates(f):
    return network.restore_coordinates(f.fb_vertices, f.fg_vertices)


@query
def vertex_degree(f):
    return network.vertex_degree(f.fn_edges)


@query
def edge_length(f):
    return network.edge_lengths(f.fn_edges, f.fn_vertices).select("edge_id", r6("metres"))


def _regions(f):
    centres = f.fg_vertices.withColumnRenamed("vertex_id", "centre_id")
    return network.region_vertices(centres, f.fn_vertices)


@query
def region_vertices(f):
    return _regions(f)


@query
def region_edges(f):
    return network.region_edges(f.fn_edges, _regions(f))


@query
def nearest_edge(f):
    return network.nearest_edges(f.fp_points, f.fn_edges, f.fn_vertices)


@query
def geohash_density(f):
    return network.geohash_density(f.fn_vertices).select("cell", "n", r6("lat"), r6("lng"))


@branching_query
def scored_route_vertices(f):
    """Routes to score, written with their vertices and read back."""
    path = _new_folder(f, "routes")
    stored.write_routes(routes.add_vertices(jobs.scoring_input(f.fc_edges, f.fc_network, fc_pairs(f)).routes, f.fc_network), path)
    return tables.read_routes(f.spark, path).select(
        "o_id", "d_id", "route_id", path_text(F.col("vertices")).alias("vertices"), path_text(F.col("ends")).alias("ends"), "freq"
    )


# trips cut into ranges of a few sites, so that the second pass has work


@query
def collapse_long_trips(f):
    return scan.collapse_repeats(f.fa_points.select("traj_id", "site", "vertex_id"), segment=16)


@branching_query
def suffix_min_long_trips(f):
    dist = f.fc_network.select("edge_id", (F.col("edge_id") % 97).cast("double").alias("dist"))
    return scan.suffix_min(f.fc_edges, dist, segment=2).select("traj_id", "site", "dist")


@branching_query
def long_path_vertices(f):
    return scan.vertex_path(f.fc_edges, f.fc_network)


@query
def unknown_vertices(f):
    """Visits of places without coordinates, where only every other place has some."""
    return network.unknown_vertices(f.fb_vertices, f.fg_vertices.where("vertex_id % 2 = 0"))


# --- stored tables and text written and read back --------------------------------------------------


def _stored_index(f):
    name, path = f"postings_{uuid.uuid4().hex}", _new_folder(f, "postings")
    stored.write_bucketed(index.vertex_index(f.fb_vertices), name, path, "key_id", 16, ["traj_id"])
    f.spark.sql(f"DROP TABLE {name}")  # the files stay, as for another session
    return tables.open_bucketed(f.spark, name, path, schemas.POSTINGS, "key_id", 16, ["traj_id"])


@query
def stored_vertex_index(f):
    return _stored_index(f)


@query
def postings_of_key(f):
    return index.postings_of(_stored_index(f), 9)


@branching_query
def stored_od_routes(f):
    found = jobs.frequent_pair_routes(f.fc_vertices, f.fc_edges, f.fc_network, FC_MIN_COUNT)
    read = src.parse_od_routes(_through_text(f, out.format_od_routes(found), "od_routes"))
    return read.select("o_id", "d_id", "n_routes", "freq", path_text(F.col("edges")).alias("path"))


@branching_query
def stored_transfer_matrix(f):
    path = _new_folder(f, "matrix")
    stored.write_transfer_matrix(jobs.transfer_matrices(f.fb_edges, f.fb_network, fb_pairs(f)), path)
    lines = f.spark.read.schema("value STRING, d_id BIGINT").option("sep", "\u0001").csv(path)
    return src.parse_transfer_matrix(lines, "d_id")


@query
def restored_lines(f):
    points = network.restore_coordinates(f.fb_vertices, f.fg_vertices)
    return src.parse_restored(_through_text(f, out.format_restored(points), "restored"))


@branching_query
def stored_expansions(f):
    found = jobs.count_routes(f.fc_edges, f.fc_network)
    read = src.parse_counted_routes(_through_text(f, out.format_counted_routes(found.expanded, found.expansions), "expansions"))
    return read.select("o_id", "d_id", path_text(F.col("edges")).alias("path"), "freq", "x_o_id", "x_d_id", "x_route_id")


@query
def vertex_traj_lines(f):
    return src.parse_vertex_trajs(_through_text(f, out.format_vertex_trajs(index.vertex_postings(f.fb_vertices)), "vertices"))


@query
def length_histogram_lines(f):
    return src.parse_histogram(_through_text(f, out.format_histogram(paths.path_length_histogram(f.fb_edges)), "histogram"))


@branching_query
def od_unordered_sets(f):
    """The trips of ``od_unordered``, kept as bit sets until the end."""
    sets = od.od_unordered_sets(index.edge_bitmap(f.fb_edges), f.fb_network, fb_pairs(f))
    found = index.bitmap_ids(sets, "o_id", "d_id").withColumnRenamed("id", "traj_id")
    return od.od_traj_lists(found).select("o_id", "d_id", "block", "n", ids_text("trajs"))


@branching_query
def trie_growth(f):
    """The tree of all routes, grown from that of one part by the nodes of the other."""
    old = trie.trie_nodes(routes.merge_routes(routes.trip_routes(f.fc_edges_of_status(False), f.fc_network)))
    new = trie.trie_nodes(routes.merge_routes(routes.trip_routes(f.fc_edges_of_status(True), f.fc_network)))
    return trie.add_nodes(old, new)


@branching_query
def stored_batches(f):
    """Two batches of trips, one of them written again, put together and read."""
    folder = _new_folder(f, "store")
    for batch, is_open in ((0, False), (1, True), (1, True), (2, None)):
        trips = f.fc_edges_of_status(bool(is_open))
        new = routes.trip_routes(trips if is_open is not None else trips.limit(0), f.fc_network)
        route_store.write_batch(new, folder, batch)
    route_store.compact_in_place(f.spark, folder)
    CommitLog(f.spark, folder).vacuum()
    return route_store.read_store(f.spark, folder).select(
        "o_id", "d_id", "route_id", path_text(F.col("edges")).alias("path"), "freq"
    )
