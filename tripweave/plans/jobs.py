"""End-to-end jobs.  Each handles all pairs or destinations in one plan.

Where one result feeds several branches it is written once with ``cut_lineage``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anomaly, index, od, paths, routes, transfer
from ..session import cut_lineage


@dataclass(frozen=True)
class CountedRoutes:
    """Merged routes, their expansions, and own plus created routes."""

    routes: DataFrame
    expansions: DataFrame
    expanded: DataFrame


def count_routes(traj_edges: DataFrame, edges: DataFrame) -> CountedRoutes:
    """Trips to merged routes to expansions."""
    merged = cut_lineage(routes.merge_routes(routes.trip_routes(traj_edges, edges)))
    expansions = cut_lineage(routes.route_expansions(merged))
    return CountedRoutes(merged, expansions, routes.expanded_routes(merged, expansions))


def frequent_pairs(traj_vertices: DataFrame, min_count: int = 100) -> DataFrame:
    """OD pairs that more than ``min_count`` trips have as their ends.

    Written once: the pairs enter several joins, and as a table their real size decides how each is run.
    """
    return cut_lineage(od.frequent_od(od.od_count(paths.od_endpoints(traj_vertices)), min_count))


def frequent_pair_routes(
    traj_vertices: DataFrame, traj_edges: DataFrame, edges: DataFrame, min_count: int = 100
) -> DataFrame:
    """Routes of every frequent pair among all trips through it."""
    pairs = frequent_pairs(traj_vertices, min_count)
    through = cut_lineage(od.od_by_scan(traj_vertices, pairs))
    return routes.od_routes(cut_lineage(routes.routes_between(traj_edges, edges, through)))


def pair_vertex_routes(traj_vertices: DataFrame, pairs: DataFrame, named: bool = False) -> DataFrame:
    """Merged vertex routes of the given pairs, cut between the first visits of O and D.

    ``trie.trie_nodes`` turns them into one prefix tree per origin, ``routes.od_trips`` into trips per pair.  With ``named`` the
    routes come without their vertices (``routes.merge_routes``), for counts.
    """
    spans = od.od_by_vertex_index(index.vertex_index(traj_vertices), pairs)
    involved = paths.restrict_trips(traj_vertices, spans)
    cut = paths.slice_by_site(paths.pack(involved, "vertex_id", "vertices"), spans, "vertices")
    trips = cut.select("o_id", "d_id", F.col("traj_id").alias("route_id"), "vertices", F.lit(1).cast("bigint").alias("freq"))
    return routes.merge_routes(trips, named)


def transfer_matrices(traj_edges: DataFrame, edges: DataFrame, destinations: DataFrame) -> DataFrame:
    """Transfer matrix of every destination (A3, A10)."""
    return transfer.transfer_matrix(traj_edges, index.edge_index(traj_edges), edges, destinations)


@dataclass(frozen=True)
class ScoringInput:
    """Routes to score, the pool of trips per pair, and the edge index of whole trips."""

    routes: DataFrame
    pool: DataFrame
    postings: DataFrame


def scoring_input(
    traj_edges: DataFrame, edges: DataFrame, pairs: DataFrame, cap: int | None = None
) -> ScoringInput:
    """Index, locate and cut out the routes of the given pairs."""
    postings = index.edge_index(traj_edges)
    located = cut_lineage(od.od_by_edge_index(postings, edges, pairs))
    # Only trips that are located can be sampled or cut, so only their rows are needed from here on.
    involved = paths.restrict_trips(traj_edges, located)
    packed = paths.pack(involved, "edge_id", "edges")
    found = cut_lineage(anomaly.scored_routes_input(packed, located, cap))
    return ScoringInput(found, od.od_traj_ids(located), index.edge_index(involved))


def score_pairs(
    traj_edges: DataFrame,
    edges: DataFrame,
    pairs: DataFrame,
    params: anomaly.IsolationParams | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Isolation score of every route of the given pairs."""
    given = scoring_input(traj_edges, edges, pairs, cap)
    return anomaly.anomaly_scores(given.routes, given.pool, given.postings, params or anomaly.IsolationParams())
