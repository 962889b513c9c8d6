"""Canonical table layouts.  Ids, sites (0-based positions), counts and times are BIGINT."""

from __future__ import annotations

EDGES = "edge_id BIGINT, s_id BIGINT, e_id BIGINT, length DOUBLE"
VERTICES = "vertex_id BIGINT, lng DOUBLE, lat DOUBLE"
TRAJ_EDGES = "traj_id BIGINT, site BIGINT, edge_id BIGINT"
TRAJ_VERTICES = "traj_id BIGINT, site BIGINT, vertex_id BIGINT"
TRAJ_POINTS = "traj_id BIGINT, site BIGINT, vertex_id BIGINT, t BIGINT"
POSTINGS = "key_id BIGINT, traj_id BIGINT, site BIGINT"
OD_COUNTS = "o_id BIGINT, d_id BIGINT, n BIGINT"
OD_TRAJS = "o_id BIGINT, d_id BIGINT, traj_id BIGINT"
ROUTES = (
    "o_id BIGINT, d_id BIGINT, route_id BIGINT, edges ARRAY<BIGINT>, vertices ARRAY<BIGINT>, "
    "ends ARRAY<BIGINT>, freq BIGINT"
)
SCORED_ROUTES = ROUTES + ", score DOUBLE"
