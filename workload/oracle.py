"""The same results in plain SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from .queries import FB_MIN_COUNT, FC_MIN_COUNT, PARAMS

ORACLE_SQL: dict[str, str] = {}

_FIXTURES: dict[str, tuple[list[str], str]] = {}


def _fixture(name: str, needs: list[str], sql: str) -> None:
    _FIXTURES[name] = (needs, sql)


def _oracle(name: str, needs: list[str], sql: str, recursive: bool = False) -> None:
    """Prefix ``sql`` with the CTEs it needs."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in _FIXTURES[n][0]:
            visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in needs:
        visit(n)
    ctes = ",\n".join(f"{n} AS (\n{_FIXTURES[n][1].strip()}\n)" for n in ordered)
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        ctes, sql = ctes + ",\n" + sql[5:], ""
    word = "WITH RECURSIVE" if recursive else "WITH"
    ORACLE_SQL[name] = f"{word} {ctes}\n{sql}" if sql else f"{word} {ctes}"


# --- inputs -------------------------------------------------------------------------------------

_fixture("fa_points", [], """
SELECT user_id AS traj_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS site,
       CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
            WHEN 'signup' THEN 4 ELSE 5 END AS BIGINT) AS vertex_id,
       event_id AS t
FROM events
""")
_fixture("fb_vertices", [], """
SELECT traj_id, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY o) - 1 AS BIGINT) AS site, vertex_id
FROM (SELECT *, lag(vertex_id) OVER (PARTITION BY traj_id ORDER BY o) AS p
      FROM (SELECT o_custkey AS traj_id, CAST(s_nationkey + 1 AS BIGINT) AS vertex_id,
                   row_number() OVER (PARTITION BY o_custkey
                     ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS o
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                          JOIN supplier ON l_suppkey = s_suppkey) x) y
WHERE p IS NULL OR p <> vertex_id
""")
_fixture("fc_vertices", [], """
SELECT traj_id, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY o) - 1 AS BIGINT) AS site, vertex_id
FROM (SELECT *, lag(vertex_id) OVER (PARTITION BY traj_id ORDER BY o) AS p
      FROM (SELECT l_orderkey AS traj_id, CAST(n_regionkey + 1 AS BIGINT) AS vertex_id,
                   row_number() OVER (PARTITION BY l_orderkey
                     ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) AS o
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
                          JOIN nation ON s_nationkey = n_nationkey) x) y
WHERE p IS NULL OR p <> vertex_id
""")
for _f in ("fb", "fc"):
    _fixture(f"{_f}_edges", [f"{_f}_vertices"], f"""
SELECT traj_id, site, vertex_id * 1000 + nx AS edge_id
FROM (SELECT *, lead(vertex_id) OVER (PARTITION BY traj_id ORDER BY site) AS nx FROM {_f}_vertices) z
WHERE nx IS NOT NULL
""")
    _fixture(f"{_f}_network", [f"{_f}_edges"], f"""
SELECT DISTINCT edge_id, CAST((edge_id - edge_id % 1000) / 1000 AS BIGINT) AS s_id, edge_id % 1000 AS e_id
FROM {_f}_edges
""")
    _fixture(f"{_f}_ends", [f"{_f}_vertices"], f"""
SELECT traj_id, arg_min(vertex_id, site) AS o_id, arg_max(vertex_id, site) AS d_id
FROM {_f}_vertices GROUP BY traj_id
""")
    _fixture(f"{_f}_pairs", [f"{_f}_ends"], f"""
SELECT o_id, d_id, count(*) AS n FROM {_f}_ends GROUP BY o_id, d_id
HAVING count(*) > {FB_MIN_COUNT if _f == "fb" else FC_MIN_COUNT}
""")
    _fixture(f"{_f}_post_e", [f"{_f}_edges"], f"""
SELECT edge_id AS key_id, traj_id, min(site) AS site FROM {_f}_edges GROUP BY edge_id, traj_id
""")
    _fixture(f"{_f}_post_v", [f"{_f}_vertices"], f"""
SELECT vertex_id AS key_id, traj_id, min(site) AS site FROM {_f}_vertices GROUP BY vertex_id, traj_id
""")
    _fixture(f"{_f}_through", [f"{_f}_pairs", f"{_f}_vertices"], f"""
SELECT DISTINCT o_id, d_id, a.traj_id
FROM {_f}_pairs JOIN (SELECT traj_id, vertex_id, min(site) AS site FROM {_f}_vertices GROUP BY 1, 2) a
                  ON a.vertex_id = o_id
     JOIN {_f}_vertices b ON b.vertex_id = d_id AND b.traj_id = a.traj_id AND b.site > a.site
""")
    _fixture(f"{_f}_located", [f"{_f}_pairs", f"{_f}_post_e", f"{_f}_network"], f"""
SELECT o_id, d_id, a.traj_id, s_site, e_site
FROM {_f}_pairs
JOIN (SELECT s_id, traj_id, min(site) AS s_site FROM {_f}_post_e JOIN {_f}_network ON key_id = edge_id GROUP BY 1, 2) a
  ON a.s_id = o_id
JOIN (SELECT e_id, traj_id, min(site) AS e_site FROM {_f}_post_e JOIN {_f}_network ON key_id = edge_id GROUP BY 1, 2) b
  ON b.e_id = d_id AND b.traj_id = a.traj_id
WHERE s_site < e_site
""")
    _fixture(f"{_f}_unordered", [f"{_f}_pairs", f"{_f}_edges", f"{_f}_network"], f"""
SELECT o_id, d_id, traj_id FROM {_f}_pairs JOIN {_f}_network ON s_id = o_id JOIN {_f}_edges USING (edge_id)
INTERSECT
SELECT o_id, d_id, traj_id FROM {_f}_pairs JOIN {_f}_network ON e_id = d_id JOIN {_f}_edges USING (edge_id)
""")

# Trips of fc as lists, and their merged routes.
_fixture("fc_packed", ["fc_edges", "fc_network"], """
SELECT traj_id, list(edge_id ORDER BY site) AS edges,
       list(s_id ORDER BY site) AS starts, list(e_id ORDER BY site) AS ends
FROM fc_edges JOIN fc_network USING (edge_id) GROUP BY traj_id
""")
_fixture("fc_trips", ["fc_packed"], """
SELECT starts[1] AS o_id, ends[len(ends)] AS d_id, traj_id, edges,
       list_append(starts, ends[len(ends)]) AS vertices
FROM fc_packed
""")
_fixture("fc_routes", ["fc_trips"], """
SELECT o_id, d_id, edges, min(traj_id) AS route_id, any_value(vertices) AS vertices, count(*) AS freq
FROM fc_trips GROUP BY o_id, d_id, edges
""")

_fixture("fn_vertices", [], """
SELECT s_suppkey AS vertex_id,
       CAST(116.3 AS DOUBLE) + CAST(s_suppkey % 8 AS DOUBLE) * CAST(0.004 AS DOUBLE) AS lng,
       CAST(39.9 AS DOUBLE) + CAST(s_suppkey % 6 AS DOUBLE) * CAST(0.003 AS DOUBLE) AS lat
FROM supplier
""")
_fixture("fn_edges", [], """
SELECT a.s_suppkey * 1000000 + b.s_suppkey AS edge_id, a.s_suppkey AS s_id, b.s_suppkey AS e_id,
       abs(a.s_acctbal) AS length
FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 OR b.s_suppkey = a.s_suppkey + 3
""")
_fixture("fp_points", [], """
SELECT c_custkey AS point_id,
       CAST(116.3 AS DOUBLE) + CAST(c_custkey % 97 AS DOUBLE) * CAST(0.0003 AS DOUBLE) AS lng,
       CAST(39.9 AS DOUBLE) + CAST(c_custkey % 89 AS DOUBLE) * CAST(0.0002 AS DOUBLE) AS lat
FROM customer
""")
_fixture("fg_vertices", [], """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS vertex_id,
       CAST(116.3 AS DOUBLE) + CAST(n_nationkey AS DOUBLE) * CAST(0.0125 AS DOUBLE) AS lng,
       CAST(39.9 AS DOUBLE) + CAST(n_nationkey AS DOUBLE) * CAST(0.00625 AS DOUBLE) AS lat
FROM nation
""")


def _blocks(frame: str, keys: str, ids: str, out: str) -> str:
    return f"""
SELECT {keys}, CAST({ids} >> 12 AS BIGINT) AS block, count(*) AS n,
       string_agg(CAST({ids} AS VARCHAR), ',' ORDER BY {ids}) AS {out}
FROM (SELECT {keys}, {ids} FROM {frame}) GROUP BY {keys}, block
"""


# --- text sources -------------------------------------------------------------------------------

_oracle("load_edge_trajectories", ["fa_points"], """
SELECT traj_id, count(*) AS n_edges, string_agg(CAST(vertex_id AS VARCHAR), ',' ORDER BY site) AS path
FROM (SELECT *, lag(vertex_id) OVER (PARTITION BY traj_id ORDER BY site) AS p,
             count(*) OVER (PARTITION BY traj_id) AS samples FROM fa_points)
WHERE (p IS NULL OR p <> vertex_id) AND samples >= 10
GROUP BY traj_id HAVING count(*) > 10
""")
_oracle("load_timed_trajectories", ["fa_points"], """
SELECT traj_id, site, vertex_id, t FROM fa_points
QUALIFY count(*) OVER (PARTITION BY traj_id) > 10
""")
_oracle("load_with_rejected", ["fa_points"], """
SELECT traj_id, count(*) AS n, traj_id % 5 = 0 AS rejected FROM fa_points GROUP BY traj_id HAVING count(*) > 10
""")
_oracle("load_vertex_trajectories", ["fb_vertices"], """
SELECT traj_id, arg_min(vertex_id, site) AS o_id, arg_max(vertex_id, site) AS d_id, count(*) AS n
FROM fb_vertices GROUP BY traj_id HAVING count(*) > 10
""")
_oracle("load_od_endpoints", ["fb_ends"], "SELECT traj_id, o_id, d_id FROM fb_ends")
_oracle("load_vertices", ["fn_vertices"], """
SELECT vertex_id, round(lng, 6) AS lng, round(lat, 6) AS lat FROM fn_vertices
""")
_oracle("load_vertices_lat_first", ["fn_vertices"], """
SELECT vertex_id, round(lng, 6) AS lng, round(lat, 6) AS lat FROM fn_vertices
""")
_oracle("load_edges", ["fn_edges"], "SELECT edge_id, s_id, e_id FROM fn_edges")
_oracle("load_edges_with_length", ["fn_edges"], "SELECT edge_id, s_id, e_id, round(length, 6) AS length FROM fn_edges")
_oracle("load_index", ["fc_post_e"], "SELECT key_id, traj_id, site FROM fc_post_e")
_oracle("lookup_postings", ["fb_post_e", "fb_pairs", "fb_network"], """
SELECT key_id, traj_id, site FROM fb_post_e
WHERE key_id IN (SELECT edge_id FROM fb_network WHERE s_id IN (SELECT o_id FROM fb_pairs))
""")
_oracle("load_od_counts", ["fc_pairs"], "SELECT o_id, d_id, n FROM fc_pairs")
_oracle("load_od_trajs", ["fc_through"], "SELECT o_id, d_id, traj_id FROM fc_through")

# --- paths --------------------------------------------------------------------------------------

_oracle("collapse_repeats", ["fa_points"], """
SELECT traj_id, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY site) - 1 AS BIGINT) AS site, vertex_id
FROM (SELECT *, lag(vertex_id) OVER (PARTITION BY traj_id ORDER BY site) AS p FROM fa_points)
WHERE p IS NULL OR p <> vertex_id
""")
_oracle("long_paths", ["fb_vertices"], """
SELECT traj_id, count(*) AS n, string_agg(CAST(vertex_id AS VARCHAR), ',' ORDER BY site) AS path
FROM fb_vertices GROUP BY traj_id HAVING count(*) > 10
""")
_oracle("path_vertices", ["fc_edges", "fc_network"], """
SELECT traj_id, site, s_id AS vertex_id FROM fc_edges JOIN fc_network USING (edge_id)
UNION ALL
SELECT traj_id, max(site) + 1, arg_max(e_id, site) FROM fc_edges JOIN fc_network USING (edge_id) GROUP BY traj_id
""")
_oracle("od_endpoints", ["fb_ends"], "SELECT traj_id, o_id, d_id FROM fb_ends")
_oracle("path_length_histogram", ["fb_edges"], """
SELECT n_edges, count(*) AS n FROM (SELECT traj_id, count(*) AS n_edges FROM fb_edges GROUP BY traj_id) GROUP BY n_edges
""")
_oracle("slice_by_site", ["fb_pairs", "fb_post_v", "fb_vertices"], """
SELECT o_id, d_id, a.traj_id, string_agg(CAST(v.vertex_id AS VARCHAR), ',' ORDER BY v.site) AS path
FROM fb_pairs JOIN fb_post_v a ON a.key_id = o_id JOIN fb_post_v b ON b.key_id = d_id AND b.traj_id = a.traj_id
     JOIN fb_vertices v ON v.traj_id = a.traj_id AND v.site BETWEEN a.site AND b.site
WHERE a.site < b.site GROUP BY o_id, d_id, a.traj_id
""")
_oracle("sub_trajectory", ["fc_through", "fc_edges", "fc_network"], """
WITH e AS (SELECT * FROM fc_edges JOIN fc_network USING (edge_id)),
     first_o AS (SELECT t.o_id, t.d_id, t.traj_id, min(site) AS i
                 FROM fc_through t JOIN e ON e.traj_id = t.traj_id AND e.s_id = t.o_id GROUP BY 1, 2, 3),
     first_d AS (SELECT f.o_id, f.d_id, f.traj_id, i, min(site) AS j
                 FROM first_o f LEFT JOIN e ON e.traj_id = f.traj_id AND e.e_id = f.d_id AND e.site >= i
                 GROUP BY 1, 2, 3, 4)
SELECT t.o_id, t.d_id, t.traj_id,
       coalesce(string_agg(CAST(e.edge_id AS VARCHAR), ',' ORDER BY e.site), '') AS path
FROM fc_through t LEFT JOIN first_d f ON f.o_id = t.o_id AND f.d_id = t.d_id AND f.traj_id = t.traj_id
     LEFT JOIN e ON e.traj_id = f.traj_id AND e.site >= f.i AND (f.j IS NULL OR e.site <= f.j)
GROUP BY 1, 2, 3
""")
_oracle("contains_vertex", ["fb_vertices", "fb_pairs"], """
SELECT DISTINCT vertex_id, traj_id FROM fb_vertices WHERE vertex_id IN (SELECT d_id FROM fb_pairs)
""")
_oracle("contains_ordered", ["fb_through"], "SELECT o_id, d_id, traj_id FROM fb_through")
_oracle("suffix_min", ["fc_edges"], """
SELECT traj_id, site, least(900000000.0::DOUBLE, min(CAST(edge_id % 97 AS DOUBLE)) OVER (PARTITION BY traj_id ORDER BY site
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS dist
FROM fc_edges
""")
_oracle("trip_min", ["fc_edges"], """
SELECT traj_id, least(900000000.0::DOUBLE, min(CAST(edge_id % 97 AS DOUBLE))) AS dist FROM fc_edges GROUP BY traj_id
""")

# --- indexes ------------------------------------------------------------------------------------

_oracle("edge_index", ["fb_post_e"], "SELECT key_id, traj_id, site FROM fb_post_e")
_oracle("vertex_index", ["fb_post_v"], "SELECT key_id, traj_id, site FROM fb_post_v")
_oracle("edge_postings", ["fb_edges"], _blocks("fb_edges", "edge_id", "traj_id", "trajs"))
_oracle("vertex_postings", ["fb_vertices"], _blocks("fb_vertices", "vertex_id", "traj_id", "trajs"))
_oracle("vertex_bitmap", ["fb_vertices"], """
SELECT vertex_id, count(DISTINCT traj_id) AS n FROM fb_vertices GROUP BY vertex_id
""")
_oracle("adjacency_out", ["fn_edges"],
        _blocks("(SELECT s_id AS vertex_id, edge_id FROM fn_edges)", "vertex_id", "edge_id", "edges"))
_oracle("adjacency_in", ["fn_edges"],
        _blocks("(SELECT e_id AS vertex_id, edge_id FROM fn_edges)", "vertex_id", "edge_id", "edges"))
_oracle("incident_edges", ["fn_edges", "fn_vertices"], """
SELECT vertex_id, edge_id FROM fn_vertices JOIN fn_edges ON s_id = vertex_id OR e_id = vertex_id
""")

# --- OD pairs -----------------------------------------------------------------------------------

_oracle("od_count", ["fc_ends"], "SELECT o_id, d_id, count(*) AS n FROM fc_ends GROUP BY o_id, d_id")
_oracle("frequent_od", ["fc_pairs"], "SELECT o_id, d_id, n FROM fc_pairs")
_oracle("od_by_vertex_index", ["fb_pairs", "fb_post_v"], """
SELECT o_id, d_id, a.traj_id, a.site AS s_site, b.site AS e_site
FROM fb_pairs JOIN fb_post_v a ON a.key_id = o_id JOIN fb_post_v b ON b.key_id = d_id AND b.traj_id = a.traj_id
WHERE a.site < b.site
""")
_oracle("od_by_edge_index", ["fb_located"], "SELECT o_id, d_id, traj_id, s_site, e_site FROM fb_located")
_oracle("od_traj_ids", ["fb_located"], "SELECT DISTINCT o_id, d_id, traj_id FROM fb_located")
_oracle("od_unordered", ["fb_unordered"], _blocks("fb_unordered", "o_id, d_id", "traj_id", "trajs"))
_oracle("od_by_scan", ["fb_through"], _blocks("fb_through", "o_id, d_id", "traj_id", "trajs"))
_oracle("od_traj_counts", ["fc_through"], "SELECT o_id, d_id, count(*) AS n FROM fc_through GROUP BY o_id, d_id")
_oracle("restrict_trips", ["fb_edges", "fb_unordered"], """
SELECT traj_id, site, edge_id FROM fb_edges WHERE traj_id IN (SELECT traj_id FROM fb_unordered)
""")

# --- routes -------------------------------------------------------------------------------------

_oracle("trip_routes", ["fc_trips"], """
SELECT o_id, d_id, traj_id AS route_id, array_to_string(vertices, ',') AS path,
       CAST(len(vertices) - 1 AS BIGINT) AS n_edges, CAST(1 AS BIGINT) AS freq
FROM fc_trips
""")
_oracle("merged_routes", ["fc_routes"], """
SELECT o_id, d_id, route_id, array_to_string(edges, ',') AS path, freq FROM fc_routes
""")
_oracle("renumbered_routes", ["fc_routes"], """
SELECT o_id, d_id,
       CAST(row_number() OVER (ORDER BY substr(md5(concat_ws('|', o_id, d_id, array_to_string(edges, ','))), 1, 3),
                               o_id, d_id, edges) - 1 AS BIGINT) AS route_id,
       array_to_string(edges, ',') AS path, freq
FROM fc_routes
""")
_oracle("od_routes", ["fc_through", "fc_packed"], """
WITH cut AS (SELECT o_id, d_id, edges, starts, ends, list_position(starts, o_id) AS i FROM fc_through JOIN fc_packed USING (traj_id)),
     parts AS (SELECT o_id, d_id, CASE WHEN i IS NULL THEN [] ELSE edges[i:coalesce(i - 1 + list_position(ends[i:], d_id), len(edges))] END AS part
               FROM cut),
     merged AS (SELECT o_id, d_id, part, count(*) AS freq FROM parts GROUP BY o_id, d_id, part)
SELECT o_id, d_id, count(*) OVER (PARTITION BY o_id, d_id) AS n_routes, freq, array_to_string(part, ',') AS path
FROM merged
""")
_oracle("routes_to_destination", ["fc_routes", "fc_pairs"], """
SELECT o_id, d_id, array_to_string(vertices, ',') AS path, freq FROM fc_routes SEMI JOIN fc_pairs USING (o_id, d_id)
""")
_oracle("od_trips", ["fc_trips"], "SELECT o_id, d_id, count(*) AS n FROM fc_trips GROUP BY o_id, d_id")

_fixture("expansions", ["fc_routes"], """
SELECT c.o_id, c.d_id, coalesce(own.edges, c.part) AS edges, coalesce(own.freq, 0) AS freq, own.edges IS NULL AS created,
       c.x_o_id, c.x_d_id, c.f_id AS x_route_id
FROM (SELECT g.o_id, g.d_id, f.route_id AS f_id, f.o_id AS x_o_id, f.d_id AS x_d_id, f.edges AS f_edges,
             list_position(f.vertices, g.o_id) AS i,
             f.edges[list_position(f.vertices, g.o_id):
                     list_position(f.vertices, g.o_id) - 1
                     + list_position(f.vertices[list_position(f.vertices, g.o_id) + 1:], g.d_id)] AS part
      FROM (SELECT DISTINCT o_id, d_id FROM fc_routes) g
      JOIN fc_routes f ON (f.o_id <> g.o_id OR f.d_id <> g.d_id) AND list_contains(f.vertices, g.o_id)
       AND list_contains(f.vertices[list_position(f.vertices, g.o_id) + 1:], g.d_id)) c
LEFT JOIN fc_routes own
  ON own.o_id = c.o_id AND own.d_id = c.d_id AND list_contains(c.f_edges, own.edges[1])
 AND c.f_edges[list_position(c.f_edges, own.edges[1]):list_position(c.f_edges, own.edges[1]) + len(own.edges) - 1] = own.edges
QUALIFY row_number() OVER (PARTITION BY c.o_id, c.d_id, c.f_id ORDER BY len(own.edges), own.edges) = 1
""")
_oracle("expand_routes", ["expansions"], """
SELECT o_id, d_id, array_to_string(edges, ',') AS path, CAST(freq AS BIGINT) AS freq, x_o_id, x_d_id, x_route_id
FROM expansions
""")
_oracle("route_counts", ["expansions", "fc_routes"], """
SELECT o_id, d_id, count(*) AS n_routes
FROM (SELECT o_id, d_id, edges FROM fc_routes UNION SELECT o_id, d_id, edges FROM expansions WHERE created)
GROUP BY o_id, d_id
""")
_oracle("sub_route_trips", ["fc_routes"], """
WITH top AS (SELECT o_id, d_id, edges AS t FROM fc_routes
             QUALIFY row_number() OVER (PARTITION BY o_id, d_id ORDER BY freq DESC, route_id) = 1)
SELECT o_id, d_id, route_id, CAST(edges = t AS BIGINT) AS same
FROM fc_routes JOIN top USING (o_id, d_id)
WHERE list_contains(edges, t[1]) AND edges[list_position(edges, t[1]):list_position(edges, t[1]) + len(t) - 1] = t
""")


def _nodes(path: str, drop: int, frame: str = "fc_routes") -> str:
    h = "CAST('0x' || substr(md5(concat_ws('|', k, path[k])), {start}, 15) AS BIGINT)"
    return f"""
WITH p AS (SELECT o_id, d_id, route_id, freq, {path}[{drop + 1}:] AS path FROM {frame}),
     s AS (SELECT *, {h.format(start=1)} AS h1, {h.format(start=16)} AS h2
           FROM (SELECT *, unnest(range(1, len(path) + 1)) AS k FROM p)),
     named AS (SELECT *, bit_xor(h1) OVER w AS hi, bit_xor(h2) OVER w AS lo
               FROM s WINDOW w AS (PARTITION BY o_id, d_id, route_id ORDER BY k))
SELECT o_id, k AS depth, any_value(path[k]) AS element, any_value(hi) AS node_hi, any_value(lo) AS node_lo,
       any_value(xor(hi, h1)) AS parent_hi, any_value(xor(lo, h2)) AS parent_lo,
       CAST(sum(CASE WHEN k = len(path) THEN freq ELSE 0 END) AS BIGINT) AS end_freq,
       CAST(sum(freq) AS BIGINT) AS pass_freq
FROM named GROUP BY o_id, k, path[1:k]
"""


_oracle("trie_nodes", ["fc_routes"], _nodes("vertices", 1))
_oracle("trie_edge_nodes", ["fc_routes"], _nodes("edges", 0))
_oracle("trie_leaves", ["fc_routes"], """
SELECT o_id, d_id, count(*) AS n_routes, CAST(sum(freq) AS BIGINT) AS n FROM fc_routes GROUP BY o_id, d_id
""")
for _f in ("fb", "fc"):
    _fixture(f"{_f}_pair_routes", [f"{_f}_pairs", f"{_f}_post_v", f"{_f}_vertices"], f"""
SELECT o_id, d_id, vertices, min(traj_id) AS route_id, count(*) AS freq
FROM (SELECT o_id, d_id, a.traj_id, list(v.vertex_id ORDER BY v.site) AS vertices
      FROM {_f}_pairs JOIN {_f}_post_v a ON a.key_id = o_id JOIN {_f}_post_v b ON b.key_id = d_id AND b.traj_id = a.traj_id
           JOIN {_f}_vertices v ON v.traj_id = a.traj_id AND v.site BETWEEN a.site AND b.site
      WHERE a.site < b.site GROUP BY 1, 2, 3)
GROUP BY 1, 2, 3
""")
_oracle("pair_tries", ["fc_pair_routes"], _nodes("vertices", 1, "fc_pair_routes"))
_oracle("pair_trips", ["fb_pair_routes"], "SELECT o_id, d_id, CAST(sum(freq) AS BIGINT) AS n FROM fb_pair_routes GROUP BY 1, 2")
_oracle("trie_merge", ["fc_routes"], """
SELECT o_id, d_id, route_id, array_to_string(edges, ',') AS path, freq FROM fc_routes
""")

# --- destinations -------------------------------------------------------------------------------

_fixture("fb_arrivals", ["fb_pairs", "fb_edges", "fb_network"], """
SELECT e_id AS d_id, traj_id, min(site) AS last_site
FROM fb_edges JOIN fb_network USING (edge_id) WHERE e_id IN (SELECT d_id FROM fb_pairs) GROUP BY 1, 2
""")
_oracle("arrivals", ["fb_arrivals"], "SELECT d_id, traj_id, last_site FROM fb_arrivals")
_oracle("transfer_matrix", ["fb_arrivals"], """
SELECT d_id, s_id, e_id, edge_id, count(*) AS num
FROM fb_arrivals a JOIN fb_edges e ON e.traj_id = a.traj_id AND e.site <= a.last_site JOIN fb_network USING (edge_id)
GROUP BY 1, 2, 3, 4
""")

# --- isolation ----------------------------------------------------------------------------------

_H = "CAST('0x' || substr(md5(concat_ws('|', {args})), 1, 15) AS BIGINT)"

_fixture("pools", ["fc_located"], "SELECT o_id, d_id, count(*) AS n FROM fc_located GROUP BY 1, 2")
# One position is drawn per step; of the states only the last of each trial is used.
_fixture("drawn", ["pools"], f"""
SELECT o_id, d_id, trial, n, greatest(n - {PARAMS.sample}, 0) AS j, CAST([] AS BIGINT[]) AS taken
FROM pools CROSS JOIN (SELECT unnest(range(0, {PARAMS.trials})) AS trial)
UNION ALL
SELECT o_id, d_id, trial, n, j + 1, list_append(taken, CASE WHEN list_contains(taken, t) THEN j ELSE t END)
FROM (SELECT *, {_H.format(args=f"{PARAMS.seed}, 's', o_id, d_id, trial, j")} % (j + 1) AS t FROM drawn WHERE j < n)
""")
_fixture("samples", ["drawn", "fc_located"], f"""
SELECT o_id, d_id, trial, traj_id, idx
FROM (SELECT o_id, d_id, trial, unnest(taken) AS pos, unnest(range(0, len(taken))) AS idx FROM drawn WHERE j = n)
JOIN (SELECT o_id, d_id, traj_id,
             row_number() OVER (PARTITION BY o_id, d_id
               ORDER BY {_H.format(args=f"{PARAMS.seed}, 'n', traj_id")} % 4096, traj_id) - 1 AS pos
      FROM fc_located) USING (o_id, d_id, pos)
""")
_fixture("scored_routes", ["fc_located", "fc_packed"], """
SELECT o_id, d_id, edges[s_site + 1:e_site + 1] AS edges, min(traj_id) AS route_id, count(*) AS freq
FROM fc_located JOIN fc_packed USING (traj_id)
GROUP BY 1, 2, 3
""")
_fixture("first_pick", ["scored_routes"], f"""
SELECT o_id, d_id, route_id, trial, edge_id, min(k) AS k
FROM (SELECT o_id, d_id, route_id, trial, k,
             edges[{_H.format(args=f"{PARAMS.seed}, 'p', o_id, d_id, md5(array_to_string(edges, ',')), trial, k")} % len(edges) + 1] AS edge_id
      FROM scored_routes CROSS JOIN (SELECT unnest(range(0, {PARAMS.trials})) AS trial)
                         CROSS JOIN (SELECT unnest(range(1, {PARAMS.max_steps + 1})) AS k))
GROUP BY 1, 2, 3, 4, 5
""")
# The sampled trips that use an edge are a bit string; those left after k picks are the AND of the strings so far.
_NONE = f"CAST(repeat('0', {PARAMS.sample}) AS BIT)"
_fixture("masks", ["samples", "fc_post_e"], f"""
SELECT o_id, d_id, trial, key_id AS edge_id, bit_or(set_bit({_NONE}, CAST(idx AS INTEGER), 1)) AS m
FROM samples JOIN fc_post_e USING (traj_id) GROUP BY 1, 2, 3, 4
""")
_fixture("counts", ["masks", "first_pick"], f"""
SELECT o_id, d_id, route_id, trial,
       CAST(coalesce(min(CASE WHEN remaining <= {PARAMS.end_size} THEN k END), {PARAMS.max_steps}) AS BIGINT) AS cnt
FROM (SELECT o_id, d_id, route_id, trial, k,
             bit_count(bit_and(coalesce(m, {_NONE})) OVER (PARTITION BY o_id, d_id, route_id, trial ORDER BY k)) AS remaining
      FROM first_pick LEFT JOIN masks USING (o_id, d_id, trial, edge_id))
GROUP BY 1, 2, 3, 4
""")
_oracle("trial_samples", ["samples"], "SELECT o_id, d_id, trial, traj_id FROM samples", recursive=True)
_oracle("isolation_counts", ["counts"], "SELECT o_id, d_id, route_id, trial, cnt FROM counts", recursive=True)
_oracle("anomaly_score", ["counts", "scored_routes", "fc_located"], f"""
WITH sizes AS (SELECT o_id, d_id, least(count(*), {PARAMS.sample})::DOUBLE AS n FROM fc_located GROUP BY 1, 2),
     means AS (SELECT o_id, d_id, route_id, avg(cnt) AS m FROM counts GROUP BY 1, 2, 3)
SELECT r.o_id, r.d_id, array_to_string(r.edges, ',') AS path, r.freq,
       round(CASE WHEN n >= 2 THEN pow(2.0::DOUBLE, -(m / (2 * (ln(n - 1) + 0.57721566::DOUBLE) - 2 * (n - 1) / n))) END, 6) AS score
FROM scored_routes r JOIN means USING (o_id, d_id, route_id) JOIN sizes USING (o_id, d_id)
""", recursive=True)

# Storing must not change them.
ORACLE_SQL["load_scored_routes"] = ORACLE_SQL["anomaly_score"]

# --- network ------------------------------------------------------------------------------------

_fixture("duplicates", ["fn_vertices"], """
SELECT vertex_id, min(vertex_id) OVER (PARTITION BY lng, lat) AS canonical_id
FROM fn_vertices QUALIFY count(*) OVER (PARTITION BY lng, lat) > 1
""")
_oracle("duplicate_vertices", ["duplicates"], "SELECT vertex_id, canonical_id FROM duplicates")
_oracle("unify_edges", ["duplicates", "fn_edges"], """
SELECT edge_id, coalesce(a.canonical_id, s_id) AS s_id, coalesce(b.canonical_id, e_id) AS e_id, round(length, 6) AS length
FROM fn_edges LEFT JOIN duplicates a ON a.vertex_id = s_id LEFT JOIN duplicates b ON b.vertex_id = e_id
""")
_oracle("restore_coordinates", ["fb_vertices", "fg_vertices"], """
SELECT traj_id, site, CAST(trunc(lng * 10000000.0::DOUBLE) AS BIGINT) AS x, CAST(trunc(lat * 10000000.0::DOUBLE) AS BIGINT) AS y
FROM fb_vertices JOIN fg_vertices USING (vertex_id)
""")
_oracle("vertex_degree", ["fn_edges"], """
SELECT vertex_id, CAST(sum(i) AS BIGINT) AS in_deg, CAST(sum(o) AS BIGINT) AS out_deg
FROM (SELECT s_id AS vertex_id, 0 AS i, 1 AS o FROM fn_edges UNION ALL SELECT e_id, 1, 0 FROM fn_edges)
GROUP BY vertex_id
""")


def _haversine(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    a = (f"(pow(sin(radians({lat1} - {lat2}) / 2), 2) + cos(radians({lat2})) * cos(radians({lat1}))"
         f" * pow(sin(radians({lng1} - {lng2}) / 2), 2))")
    return f"(6378137.0::DOUBLE * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


def _box(lng: str, lat: str, c_lng: str, c_lat: str) -> str:
    metres = "(24901 * 1609 / 360.0::DOUBLE)"
    h = f"(1 / {metres} * 500)"
    w = f"(1 / ({metres} * cos(radians({c_lat}))) * 500)"
    return (f"({lng} BETWEEN {c_lng} - {w} AND {c_lng} + {w} AND {lat} BETWEEN {c_lat} - {h} AND {c_lat} + {h})")


_fixture("fn_located", ["fn_edges", "fn_vertices"], """
SELECT edge_id, s.lng AS s_lng, s.lat AS s_lat, e.lng AS e_lng, e.lat AS e_lat
FROM fn_edges JOIN fn_vertices s ON s.vertex_id = s_id JOIN fn_vertices e ON e.vertex_id = e_id
""")
_fixture("regions", ["fg_vertices", "fn_vertices"], f"""
SELECT c.vertex_id AS centre_id, v.vertex_id FROM fg_vertices c JOIN fn_vertices v ON {_box("v.lng", "v.lat", "c.lng", "c.lat")}
""")
_oracle("edge_length", ["fn_located"], f"""
SELECT edge_id, round({_haversine("s_lng", "s_lat", "e_lng", "e_lat")}, 6) AS metres FROM fn_located
""")
_oracle("region_vertices", ["regions"], "SELECT centre_id, vertex_id FROM regions")
_oracle("region_edges", ["regions", "fn_edges"], """
SELECT a.centre_id, edge_id FROM fn_edges JOIN regions a ON a.vertex_id = s_id
     JOIN regions b ON b.vertex_id = e_id AND b.centre_id = a.centre_id
""")
_oracle("nearest_edge", ["fp_points", "fn_located"], f"""
WITH d AS (SELECT point_id, edge_id, {_haversine("lng", "lat", "s_lng", "s_lat")} AS a,
                  {_haversine("lng", "lat", "e_lng", "e_lat")} AS b, {_haversine("s_lng", "s_lat", "e_lng", "e_lat")} AS c
           FROM fp_points CROSS JOIN fn_located),
     m AS (SELECT point_id, edge_id,
                  round(CASE WHEN a < 10 OR b < 10 THEN 0 WHEN c < 10 THEN a
                             WHEN a * a >= b * b + c * c THEN b WHEN b * b >= a * a + c * c THEN a
                             ELSE 2 * sqrt(greatest((a + b + c) / 2 * ((a + b + c) / 2 - a) * ((a + b + c) / 2 - b)
                                                    * ((a + b + c) / 2 - c), 0)) / c END, 6) AS metres
           FROM d)
SELECT point_id, edge_id, metres FROM m
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY metres, edge_id) = 1
""")
# 75 halvings, longitude first; each takes the upper half only above the middle.
_oracle("geohash_density", ["fn_vertices"], """
WITH h AS (
  SELECT vertex_id, lng, lat, 0 AS step, -180.0::DOUBLE AS x0, 180.0::DOUBLE AS x1, -90.0::DOUBLE AS y0, 90.0::DOUBLE AS y1,
         0 AS code, '' AS cell
  FROM fn_vertices
  UNION ALL
  SELECT vertex_id, lng, lat, step + 1,
         CASE WHEN step % 2 = 0 AND lng > (x0 + x1) / 2 THEN (x0 + x1) / 2 ELSE x0 END,
         CASE WHEN step % 2 = 0 AND NOT lng > (x0 + x1) / 2 THEN (x0 + x1) / 2 ELSE x1 END,
         CASE WHEN step % 2 = 1 AND lat > (y0 + y1) / 2 THEN (y0 + y1) / 2 ELSE y0 END,
         CASE WHEN step % 2 = 1 AND NOT lat > (y0 + y1) / 2 THEN (y0 + y1) / 2 ELSE y1 END,
         CASE WHEN step % 5 = 4 THEN 0 ELSE bits END,
         CASE WHEN step % 5 = 4 THEN cell || substr('0123456789BCDEFGHJKLMNPQRSTUVWXYZ', bits + 1, 1) ELSE cell END
  FROM (SELECT *, 2 * code + CASE WHEN step % 2 = 0 THEN CAST(lng > (x0 + x1) / 2 AS INTEGER)
                                  ELSE CAST(lat > (y0 + y1) / 2 AS INTEGER) END AS bits FROM h)
  WHERE step < 75
)
SELECT cell, count(*) AS n,
       round(any_value((y0 + y1) / 2 - ((y0 + y1) / 2) % 1e-8::DOUBLE), 6) AS lat,
       round(any_value((x0 + x1) / 2 - ((x0 + x1) / 2) % 1e-8::DOUBLE), 6) AS lng
FROM h WHERE step = 75 GROUP BY cell
""", recursive=True)

# --- stored tables and text ---------------------------------------------------------------------

# Storing must not change them.
for _name, _of in {
    "stored_vertex_index": "vertex_index", "stored_od_routes": "od_routes", "stored_transfer_matrix": "transfer_matrix",
    "length_histogram_lines": "path_length_histogram", "od_unordered_sets": "od_unordered", "trie_growth": "trie_nodes",
    "stored_batches": "trie_merge", "collapse_long_trips": "collapse_repeats", "suffix_min_long_trips": "suffix_min",
    "long_path_vertices": "path_vertices",
}.items():
    ORACLE_SQL[_name] = ORACLE_SQL[_of]

_oracle("postings_of_key", ["fb_post_v"], "SELECT key_id, traj_id, site FROM fb_post_v WHERE key_id = 9")
_oracle("unknown_vertices", ["fb_vertices"], """
SELECT vertex_id, count(*) AS n FROM fb_vertices
WHERE vertex_id NOT IN (SELECT n_nationkey + 1 FROM nation WHERE (n_nationkey + 1) % 2 = 0) GROUP BY vertex_id
""")
_oracle("scored_route_vertices", ["scored_routes"], """
SELECT o_id, d_id, route_id, freq, array_to_string(list_transform(edges, lambda e: e % 1000), ',') AS ends,
       array_to_string(list_append(list_transform(edges, lambda e: e // 1000), edges[len(edges)] % 1000), ',') AS vertices
FROM scored_routes
""")
_oracle("restored_lines", ["fb_vertices", "fg_vertices"], """
SELECT traj_id, site, CAST(trunc(lng * 10000000.0::DOUBLE) AS BIGINT) AS x, CAST(trunc(lat * 10000000.0::DOUBLE) AS BIGINT) AS y,
       CAST(0 AS BIGINT) AS t
FROM fb_vertices JOIN fg_vertices USING (vertex_id)
""")
_oracle("vertex_traj_lines", ["fb_vertices"], "SELECT vertex_id, traj_id FROM fb_vertices")
_oracle("stored_expansions", ["expansions", "fc_routes"], """
WITH every AS (SELECT o_id, d_id, edges, freq FROM fc_routes
               UNION SELECT o_id, d_id, edges, 0 FROM expansions WHERE created)
SELECT v.o_id, v.d_id, array_to_string(v.edges, ',') AS path, CAST(v.freq AS BIGINT) AS freq, x_o_id, x_d_id, x_route_id
FROM every v LEFT JOIN expansions x ON x.o_id = v.o_id AND x.d_id = v.d_id AND x.edges = v.edges
""")
