"""Text layouts.

Every layout has a parser from a frame with one ``value`` column and a reader from a path.  A line whose
numbers cannot be read is left out; ``rejected=True`` gives exactly those lines instead, as ``value``, and
:func:`read_once` gives both from one pass.  Lines that a layout's own length rule filters out are neither.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import collapse
from ..session import cut_lineage

#: A parser's ``rejected`` for the rows it reads and a row for each line it cannot read, told by ``_LINE``.
BOTH = "both"
_LINE = "_rejected"

# The layouts' thresholds and patterns.
MIN_SAMPLES = 10
MIN_EDGES = 10
MIN_COUNT = 10
OD_COUNT_LINE = r"^\(\(([0-9]+),([0-9]+)\),([0-9]+)\)$"
OD_TRAJS_LINE = r"^\(([0-9]+),\(\(([0-9]+),([0-9]+)\),CompactBuffer\((.*)\)\)\)$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _fields(separator: str) -> Column:
    """Fields of a line; empty fields at its end do not count."""
    return F.split(F.rtrim(F.col("value"), F.lit(separator)), f"[{separator}]")


def _long(x: Column) -> Column:
    return x.try_cast("bigint")


def _double(x: Column) -> Column:
    return x.try_cast("double")


def _longs(xs: Column) -> Column:
    return F.transform(xs, _long)


def _whole(xs: Column) -> Column:
    return ~F.exists(xs, lambda x: x.isNull())


def _every(i: Column, start: int) -> Column:
    return (i >= start) & (i % 2 == start % 2)


def _split_rejected(parsed: DataFrame, ok: Column, rejected: bool | str, *columns: str) -> DataFrame:
    ok = F.coalesce(ok, F.lit(False))
    if rejected == BOTH:
        # a rejected line keeps the line alone
        return parsed.withColumn("_ok", ok).select(*(F.when(F.col("_ok"), F.col(c)).alias(c) for c in columns), F.when(~F.col("_ok"), F.struct("value")).alias(_LINE))
    return parsed.where(~ok).select("value") if rejected else parsed.where(ok).select(*columns)


def _marks(rejected: bool | str) -> list[str]:
    return [_LINE] if rejected == BOTH else []


def _filled(rows: DataFrame, column: str, rejected: bool | str) -> DataFrame:
    """``rows`` that have ``column``, and the rejected lines among them."""
    there = F.col(column).isNotNull()
    return rows.where(there | F.col(_LINE).isNotNull() if rejected == BOTH else there)


def read_once(parse: Callable[..., DataFrame], lines: DataFrame, seen: Observation | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """What ``parse(lines)`` and ``parse(lines, rejected=True)`` give, from one pass over ``lines``.

    The pass writes both to one table (see ``cut_lineage``) and runs at once.  ``seen`` counts the rows as ``kept``
    and the lines that could not be read as ``rejected``.
    """
    both = parse(lines, rejected=BOTH, **how)
    if seen is not None:
        both = both.observe(seen, F.count_if(F.col(_LINE).isNull()).alias("kept"), F.count(_LINE).alias("rejected"))
    both = cut_lineage(both)
    return both.where(F.col(_LINE).isNull()).drop(_LINE), both.where(F.col(_LINE).isNotNull()).select(f"{_LINE}.value")


def parse_edge_trajectories(
    lines: DataFrame, min_samples: int = MIN_SAMPLES, min_edges: int = MIN_EDGES, rejected: bool | str = False
) -> DataFrame:
    """``traj_id,<x>|edge_id[|...],...`` to (traj_id, edges).

    Keeps lines with more than ``min_samples`` fields, collapses repeats of an edge, then keeps paths of
    more than ``min_edges`` edges.  Edge id 0 in front of a path vanishes, as if the vehicle had been on
    edge 0 before.
    """
    rows = lines.select("value", _fields(",").alias("_f")).where(F.size("_f") > min_samples)
    sample = F.slice("_f", 2, F.size("_f"))
    raw = F.transform(sample, lambda x: _long(F.split_part(x, F.lit("|"), F.lit(2))))
    parsed = rows.select("value", _long(F.get("_f", F.lit(0))).alias("traj_id"), raw.alias("_raw"))
    ok = F.col("traj_id").isNotNull() & _whole(F.col("_raw"))
    good = _split_rejected(parsed, ok, rejected, "traj_id", "_raw")
    if rejected is True:
        return good
    path = collapse(F.col("_raw"), before=F.lit(0))
    found = good.select("traj_id", path.alias("edges"), *_marks(rejected))
    long = F.size("edges") > min_edges
    return found.where(long | F.col(_LINE).isNotNull() if rejected == BOTH else long)


def _counted_rows(lines: DataFrame, min_count: int) -> DataFrame:
    rows = lines.select("value", _fields(",").alias("_f"))
    return rows.select(
        "value", "_f", _long(F.get("_f", F.lit(0))).alias("traj_id"), _long(F.get("_f", F.lit(1))).alias("_n")
    ).where(F.col("_n").isNull() | (F.col("_n") > min_count))


def parse_timed_trajectories(lines: DataFrame, min_count: int = MIN_COUNT, rejected: bool | str = False) -> DataFrame:
    """``traj_id,n,v1,t1,v2,t2,...`` to (traj_id, site, vertex_id, t).

    Keeps lines whose declared count n is more than ``min_count``, whatever their real length.
    """
    parsed = _counted_rows(lines, min_count)
    ids = _longs(F.filter("_f", lambda x, i: _every(i, 2)))
    times = _longs(F.filter("_f", lambda x, i: _every(i, 3)))
    parsed = parsed.withColumn("_v", ids).withColumn("_t", times)
    ok = F.col("traj_id").isNotNull() & F.col("_n").isNotNull() & _whole(F.col("_v")) & _whole(F.col("_t"))
    good = _split_rejected(parsed, ok, rejected, "traj_id", "_v", "_t")
    if rejected is True:
        return good
    points = good.select("traj_id", F.posexplode_outer(F.arrays_zip("_v", "_t")).alias("site", "_p"), *_marks(rejected))
    return _filled(points, "site", rejected).select(
        "traj_id", F.col("site").cast("bigint").alias("site"), F.col("_p._v").alias("vertex_id"), F.col("_p._t").alias("t"), *_marks(rejected)
    )


def parse_vertex_trajectories(lines: DataFrame, min_count: int = MIN_COUNT, rejected: bool | str = False) -> DataFrame:
    """``traj_id,n,v1,v2,...`` to (traj_id, vertices) (S3); the same declared-count rule."""
    parsed = _counted_rows(lines, min_count).withColumn("vertices", _longs(F.slice("_f", 3, F.size("_f"))))
    ok = F.col("traj_id").isNotNull() & F.col("_n").isNotNull() & _whole(F.col("vertices"))
    return _split_rejected(parsed, ok, rejected, "traj_id", "vertices")


def parse_od_endpoints(lines: DataFrame, rejected: bool | str = False) -> DataFrame:
    """First and last vertex straight from vertex lines, without a length rule."""
    parsed = lines.select("value", _fields(",").alias("_f")).select(
        "value",
        _long(F.get("_f", F.lit(0))).alias("traj_id"),
        _long(F.get("_f", F.lit(2))).alias("o_id"),
        _long(F.element_at("_f", -1)).alias("d_id"),
    )
    return _split_rejected(parsed, F.col("o_id").isNotNull() & F.col("d_id").isNotNull(), rejected, "traj_id", "o_id", "d_id")


def parse_vertices(lines: DataFrame, lat_first: bool = False, rejected: bool | str = False) -> DataFrame:
    """``id<TAB>lng<TAB>lat`` (S4), or with latitude first (S5), to (vertex_id, lng, lat)."""
    lng, lat = (2, 1) if lat_first else (1, 2)
    f = F.split("value", "\t")
    parsed = lines.select(
        "value",
        _long(F.get(f, F.lit(0))).alias("vertex_id"),
        _double(F.get(f, F.lit(lng))).alias("lng"),
        _double(F.get(f, F.lit(lat))).alias("lat"),
    )
    ok = F.col("vertex_id").isNotNull() & F.col("lng").isNotNull() & F.col("lat").isNotNull()
    return _split_rejected(parsed, ok, rejected, "vertex_id", "lng", "lat")


def parse_edges(lines: DataFrame, with_length: bool = False, rejected: bool | str = False) -> DataFrame:
    """``edge_id<TAB>s_id<TAB>e_id[<TAB>length]`` (S6, S7); length is NULL unless asked for."""
    f = F.split("value", "\t")
    length = _double(F.get(f, F.lit(3))) if with_length else F.lit(None).cast("double")
    parsed = lines.select(
        "value",
        *[_long(F.get(f, F.lit(i))).alias(c) for i, c in enumerate(["edge_id", "s_id", "e_id"])],
        length.alias("length"),
    )
    ok = F.col("edge_id").isNotNull() & F.col("s_id").isNotNull() & F.col("e_id").isNotNull()
    if with_length:
        ok = ok & F.col("length").isNotNull()
    return _split_rejected(parsed, ok, rejected, "edge_id", "s_id", "e_id", "length")


def parse_index(lines: DataFrame, rejected: bool | str = False) -> DataFrame:
    """``key|traj,site,traj,site,...`` to postings.

    A key may have several lines, and an empty list gives no rows.
    """
    parsed = lines.select(
        "value",
        _long(F.split_part("value", F.lit("|"), F.lit(1))).alias("key_id"),
        F.filter(F.split(F.split_part("value", F.lit("|"), F.lit(2)), ","), lambda x: x != "").alias("_f"),
    ).withColumn("_x", _longs(F.col("_f")))
    ok = F.col("key_id").isNotNull() & _whole(F.col("_x")) & (F.size("_x") % 2 == 0)
    good = _split_rejected(parsed, ok, rejected, "key_id", "_x")
    if rejected is True:
        return good
    trajs = F.filter("_x", lambda x, i: i % 2 == 0)
    sites = F.filter("_x", lambda x, i: i % 2 == 1)
    visits = good.select("key_id", trajs.alias("traj_id"), sites.alias("site"), *_marks(rejected)).select(
        "key_id", F.inline_outer(F.arrays_zip("traj_id", "site")), *_marks(rejected)
    )
    return _filled(visits, "traj_id", rejected)


def parse_posting_lines(lines: DataFrame, rejected: bool | str = False) -> DataFrame:
    """``traj,site`` lines of one key's file to (traj_id, site) plus any other columns."""
    f = F.split(F.trim("value"), ",")
    others = [c for c in lines.columns if c != "value"]
    parsed = lines.select("*", _long(F.get(f, F.lit(0))).alias("traj_id"), _long(F.get(f, F.lit(1))).alias("site"))
    ok = F.col("traj_id").isNotNull() & F.col("site").isNotNull()
    return _split_rejected(parsed, ok, rejected, *others, "traj_id", "site")


def read_posting_files(spark: SparkSession, folder: str, key_id: int | None = None) -> DataFrame:
    """Postings from ``<folder>/<key>.txt`` (S9): of one key, or of every file with the key from its name."""
    path = f"{folder}/{'*' if key_id is None else key_id}.txt"
    key = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.txt$", 1).cast("bigint")
    return parse_posting_lines(spark.read.text(path).select("value", key.alias("key_id")))


def parse_od_counts(lines: DataFrame, rejected: bool | str = False) -> DataFrame:
    """``((o,d),n)`` to (o_id, d_id, n)."""
    parsed = lines.select(
        "value",
        *[_long(F.regexp_extract("value", OD_COUNT_LINE, g)).alias(c) for g, c in [(1, "o_id"), (2, "d_id"), (3, "n")]],
    )
    return _split_rejected(parsed, F.col("n").isNotNull(), rejected, "o_id", "d_id", "n")


def parse_od_trajs(lines: DataFrame, rejected: bool | str = False) -> DataFrame:
    """``(n,((o,d),CompactBuffer(t1, t2)))`` to (o_id, d_id, traj_id) rows."""
    parsed = lines.select(
        "value",
        _long(F.regexp_extract("value", OD_TRAJS_LINE, 2)).alias("o_id"),
        _long(F.regexp_extract("value", OD_TRAJS_LINE, 3)).alias("d_id"),
        _longs(F.split(F.regexp_extract("value", OD_TRAJS_LINE, 4), ", ")).alias("_t"),
    )
    ok = F.col("o_id").isNotNull() & F.col("d_id").isNotNull() & _whole(F.col("_t"))
    good = _split_rejected(parsed, ok, rejected, "o_id", "d_id", "_t")
    if rejected is True:
        return good
    return _filled(good.select("o_id", "d_id", F.explode_outer("_t").alias("traj_id"), *_marks(rejected)), "traj_id", rejected)


def parse_od_routes(lines: DataFrame, rejected: bool | str = False) -> DataFrame:
    """``((o,d),n_routes,(freq,edge_id:e1,e2,...))`` to (o_id, d_id, n_routes, freq, edges) (K5)."""
    g = lambda i: F.regexp_extract("value", r"^\(\((-?\d+),(-?\d+)\),(\d+),\((\d+),edge_id:([-\d,]*)\)\)$", i)
    ids = F.filter(F.split(g(5), ","), lambda x: x != "")
    parsed = lines.select("value", *[_long(g(i)).alias(c) for i, c in enumerate(("o_id", "d_id", "n_routes", "freq"), 1)], _longs(ids).alias("edges"))
    return _split_rejected(parsed, F.col("freq").isNotNull() & _whole(F.col("edges")), rejected, "o_id", "d_id", "n_routes", "freq", "edges")


def parse_restored(lines: DataFrame, rejected: bool | str = False) -> DataFrame:
    """``traj_id,x|y|0|t|0,...`` to (traj_id, site, x, y, t) (K7); sites are numbered anew."""
    f = F.split("value", ",")
    point = F.transform(F.slice(f, F.lit(2), F.size(f)), lambda p: F.transform(F.split(p, "[|]"), _long))
    parsed = lines.select("value", _long(F.get(f, F.lit(0))).alias("traj_id"), point.alias("_p"))
    ok = F.col("traj_id").isNotNull() & ~F.exists("_p", lambda p: (F.size(p) != 5) | F.exists(p, lambda x: x.isNull()))
    good = _split_rejected(parsed, ok, rejected, "traj_id", "_p")
    if rejected is True:
        return good
    points = good.select("traj_id", F.posexplode_outer("_p").alias("site", "_p"), *_marks(rejected))
    values = [F.get("_p", F.lit(i)).alias(c) for i, c in ((0, "x"), (1, "y"), (3, "t"))]
    return _filled(points, "site", rejected).select("traj_id", F.col("site").cast("bigint").alias("site"), *values, *_marks(rejected))


def parse_counted_routes(lines: DataFrame, rejected: bool | str = False) -> DataFrame:
    """``(o,d)|path,freq[x_o,x_d,x_route|...]`` to (o_id, d_id, edges, freq, x_o_id, x_d_id, x_route_id) (K9).

    A route without expansions has one row with NULLs.
    """
    g = lambda i: F.regexp_extract("value", r"^\((-?\d+),(-?\d+)\)\|([-\d,]*),(\d+)\[([-\d,|]*)\]$", i)
    ids = F.filter(F.split(g(3), ","), lambda x: x != "")
    items = F.transform(F.filter(F.split(g(5), "[|]"), lambda x: x != ""), lambda x: F.transform(F.split(x, ","), _long))
    parsed = lines.select("value", *[_long(g(i)).alias(c) for i, c in ((1, "o_id"), (2, "d_id"), (4, "freq"))], _longs(ids).alias("edges"), items.alias("_x"))
    ok = F.col("freq").isNotNull() & _whole(F.col("edges")) & ~F.exists("_x", lambda x: (F.size(x) != 3) | F.exists(x, lambda v: v.isNull()))
    good = _split_rejected(parsed, ok, rejected, "o_id", "d_id", "edges", "freq", "_x")
    if rejected is True:
        return good
    return good.select("o_id", "d_id", "edges", "freq", F.explode_outer("_x").alias("_x"), *_marks(rejected)).select(
        "o_id", "d_id", "edges", "freq", *[F.get("_x", F.lit(i)).alias(c) for i, c in enumerate(("x_o_id", "x_d_id", "x_route_id"))], *_marks(rejected)
    )


def parse_vertex_trajs(lines: DataFrame, rejected: bool | str = False) -> DataFrame:
    """``vertex|t1,t2,`` to (vertex_id, traj_id), a row for each visit."""
    ids = F.filter(F.split(F.split_part("value", F.lit("|"), F.lit(2)), ","), lambda x: x != "")
    parsed = lines.select("value", _long(F.split_part("value", F.lit("|"), F.lit(1))).alias("vertex_id"), _longs(ids).alias("_t"))
    good = _split_rejected(parsed, F.col("vertex_id").isNotNull() & _whole(F.col("_t")), rejected, "vertex_id", "_t")
    if rejected is True:
        return good
    return _filled(good.select("vertex_id", F.explode_outer("_t").alias("traj_id"), *_marks(rejected)), "traj_id", rejected)


def parse_histogram(lines: DataFrame, rejected: bool | str = False) -> DataFrame:
    """``(n_edges,n)`` to (n_edges, n)."""
    g = lambda i: _long(F.regexp_extract("value", r"^\((\d+),(\d+)\)$", i))
    return _split_rejected(lines.select("value", g(1).alias("n_edges"), g(2).alias("n")), F.col("n").isNotNull(), rejected, "n_edges", "n")


def parse_transfer_matrix(lines: DataFrame, *keys: str) -> DataFrame:
    """``s_id,e_id,edge_id,num`` rows of one destination, as the matrix sink writes them, beside the columns ``keys``."""
    f = F.split("value", ",")
    return lines.select(*keys, *[_long(F.get(f, F.lit(i))).alias(c) for i, c in enumerate(["s_id", "e_id", "edge_id", "num"])])
