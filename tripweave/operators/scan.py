"""Scans along trips in two passes, for trips too long for one task.

A trip is cut into ranges of ``segment`` sites.  The first pass works inside each range, which a task holds; a row per
range then carries what the next ranges need to know, and the second pass puts it in.  So a trip spreads over as
many tasks as it has ranges, and only one row per range of a trip meets in one.

The functions in :mod:`.paths` do the same with one window per trip, which is less work where trips are short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .paths import FAR

#: Sites of a range.
SEGMENT = 1 << 16
_RANGE = ["traj_id", "_range"]


def _ranges(seq: DataFrame, segment: int) -> DataFrame:
    return seq.withColumn("_range", F.floor(F.col("site") / segment))


def _before(ascending: bool = True) -> Window:
    """All ranges of the trip before this one, or after it."""
    order = F.col("_range") if ascending else F.col("_range").desc()
    return Window.partitionBy("traj_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def collapse_repeats(seq: DataFrame, id_col: str = "vertex_id", segment: int = SEGMENT) -> DataFrame:
    """``paths.collapse_repeats`` of numbered visits (traj_id, site, id): drop those equal to the one just before (O1)."""
    rows = _ranges(seq.select("traj_id", "site", id_col), segment)
    inside = Window.partitionBy(*_RANGE).orderBy("site")
    prev = F.lag(id_col).over(inside)
    # the first visit of a range is settled by the second pass
    kept = rows.withColumns({"_first": F.row_number().over(inside) == 1, "_new": F.when(prev.isNull() | (prev != F.col(id_col)), 1).otherwise(0)})
    kept = kept.withColumn("_kept", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = rows.groupBy(*_RANGE).agg(F.min_by(id_col, "site").alias("_head"), F.max_by(id_col, "site").alias("_tail"))
    counts = kept.groupBy(*_RANGE).agg(F.sum("_new").alias("_n"))
    along = Window.partitionBy("traj_id").orderBy("_range")
    met = ends.join(counts, _RANGE).withColumn("_again", F.coalesce(F.lag("_tail").over(along) == F.col("_head"), F.lit(False)).cast("int"))
    carried = met.select(*_RANGE, "_again", F.coalesce(F.sum(F.col("_n") - F.col("_again")).over(_before()), F.lit(0)).alias("_off"))
    return (
        kept.where("_new = 1").join(carried, _RANGE).where("NOT (_first AND _again = 1)")
        .select("traj_id", (F.col("_off") + F.col("_kept") - F.col("_again") - 1).cast("bigint").alias("site"), id_col)
    )


def suffix_min(traj_edges: DataFrame, distances: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``paths.suffix_min``: smallest distance over each edge and everything after it on the trip."""
    rows = _ranges(traj_edges.join(distances.select("edge_id", "dist"), "edge_id", "left"), segment)
    inside = Window.partitionBy(*_RANGE).orderBy(F.col("site").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = rows.withColumn("_low", F.min("dist").over(inside))
    least = rows.groupBy(*_RANGE).agg(F.min("dist").alias("_least"))
    carried = least.select(*_RANGE, F.min("_least").over(_before(ascending=False)).alias("_later"))
    # least() passes over NULLs
    return low.join(carried, _RANGE).select("traj_id", "site", "edge_id", F.least(F.lit(FAR), F.col("_low"), F.col("_later")).alias("dist"))


def vertex_path(traj_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """``paths.vertex_path``: the start of every edge, then the end of the last one (O3), by counts per trip that combine
    before the shuffle; a trip with an edge that the network lacks is left out whole."""
    ends = traj_edges.join(edges.select("edge_id", "s_id", "e_id"), "edge_id", "left")
    known = F.col("s_id").isNotNull() & F.col("e_id").isNotNull()
    whole = ends.groupBy("traj_id").agg(F.min(known).alias("_known"), F.max("site").alias("_last")).where("_known").drop("_known")
    here = F.struct(F.col("site"), F.col("s_id").alias("vertex_id"))
    after = F.struct((F.col("site") + 1).alias("site"), F.col("e_id").alias("vertex_id"))
    both = F.when(F.col("site") == F.col("_last"), F.array(here, after)).otherwise(F.array(here))
    return ends.join(whole, "traj_id").select("traj_id", F.inline(both))
