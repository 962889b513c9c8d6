"""Contiguous shards of near equal size, from DataFrame functions alone.

Rows are dealt by range of their order into partitions and written.  The totals of the partitions, one row each, give
every partition the size of all that lies before it; a running sum inside each partition then gives every row its place in
the whole.  The whole is cut at equal targets.  No task sees more than a partition, and one row per partition meets in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.session import cut_lineage

SHARDS = 40
#: Bytes that a row costs beside its text.
ROW_BYTES = 16


def text_bytes(text: str = "text") -> Column:
    """Bytes of a text in UTF-8 and ``ROW_BYTES``; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def text_crc32(text: str = "text") -> Column:
    """Unsigned CRC-32 of a text in UTF-8; that of a null text is that of an empty one, 0."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _prefix_sums(rows: DataFrame, order: Sequence[Column], size: Column) -> DataFrame:
    """(row, part, at, size, before, n, total): what lies before each row in bytes and in rows, and the sum of all.

    Rows equal in ``order`` are told apart by their place in the input, so that copies spread over partitions.
    """
    names = [f"k{i}" for i in range(len(order))]
    keyed = rows.select(
        F.struct(*rows.columns).alias("row"), *[c.alias(k) for c, k in zip(order, names)],
        F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"), F.monotonically_increasing_id().alias("at"),
    )
    by = [*names, "at"]
    # written before it is dealt, as dealing by range reads it twice
    ranged = cut_lineage(cut_lineage(keyed).repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_off"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_off"), F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*by)
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = ranged.withColumns({"sum": running, "rank": F.row_number().over(inside)})
    return summed.join(F.broadcast(offsets), "part").select(  # a row per partition
        "row", "size", (F.col("bytes_off") + F.col("sum") - F.col("size")).alias("before"),
        (F.col("rows_off") + F.col("rank") - 1).alias("n"), "total",
    )


def balanced(rows: DataFrame, order: Sequence[Column], size: Column, shards: int = SHARDS) -> DataFrame:
    """``rows`` with ``shard`` (int, 0 to ``shards`` - 1) and ``slot`` (long, 0, 1, ... within each shard).

    Shards are runs of the rows in ``order`` (nulls first); a row belongs to the shard in whose target its middle byte falls,
    so each end of a shard is off its target by half a row at most, and a row longer than a target can leave shards empty.
    A size that is null or negative counts as 0.  Rows equal in ``order`` come in any sequence; copies of a row are separate
    rows.  Columns that are called shard or slot are replaced.  An empty table gives no rows.

    Rows are written with all their columns, so leave out long ones and join the result.  Building it runs jobs.
    """
    rows = rows.drop("shard", "slot")
    sums = _prefix_sums(rows, order, size)
    # twice the middle of a row over twice the sum of all, in decimals as bytes times shards can pass a long
    target = F.expr(f"(2 * cast(before AS decimal(19,0)) + size) * {int(shards)} div nullif(2 * cast(total AS decimal(19,0)), 0)")
    shard = F.least(F.coalesce(target, F.lit(0)), F.lit(shards - 1)).cast("int")
    placed = cut_lineage(sums.select("row", "n", shard.alias("shard")))
    first = placed.groupBy("shard").agg(F.min("n").alias("first"))
    slot = (F.col("n") - F.col("first")).alias("slot")
    return placed.join(F.broadcast(first), "shard").select("row.*", "shard", slot)  # a row per shard
