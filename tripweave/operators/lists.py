"""Id lists of bounded size.

A hot key (a main road, a busy OD pair) can be met by a third of all trips, so one list per key would
not fit a task.  Lists are therefore cut by ranges of the listed id: ``block`` is the id without its low
``block_bits`` bits, and one (key, block) row lists at most ``2 ** block_bits`` different ids however
hot the key is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 12


def block_of(ids: Column, block_bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(ids, block_bits)


def id_blocks(
    df: DataFrame, keys: Sequence[str], id_col: str, list_col: str, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """(keys, block, n, sorted id list); an id must be listed once per key."""
    return (
        df.withColumn("block", block_of(F.col(id_col), block_bits))
        .groupBy(*keys, "block")
        .agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(id_col)).alias(list_col))
    )


def repeated_id_blocks(
    df: DataFrame, keys: Sequence[str], id_col: str, list_col: str, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """(keys, block, n, sorted id list) where an id stands as often as it occurs.

    Repeats are counted with map-side combine first, so a block shuffles each id once.
    """
    counted = df.groupBy(*keys, id_col).agg(F.count(F.lit(1)).alias("_c"))
    items = F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col("_c").alias("c"))))
    blocks = (
        counted.withColumn("block", block_of(F.col(id_col), block_bits))
        .groupBy(*keys, "block")
        .agg(F.sum("_c").cast("bigint").alias("n"), items.alias("_l"))
    )
    ids = F.flatten(F.transform("_l", lambda x: F.array_repeat(x["id"], x["c"].cast("int"))))
    return blocks.select(*keys, "block", "n", ids.alias(list_col))
