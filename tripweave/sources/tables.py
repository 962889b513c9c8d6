"""Stored columnar tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_table(spark: SparkSession, path: str, schema: str, absent_is_empty: bool = True) -> DataFrame:
    """Stored table with a fixed schema; a table not written yet is empty, or an error where that is not wanted."""
    if not absent_is_empty:
        return spark.read.schema(schema).parquet(path)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: str, by: str, buckets: int, sort: Sequence[str] = ()) -> DataFrame:
    """The table that ``write_bucketed`` left at ``path``, named anew in this session's catalog."""
    order = ", ".join([by, *sort])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Postings sorted by key, so a filter on key_id skips the row groups of other keys."""
    return read_table(spark, path, schemas.POSTINGS, absent_is_empty=False)


def read_routes(spark: SparkSession, path: str, o_id: int | None = None) -> DataFrame:
    """Stored routes, of one origin or of all; empty where nothing is stored.

    Columns that were not written, such as the score of routes without one, are NULL.
    """
    routes = read_table(spark, path, schemas.SCORED_ROUTES)
    return routes if o_id is None else routes.where(F.col("o_id") == o_id)
