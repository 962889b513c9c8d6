"""A stored route table that grows by batches of new trips.

Every batch keeps its own merged routes in its own folder, and a commit (:mod:`.commit_log`) names the folders that count.
Writing a batch again publishes a new folder in place of the old one, so a rerun never counts twice, a write that fails
midway changes nothing, and a reader has the old batch or the new one, whole.  Adding a batch costs only that
batch.  Reading adds the batches up.  Route ids are trip ids, so batches cannot give one id to two routes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..operators.routes import merge_routes, trip_routes
from .commit_log import CommitLog, Live


def _write(routes: DataFrame, log: CommitLog) -> str:
    name = log.new_name()
    merge_routes(routes).select(*read_columns()).write.parquet(log.data_path(name))
    return name


def _holder(live: Live, batch_id: int) -> str | None:
    """The entry of ``live`` that holds the batch: its own, or one of several that were put together."""
    return next((k for k in live if str(int(batch_id)) in k.split(",")), None)


def write_batch(new_routes: DataFrame, folder: str, batch_id: int) -> None:
    """Store one batch of routes, replacing an earlier try of the same batch.

    A batch that :func:`compact_in_place` has put together with others is stored for good and left as it is.
    """
    log, key = CommitLog(new_routes.sparkSession, folder), str(int(batch_id))
    name = _write(new_routes, log)
    log.publish(lambda live: live if _holder(live, batch_id) not in (None, key) else {**live, key: name})


def read_columns() -> list[str]:
    return [part.split()[0] for part in schemas.ROUTES.split(", ")]


def _read(spark: SparkSession, log: CommitLog, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], schemas.ROUTES)
    return merge_routes(spark.read.schema(schemas.ROUTES).parquet(*map(log.data_path, names)))


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """All stored routes with their summed frequencies, as they stand now; empty where nothing is stored."""
    log = CommitLog(spark, folder)
    return _read(spark, log, list(log.live().values()))


def compact(spark: SparkSession, folder: str, target: str, batch_id: int = -1) -> None:
    """A new store at ``target`` with everything in one batch."""
    write_batch(read_store(spark, folder), target, batch_id)


def compact_in_place(spark: SparkSession, folder: str) -> None:
    """Put all batches but the last together, while others may read and add batches.

    The last batch stays by itself, since a stream may write it again.  The folders that no longer count stay until
    ``CommitLog.vacuum``.
    """
    log = CommitLog(spark, folder)
    live = log.live()
    last = max((int(b) for k in live for b in k.split(",")), default=None)
    old = {k: v for k, v in live.items() if k != str(last)}
    if len(old) < 2:
        return
    name = _write(_read(spark, log, list(old.values())), log)

    def change(now: Live) -> Live:
        if any(now.get(k) != v for k, v in old.items()):  # written again meanwhile: another time
            return now
        return {",".join(old): name, **{k: v for k, v in now.items() if k not in old}}

    log.publish(change)


def batch_writer(folder: str, edges: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Function for ``writeStream.foreachBatch``: each micro-batch of whole trips becomes one stored batch.

    ``parse`` turns the micro-batch into (traj_id, site, edge_id) rows; a trip is one input record, so it
    never spans two batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(trip_routes(parse(batch), edges), folder, batch_id)

    return write
