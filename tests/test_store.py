from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import Walks, rows
from tripweave.operators import routes
from tripweave.sinks import tables as sink
from tripweave.sources import tables
from tripweave.sources import text as src
from tripweave.streaming import route_store
from tripweave.streaming.commit_log import CommitLog

COLUMNS = ["o_id", "d_id", "edges", "route_id", "freq"]


def test_batches_add_up_and_reruns_do_not(spark, walks, tmp_path):
    folder = f"{tmp_path}/store"
    assert route_store.read_store(spark, folder).count() == 0
    trips = routes.trip_routes(walks.traj_edges, walks.network)
    want = rows(routes.merge_routes(trips), *COLUMNS)
    for batch, part in enumerate(["route_id <= 20", "route_id BETWEEN 21 AND 40", "route_id > 40"]):
        route_store.write_batch(trips.where(part), folder, batch)
    route_store.write_batch(trips.where("route_id <= 20"), folder, 0)
    assert rows(route_store.read_store(spark, folder), *COLUMNS) == want
    route_store.compact(spark, folder, f"{tmp_path}/compacted")
    assert rows(route_store.read_store(spark, f"{tmp_path}/compacted"), *COLUMNS) == want


def test_micro_batches_of_trip_lines(spark, rng, tmp_path):
    walks = Walks(spark, rng, gap=0.0)
    lines = [(f"{t}," + ",".join(f"x|{e}" for e in p),) for t, p in walks.edges.items()]

    def parse(batch):
        trips = src.parse_edge_trajectories(batch, min_samples=1, min_edges=0)
        return trips.select("traj_id", F.posexplode("edges").alias("site", "edge_id"))

    write = route_store.batch_writer(f"{tmp_path}/store", walks.network, parse)
    for i in (0, 1, 1, 2):
        write(spark.createDataFrame(lines[i::3], "value string"), i)
    want = routes.merge_routes(routes.trip_routes(walks.traj_edges, walks.network))
    assert rows(route_store.read_store(spark, f"{tmp_path}/store"), *COLUMNS) == rows(want, *COLUMNS)


def test_readers_see_whole_batches(spark, walks, tmp_path, monkeypatch):
    """A reader that began before a batch is written again keeps the old one; a write that fails midway changes nothing."""
    folder = f"{tmp_path}/store"
    trips = routes.trip_routes(walks.traj_edges, walks.network)
    first, second = trips.where("route_id <= 20"), trips.where("route_id > 20")
    route_store.write_batch(first, folder, 0)
    before, old = route_store.read_store(spark, folder), rows(routes.merge_routes(first), *COLUMNS)
    route_store.write_batch(second, folder, 0)
    new = rows(routes.merge_routes(second), *COLUMNS)
    assert rows(before, *COLUMNS) == old and rows(route_store.read_store(spark, folder), *COLUMNS) == new

    monkeypatch.setattr(CommitLog, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        route_store.write_batch(first, folder, 0)
    monkeypatch.undo()
    assert rows(route_store.read_store(spark, folder), *COLUMNS) == new

    log = CommitLog(spark, folder)
    with open(f"{folder}/commits/{log._numbers()[-1] + 1:010d}", "w") as cut_off:
        cut_off.write("7\tsomewhere\n")
    assert rows(route_store.read_store(spark, folder), *COLUMNS) == new
    route_store.write_batch(first, folder, 1)
    assert rows(route_store.read_store(spark, folder), *COLUMNS) == rows(routes.merge_routes(trips), *COLUMNS)
    assert log.vacuum() == 2 and rows(route_store.read_store(spark, folder), *COLUMNS) == rows(routes.merge_routes(trips), *COLUMNS)


def test_another_writer_may_come_first(spark, tmp_path):
    one, two = CommitLog(spark, f"{tmp_path}/log"), CommitLog(spark, f"{tmp_path}/log")
    tries = []

    def change(live):
        tries.append(dict(live))
        if len(tries) == 1:
            two.publish(lambda live: {**live, "5": "b"})
        return {**live, "4": "a"}

    one.publish(change)
    assert tries == [{}, {"5": "b"}] and two.live() == {"5": "b", "4": "a"}


def test_compaction_under_readers(spark, walks, tmp_path):
    folder = f"{tmp_path}/store"
    trips = routes.trip_routes(walks.traj_edges, walks.network)
    want = rows(routes.merge_routes(trips), *COLUMNS)
    for batch in range(4):
        route_store.write_batch(trips.where(f"route_id % 4 = {batch}"), folder, batch)
    before = route_store.read_store(spark, folder)
    route_store.compact_in_place(spark, folder)
    assert set(CommitLog(spark, folder).live()) == {"0,1,2", "3"}
    route_store.write_batch(trips.where("route_id % 4 = 1"), folder, 1)
    route_store.write_batch(trips.where("route_id % 4 = 3"), folder, 3)
    assert rows(before, *COLUMNS) == want == rows(route_store.read_store(spark, folder), *COLUMNS)


def test_scores_are_read_back(spark, walks, tmp_path):
    merged = routes.merge_routes(routes.trip_routes(walks.traj_edges, walks.network))
    scored = merged.withColumn("score", F.col("route_id") / 100.0)
    sink.write_routes(scored, f"{tmp_path}/scored")
    sink.write_routes(merged, f"{tmp_path}/plain")
    columns = [*COLUMNS, "vertices", "ends", "score"]
    assert rows(tables.read_routes(spark, f"{tmp_path}/scored"), *columns) == rows(scored, *columns)
    plain = tables.read_routes(spark, f"{tmp_path}/plain")
    assert rows(plain, *COLUMNS) == rows(merged, *COLUMNS) and plain.where("score IS NOT NULL").isEmpty()
    assert tables.read_routes(spark, f"{tmp_path}/none").isEmpty()
