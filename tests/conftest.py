from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tripweave.session import tune

    s = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield tune(s)
    s.stop()


@pytest.fixture
def rng():
    return random.Random(7)


class Walks:
    """Random trips on a small random network, as Python lists and as frames."""

    def __init__(self, spark, rng, trips=60, vertices=6, longest=9, gap=0.1):
        self.net = {}
        for s in range(1, vertices + 1):
            for e in range(1, vertices + 1):
                if s != e:
                    self.net[s * 100 + e] = (s, e)
        self.edges = {}
        for t in range(1, trips + 1):
            at, path = rng.randint(1, vertices), []
            for _ in range(rng.randint(1, longest)):
                if rng.random() < gap:
                    at = rng.randint(1, vertices)
                nxt = rng.choice([v for v in range(1, vertices + 1) if v != at])
                path.append(at * 100 + nxt)
                at = nxt
            self.edges[t] = path
        self.vertices = {t: [self.net[e][0] for e in p] + [self.net[p[-1]][1]] for t, p in self.edges.items()}
        long = lambda paths: [(t, i, x) for t, p in paths.items() for i, x in enumerate(p)]
        self.traj_edges = spark.createDataFrame(long(self.edges), "traj_id long, site long, edge_id long")
        self.traj_vertices = spark.createDataFrame(long(self.vertices), "traj_id long, site long, vertex_id long")
        self.network = spark.createDataFrame([(e, s, d) for e, (s, d) in self.net.items()], "edge_id long, s_id long, e_id long")
        self.pairs = [(o, d) for o in range(1, vertices + 1) for d in range(1, vertices + 1)]
        self.od = spark.createDataFrame(self.pairs, "o_id long, d_id long")


@pytest.fixture
def walks(spark, rng):
    return Walks(spark, rng)


def rows(df, *columns):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect())
