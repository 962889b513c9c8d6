"""Helpers the operators share: text batches, word hashes, whole groups, hot groups and components."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tripweave.session import cut_lineage

#: Python holds this many bytes of text at a time, or one text where that is longer.
BATCH_BYTES = 2 << 20
#: Rows that go to a worker at a time: texts are long, so Spark's default is too many.
ROWS = 2000
_ROOT = str(Path(__file__).resolve().parents[2])
_TABLE = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def remainder(column: str, m: int):
    """crc32 of the id as text, modulo ``m``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def slices(batch: pa.RecordBatch, column: str, size: int = BATCH_BYTES):
    """``batch`` cut by rows so that ``column`` holds about ``size`` bytes in each piece."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def ship(spark) -> None:
    """Let Python workers find this package where the driver has it, and send them fewer rows at a time.

    That holds on one machine and where all machines have the same path; elsewhere ship it with --py-files.
    """
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), _ROOT]))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, fn, ddl: str, column: str = "text") -> DataFrame:
    """``fn(batch) -> dict of columns`` over bounded batches of rows."""
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_pydict(fn(part), schema=schema)

    return map_arrow(df, run, ddl)


def map_groups(df: DataFrame, group: str, fn, ddl: str, rows: int = 20_000, size: int = 32 << 20) -> DataFrame:
    """``fn(table, first) -> dict of columns`` over pieces that hold whole groups, a group's rows side by side.

    ``group`` is a long, ``first`` has the place of each group's first row.  No group may grow with the
    input: see :func:`split_groups`.
    """
    schema = arrow_schema(ddl)

    def work(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        key = np.asarray(t.column(group))
        return pa.RecordBatch.from_pydict(fn(t, np.flatnonzero(np.r_[True, key[1:] != key[:-1]])), schema=schema)

    def run(batches):
        held, n, b = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n, b = n + batch.num_rows, b + batch.nbytes
            if n < rows and b < size:
                continue
            whole = pa.Table.from_batches(held)
            key = np.asarray(whole.column(group))
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield work(whole.slice(0, cut).to_batches())
                held = whole.slice(cut).to_batches()
                n, b = whole.num_rows - cut, sum(x.nbytes for x in held)
        if n:
            yield work(held)

    return map_arrow(df.repartition(group).sortWithinPartitions(group), run, ddl)


def split_groups(df: DataFrame, group: str, member: str, limit: int, sizes: DataFrame | None = None) -> DataFrame:
    """Deal groups of two rows or more into bounded groups in which every two rows of a group meet once.

    A group of n rows gets ceil(n / limit) salts and one new group for every two of them: column ``sub``.
    ``side`` is 0 or 1; where ``cross`` holds, only rows of different sides are to be compared.
    ``sizes`` (group, _n), if known already, spares counting them.
    """
    if sizes is None:
        sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.filter("_n > 1")
    salts = F.ceil(F.col("_n") / F.lit(limit)).cast("int")
    return (
        df.join(sizes, group)
        .withColumn("_salts", salts)
        .withColumn("_salt", F.pmod(F.xxhash64(member), F.col("_salts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
        .withColumn("sub", F.xxhash64(group, F.least("_salt", "_other"), F.greatest("_salt", "_other")))
        .withColumn("side", F.when(F.col("_salt") <= F.col("_other"), 0).otherwise(1))
        .withColumn("cross", F.col("_salt") != F.col("_other"))
        .drop("_n", "_salts", "_salt", "_other", group)
    )


def pairs_of(first: np.ndarray, n: int, side: np.ndarray, cross: np.ndarray, most: int = 1 << 19):
    """Places (i, j), i < j, of the rows to compare in each group, in pieces of about ``most`` pairs."""
    end = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    later = end - np.arange(n) - 1
    total = np.cumsum(later)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        count = later[at:to]
        i = np.repeat(np.arange(at, to), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        use = ~cross[i] | (side[i] != side[j])
        yield i[use], j[use]
        at = to


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest place it is joined with by the pairs, itself included."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, ``n`` at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = tuple(
                np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)])
                for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))
            )
    return _powers


def prefix_hashes(a: np.ndarray) -> np.ndarray:
    up, _ = powers(len(a) + 1)
    return np.r_[np.uint64(0), np.cumsum(_TABLE[a] * up[: len(a)])]


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from ``start`` to ``end``."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, cut at ASCII white space, and the place of each text's first word, plus the end."""
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = _SPACE[a]
    start = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    end = np.flatnonzero(gap & np.r_[False, ~gap[:-1]])
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return range_hashes(prefix_hashes(a), start, end), np.searchsorted(start, begin)


def runs(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and the place of each text's first run; a shorter text is one run."""
    count = np.diff(first)
    long = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.r_[0, np.cumsum(long)]
    start = np.repeat(first[:-1] - at[:-1], long) + np.arange(at[-1])
    stop = np.repeat(first[1:], long)
    out = np.zeros(at[-1], np.uint64)
    for k in range(n):
        there = start + k < stop
        w = words[np.minimum(start + k, max(len(words) - 1, 0))] if len(words) else out
        out = np.where(there, mix(out * np.uint64(_BASE) + w), out)
    return out, at


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected ``edges`` (a long, b long): nodes that are joined share a root.

    Each round every node joins the neighbour that a hash puts first, which leaves a fraction of the nodes;
    rounds follow until no edge is left, so their number is about the logarithm of the longest path.
    """
    spark = edges.sparkSession
    left = cut_lineage(edges.filter("a <> b").distinct())
    names = None
    turn = 0
    while left.take(1):
        turn += 1
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("x"))  # noqa: E731, B023
        step = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(order("b")), F.first(order("a")))["x"].alias("to"))
        step = cut_lineage(step)
        one, two = (step.select(F.col("node").alias(k), F.col("to").alias(f"{k}_to")) for k in "ab")
        left = cut_lineage(left.join(one, "a").join(two, "b").filter("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct())
        if names is None:
            names = step.withColumnRenamed("to", "root")
        else:
            later = step.select(F.col("node").alias("root"), "to")
            names = names.join(later, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return names if names is not None else spark.createDataFrame([], "node long, root long")
