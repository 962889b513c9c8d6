"""Near copies among vectors: a subspace pigeonhole join.

Unit vectors of cosine c or more are at squared distance 2 - 2c or less.  After a rotation that spreads every
vector evenly over its coordinates, cut into blocks, some block of such a pair is within its share of that
distance.  In each block pairs within the share are found by ranges of the block's first coordinate.  A pair
counts in the first block that finds it, so no list of pairs is made, and is verified on the vectors themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import arrow_schema, components, cut_lineage, forest, map_arrow, map_groups, split_groups

#: Coordinates of a block; vectors of a cell that one task compares with as many others.
BLOCK, LIMIT = 16, 16_000
#: Cells up to which their sizes are broadcast; vectors of one length have some ten cells a block.
SMALL = 100_000
_PAIRS = 1 << 18  # pairs measured at a time
_SLACK = 1e-9


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, scaled first so that no square over- or underflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def rotate(v: np.ndarray) -> np.ndarray:
    """Random signs and a Hadamard transform: a rotation of the rows, padded to a power of two.

    Only sums of two numbers occur, so a row's result does not depend on the rows beside it.
    """
    size = 1 << max(v.shape[1] - 1, 0).bit_length()
    out = np.zeros((len(v), size))
    out[:, : v.shape[1]] = v * np.where(np.random.default_rng(5).random(v.shape[1]) < 0.5, -1.0, 1.0)
    step = 1
    while step < size:
        x = out.reshape(len(v), -1, 2, step)
        out = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(v), size)
        step *= 2
    return out / np.sqrt(size)


def _gap(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, coordinate by coordinate, the same in every task."""
    out = np.zeros(len(i))
    for k in range(x.shape[1]):
        d = x[i, k] - x[j, k]
        out += d * d
    return out


def _blocks(v: np.ndarray, budget: float):
    """For each block of the rows ``v`` made units and rotated: its number, its columns, its share of the budget, and
    the cell of every row by the block's first coordinate.  Rows of another length are in other cells."""
    u = rotate(unit(v))
    for b, at in enumerate(range(0, u.shape[1], BLOCK)):
        x = u[:, at : at + BLOCK]
        share = budget * x.shape[1] / u.shape[1] + _SLACK
        place = np.floor(x[:, 0] / (np.sqrt(share) + _SLACK)).astype(np.int64)
        yield b, x, share, (np.int64(v.shape[1]) << 40) + (np.int64(b) << 24) + place


def _by_length(batch: pa.RecordBatch, size: int = 2000):
    """Pieces of ``batch`` whose vectors are of one length, and these vectors."""
    long = np.asarray(pc.list_value_length(batch.column("v")))
    for d in np.unique(long):
        own = np.flatnonzero(long == d)
        for at in range(0, len(own), size):
            part = batch.take(pa.array(own[at : at + size]))
            yield part, np.asarray(part.column("v").flatten()).reshape(-1, d)


def _sizes(classes: DataFrame, budget: float) -> DataFrame:
    """(cell, _n): the rows that :func:`_cells` has for each cell."""
    ddl = "cell long, n long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for _, v in _by_length(batch):
                cells = [c + move for _, _, _, c in _blocks(v, budget) for move in (0, 1)]
                cell, n = np.unique(np.concatenate(cells), return_counts=True)
                yield pa.RecordBatch.from_pydict({"cell": cell, "n": n}, schema=schema)

    return map_arrow(classes.select("v"), run, ddl).groupBy("cell").agg(F.sum("n").alias("_n"))


def _cells(classes: DataFrame, budget: float) -> DataFrame:
    """(cell, block, home, rep, weight, v): every class in the cell of each of its blocks, and as a visitor in the
    next one, so that two near classes meet in one cell.  ``v`` has the vector's numbers as bytes."""
    ddl = "cell long, block int, home boolean, rep long, weight long, v binary"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for part, v in _by_length(batch):
                raw = [row.tobytes() for row in v]
                for b, _, _, cell in _blocks(v, budget):
                    for move in (0, 1):
                        yield pa.RecordBatch.from_pydict({
                            "cell": cell + move, "block": np.full(len(v), b, np.int32), "home": np.full(len(v), not move),
                            "rep": part.column("rep"), "weight": part.column("weight"), "v": raw,
                        }, schema=schema)

    return map_arrow(classes.select("rep", "weight", "v"), run, ddl)


def _to_compare(home: np.ndarray, side: np.ndarray, cross: bool):
    """(rows, columns): places whose pairs are to be compared; where both are the same, each pair once."""
    kinds = {(h, s): np.flatnonzero((home == h) & (side == s)) for h in (True, False) for s in (0, 1)}
    if cross:
        yield kinds[True, 0], kinds[True, 1]
        yield kinds[True, 0], kinds[False, 1]
        yield kinds[True, 1], kinds[False, 0]
    else:
        at_home = np.flatnonzero(home)
        yield at_home, at_home
        yield at_home, np.flatnonzero(~home)


def _near(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, share: float):
    """Pairs of ``rows`` and ``cols`` at about ``share`` or less, in pieces.

    Both are sorted by the first coordinate, so that a piece of rows is compared with a range of columns only.
    Single precision is enough to choose pairs that are measured after that.
    """
    same = rows is cols
    rows, cols = (k[np.argsort(x[k, 0], kind="stable")] for k in (rows, cols))
    reach = np.sqrt(share) + 1e-6
    small = x.astype(np.float32)
    half = (x * x).sum(axis=1).astype(np.float32) / 2
    for at in range(0, len(rows), 256):
        i = rows[at : at + 256]
        first, last = np.searchsorted(x[cols, 0], [x[i[0], 0] - reach, x[i[-1], 0] + reach])
        first = max(first, at + 1) if same else first
        j = cols[first:last]
        if not len(j):
            continue
        dot = small[i] @ small[j].T
        dot -= half[j]
        hit_i, hit_j = np.divmod(np.flatnonzero(dot >= (half[i] - np.float32(share / 2 + 1e-5))[:, None]), len(j))
        if same:
            later = first + hit_j > at + hit_i
            hit_i, hit_j = hit_i[later], hit_j[later]
        for k in range(0, len(hit_i), _PAIRS):
            yield i[hit_i[k : k + _PAIRS]], j[hit_j[k : k + _PAIRS]]


def _links(cells: DataFrame, sizes: DataFrame, kind: str, cosine: float, budget: float) -> DataFrame:
    """(rep, n, root): for each group a row for each class in it with the weight of those it is linked with."""
    dealt = split_groups(cells, "cell", "rep", LIMIT, sizes)

    def run(t, first):
        rep, weight, block = (np.asarray(t.column(c)) for c in ("rep", "weight", "block"))
        home, side, cross = (np.asarray(t.column(c)) for c in ("home", "side", "cross"))
        n, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for a, e in zip(first, np.r_[first[1:], len(rep)]):
            v = np.frombuffer(b"".join(t.column("v").slice(a, e - a).to_pylist()), kind).reshape(e - a, -1)
            u = unit(v)
            blocks = [(x, share) for _, x, share, _ in _blocks(v, budget)]
            x, share = blocks[block[a]]
            # labels are joined pair by pair of pieces, so that no list of a group's pairs is kept
            own = np.arange(e - a)
            for rows, cols in _to_compare(home[a:e], side[a:e], cross[a]):
                for i, j in _near(x, rows, cols, share):
                    use = (rep[a + i] != rep[a + j]) & (_gap(x, i, j) <= share)
                    for y, most in blocks[: block[a]]:  # found there already
                        i, j = i[use], j[use]
                        use = _gap(y, i, j) > most
                    i, j = i[use], j[use]
                    link = np.einsum("ij,ij->i", u[i], u[j]) >= cosine
                    i, j = i[link], j[link]
                    np.add.at(n, a + i, weight[a + j])
                    np.add.at(n, a + j, weight[a + i])
                    if len(i):
                        own = _joined(own, i, j)
            label[a:e] = a + own
        return {"rep": rep, "n": n, "root": rep[label]}

    cols = ["sub", "block", "home", "rep", "weight", "v", "side", "cross"]
    return map_groups(dealt.select(*cols), "sub", run, "rep long, n long, root long", rows=4000).filter("n > 0")


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the pairs (i, j) too: a label is the smallest place of those joined so far."""
    return forest(len(label), label[i], label[j])[label]


def join(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of (vec_id, embedding): links of ``cosine`` or more.

    A vector that is null, empty or zero, or holds null or non-finite components, has no links; so have
    vectors of different lengths.  Rows that repeat vec_id and vector count once; rows without vec_id are left out.
    """
    budget = 2 - 2 * cosine
    kind, ddl = ("<f4", "float") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else ("<f8", "double")
    rows = vectors.filter("vec_id is not null").select("vec_id", F.col("embedding").cast(f"array<{ddl}>").alias("v")).distinct()
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.coalesce(F.size("v") > 0, F.lit(False)) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    good = rows.filter(fine)
    classes = cut_lineage(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    sizes = cut_lineage(_sizes(classes, budget))
    if sizes.count() <= SMALL:
        sizes = F.broadcast(sizes)
    links = cut_lineage(_links(_cells(classes, budget), sizes, kind, cosine, budget))
    roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    linked = roots.join(least, "root").select(F.col("node").alias("rep"), "component_id")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    per_class = (
        classes.join(counts, "rep", "left").join(linked, "rep", "left")
        .select("v", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    per_vec = good.join(per_class, "v").select("vec_id", "n", "component_id")
    return (
        rows.filter(~fine | F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component_id"))
        .unionByName(per_vec)
        .select("vec_id", F.col("n").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    )
