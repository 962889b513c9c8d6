"""Near copies of texts: Jaccard similarity of word n-grams, candidates pruned by their posterior probability.

Texts of equal n-gram sets are one class from the start.  Classes that share a band of MinHash values meet in
a bucket, where a pair's values are compared a few at a time; it is dropped when the probability, given the
matches so far, that its similarity reaches the threshold falls below a tolerance.  A pair that meets in several
buckets counts in the first.  The classes of a bucket that have a pair left meet there once more with all
their values and their sets: the pruning goes on over all values, and what it leaves is verified on the sets.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import cut_lineage, components, forest, map_groups, map_texts, mix, pairs_of, runs, split_groups, words_of

#: Bands of ROWS values each: a pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^40 = 1e-7.
BANDS, ROWS = 40, 5
VALUES = BANDS * ROWS
#: Values that travel to the buckets, values compared at a time, and rows of a group in one task.
EARLY, STEP, LIMIT = 64, 16, 200
_FACTORS = np.random.default_rng(23).integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(values: int, threshold: float, tolerance: float) -> np.ndarray:
    """For n = STEP, 2 STEP, ... values the fewest matches with P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), whose upper tail is a
    binomial sum.
    """
    out = []
    for n in range(STEP, values + 1, STEP):
        tail = np.cumsum([comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(n + 1)])
        out.append(int(np.searchsorted(tail, tolerance)))
    return np.array(out)


def survivors(values: np.ndarray, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of rows of ``values`` are never below ``least`` as more values are compared."""
    alive, same = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, m in enumerate(least):
        cut = slice(k * STEP, (k + 1) * STEP)
        same = same[:] + (values[i[alive], cut] == values[j[alive], cut]).sum(axis=1)
        keep = same >= m
        alive, same = alive[keep], same[keep]
        if not len(alive):
            break
    return alive


def sets_of(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``n`` words, lower case, of each text; a shorter text is one run."""
    words, at = words_of([(t or "").lower().encode() for t in texts])
    grams, gat = runs(words, at, n)
    return [np.unique(grams[a:b]) for a, b in zip(gat[:-1], gat[1:])]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """32-bit MinHash values, a row for each set, none of them empty."""
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), VALUES), np.uint32)
    for k, f in enumerate(_FACTORS):
        out[:, k] = np.minimum.reduceat(((flat ^ f) * f) >> np.uint64(32), at)
    return out


def _values_of(sets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([minhash(sets[a : a + 64]) for a in range(0, len(sets), 64)])


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row; bands differ in their keys."""
    keys = np.zeros((len(values), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, r::ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return keys


def _low(values: np.ndarray) -> np.ndarray:
    """16 bits of each value: what is compared."""
    return (values & np.uint32(0xFFFF)).astype(np.uint16)


def _marks(keys: np.ndarray) -> np.ndarray:
    """32 bits of each band's key: what tells in which band two rows met first."""
    return (keys >> np.uint64(32)).astype(np.uint32)


def first_met(marks: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of rows have no equal mark in a band before their ``band``."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 15):
        a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        out[at : at + (1 << 15)] = (marks[a] == marks[b]).argmax(axis=1) == band[a]
    return out


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, set_key, early, marks, bands) of the texts that have a word."""

    def run(batch):
        sets = sets_of(batch.column("text").to_pylist(), n)
        some = [k for k, s in enumerate(sets) if len(s)]
        if not some:
            return {"doc_id": [], "set_key": [], "early": [], "marks": [], "bands": []}
        values = _values_of([sets[k] for k in some])
        keys = band_keys(values)
        return {
            "doc_id": batch.column("doc_id").take(pa.array(some)),
            "set_key": [_digest(sets[k].tobytes()) for k in some],
            "early": [v.tobytes() for v in _low(values[:, :EARLY])],
            "marks": [v.tobytes() for v in _marks(keys)],
            "bands": pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
        }

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, set_key binary, early binary, marks binary, bands array<long>")


def _matrix(column, dtype) -> np.ndarray:
    width = len(column[0].as_py()) // np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _units(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(sub, rep, band, side, cross): of the groups that buckets are dealt to, the rows with a pair that is left.

    A pair counts in the first band in which its values are equal, so in one group only.
    """
    least = least_matches(EARLY, threshold, tolerance)
    rows = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    # a class alone in its buckets carries no values to them
    dealt = split_groups(rows, "bucket", "rep", LIMIT).join(classes.select("rep", "early", "marks"), "rep")

    def run(t, first):
        values, marks = _matrix(t.column("early"), np.uint16), _matrix(t.column("marks"), np.uint32)
        band, side, cross = (np.asarray(t.column(c)) for c in ("band", "side", "cross"))
        hit = np.zeros(len(band), bool)
        for i, j in pairs_of(first, len(band), side, cross):
            ok = survivors(values, i, j, least)
            i, j = i[ok], j[ok]
            ok = first_met(marks, i, j, band)
            hit[i[ok]] = hit[j[ok]] = True
        return {c: np.asarray(t.column(c))[hit] for c in ("sub", "rep", "band", "side", "cross")}

    cols = ["sub", "rep", "band", "early", "marks", "side", "cross"]
    return map_groups(dealt.select(*cols), "sub", run, "sub long, rep long, band int, side int, cross boolean")


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs; many pairs of few sets by products of incidence matrices."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[col]
    row, col = row[use], number[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        both += m @ m.T
    return both[i, j].astype(np.int64)


def _links(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(rep, n, root) from (sub, band, side, cross, rep, weight, grams, values, marks): in each group a row for each
    class with the weight of the classes it is linked with, and the first class that links join it with there."""
    least = least_matches(VALUES, threshold, tolerance)

    def run(t, first):
        rep, weight = np.asarray(t.column("rep")), np.asarray(t.column("weight"))
        sets = [np.frombuffer(b, np.uint64) for b in t.column("grams").to_pylist()]
        values, marks = _matrix(t.column("values"), np.uint16), _matrix(t.column("marks"), np.uint32)
        size = np.array(list(map(len, sets)))
        band, side, cross = (np.asarray(t.column(c)) for c in ("band", "side", "cross"))
        n, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for a, b in zip(first, np.r_[first[1:], len(rep)]):
            for i, j in pairs_of(np.array([0]), b - a, side[a:b], cross[a:b], 1 << 30):
                near = np.minimum(size[a + i], size[a + j]) >= threshold * np.maximum(size[a + i], size[a + j]) - 1e-9
                i, j = i[near], j[near]
                ok = survivors(values[a:b], i, j, least)
                i, j = i[ok], j[ok]
                ok = first_met(marks[a:b], i, j, band[a:b])
                i, j = i[ok], j[ok]
                both = _intersections(sets[a:b], i, j)
                link = both >= threshold * (size[a + i] + size[a + j] - both) - 1e-9
                i, j = a + i[link], a + j[link]
                np.add.at(n, i, weight[j])
                np.add.at(n, j, weight[i])
                label[a:b] = a + forest(b - a, i - a, j - a)
        return {"rep": rep, "n": n, "root": rep[label]}

    cols = ["sub", "band", "side", "cross", "rep", "weight", "grams", "values", "marks"]
    return map_groups(members.select(*cols), "sub", run, "rep long, n long, root long").filter("n > 0")


def join(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-9) -> DataFrame:
    """(doc_id, class_id, n_links, kept): links of similarity ``threshold`` or more between whole texts.

    ``n_links`` counts the other documents linked directly, ``class_id`` is the smallest doc_id reachable by
    links, ``kept`` marks it.  Case and the kind of white space make no difference.  A text without a word has
    no links; of rows that repeat a doc_id the one whose n-grams have the least digest counts; rows without doc_id
    are left out.
    """
    rows = docs.filter("doc_id is not null").select("doc_id", "text")
    signed = cut_lineage(signatures(rows, n))
    keys = cut_lineage(signed.groupBy("doc_id").agg(F.min("set_key").alias("set_key")))
    classes = cut_lineage(keys.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    first = classes.select(F.col("rep").alias("doc_id"), "set_key", "rep")
    own = signed.join(first, ["doc_id", "set_key"]).select("rep", "early", "marks", "bands").dropDuplicates(["rep"])
    units = cut_lineage(_units(own, threshold, tolerance))

    def grams(batch):
        sets = sets_of(batch.column("text").to_pylist(), n)
        some = [k for k, s in enumerate(sets) if len(s)]
        sets = [sets[k] for k in some]
        values = _values_of(sets) if some else np.zeros((0, VALUES), np.uint32)
        return {
            "rep": batch.column("doc_id").take(pa.array(some, pa.int64())), "set_key": [_digest(s.tobytes()) for s in sets],
            "grams": [s.tobytes() for s in sets], "values": [v.tobytes() for v in _low(values)], "marks": [v.tobytes() for v in _marks(band_keys(values))],
        }

    wanted = cut_lineage(units.select("rep").distinct().join(classes, "rep"))
    texts = rows.join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = map_texts(texts, grams, "rep long, set_key binary, grams binary, values binary, marks binary").dropDuplicates(["rep", "set_key"])
    members = units.join(wanted.join(sets, ["rep", "set_key"]).drop("set_key"), "rep")
    links = cut_lineage(_links(members, threshold, tolerance))
    roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    least = roots.groupBy("root").agg(F.min("node").alias("class_id"))
    linked = roots.join(least, "root").select(F.col("node").alias("rep"), "class_id")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    per_class = (
        classes.join(counts, "rep", "left").join(linked, "rep", "left")
        .select("set_key", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("class_id", "rep").alias("class_id"))
    )
    per_doc = keys.join(per_class, "set_key").select(F.col("doc_id").alias("_id"), "n_links", "class_id")
    ids = rows.select("doc_id").distinct()
    return ids.join(per_doc, ids["doc_id"] == per_doc["_id"], "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.coalesce("class_id", "doc_id") == F.col("doc_id")).alias("kept"),
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-9) -> DataFrame:
    """The rows of ``docs``, all columns, but for documents that are linked with one of smaller doc_id."""
    gone = join(docs, threshold, n, tolerance).filter("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
