"""Repeated byte strings, removed: suffixes at sampled places in deep-shallow order.

A string of LENGTH bytes that occurs twice is found by its anchor, the place in it whose next GRAM bytes hash
lowest: equal strings have equal anchors.  So only suffixes at anchors are sorted, one in LENGTH / 2 or so, and
each with the bytes to its left and right that strings with this anchor reach (its surroundings).  Anchors are
grouped by the hash of their bytes.  In a group both sides are sorted, by multikey quicksort to a shallow depth
and by blind tries below it; neighbours' common prefixes then tell, for every pair, which strings of LENGTH
bytes that hold the anchor are equal.  Equal surroundings stand for each other, so copies cost one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import arrow_schema, cut_lineage, map_arrow, map_groups, map_texts, prefix_hashes, range_hashes, slices

GRAM = 32
#: Depth in bytes to which quicksort goes before blind tries take over.
SHALLOW = 32
#: Surroundings of one group that are sorted in one task; larger groups are cut by ranges of strings, WAYS at a time.
LIMIT, WAYS = 400, 8
_PLACE = 31  # low bits of a hash that hold the place, so that the first of equal hashes wins


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class _Trie:
    """A blind trie: inner nodes hold only the depth at which their branches differ, leaves the strings.

    A string goes down by the bytes at these depths alone, is compared once with the leaf it reaches, and is
    then put where the two differ.
    """

    def __init__(self, strings: list[bytes]):
        self.s = strings
        self.root = None

    def add(self, n: int) -> None:
        s = self.s[n]
        if self.root is None:
            self.root = [n]
            return
        node = self.root
        while isinstance(node, tuple):
            depth, branches = node
            byte = s[depth] if depth < len(s) else -1
            node = branches.get(byte) or next(iter(branches.values()))
        other = self.s[node[0]]
        depth = _common(s, other)
        if depth == len(s) == len(other):
            node.append(n)
            return
        byte, against = (x[depth] if depth < len(x) else -1 for x in (s, other))
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            above = node, (s[node[0]] if node[0] < len(s) else -1)
            node = node[1][above[1]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][byte] = [n]
            return
        made = (depth, {byte: [n], against: node})
        if above is None:
            self.root = made
        else:
            above[0][1][above[1]] = made

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """The order of ``strings``: multikey quicksort on eight bytes at a time down to SHALLOW, then blind tries."""
    words = SHALLOW // 8
    head = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(-1, words).astype(np.uint64)
    out: list[int] = []
    stack = [(np.arange(len(strings)), 0)]
    while stack:
        rows, depth = stack.pop()
        if not len(rows):
            continue
        if len(rows) == 1:
            out.append(int(rows[0]))
        elif depth == words:
            trie = _Trie(strings)
            for n in rows:
                trie.add(int(n))
            out += trie.order()
        else:
            key = head[rows, depth]
            pivot = key[len(key) // 2]
            stack += [(rows[key > pivot], depth), (rows[key == pivot], depth + 1), (rows[key < pivot], depth)]
    return out


def _between(strings: list[bytes]) -> np.ndarray:
    """Common prefix lengths of all pairs of strings, by the least one between neighbours in order."""
    order = deep_shallow(strings)
    n = len(order)
    near = np.array([_common(strings[a], strings[b]) for a, b in zip(order, order[1:])], np.int32)
    out = np.zeros((n, n), np.int32)
    for k in range(n - 1):
        out[k, k + 1 :] = np.minimum.accumulate(near[k:])
    out = out + out.T
    back = np.empty(n, int)
    back[order] = np.arange(n)
    return out[np.ix_(back, back)]


def repeated(left: list[bytes], right: list[bytes], length: int) -> np.ndarray:
    """For strings around one anchor: (row, first, last), the numbers of bytes left of the anchor that a string of
    ``length`` bytes which another row has too may have.  ``left`` is read backwards."""
    l, r = _between([s[::-1] for s in left]), _between(right)
    l, r = np.minimum(l, length), np.minimum(r, length)
    i, j = np.nonzero(l + r >= length)
    keep = i != j
    i, j = i[keep], j[keep]
    marks = np.zeros((len(left), length + 2), np.int32)
    np.add.at(marks, (i, length - r[i, j]), 1)
    np.add.at(marks, (i, l[i, j] + 1), -1)
    on = np.pad(marks.cumsum(axis=1)[:, :-1] > 0, ((0, 0), (1, 1)))
    row, first = np.nonzero(on[:, 1:] & ~on[:, :-1])
    _, last = np.nonzero(~on[:, 1:] & on[:, :-1])
    return np.stack([row, first, last - 1], axis=1)


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, place, first, last, key): the anchors and the first and last start of the strings that have them."""
    window = length - GRAM + 1
    a = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum([0, *map(len, texts)])
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    n = len(a) - GRAM + 1
    if n < window:
        return none
    place = np.arange(n)
    key = range_hashes(prefix_hashes(a), place, place + GRAM)
    low = ((key >> np.uint64(_PLACE)) << np.uint64(_PLACE)) | place.astype(np.uint64)
    # least of every window: of the tail of one block of that size and the head of the next
    full = np.pad(low, (0, -n % window), constant_values=np.uint64(2**64 - 1)).reshape(-1, window)
    head = np.minimum.accumulate(full, axis=1).ravel()
    tail = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - window + 1
    at = (np.minimum(tail[:starts], head[window - 1 : window - 1 + starts]) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), list(map(len, texts)))[:starts]
    inside = np.arange(starts) + length <= begin[text + 1]
    start = np.flatnonzero(inside)
    if not len(start):
        return none
    at, text = at[start], text[start]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:], len(start)] - 1
    off = begin[text[new]]
    return text[new], at[new] - off, start[new] - off, start[last] - off, key[at[new]]


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(key, near, text_id, place, first, last): near is a digest of an anchor's surroundings."""

    def run(batch):
        raw = [t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
        ids = batch.column("text_id").to_pylist()
        text, place, first, last, key = anchors(raw, length)
        near = [
            int.from_bytes(hashlib.blake2b(raw[t][f : e + length] + (p - f).to_bytes(4, "little"), digest_size=8).digest(), "little", signed=True)
            for t, p, f, e in zip(text.tolist(), place.tolist(), first.tolist(), last.tolist())
        ]
        return {"key": key.view(np.int64), "near": near, "text_id": [ids[t] for t in text.tolist()], "place": place.astype(np.int32), "first": first.astype(np.int32), "last": last.astype(np.int32)}

    return map_texts(texts, run, "key long, near long, text_id long, place int, first int, last int")


def _surroundings(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, near, left, right) of each row of ``wanted``: the bytes before the anchor and from it on."""
    ddl = "key long, near long, left binary, right binary"
    schema = arrow_schema(ddl)
    lists = wanted.groupBy("text_id").agg(F.collect_list(F.struct("key", "near", "place", "first", "last")).alias("found"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist()):
                    raw = text.encode("utf-8", "replace")
                    rows += [(f["key"], f["near"], raw[f["first"] : f["place"]], raw[f["place"] : f["last"] + length]) for f in found]
                for at in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 5000]), schema.types)], schema=schema)

    return map_arrow(texts.join(lists, "text_id").select("text", "found"), run, ddl)


def _sorted_groups(rows: DataFrame, length: int) -> DataFrame:
    """(key, near, lo, hi): bytes left of the anchor, from lo to hi, of the strings that another row of ``sub`` has.

    ``rows`` has (sub, key, near, left, right); only the strings within ``left`` and ``right`` are compared.
    """

    def run(t, first):
        key, near = np.asarray(t.column("key")), np.asarray(t.column("near"))
        left, right = t.column("left").to_pylist(), t.column("right").to_pylist()
        out = [np.zeros((0, 3), int)]
        for a, b in zip(first, np.r_[first[1:], len(key)]):
            out.append(repeated(left[a:b], right[a:b], length) + [a, 0, 0])
        got = np.concatenate(out)
        return {"key": key[got[:, 0]], "near": near[got[:, 0]], "lo": got[:, 1].astype(np.int32), "hi": got[:, 2].astype(np.int32)}

    return map_groups(rows.select("sub", "key", "near", "left", "right"), "sub", run, "key long, near long, lo int, hi int")


def _narrowed(rows: DataFrame, length: int) -> DataFrame:
    """Each row of (key, near, left, right, lo, hi) cut into WAYS ranges of lo to hi: (sub, cut, key, near, lo, hi).

    All strings of a range hold the same middle, whose hash names the new group ``sub``; ``cut`` is a digest of
    all that the strings of the range reach.
    """

    def run(batch):
        out = {k: [] for k in ("sub", "cut", "key", "near", "lo", "hi")}
        number = lambda *parts: int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)
        for key, near, left, right, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("key", "near", "left", "right", "lo", "hi"))):
            width = -(-(hi - lo + 1) // WAYS)
            for x in range(lo, hi + 1, width):
                y = min(x + width - 1, hi)
                if max(x, length - len(right)) > min(y, len(left)):
                    continue  # none of this row's strings
                tag = key.to_bytes(8, "little", signed=True) + x.to_bytes(4, "little") + y.to_bytes(4, "little")
                reach = left[max(len(left) - y, 0) :]
                out["sub"].append(number(tag, left[len(left) - x :], right[: length - y]))
                out["cut"].append(number(len(reach).to_bytes(4, "little"), reach, right[: length - x]))
                for k, v in (("key", key), ("near", near), ("lo", x), ("hi", y)):
                    out[k].append(v)
        return out

    return map_texts(rows, run, "sub long, cut long, key long, near long, lo int, hi int", "right")


def _large_groups(base: DataFrame, length: int) -> DataFrame:
    """The result of :func:`_sorted_groups` for groups of any size.

    A group is cut by ranges of strings, round after round, until its parts are small enough to sort.  Rows
    that are equal in all a range reaches are settled by counting them, and only one of them goes on; a range of
    one string settles all rows, so there are few rounds, and each has WAYS rows at most for each row before.
    """
    rows = base.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(length - GRAM))
    out = []
    while True:
        parts = cut_lineage(_narrowed(rows, length))
        kinds = cut_lineage(parts.groupBy("sub", "cut").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "near", "lo", "hi")).alias("at")))
        out.append(parts.join(kinds.filter("n > 1").select("sub", "cut"), ["sub", "cut"]).select("key", "near", "lo", "hi"))
        subs = kinds.groupBy("sub").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        left = cut_lineage(kinds.join(subs, "sub").select("sub", "m", "at.*").join(base, ["key", "near"]))
        reach = left.filter(F.col("m") <= LIMIT).select(
            "sub", "key", "near", F.expr("substring(left, greatest(length(left) - hi, 0) + 1)").alias("left"), F.expr(f"substring(right, 1, {length} - lo)").alias("right")
        )
        out.append(_sorted_groups(reach, length))
        rows = left.filter(F.col("m") > LIMIT).select("key", "near", "left", "right", "lo", "hi")
        if not rows.take(1):
            break
    spans = out[0]
    for more in out[1:]:
        spans = spans.unionByName(more)
    return spans


def repeats(texts: DataFrame, length: int) -> DataFrame:
    """(text_id, starts): for each text of (text_id, text) runs of the starts of repeated strings.

    ``starts`` is an array of (lo, hi); texts without repeated strings have no row.
    """
    found = cut_lineage(_anchor_rows(texts, length))
    kinds = found.groupBy("key", "near").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_id", "place", "first", "last")).alias("at"))
    kinds = cut_lineage(kinds)
    keys = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    wanted = kinds.join(keys, "key").select("key", "near", "at.*")
    rows = _surroundings(texts, wanted, length)
    rows = cut_lineage(rows.join(keys, "key"))
    some = _sorted_groups(rows.filter(F.col("m") <= LIMIT).withColumn("sub", F.col("key")), length)
    large = rows.filter(F.col("m") > LIMIT).drop("m")
    more = _large_groups(large, length) if large.take(1) else some.limit(0)
    again = kinds.filter("n > 1").select("key", "near", F.lit(0).alias("lo"), F.lit(length).alias("hi"))
    spans = cut_lineage(some.unionByName(more).unionByName(again))
    hit = found.join(spans, ["key", "near"]).select(
        "text_id", F.greatest(F.col("first"), F.col("place") - F.col("hi")).alias("lo"), F.least(F.col("last"), F.col("place") - F.col("lo")).alias("hi")
    )
    return hit.groupBy("text_id").agg(F.collect_set(F.struct("lo", "hi")).alias("starts"))


def covered(starts, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs (begin, end) of bytes in strings of ``length`` bytes that start in the runs ``starts``."""
    out: list[list[int]] = []
    for lo, hi in sorted(starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, min(b, size)) for a, b in out]


def remove(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): bytes in repeated strings of ``length`` bytes.

    A string counts as repeated if it starts at another place too, in the same text or another.  A null text
    is empty; every row is a text of its own, also where rows repeat each other or their doc_id.
    """
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_id", F.xxhash64("doc_id", "text"))
    found = repeats(raw.filter(F.octet_length("text") >= length).select("text_id", "text"), length)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:int,end:int>>"

    def run(batch):
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
            data = text.encode("utf-8", "replace")
            spans = covered([(s["lo"], s["hi"]) for s in starts or []], len(data), length)
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            out["n_bytes"].append(len(data))
            out["n_removed"].append(sum(b - a for a, b in spans))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(b"".join(kept)).hexdigest())
            out["spans"].append([{"begin": a, "end": b} for a, b in spans])
        return {"doc_id": batch.column("doc_id"), **out}

    return map_texts(raw.join(found, "text_id", "left").select("doc_id", "text", "starts"), run, ddl)
