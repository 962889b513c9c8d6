"""Scores of texts by prediction by partial matching, pretrained on a corpus of bytes.

The model is a trie of byte contexts up to ORDER bytes long with the counts of the bytes that follow.  A byte
not seen after a context escapes to the next shorter one with probability d / (n + d), n being the count and d
the number of different bytes seen there (method C); bytes already ruled out are excluded from the shorter
context's counts.  As every byte seen after a context is also seen after its suffix, what is excluded is a
property of the longer context: the sum of the suffix's counts over the bytes it has seen.

The probability of a byte depends on its last ORDER bytes alone, so it is worked out once for every different
run of ORDER + 1 bytes, by joins on tables of such runs.  Texts are dealt to blocks; a block asks for the runs
and words it holds and gets their values back.  A text is led by ORDER zero bytes and ended by its length only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import arrow_schema, cut_lineage, map_arrow, ship, slices, words_of
from tripweave.session import release

ORDER = 5
#: Bytes of text in a block, about.
BLOCK_BYTES = 24 << 20
#: Bytes of text that a task works on at a time: its arrays take some fifty times as much.
_PIECE = 1 << 18
RUN, WORD = 0, 1
#: The key of a text's end among the words.
END = 1


def run_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The key of every byte with the ORDER bytes before it, and the place of each text's first one, plus the end."""
    lead = bytes(ORDER)
    a = np.frombuffer(lead + lead.join(texts) + lead, np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    key = np.zeros(len(a) - ORDER, np.int64)
    for k in range(ORDER + 1):
        key = (key << 8) | a[k : len(a) - ORDER + k]
    at = np.r_[0, np.cumsum(size)]
    use = np.arange(at[-1]) + np.repeat(np.arange(len(texts)) * ORDER, size)
    return key[use], at


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words, A-Z in lower case, and the place of each text's first word, plus the end."""
    h, at = words_of([t.lower() for t in texts])
    return np.where(h == END, np.uint64(2), h).view(np.int64), at


def _plain(batch) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]


def _requests(dealt: DataFrame) -> DataFrame:
    """(block, kind, key, n) of every run and word of a block: n is its count in the texts to learn from.

    The rows of a block lie side by side.
    """
    ddl = "block int, kind byte, key long, n long"
    schema = arrow_schema(ddl)

    def merged(parts):
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys)
        keys, n = keys[order], np.concatenate([n for _, n in parts])[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(n, first)

    def run(batches):
        held: dict[int, list] = {RUN: [], WORD: []}
        now = None

        def add(kind, keys, learn):
            held[kind].append(merged([(keys, learn)]))
            if len(held[kind]) > 6:
                held[kind] = [merged(held[kind])]

        def flush():
            for kind, parts in held.items():
                if parts:
                    key, n = merged(parts)
                    for at in range(0, len(key), 100_000):
                        k = key[at : at + 100_000]
                        yield pa.RecordBatch.from_pydict({"block": np.full(len(k), now, np.int32), "kind": np.full(len(k), kind, np.int8), "key": k, "n": n[at : at + 100_000]}, schema=schema)
                held[kind] = []
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for part in slices(batch, "text", _PIECE):
                blocks = np.asarray(part.column("block"))
                for at in np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]):
                    if blocks[at] != now:
                        yield from flush()
                        now = int(blocks[at])
                    mine = part.slice(at, int((blocks[at:] != now).argmax()) if (blocks[at:] != now).any() else None)
                    texts, w = _plain(mine), np.asarray(mine.column("learn")).astype(np.int64)
                    key, first = run_keys(texts)
                    if len(key):
                        add(RUN, key, np.repeat(w, np.diff(first)))
                    key, first = word_keys(texts)
                    add(WORD, np.r_[key, np.full(len(texts), END)], np.r_[np.repeat(w, np.diff(first)), w])
        yield from flush()

    return map_arrow(dealt, run, ddl)


def _probabilities(runs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key, value): log10 of the probability of the last byte of each run, from (key, n); and the tables it reads.

    ``runs`` has every run that is asked for; n is 0 where it was not learned.
    """
    tables = []  # by order: (key, n) learned
    now = runs.filter("n > 0")
    for order in range(ORDER, -1, -1):
        tables.insert(0, now)
        if order:
            keep = F.lit((1 << (8 * order)) - 1)
            now = cut_lineage(now.groupBy(F.col("key").bitwiseAND(keep).alias("key")).agg(F.sum("n").alias("n")))
    contexts = []  # by order: (ctx, total, kinds, excluded)
    for order, t in enumerate(tables):
        if order:
            shorter = tables[order - 1].select(F.col("key").alias("_k"), F.col("n").alias("_n"))
            t = t.withColumn("_k", F.col("key").bitwiseAND(F.lit((1 << (8 * order)) - 1))).join(shorter, "_k")
        else:
            t = t.withColumn("_n", F.lit(0).cast("long"))
        ctx = t.groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("_n").alias("excluded"))
        contexts.append(cut_lineage(ctx))
    # from the longest context down; each round settles the runs whose byte was seen there
    left = runs.select("key", F.lit(0.0).alias("lp"), F.lit(0).cast("long").alias("x_n"), F.lit(0).cast("long").alias("x_d"))
    done, read = [], [*tables[:-1], *contexts]
    for order in range(ORDER, -1, -1):
        mask = F.lit((1 << (8 * (order + 1))) - 1)
        ctx = contexts[order]
        got = left.withColumn("own", F.col("key").bitwiseAND(mask)).withColumn("ctx", F.shiftright(F.col("key").bitwiseAND(mask), 8))
        got = got.join(ctx, "ctx", "left").join(tables[order].select(F.col("key").alias("own"), "n"), "own", "left")
        # nothing learned after this context, or nothing but what is excluded: escape is certain
        n, d = F.col("total") - F.col("x_n"), F.col("kinds") - F.col("x_d")
        new = F.col("total").isNull()
        here = F.when(F.col("n").isNotNull(), F.log10(F.col("n") / (n + d))).when(new | (d <= 0), F.lit(0.0)).otherwise(F.log10(d / (n + d)))
        step = cut_lineage(got.select(
            "key", F.col("n").isNotNull().alias("settled"), (F.col("lp") + here).alias("lp"),
            F.when(new, F.col("x_n")).otherwise(F.col("excluded")).alias("x_n"), F.when(new, F.col("x_d")).otherwise(F.col("kinds")).alias("x_d"),
        ))
        read.append(step)
        done.append(step.filter("settled").select("key", F.col("lp").alias("value")))
        left = step.filter("not settled").drop("settled")
    # never learned at all: the same share for each of the bytes that are left
    done.append(left.select("key", (F.col("lp") - F.log10(F.greatest(F.lit(256) - F.col("x_d"), F.lit(1)).cast("double"))).alias("value")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, read


def score(docs: DataFrame, learn) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text; null counts as empty.

    ``learn`` is a condition on the rows of ``docs``: the texts it marks, with all their bytes and words, are
    what the model learns from.  ``score`` is the log10 probability of the text under the model, ``base_score``
    that under smoothed counts of its words and its end.  Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    blocks = int((rows.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // BLOCK_BYTES) + 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(blocks)).cast("int"))
    asked = cut_lineage(_requests(dealt.repartition("block").sortWithinPartitions("block")))
    known = cut_lineage(asked.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")))
    words = known.filter(F.col("kind") == WORD)
    total, distinct = words.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    chances, read = _probabilities(known.filter(F.col("kind") == RUN).select("key", "n"))
    # a word that one block alone holds has there the count that it has anywhere
    shared = words.filter("blocks > 1").select("kind", "key", F.col("n").cast("double").alias("value"))
    values = cut_lineage(shared.unionByName(chances.select(F.lit(RUN).cast("byte").alias("kind"), "key", "value")))
    release(known, *read)
    replies = asked.select("block", "kind", "key").join(values, ["kind", "key"])
    ddl = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = arrow_schema(ddl)
    spread = total + distinct + 1

    def work(key, texts, replies):
        kinds, keys, values = (np.asarray(replies.column(c)) for c in ("kind", "key", "value"))
        reply = {}
        for kind in (RUN, WORD):
            k, v = keys[kinds == kind], values[kinds == kind]
            order = np.argsort(k)
            reply[kind] = k[order], v[order]
        del kinds, keys, values, replies
        batches = texts.to_batches()

        def pieces():
            for batch in batches:
                for part in slices(batch, "text", _PIECE):
                    yield part, _plain(part)

        def counts(keys):
            """Of sorted different keys: the counts by the replies, and which have none."""
            k, v = reply[WORD]
            place = np.minimum(np.searchsorted(k, keys), max(len(k) - 1, 0))
            there = k[place] == keys if len(k) else np.zeros(len(keys), bool)
            return np.where(there, v[place] if len(k) else 0.0, 0.0), ~there

        alone = []  # what this block has learned of words that no other block holds
        for part, plain in pieces():
            learn = np.asarray(part.column("learn")).astype(np.float64)
            k, at = word_keys(plain)
            u, inverse = np.unique(np.r_[k, np.full(len(plain), END)], return_inverse=True)
            missing = counts(u)[1]
            n = np.bincount(inverse, np.r_[np.repeat(learn, np.diff(at)), learn], len(u))
            alone.append((u[missing], n[missing]))
        k = np.concatenate([a for a, _ in alone]) if alone else np.zeros(0, np.int64)
        u, inverse = np.unique(k, return_inverse=True)
        local = u, np.bincount(inverse, np.concatenate([n for _, n in alone]) if alone else None, len(u))
        del alone, k, inverse

        def count_of(keys):
            u, inverse = np.unique(keys, return_inverse=True)
            c, missing = counts(u)
            c[missing] = local[1][np.searchsorted(local[0], u[missing])]
            return c[inverse]

        def chance_of(keys):
            u, inverse = np.unique(keys, return_inverse=True)
            return reply[RUN][1][np.searchsorted(reply[RUN][0], u)][inverse]

        def sums(v, at):
            return np.add.reduceat(np.r_[v, 0.0], at[:-1]) * (np.diff(at) > 0)

        out = []
        for part, plain in pieces():
            keys, at = run_keys(plain)
            s = sums(chance_of(keys), at) if len(keys) else np.zeros(len(plain))
            keys, at = word_keys(plain)
            c = count_of(np.r_[keys, END])
            c, end = c[:-1], c[-1]
            out.append(pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_tokens": np.diff(at) + 1, "n_known": sums((c > 0).astype(float), at).astype(np.int64) + int(end > 0),
                "train_tokens": np.full(len(plain), total), "base_score": sums(np.log10((c + 1) / spread), at) + math.log10((end + 1) / spread), "score": s,
            }, schema=schema))
        return pa.Table.from_batches(out, schema)

    # pairs of small frames meet: a block's texts and the values that it asked for
    ship(spark)
    return dealt.select("block", "doc_id", "text", "learn").groupBy("block").cogroup(replies.select("block", "kind", "key", "value").groupBy("block")).applyInArrow(work, ddl)
