"""Benchmark items in training texts: BM25 over an inverted index with block maxima, then exact overlap.

Index terms are runs of words, so that unrelated text of the same vocabulary meets no posting list.  Texts
are cut into overlapping passages, each long enough to hold any item whole, and every passage is a query:
items whose score reaches a share of their own full score are retrieved, by bounds of the terms first, then
of the blocks of items, then in full.  Retrieved items are held against the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import map_texts, runs, words_of

#: Words of a run that is an index term, and of a shingle in the check of overlap.
TERM, SHINGLE = 3, 5
BLOCK = 32
#: An index part has about this many words of items; more items make more parts, each run over all texts.
PART_WORDS = 4_000_000


class _Fold(dict):
    """Characters to lower case, or to a space where they are neither letter nor digit, filled when met."""

    def __missing__(self, c):
        low = chr(c).lower()
        self[c] = got = low if low.isalnum() else " "
        return got


_FOLD = _Fold()


def normal(text: str | None) -> bytes:
    """Lower-case words of letters and digits: case and punctuation do not hide a copy."""
    return (text or "").translate(_FOLD).encode()


@dataclass
class Index:
    """Postings of one part of the items, by term; ``weights`` are shares of the item's own full score."""

    items: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    postings: np.ndarray
    weights: np.ndarray
    top: np.ndarray  # per term the largest weight
    block_first: np.ndarray
    blocks: np.ndarray  # per term the blocks it is in
    block_top: np.ndarray  # and its largest weight there
    longest: int
    shingles: np.ndarray  # of question and answer, with item and part
    shingle_item: np.ndarray
    shingle_part: np.ndarray
    sizes: np.ndarray  # items x (question, answer)

    @classmethod
    def build(cls, rows: list[tuple[int, str | None, str | None]], k1: float = 1.2, b: float = 0.75) -> Index:
        """From (item_id, question, answer); an item without a word in its question is never found."""
        rows = sorted((i, q, a) for i, q, a in rows if normal(q).split())
        whole = [normal(q) + b" " + normal(a) for _, q, a in rows]
        words, at = words_of(whole)
        grams, gat = runs(words, at, TERM)
        item = np.repeat(np.arange(len(rows)), np.diff(gat))
        pair, tf = np.unique(np.stack([grams, item.astype(np.uint64)], axis=1), axis=0, return_counts=True) if len(grams) else (np.zeros((0, 2), np.uint64), np.zeros(0))
        terms, first, df = np.unique(pair[:, 0], return_index=True, return_counts=True)
        doc = pair[:, 1].astype(np.int64)
        size = np.maximum(np.diff(gat), 1)
        idf = np.log1p((len(rows) - df + 0.5) / (df + 0.5))
        w = np.repeat(idf, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / size.mean())) if len(rows) else np.zeros(0)
        w = w / np.maximum(np.bincount(doc, w, len(rows)), 1e-30)[doc] if len(rows) else w
        first = np.r_[first, len(doc)]
        top = np.maximum.reduceat(w, first[:-1]) if len(terms) else np.zeros(0)
        code = np.repeat(np.arange(len(terms)), df) * (len(rows) // BLOCK + 1) + doc // BLOCK
        cell, cat = np.unique(code, return_index=True)
        block_top = np.maximum.reduceat(w, cat) if len(cell) else np.zeros(0)
        per = len(rows) // BLOCK + 1
        parts = []
        for p in (1, 2):
            ws, wat = words_of([normal(r[p]) for r in rows])
            gs, gat2 = runs(ws, wat, SHINGLE)
            key = np.unique(np.stack([np.repeat(np.arange(len(rows)), np.diff(gat2)).astype(np.uint64), gs], axis=1), axis=0) if len(gs) else np.zeros((0, 2), np.uint64)
            parts.append((key[:, 1], key[:, 0].astype(np.int64), np.full(len(key), p - 1)))
        shingle, s_item, s_part = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(shingle, kind="stable")
        sizes = np.bincount(s_item * 2 + s_part, minlength=2 * len(rows)).reshape(-1, 2)
        return cls(np.array([r[0] for r in rows], np.int64), terms, first, doc, w, top, np.searchsorted(cell // per, np.arange(len(terms) + 1)), cell % per, block_top, int(np.diff(at).max(initial=1)), shingle[order], s_item[order], s_part[order], sizes)

    def candidates(self, texts: list[bytes], least: float) -> np.ndarray:
        """Codes text * items + item of all that some passage retrieves with ``least`` of the item's full score."""
        n = len(self.items)
        if not n:
            return np.zeros(0, np.int64)
        words, at = words_of(texts)
        grams, gat = runs(words, at, TERM)
        place = np.searchsorted(self.terms, grams)
        hit = np.flatnonzero(self.terms[np.minimum(place, len(self.terms) - 1)] == grams)
        if not len(hit):
            return np.zeros(0, np.int64)
        term, text = place[hit], np.searchsorted(gat, hit, "right") - 1
        # passages start every `longest` runs and are twice as long, so each run is in two of them
        step = (hit - gat[text]) // self.longest
        stride = int(step.max()) + 2
        passage = np.concatenate([text * stride + step, text * stride + step + 1])
        both = np.unique(passage * len(self.terms) + np.concatenate([term, term]))
        passage, term = both // len(self.terms), both % len(self.terms)
        # bound by terms, then by blocks of items, then the score itself
        own, inv = np.unique(passage, return_inverse=True)
        use = np.bincount(inv, self.top[term])[inv] >= least - 1e-9
        passage, term = passage[use], term[use]
        count = self.block_first[term + 1] - self.block_first[term]
        entry = np.repeat(self.block_first[term] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(term) else np.zeros(0, int)
        cell = np.repeat(passage, count) * (n // BLOCK + 1) + self.blocks[entry]
        own, inv = np.unique(cell, return_inverse=True)
        good = own[np.bincount(inv, self.block_top[entry], len(own)) >= least - 1e-9] if len(own) else own
        count = self.first[term + 1] - self.first[term]
        entry = np.repeat(self.first[term] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(term) else np.zeros(0, int)
        where = np.repeat(passage, count)
        use = np.isin(where * (n // BLOCK + 1) + self.postings[entry] // BLOCK, good)
        code = where[use] * n + self.postings[entry[use]]
        own, inv = np.unique(code, return_inverse=True)
        found = own[np.bincount(inv, self.weights[entry[use]], len(own)) >= least - 1e-9] if len(own) else own
        return np.unique(found // n // stride * n + found % n)

    def verified(self, texts: list[bytes], codes: np.ndarray, overlap: float) -> list[tuple[int, int, float]]:
        """(text, item_id, share of question) of the codes whose question and answer shingles are in the text
        to the share ``overlap`` each; an empty answer needs nothing."""
        out = []
        n = len(self.items)
        for t in np.unique(codes // n) if len(codes) else []:
            words, at = words_of([texts[t]])
            wanted = codes[codes // n == t] % n
            sets = {m: runs(words, at, m)[0] for m in range(1, SHINGLE + 1)}
            shingle = np.unique(np.concatenate(list(sets.values())))
            lo, hi = np.searchsorted(self.shingles, shingle), np.searchsorted(self.shingles, shingle, "right")
            entry = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi) if a < b] or [np.zeros(0, int)])
            got = np.bincount(self.shingle_item[entry] * 2 + self.shingle_part[entry], minlength=2 * n).reshape(-1, 2)
            for i in wanted:
                share = got[i] / np.maximum(self.sizes[i], 1)
                if share[0] >= overlap and (share[1] >= overlap or not self.sizes[i, 1]):
                    out.append((int(t), int(self.items[i]), float(share[0])))
        return out


def question_and_answer(benchmark: DataFrame) -> DataFrame:
    """(item_id, question, answer) of a table (item_id, text): the last sentence is the answer, if there are two.

    Repeated ids count once, with their least text; items without a word never match.
    """
    one = benchmark.filter("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("t"))
    last = F.regexp_extract("t", r"(?s)^(.*[.!?\n])\s*([^.!?\n]*\p{Alnum}[^.!?\n]*[.!?]*\s*)$", 2)
    head = F.regexp_extract("t", r"(?s)^(.*[.!?\n])\s*([^.!?\n]*\p{Alnum}[^.!?\n]*[.!?]*\s*)$", 1)
    split = head.rlike(r"\p{Alnum}")
    return one.select("item_id", F.when(split, head).otherwise(F.col("t")).alias("question"), F.when(split, last).alias("answer"))


def matches(docs: DataFrame, items: DataFrame, least: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """(doc_id, item_id, share) of every benchmark item (item_id, question, answer) found in a whole text.

    ``least`` is the share of an item's own BM25 score that a passage must reach, ``overlap`` the share of
    five-word shingles of question and answer that the text must then hold.  Items are indexed in parts of
    bounded size, each of which is sent to all tasks in its turn.
    """
    spark = docs.sparkSession
    size = items.select(F.sum(F.size(F.split(F.concat_ws(" ", "question", "answer"), r"\s+"))).alias("n")).first()["n"] or 0
    parts = size // PART_WORDS + 1
    texts = docs.select("doc_id", "text")
    out = None
    for part in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else items
        sent = spark.sparkContext.broadcast(Index.build([tuple(r) for r in mine.select("item_id", "question", "answer").collect()]))

        def run(batch, sent=sent):
            index = sent.value
            plain = [normal(t) for t in batch.column("text").to_pylist()]
            found = index.verified(plain, index.candidates(plain, least), overlap)
            ids = batch.column("doc_id").to_pylist()
            return {"doc_id": [ids[t] for t, _, _ in found], "item_id": [i for _, i, _ in found], "share": [s for _, _, s in found]}

        got = map_texts(texts, run, "doc_id long, item_id long, share double")
        out = got if out is None else out.unionByName(got)
    return out


def flagged(docs: DataFrame, items: DataFrame, least: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items and the sorted item_ids found in it.

    A null or empty text holds nothing; rows that repeat a doc_id are one document.
    """
    found = matches(docs, items, least, overlap).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    ids = docs.select("doc_id").distinct()
    return ids.join(found, ids["doc_id"].eqNullSafe(found["doc_id"]), "left").select(
        ids["doc_id"], F.col("item_ids").isNotNull().alias("contaminated"), F.when(F.col("item_ids").isNull(), 0).otherwise(F.size("item_ids")).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item is found."""
    found = matches(docs, items, least, overlap).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_found"]), "left_anti")
