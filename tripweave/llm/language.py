"""Language of a text by its nearest centroid among clustered TF-IDF vectors of letter n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tripweave.llm.common import map_arrow, map_texts, mix, remainder, slices

DIM = 1 << 13
_letters = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def counts_of(texts: list[str | None]) -> np.ndarray:
    """Rows of hashed counts of 1- to 3-grams over letters; all else is one gap between words."""
    lower = [(t or "").lower() for t in texts]
    a = np.frombuffer("\n".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts) + 1), [1, *(len(t) + 1 for t in lower)]) - 1
    letter = _is_letter()[a]
    use = letter | np.r_[True, letter[:-1]] | np.r_[False, doc[1:] != doc[:-1]]
    a, doc, letter = np.where(letter, a, 0)[use], doc[use], letter[use]
    doc = np.where(letter, doc, np.r_[doc[1:], -1])  # a gap opens the next word, and the last one opens none
    counts = np.zeros(len(texts) * DIM, np.float32)
    h = np.zeros(len(a), np.uint64)
    for n in range(1, 4):
        h = h[: len(a) - n + 1]
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + a[n - 1 :] + np.uint64(n))
        own, last = doc[: len(h)], doc[n - 1 :]
        ok = (own >= 0) & (own == last) & ((a[: len(h)] > 0) | (n > 1))
        key = own[ok] * DIM + (h[ok] & np.uint64(DIM - 1)).astype(np.int64)
        counts += np.bincount(key, minlength=len(counts)).astype(np.float32)
    return counts.reshape(len(texts), DIM)


@dataclass
class Centroids:
    """``langs[i]`` is the language of row i of ``rows``; ``least`` is the cosine below which a text is rejected."""

    idf: np.ndarray
    rows: np.ndarray
    langs: list[str]
    least: float

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine with its nearest centroid, and whether the text is rejected.

        No letter or no learned language gives ``und`` with 0, rejected.
        """
        langs, scores = [], np.zeros(len(texts))
        for at in range(0, len(texts), 128):
            counts = counts_of(texts[at : at + 128])
            if not self.langs:
                langs += ["und"] * len(counts)
                continue
            cosine = self.vectors(counts) @ self.rows.T
            best = cosine.argmax(axis=1)
            some = counts.any(axis=1)
            scores[at : at + len(counts)] = np.where(some, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0)
            langs += [self.langs[b] if s else "und" for b, s in zip(best, some)]
        return langs, scores, np.array([x == "und" for x in langs], bool) | (scores < self.least)


def _clusters(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, started from the rows farthest from those taken so far."""
    centres = v.mean(axis=0, keepdims=True)
    while len(centres) < min(k, len(v)):
        centres = np.vstack([centres, v[(v @ centres.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)
        near = (v @ centres.T).argmax(axis=1)
        centres = np.vstack([v[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)


def fit(labelled: DataFrame, per_lang: int = 400, clusters: int = 4, slack: float = 0.5) -> Centroids:
    """Learn from rows (doc_id, text, lang); rows without text, letters or lang teach nothing.

    The fit is on a bounded sample: of each language the ``per_lang`` different rows whose hashed id comes first, chosen
    over all rows.  Only their sparse counts reach the driver.  A text is rejected where its cosine is under
    ``slack`` times the least that any sampled text has with its own language.
    """
    keys = ["doc_id", "lang", "digest"]
    known = labelled.filter("lang is not null and text is not null").select("doc_id", "lang", "text", F.xxhash64("text").alias("digest"))
    order = ["h", *keys]
    picked = (
        known.select(*keys).distinct().withColumn("h", F.xxhash64("doc_id"))
        # a language may hold most rows: first the best of each of 64 parts of it, then the best of those
        .withColumn("k", F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy(*order)))
        .filter(F.col("k") <= per_lang)
        .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        .filter(F.col("k") <= per_lang)
        .select(*keys)
    )
    # copies of a row teach once, and are put together before they are sent anywhere
    rows = known.join(picked, keys, "left_semi").groupBy(*keys).agg(F.first("text").alias("text")).select("lang", "text")

    def sparse(batch):
        texts, out = batch.column("text").to_pylist(), {"lang": batch.column("lang").to_pylist(), "at": [], "n": []}
        for begin in range(0, len(texts), 128):
            for row in counts_of(texts[begin : begin + 128]):
                at = np.flatnonzero(row)
                out["at"].append(at.astype(np.uint16).tobytes())
                out["n"].append(row[at].astype(np.float32).tobytes())
        return out

    got = sorted(map(tuple, map_texts(rows, sparse, "lang string, at binary, n binary").filter("length(at) > 0").collect()))
    langs = sorted({r[0] for r in got})
    counts = np.zeros((len(got), DIM), np.float32)
    for i, (_, at, n) in enumerate(got):
        counts[i, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.float32)
    model = Centroids(np.log((1 + len(got)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1, np.zeros((0, DIM), np.float32), [], 0.0)
    own = np.array([r[0] for r in got])
    least = 1.0
    for lang in langs:
        v = model.vectors(counts[own == lang])
        c = _clusters(v, clusters)
        model.rows = np.vstack([model.rows, c])
        model.langs += [lang] * len(c)
        least = min(least, float((v @ c.T).max(axis=1).min()))
    model.least = slack * least if langs else 0.0
    return model


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        langs, scores, rejected = sent.value.predict(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": scores, "rejected": rejected}

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Centroids) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(~sent.value.predict(part.column("text").to_pylist())[2]))

    return map_arrow(docs, run, docs.schema)


def learned_from(docs: DataFrame) -> DataFrame:
    return docs.filter(remainder("doc_id", 3) != 1)
