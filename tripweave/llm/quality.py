"""Quality of a text by a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, some pairs of features have one over both; a score is the
sum of the looked-up values through the logistic function.  The tables are learned by cyclic boosting: one
feature after the other gets a shallow tree on the gradients, in many small rounds.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import map_texts, remainder

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_spread", "digits", "upper", "punctuation", "symbols", "non_ascii",
    "line_ends", "distinct_words", "top_word", "copied_lines", "longest_line", "ends_per_word", "stops", "commas", "rare_marks",
)
_CLASS = np.full(256, 8)
for _k, _chars in enumerate((b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".!?", b",;:'\"-()", b"#$%&*@|<>{}[]\\/=+~^_`", b"\n", b" \t\r", bytes(range(128, 256)))):
    _CLASS[list(_chars)] = _k


def features(text: str | None) -> list[float]:
    """The features of one whole text; an empty or null text has zeros."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw.strip():
        return [0.0] * len(FEATURES)
    n = len(raw)
    by = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9)
    words = raw.lower().split()
    m = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.float64, len(words))
    count = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    top = max(count.values())
    return [
        math.log1p(n), math.log1p(m), sizes.mean(), sizes.std(), by[0] / n, by[1] / n, (by[2] + by[3]) / n, by[4] / n, by[7] / n,
        by[5] / n, len(count) / m ** 0.9, top / m, 1 - len(set(lines)) / len(lines), math.log1p(max(map(len, lines))),
        by[2] / m, sum(v for k, v in count.items() if len(k) <= 3) / m, by[3] / m, raw.count(b"!!") / m,
    ]


@dataclass
class Tables:
    """Cuts of each feature's bins, the tables by feature and by pair, and the intercept."""

    cuts: list[np.ndarray]
    main: np.ndarray
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of features, by additions from the tables."""
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for k in range(b.shape[1]):
            z += self.main[k][b[:, k]]
        for (j, k), t in self.pairs.items():
            z += t[b[:, j], b[:, k]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _leaves(g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> np.ndarray:
    """A shallow tree over ordered bins with gradient sums g and curvatures h: the value of each bin."""
    out = np.full(len(g), g.sum() / (h.sum() + l2))
    if depth == 0 or len(g) < 2:
        return out
    left_g, left_h = g.cumsum()[:-1], h.cumsum()[:-1]
    gain = left_g**2 / (left_h + l2) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + l2)
    best = int(gain.argmax())
    if gain[best] <= g.sum() ** 2 / (h.sum() + l2) + 1e-9:
        return out
    return np.r_[_leaves(g[: best + 1], h[: best + 1], depth - 1, l2), _leaves(g[best + 1 :], h[best + 1 :], depth - 1, l2)]


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """The best cut of each of two features at once: table of values and its gain."""
    sums = lambda a: np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    sg, sh = sums(g), sums(h)
    total = 0
    parts = []
    for s in (sg, sh):
        a = s[1:-1, 1:-1]
        right, down, all_ = s[1:-1, -1:] - a, s[-1:, 1:-1] - a, s[-1, -1]
        parts.append((a, right, down, all_ - a - right - down))
    total = sum(pg**2 / (ph + l2) for pg, ph in zip(*parts))
    i, j = np.unravel_index(total.argmax(), total.shape)
    out = np.empty_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + l2)
    return out, float(total[i, j] - g.sum() ** 2 / (h.sum() + l2))


def fit_tables(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.15, pairs: int = 8, pair_rounds: int = 60, l2: float = 5.0) -> Tables:
    """Learn from features and 0/1 labels; without both labels all scores are the same."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(len(FEATURES))]
    model = Tables(cuts, np.zeros((len(cuts), bins + 1)))
    share = (y.sum() + 1) / (len(y) + 2)
    model.base = math.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        return model
    b = model.bins(x)
    z = np.full(len(y), model.base)
    chance = lambda: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(rounds):
        for k in range(len(cuts)):
            p = chance()
            g = np.bincount(b[:, k], y - p, bins + 1)
            h = np.bincount(b[:, k], p * (1 - p), bins + 1)
            step = rate * _leaves(g, h, 2, l2)
            model.main[k] += step
            z += step[b[:, k]]
    sums = lambda j, k, w: np.bincount(b[:, j] * (bins + 1) + b[:, k], w, (bins + 1) ** 2).reshape(bins + 1, bins + 1)
    p = chance()
    gains = {(j, k): _quadrants(sums(j, k, y - p), sums(j, k, p * (1 - p)), l2)[1] for j, k in combinations(range(len(cuts)), 2)}
    chosen = sorted(gains, key=lambda q: (-gains[q], q))[:pairs]
    model.pairs = {q: np.zeros((bins + 1, bins + 1)) for q in chosen}
    for _ in range(pair_rounds):
        for j, k in chosen:
            p = chance()
            step = rate * _quadrants(sums(j, k, y - p), sums(j, k, p * (1 - p)), l2)[0]
            model.pairs[j, k] += step
            z += step[b[:, j], b[:, k]]
    return model


def fit(labelled: DataFrame, sample: int = 12_000) -> Tables:
    """Learn from rows (doc_id, text, quality).  The fit is on a bounded sample: the ``sample`` different rows whose
    hashed id comes first, over all rows; only their features reach the driver.  Rows without label or doc_id teach nothing."""
    keys = ["doc_id", "quality", "digest"]
    known = labelled.filter("quality is not null and doc_id is not null").select("doc_id", "text", "quality")
    ids = known.select("doc_id").distinct().select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample).select("doc_id")
    # only texts of these ids move; copies of a row teach once, and are put together before that
    chosen = known.join(ids, "doc_id", "left_semi").withColumn("digest", F.xxhash64("text"))
    chosen = chosen.groupBy(*keys).agg(F.first("text").alias("text"))

    def run(batch):
        rows = [features(t) for t in batch.column("text").to_pylist()]
        return {**{k: batch.column(k) for k in keys}, "x": rows}

    rows = map_texts(chosen, run, "doc_id long, quality int, digest long, x array<double>")
    # an id may have many different rows
    rows = rows.orderBy(F.xxhash64("doc_id"), *keys).limit(sample)
    got = sorted((r["doc_id"], r["quality"], tuple(r["x"])) for r in rows.collect())
    x = np.array([r[2] for r in got]).reshape(-1, len(FEATURES))
    return fit_tables(x, np.array([float(r[1]) for r in got]))


def score(docs: DataFrame, model: Tables) -> DataFrame:
    """(doc_id, score, predicted) of every whole text; empty and null texts have the features 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        s = sent.value.score(np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES)))
        return {"doc_id": batch.column("doc_id"), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, quality) of the documents to learn from, which are those of remainder 0 and 2."""
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.filter(remainder("doc_id", 3) != 1).select("doc_id", "text").join(marks, "doc_id")
