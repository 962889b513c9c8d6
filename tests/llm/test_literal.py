"""Learned models and similarity joins against literal versions in plain loops."""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pytest

from tripweave.llm import jaccard, language, quality
from tripweave.llm.common import mix


def literal_counts(text):
    """Bucket -> count of the 1- to 3-grams; 0 is a gap, one opens the text and one follows it if it starts without a letter."""
    lower = (text or "").lower()
    seq = [0]
    for k, c in enumerate(lower):
        if c.isalpha():
            seq.append(ord(c))
        elif k == 0 or seq[-1]:
            seq.append(0)
    if len(seq) > 1 and not seq[-1]:
        seq.pop()  # a gap opens the next word only
    out = {}
    for n in range(1, 4):
        for k in range(len(seq) - n + 1):
            gram = seq[k : k + n]
            if gram == [0]:
                continue
            h = np.zeros(1, np.uint64)
            for m, c in enumerate(gram):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c) + np.uint64(m + 1))
            at = int(h[0]) % language.DIM
            out[at] = out.get(at, 0) + 1
    return out


def unit(v):
    size = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / size for k, x in v.items()} if size else v


def dot(a, b):
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def mean(vs):
    return {k: sum(v.get(k, 0.0) for v in vs) / len(vs) for k in set().union(*vs)}


def literal_clusters(vs, k):
    centres = [mean(vs)]
    while len(centres) < min(k, len(vs)):
        centres.append(min(vs, key=lambda v: max(dot(v, c) for c in centres)))
    for _ in range(8):
        centres = [unit(c) for c in centres]
        near = [max(range(len(centres)), key=lambda c: dot(v, centres[c])) for v in vs]
        centres = [mean([v for v, x in zip(vs, near) if x == c]) if c in near else centres[c] for c in range(len(centres))]
    return [unit(c) for c in centres]


@pytest.fixture(scope="module")
def speech():
    r = random.Random(31)
    words = {
        "aa": ["the", "thing", "with", "over", "house", "water", "light"], "bb": ["él", "niño", "años", "casa", "quiere", "agua"],
        "cc": ["straße", "über", "wasser", "haus", "licht", "ding"],
    }
    make = lambda x: r.choice(["", "¡", "- "]) + r.choice([" ", ", ", "! 7 "]).join(r.choice(words[x]) for _ in range(r.randint(4, 25))) + r.choice(["", ".", " 9"])
    return [(i, make(x), x) for i, x in enumerate(["aa", "bb", "cc"] * 14)]


def test_counts_do_not_hang_on_the_batch(speech):
    texts = [t for _, t, _ in speech] + ["", None, "!", "a", "!a", "a!", "", "İstanbul 漢字"]
    whole = language.counts_of(texts)
    for k, t in enumerate(texts):
        alone = language.counts_of([t])[0]
        assert np.array_equal(alone, whole[k])
        assert {int(i): int(alone[i]) for i in np.flatnonzero(alone)} == literal_counts(t)


@pytest.mark.parametrize("clusters", [1, 3])
def test_centroids_equal_a_literal_version(spark, speech, clusters):
    learn, ask = speech[:30], speech[30:] + [(90, "xyz qqq", None), (91, "", None), (92, None, None), (93, "漢字", None)]
    model = language.fit(spark.createDataFrame(learn, "doc_id long, text string, lang string").repartition(5), clusters=clusters)
    counts = [literal_counts(t) for _, t, _ in learn]
    held = {}
    for c in counts:
        for k in c:
            held[k] = held.get(k, 0) + 1
    weigh = lambda c: unit({k: math.log1p(n) * (math.log((1 + len(learn)) / (1 + held.get(k, 0))) + 1) for k, n in c.items()})
    centroids, least = [], 1.0
    for lang in ("aa", "bb", "cc"):
        vs = [weigh(c) for c, (_, _, x) in zip(counts, learn) if x == lang]
        own = literal_clusters(vs, clusters)
        centroids += [(lang, c) for c in own]
        least = min(least, *(max(dot(v, c) for c in own) for v in vs))
    assert model.langs == [lang for lang, _ in centroids] and model.least == pytest.approx(0.5 * least, abs=1e-4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in ask], "doc_id long, text string").repartition(3)
    for r in language.identify(docs, model).collect():
        v = weigh(literal_counts({i: t for i, t, _ in ask}[r.doc_id]))
        lang, score = max(((x, dot(v, c)) for x, c in centroids), key=lambda b: b[1]) if v else ("und", 0.0)
        assert r.score == pytest.approx(score, abs=1e-4)
        assert score < 1e-3 or r.lang_pred == lang
        assert r.rejected == (score < 0.5 * least)


def literal_leaves(g, h, depth, l2):
    """The values of a tree over ordered bins, each cut tried by its own sums."""
    if depth and len(g) > 1:
        gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + l2)
        cuts = [(gain(0, c) + gain(c, len(g)), -c) for c in range(1, len(g))]
        best, c = max(cuts)
        if best > gain(0, len(g)) + 1e-9:
            return literal_leaves(g[:-c], h[:-c], depth - 1, l2) + literal_leaves(g[-c:], h[-c:], depth - 1, l2)
    return [sum(g) / (sum(h) + l2)] * len(g)


def literal_quadrants(cells, size, l2):
    """(gain, table) of the best cut of two features at once; ``cells`` has (bin, bin, g, h) of each row."""
    best = None
    for i in range(1, size):
        for j in range(1, size):
            sums = {(a, b): [0.0, 0.0] for a in (False, True) for b in (False, True)}
            for x, y, g, h in cells:
                sums[x >= i, y >= j][0] += g
                sums[x >= i, y >= j][1] += h
            gain = sum(g * g / (h + l2) for g, h in sums.values())
            if best is None or gain > best[0] + 1e-12:
                best = gain, i, j, {k: g / (h + l2) for k, (g, h) in sums.items()}
    gain, i, j, value = best
    return gain, [[value[x >= i, y >= j] for y in range(size)] for x in range(size)]


def literal_scores(x, y, bins, rounds, rate, pairs, pair_rounds, l2=5.0):
    """Scores of the rows learned from, by cyclic boosting with a loop for everything."""
    n, m = len(x), len(x[0])
    place = []
    for k in range(m):
        cuts = sorted(set(np.quantile([r[k] for r in x], np.linspace(0, 1, bins + 1)[1:-1]).tolist()))
        place.append([sum(c <= r[k] for c in cuts) for r in x])
    share = (sum(y) + 1) / (n + 2)
    z = [math.log(share / (1 - share))] * n
    slopes = lambda: [(y[i] - p, p * (1 - p)) for i in range(n) for p in [1 / (1 + math.exp(-z[i]))]]
    for _ in range(rounds):
        for k in range(m):
            g, h = [0.0] * (bins + 1), [0.0] * (bins + 1)
            for i, (a, b) in enumerate(slopes()):
                g[place[k][i]] += a
                h[place[k][i]] += b
            step = literal_leaves(g, h, 2, l2)
            for i in range(n):
                z[i] += rate * step[place[k][i]]

    def both(j, k):
        return literal_quadrants([(place[j][i], place[k][i], a, b) for i, (a, b) in enumerate(slopes())], bins + 1, l2)

    order = sorted(combinations(range(m), 2), key=lambda q: (-both(*q)[0], q))
    for _ in range(pair_rounds):
        for j, k in order[:pairs]:
            step = both(j, k)[1]
            for i in range(n):
                z[i] += rate * step[place[j][i]][place[k][i]]
    return [1 / (1 + math.exp(-v)) for v in z]


def test_additive_model_equals_a_literal_version():
    r = np.random.default_rng(17)
    x = r.normal(size=(70, len(quality.FEATURES)))
    y = ((x[:, 0] + x[:, 3] * x[:, 5] + 0.3 * r.normal(size=70)) > 0).astype(float)
    how = {"bins": 4, "rounds": 3, "rate": 0.3, "pairs": 2, "pair_rounds": 2}
    model = quality.fit_tables(x, y, **how)
    assert len(model.pairs) == 2
    assert model.score(x) == pytest.approx(literal_scores(x.tolist(), y.tolist(), **how), abs=1e-9)


def test_additive_model_of_labelled_texts(spark):
    """The fit of the labelled rows is that of their features, and the scores are those of its tables."""
    r = random.Random(23)
    texts = ["", "a"] + [" ".join(r.choice(["plain", "words", "$$ 99", "Here.\n", "über"]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    rows = [(i, t, i % 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    model = quality.fit(df)
    x = np.array([quality.features(t) for t in texts])
    same = quality.fit_tables(x, np.array([float(q) for _, _, q in rows]))
    want = same.score(x)
    assert sorted((s.doc_id, s.predicted) for s in quality.score(df, model).collect()) == [(i, int(w >= 0.5)) for i, w in enumerate(want)]
    assert sorted(s.score for s in quality.score(df, model).collect()) == pytest.approx(sorted(want), abs=1e-9)


def test_jaccard_recall_on_a_whole_table(spark):
    """Links of every twentieth document of sf0.01 against all documents: none is lost, none is wrong."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.n_links for r in jaccard.join(docs).collect()}
    sets, holders = {}, {}
    for r in docs.select("doc_id", "text").collect():
        w = (r.text or "").lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for g in sets[r.doc_id]:
            holders.setdefault(g, []).append(r.doc_id)
    asked = [i for i in sets if i % 20 == 0]
    for i in asked:
        shared = {}
        for g in sets[i]:
            for j in holders[g]:
                shared[j] = shared.get(j, 0) + 1
        assert got[i] == sum(j != i and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9 for j, n in shared.items())
    assert len(asked) >= 50 and len(got) == len(sets)
