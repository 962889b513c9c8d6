"""Sharding, whitening and spelling variants against literal versions and SQL, with nulls, empty texts, ties and copies."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from compare import difference, duck, oracle_rows, spark_rows
from pyspark.sql import functions as F

from tripweave.llm import queries, shard, spelling, whitening

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_sharding", "op13_spelling"])
def test_queries_match_sql(spark, name):
    got = spark_rows(queries.QUERIES[name](spark, SF_DIR))
    assert difference(got, oracle_rows(duck(SF_DIR), queries.ORACLE_SQL[name])) is None


# --- shards -------------------------------------------------------------------------------------


def literal_shards(rows, n):
    """``rows`` (key, size) in order: (key, shard, slot) by the middle byte."""
    total, before, out, used = sum(s for _, s in rows), 0, [], collections.Counter()
    for key, size in rows:
        at = min((2 * before + size) * n // (2 * total), n - 1) if total else 0
        out.append((key, at, used[at]))
        used[at] += 1
        before += size
    return out


@pytest.mark.parametrize("n", [1, 3, 40])
def test_shards_are_cut_at_equal_targets(spark, n):
    r = random.Random(1)
    rows = [(k, r.choice([0, 16, 17, 300, 9000])) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, size long").repartition(7).withColumn("shard", F.lit("x")).withColumn("part", F.lit(0))
    got = shard.balanced(df, [F.col("k")], F.col("size"), n)
    assert got.columns == ["k", "size", "part", "shard", "slot"]
    assert sorted(got.select("k", "shard", "slot").collect()) == literal_shards(rows, n)


def test_copies_of_one_row_fill_many_shards(spark):
    """All rows but a few are one row; sizes may be null, and the table empty."""
    df = spark.createDataFrame([(None, None)] + [(1, 20)] * 3000 + [(2, -5), (3, 10)], "k long, size long")
    got = shard.balanced(df, [F.col("k")], F.col("size"), 10).collect()
    assert len(got) == 3003
    held = collections.defaultdict(list)
    for row in got:
        held[row["shard"]].append(row["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    assert {len(v) for k, v in held.items() if 0 < k < 9} == {300} and len(held) == 10
    assert shard.balanced(df.limit(0), [F.col("k")], F.col("size"), 10).count() == 0
    assert {(x["shard"], x["slot"]) for x in shard.balanced(df.limit(1), [F.col("k")], F.col("size"), 10).collect()} == {(0, 0)}


def test_sizes_and_sums_of_texts(spark):
    texts = [None, "", "é\n", "a" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [tuple(x) for x in df.select(shard.text_bytes(), shard.text_crc32()).collect()]
    assert got == [(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts]


# --- whitening ----------------------------------------------------------------------------------


@pytest.mark.parametrize("n, m", [(1, 1), (2, 2), (3, 4), (20, 4), (64, 6)])
def test_eigenvectors_equal_the_librarys(n, m):
    r = np.random.default_rng(n)
    a = r.normal(size=(n, 2 * n))
    a = a @ a.T
    values, vectors = whitening.leading(a, m)
    want, w = np.linalg.eigh(a)
    m = min(m, n)
    assert np.allclose(values, want[::-1][:m], rtol=1e-12)
    assert np.allclose(np.abs((vectors * w.T[::-1][:m]).sum(axis=1)), 1, atol=1e-11)
    assert np.allclose(vectors @ vectors.T, np.eye(m), atol=1e-13)


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 1, 1, 0], [1, 1, 1, 1], [3, 3 - 1e-13, 2, 1e-9], [0, 0, 0], [7, 0, 0, 0, 0]])
def test_clusters_of_equal_values_give_orthogonal_vectors(spectrum):
    r = np.random.default_rng(7)
    q, _ = np.linalg.qr(r.normal(size=(len(spectrum), len(spectrum))))
    a = q @ np.diag(spectrum).astype(float) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.leading(a, 4)
    assert np.allclose(values, sorted(spectrum, reverse=True)[:4], atol=1e-12)
    assert np.allclose(vectors @ vectors.T, np.eye(len(vectors)), atol=1e-12)
    assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-12
    diagonal, v = whitening.leading(np.diag(np.array(spectrum, float)), 4)
    assert np.allclose(diagonal, sorted(spectrum, reverse=True)[:4], atol=1e-14) and np.allclose(v @ v.T, np.eye(len(v)), atol=1e-12)


def literal_whitening(rows):
    """{id: (n, deviation, |whitened|, explained)} of (id, vector) by whole numbers and the library's eigenvectors."""
    kept = [(k, tuple(math.floor(256 * c) for c in v)) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = sorted({x for _, x in kept})
    n, s = len(xs), [sum(c) for c in zip(*xs)]
    x = np.array(xs, float)
    cov = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:4], vectors.T[::-1][:4]
    out = collections.defaultdict(list)
    for k, x in kept:
        far = sum((n * a - b) ** 2 for a, b in zip(x, s))
        z = (np.array(x) - np.array(s) / n) @ vectors.T / np.sqrt(values)
        out[k].append((n, far, np.abs(z), values / np.trace(cov)))
    return out


def test_whitened_vectors_equal_a_literal_version(spark):
    r = np.random.default_rng(5)
    rows = [(k, [float(c) for c in r.normal(size=6) * [5, 3, 2, 1, 0.5, 0.1]]) for k in range(300)]
    rows += [(900, rows[0][1]), (0, rows[0][1]), (901, [0.0] * 6), (902, [-0.001] * 6)]
    bad = [(910, None), (911, [None] * 6), (912, [float("nan")] + [0.0] * 5), (913, [float("inf")] + [0.0] * 5), (None, rows[3][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "n": F.lit("n")})
    grid = whitening.on_grid(df.repartition(5))
    got = whitening.whiten(grid, whitening.fit(grid)).collect()
    want = literal_whitening(rows + bad)
    seen = collections.Counter()
    for row in got:
        n, far, z, share = want[row["vec_id"]][0]
        c = row["component"] - 1
        seen[row["vec_id"]] += 1
        assert (row["n"], row["deviation"]) == (n, far)
        assert abs(abs(row["whitened"]) - z[c]) < 1e-9 and abs(row["explained"] / share[c] - 1) < 1e-9
        assert 0 <= row["identity_error"] < 1e-9
    assert seen == {k: 4 * len(v) for k, v in want.items()}
    signs = {(row["component"], row["whitened"] > 0) for row in got if row["vec_id"] in (0, 900)}
    assert len(signs) == 4


def test_single_precision_vectors_of_the_table(spark):
    got = queries.op12_whitening(spark, SF_DIR).collect()
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = literal_whitening([(t[0], t[1]) for t in table])
    assert len(got) == 4 * len(table)
    for row in got:
        n, far, z, share = want[row["vec_id"]][0]
        c = row["component"] - 1
        assert (row["n"], row["deviation"]) == (n, far) and row["identity_error"] <= 1e-4
        assert abs(abs(row["whitened"]) - z[c]) < 1e-8 and abs(row["explained"] / share[c] - 1) < 1e-10


def test_odd_tables_of_vectors(spark):
    """Empty tables, empty vectors, equal vectors, two lengths, huge entries, fewer dimensions than components."""
    def run(rows):
        grid = whitening.on_grid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        return whitening.whiten(grid, whitening.fit(grid)).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [])]) == [] and run([(1, [2.0, 3.0])] * 3) == []
    got = run([(1, [0.0]), (2, [1.0]), (3, [0.0, 5.0]), (4, [0.0, 7.0]), (5, [1.0, 6.0]), (6, [])])
    assert {(r["vec_id"], r["component"]) for r in got} == {(1, 1), (2, 1), *((v, c) for v in (3, 4, 5) for c in (1, 2))}
    assert {r["n"] for r in got if r["vec_id"] < 3} == {2} and {r["n"] for r in got if r["vec_id"] > 2} == {3}
    got = run([(1, [1e15]), (2, [-1e15]), (3, [1e300])])
    assert {r["vec_id"] for r in got} == {1, 2} and {r["deviation"] for r in got} == {None}
    assert all(abs(abs(r["whitened"]) - 1) < 1e-12 for r in got)


# --- spelling -----------------------------------------------------------------------------------


def literal_words(docs):
    n = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def literal_groups(words):
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_words_of_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, "123 --"), (None, "Straße ÉCLAIRS éclairs ÷×÷×÷×÷ ÷×÷×÷×÷ plainword plainword"), (4, "plainwordé Plainwordé plainwordé")]
    docs += [(k, "Einlongword twolongwords Ÿlongword " * 40) for k in range(5, 60)] + [(70, "longword " * 50_000), (71, "x" * 300_000), (71, "x" * 300_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "run": F.lit("a"), "h": F.lit(2), "id": F.lit(3)})
    got = {r["word"]: r["n"] for r in spelling.corpus_words(df).collect()}
    assert got == literal_words(docs) and len(got) > 8


@pytest.mark.parametrize("limit", [1, 50, 1 << 16])
def test_variants_equal_all_pairs(spark, limit):
    r = random.Random(11)
    words = {}
    bases = ["".join(r.choice("abé") for _ in range(r.randint(7, 10))) for _ in range(30)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ab" * 30]
    for base in bases:
        words[base] = r.choice([2, 30, 400, 5000, 70000])
        for _ in range(12):
            w, i = base, r.randrange(len(base))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abé") + w[i:], w[:i] + r.choice("abé") + w[i + 1 :], w + "b"])
            if len(w) >= 7:
                words.setdefault(w, r.choice([2, 3, 20, 300]))
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumns({"form": F.lit("f"), "s": F.lit(1), "chunk": F.lit(2)})
    got = {tuple(x) for x in spelling.group(df, limit=limit).select(*COLUMNS).collect()}
    assert got == literal_groups(words)
    assert any(x[1] and x[2] != x[1] for x in got)


def test_no_words(spark):
    assert spelling.group(spark.createDataFrame([], "word string, n long")).count() == 0
    got = spelling.group(spark.createDataFrame([("abcdefg", 2), ("é", 3), ("", 9)], "word string, n long"))
    assert {(x["word"], x["n_near"]) for x in got.collect()} == {("abcdefg", 0), ("é", 0), ("", 0)}


def test_chains_lead_to_the_root(spark):
    chain = ["a" * 7 + "b" * k for k in range(9)]
    words = {w: 2 * 10**k for k, w in enumerate(chain)}
    got = {x["word"]: x["root"] for x in spelling.group(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(got.values()) == {chain[-1]}
