"""Secrets in texts: fixed patterns, and a likelihood ratio of two character Markov models."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import map_arrow, map_texts, slices

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINT = ("passw", "secret", "token", "api")
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: Symbols of the models; all other characters share the last one.
_SYMBOL = np.full(128, 64, np.int64)
for _k, _c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
    _SYMBOL[ord(_c)] = _k
SYMBOLS = 65
#: Steps that the overall share counts as, beside those met from a character.
LEAN = 1000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, by start and kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINT):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _values(text: str, spans: list) -> list[str]:
    """The secret strings of the spans: of an assignment its value."""
    return [_ASSIGN.match(text, s)[2] if k == 0 else text[s:e] for s, k, e in spans]


def _steps(words: list[str]) -> np.ndarray:
    """Codes first * SYMBOLS + second of all neighbouring characters; -1 between words."""
    a = np.frombuffer("\n".join(words).encode("latin-1"), np.uint8)
    code = _SYMBOL[a[:-1]] * SYMBOLS + _SYMBOL[a[1:]]
    return np.where((a[:-1] == 10) | (a[1:] == 10), -1, code)


def labelled_words(docs: DataFrame) -> DataFrame:
    """(label, step, n): neighbouring characters in known secrets (1) and in all other long words (0).

    Samples are labelled by the fixed patterns, over every whole text; the result has two rows for each of
    the SYMBOLS squared steps at most.
    """

    def run(batch):
        out = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
        rows = ([], [])
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            spans = base_spans(text)
            rows[1].extend(_values(text, spans))
            for s, _, e in reversed(spans):
                text = text[:s] + " " + text[e:]
            rows[0].extend(_WORD.findall(text))
        for label in (0, 1):
            if rows[label]:
                steps = _steps(rows[label])
                out[label] += np.bincount(steps[steps >= 0], minlength=SYMBOLS * SYMBOLS)
        label, step = np.nonzero(out)
        return {"label": label.astype(np.int32), "step": step.astype(np.int32), "n": out[label, step]}

    return map_texts(docs.select("text"), run, "label int, step int, n long").groupBy("label", "step").agg(F.sum("n").alias("n"))


class Models:
    """Log-likelihood ratio of each step: random strings against ordinary words."""

    def __init__(self, rows):
        n = np.full((2, SYMBOLS, SYMBOLS), 0.0)
        for label, step, count in rows:
            n[label].flat[step] += count
        # a character rarely met leans on the overall share of what follows, in either model
        share = (n.sum(axis=1) + 1) / (n.sum(axis=(1, 2)) + SYMBOLS)[:, None]
        plain, secret = (n + LEAN * share[:, None, :]) / (n.sum(axis=2, keepdims=True) + LEAN)
        self.ratio = np.log(secret / plain).ravel()

    def spans(self, text: str, taken: list, least: float, shortest: int) -> list[tuple[int, int, int]]:
        """Words of ``shortest`` characters or more, with letters and digits, that look random.

        The ratio must be ``least`` nats a step on average.  Words that touch a span in ``taken`` are left out.
        """
        found = [m for m in _WORD.finditer(text) if m.end() - m.start() >= shortest]
        out = []
        for m in found:
            word = m[0]
            if not any(c.isdigit() for c in word) or not any(c.isalpha() for c in word):
                continue
            if any(s < m.end() and m.start() < e for s, _, e in taken):
                continue
            if self.ratio[_steps([word])].mean() >= least:
                out.append((m.start(), 3, m.end()))
        return out


def train(samples: DataFrame) -> Models:
    """Models from (label, step, n); no samples of a label leave it with its prior."""
    return Models(sorted(map(tuple, samples.collect())))


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, models: Models, least: float = 1.0, shortest: int = 20) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text; a null text is empty.

    Offsets count code points, ends are exclusive.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batch):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            for kind in range(3):
                out[f"n_{KINDS[kind]}"].append(sum(k == kind for _, k, _ in spans))
            out["base_sha256"].append(hashlib.sha256(listed(spans).encode()).hexdigest())
            out["spans"].append(listed(sorted(spans + sent.value.spans(text or "", spans, least, shortest))))
        return {"doc_id": batch.column("doc_id"), **out}

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, models: Models, least: float = 1.0, shortest: int = 20, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found secret in text replaced by ``mark``; n_chars follows the text where it is given.

    Spans that overlap are replaced as one.  All rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)
    schema = docs.schema
    names = docs.columns

    def clean(text):
        spans = base_spans(text)
        spans = sorted(spans + sent.value.spans(text, spans, least, shortest))
        out, at = [], 0
        for s, _, e in spans:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]]) if spans else text

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t if t is None else clean(t) for t in part.column("text").to_pylist()]
                cols = {n: part.column(n) for n in names}
                cols["text"] = pa.array(texts, part.schema.field("text").type)
                if "n_chars" in cols:
                    old = part.column("n_chars").to_pylist()
                    before = part.column("text").to_pylist()
                    new = [o if a == b else len(b) for o, a, b in zip(old, before, texts)]
                    cols["n_chars"] = pa.array(new, part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], schema=part.schema)

    return map_arrow(docs, run, schema)
