"""Byte-level BPE by backtracking over longest token matches; decoding by an offset table.

The tokens of a piece are exactly those of the merges: a sequence in which every two neighbours are
compatible is the one that merging gives.  An Aho-Corasick automaton yields the longest token at each place,
and the search falls back to the next shorter token only where neighbours are not compatible.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tripweave.llm.common import map_arrow, map_texts, slices

_PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Words with the space before them, and white space as the pattern above takes it.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNKS = re.compile(rf" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
#: Chunks kept by a worker: so many that came twice or more, and so many new ones.
_KEEP = 1 << 18
_PAIRS = 1 << 20  # pairs of tokens whose compatibility is kept


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the rest follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Coder:
    """A vocabulary file's encoder and decoder.  Inside, tokens are numbered by merge order, bytes first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        vocab = spec["model"]["vocab"]
        raw = lambda s: bytes(chars[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = [t for t in vocab if t not in self.added]
        self.bytes = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t in plain:
            self.bytes[vocab[t]] = raw(t)
        for t, i in self.added.items():
            self.bytes[i] = t.encode()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        order, self.ids, self.text, self.split = {}, [], [], []
        for c in sorted(chars, key=chars.get):
            order[c] = len(self.ids)
            self.ids.append(vocab[c])
            self.text.append(raw(c))
            self.split.append((order[c], order[c]))
        self.pair = {}
        for x, y in merges:
            n = order.setdefault(x + y, len(self.ids))
            if n == len(self.ids):
                self.ids.append(vocab[x + y])
                self.text.append(raw(x + y))
                self.split.append((order[x], order[y]))
            self.pair.setdefault((order[x], order[y]), n)
        number = {t: n for n, t in enumerate(self.text)}
        self.shorter = [next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in number), -1) for t in self.text]
        self.machine = ahocorasick.Automaton()
        for n, t in enumerate(self.text):
            self.machine.add_word(t.decode("latin-1"), n)
        self.machine.make_automaton()
        self.known, self.young, self.old, self.pieces = {}, {}, {}, {}
        self.size = [len(t) for t in self.text]
        self.longest = max(self.size, default=0)
        self.number = {t.decode("latin-1"): n for n, t in enumerate(self.text)}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        lengths = np.array([len(b) for b in self.bytes])
        self.offset = np.r_[0, np.cumsum(lengths)]
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)

    def compatible(self, one: int, two: int) -> bool:
        """Whether merging leaves ``one`` and ``two`` side by side: no merge across their border comes earlier."""
        got = self.known.get((one, two))
        if got is None:
            if len(self.known) >= _PAIRS:
                self.known.clear()
            got = self.known[one, two] = self._compatible(one, two)
        return got

    def _compatible(self, left: int, right: int) -> bool:
        limit = len(self.ids) + 1
        while True:
            if self.pair.get((left, right), limit) < limit:
                return False
            if left > right:  # undo the later merge
                limit = left
                inner = self.split[left][1]
                if inner == left:
                    return True
                left = inner
            else:
                inner = self.split[right][0]
                if inner != right:
                    limit, right = right + 1, inner
                    continue
                inner = self.split[left][1]
                if inner == left:
                    return True
                limit, left = left, inner

    def piece(self, data: str) -> list[int]:
        """Tokens of one piece, given as one character a byte."""
        number, known, size = self.number, self.known, self.size
        token = number.get(data)
        if token is not None:
            return [token]
        reach, shorter, longest = self.machine.longest_prefix, self.shorter, self.longest
        spoilt = set()
        out, at, n, last = [], 0, len(data), -1
        token = None
        while True:
            if token is None:  # the automaton's longest path, cut back to its last token
                rest = data[at : at + longest]
                rest = rest[: reach(rest)]
                token = number.get(rest)
                while token is None:
                    rest = rest[:-1]
                    token = number.get(rest)
            end = at + size[token]
            if end not in spoilt:
                fits = last < 0 or known.get((last, token))
                if fits is None:
                    fits = self.compatible(last, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    at, last, token = end, token, None
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                spoilt.add(at)
                token = out.pop()
                last = out[-1] if out else -1
                at -= size[token]

    def _chunk(self, text: str) -> bytes:
        """Ids of a word with the space before it, or of white space; chunks met twice are kept longest."""
        got = self.young.pop(text, None)
        if got is not None:
            if len(self.old) < _KEEP:
                self.old[text] = got
                return got
        else:
            parts = _PIECES.findall(text)
            got = b"".join([self.pieces.get(p) or self._piece(p) for p in parts])
        if len(text) < 64:
            if len(self.young) > _KEEP:
                self.young.clear()
            self.young[text] = got
        return got

    def _piece(self, text: str) -> bytes:
        order = self.piece(text.encode("utf-8").decode("latin-1"))
        ids = self.ids
        got = struct.pack(f"<{len(order)}I", *[ids[t] for t in order])
        if len(text) < 64:
            if len(self.pieces) > _KEEP:
                self.pieces.clear()
            self.pieces[text] = got
        return got

    def _plain(self, text: str) -> bytes:
        # white space opens a piece wherever it follows a word, so words can be looked up one by one
        known, chunk = self.old.get, self._chunk
        return b"".join([known(c) or chunk(c) for c in _CHUNKS.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian 32-bit integers; added tokens in the text stand for themselves."""
        if self.special is None:
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the ids' text; bytes that are not UTF-8 become replacement characters."""
        ids = np.frombuffer(ids, "<u4")
        first, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        place = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]] if len(ids) else first, size) + np.arange(size.sum())
        raw = self.blob[place].tobytes()
        return raw.decode("utf-8", "replace").encode()


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder a worker for each vocabulary file; the file must lie on every machine."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian 32-bit integers; a null text is empty."""
    path = path or default_vocabulary()

    def run(batch):
        c = coder(path)
        ids = [c.encode(t or "") for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "n_tokens": [len(i) // 4 for i in ids], "ids": ids, "decoded": [c.decode(i).decode() for i in ids]}

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the same encoding, without the bytes themselves."""
    path = path or default_vocabulary()

    def run(batch):
        c = coder(path)
        ids = [c.encode(t or "") for t in batch.column("text").to_pylist()]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return {"doc_id": batch.column("doc_id"), "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [sha(i) for i in ids], "decoded_sha256": [sha(c.decode(i)) for i in ids]}

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def add_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs``, all rows and columns, with n_tokens and ids (little-endian 32-bit integers); a null text is empty.

    Every encoding is decoded again and held against its text.  Columns of these names are replaced.
    """
    path = path or default_vocabulary()
    kept = [c for c in docs.columns if c not in ("n_tokens", "ids")]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        c = coder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [c.encode(t) for t in texts]
                for t, i in zip(texts, ids):
                    if c.decode(i) != t.encode():
                        raise ValueError("a text is not what its tokens decode to")
                new = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *new], schema=arrow)

    return map_arrow(docs, run, schema)
