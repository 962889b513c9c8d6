"""Fingerprints of paths: any run of a path gets its 16-byte name in constant time.

A fingerprint is four polynomial hashes modulo the prime 2^31 - 1, two packed into each of two longs.  Those of
all prefixes are scanned once inside the row; a run's is that of the prefix up to its end, less the prefix before it
times the base to the power of the run's length.  Equal runs have equal names wherever they lie, different ones
differ but for a chance of about their length / 2^31 in each of the four.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
#: Two bases for each long.
BASES = ((1_618_033_988, 1_414_213_562), (1_732_050_807, 577_215_664))


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _low(v: Column) -> Column:
    return v.bitwiseAND(_long(PRIME))


def _pack(a: Column, b: Column) -> Column:
    return a * _long(1 << 31) + b


def _times(v: Column, by: tuple[Column, Column], plus: tuple[Column, Column] | None = None) -> Column:
    """Both halves of ``v`` times ``by``, plus ``plus``; no product reaches 2^62."""
    a, b = F.shiftright(v, 31) * by[0], _low(v) * by[1]
    if plus is not None:
        a, b = a + plus[0], b + plus[1]
    return _pack(a % _long(PRIME), b % _long(PRIME))


def _append(word: int, v: Column, x: Column) -> Column:
    h = F.xxhash64(x, F.lit(word))
    return _times(v, tuple(map(_long, BASES[word])), (_low(h), _low(F.shiftrightunsigned(h, 31))))


def _word_of(path: Column, word: int) -> Column:
    return F.aggregate(path, _long(0), lambda v, x: _append(word, v, x))


def _prefix_words(path: Column, word: int) -> Column:
    return F.aggregate(path, F.array(_long(0)), lambda seen, x: F.concat(seen, F.array(_append(word, F.element_at(seen, -1), x))))


def _power(length: Column, word: int) -> Column:
    by = tuple(map(_long, BASES[word]))
    return F.aggregate(F.array_repeat(F.lit(0), length), _pack(_long(1), _long(1)), lambda v, _: _times(v, by))


def names(*paths: Column) -> list[Column]:
    """Two longs that tell whole paths apart, also where they hold NULL; cheaper than :func:`whole`, but not of use for runs."""
    parts = [x for p in paths for x in (p, F.transform(p, lambda v: v.isNull()), F.size(p))]
    return [F.xxhash64(F.lit(word), *parts) for word in range(2)]


def whole(path: Column) -> list[Column]:
    """The two longs that name the whole path."""
    return [_word_of(path, word) for word in range(len(BASES))]


def prefixes(path: Column) -> list[Column]:
    """Two lists of longs: at k the name of the first k elements."""
    return [_prefix_words(path, word) for word in range(len(BASES))]


def powers(length: Column) -> list[Column]:
    """What :func:`run` needs for runs of this length."""
    return [_power(length, word) for word in range(len(BASES))]


def run(before: Column, end: Column, power: Column) -> Column:
    """One long of the name of a run: from those of the prefixes up to its start and up to its end, and its length's :func:`powers`."""
    shifted = _times(before, (F.shiftright(power, 31), _low(power)))
    a = F.shiftright(end, 31) - F.shiftright(shifted, 31)
    return _pack(F.pmod(a, _long(PRIME)), F.pmod(_low(end) - _low(shifted), _long(PRIME)))
