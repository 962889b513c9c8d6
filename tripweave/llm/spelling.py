"""Spelling variants among the words of a corpus: asymmetric q-chunks.

Of two words that differ by one edit the shorter one (of two as long, the first) is cut into two disjoint chunks.  The edit
hits one of them; the other stands in the longer word as a gram at its own place or, behind an insertion, one further on.
So the one word files its two chunks, the other its grams with their positions, at the places that a chunk within shift one
can meet, and words that meet are verified.

Where a chunk is so common that very many pairs would meet, the part that the edit hits is halved, and what is left of
the chunk word, now three quarters or more of it, is the key.  In the end all but one position is, and no group is large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.session import cut_lineage

#: Words have this many code points and occurrences at least; a form is so many times as frequent as its variant.
LEAST, TWICE, TIMES = 7, 2, 10
#: Pairs that may meet in one group before its chunks are made longer.
LIMIT = 1 << 16

# Letters of a run, and the case that is folded.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 31

_KEY = ["length", "s", "e", "gram"]


def corpus_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, some with a letter dropped, that are long and frequent enough.

    Whether and where a run loses a letter hangs on the CRC-32 of ``<doc_id>:<run>``; a null id counts as empty.  Null
    and empty texts have no words; equal rows count each.  Words are counted where they are read before they are shuffled.
    """
    # runs that are too short stay so, whatever they lose
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{LEAST},}})"))).alias("run"),
    ).withColumn("run", F.translate("run", UPPER, LOWER))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) AS int)), substring(run, cast(h % length(run) AS int) + 2))")
    words = hashed.select(F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TWICE)


def _gram(word: Column, s: Column, e: Column, shift: Column) -> Column:
    """What a word has outside the part from ``s`` to ``e`` of a chunk word, behind it ``shift`` further on."""
    return F.concat(F.substring(word, F.lit(1), s), F.substring(word, e + shift + 1, F.length(word)))


def _file(rows: DataFrame, parts: Column) -> DataFrame:
    """``rows`` (word, n, chunk, length) once for each part (s, e) of a chunk word of ``length``, with the gram."""
    shift = F.length("word") - F.col("length")
    return rows.select("word", "n", "chunk", "length", F.inline(parts)).withColumn("gram", _gram(F.col("word"), F.col("s"), F.col("e"), shift))


def _halves(s: Column, e: Column) -> Column:
    middle = F.floor((s + e) / 2).cast("int")
    return F.array(F.struct(s.alias("s"), middle.alias("e")), F.struct(middle.alias("s"), e.alias("e")))


def _meet(rows: DataFrame) -> DataFrame:
    """(word, n, other, m): near pairs, each once, of ``rows`` with equal keys.

    A pair comes from the key whose missing part holds the first place where the two words differ.
    """
    a = rows.where("chunk").select(*_KEY, "word", "n")
    b = rows.where("NOT chunk").select(*_KEY, F.col("word").alias("other"), F.col("n").alias("m"))
    longer = F.length("other") > F.col("length")
    first = (F.col("e") == F.col("length")) | (F.substring("word", F.lit(1), F.col("e")) != F.substring("other", F.lit(1), F.col("e")))
    near = F.levenshtein("word", "other", 1) == 1
    return a.join(b, _KEY).where((longer | (F.col("word") < F.col("other"))) & first & near).select("word", "n", "other", "m")


def near_pairs(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n, other, m): pairs of ``words`` (word, n) that differ by one inserted, deleted or replaced code point."""
    length = F.length("word")
    kinds = F.array(*[  # chunk word, or gram word for chunk words as long or one shorter
        F.struct(F.lit(c).alias("chunk"), (length - less).alias("length")) for c, less in ((True, 0), (False, 0), (False, 1))
    ])
    rows = words.select("word", "n", F.inline(kinds)).where("length > 0")
    level = cut_lineage(_file(rows, _halves(F.lit(0), F.col("length"))))
    found = []
    while True:
        met = level.groupBy(*_KEY).agg(F.sum(F.col("chunk").cast("long")).alias("a"), F.sum((~F.col("chunk")).cast("long")).alias("b"))
        large = cut_lineage(met.where((F.col("a") * F.col("b") > limit) & (F.col("e") - F.col("s") > 1)).select(*_KEY))
        if large.isEmpty():
            found.append(_meet(level))
            return reduce(DataFrame.unionByName, found)
        found.append(_meet(level.join(large, _KEY, "left_anti")))
        hot = level.join(large, _KEY, "left_semi")
        level = cut_lineage(_file(hot.drop("gram").withColumnsRenamed({"s": "_s", "e": "_e"}), _halves(F.col("_s"), F.col("_e"))))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form that is reached.  A form is ten times as frequent, so chains are short;
    each round follows chains twice as far."""
    links = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut_lineage(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return links
        links = step.drop("moved")


def group(words: DataFrame, times: int = TIMES, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n), ``word`` being unique.

    ``n_near`` counts the words at one edit.  ``form`` is the most frequent of these (of equal ones the first in code-point
    order), if it is at least ``times`` as frequent; ``root`` is reached from the word over forms.  A word without a form is
    its own root.  No words, no rows.  Building it runs jobs.
    """
    words = cut_lineage(words.select("word", "n"))
    pairs = near_pairs(words, limit)
    ways = F.array(
        F.struct("word", F.col("other"), F.col("m")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("m")),
    )
    best = F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("form")))
    near = pairs.select(F.inline(ways)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    frequent = -F.col("best.less") >= F.col("n") * times
    out = cut_lineage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(frequent, F.col("best.form")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
