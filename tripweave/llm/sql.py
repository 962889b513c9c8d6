"""SQL of the queries that SQL can express."""

from __future__ import annotations

# The table of CRC-32 by its rule: eight halvings of each byte.  Fixed values: the polynomial and the first and last XOR.
_CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS tab
  FROM (SELECT b, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
        FROM range(0, 256) AS t(b))
)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text, byte by byte of its hexadecimal form; needs ``crc_table``."""
    pairs = f"string_split(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g'), ' ')[:strlen({text})]"
    step = "lambda c, b: xor(crc_table.tab[xor(c, b) % 256 + 1], c >> 8)"
    return f"xor(list_reduce(list_transform({pairs}, lambda p: CAST('0x' || p AS BIGINT)), {step}, 4294967295), 4294967295)"


SHARDS = f"""
WITH {_CRC_TABLE},
sized AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size,
                 CAST({_crc32("coalesce(text, '')")} AS BIGINT) AS text_crc32
          FROM documents, crc_table),
summed AS (SELECT *, sum(size) OVER () AS total,
                  sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
                  row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS n
           FROM sized),
placed AS (SELECT *, CAST(least(((2 * before + size) * 40) // (2 * total), 39) AS INTEGER) AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""

# A pair at one edit: the longer word without a letter is the shorter one, or both without the letter at one place are equal.
SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
         FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, c, {_crc32("concat(doc_id, ':', run)")} AS h FROM counted, crc_table),
slipped AS (SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
            FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
                      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b USING (i, rest) WHERE a.word <> b.word AND length(a.word) = length(b.word)
          UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
          UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest),
near AS (SELECT word, count(*) AS n_near, max(m) AS top FROM pairs GROUP BY word),
best AS (SELECT p.word, min(other) AS form, m AS form_n FROM pairs p JOIN near USING (word) JOIN words USING (word)
         WHERE m = top AND m >= 10 * n GROUP BY p.word, m),
chain AS (SELECT word, word AS root FROM words
          UNION ALL SELECT chain.word, best.form FROM chain JOIN best ON best.word = chain.root),
roots AS (SELECT word, root FROM chain ANTI JOIN best ON best.word = chain.root)
SELECT word, form, root, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form_n
FROM words LEFT JOIN near USING (word) LEFT JOIN best USING (word) JOIN roots USING (word)
"""
