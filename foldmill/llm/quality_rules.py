"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one integer of failure
bits; policies are versioned sets of bits applied afterwards without reading a text again, and ablations
(what a policy would keep without each of its rules) come from a bitwise aggregation of the ledger, whose
groups are the at most 2**len(RULES) combinations of bits.

Cases: a null text has no words and counts as empty; an empty text fails ``few_words``; repeated rows and
ties do not interact; an empty table gives an empty ledger; texts are read whole; other columns pass
through, and the ledger's columns replace columns of the same name.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Windows of a text from which numbers take the place of words.
MANY = 20_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_stutter")

#: Rule name -> failed, given the measurements (arrays of integers, by name).
RULES = {
    "few_words": lambda m: m["n_words"] < 20,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "symbols": lambda m: 100 * m["n_symbols"] > 15 * m["n_words"],
    "duplicate_lines": lambda m: (m["n_dup_lines"] >= 2) & (100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    "upper_case": lambda m: 100 * m["n_upper"] > 50 * m["n_letters"],
    "short_words": lambda m: 10 * m["word_chars"] < 20 * m["n_words"],
    "long_words": lambda m: 10 * m["word_chars"] > 150 * m["n_words"],
    "stutter": lambda m: 100 * m["n_stutter"] > 30 * m["n_words"],
}
#: Policy version -> rules that reject a document.  Versions are never changed, only added.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "upper_case", "short_words", "long_words", "stutter"),
}


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def repeated(words: list[bytes]) -> int:
    """Words in windows that are found twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if n > MANY:
        return repeated_in_many(words)
    windows = list(zip(*[words[k:] for k in range(WINDOW)]))
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)} if len(set(windows)) < n else ()
    if not twice:
        return 0
    total, end = 0, 0
    for k, w in enumerate(windows):
        if w in twice:
            total += k + WINDOW - max(k, end)
            end = k + WINDOW
    return total


def repeated_in_many(words: list[bytes]) -> int:
    """The same for very long texts, with some 50 bytes a word: words become numbers, windows rows of numbers."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
    n = len(ids) - WINDOW + 1
    # A hash that slides over the numbers proposes equal windows; rows of numbers decide.
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        hashes = hashes * np.uint64(0xC2B2AE3D27D4EB4F) + (mixed[k : k + n] ^ mixed[k : k + n] >> np.uint64(29))
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    chosen = np.sort(order[np.r_[same, False] | np.r_[False, same]])
    del order, same, hashes, mixed
    rows = np.stack([ids[chosen + k] for k in range(WINDOW)], 1)
    _, which, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    starts = chosen[times[which.ravel()] > 1]
    covered = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        covered[starts + k] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()  # ASCII white space
    codes = np.frombuffer(raw, np.uint8)
    inner = np.bincount(codes, minlength=256)
    continuation = int(inner[128:192].sum())
    space = int(inner[32] + inner[9:14].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    upper, lower = int(inner[65:91].sum()), int(inner[97:123].sum())
    return (
        len(words),
        len(raw) - continuation - space,
        int(sum(inner[ord(c)] for c in SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
        upper + lower,
        upper,
        sum(map(eq, words, words[1:])),
    )


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed_bits``, bit k for the k-th rule."""

    def per_batch(texts):
        rows = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES))
        env = dict(zip(MEASURES, rows.T))
        bits = np.zeros(len(rows), np.int64)
        for k, rule in enumerate(RULES.values()):
            bits |= rule(env).astype(np.int64) << k
        return [pa.array(c, pa.int64()) for c in (*rows.T, bits)]

    return append_columns(docs, text_col, [(n, T.LongType()) for n in (*MEASURES, "failed_bits")], per_batch)


def rejected(policy: str, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) != 0


def apply_policy(ledger_df: DataFrame, policy: str, out: str = "kept") -> DataFrame:
    return ledger_df.withColumns({out: ~rejected(policy)})


def ablations(ledger_df: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents it fails, fails alone, and what the policy keeps without it."""
    names = list(RULES)
    chosen = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    groups = ledger_df.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = groups.select("bits", "n", F.explode(chosen).alias("r")).select("bits", "n", "r.*")
    hit, rest = F.col("bits").bitwiseAND(F.col("bit")), F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit != 0, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when((hit != 0) & (rest == 0), F.col("n"))), F.lit(0)).alias("failed_alone"),
        F.coalesce(F.sum(F.when(rest == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
    )


#: The ledger and policy ``v1`` in SQL.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), v AS (
  SELECT rid, unnest(range(1, len(ws) - 6)) AS p, ws FROM w WHERE len(ws) >= 8
), k AS (SELECT rid, p, list_slice(ws, p, p + 7) AS g FROM v),
c AS (SELECT rid, g FROM k GROUP BY rid, g HAVING count(*) >= 2),
r AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT k.rid, unnest(range(p, p + 8)) AS q FROM k JOIN c USING (rid, g)) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_stutter
  FROM w LEFT JOIN r ON w.rid = r.rid
), f AS (
  SELECT *, n_words < 20 AS f0, 100 * n_repeat_words > 30 * n_words AS f1, 100 * n_symbols > 15 * n_words AS f2,
         n_dup_lines >= 2 AND 100 * n_dup_lines > 30 * n_lines AS f3, 100 * n_upper > 50 * n_letters AS f4,
         10 * word_chars < 20 * n_words AS f5, 10 * word_chars > 150 * n_words AS f6, 100 * n_stutter > 30 * n_words AS f7
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (f0 OR f1) AS base_failed,
       NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5 OR f6 OR f7) AS kept,
       CAST(f0 AS BIGINT) + 2 * CAST(f1 AS BIGINT) + 4 * CAST(f2 AS BIGINT) + 8 * CAST(f3 AS BIGINT) + 16 * CAST(f4 AS BIGINT)
       + 32 * CAST(f5 AS BIGINT) + 64 * CAST(f6 AS BIGINT) + 128 * CAST(f7 AS BIGINT) AS failed_bits
FROM f
"""
