"""Benchmark decontamination by spaced-seed hashing.

A mask is a short window of token positions of which it ignores some.  Every benchmark item and every
document is hashed under each mask at each position; equal hashes are hits, so a substituted word under an
ignored position does not hide an overlap.  Around each hit the two texts are compared word by word on the
hit's diagonal, and a window of ``WINDOW`` words (or of the whole item or document, if shorter) with at most
the tolerated substitutions is an overlap.  The two masks together hit every window within the tolerance: 2
of 13 words, 1 of 10 to 12, none of 8 or 9 (``tests/llm`` prove it by enumeration).  An item of fewer words
than a mask spans is hashed whole, and is found wherever a document holds all its words in a row.

All of it is DataFrame operations.  Documents are read and probed where they lie.  The benchmark's seeds
are broadcast only if their counted size is at most ``BROADCAST_BYTES``; beyond that, seeds are joined by a
shuffle that carries no text, hits of one diagonal become one, and the verification joins the words back.

Cases: words are the runs of letters and digits of the lower-cased text; null or blank texts have none; a
document of fewer than 8 words can only hold items shorter than that; repeated rows and items with equal
ids give one row for each pair of ids, with the best overlap; a null id is an id like any other; empty tables
give an empty result; texts are used whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chosen_rows, placed_rows, without

#: Fixed positions that each mask compares; the others up to the span are ignored.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
WINDOW = 13
#: Estimated size of the benchmark's seeds and words up to which they are broadcast.
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hashed(text: Column) -> Column:
    """The words of a text as 64-bit hashes; an empty array for null."""
    return F.coalesce(F.transform(words_of(text), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def at_seeds(df: DataFrame, words: str, short: list[int], whole: bool = False) -> DataFrame:
    """``df`` once for each position and seed, with ``p`` and ``seed``; rows without a seed drop out.

    ``short`` are lengths of items below ``SPAN``: their seeds hash so many words in a row; with ``whole``
    (for items) a row has the seed of its own length alone.
    """
    n = F.size(words)
    # Not a filter: that would be pushed below the words' hashing and hash them twice.
    last = n - (min(short) if short else SPAN)
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    placed = df.withColumn("p", F.explode(places))

    def of(k: int, at: tuple[int, ...], fits: Column) -> Column:
        return F.when(fits, F.xxhash64(F.lit(k), *[F.get(F.col(words), F.col("p") + c) for c in at]))

    seeds = [of(k, mask, F.col("p") + SPAN <= n) for k, mask in enumerate(MASKS)]
    seeds += [of(100 + m, tuple(range(m)), n == m if whole else F.col("p") + m <= n) for m in short]
    placed = placed.withColumn("seed", F.explode(F.array(*seeds)))
    return placed.where("seed is not null") if short else placed


def tolerance(k: str) -> str:
    """Substitutions allowed in a window of k words."""
    return f"(case when {k} >= 13 then 2 when {k} >= 10 then 1 else 0 end)"


def verified(hits: DataFrame, near: bool = True) -> DataFrame:
    """Keep the hits (a, p: document; b, q: item) within an overlap; adds ``k`` (words compared), ``matched``
    and ``start``.  Windows over the hit are compared, or with ``near`` false, all on its diagonal."""
    out = hits.withColumn("k", F.least(F.lit(WINDOW), F.size("b"), F.size("a")))
    # Item positions that these windows may cover, inside both texts.
    low, high = (f"q + least({SPAN}, size(b)) - k, ", "q + k, ") if near else ("", "")
    out = out.withColumns({"lo": F.expr(f"greatest(0, {low}q - p)"), "hi": F.expr(f"least(size(b), {high}size(a) - p + q)")}).where("hi - lo >= k")
    same = "zip_with(slice(a, p - q + lo + 1, hi - lo), slice(b, lo + 1, hi - lo), (x, y) -> if(x = y, 1, 0))"
    out = out.withColumn("same", F.expr(same))
    sums = "transform(sequence(0, hi - lo - k), s -> struct(aggregate(slice(same, s + 1, k), 0, (t, x) -> t + x) as matched, -s as back))"
    out = out.withColumn("best", F.expr(f"array_max({sums})"))
    out = out.where(F.expr(f"best.matched >= k - {tolerance('k')}"))
    return out.withColumns({"matched": F.col("best.matched"), "start": F.expr("p - q + lo - best.back")})


def hits_of(rows: DataFrame, by: list[str], benchmark: DataFrame, item_col: str, item_text: str, broadcast_bytes: int) -> DataFrame:
    """Verified hits (``by``, item_id, k, matched, start) of ``rows`` (``by``, a), where ``by`` names a row of the
    documents; rows that agree in it have equal words."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), hashed(F.col(f"`{item_text}`")).alias("b"))
    items = items.where(F.size("b") > 0).distinct()
    # Equal ids may have several texts: an item is known by its id and words.
    items = items.withColumn("item", F.xxhash64("item_id", "b"))
    sizes = F.collect_set(F.when(F.size("b") < SPAN, F.size("b")))  # at most SPAN - 1 numbers
    total, short = items.agg(F.coalesce(F.sum(F.size("b")), F.lit(0)), sizes).first()
    seeds = at_seeds(items, "b", sorted(short), whole=True).select("item", F.col("p").alias("q"), "seed")
    if total * (8 + len(MASKS) * 40) <= broadcast_bytes:
        hits = at_seeds(rows, "a", sorted(short)).join(F.broadcast(seeds), "seed").join(F.broadcast(items), "item")
        return verified(hits.select(*by, "a", "p", "item_id", "b", "q"))
    # A seed that many documents and items share is split by adaptive joins: both sides come from a shuffle.
    hits = at_seeds(rows, "a", sorted(short)).select(*by, "p", "seed").join(seeds, "seed").select(*by, "item", (F.col("p") - F.col("q")).alias("p"))
    hits = hits.distinct().join(items, "item").withColumn("q", F.lit(0))
    own = rows.dropDuplicates(by).select(*[F.col(c).alias(f"own_{c}") for c in by], "a")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in by])
    return verified(hits.join(own, same).select(*by, "a", "p", "item_id", "b", "q"), near=False)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row for each document and item that overlap: ``doc_id``, ``text_hash``, ``item_id``, ``window``
    (words compared), ``matched`` (most equal words in a window) and ``first_word`` (first such window's
    least position among the document's words)."""
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), hashed(F.col("text")).alias("a"))
    found = hits_of(rows, ["doc_id", "text_hash"], benchmark, item_col, item_text, broadcast_bytes)
    best = found.groupBy("doc_id", "text_hash", "item_id", F.col("k").alias("window")).agg(
        F.max("matched").alias("matched"), F.min("start").alias("first_word")
    )
    return best.select("doc_id", "text_hash", "item_id", F.col("window").cast("long").alias("window"), F.col("matched").cast("long").alias("matched"), F.col("first_word").cast("long").alias("first_word"))


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``docs`` without the documents that overlap an item of ``benchmark``.

    Rows are known by their place in the files, so no text is shuffled.
    """
    placed, file, row = placed_rows(docs, "documents")
    rows = placed.select(file, row, hashed(F.col(f"`{text_col}`")).alias("a"))
    bad = hits_of(rows, [file, row], benchmark, item_col, item_text, broadcast_bytes).select(file, row).distinct()
    return without(chosen_rows(placed, bad, file, row, keep=False), [file, row])


#: The same pairs found without seeds: all diagonals on which enough words agree, all windows on them.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT row_number() OVER () AS iid, item_id, w FROM (
    SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
  )
), it AS (SELECT iid, item_id, len(w) AS nb, unnest(w) AS t, unnest(range(len(w))) AS q FROM i),
dt AS (SELECT rid, doc_id, len(w) AS na, unnest(w) AS t, unnest(range(len(w))) AS p FROM d),
m AS (
  SELECT rid, doc_id, na, iid, item_id, nb, least(13, na, nb) AS k, p - q AS diag, q FROM dt JOIN it USING (t)
  WHERE nb <= na AND nb < 8 OR na >= 8 AND nb >= 8
), g AS (
  SELECT rid, doc_id, na, iid, item_id, nb, k, k - CASE WHEN k >= 13 THEN 2 WHEN k >= 10 THEN 1 ELSE 0 END AS least_equal, diag, list(q) AS qs FROM m
  GROUP BY rid, doc_id, na, iid, item_id, nb, k, diag HAVING count(*) >= least_equal
), s AS (
  SELECT *, unnest(range(greatest(0, -diag), least(nb, na - diag) - k + 1)) AS s FROM g
), o AS (SELECT rid, doc_id, item_id, k, least_equal, diag + s AS start, len(list_filter(qs, lambda x: x >= s AND x < s + k)) AS matched FROM s)
SELECT doc_id, item_id, CAST(k AS BIGINT) AS "window", CAST(max(matched) AS BIGINT) AS matched
FROM o WHERE matched >= least_equal GROUP BY doc_id, item_id, k
"""
