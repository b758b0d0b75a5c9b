"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all values (variants) within half the radius, variants are shuffled by value,
and fingerprints that meet at a variant are deduplicated, verified by their Hamming distance and linked.  Two
fingerprints of distance 2h or less have a value within h bits of both.  All that meet at one variant are then
linked with each other, so a star to one of them keeps the same components without emitting pairs.  If the
radius is odd, 2h + 1, balls have h + 1 bits, and the star's centre must be within h bits of the variant: a
pair at the full distance meets so at some value, and whatever meets the centre there is within the radius.

The shuffle carries no variant as a row of its own.  Variants fall into 2**k buckets by a hash that is
linear over XOR: bit j of it is the parity of the fingerprint's bits i with i % k = j.  A bucket can therefore
list the variants it owns of a fingerprint from the fingerprint alone, and a change of h bits changes at most
h bits of the hash: a fingerprint is sent (8 bytes) to 1 + k + k (k - 1) / 2 buckets for h = 2, not to one for
each of its 2,081 variants.  The number of buckets follows the number of distinct fingerprints, so a bucket's
variants always fit in a task.  Copies share a fingerprint and are grouped before anything is emitted.

Fingerprints within few bits find copies that are almost the same.  ``deduplicated`` can also link all texts
of some Jaccard similarity of their five-word shingles, which no ball of bits can (the README has figures).
Min-hash bands bring sets together; in each band all are compared, by the sets themselves, with one centre: the
one that shares bands with most others, as an original does among its copies.  What is still in different
classes is compared with the next centre, until a round links nothing.  So the number of comparisons grows with
the number of sets, not with the square of a group.

Bands and centres may miss a link, so an exact join by prefixes follows (``rest``).  With all shingles in one
order, two sets of some similarity have a shingle in common among the first ones of both.  These are shuffled, and
sets of different classes that meet at one are compared, if their sizes, the shingle's places and a bound by bit
sketches allow the similarity.  The most frequent shingles of a sample come last, which changes speed and no result.

Cases: a null, empty or blank text has fingerprint zero and is linked like any other; a text of fewer
words than a shingle has one shingle of all its words; repeated rows each stay, with the same class; a
null doc_id is kept, and is a class's id only if no document of it has one; an empty table gives an
empty result; texts are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, chosen_rows, materialize, placed_rows, release, slices, trim, without

#: Variants that a bucket owns on average at most, and how many of them a task holds at once.
BUCKET_VARIANTS, AT_ONCE = 1 << 23, 1 << 18
#: Fingerprints that are sent at once at most, and (bucket, fingerprint) pairs.
CHUNK, PAIRS = 1 << 15, 1 << 18
LANES = np.uint64(0x0101010101010101)
ASCII_SPACE = b" \t\n\r\x0b\x0c"


def shingle_hashes(text: str | None, width: int, seed: int) -> list[int]:
    """XXH64 of each shingle of the words, which are runs of anything but ASCII white space."""
    words = text.encode().lower().split() if text else ()  # bytes.lower() changes A-Z alone
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, seed)]
    digest, starts, at = xxhash.xxh64_intdigest, [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    return [digest(line[a : b - 1], seed) for a, b in zip(starts, starts[width:])]


#: Shingle hashes that are summed at once.
SUM_AT_ONCE = 1 << 19


def add_bits(hashes: list[int], counts: np.ndarray, bits: np.ndarray) -> None:
    """Add to ``bits`` (texts x 64) how many hashes have each bit; ``counts`` hashes belong to each text."""
    full = np.flatnonzero(counts)
    if not len(full):
        return
    h = np.array(hashes, np.uint64)
    # Sums of up to 255 hashes stay in eight byte lanes; then the lanes of a text's blocks are added.
    blocks = -(-counts[full] // 255)
    first = np.repeat(np.cumsum(counts[full]) - counts[full], blocks)
    inner = np.arange(len(first)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    edges, owner = first + 255 * inner, np.cumsum(blocks) - blocks
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, edges)
        bits[full, k::8] += np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)


def fingerprint_batch(texts: list[str | None], width: int = 4, seed: int = 42) -> np.ndarray:
    """Fingerprints: a bit is 1 if it is set in over half of the text's shingle hashes."""
    bits, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = shingle_hashes(text, width, seed)
        total[k] = counts[k] = len(found)
        hashes += found
        if len(hashes) > SUM_AT_ONCE or k == len(texts) - 1:
            add_bits(hashes, counts, bits)
            hashes, counts = [], np.zeros(len(texts), np.int64)
    over = 2 * bits > total[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


# -------------------------------------------------------------------------------------- similar shingle sets

#: Words of a shingle in sets; bands, and min-hashes in each: a pair of similarity 0.8 shares no band with a
#: probability of (1 - 0.8 ** 5) ** 24, about seven in 100,000.
SET_WIDTH, BANDS, ROWS = 5, 24, 5


def shingle_set(text: str | None, seed: int = 42) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, SET_WIDTH, seed), np.uint64))


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(5)
    return draw.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One key for each band of each set (sets x BANDS); no set is empty."""
    edges = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x = np.concatenate(sets)
    x = (x ^ x >> np.uint64(32)).astype(np.uint32)
    low = np.empty((len(sets), BANDS * ROWS), np.uint32)
    for k, (times, flip) in enumerate(zip(*permutations())):
        y = (x ^ flip) * times
        y ^= y >> np.uint32(15)
        low[:, k] = np.minimum.reduceat(y * np.uint32(0x2C1B3C6D), edges)
    rows = np.ascontiguousarray(low.reshape(len(sets), BANDS, ROWS))
    keys = [[xxhash.xxh64_intdigest(rows[i, j].tobytes(), j) for j in range(BANDS)] for i in range(len(sets))]
    return np.array(keys, np.uint64)


def set_name(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes())).astype(np.int64))


def with_sets(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with ``fp``, ``set_id`` (a hash of the shingle set of ``text``; null if it is empty),
    ``set_size`` and ``band_keys``; all in one pass, as each pass has Python workers of its own."""

    def per_batch(texts):
        sets = [shingle_set(t, seed) for t in texts]
        full = [k for k, s in enumerate(sets) if len(s)]
        ids, keys = [None] * len(sets), [None] * len(sets)
        if full:
            for k, row in zip(full, band_keys([sets[k] for k in full]).view(np.int64)):
                ids[k], keys[k] = set_name(sets[k]), row
        fps = pa.array(fingerprint_batch(texts, width, seed).view(np.int64), pa.int64())
        return [fps, pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]

    added = [("fp", T.LongType()), ("set_id", T.LongType()), ("set_size", T.LongType()), ("band_keys", T.ArrayType(T.LongType()))]
    return append_columns(docs, "text", added, per_batch)


#: Prefix entries that a bucket of ``rest`` has on average at most, that are sent at once, and pairs looked at at once.
BUCKET_ENTRIES, SENT_AT_ONCE, PAIRS_AT_ONCE = 1 << 17, 1 << 15, 1 << 17
#: One set of so many has its shingles counted, and the frequent shingles that come last in prefixes at most.
SAMPLE, FREQUENT = 16, 1 << 18
ENTRY = np.dtype([("set_id", "<i8"), ("root", "<i8"), ("n", "<i4"), ("place", "<i4"), ("gram", "<i8")])


def ratio(similar: float) -> tuple[int, int]:
    """The similarity as a fraction, exact as it is written."""
    return Fraction(str(similar)).as_integer_ratio()


def prefix(grams: np.ndarray, frequent: np.ndarray, order: np.ndarray, p: int, q: int) -> np.ndarray:
    """The first shingles of a set, by hash, those of ``frequent`` (sorted) last and by ``order``.

    A set of similarity p / q or more has p / q of these shingles at least, so one of all but that many, and one.
    """
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        often = frequent[at] == grams
        grams = np.r_[grams[~often], grams[often][np.argsort(order[at[often]])]]
    return grams[: len(grams) - -(-p * len(grams) // q) + 1]


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the shingles by their lowest bits, one bit each, two or more for each shingle: sets that differ
    in d shingles have sketches that differ in d bits at most."""
    width = max(64, 1 << (2 * len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def may_be_alike(x: np.ndarray, y: np.ndarray, total: int, p: int, q: int) -> bool:
    """Whether sketches allow the similarity of two sets of ``total`` shingles; the wider one is folded."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return (p + q) * int(np.bitwise_count(x ^ y).sum()) <= (q - p) * total


def met_pairs(entries: np.ndarray, p: int, q: int) -> Iterator[np.ndarray]:
    """Indices (i, j) into ``entries`` of sets in different classes that a shingle's places let be similar."""
    rank = np.lexsort((entries["n"], entries["root"], entries["gram"]))
    gram, root = entries["gram"][rank], entries["root"][rank]
    if not len(rank):
        return
    # The largest class of each shingle: its members are compared with the others only.
    new = np.r_[True, gram[1:] != gram[:-1]]
    runs = np.flatnonzero(new | np.r_[True, root[1:] != root[:-1]])
    lengths = np.diff(np.r_[runs, len(rank)])
    group = np.cumsum(new) - 1
    best = np.lexsort((lengths, group[runs]))
    best = best[np.flatnonzero(np.r_[np.diff(group[runs][best]) != 0, True])]
    main = root[runs[best]]
    mixed = lengths[best] < np.bincount(group)
    stay = mixed[group]
    rank, group = rank[stay], group[stay]
    rank = rank[np.lexsort((entries["n"][rank], group))]
    e = entries[rank]
    minor = e["root"] != main[group]
    n = e["n"].astype(np.int64)
    # Partners of an entry: a stretch of its shingle's entries, which are in order of size.
    key = group << 32 | n
    first = np.searchsorted(key, group << 32 | -(-p * n // q))
    last = np.searchsorted(key, group << 32 | np.minimum(q * n // p, (1 << 32) - 1), "right")
    count = np.where(minor, last - first, 0)
    ends = np.cumsum(count)
    at = 0
    while at < len(e):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + PAIRS_AT_ONCE, "right")))
        total = count[at:stop]
        if total.any():
            i = np.repeat(np.arange(at, stop), total)
            j = np.arange(len(i)) - np.repeat(ends[at:stop] - total - before, total) + first[i]
            both = -(-p * (n[i] + n[j]) // (p + q))
            fit = (e["root"][i] != e["root"][j]) & (~minor[j] | (i < j))
            fit &= (e["place"][i] <= n[i] - both) & (e["place"][j] <= n[j] - both)
            yield np.stack([rank[i[fit]], rank[j[fit]]])
        at = stop


def rest(only: DataFrame, sets: DataFrame, linked: DataFrame, similar: float, seed: int) -> DataFrame:
    """All pairs (set_a, set_b, u, v) of ``sets`` in the different classes u and v of ``linked`` that may have the
    similarity, and few others; the arguments are those of ``similar_classes``."""
    p, q = ratio(similar)
    total = sets.agg(F.sum(F.expr(f"set_size - ceil({p} * set_size / {q}) + 1"))).first()[0]
    buckets = -(-int(total or 0) // BUCKET_ENTRIES) or 1
    places = sets.select("file", "row")
    texts = only.select("file", "row", "text")

    def grams_of(texts):
        return [pa.array([shingle_set(t, seed).view(np.int64) for t in texts], pa.list_(pa.int64()))]

    few = places.where(F.pmod(F.xxhash64("file", "row"), F.lit(SAMPLE)) == 0)
    grams = append_columns(chosen_rows(texts, few, "file", "row"), "text", [("grams", T.ArrayType(T.LongType()))], grams_of)
    often = grams.select(F.explode("grams").alias("gram")).groupBy("gram").count().where("count > 2").orderBy(F.desc("count"), "gram").limit(FREQUENT)
    often = np.array([r["gram"] for r in often.collect()], np.int64).view(np.uint64)
    by_hash = np.argsort(often)
    frequent, order = often[by_hash], -by_hash.astype(np.int32)

    def prefixes_of(texts):
        found = [shingle_set(t, seed) for t in texts]
        firsts = pa.array([prefix(x, frequent, order, p, q).tobytes() for x in found], pa.binary())
        return [pa.array([set_name(x) for x in found], pa.int64()), firsts, pa.array([sketch(x).tobytes() for x in found], pa.binary())]

    added = [("set_id", T.LongType()), ("grams", T.BinaryType()), ("sketch", T.BinaryType())]
    prefixes = materialize(append_columns(chosen_rows(texts, places, "file", "row"), "text", added, prefixes_of).drop("text", "file", "row"), "prefixes")
    rooted = sets.select("set_id", "set_size", "fp").join(linked.withColumnRenamed("u", "fp"), "fp", "left")
    rooted = prefixes.select("set_id", "grams").join(rooted, "set_id").select("set_id", F.coalesce("root", "fp").alias("root"), "set_size", "grams")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3)):
            ids, roots, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            grams = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            lengths = np.array([len(x) for x in grams])
            ends = np.cumsum(lengths)
            at = 0
            while at < len(grams):
                before = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + SENT_AT_ONCE, "right")))
                part = slice(at, stop)
                entries = np.empty(ends[stop - 1] - before, ENTRY)
                entries["gram"] = np.concatenate(grams[part])
                entries["place"] = np.arange(len(entries)) - np.repeat(ends[part] - lengths[part] - before, lengths[part])
                for name, values in (("set_id", ids), ("root", roots), ("n", sizes)):
                    entries[name] = np.repeat(values[part], lengths[part])
                bucket = (entries["gram"] & 0xFFFFFFFF) % buckets
                by_bucket = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(bucket[by_bucket]) != 0])
                blobs = [x.tobytes() for x in np.split(entries[by_bucket], cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[by_bucket][cuts], pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "entries"])
                at = stop
        trim()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for batch in batches for x in batch.column("entries").to_pylist()]
        entries = np.frombuffer(b"".join(blobs), ENTRY)
        del blobs
        for i, j in met_pairs(entries, p, q):
            a, b = entries[i], entries[j]
            swap = a["set_id"] > b["set_id"]
            a[swap], b[swap] = b[swap], a[swap]
            kept = np.unique(np.stack([a[x].astype(np.int64) for x in ("set_id", "root", "n")] + [b[x].astype(np.int64) for x in ("set_id", "root", "n")]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in kept], names=["set_a", "u", "n", "set_b", "v", "m"])
        trim()

    sent = rooted.mapInArrow(emit, "bucket bigint, entries binary")
    pairs = materialize(sent.groupBy("bucket").applyInArrow(meet, "set_a long, u long, n long, set_b long, v long, m long").distinct(), "met")
    for side in "ab":
        pairs = pairs.join(prefixes.select(F.col("set_id").alias(f"set_{side}"), F.col("sketch").alias(f"sketch_{side}")), f"set_{side}")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v, "<u8") for v in batch.column(k).to_pylist()] for k in (4, 5))
            total = batch.column(6).to_pylist()
            yield batch.select(range(4)).filter(pa.array([may_be_alike(*z, p, q) for z in zip(x, y, total)], pa.bool_()))
        trim()

    pairs = pairs.select("set_a", "set_b", "u", "v", "sketch_a", "sketch_b", (F.col("n") + F.col("m")).alias("total"))
    return pairs.mapInArrow(near, "set_a long, set_b long, u long, v long")


def alike(pairs: DataFrame, only: DataFrame, sets: DataFrame, similar: float, seed: int) -> DataFrame:
    """The ``pairs`` (set_a, set_b, u, v) whose sets have a Jaccard similarity of ``similar`` or more, as (u, v).

    ``sets`` (set_id, file, row) names a row of ``only`` (text, file, row) for each set.  Only the texts that
    are compared are cut into shingles, where they lie; their shingles' hashes are shuffled, not they.
    """
    p, q = ratio(similar)
    need = pairs.select(F.col("set_a").alias("set_id")).union(pairs.select("set_b")).distinct()
    places = materialize(sets.select("set_id", "file", "row").join(need, "set_id"), "compared")

    def grams_of(texts):
        return [pa.array([shingle_set(t, seed).view(np.int64) for t in texts], pa.list_(pa.int64()))]

    chosen = chosen_rows(only.select("file", "row", "text"), places.select("file", "row"), "file", "row")
    grams = append_columns(chosen, "text", [("grams", T.ArrayType(T.LongType()))], grams_of).select("file", "row", "grams")
    grams = materialize(grams.join(places, ["file", "row"]).select("set_id", "grams"), "grams")
    release(places)
    for side in "ab":
        pairs = pairs.join(grams.select(F.col("set_id").alias(f"set_{side}"), F.col("grams").alias(f"grams_{side}")), f"set_{side}")
    pairs = pairs.withColumn("both", F.size(F.array_intersect("grams_a", "grams_b")))
    links = materialize(pairs.where(f"{q} * both >= {p} * (size(grams_a) + size(grams_b) - both)").select("u", "v").distinct(), "links")
    release(grams)
    return links


def similar_classes(only: DataFrame, rows: DataFrame, linked: DataFrame, similar: float, seed: int) -> DataFrame:
    """(u, root) of fingerprints whose class is not their own, after texts of a Jaccard similarity of
    ``similar`` or more are linked as well.  ``only`` has text, file and row; ``rows`` has file, row, fp and the
    columns of ``with_sets``; ``linked`` (u, root) are the classes so far."""
    p, q = ratio(similar)
    known = rows.where("set_id is not null")
    # One row for each set; its band keys are read where they lie.
    first = known.groupBy("set_id").agg(F.min(F.struct("file", "row")).alias("x")).select("x.file", "x.row")
    sets = materialize(chosen_rows(known, first, "file", "row").select("set_id", "set_size", "fp", "file", "row", "band_keys"), "sets")
    # Fingerprints of one set are one class.
    same = known.select("set_id", F.col("fp").alias("u")).distinct().join(sets.select("set_id", F.col("fp").alias("v")), "set_id").where("u <> v").select("u", "v")
    linked = components(linked.withColumnRenamed("root", "v").unionByName(same))
    # The bands that several sets share, and with how many sets a set shares its bands.
    every = sets.select("set_id", F.explode("band_keys").alias("key"))
    sizes = materialize(every.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = materialize(every.join(sizes, "key").select("key", "set_id", "size"), "shared")
    rank = shared.groupBy("set_id").agg(F.sum("size").alias("rank"))
    nodes = materialize(sets.join(rank, "set_id").select("set_id", "fp", F.col("set_size").alias("n"), "rank"), "nodes")
    keys = materialize(shared.select("key", "set_id").join(nodes, "set_id"), "keys")
    for done in (sizes, shared, nodes):
        release(done)
    used, compared = None, None
    # Sets of similarity s differ in size by the factor s at most.
    fits = f"root <> v and {q} * least(n, m) >= {p} * greatest(n, m)"
    while True:
        rooted = materialize(keys.join(linked.withColumnRenamed("u", "fp"), "fp", "left").select("key", "set_id", "n", "rank", F.coalesce("root", "fp").alias("root")), "rooted")
        left = rooted if used is None else rooted.join(used, ["key", "set_id"], "left_anti")
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        centre = F.max(F.struct("rank", F.col("set_id").alias("c"), F.col("root").alias("v"), F.col("n").alias("m"))).alias("x")
        centres = materialize(left.join(mixed, "key", "left_semi").groupBy("key").agg(centre).select("key", "x.c", "x.v", "x.m"), "centres")
        pairs = rooted.join(centres, "key").where(fits).select(F.col("set_id").alias("set_a"), F.col("c").alias("set_b"), F.col("root").alias("u"), "v").distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["set_a", "set_b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        links = alike(pairs, only, sets, similar, seed)
        release(rooted)
        if links.isEmpty():
            break
        linked = components(linked.withColumnRenamed("root", "v").unionByName(links))
        now = centres.select("key", F.col("c").alias("set_id"))
        used = now if used is None else used.unionByName(now)
        now = pairs.select("set_a", "set_b")
        compared = now if compared is None else compared.unionByName(now)
    compared = pairs if compared is None else compared.unionByName(pairs.select("set_a", "set_b"))
    pairs = rest(only, sets, linked, similar, seed)
    for x, y in (("set_a", "set_b"), ("set_b", "set_a")):
        pairs = pairs.join(compared.select(F.col(x).alias("set_a"), F.col(y).alias("set_b")), ["set_a", "set_b"], "left_anti")
    links = alike(materialize(pairs, "pairs"), only, sets, similar, seed)
    return components(linked.withColumnRenamed("root", "v").unionByName(links))


def with_fingerprint(docs: DataFrame, text_col: str = "text", width: int = 4, seed: int = 42, out: str = "fp") -> DataFrame:
    """``docs`` with the 64-bit fingerprint of each whole text, as a signed long."""

    def per_batch(texts):
        return [pa.array(fingerprint_batch(texts, width, seed).view(np.int64), pa.int64())]

    return append_columns(docs, text_col, [(out, T.LongType())], per_batch)


# ------------------------------------------------------------------------------------------ ball hashing


@lru_cache(maxsize=64)
def linear_tables(k: int, more: int) -> np.ndarray:
    """Byte tables of a linear map from 64 bits to k + ``more`` bits.

    The first k are parities of every k-th bit, so a changed bit changes one of them; the others are random.
    """
    columns = np.random.default_rng(64).integers(0, 1 << 30, 64, np.int64) & ((1 << more) - 1)
    columns = columns << k | (np.int64(1) << np.arange(64) % k if k else 0)
    tables = np.zeros((8, 256), np.int64)
    for b in range(8):
        for v in range(256):
            for i in range(8):
                if v >> i & 1:
                    tables[b, v] ^= columns[8 * b + i]
    return tables


def linear_hash(values: np.ndarray, k: int, more: int = 0) -> np.ndarray:
    tables, out = linear_tables(k, more), np.zeros(len(values), np.int64)
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    for b in range(8):
        out ^= tables[b][raw[:, b]]
    return out


@lru_cache(maxsize=2)
def ball_masks(half: int, k: int, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All XOR masks of at most ``half`` bits in order of their hash, and these hashes."""
    masks = np.array([sum(1 << i for i in c) for n in range(half + 1) for c in combinations(range(64), n)], np.uint64)
    h = linear_hash(masks, k, more)
    order = np.argsort(h, kind="stable")
    return masks[order], h[order]


def bucket_links(fps: np.ndarray, bucket: int, radius: int, k: int, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest one of its local component) for all that a variant of this bucket links;
    ``fps`` is sorted and distinct, ``bucket`` has k + ``more`` bits."""
    core = radius // 2
    masks, hashes = ball_masks(radius - core, k, more)
    h = linear_hash(fps, k, more) ^ bucket
    first = np.searchsorted(hashes, h)
    owned = np.searchsorted(hashes, h, "right") - first
    o = np.repeat(np.arange(len(fps)), owned)
    place = np.arange(len(o)) - np.repeat(np.cumsum(owned) - owned, owned) + first[o]
    mask = masks[place]
    v = fps[o] ^ mask
    empty = np.zeros(0, np.uint64)
    if not len(v):
        return empty, empty
    ranked = np.sort(v)
    shared = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(shared):
        return empty, empty
    place = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
    met = shared[place] == v
    key, who, outer = place[met], o[met], np.bitwise_count(mask[met]) > core
    order = np.lexsort((who, outer, key))
    key, who, outer = key[order], who[order], outer[order]
    begins = np.flatnonzero(np.r_[True, np.diff(key) != 0])
    sizes = np.diff(np.r_[begins, len(key)])
    # A centre is nearer than the ball's edge if the radius is odd; where there is none, no pair is within it.
    centre, usable = np.repeat(who[begins], sizes), np.repeat(~outer[begins], sizes)
    pair = np.unique(centre[usable] * len(fps) + who[usable])
    a, b = pair // len(fps), pair % len(fps)
    near = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= radius)
    a, b = a[near], b[near]
    label = np.arange(len(fps))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def variants_of(radius: int) -> int:
    """Variants that a fingerprint emits."""
    return sum(comb(64, i) for i in range((radius + 1) // 2 + 1))


def bucket_bits(n: int, radius: int) -> int:
    """k for n distinct fingerprints: 2**k buckets own ``BUCKET_VARIANTS`` variants each on average at most."""
    return max(0, int(np.ceil(np.log2(max(1, n * variants_of(radius) / BUCKET_VARIANTS)))))


def sent_to(radius: int, k: int) -> int:
    """Buckets that a fingerprint is sent to, 8 bytes each."""
    return len(np.unique(ball_masks((radius + 1) // 2, k)[1]))


def ball_links(fps: DataFrame, n: int, radius: int = 4, col: str = "fp") -> DataFrame:
    """Links (u, v), v < u unsigned, whose components are those of all pairs within ``radius`` bits.

    ``fps`` holds the distinct fingerprints, ``n`` is their number.
    """
    half, k = (radius + 1) // 2, bucket_bits(n, radius)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned = np.unique(ball_masks(half, k)[1])
        # So many fingerprints at once that what goes out in one piece stays small.
        most = max(1, min(CHUNK, PAIRS // len(owned)))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(values), most):
                part = values[at : at + most]
                buckets = (linear_hash(part, k)[:, None] ^ owned[None, :]).ravel()
                order = np.argsort(buckets, kind="stable")
                sent = part[order // len(owned)]
                cuts = np.flatnonzero(np.r_[True, np.diff(buckets[order]) != 0])
                blobs = [x.tobytes() for x in np.split(sent, cuts[1:])]
                names = pa.array(buckets[order][cuts], pa.int64())
                yield pa.RecordBatch.from_arrays([names, pa.array(blobs, pa.binary())], names=["bucket", "fps"])

    def meet(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        fps = np.unique(np.frombuffer(b"".join(group.column("fps").to_pylist()), np.uint64))
        # More bits of the hash cut the bucket into parts that are met one after another.
        hashes = ball_masks(half, k)[1]
        target = linear_hash(fps, k) ^ bucket
        total = int((np.searchsorted(hashes, target, "right") - np.searchsorted(hashes, target)).sum())
        more = max(0, int(np.ceil(np.log2(max(1, total / AT_ONCE)))))
        parts = [bucket_links(fps, bucket | part << k, radius, k, more) for part in range(1 << more)]
        u, v = (np.concatenate([x[side] for x in parts]) for side in (0, 1))
        trim()
        return pa.table({"u": pa.array(u.view(np.int64), pa.int64()), "v": pa.array(v.view(np.int64), pa.int64())})

    sent = fps.select(F.col(col).alias("fp")).mapInArrow(emit, "bucket bigint, fps binary")
    return sent.groupBy("bucket").applyInArrow(meet, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(u, root) for every node of ``links`` (u, v) but the roots; the root is the smallest signed value.

    Large-star and small-star steps in turn, each a partial aggregate and a join; all tables are written
    to the shared folder, so no lineage grows and nothing is collected.  The minima are written too: then
    both sides of a join are read and shuffled for it alone, and a node with very many links is split.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = materialize(links.where("u <> v").select(high, low).distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "links")
        release(lowest)
        lowest = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = materialize(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        release(lowest)
        release(large)
        release(edges)
        edges = step
    return edges.select("u", F.col("v").alias("root"))


def classes_of(rows: DataFrame, radius: int, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of ``rows`` (doc_id, fp); root names its class.

    ``more`` turns the classes (u, root) that fingerprints alone make into larger ones.
    """
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = components(ball_links(nodes, nodes.count(), radius))
    if more:
        linked = more(linked)
    members = nodes.join(linked.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = materialize(members.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    return members.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (long), ``root`` (the fingerprint naming its class) and
    ``component_id``, the smallest doc_id of the class."""
    only = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = materialize(with_fingerprint(only, "text", width, seed).select("doc_id", "fp"), "fingerprints")
    return rows.join(classes_of(rows, radius), "fp").select("doc_id", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4, similar: float | None = None) -> DataFrame:
    """``docs`` with one document of each class: the one of the smallest id (nulls last).

    Of rows with the same id, the one of the smallest text hash stays, then the first one.  With ``similar``,
    texts whose sets of five-word shingles have at least this Jaccard similarity are linked too, whatever their
    fingerprints.  Rows are known by their place in the files, so no text is shuffled.
    """
    placed, file, row = placed_rows(docs, "documents")
    text = F.col(f"`{text_col}`")
    only = placed.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.col(file).alias("file"), F.col(row).alias("row"))
    marked = with_fingerprint(only, "text", width, seed) if similar is None else with_sets(only, width, seed)
    rows = materialize(marked.drop("text"), "fingerprints")
    more = None if similar is None else lambda linked: similar_classes(only, rows, linked, similar, seed)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "file", "row")
    first = rows.select("doc_id", "h", "file", "row", "fp").join(classes_of(rows, radius, more), "fp").groupBy("root").agg(F.min(order).alias("x"))
    kept = chosen_rows(placed, first.select(F.col("x.file").alias(file), F.col("x.row").alias(row)), file, row)
    return without(kept, [file, row])


def hex_fingerprint(col: str = "fp"):
    return F.lpad(F.lower(F.hex(col)), 16, "0")
