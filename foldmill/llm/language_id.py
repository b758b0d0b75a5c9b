"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed letter bigrams and trigrams, normalised to length one.  Each
language has several centroids, found by spherical k-means over a bounded sample of its distinct labelled
texts; a text gets the language of the centroid with the largest cosine, and is rejected if even that one is
too far away.  How far depends on the language and on the text's length: letter noise comes nearer by slot
collisions as it gets longer, and so do the learned languages.  A language's sample texts are compared with
centroids of the other half of its sample, and a text's cosine must reach ``MARGIN`` of a low quantile of
theirs at its length (of all languages' at lengths of which the language has few).

Every language that a label names is learned, each in a task of its own that holds its sample alone; the
driver gets some 70 kB a language.  Predicting shuffles nothing.

Cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; without any labelled
text all are; ties go to the first language in code-point order; repeated rows get equal results and count
once in training; an empty table gives an empty result; texts are read whole; other columns pass through, and
the added columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fresh, materialize, release, without

SLOTS = 1 << 12
CENTROIDS = 4
#: Distinct texts of a language that training uses at most.
PER_LANGUAGE = 500
#: Cosine below which a text of any length is too far from every language.
REJECT = 0.05
#: Quantile of the cosines at a length, and the share of it that a text must reach.
QUANTILE, MARGIN = 0.01, 0.85
#: Sample texts of a language (of this length class, else of shorter ones too) from which its own quantile holds,
#: and of all languages from which theirs does; with fewer, ``REJECT`` holds alone.
LEAST_OWN, LEAST_ALL = 100, 20
#: Length classes: powers of two of the number of grams.
LENGTHS = 40
CHUNK = 128
#: Characters whose grams are counted at once.
PIECE = 1 << 18


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def pieces(text: str) -> list[str]:
    """A text cut at characters that are no letters, so that no gram is lost or counted twice.

    Only a run of more than ``PIECE`` letters is cut within.
    """
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut > at and text[cut - 1].isalpha():
            cut -= 1
        cut = cut if cut > at else at + PIECE
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Gram counts (texts x SLOTS) and whether a text has a letter."""
    out, some = np.zeros(len(texts) * SLOTS, np.float32), np.zeros(len(texts), bool)
    held: list[tuple[int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        for piece in pieces(text or ""):
            held.append((k, piece))
            size += len(piece) + 2
            if size > PIECE:
                add_counts(held, out, some)
                held, size = [], 0
    if held:
        add_counts(held, out, some)
    return out.reshape(len(texts), SLOTS), some


def add_counts(held: list[tuple[int, str]], out: np.ndarray, some: np.ndarray) -> None:
    """Add the grams of (row, piece) to ``out``, row-major."""
    parts = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for _, t in held]
    owner = np.repeat(np.array([k for k, _ in held], np.int64), [len(p) for p in parts])
    part = np.repeat(np.arange(len(held)), [len(p) for p in parts])
    c = np.concatenate(parts)
    is_letter = letters()[c]
    some[owner[is_letter]] = True
    c = np.where(is_letter, c, 0).astype(np.uint32)
    # A run of other characters is one space, and each piece starts with one of its own.
    keep = is_letter | np.r_[True, is_letter[:-1]] | np.r_[True, part[1:] != part[:-1]]
    c, owner, part = c[keep], owner[keep], part[keep]
    two = (c[:-1] * np.uint32(0x9E3779B1)) ^ (c[1:] * np.uint32(0x85EBCA77))
    three = (two[:-1] * np.uint32(0xC2B2AE3D)) ^ (c[2:] * np.uint32(0x27D4EB2F))
    shift = np.uint32(32 - SLOTS.bit_length() + 1)
    low = int(owner[0]) * SLOTS
    size = (int(owner[-1]) + 1) * SLOTS - low
    for gram, back, inner in ((two, 1, c[1:]), (three, 2, c[1:-1])):
        good = (part[: len(gram)] == part[back:]) & (inner > 0)
        slot = (gram[good] * np.uint32(0x165667B1)) >> shift
        out[low : low + size] += np.bincount(owner[back:][good] * SLOTS + slot - low, minlength=size)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    owner: np.ndarray  # language of each centroid
    centres: np.ndarray  # centroids x SLOTS, unit length
    floors: np.ndarray  # languages x LENGTHS: least cosine of a text that is not rejected

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        return unit(np.sqrt(tf) * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language of each text, its cosine and the cosine that it needs."""
        names, best, needed = [], np.zeros(len(texts)), np.zeros(len(texts))
        for at in range(0, len(texts), CHUNK):
            tf, some = counts(texts[at : at + CHUNK])
            if not self.languages:
                names += ["und"] * len(tf)
                continue
            cosine = np.clip(self.vectors(tf) @ self.centres.T, 0, 1)
            k = cosine.argmax(1)
            best[at : at + CHUNK] = np.where(some, cosine[np.arange(len(k)), k], 0)
            needed[at : at + CHUNK] = self.floors[self.owner[k], length_classes(tf)]
            names += [self.languages[self.owner[j]] if s else "und" for j, s in zip(k, some)]
        return names, best, needed


def length_classes(tf: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(tf.sum(1), 1)).astype(np.int64), LENGTHS - 1)


def idf_of(n: int, having: np.ndarray) -> np.ndarray:
    """From the number of sample texts, and how many have each slot."""
    return (np.log((1 + n) / (1 + having)) + 1).astype(np.float32)


def centroids(x: np.ndarray) -> np.ndarray:
    """k-means of unit vectors by cosine; starts are spread by the farthest-point rule."""
    found = unit(x.mean(0, keepdims=True))
    while len(found) < min(CENTROIDS, len(x)):
        found = np.concatenate([found, x[[(x @ found.T).max(1).argmin()]]])
    for _ in range(8):
        near = (x @ found.T).argmax(1)
        found = unit(np.stack([x[near == j].mean(0) if (near == j).any() else found[j] for j in range(len(found))]))
    return found.astype(np.float32)


def cross_cosines(x: np.ndarray) -> np.ndarray:
    """Cosines of a language's vectors with the centroids of the half of them to which they do not belong."""
    half, best = np.arange(len(x)) % 2 == 0, np.zeros(len(x))
    if len(x) > 1:
        for own in (half, ~half):
            best[own] = (x[own] @ centroids(x[~own]).T).max(1)
    return best


def floors_of(cosines: np.ndarray, classes: np.ndarray, least: int) -> np.ndarray:
    """Least cosine that is not rejected, by length class; zero where too few texts tell."""
    out = np.zeros(LENGTHS)
    for c in range(LENGTHS):
        for low in range(c, -1, -1):
            near = cosines[(classes >= low) & (classes <= c)]
            if len(near) >= least:
                out[c] = MARGIN * np.quantile(near, QUANTILE, method="lower")
                break
    return out


def dense(blobs: list[bytes]) -> np.ndarray:
    """Gram counts (texts x SLOTS) of sparse ones: slots, then their counts."""
    tf = np.zeros((len(blobs), SLOTS), np.float32)
    for k, blob in enumerate(blobs):
        flat = np.frombuffer(blob, "<f4")
        tf[k, flat[: len(flat) // 2].astype(int)] = flat[len(flat) // 2 :]
    return tf


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that no model learns from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, draw, text): for each language its ``per_language`` distinct texts of the smallest draws, or all
    if there are fewer.  A draw is a hash of the text, so copies draw alike and count once."""
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    usable = usable.select("lang", "text", F.xxhash64("text").alias("draw"))
    # Twice as many as needed pass a first threshold, from the number of distinct texts of each language.
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()  # one row a language
    share = [(r["lang"], int(min(1.0, 2 * per_language / max(1, r["n"])) * float(1 << 53))) for r in sizes]
    share = docs.sparkSession.createDataFrame(share, "lang string, share bigint")
    few = usable.join(F.broadcast(share), "lang").where(F.col("draw").bitwiseAND(F.lit((1 << 53) - 1)) < F.col("share"))
    few = few.groupBy("lang", "draw").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("draw").bitwiseAND(F.lit((1 << 53) - 1)), "draw"))
    return few.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "draw", "text")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Centroids:
    """Learn from ``docs`` (doc_id, text, lang), without the held-out fold."""

    def per_batch(texts):
        blobs = []
        for at in range(0, len(texts), CHUNK):
            for row in counts(texts[at : at + CHUNK])[0]:
                slots = np.flatnonzero(row)
                blobs.append(np.concatenate([slots.astype("<f4"), row[slots].astype("<f4")]).tobytes())
        return [pa.array(blobs, pa.binary())]

    rows = append_columns(sample(docs, per_language), "text", [("grams", T.BinaryType())], per_batch)
    rows = materialize(rows.select("lang", "draw", "grams").where(F.octet_length("grams") > 0), "grams")

    def having(batches):
        total, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                flat = np.frombuffer(blob, "<f4")
                total[flat[: len(flat) // 2].astype(int)] += 1
                n += 1
        slots = np.r_[-1, np.flatnonzero(total)]
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(np.r_[n, total[slots[1:]]], pa.int64())], names=["slot", "n"])

    found = dict(map(tuple, rows.select("grams").mapInArrow(having, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n")).collect()))  # SLOTS + 1 rows
    texts = found.pop(-1, 0) or 0
    idf = idf_of(texts, np.array([found.get(k, 0) for k in range(SLOTS)]))

    def learn(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("draw").to_numpy(), kind="stable")
        blobs = group.column("grams").to_pylist()
        tf = dense([blobs[k] for k in order])
        x = unit(np.sqrt(tf) * idf)
        return pa.table({"lang": [group.column("lang")[0].as_py()], "centres": [centroids(x).tobytes()], "lengths": [np.stack([cross_cosines(x), length_classes(tf)]).astype("<f8").tobytes()]})

    each = sorted(map(tuple, rows.groupBy("lang").applyInArrow(learn, "lang string, centres binary, lengths binary").collect()))  # one row a language
    release(rows)
    centres = [np.frombuffer(x[1], np.float32).reshape(-1, SLOTS) for x in each]
    owner = np.repeat(np.arange(len(each)), [len(c) for c in centres])
    lengths = [np.frombuffer(x[2], "<f8").reshape(2, -1) for x in each]
    pooled = floors_of(*np.concatenate(lengths, 1), LEAST_ALL) if each else np.zeros(LENGTHS)
    floors = np.stack([np.where(own > 0, own, pooled) for own in (floors_of(*x, LEAST_OWN) for x in lengths)]) if each else np.zeros((0, LENGTHS))
    return Centroids([x[0] for x in each], idf, owner, np.concatenate(centres) if each else np.zeros((0, SLOTS), np.float32), floors)


NAMES = ("lang_pred", "lang_score", "lang_rejected")


def with_language(docs: DataFrame, model: Centroids, text_col: str = "text", reject: float = REJECT, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``docs`` with the predicted language, its cosine (0 to 1) and whether the text is rejected."""

    def per_batch(texts):
        langs, best, needed = model.predict(texts)
        refused = [n == "und" or s < max(reject, least) for n, s, least in zip(langs, best, needed)]
        return [pa.array(langs, pa.string()), pa.array(best, pa.float64()), pa.array(refused, pa.bool_())]

    return append_columns(docs, text_col, list(zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))), per_batch)


def accepted(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are too far from every language."""
    names = tuple(fresh(docs.columns, f"_{n}") for n in NAMES)
    return without(with_language(docs, model, text_col, names=names).where(~F.col(names[2])), names)
