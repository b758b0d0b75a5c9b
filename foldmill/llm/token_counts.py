"""Token counts by a map-side two-tier lookup.

Tier one is a compact table, broadcast once, from frequent pre-tokens to their numbers of tokens.  Which
pre-tokens are frequent is counted over a bounded sample of documents (``SAMPLE`` rows; a parameter that
changes speed, never a count): each task adds up its own counts, those above one are shuffled, and the most
frequent are kept up to ``TABLE_WORDS`` entries and ``TABLE_BYTES`` bytes.  Tier two encodes a miss by exact
BPE merging and keeps its count in a bounded cache of the worker.  No pre-token of the documents is shuffled:
every document is counted where it is read.

Cases: a null text counts as empty and has 0 bytes and 0 tokens; repeated rows and ties do not interact;
an empty table gives an empty result; texts are counted whole whatever their length; other columns pass
through, and the added columns replace columns of the same name.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter as Tally
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytelevel import UNSETTLED, Merges, library, load
from .common import append_columns, resident, slices, small_batches

#: Entries of the broadcast table, and bytes of their words, at most.
TABLE_WORDS, TABLE_BYTES = 65_536, 1 << 20
#: Documents, about, whose pre-tokens are counted to choose the entries.
SAMPLE = 2_000
#: Distinct pre-tokens that a task of this count holds before it puts them out.
HELD = 200_000
#: Counts in the younger half of a worker's cache; when it is full it becomes the older half.
CACHE_WORDS = 250_000


class Counter:
    """Counts tokens of whole texts for one word-end BPE vocabulary."""

    def __init__(self, path: str, frequent: dict[str, int]) -> None:
        spec = load(path)
        self.path = path
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"] or "")
        (pattern,) = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(pattern)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = frozenset(special)
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.frequent = frequent
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def plain(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings, normalised as the vocabulary asks."""
        if not text.isascii():
            if UNSETTLED.search(text):
                lib = library(self.path)
                text = lib.normalizer.normalize_str(text)
                return [text[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(text)]
            # A capital sigma becomes a medial one wherever it stands: characters are mapped one by one.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words.findall(text.lower())

    def pre_tokens(self, text: str | None) -> tuple[int, list[str]]:
        """Special strings in a text, and its other pre-tokens."""
        if not text:
            return 0, []
        if self.split is None or "<" not in text:
            return 0, self.plain(text)
        parts = self.split.split(text)
        return sum(p in self.special for p in parts), [w for p in parts if p and p not in self.special for w in self.plain(p)]

    def counts(self, texts: list[str | None]) -> list[int]:
        out = []
        for at in range(0, len(texts), 256):
            bases, words = zip(*map(self.pre_tokens, texts[at : at + 256]))
            if len(self.young) > CACHE_WORDS:
                self.old, self.young = self.young, {}
            frequent, young, old, new = self.frequent, self.young, self.old, []
            local: dict[str, int] = {}
            for w in set().union(*words):
                n = frequent.get(w)
                if n is None:
                    n = young.get(w)
                    if n is None:
                        n = old.get(w)
                        if n is None:
                            new.append(w)
                            continue
                        young[w] = n
                local[w] = n
            for w, ids in zip(new, self.merges.encode_many([w.encode() for w in new])):
                local[w] = young[w] = len(ids)
            get = local.__getitem__
            out += [b + sum(map(get, x)) for b, x in zip(bases, words)]
        return out


def frequent(docs: DataFrame, path: str, text_col: str = "text", sample: int = SAMPLE, words: int = TABLE_WORDS, size: int = TABLE_BYTES) -> pa.RecordBatch:
    """(word, n): the most frequent pre-tokens of a sample of ``docs`` and their numbers of tokens, within both bounds."""
    small_batches(docs.sparkSession)
    total = docs.count()
    some = docs.select(F.col(f"`{text_col}`").alias("text"))
    some = some.sample(fraction=sample / total, seed=7) if total > sample else some

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held = worker(path), Tally()
        for batch in (part for whole in batches for part in slices(whole, 0)):
            for text in batch.column(0).to_pylist():
                held.update(counter.pre_tokens(text)[1])
            if len(held) > HELD:
                yield tallied(held)
                held = Tally()
        yield tallied(held)

    counts = some.mapInArrow(tally, "word string, times bigint").groupBy("word").agg(F.sum("times").alias("times"))
    chosen = counts.orderBy(F.desc("times"), "word").limit(words)
    before = F.sum(F.octet_length("word")).over(Window.orderBy(F.desc("times"), "word"))  # over ``words`` rows at most
    found = [r["word"] for r in chosen.withColumn("bytes", before).where(F.col("bytes") <= size).collect()]
    lengths = [len(ids) for ids in worker(path).merges.encode_many([w.encode() for w in found])]
    return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(lengths, pa.int32())], names=["word", "n"])


def tallied(held: Tally) -> pa.RecordBatch:
    held = {w: n for w, n in held.items() if n > 1}
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "times"])


def worker(path: str, name: str = "", shared=None) -> Counter:
    """The counter of this process; ``shared`` is the broadcast table, known by ``name``."""
    return resident(("counts", path, name), lambda: Counter(path, dict(zip(*(c.to_pylist() for c in shared.value.columns))) if shared else {}))


def with_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    shared, name = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text_col)), uuid.uuid4().hex

    def per_batch(texts):
        tokens = worker(path, name, shared).counts(texts)
        sizes = [len(t.encode()) if t else 0 for t in texts]
        return [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]

    return append_columns(docs, text_col, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], per_batch, ("counts", path, name))
