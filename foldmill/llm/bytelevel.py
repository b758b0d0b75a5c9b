"""Reading of byte-level BPE vocabularies and exact merging of one word."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import regex

#: Characters outside these ranges may have another class in another Unicode version.  Texts with such
#: characters are split by the tokenizer library itself, so that both follow one version.
UNSETTLED = regex.compile(
    "[^\\0-\u052f\u0905-\u0939\u2000-\u2064\u2070-\u208e\u20a0-\u20bf\u2190-\u23ff\u2500-\u27bf\u3000-\u303e\u3041-\u3096\u30a0-\u30ff"
    "\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f5ff\U0001f600-\U0001f64f]"
)

#: Words of up to this many bytes are merged side by side; longer ones one by one with a heap.
SIDE_BY_SIDE = 48
#: Words merged side by side at once.
BLOCK = 16_384
NO_PAIR = np.int32(2**31 - 1)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Bytes that print in Latin-1 stand for themselves; the others follow from code point 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


class Merges:
    """Merge ranks over token ids; ``encode`` merges the lowest rank first, leftmost on ties."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "") -> None:
        self.suffix = suffix
        self.letters = byte_alphabet()
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = (k, vocab[a + b])
        self.first = [vocab[self.letters[b]] for b in range(256)]
        self.last = [vocab[self.letters[b] + suffix] for b in range(256)] if suffix else self.first
        pairs = sorted((a << 20 | b, k, m) for (a, b), (k, m) in self.rank.items())
        self.pair_codes = np.array([x[0] for x in pairs] + [2**62], np.int64)
        self.pair_ranks = np.array([x[1] for x in pairs] + [NO_PAIR], np.int32)
        self.merged = np.zeros(len(merges), np.int32)
        for _, k, m in pairs:
            self.merged[k] = m
        self.first_ids, self.last_ids = np.array(self.first, np.int32), np.array(self.last, np.int32)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_PAIR where there is no merge or b is negative (past the end)."""
        codes = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.pair_codes, codes)
        return np.where((b >= 0) & (self.pair_codes[at] == codes), self.pair_ranks[at], NO_PAIR)

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        """``encode`` of each word; short words are merged side by side, one merge of each per step."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        short = order[: np.searchsorted(lengths[order], SIDE_BY_SIDE, "right")]
        for k in order[len(short) :].tolist():
            out[k] = self.encode(words[k])
        for at in range(0, len(short), BLOCK):
            block = short[at : at + BLOCK]
            chosen = block.tolist()
            n = lengths[block]
            width = int(n[-1])
            raw = np.frombuffer(b"".join([words[k].ljust(width, b"\0") for k in chosen]), np.uint8).reshape(len(chosen), width)
            ids = np.full((len(chosen), width + 1), -1, np.int32)
            cols = np.arange(width)
            ids[:, :width] = np.where(cols < n[:, None], self.first_ids[raw], -1)
            ids[np.arange(len(chosen)), n - 1] = self.last_ids[raw[np.arange(len(chosen)), n - 1]]
            ranks = np.full((len(chosen), width + 1), NO_PAIR, np.int32)
            ranks[:, :width] = self.ranks_of(ids[:, :-1], ids[:, 1:])
            live, cols = np.arange(len(chosen)), np.arange(width + 1)
            step = np.minimum(cols + 1, width)
            own_ids, own_ranks = ids, ranks
            while True:
                p = own_ranks.argmin(1)
                rows = np.arange(len(p))
                best = own_ranks[rows, p]
                go = best != NO_PAIR
                if not go.all():
                    ids[live[~go]] = own_ids[~go]
                    live, own_ids, own_ranks, p, best = live[go], own_ids[go], own_ranks[go], p[go], best[go]
                    rows = np.arange(len(p))
                if not len(p):
                    break
                move = cols > p[:, None]
                own_ids = np.where(move, own_ids[:, step], own_ids)
                own_ranks = np.where(move, own_ranks[:, step], own_ranks)
                new = self.merged[best]
                own_ids[rows, p] = new
                own_ranks[rows, p] = self.ranks_of(new, own_ids[rows, np.minimum(p + 1, width)])
                has = p > 0
                own_ranks[rows[has], p[has] - 1] = self.ranks_of(own_ids[rows[has], p[has] - 1], new[has])
            counts = (ids >= 0).sum(1).tolist()
            for k, row, c in zip(chosen, ids.tolist(), counts):
                out[k] = row[:c]
        return out

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one non-empty word, in time O(n log n)."""
        ids = [self.first[b] for b in word]
        ids[-1] = self.last[word[-1]]
        n = len(ids)
        rank = self.rank
        if n < 40:
            while len(ids) > 1:
                best, at = None, 0
                for i in range(len(ids) - 1):
                    r = rank.get((ids[i], ids[i + 1]))
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                ids[at : at + 2] = [best[1]]
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n and (r := rank.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (r[0], left, ids[left], ids[right]))
        return [t for t in ids if t >= 0]


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=1)
def library(path: str):
    """The public library's tokenizer, for splitting texts with unsettled characters and for tests."""
    from tokenizers import Tokenizer  # only workers that need it hold it

    return Tokenizer.from_file(path)
