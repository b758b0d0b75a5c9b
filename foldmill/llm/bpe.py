"""BPE encoding and decoding: speculate and verify.

For each distinct pre-token a greedy longest match proposes tokens.  A proposal is the true BPE result
if, and only if, each of its adjacent pairs is compatible: merging the two tokens' joined bytes gives
back just these two.  The pairs of all new words of an Arrow batch are tested in one vectorised lookup
against the verdicts so far; a pair met for the first time is decided by exact merging.  Only words with an
incompatible pair are merged exactly - and those of more than ``LONG`` bytes, since greedy matching goes on
word by word side by side and one long word would hold up all.  What a worker keeps, results of words and
verdicts on pairs, is bounded: the younger half becomes the older one when it is full.

Cases: a null text counts as empty; an empty text has no tokens (its ids hash is the hash of the
empty string); repeated rows and ties do not interact; an empty table gives an empty result; texts are
encoded whole whatever their length; other columns pass through, and the added columns replace columns
of the same name.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytelevel import UNSETTLED, Merges, library, load
from .common import append_columns, resident

#: Fixed value: the word pattern of byte-level vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words in the younger half of a worker's cache; when it is full it becomes the older half.
CACHE_WORDS = 64_000
#: Pair verdicts of the younger half (9 bytes each), and of those among them that are not merged in yet.
PAIRS, RECENT = 1 << 20, 1 << 15
#: Bytes from which a word is merged exactly without a proposal.
LONG = 512


class Verdicts:
    """Verdicts on pair codes in sorted arrays: recent ones, a younger and an older half."""

    def __init__(self) -> None:
        empty = np.zeros(0, np.int64), np.zeros(0, bool)
        self.recent = self.young = self.old = empty

    def __len__(self) -> int:
        return sum(len(codes) for codes, _ in (self.recent, self.young, self.old))

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each code is known, and its verdict."""
        known, good = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        for have, verdict in (self.young, self.recent, self.old):
            if len(have):
                at = np.minimum(np.searchsorted(have, codes), len(have) - 1)
                hit = have[at] == codes
                known |= hit
                good[hit] = verdict[at[hit]]
        return known, good

    @staticmethod
    def merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([a[0], b[0]])
        order = np.argsort(codes, kind="stable")
        return codes[order], np.concatenate([a[1], b[1]])[order]

    def add(self, codes: np.ndarray, good: np.ndarray) -> None:
        """Add codes that are not known."""
        self.recent = self.merged(self.recent, (codes, good))
        if len(self.recent[0]) > RECENT:
            self.young = self.merged(self.young, self.recent)
            self.recent = np.zeros(0, np.int64), np.zeros(0, bool)
            if len(self.young[0]) > PAIRS:
                self.old, self.young = self.young, self.recent


class ByteBpe:
    """Encoder and decoder of one vocabulary file; one instance per worker process."""

    def __init__(self, path: str) -> None:
        spec = load(path)
        self.path = path
        vocab = spec["model"]["vocab"]
        self.merges = Merges(vocab, spec["model"]["merges"])
        back = {c: b for b, c in self.merges.letters.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, k in vocab.items():
            self.bytes_of[k] = bytes(back[c] for c in token)
        for token, k in self.special.items():
            self.bytes_of[k] = token.encode()
        own = set(self.special.values())
        self.by_bytes = {b: k for k, b in enumerate(self.bytes_of) if b and k not in own}
        self._trie()
        del self.by_bytes
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.size = size
        self.verdicts = Verdicts()
        #: One object for each id: results hold references to these.
        self.numbers = list(range(size))
        self.cache: dict[str, tuple[int, str, tuple[int, ...]]] = {}
        self.old: dict[str, tuple[int, str, tuple[int, ...]]] = {}
        self.exact_words = self.seen_words = 0

    def _trie(self) -> None:
        """Transitions of the trie of all tokens, sorted by node and byte."""
        inner: dict[bytes, int] = {b"": 0}
        for token in self.by_bytes:
            for n in range(1, len(token)):
                inner.setdefault(token[:n], len(inner))
        moves: dict[int, list[int]] = {}
        for prefix, k in inner.items():
            if prefix:
                moves[inner[prefix[:-1]] << 8 | prefix[-1]] = [k, -1]
        for token, k in self.by_bytes.items():
            moves.setdefault(inner[token[:-1]] << 8 | token[-1], [-1, -1])[1] = k
        self.moves = np.array(sorted(moves), np.int64)
        #: For each move the inner node reached and the token completed, or -1.
        self.node, self.token = np.array([moves[m] for m in self.moves.tolist()], np.int32).T.copy()

    def propose(self, words: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words side by side: their token ids end to end, and their token counts.

        Every byte is a token, so each round of matching moves every unfinished word on.
        """
        raw = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        ends = np.cumsum(lengths)
        at = ends - lengths
        live = np.flatnonzero(at < ends)
        who, what = [], []
        while len(live):
            start, stop = at[live], ends[live]
            pos, node = start.copy(), np.zeros(len(live), np.int32)
            token, after = np.full(len(live), -1, np.int32), start.copy()
            walk = np.arange(len(live))
            while len(walk):
                move = node[walk].astype(np.int64) << 8 | raw[pos[walk]]
                at_move = np.minimum(np.searchsorted(self.moves, move), len(self.moves) - 1)
                known = self.moves[at_move] == move
                got = known & (self.token[at_move] >= 0)
                token[walk[got]] = self.token[at_move[got]]
                after[walk[got]] = pos[walk[got]] + 1
                node[walk] = np.where(known, self.node[at_move], -1)
                pos[walk] += 1
                walk = walk[(node[walk] >= 0) & (pos[walk] < stop[walk])]
            who.append(live)
            what.append(token)
            at[live] = after
            live = live[after < stop]
        who, what = np.concatenate(who), np.concatenate(what)
        order = np.argsort(who, kind="stable")
        return what[order].astype(np.int64), np.bincount(who, minlength=len(words))

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """Whether merging keeps each pair (code a * (size + 1) + b; b = size stands for a alone)."""
        distinct, at = np.unique(codes, return_inverse=True)
        known, good = self.verdicts.find(distinct)
        if not known.all():
            fresh = distinct[~known]
            pairs = [divmod(c, self.size + 1) for c in fresh.tolist()]
            joined = self.merges.encode_many([self.bytes_of[a] + (self.bytes_of[b] if b != self.size else b"") for a, b in pairs])
            good[~known] = np.fromiter((x == ([a, b] if b != self.size else [a]) for x, (a, b) in zip(joined, pairs)), bool, len(pairs))
            self.verdicts.add(fresh, good[~known])
        return good[at]

    def learn(self, words: list[str]) -> None:
        """Encode words that the cache does not hold yet."""
        self.seen_words += len(words)
        raw = [w.encode() for w in words]
        long = [k for k, x in enumerate(raw) if len(x) > LONG]
        if long:
            self.exact_words += len(long)
            for k, p in zip(long, self.merges.encode_many([raw[k] for k in long])):
                self.keep(words[k], p)
            words, raw = [w for w, x in zip(words, raw) if len(x) <= LONG], [x for x in raw if len(x) <= LONG]
        if not words:
            return
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat, lengths = self.propose(raw, sizes)
        ends = np.cumsum(lengths)
        nxt = np.empty_like(flat)
        nxt[:-1] = flat[1:]
        nxt[ends - 1] = self.size  # the last token of a word is paired with nothing
        checked = np.ones(len(flat), bool)
        ask = (nxt != self.size) | np.repeat(lengths == 1, lengths)
        checked[ask] = self.compatible(flat[ask] * (self.size + 1) + nxt[ask])
        good = np.logical_and.reduceat(checked, ends - lengths)
        ids, stops = flat.tolist(), ends.tolist()
        proposed = [ids[a:b] for a, b in zip([0, *stops], stops)]
        failing = np.flatnonzero(~good).tolist()
        self.exact_words += len(failing)
        for k, merged in zip(failing, self.merges.encode_many([raw[k] for k in failing])):
            proposed[k] = merged
        for w, p in zip(words, proposed):
            self.keep(w, p)

    def keep(self, word: str, ids: list[int]) -> None:
        self.cache[word] = (len(ids), ",".join(map(str, ids)), tuple(map(self.numbers.__getitem__, ids)))

    def plain(self, text: str) -> list[str]:
        if not text.isascii() and UNSETTLED.search(text):
            return [text[a:b] for _, (a, b) in library(self.path).pre_tokenizer.pre_tokenize_str(text)]
        return self.words.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Special strings and pre-tokens of a text, in order."""
        if self.split is None or "<" not in text:
            return self.plain(text)
        out: list[str] = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out.extend(self.plain(part))
        return out

    def encode_words(self, texts: list[str | None]) -> list[list[tuple[int, str, tuple[int, ...]]]]:
        """The cached results of each text's words, in order."""
        out: list[list] = []
        for at in range(0, len(texts), 256):
            words = [self.pieces(t) if t else [] for t in texts[at : at + 256]]
            if len(self.cache) > CACHE_WORDS:
                self.old, self.cache = self.cache, {}
            cache, old, new = self.cache, self.old, []
            for w in set(chain.from_iterable(words)):
                if w not in cache:
                    if (x := old.get(w)) is not None:
                        cache[w] = x
                    elif w in self.special:
                        k = self.special[w]
                        cache[w] = (1, str(k), (k,))
                    else:
                        new.append(w)
            self.learn(new)
            get = cache.__getitem__
            out += [list(map(get, x)) for x in words]
        return out

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(x[2] for x in self.encode_words([text])[0]))

    def decode(self, ids) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def worker(path: str) -> ByteBpe:
    """The encoder of this process."""
    return resident(("bpe", path), lambda: ByteBpe(path))


def with_tokens(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text as ARRAY<INT>."""

    def per_batch(texts):
        bpe = worker(path)
        return [pa.array([bpe.encode(t) for t in texts], pa.list_(pa.int32()))]

    return append_columns(docs, text_col, [(ids_col, T.ArrayType(T.IntegerType()))], per_batch, ("bpe", path))


def with_decoded(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text that its ids stand for; null ids give a null text."""

    def per_batch(ids):
        bpe = worker(path)
        return [pa.array([None if x is None else bpe.decode(x) for x in ids], pa.string())]

    return append_columns(tokens, ids_col, [(text_col, T.StringType())], per_batch, ("bpe", path))


def with_digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each whole text's round trip."""

    def per_batch(texts):
        bpe = worker(path)
        counts, hashes, decoded = [], [], []
        for found in chain.from_iterable(bpe.encode_words(texts[k : k + 256]) for k in range(0, len(texts), 256)):
            counts.append(sum([x[0] for x in found]))
            hashes.append(hashlib.sha256(",".join([x[1] for x in found]).encode()).hexdigest())
            back = bpe.decode(chain.from_iterable([x[2] for x in found]))
            decoded.append(hashlib.sha256(back.encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]

    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return append_columns(docs, text_col, added, per_batch, ("bpe", path))
