"""Plain, slow versions of what the operators compute."""

from __future__ import annotations

import itertools
import re

import regex
import xxhash


def fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints, radius=4):
    """id -> smallest id that a chain of links reaches."""
    ids = sorted(fingerprints)
    parent = {k: k for k in ids}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fingerprints[a] ^ fingerprints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def similar_classes(docs, similar=0.8):
    """id -> smallest id of its class: near fingerprints, or five-word shingle sets of this similarity."""
    classes = components({k: fingerprint(t) for k, t in docs})
    sets = {}
    for k, t in docs:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets[k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    for a, b in itertools.combinations(sorted(sets), 2):
        if classes[a] != classes[b] and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= round(10 * similar) * len(sets[a] | sets[b]):
            low, high = sorted((classes[a], classes[b]))
            classes = {k: low if c == high else c for k, c in classes.items()}
    return classes


def words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def contaminated(text, item):
    """Most equal words in an aligned window within the tolerance, or 0."""
    a, b = words(text), words(item)
    k = min(13, len(a), len(b))
    if not k or (k < 8 and k < len(b)):
        return 0
    least = k - (2 if k >= 13 else 1 if k >= 10 else 0)
    best = 0
    for d in range(-(len(b) - k), len(a) - k + 1):
        same = [0 <= d + j < len(a) and a[d + j] == b[j] for j in range(len(b))]
        for s in range(max(0, -d), min(len(b), len(a) - d) - k + 1):
            n = sum(same[s : s + k])
            best = max(best, n if n >= least else 0)
    return best


def repeated_words(text, width=8):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    windows = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]
    covered = {p for k, x in enumerate(windows) if windows.count(x) > 1 for p in range(k, k + width)}
    return len(covered)
