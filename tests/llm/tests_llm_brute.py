"""Brute-force versions that several test modules hold results against."""

import hashlib
from itertools import combinations

import xxhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits=2):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(sorted(set(fps)), 2):
        if bin(a ^ b).count("1") <= bits:
            root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps):
        r = find(f)
        least[r] = min(least.get(r, i), i) if i is not None and least.get(r) is not None else (
            least.get(r) if i is None else i)
    return [least[find(f)] for f in fps]


def brute_shards(rows, limit):
    """Split buckets of documents one bit at a time."""
    h = {k: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) for k, (i, _) in enumerate(rows)}
    size = {k: n for k, (_, n) in enumerate(rows)}
    out, stack = {}, [("", list(h))]
    while stack:
        bits, docs = stack.pop()
        if not docs:
            continue
        if sum(size[k] for k in docs) <= limit or len(bits) == 60:
            out.update({k: bits for k in docs})
            continue
        for b in "01":
            stack.append((bits + b, [k for k in docs if format(h[k], "060b")[len(bits)] == b]))
    return out


def brute_infix(item, text):
    """Word edit distance of an item to the nearest piece of a text."""
    d = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(text, 1):
            prev, d[j] = d[j], min(prev + (x != y), d[j] + 1, d[j - 1] + 1)
    return min(d)
