"""Brute-force versions, written without the operators."""

import hashlib
import re
import zlib

import xxhash

WS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def simhash(text):
    words = WS.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints, most=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


DW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items, k=13):
    """n_words, n_hit, item ids by trying every window everywhere."""
    w = DW.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        b = DW.findall(lower(body))
        if not b:
            continue
        n = min(k, len(b))
        for j in range(len(b) - n + 1):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[j : j + n]:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def crc(t):
    return zlib.crc32((t or "").encode())
