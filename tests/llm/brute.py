"""Plain re-computations that the operators are compared with."""

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def fingerprint(text) -> int:
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(n: int, linked) -> list[int]:
    """Smallest index reachable from each of 0 ... n - 1."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_duplicates(rows):
    """[(doc_id, fingerprint, component_id)] of [(doc_id, text)]."""
    prints = [fingerprint(t) for _, t in rows]
    root = reachable(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    smallest = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            smallest[r] = min(i, smallest.get(r, i))
    return [(i, f"{p:016x}", smallest.get(r)) for (i, _), p, r in zip(rows, prints, root)]


def removed(rows, window, units):
    """Per row a mask of the removed units; rows are (doc_id, text)."""
    seqs = [(i, units(t)) for i, t in rows]
    first = {}
    for i, s in seqs:
        if i is not None:
            for p in range(len(s) - window + 1):
                key = tuple(s[p : p + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, s in seqs:
        mask = [False] * len(s)
        if i is not None:
            for p in range(len(s) - window + 1):
                if first[tuple(s[p : p + window])] < i:
                    mask[p : p + window] = [True] * window
        out.append((s, mask))
    return out


def bytes_of(text):
    return (text or "").encode()


def words_of(text):
    return WORD.findall((text or "").encode())


def byte_row(s, mask):
    """n_bytes, n_removed, n_spans, kept"""
    runs = len(re.findall(b"\1+", bytes(mask)))
    return len(s), sum(mask), runs, bytes(c for c, m in zip(s, mask) if not m)


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def contained(docs, items):
    """{(doc_id, item_id): (n_shared, n_item)}"""
    own = [(d, shingles(t)) for d, t in docs]
    out = []
    for i, t in items:
        s = shingles(t)
        out += [(d, i, len(s & o), len(s)) for d, o in own if s and 10 * len(s & o) >= 8 * len(s)]
    return out


def encoder():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def jump(key: int, shards: int) -> int:
    key %= 2**64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b
