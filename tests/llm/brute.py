"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def substring(texts, window):
    """doc -> (n_words, n_removed, kept_sha256)"""
    words = {k: WORD.findall((t or "").encode()) for k, t in texts.items()}
    count = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def suffixes(texts, length):
    """doc -> (n_bytes, n_removed, n_spans, kept_sha256)"""
    seen, out = set(), {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(s)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[k] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def components(texts, gram=4, percent=85):
    """doc -> (n_shingles, component_id)"""
    sets = {}
    for k, t in texts.items():
        w = WORD.findall((t or "").encode().lower() if False else bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        sets[k] = {tuple(w[i : i + gram]) for i in range(max(1, len(w) - gram + 1))} if w else set()
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in ids}
