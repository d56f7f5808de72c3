"""Plain Python versions of the operators, written from their definitions."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs, min_docs=3, min_chars=20):
    """docs: (doc_id, text) with distinct ids."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            holders[key(x)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and d != max(holders[key(x)]))]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def jaccard(docs, n, percent):
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(FOLD))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def substring_dedup(docs, window=20):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        drop = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                drop[i : i + window] = [True] * window
            seen.add(k)
        out[d] = (len(w), sum(drop), sha(" ".join(x for x, y in zip(w, drop) if not y)))
    return out
