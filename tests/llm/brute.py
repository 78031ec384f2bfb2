"""Plain versions of what the operators compute, for small tables."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(_LOW))
    if len(w) >= k:
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def near_groups(rows, percent=80):
    """[(doc_id, set size, component)] of (doc_id, text) rows, every pair compared."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[top(i)].append(d)
    low = {g: min([d for d in ds if d is not None], default=None) for g, ds in groups.items()}
    return [(d, len(sets[i]), low[top(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def plain(df, *cols):
    """Rows as sorted tuples, nulls first."""
    return sorted(((tuple(r) for r in df.select(*cols).collect())), key=lambda r: [(v is not None, v) for v in r])


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is not None, v) for v in r])
