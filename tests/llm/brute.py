"""Plain versions of the operators, for small fixtures."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(rows, width):
    """[(id, n_words, n_removed, kept)] of rows (id, text): windows that start in a smaller id go."""
    low = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            if i is not None:
                low[key] = min(low.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for j in range(len(w) - width + 1):
            if i is not None and low[tuple(w[j : j + width])] < i:
                keep[j : j + width] = [False] * width
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((i, len(w), len(w) - len(kept), " ".join(kept)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(rows, words, percent):
    """{id: (set size, component)} for unique ids."""
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + words]) for j in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    where, common = collections.defaultdict(list), collections.Counter()
    for i in sorted(sets):
        for s in sets[i]:
            for j in where[s]:
                common[j, i] += 1
            where[s].append(i)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def distance(item, text):
    """Smallest edit distance of ``item`` to a substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, z in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != z)))
        row = new
    return min(row)
