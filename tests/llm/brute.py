"""Plain computations that the operators are held against."""

import collections
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near(docs, width, percent=80):
    """id: (size of the shingle set, component)."""
    sets = {}
    for k, text in docs.items():
        w = WORD.findall(lower(text))
        sets[k] = frozenset() if not w else frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    parent = {k: k for k in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = [k for k in docs if sets[k]]
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in docs}


def repeats(words):
    """Words in windows of three that occur twice."""
    count = collections.Counter(zip(words, words[1:], words[2:]))
    return len({i + k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in range(3)})
