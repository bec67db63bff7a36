"""Plain search over lists of words: what the engine's plans should find and score."""

import math
import random
import re

MUST, SHOULD, NOT = "MUST", "SHOULD", "MUST_NOT"


def norm(n):
    """1/sqrt(n), cut to the next lower of 4, 5, 6 and 7 eighths of a power of two."""
    if n == 0:
        return 0.0
    power = 1.0
    while power * power * n > 1:
        power /= 2
    return max(power * (1 + k / 4) for k in range(4) if (power * (1 + k / 4)) ** 2 * n <= 1)


def pool(seed, n=90, letters="kmnprstv", longest=30):
    """Documents of words of one or two letters, some empty, drawn with a bias to the first ones."""
    draw = random.Random(seed)
    vocabulary = list(letters) + [a + b for a in letters[:3] for b in letters[:3]]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [" ".join(draw.choices(vocabulary, weights, k=draw.randint(0, longest))) for _ in range(n)], vocabulary


class Plain:
    def __init__(self, texts, deleted=(), words=None):
        self.docs = [(words or str.split)(t) for t in texts]
        self.deleted = set(deleted)

    def idf(self, term):
        return 1 + math.log(len(self.docs) / (1 + sum(term in d for d in self.docs)))

    def starts(self, doc, terms, offsets):
        return sum(all(0 <= p + o < len(doc) and doc[p + o] == t for t, o in zip(terms, offsets)) for p in range(len(doc)))

    def weight(self, q):
        """Sum of squares of what a query's clauses weigh."""
        if q[0] == "term":
            return self.idf(q[1]) ** 2
        if q[0] == "phrase":
            return sum(map(self.idf, q[1])) ** 2
        return sum(self.weight(c) for o, c in q[1] if o != NOT)

    def score(self, doc, q, factor):
        """None if the document doesn't match."""
        if q[0] == "term":
            return math.sqrt(doc.count(q[1])) * self.idf(q[1]) ** 2 * factor * norm(len(doc)) if q[1] in doc else None
        if q[0] == "phrase":
            n = self.starts(doc, q[1], q[2])
            return math.sqrt(n) * sum(map(self.idf, q[1])) ** 2 * factor * norm(len(doc)) if n else None
        got = [(o, self.score(doc, c, factor)) for o, c in q[1]]
        held = [s for o, s in got if o != NOT and s is not None]
        if not held or any((s is None) == (o == MUST) for o, s in got if o in (MUST, NOT)):
            return None
        most = sum(o != NOT for o, _ in got)
        return sum(held) * (len(held) / most if most > 1 else 1)

    def hits(self, q):
        """(doc, score), the best first, ties by doc."""
        square = self.weight(q)
        factor = 1 / math.sqrt(square) if square else 1.0
        found = [(i, self.score(d, q, factor)) for i, d in enumerate(self.docs) if i not in self.deleted]
        return sorted(((i, s) for i, s in found if s is not None), key=lambda x: (-round(x[1], 6), x[0]))

    def holding(self, accept):
        """Documents with a word that is accepted."""
        return [i for i, d in enumerate(self.docs) if i not in self.deleted and any(map(accept, d))]


def edits(a, b):
    """Fewest inserts, deletes, replacements and swaps of neighbours, no place edited twice."""
    d = {(i, j): max(i, j) if not i or not j else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def sideways(shelf, hits, drills, requests):
    """Counts by request of drill-sideways. ``shelf``: doc -> dim -> list of paths, ``hits``: matching docs, all of them.

    Ties are ordered by first appearance of the category, the later first.
    """
    first = {}
    for i in sorted(shelf):
        for place, dim in enumerate(shelf[i]):
            for k, path in enumerate(shelf[i][dim]):
                parts = path.split("/")
                for n in range(1, len(parts) + 1):
                    first.setdefault((dim, "/".join(parts[:n])), (i, place, k, n))

    def misses(i):
        return [d for d, wanted in drills.items() if not any(p == w or p.startswith(w + "/") for p in shelf[i][d] for w in wanted)]

    out = []
    for dim, k, *rest in requests:
        under = rest[0] + "/" if rest else ""
        depth = under.count("/") + 1
        counts = {}
        for i in hits:
            if not misses(i) or misses(i) == [dim]:
                labels = {"/".join(p.split("/")[:depth]) for p in shelf[i][dim] if len(p.split("/")) >= depth}
                for x in labels:
                    if x.startswith(under):
                        counts[x] = counts.get(x, 0) + 1
        ranked = sorted(counts.items(), key=lambda x: (x[1], first[dim, x[0]]), reverse=True)
        out.append(ranked[:k])
    return [i for i in hits if not misses(i)], out


def matches(pattern):
    return lambda word: re.fullmatch(pattern, word) is not None
