"""Plain versions of the operators, for small tables."""

import hashlib
import html
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def quality_counts(text):
    text = text or ""
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def shingles(text, size=5):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(docs):
    """docs: id -> text; (n_shingles, component) by id."""
    sets = {i: shingles(t) for i, t in docs.items()}
    links = [(a, b) for a in docs for b in docs if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = components(docs, links)
    return {i: (len(sets[i]), found[i]) for i in docs}


def passages(docs, window=50):
    """docs: id -> text; (n_words, n_removed, sha) by id."""
    first = {}
    for i in sorted(docs):
        w = words(docs[i])
        for at in range(len(w) - window + 1):
            first.setdefault(tuple(w[at : at + window]), i)
    out = {}
    for i, text in docs.items():
        w = words(text)
        gone = {at + k for at in range(len(w) - window + 1) if first[tuple(w[at : at + window])] < i for k in range(window)}
        out[i] = (len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone)))
    return out


def repeats(docs, window=100):
    """docs: id -> text; (n_bytes, n_removed, n_spans, sha) by id."""
    seen, out = set(), {}
    for i in sorted(docs):
        data = (docs[i] or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - window + 1):
            w = data[at : at + window]
            if w in seen:
                gone[at : at + window] = b"\1" * window
            seen.add(w)
        runs = sum(1 for n, g in enumerate(gone) if g and not (n and gone[n - 1]))
        out[i] = (len(data), sum(gone), runs, sha(bytes(b for b, g in zip(data, gone) if not g)))
    return out


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def exact(docs):
    """rows of (id, text); (keep_id, size) by position."""
    groups = defaultdict(list)
    for i, text in docs:
        groups[norm(text)].append(i)
    return [(min(groups[norm(t)]), len(groups[norm(t)])) for _, t in docs]


def article(page):
    """Blocks of the article element of a generated page, by plain substitutions."""
    inner = page[page.index("<article") : page.index("</article>")] if "<article" in page else page
    inner = re.sub(r"<!--.*?-->|<(script|style|nav|aside|footer|form)\b.*?</\1>|<div class=\"?ad\"?>.*?</div>", "", inner, flags=re.S)
    blocks = re.split(r"</?(?:article|p|h[1-6]|ul|ol|li|div|blockquote|pre|section|table|tr|td)\b[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in blocks]
    return "\n\n".join(x for x in texts if x)


def disclosing(texts, contexts=3, conditional=0.5, bits=3.0, reach=100):
    """(entity, term) pairs beyond the thresholds, all counts in distinct texts; a text has one context for each entity.

    The least context by hash is not known here, so no text may hold an entity twice.
    """
    texts = sorted(set(texts))
    held, around = defaultdict(dict), {}
    terms = [{t.lower() for t in (re.sub(r"^[\W\d_]+|[\W\d_]+$", "", w) for w in words(x)) if re.search(r"[^\W\d_]{2}", t) and not re.search("[0-9@]", t)} for x in texts]
    for n, x in enumerate(texts):
        for kind, s, e in pii(x):
            assert n not in held[kind, x[s:e]]
            held[kind, x[s:e]][n] = (x[max(0, s - reach) : s], x[e : e + reach])
    out = set()
    for entity, rows in held.items():
        if len(set(rows.values())) < contexts:
            continue
        for term in set().union(*(terms[n] for n in rows)):
            both = [n for n in rows if term in terms[n]]
            n_term = sum(term in t for t in terms)
            if len({rows[n] for n in both}) >= contexts and len(both) >= conditional * n_term and math.log2(len(texts) * len(both) / (n_term * len(rows))) >= bits:
                out.add((":".join(entity), term))
    return out
