"""Operators against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import os
import random
import time

import brute
import pytest

from quern.llm import html_extract, mixing, packing, passages, pii, quality, suffix_dedup, url_filter
from quern.llm.components import connected_components
from quern.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from quern.llm.minhash import drop_near_duplicates, near_duplicates

#: Columns named like those that operators add or use inside.
EXTRA = "rate double, kept boolean, n_words long, key long, h long, row_no long, code int, id long, node long, size long"
BLANK = (None,) * 10
DOCS = f"doc_id long, text string, source string, {EXTRA}"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, *BLANK) for i, t, s in rows], DOCS).repartition(3)


def prose(draw, n, vocabulary=2000):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def tangled(seed=3, n=60):
    """id -> text with copies, near copies, chains of edits, shared passages and odd texts."""
    draw = random.Random(seed)
    shared = prose(draw, 70)
    docs = {0: "", 1: None, 2: "one two", 3: "One  two", 4: " \t\n\x0b\x0c\r", 5: "é \u00a0ü \u2003x y z", 6: "a" * 300, 7: "ab" * 200}
    chain = prose(draw, 120).split(" ")
    for i in range(10, 10 + n):
        kind = i % 6
        if kind == 0:
            docs[i] = prose(draw, draw.randint(5, 200))
        elif kind == 1:
            docs[i] = docs[draw.choice([k for k in docs if k >= 2])]
        elif kind == 2:
            w = brute.words(docs[draw.choice([k for k in docs if k >= 2])]) or ["x"]
            w[draw.randrange(len(w))] = "edit"
            docs[i] = "\n".join(w)
        elif kind == 3:
            docs[i] = prose(draw, draw.randint(0, 40)) + " " + shared + "  " + prose(draw, draw.randint(0, 40))
        elif kind == 4:
            chain = list(chain)
            for _ in range(2):
                chain[draw.randrange(len(chain))] = f"c{i}"
            docs[i] = " ".join(chain)
        else:
            half = prose(draw, 60)
            docs[i] = half + " " + prose(draw, 5) + " " + half
    docs[-5] = shared
    docs[900] = prose(draw, 3000, 40)
    return docs


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates(spark, seed):
    docs = tangled(seed)
    want = brute.near(docs)
    got = {r.doc_id: r for r in near_duplicates(spark, frame(spark, [(i, t, "s") for i, t in docs.items()])).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_many(spark):
    """A large group of near copies, none of which is the first's neighbour in every band."""
    draw = random.Random(1)
    base = prose(draw, 150).split(" ")
    docs = {}
    for i in range(300):
        w = list(base)
        for _ in range(draw.randint(0, 6)):
            w[draw.randrange(len(w))] = f"x{i}"
        docs[i] = " ".join(w)
    want = brute.near(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark, frame(spark, [(i, t, "s") for i, t in docs.items()])).collect()}
    assert got == want


def test_near_duplicates_odd_rows(spark):
    text = "a b c d e f g h"
    rows = [(5, text, "s"), (5, text, "s"), (None, text, "s"), (7, text.upper(), "t"), (8, "", "s")]
    got = sorted(near_duplicates(spark, frame(spark, rows)).collect(), key=str)
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [("5", 5, True), ("5", 5, True), ("7", 5, False), ("8", 8, True), ("None", None, True)]
    assert drop_near_duplicates(spark, frame(spark, rows)).count() == 4
    assert near_duplicates(spark, frame(spark, [])).count() == 0
    assert drop_near_duplicates(spark, frame(spark, [])).columns == frame(spark, []).columns


def test_near_duplicates_id_joins_groups(spark):
    """An id with two texts, one a copy of a smaller id's, one near a larger id's or a copy of it, makes one group."""
    draw = random.Random(12)
    a, b, c = (prose(draw, 100) for _ in range(3))
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (9, b + " more", "s"), (20, c, "s"), (30, a + " more", "s"), (30, c, "s"), (40, prose(draw, 100), "s")]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(spark, frame(spark, rows)).collect()}
    assert got == {3: (3, True), 5: (3, False), 9: (3, False), 20: (3, False), 30: (3, False), 40: (40, True)}


@pytest.mark.parametrize("window, period", [(50, None), (8, 3), (10, 7)])
def test_passages(spark, window, period):
    docs = tangled()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.repeated_passages(spark, frame(spark, [(i, t, "s") for i, t in docs.items()]), window=window, period=period).collect()}
    assert got == brute.passages(docs, window)


def test_passages_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "s"), (5, text, "s"), (None, text, "s"), (5, "other " + text, "s")]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, len(r.spans)) for r in passages.repeated_passages(spark, frame(spark, rows)).collect())
    assert got == [("5", 60, 0, 0), ("5", 60, 0, 0), ("5", 61, 0, 0), ("None", 60, 60, 1)]
    assert passages.repeated_passages(spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("cells", [suffix_dedup.GROUP_CELLS, 2])
def test_repeated_bytes(spark, cells):
    docs = tangled()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_bytes(spark, frame(spark, [(i, t, "s") for i, t in docs.items()]), group_cells=cells).collect()}
    assert got == brute.repeats(docs)


def test_repeated_bytes_odd_rows(spark):
    text = "".join(chr(97 + i % 23) for i in range(150))
    rows = [(5, text, "s"), (5, text, "s"), (None, text, "s"), (6, "", "s"), (7, "é" * 80, "s")]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.repeated_bytes(spark, frame(spark, rows)).collect())
    own = brute.repeats({5: text})[5][1]
    assert got == [("5", 150, own), ("5", 150, own), ("6", 0, 0), ("7", 160, brute.repeats({7: "é" * 80})[7][1]), ("None", 150, 150)]
    assert suffix_dedup.repeated_bytes(spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("data", [b"banana", b"", b"aaaa", bytes(random.Random(2).choices(b"ab", k=200))])
def test_suffix_order(data):
    order, common = suffix_dedup.suffix_order(data)
    assert order == sorted(range(len(data)), key=lambda i: data[i:])
    for a, b, n in zip(order, order[1:], common[1:]):
        assert data[a : a + n] == data[b : b + n] and data[a + n : a + n + 1] != data[b + n : b + n + 1]


def test_exact(spark):
    docs = list(tangled().items()) + [(12, "a  b"), (12, "a  b"), (11, "a b"), (None, "a\tb"), (None, None)]
    rows = exact_duplicates(spark, frame(spark, [(i, t, "s") for i, t in docs])).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.text_sha256, []).append(r)
    want = {}
    for i, t in docs:
        want.setdefault(brute.sha(brute.norm(t)), []).append(i)
    assert {k: sorted(map(str, [r.doc_id for r in v])) for k, v in groups.items()} == {k: sorted(map(str, v)) for k, v in want.items()}
    for k, v in groups.items():
        ids = [i for i in want[k] if i is not None]
        assert all(r.keep_id == (min(ids) if ids else None) and r.group_size == len(v) for r in v)
        assert [r.doc_id for r in v if r.kept] == [min(ids) if ids else None]
    kept = drop_exact_duplicates(spark, frame(spark, [(i, t, "s") for i, t in docs]))
    assert kept.columns == frame(spark, []).columns
    assert sorted(brute.sha(brute.norm(r.text)) for r in kept.collect()) == sorted(want)
    # a filter that lets every row into the join gives the same rows
    everything = drop_exact_duplicates(spark, frame(spark, [(i, t, "s") for i, t in docs]), filter_bits=1)
    assert sorted(map(str, everything.collect())) == sorted(map(str, kept.collect()))
    assert exact_duplicates(spark, frame(spark, [])).count() == 0 and drop_exact_duplicates(spark, frame(spark, [])).count() == 0


def test_quality_counts_and_verdicts(spark):
    draw = random.Random(5)
    docs = dict(tangled())
    for i in range(1000, 1200):
        docs[i] = ". ".join(prose(draw, 12).capitalize() for _ in range(10)).replace("w", "the")
    for i in range(1200, 1230):
        docs[i] = " ".join(f"{w}###" for w in prose(draw, 120).split())
    docs[1300] = "a b\na b\n \na b \r\n" * 3
    rows = {r.doc_id: r for r in quality.score(spark, frame(spark, [(i, t, "s") for i, t in docs.items()]).select("doc_id", "text"), "doc_id").collect()}
    for i, t in docs.items():
        r, want = rows[i], brute.quality_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert all(rows[i].kept for i in range(1000, 1200)) and not any(rows[i].kept for i in range(1200, 1230))
    kept = quality.keep_good(spark, frame(spark, [(i, t, "s") for i, t in docs.items()]))
    assert kept.columns == frame(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in rows.items() if r.kept)
    clashing = quality.score(spark, frame(spark, [(i, t, "s") for i, t in docs.items()]), "doc_id", "kept", "code", "source").collect()
    assert {r.doc_id: (r.kept, r.code, r.source) for r in clashing} == {i: (r.kept, r.code, "s") for i, r in rows.items()}
    assert quality.score(spark, frame(spark, []).select("doc_id", "text"), "doc_id").count() == 0
    assert quality.keep_good(spark, frame(spark, [])).count() == 0


def test_quality_em_against_plain_loop(spark):
    import math

    counts = {(-1, 0, 1): 40.0, (0, 0, 1): 300.0, (-1, -1, 0): 60.0, (1, -1, 1): 20.0, (0, 0, 0): 5.0}
    code = lambda v: sum((x + 1) * 3**k for k, x in enumerate(v))
    df = spark.createDataFrame([(code(v), n) for v, n in counts.items()], "code int, n double")
    got = {r.code: r.quality for r in quality.pattern_quality(df, 3).collect()}
    acc, total = [0.9] * 3, sum(counts.values())
    post = lambda v: 1 / (1 + math.exp(-sum(x * math.log(a / (1 - a)) for x, a in zip(v, acc))))
    for _ in range(quality.ITERATIONS):
        g = {v: post(v) for v in counts}
        acc = [
            max(0.05, min(0.995, (0.02 * total * 0.9 + sum(n * (g[v] if v[k] == 1 else 1 - g[v]) for v, n in counts.items() if v[k])) / (0.02 * total + sum(n for v, n in counts.items() if v[k]))))
            for k in range(3)
        ]
    for v in counts:
        assert abs(got[code(v)] - post(v)) < 1e-9


ODD_PII = [
    "x@y.com_z@w.org a@b.c@d.e ..@a.b a@b @c.d e+f%g-h.i_j@k-l.m-n.o",
    "1.2.3.4.5 300.1.1.1 001.002.003.004 1.2.3 9.9.9.9999 0000000255.0.0.0 255.255.255.255",
    "4539 1488 0343 6467 4539148803436467 4539-1488-0343-6467 4539148803436468 49927398716 0000 0000 0000 0000",
    "+1 (017) 555-7713 +49 30 123456 +1 +12 +1234567 +12345678 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 ++12345678",
    "é a@b.co ü 1.1.1.1 \U0001f600 +1 234 567 890",
    "",
    None,
    "a" * 20000 + "@" + "b" * 20000,
    "1 " * 3000 + "4539148803436467",
    "12 34 " * 400,
]


def test_pii_base(spark):
    rows = [(i, t, "s") for i, t in enumerate(ODD_PII)] + [(None, "a@b.c", "s"), (0, ODD_PII[0], "s")]
    for r in pii.find_pii(spark, frame(spark, rows)).collect():
        text = "a@b.c" if r.doc_id is None else ODD_PII[r.doc_id]
        assert [(x.kind, x.s, x.e) for x in r.base] == brute.pii(text), text and text[:60]
        assert all((text or "")[x.s : x.e] == x.v for x in r.base)
    assert pii.find_pii(spark, frame(spark, [])).count() == 0


def test_pii_terms_and_redaction(spark):
    draw = random.Random(6)
    rows = [(i, f"{prose(draw, 9)} Quixwort said mail bob@site.org now {prose(draw, 9)}", "s") for i in range(6)]
    rows += [(100 + i, f"{prose(draw, 20)} said mail now", "s") for i in range(60)]
    found = {r.doc_id: r for r in pii.find_pii(spark, frame(spark, rows)).collect()}
    for i in range(6):
        assert [x.v for x in found[i].added] == ["quixwort"]
        x = found[i].added[0]
        assert rows[i][1][x.s : x.e] == "Quixwort"
    assert not any(found[100 + i].added for i in range(60))
    df = spark.createDataFrame([("é a@b.c, 1.1.1.1 x",)], "text string").select("text", pii.base_spans(pii.F.col("text")).alias("spans"))
    assert df.select(pii.redacted(pii.F.col("text"), pii.F.col("spans")).alias("x")).first().x == "é <email>, <ip> x"


def test_pii_terms_among_copies(spark):
    """Copies sink no disclosing term and make none; a term far from the entity counts; both sides are in distinct texts."""
    draw = random.Random(7)
    telling = [f"Quixwort, quixwort {prose(draw, 9)} said {prose(draw, 60)} mail bob@site.org now {prose(draw, 30)}" for _ in range(3)]
    copied = f"Zanthic said {prose(draw, 30)} mail ann@site.org now {prose(draw, 30)}"
    passage = f"{prose(draw, 30)} mail eve@site.org now {prose(draw, 30)}"
    texts = telling + telling[:1] * 200 + [copied] * 200 + [f"{''.join(draw.choices('ghjk', k=9))} morvane {passage}" for _ in range(5)]
    texts += [f"{prose(draw, 20)} said mail now" for _ in range(60)]
    # in 3 of 7 distinct texts with the entity, whatever the copies of one of the 3 say
    half = [f"halfling {prose(draw, 40)} pat@site.org {prose(draw, 40)}" for _ in range(3)]
    texts += half + half[:1] * 50 + [f"halfling {prose(draw, 20)}" for _ in range(4)]
    found = {r.doc_id: r for r in pii.find_pii(spark, frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        want = ["quixwort", "quixwort"] if text.startswith("Quixwort") else []
        assert [x.v for x in found[i].added] == want, text[:60]
        assert all(text[x.s : x.e].lower().strip(",") == x.v for x in found[i].added)


def _filled(sizes, share, cap, weights):
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    left, target, capped = share * sum(sizes.values()), {}, set()
    while True:
        free = [k for k in keys if k not in capped]
        level = (left - sum(cap * sizes[k] for k in capped)) / sum(w[k] for k in free) if free else 0
        over = [k for k in free if w[k] * level > cap * sizes[k]]
        if not over:
            return {k: cap * sizes[k] if k in capped else w[k] * level for k in keys}
        capped |= set(over)


def test_mixing(spark):
    draw = random.Random(8)
    sources = [None, "b", "a", "c", "d", "é", "tiny"]
    rows = [(i, prose(draw, draw.randint(0, 30)), draw.choice(sources[:6] + ["a"] * 4)) for i in range(1500)]
    rows += [(5000, "one two", "tiny"), (5001, None, "empty"), (None, "x y", "a"), (3, "x y z", "a")]
    got = mixing.mixing_plan(spark, frame(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = _filled(sizes, 1.5, 2.0, (3, 1, 2))
    assert len(got) == len(rows)
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    by_size = {}
    for r in got:
        assert r.taken <= 2 * r.size and r.taken == r.size * r.copies
        by_size.setdefault((r.source_size, round(r.target, 6)), []).append(r)
    for s, n in sizes.items():
        assert (n, round(want[s], 6)) in by_size
        taken = sum(r.taken for r in by_size[n, round(want[s], 6)])
        assert n < 500 or abs(taken - want[s]) < 0.01 * want[s]
    copies = {}
    for r in got:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    mixed = mixing.mix_documents(spark, frame(spark, rows))
    assert mixed.columns == frame(spark, []).columns
    found = {}
    for r in mixed.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {i: n for i, n in copies.items() if n}
    assert mixing.mixing_plan(spark, frame(spark, [])).count() == 0 and mixing.mix_documents(spark, frame(spark, [])).count() == 0


def _plain_best_fit(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["left"], n) for n, b in enumerate(bins) if b["left"] >= size and b["left"] >= 0 and not b["shut"] and source not in b["s"] and (cluster < 0 or cluster not in b["c"])]
        if fits:
            _, n = min(fits)
        else:
            n = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set(), "shut": False})
        b = bins[n]
        b["left"] -= size
        b["s"].add(source)
        b["c"].add(cluster)
        b["shut"] = b["left"] == 0 and size > 0
        out.append(n)
    return out


def test_best_fit_against_plain_search():
    draw = random.Random(9)
    for _ in range(20):
        items = sorted(((draw.choice([0, 1, 5, 50, 99, 100, draw.randint(1, 100)]), draw.randrange(4), draw.choice([-1, -1, 0, 1])) for _ in range(80)), key=lambda x: -x[0])
        assert packing.best_fit(*map(list, zip(*items)), 100) == _plain_best_fit(items, 100)


def test_packing(spark):
    docs = tangled()
    rows = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in docs.items()] + [(12, "a b", "s0"), (12, "a b", "s0"), (None, "c", None)]
    for blocks in (8192, 20):
        got = packing.pack_documents(spark, frame(spark, rows), capacity=100, block_pieces=blocks).collect()
        assert sum(r.n_words for r in got) == sum(len(brute.words(t)) for _, t, _ in rows)
        bins = {}
        for r in got:
            bins.setdefault(r.bin_id, []).append(r)
        for held in bins.values():
            assert sum(r.n_words for r in held) == held[0].bin_words <= 100
            assert len({r.source for r in held}) == len(held)
            clusters = [r.cluster for r in held if r.cluster is not None]
            assert len(set(clusters)) == len(clusters)
        pieces = {}
        for r in got:
            pieces.setdefault(r.doc_id, []).append((r.piece, r.first_word, r.n_words))
        assert sorted(pieces[900]) == [(p, 100 * p, 100) for p in range(30)]
    assert packing.pack_documents(spark, frame(spark, [])).count() == 0


def test_packing_fills_bins_whatever_the_blocks(spark):
    draw = random.Random(18)
    rows = [(i, prose(draw, draw.randint(1, 90)), f"s{draw.randrange(30)}") for i in range(1500)]
    used = {}
    for blocks in (100_000, 150):
        got = packing.pack_documents(spark, frame(spark, rows), capacity=100, block_pieces=blocks).collect()
        assert sorted(r.doc_id for r in got) == list(range(1500))
        fill = {}
        for r in got:
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_words
        assert all(fill[r.bin_id] == r.bin_words <= 100 for r in got)
        used[blocks] = len(fill)
    assert used[150] <= 1.03 * used[100_000]  # blocks of some seventy bins


def test_packing_by_given_clusters(spark):
    """Near copies of different sources share no bin if their cluster is given."""
    draw = random.Random(10)
    base = prose(draw, 20).split(" ")
    rows = [(i, " ".join(base[:-1] + [f"edit{i}"]), f"s{i}") for i in range(4)] + [(i, prose(draw, 20), f"s{i}") for i in range(4, 8)] + [(8, "", "s8")]
    docs = frame(spark, rows)
    found = near_duplicates(spark, docs, shingle=2).select("doc_id", "component_id")
    got = packing.pack_documents(spark, docs.join(found, "doc_id"), capacity=100, cluster_col="component_id").collect()
    assert {r.doc_id: r.cluster for r in got} == {**dict.fromkeys(range(4), 0), 4: 4, 5: 5, 6: 6, 7: 7, 8: None}
    assert len({r.bin_id for r in got if r.doc_id < 4}) == 4
    assert len({r.bin_id for r in packing.pack_documents(spark, docs, capacity=100).collect() if r.doc_id < 8}) == 2


URLS = [
    ("https://A.Example.COM/en/742?x", "a.example.com", "/en/742", "example.com/en/7", "allow"),
    ("http://x.com/en/8", "x.com", "/en/8", "com/en/", "block"),
    ("http://x.com/en", "x.com", "/en", None, "allow"),
    ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("http://b.net/de/80", "b.net", "/de/80", "net/de/", "block"),
    ("http://example.net/de/80#f", "example.net", "/de/80", "example.net/de/8", "block"),
    ("org/es/", "", "", None, "allow"),
    ("x://org?/es/", "org", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://org/es/", "b:", "//org/es/", None, "allow"),
    ("http://.org/es/\u00c9", ".org", "/es/\u00c9", "org/es/", "block"),
]


@pytest.mark.parametrize("block, at_once", [(url_filter.RULES_PER_BLOCK, url_filter.BLOCKS_AT_ONCE), (2, 8), (1, 2)])
def test_urls(spark, block, at_once):
    df = spark.createDataFrame([(i, u[0], "r", 1) for i, u in enumerate(URLS)] + [(0, URLS[0][0], None, 2)], "page_id long, url string, rule string, best int")
    got = url_filter.filter_urls(spark, df, url_filter.PRODUCTION_RULES, rules_per_block=block, blocks_at_once=at_once).collect()
    assert all(r.best in (1, 2) for r in got)
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.url, r.host, r.path, r.rule, r.verdict) == URLS[r.page_id]
    assert url_filter.filter_urls(spark, df.limit(0), url_filter.PRODUCTION_RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(spark, df, []).collect()} == {"allow"}


def test_url_query_has_the_rules_of_its_contract(spark, tmp_path):
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    spark.createDataFrame([(i, f"http://{rule}1") for i, rule in enumerate(contract)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.rule: r.verdict for r in url_filter.op1_url_filter(spark, str(tmp_path)).collect()} == contract


def test_urls_against_plain_rules():
    draw = random.Random(4)
    rules = [(".".join(draw.choices(["a", "b", "com"], k=draw.randint(1, 3))), draw.choice(["", "/", "/x", "/x/", "/x/y", "/xy"]), draw.choice(["allow", "block"])) for _ in range(40)]
    trie = url_filter.build_trie(rules)
    for _ in range(400):
        host, path = ".".join(draw.choices(["a", "b", "com"], k=draw.randint(1, 4))), draw.choice(["", "/", "/x", "/x/y", "/x/yz/", "/xyz", "/y"])
        fit = [(h.count(".") + 1, len(p), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        hit = url_filter.longest_match(trie, host, path)
        assert (hit and (hit[2], hit[3], hit[1] == "block", hit[0])) == (max(fit) if fit else None)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side text that is rather long, really quite long for a side bar.</p></div>
%s<form><label>Name</label><input></form><section class="comments"><h2>Comments</h2><p>First! A very long reader comment about nothing in particular at all.</p></section>
<footer>&copy; me</footer></body></html>"""
BODY = "<h1>Head &amp; line</h1><p>Some <b>bold</b>\n text&nbsp;here &#233;&eacute;.<p>Short.<ul><li>item one</li></ul><div class=ad>Buy now</div><p>Last&lt;tag&gt; paragraph of it.</p>"
WANT = "Head & line\n\nSome bold text here éé.\n\nShort.\n\nitem one\n\nLast<tag> paragraph of it."


@pytest.mark.parametrize("shell", ["<article>%s</article>", "<main><div>%s</div></main>", "<div class=content>%s</div>"])
def test_html(shell):
    assert html_extract.main_text(PAGE % (shell % BODY)) == WANT


@pytest.mark.parametrize(
    "shell",
    [
        "<div class='content has-sidebar'>%s<div class='sidebar'><p>Side</p></div></div>",
        "<div class='site no-sidebar'><div class='post social-ready'>%s</div></div>",
        "<form action=/page.aspx>%s<div class='cookie-notice'>We use cookies</div></form>",
        "<div class=widget>%s<div class='comment-list'><p>A remark.</p></div></div>",
        "<div class=content-sidebar-wrap>%s<div class='share-buttons'>Share</div></div>",
        "<div class=x>%s</div><form><label>Name</label><input></form>",
        "<article>%s<article class=teaser><p>Read on</p></article></article>",
    ],
)
def test_html_wrapper_named_like_boilerplate(shell):
    lines = [f"Line {i} of the article, which goes on for a while, as prose does." for i in range(6)]
    body = "".join(f"<p class='ad-free'>{x}</p>" for x in lines)
    assert html_extract.main_text(f"<html><body><nav><a>Home</a></nav>{shell % body}<footer>me</footer></body></html>") == "\n\n".join(lines)


@pytest.mark.parametrize(
    "inner, want",
    [
        ("<p>one <button>Share</button></p><script>var a=1</script><p>two</p>", ["one", "two"]),
        ("<p>one</p><style>p{color:red}</style>and<noscript><img src=x>Turn it on</noscript> more<p>two</p>", ["one", "and more", "two"]),
        ("<p>one <select><option>A<option>B</select>or <textarea>t</textarea>two</p>three", ["one or two", "three"]),
        ("<p>one <svg/>and <svg><path/><title>t</title></svg>two <button><div>Share</div></button>three</p><iframe src=x /><p>four", ["one and two three", "four"]),
        ("<div>one <button><div>Share</div></div><p>two <video>no video</p>", ["one", "two"]),
        (f"<p>one</p><script>{'x = 1; ' * 500}</script><p>two", ["one", "two"]),
    ],
)
@pytest.mark.parametrize("shell", ["<article>%s</article>", "<div class=content>%s</div>"])
def test_html_unread(shell, inner, want):
    assert html_extract.main_text(f"<html><body>{shell % inner}</body></html>") == "\n\n".join(want)


def test_html_short_article_with_long_comments():
    comments = "".join(f"<p>Reader {i} says that all of this is wrong and writes at length about why.</p>" for i in range(40))
    page = f"<body><div class=post><p>The article is only this one line, though as long as the others.</p></div><div class=comments>{comments}</div></body>"
    assert html_extract.main_text(page).startswith("The article is only") and "Reader" not in html_extract.main_text(page)


def test_html_odd(spark):
    pages = [(1, None), (2, ""), (3, "plain text"), (4, "<![bad[ x <p>one<p>two"), (5, "<p>a<br>b</p>" * 3), (6, "<article><p>" + "x " * 50000), (1, None)]
    df = spark.createDataFrame([(i, h, "old") for i, h in pages], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract_text(df).collect()}
    assert got[1] == got[2] == "" and got[3] == "plain text" and "two" in got[4]
    assert got[5] == "\n\n".join(["a b"] * 3) and got[6] == ("x " * 50000).strip()
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a is not None for x in (a, b)}
    assert got == brute.components(nodes, [x for x in links if x[0] is not None])
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("shape, most", [("ascending", 12), ("shuffled", 12), ("star", 3)])
def test_components_take_few_rounds(spark, shape, most):
    """Chains of 1000 nodes, whose links would take 999 rounds one by one, and a star around its largest node."""
    draw = random.Random(15)
    names = list(range(1000))
    if shape == "shuffled":
        draw.shuffle(names)
    links = [(999, i) for i in range(999)] if shape == "star" else list(zip(names, names[1:]))
    rounds = []
    got = connected_components(spark, spark.createDataFrame(links, "a long, b long").coalesce(2), rounds).collect()
    assert {r.node for r in got} == set(range(1000)) and {r.component for r in got} == {0}
    assert len(rounds) <= most, rounds


def test_mixing_numbers_many_sources(spark):
    """Turns follow the order of sources over all partitions of the sort; capped sources cascade."""
    draw = random.Random(16)
    names = [None] + sorted({f"{draw.randrange(10**6):x}" for _ in range(300)})
    rows = [(n, draw.choice([0, 1, 5, 40, 1000])) for n in names for _ in range(3)]
    sizes = {n: sum(k for m, k in rows if m == n) for n in names}
    got = mixing.source_targets(spark, spark.createDataFrame(rows, "source string, size long").repartition(7)).collect()
    want = _filled(sizes, 1.5, 2.0, (3, 1, 2))
    assert {r.source: r.source_size for r in got} == sizes
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in got)


def test_near_duplicates_of_a_template(spark):
    """Texts of one template whose pairs lie on both sides of the threshold: few of the pairs are compared, no link is lost."""
    draw = random.Random(17)
    base = [f"w{draw.randrange(10**6)}" for _ in range(604)]
    docs = {}
    for i in range(300):
        w = list(base)
        for at in draw.sample(range(604), draw.randint(5, 15)):
            w[at] = f"x{i}_{at}"
        docs[i] = " ".join(w)
    seen = {}
    got = near_duplicates(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string"), seen=seen).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(docs)
    assert seen["met"] + seen["rest"] < 0.4 * 300 * 299 / 2, seen


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_html_pages_against_plain_substitutions(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = html_extract.extract_text(pages, out_col="found").select("html", "found").collect()
    assert len(got) > 10 and all(r.found == brute.article(r.html) for r in got)


@pytest.mark.parametrize(
    "shell",
    [
        "<div id='content-sidebar-wrap'>%s</div>",
        "<div class='content no-sidebar'>%s</div>",
        "<div class='post has-related'>%s</div>",
        "<div class='social-science'>%s</div>",
        "<div class='layout-notice-free'>%s</div>",
        "<form id='aspnetForm'>%s</form>",
    ],
)
def test_html_clusters_find_the_article(shell, monkeypatch):
    """No article, main or nav tag names anything: menus and the other column are told by their ratios alone."""
    lines = [f"Line {i} of the article, which goes on for a while, as prose does." for i in range(6)]
    menu = "<div>" + "".join(f"<div><a href=/{w}><i>{w}</i></a></div>" for w in ("Home", "News", "Shop", "Maps", "Help")) + "</div>"
    links = "".join(f"<p><a href=/{i}><b>See {i}</b></a></p>" for i in range(4))
    body = "".join(f"<p>{x}</p>" for x in lines[:3]) + links + "".join(f"<p>{x}</p>" for x in lines[3:])
    page = f"<html><body>{menu}{shell % body}<div><p>(c) <a>me</a></p></div></body></html>"
    assert html_extract.main_text(page) == "\n\n".join(lines)
    monkeypatch.setattr(html_extract, "cluster_threshold", lambda values: -1.0)
    assert "Home" in html_extract.main_text(page) or "See 1" in html_extract.main_text(page)


def test_html_several_articles():
    a, b = "<p>The first story, told at some length, as stories are.</p>" * 4, "<p>The second story, which is as long as the first one is.</p>" * 4
    got = html_extract.main_text(f"<body><nav>x</nav><article>{a}</article><div class=ad>Buy</div><article>{b}</article><article><p>Next: more</p></article></body>")
    assert got.count("first story") == 4 and got.count("second story") == 4 and "Buy" not in got and "Next" not in got


@pytest.mark.parametrize("piece", ["<div>line", "<font>t", "<p><font>t", "<div class=sidebar>line", "<b>x</i>"])
def test_html_nesting_takes_linear_time(piece):
    began = time.process_time()
    html_extract.main_text("".join(f"{piece} {i} " for i in range(20000)))
    assert time.process_time() - began < 3


def test_pii_terms_against_plain_counts(spark):
    """Added spans of a random corpus, copies included, are those of plain counts; texts are sanitised at all spans."""
    draw = random.Random(19)
    people = [(f"{n}@site.org", n.capitalize() + "sson", draw.randint(2, 6)) for n in ("ada", "bob", "cyd", "dan", "eve", "fay")]
    word = lambda: "".join(draw.choices("ghjkmn", k=4))
    texts = []
    for mail, name, n in people:
        for k in range(n):
            before, after = " ".join(word() for _ in range(30)), " ".join(word() for _ in range(30))
            texts.append(f"{before} {name if k or draw.random() < 0.5 else 'nobody'}, wrote {mail} today {after}")
        texts += [f"{' '.join(word() for _ in range(20))} {name} {word()}" for _ in range(draw.randint(0, 4))]
    texts += [f"{' '.join(word() for _ in range(20))} wrote today" for _ in range(60)]
    texts += texts[:4] * 3
    want = brute.disclosing(texts)
    assert {t for _, t in want} & {n.lower() for _, n, _ in people}
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(900, None, "s"), (901, "", "s")]
    for r in pii.find_pii(spark, frame(spark, rows)).collect():
        text = rows[[i for i, _, _ in rows].index(r.doc_id)][1] or ""
        terms = {t for e, t in want if e in {f"{k}:{text[s:x]}" for k, s, x in brute.pii(text)}}
        assert sorted(x.v for x in r.added) == sorted(t for t in (w.lower().strip(",") for w in brute.words(text)) if t in terms)
    clean = {r.doc_id: r for r in pii.sanitise(spark, frame(spark, rows)).collect()}
    assert clean[900].text is None and clean[901].text == "" and len(clean) == len(rows)
    for i, text, _ in rows[: len(texts)]:
        assert "@" not in clean[i].text and ("<email>" in clean[i].text) == ("@" in text)
        assert clean[i].source == "s"
    assert any("<term>" in clean[i].text for i in range(len(texts)))
    assert pii.sanitise(spark, frame(spark, [])).columns == frame(spark, []).columns


def test_suffix_sort_proves_its_order(monkeypatch):
    """With hashes that see nothing of a byte but its lowest bit, collisions are found on the bytes and results stay right."""
    import numpy as np

    draw = random.Random(20)
    base = bytes(draw.choices(b"abcd", k=300))
    cells = []
    for n in range(60):
        at = draw.randrange(150)
        data = bytearray(base[at : at + draw.randint(12, 60)])
        if n % 3 == 0:
            data[draw.randrange(len(data))] = 120
        cells.append((draw.randrange(20), 0, n, n % 7, bytes(data)))
    columns = [np.array([c[k] for c in cells], np.int64) for k in range(4)]

    def found():
        got = suffix_dedup._repeats(*columns, [c[4] for c in cells], 10)
        assert len(got) == len(set(got))
        return set(got)

    seen, want = set(), set()
    for n in sorted(range(60), key=lambda n: cells[n][:3]):
        for at in range(len(cells[n][4]) - 9):
            w = (cells[n][3], cells[n][4][at : at + 10])
            if w in seen:
                want.add((n, at))
            seen.add(w)
    assert found() == want and len(want) > 50
    monkeypatch.setattr(suffix_dedup, "_BYTES", suffix_dedup._BYTES[np.arange(256) & 1])
    assert found() == want
    data = bytes(draw.choices(b"abcd", k=200))
    assert suffix_dedup.suffix_order(data)[0] == sorted(range(200), key=lambda i: data[i:])


def test_repeated_bytes_of_long_texts(spark, monkeypatch):
    """Segments of a long text meet without a seam."""
    draw = random.Random(21)
    data = "".join(draw.choices("abc ", k=3000))
    data = data + data[500:1500] + "".join(draw.choices("abc ", k=700)) + data[100:400]
    whole = [x.tolist() for x in suffix_dedup.cells_of(data.encode())]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    split = [x.tolist() for x in suffix_dedup.cells_of(data.encode())]
    anchors = lambda cells: [(g, n) for g, f, l in zip(*cells) for n in range(f, l + 1)]  # noqa: E741, E731
    assert anchors(split) == anchors(whole)
