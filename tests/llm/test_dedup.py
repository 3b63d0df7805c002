"""Substring dedup, line dedup, near duplicates and components against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardlake.llm import line_dedup, near_dup, substring_dedup
from hazardlake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def removed(rows, width):
    """(doc_id, kept text, words, removed) by looking at every window."""
    words = [(i, WORD.findall(t)) for i, t in rows]
    first = {}
    for i, ws in words:
        for k in range(len(ws) - width + 1):
            if i is not None:
                w = tuple(ws[k:k + width])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - width + 1):
            if i is not None and first[tuple(ws[k:k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, " ".join(w for k, w in enumerate(ws) if k not in gone), len(ws), len(gone)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, x if x is not None else 0) for x in r])


def test_substrings_of_odd_rows(odd_docs):
    got = substring_dedup.remove_substrings(odd_docs)
    assert set(got.columns) == {*odd_docs.columns, "n_removed", "factors"}
    rows = got.collect()
    assert order((r.doc_id, r.text, r.n_words, r.n_removed) for r in rows) == order(removed(plain(odd_docs), 13))
    assert {(r.lang, r.anchor, r.ids) for r in rows} == {("en", "q", None), (None, "q", None)}
    texts = dict(plain(odd_docs))
    for r in rows:
        for f in r.factors:
            own, ref = WORD.findall(texts[r.doc_id]), WORD.findall(texts[f.ref_doc])
            assert f.ref_doc < r.doc_id and f.length >= 13
            assert own[f.start:f.start + f.length] == ref[f.ref_start:f.ref_start + f.length]


@pytest.mark.parametrize("width, gram", [(13, 5), (6, 2)])
def test_substrings_of_random_texts(spark, width, gram):
    rnd = random.Random(width)
    parts = [[rnd.choice("abcdef") for _ in range(rnd.randint(3, 30))] for _ in range(12)]
    rows = [(k, " ".join(w for p in rnd.choices(parts, k=rnd.randint(0, 6)) for w in p)) for k in rnd.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [(r.doc_id, r.text, r.n_words, r.n_removed) for r in substring_dedup.remove_substrings(df, width, gram).collect()]
    assert order(got) == order(removed(rows, width))


def test_many_segments_of_one_anchor(spark):
    """Different contexts of one phrase are no copies, however many they are."""
    rng = np.random.default_rng(4)
    grams = [" ".join(f"c{x}" for x in g) for g in rng.integers(0, 10**6, (100_000, 5)).tolist()]
    words = substring_dedup.Words([g.encode() for g in grams])
    phrase = grams[int(np.argmin(words.grams(5, 1)[::5]))]
    near = rng.integers(0, 1 << 40, (300_000, 8)).tolist()
    rows = [(i, " ".join([*(f"{x:x}" for x in n[:4]), phrase, *(f"{x:x}" for x in n[4:])])) for i, n in enumerate(near)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = substring_dedup.remove_substrings(df).agg(F.count("*"), F.sum("n_words"), F.sum("n_removed")).first()
    assert tuple(out) == (300_000, 13 * 300_000, 0)


def test_blocks_in_small_batches():
    """An anchor's segments may be spread over any number of batches."""
    import pyarrow as pa
    rnd = random.Random(1)
    rows = sorted((rnd.randint(0, 6), rnd.randint(0, 2), rnd.randint(0, 5), 16 * rnd.randint(0, 3) + 1) for _ in range(200))
    want = []
    for a in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == a]
        for s in {r[1] for r in own}:
            seg = [r for r in own if r[1] == s]
            for r in seg:
                if r[2] > seg[0][2]:
                    want.append((r[2], r[3], seg[0][2], seg[0][3]))
                elif len({r[1] for r in own}) > 1:
                    want.append((r[2], r[3], None, None))
    for size in (1, 3, 50, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(*r[:3], 0, r[3]) for r in rows[i:i + size]]), substring_dedup._KEYED_ARROW)],
                                              schema=substring_dedup._KEYED_ARROW) for i in range(0, 200, size)]
        got = [tuple(v for k, v in r.items() if k != "version") for b in substring_dedup._resolve(batches) for r in b.to_pylist()]
        assert order(got) == order(want)


def test_substrings_of_rows_that_share_an_id(spark):
    """Each text of a repeated doc_id loses what is found in it, at its own places; columns of any name pass through."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (2, f"{b} {a}"), (2, None), (3, f"{c} {b}"), (3, c), (3, c), (None, a), (4, f"x {c}"), (4, f"x {c}")]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id int, text string, _spans int, _version int").repartition(4)
    got = substring_dedup.remove_substrings(df).collect()
    assert order((r.doc_id, r.text, r.n_words, r.n_removed) for r in got) == order(removed([(i, t or "") for i, t in rows], 13))
    assert {(r._spans, r._version) for r in got} == {(7, 8)}


def test_substrings_of_nothing(no_docs):
    assert substring_dedup.remove_substrings(no_docs).count() == 0


def test_lines_of_odd_rows(spark, odd_docs):
    blank = " \t\n\x0b\f\r"
    rows = list(dict.fromkeys(plain(odd_docs)))
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(blank))
    docs_of = defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            if i is not None and len(key(x)) >= 20:
                docs_of[key(x)].add(i)
    want = {}
    for i, t in rows:
        keep = [x for x in t.split("\n") if i is None or len(docs_of[key(x)]) < 3 or i == max(docs_of[key(x)])]
        want[i, len(t.split("\n")), len(t.split("\n")) - len(keep)] = "\n".join(keep)
    got = line_dedup.dedup_lines(odd_docs)
    assert set(got.columns) == {*odd_docs.columns, "n_lines", "n_dropped"}
    found = got.collect()
    assert len(found) == odd_docs.count()
    assert {(r.doc_id, r.n_lines, r.n_dropped): r.text for r in found if r.doc_id is not None} == {k: v for k, v in want.items() if k[0] is not None}
    assert Counter(r.text for r in found if r.doc_id is None) == Counter(t or "" for i, t in plain(odd_docs) if i is None)


def test_lines_of_nothing(no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_lines_against_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = {r[0]: r[1:] for r in con.execute(line_dedup.ORACLE).fetchall()}
    got = line_dedup.dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want


def classes(rows, k=5, threshold=0.8):
    sets = {}
    for i, t in rows:
        ws = WORD.findall(t)
        sets.setdefault(i, set()).add(frozenset(tuple(ws[j:j + k]) for j in range(max(1, len(ws) - k + 1))) if ws else frozenset())
    every = {s for v in sets.values() for s in v}
    rep = {s: min(i for i, v in sets.items() if s in v) for s in every}
    top = {r: r for r in rep.values()}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = Counter()
    for s in every:
        for t in every:
            if rep[s] < rep[t] and s and t and len(s & t) / len(s | t) >= threshold:
                links[rep[s]] += 1
                links[rep[t]] += 1
                a, b = find(rep[s]), find(rep[t])
                top[max(a, b)] = min(a, b)
    return {(i, rep[s], find(rep[s]), links[rep[s]]) for i, v in sets.items() for s in v}


def test_near_copies_of_odd_rows(odd_docs):
    rows = [r for r in plain(odd_docs) if r[0] is not None]
    got = near_dup.jaccard_classes(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {tuple(r) for r in got if r.doc_id is not None} == classes(rows)
    assert {tuple(r) for r in got if r.doc_id is None} == {(None, None, None, 0)}


@pytest.mark.parametrize("block", [3, 1000])
def test_near_copies_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", block)
    rnd = random.Random(3)
    rows = []
    for g in range(4):
        base = [f"g{g}w{rnd.randint(0, 900)}" for _ in range(150)]
        for k in range(25):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(150)] = f"e{rnd.randint(0, 9)}"
            rows.append((g * 100 + k, " ".join(own)))
    rnd.shuffle(rows)
    got = near_dup.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = classes(rows)
    assert sum(r[3] for r in want) > 500
    assert {tuple(r) for r in got} == want


def test_near_copies_of_nothing(no_docs):
    assert near_dup.jaccard_classes(no_docs).count() == 0


def test_prefix_length_meets_the_recall():
    n = near_dup.prefix_length(0.8, 0.9995, 16, 8)
    assert 1 - (1 - 0.8 ** n) ** 16 >= 0.9995 > 1 - (1 - 0.8 ** (n + 1)) ** 16


def test_least_agreement_meets_the_recall():
    m = near_dup.least_agreement(0.8, 0.9995, 160)
    tail = lambda m: sum(math.comb(160, c) * 0.8 ** c * 0.2 ** (160 - c) for c in range(m, 161))
    assert tail(m) >= 0.9995 > tail(m + 1)


def _signed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return near_dup.signatures(df, 5, near_dup.TREES, near_dup.LABEL).withColumnRenamed("doc_id", "rep")


def test_texts_of_a_template_do_not_chain(spark):
    """600 texts with two thirds of their words in common, no pair of similarity 0.8: hardly a link."""
    rnd = random.Random(8)
    base = [f"t{k}" for k in range(120)]
    texts = [" ".join([*base, *(f"w{rnd.randint(0, 10 ** 6)}" for _ in range(56))]) for _ in range(600)]
    assert near_dup.candidate_links(_signed(spark, texts)).count() < 5


@pytest.mark.parametrize("block", [7, 1000])
def test_forest_finds_pairs_at_the_threshold(spark, monkeypatch, block):
    """400 pairs of similarity 0.8 to 0.85, each of its own words: nearly all are linked, nothing else is."""
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", block)
    rnd, texts, true = random.Random(9), [], set()
    while len(true) < 400:
        words = [f"p{len(texts)}x{k}" for k in range(200)]
        other = [*words[:-(n := rnd.randint(16, 22))], *(f"q{len(texts)}x{k}" for k in range(n))]
        both, n = 200 - n - 4, 196
        if 0.8 <= both / (2 * n - both) <= 0.85:
            true.add((len(texts), len(texts) + 1))
            texts += [" ".join(words), " ".join(other)]
    found = {(min(r), max(r)) for r in near_dup.candidate_links(_signed(spark, texts)).collect()}
    assert found <= true and len(found) >= 0.99 * len(true)


def test_links_of_a_sorted_trie():
    """Every two rows of a prefix whose sketches agree are in one group, and no others."""
    rng = np.random.default_rng(4)
    labels = np.array(sorted(map(tuple, rng.integers(0, 2, (300, 4)).tolist())), ">u2")
    sketch = rng.integers(0, 3, (300, 6)).astype(np.uint8)
    block = np.arange(300) // 60
    a, b = near_dup.forest_links(labels, sketch, block, 2, 5)
    got = near_dup._roots(300, a, b)
    pairs = [(i, j) for i in range(300) for j in range(i) if block[i] == block[j] and (labels[i, :2] == labels[j, :2]).all()
             and (sketch[i] == sketch[j]).sum() >= 5]
    want = near_dup._roots(300, *map(np.array, zip(*pairs)))
    assert (got == want).all() and (np.bincount(want) > 2).any()


def test_common_counts():
    rng = np.random.default_rng(0)
    sets = [set(rng.choice(60, rng.integers(1, 50), replace=False).tolist()) for _ in range(70)]
    row, h = zip(*[(i, x) for i, s in enumerate(sets) for x in sorted(s)])
    got = near_dup.common_counts(np.array(row), np.array(h, np.uint64), 70)
    off = ~np.eye(70, dtype=bool)
    assert (got[off] == np.array([[len(a & b) for b in sets] for a in sets])[off]).all()


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(None, 1), (5, 5)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in top)
