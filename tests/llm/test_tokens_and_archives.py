"""Encoding, token counts, mixing and archives against definitions."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from hazardlake.llm import mixing, pieces, token_scan, warc

MODEL = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.load_model())


def ids(raw):
    return np.frombuffer(raw, np.int32).tolist()


def test_encoding_is_the_models(encoder):
    texts = [r[0] for r in duckdb.connect().execute(f"SELECT coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall()]
    assert [ids(x) for x in encoder.encode(texts)] == MODEL.encode(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdeint hors  ▁\n\té漢😀\0.=-_"), max_size=60), max_size=20))
def test_encoding_of_odd_texts(encoder, texts):
    assert [ids(x) for x in encoder.encode(texts)] == MODEL.encode(texts)


def test_encoding_of_joined_pieces(encoder):
    rnd = random.Random(7)
    words = [p.replace("▁", " ") for p in encoder.pieces[259:]]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    assert [ids(x) for x in encoder.encode(texts)] == MODEL.encode(texts)


def test_forgetting_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    texts = ["the quick brown fox", "an old house by the sea", "the fox", "ununderstandableness of things"] * 9
    assert [ids(x) for t in texts for x in encoder.encode([t])] == MODEL.encode(texts)


def test_round_trip_of_odd_rows(odd_docs, no_docs):
    rows = pieces.decode(pieces.encode(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.ids == MODEL.encode(r.text or "") and r.decoded == (r.text or "").replace("▁", " ")
        assert r.score == "s"
    assert pieces.decode(pieces.encode(no_docs)).count() == 0


@pytest.mark.parametrize("block", [1, 5, 64, 10_000])
def test_scan_of_blocks(spark, block):
    rnd = random.Random(block)
    files, want = [], set()
    for f in range(4):
        tokens, start = [], 0
        for k in range(rnd.randint(0, 40)):
            n = rnd.choice([0, 0, 1, 3, 17, 200])
            want.add((f, k, start, n, True))
            tokens += [rnd.randint(3, 9) for _ in range(n)] + [2]
            start = len(tokens)
        if f == 3:
            want.add((f, k + 1, start, 5, False))
            tokens += [4] * 5
        files += [(f, i // block, bytearray(np.array(tokens[i:i + block], "<u2").tobytes())) for i in range(0, len(tokens), block)]
    files += [(9, 0, None), (8, 0, bytearray())]
    df = spark.createDataFrame(files, "file int, block long, data binary").repartition(5)
    assert {tuple(r) for r in token_scan.scan_separators(df).collect()} == want


def test_token_counts(spark, odd_docs):
    flat = token_scan.write_flat(odd_docs.repartition(3), block_tokens=50).persist()
    got = Counter(r.n_tokens for r in token_scan.scan_separators(flat.where("data IS NOT NULL")).collect())
    assert got == Counter(len(MODEL.encode(r.text or "")) for r in odd_docs.collect())
    want = {r[0]: len(MODEL.encode(r[1] or "")) for r in duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}
    assert {r.doc_id: r.n_tokens for r in token_scan.op10_token_counts(spark, SF).collect()} == want


def targets(sizes):
    """By the rule: share, stop at three times the size, share the excess, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        out = {s: 3 * sizes[s] if s in full else rest * weight[s] / total for s in names}
        above = {s for s in names if out[s] > 3 * sizes[s]}
        if not above:
            return out
        full |= above


def check_mix(df):
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    size = defaultdict(int)
    for r in rows:
        size[r.source] += r.size
    want, taken, longest = targets(size), defaultdict(int), max((r.size for r in rows), default=0)
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * (r.times if r.size else 0) and r.times <= 3
    return rows, {s: (taken[s], want[s]) for s in size}, longest


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows, sums, longest = check_mix(odd_docs)
    assert all(abs(a - b) <= longest for a, b in sums.values())
    again = mixing.mix(odd_docs.repartition(5)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(no_docs).count() == 0


def test_mix_meets_its_targets(spark, docs):
    _, sums, longest = check_mix(docs)
    assert all(0 <= b - a + 0.5 and b - a <= longest for a, b in sums.values())
    _, sums, _ = check_mix(spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet"))
    assert all(abs(a - b) <= max(20, 0.01 * b) for a, b in sums.values())


def test_rows_of_a_mix(odd_docs):
    got = Counter((r.doc_id, r.text) for r in mixing.mixed(odd_docs).collect())
    want = Counter()
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id, r.source, len((r.text or "").encode().split())].append(r.text)
    for r in mixing.mix(odd_docs).collect():
        want[r.doc_id, r.source, r.size] += r.times
    total = Counter()
    for k, t in texts.items():
        total[k] = sum(got[k[0], x] for x in set(t))
    assert total == +want


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 8), min_size=1, max_size=12), st.floats(0, 1))
def test_budget_is_met_where_it_can_be(hist, share):
    lengths, counts = np.array(sorted(hist)), np.array([hist[k] for k in sorted(hist)])
    budget = round(share * int(lengths @ counts))
    take = mixing.fit_budget(lengths, counts, budget)
    assert (0 <= take).all() and (take <= counts).all()
    sums = {0}
    for x, n in hist.items():
        sums = {a + x * k for a in sums for k in range(n + 1)}
    assert int(take @ lengths) == max(a for a in sums if a <= budget)


def test_budget_that_a_proportional_start_misses():
    lengths, counts = np.array([0, 23, 45, 48, 51, 54, 59]), np.array([3, 1, 8, 4, 1, 3, 2])
    assert int(mixing.fit_budget(lengths, counts, 380) @ lengths) == 380
    many = np.array([1000, 1001])
    assert int(mixing.fit_budget(many, np.array([10 ** 8, 10 ** 8]), 75_400_037_711) @ many) == 75_400_037_711
    assert mixing.fit_budget(np.array([], int), np.array([], int), 0).tolist() == []
    assert mixing.fit_budget(np.array([0]), np.array([4]), 0).tolist() == [0]


def test_archives_of_odd_pages(spark):
    big, other = "<p>é " * 400, "<p>x</p>" * 300
    rows = [(1, "http://a/1", big), (2, "http://a/ b\n", big), (5, None, big), (3, "http://c", other), (4, "", None), (6, "http://d", ""),
            (7, "http://e", "tiny"), (8, "http://e", "tiny"), (None, "http://f", big), (None, None, None), (9, "u", other), (9, "u", other),
            (10, "u", "WARC/1.1\r\n\r\nfiledesc://x 1\n\n" * 60), (11, "u", big[:-1] + "x")]
    pages = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, name string")
    got = warc.read_warc(warc.convert_pages(pages)).collect()
    assert len(got) == len(rows)
    con = duckdb.connect()
    con.register("pages", pages.where("page_id IS NOT NULL").toArrow())
    want = Counter(con.execute(warc.ORACLE).fetchall())
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.page_id is not None) == want
    assert sorted((r.payload_bytes, r.record_type, r.refers_to) for r in got if r.page_id is None) == [(0, "response", None), (len(big.encode()), "revisit", 5)]
    for r in got:
        assert " " not in r.url and (r.payload is None) == (r.record_type == "revisit")
    assert warc.convert_pages(pages.limit(0)).count() == 0


def test_versions_of_legacy_archives(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "x" * k) for k in range(40)], "page_id long, url string, html string")
    archives = warc.write_arc(pages.coalesce(1), limit=2000)
    records = warc.read_arc(archives).collect()
    assert {r.version for r in records} == {1, 2} and archives.count() > 3
    assert sorted((r.page_id, r.url, r.payload.decode(), r.payload_bytes, r.date) for r in records) == [
        (k, f"http://h/{k}", "x" * k, k, "20240101000000") for k in range(40)]
