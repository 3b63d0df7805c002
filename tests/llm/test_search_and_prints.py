"""Vector search and fingerprints against brute force."""

import hashlib
import random

import numpy as np
import pytest

from hazardlake.llm import syncmers, vafile


def best(vectors, k):
    """Brute force over {id: integer vector}."""
    out = set()
    for q in vectors:
        if q % 50 == 0:
            scores = sorted((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("n, span", [(260, 3.0), (4, 1.0), (1, 1.0), (120, 0.004)])
def test_top_k(spark, n, span):
    rng = np.random.default_rng(n)
    x = np.round(rng.uniform(-span, span, (n, 6)), 2).astype(np.float32)
    x[n // 2:] = x[:n - n // 2]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [float("nan")] * 6), (1100, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
                                                         (1150, [float("inf")] * 6), (None, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    v = vafile.scaled(df)
    got = {tuple(r) for r in vafile.top_k(v, v.where("vec_id % 50 = 0")).collect()}
    assert got == best({i: np.floor(256 * a.astype(np.float64)).astype(np.int64) for i, a in enumerate(x)}, 5)


def test_repeated_vectors_count_once(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0])]
    v = vafile.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = vafile.top_k(v, v.where("vec_id = 0")).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 2)]


def test_vectors_of_many_rows_leave_room_for_others(spark):
    """A partition has more rows of the best vec_id, and of another with different vectors, than results."""
    rng = np.random.default_rng(3)
    x = [(i, rng.integers(-9, 9, 4).tolist()) for i in range(40)]
    x += [(1, [30, 30, 30, 30])] * 9 + [(7, [20 + j, 9, 9, 9]) for j in range(9)] + [(0, [1, j, 2, 3]) for j in range(9)]
    rnd = rng.permutation(len(x)).tolist()
    scores = {}
    for q, a in x:
        for i, b in x:
            if q == 0 and i != 0:
                scores[i] = max(scores.get(i, -10**9), 256 * 256 * int(np.dot(a, b)))
    want = [(0, n + 1, i, s) for n, (i, s) in enumerate(sorted(scores.items(), key=lambda r: (-r[1], r[0]))[:5])]
    df = spark.createDataFrame([(x[i][0], [float(y) for y in x[i][1]]) for i in rnd], "vec_id long, embedding array<float>")
    for parts in (1, 3):
        v = vafile.scaled(df.coalesce(1) if parts == 1 else df.repartition(parts))
        assert sorted(tuple(r) for r in vafile.top_k(v, v.where("vec_id = 0")).collect()) == want


def test_no_vectors(spark):
    v = vafile.scaled(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert vafile.top_k(v, v).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-300, 300, (200, 8)), rng.integers(-300, 300, (20, 8))
    grid = vafile.Cells(x.min(axis=0), x.max(axis=0))
    low, high = grid.bounds(grid.of(x), q)
    assert (low <= x @ q.T).all() and (x @ q.T <= high).all()


def test_anchors_are_closed_syncmers():
    texts = ["", "short", "abcdefgh" * 20, "".join(chr(97 + i * i % 26) for i in range(300)) + "é漢😀" * 9]
    got = list(zip(*(x.tolist() for x in syncmers.anchors(texts)[:2])))
    want = []
    for n, t in enumerate(texts):
        points = np.array([ord(c) for c in t], np.uint32)
        s = syncmers._smers(points).tolist() if len(t) >= syncmers.S else []
        for i in range(len(t) - syncmers.K + 1):
            inner = s[i:i + syncmers.K - syncmers.S + 1]
            if min(inner) in (inner[0], inner[-1]):
                want.append((n, i))
    assert got == want


def test_fingerprints_of_odd_rows(odd_docs):
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = syncmers.compare_with_next(odd_docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want, prints = [], {t: syncmers.fingerprints([t])[0] for _, t in rows}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        e = t[:len(t) - len(t) // 3] + after[:len(t) // 3]
        other = syncmers.fingerprints([e])[0]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), syncmers.to_string(prints[t]), syncmers.to_string(other),
                     syncmers.likeness(prints[t], other), syncmers.likeness(prints[t], prints[after])))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_ranges_hand_over_their_first_rows(spark):
    rows = [(i * 3 % 101, f"text {i} " * 9) for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = syncmers.in_sequence(df, rows_each=10).mapInArrow(syncmers._compare, syncmers._COMPARED).collect()
    texts = dict(rows)
    assert len(got) == 101
    for r in got:
        t, after = texts[r.doc_id], texts[(r.doc_id - 1) % 101]
        assert r.edited_sha256 == hashlib.sha256(syncmers.edited(t, after).encode()).hexdigest()


def test_likeness():
    a = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(4000))
    one, half, other = syncmers.fingerprints([a, a[:2000] + a[:1:-1][:2000].upper(), a.upper()])
    assert syncmers.likeness(one, one) == 1 > syncmers.likeness(one, half) > 0.1 > syncmers.likeness(one, other)
    assert (syncmers.from_string(syncmers.to_string(one)) == one).all()


def test_vectors_of_unequal_lengths(spark):
    """Those of another length than most take no part, empty ones neither."""
    rows = [(i, [float(i % 7), 0.5 * i]) for i in range(60)] + [(100, []), (150, [1.0]), (200, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = vafile.scaled(df)
    got = {tuple(r) for r in vafile.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()}
    assert got == best({i: np.floor(256 * np.array(v)).astype(int) for i, v in rows[:60]}, 5)


def plain_anchors(text):
    """All closed syncmers by their definition: {k-mer: first place}."""
    s = syncmers._smers(np.array([ord(c) for c in text], np.uint32)).tolist() if len(text) >= syncmers.S else []
    found = {}
    for i in range(len(text) - syncmers.K + 1):
        inner = s[i:i + syncmers.K - syncmers.S + 1]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(text[i:i + syncmers.K], i)
    return found


def test_likeness_uses_all_anchors():
    """Against all anchors by their text and a quadratic search for the longest common order; one word counts in a long text."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    for n in (0, 3, 40, 400, 1500):
        a = [rng.choice(words) for _ in range(n)]
        b = a[:n // 2] + [rng.choice(words) for _ in range(n // 5)] + a[2 * n // 3:] + a[:n // 10]
        a, b = " ".join(a), " ".join(b)
        x, y = plain_anchors(a), plain_anchors(b)
        common = [y[k] for k in sorted(x, key=x.get) if k in y]
        best = []
        for i, p in enumerate(common):
            best.append(1 + max((best[j] for j in range(i) if common[j] < p), default=0))
        got = syncmers.fingerprints([a, b])
        if x and y:
            assert [len(f) for f in got] == [len(x), len(y)]
            assert syncmers.likeness(*got) == max(best, default=0) / len(set(x) | set(y))
    long = " ".join(rng.choice(words) for _ in range(3000))
    changed = long[:9000] + "zzzzzzzzzz" + long[9000:]
    one, two = syncmers.fingerprints([long, changed])
    assert set(one["hash"]) != set(two["hash"]) and 0.98 < syncmers.likeness(one, two) < 1


def test_fingerprint_column(odd_docs, no_docs):
    rows = syncmers.fingerprint(odd_docs, "score").collect()
    assert all(r.score == syncmers.to_string(syncmers.fingerprints([r.text or ""])[0]) for r in rows)
    assert syncmers.compare_with_next(no_docs).count() == 0
