"""The network's gradients and accuracy, and the pipeline's stages."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hazardlake.llm import gru, line_dedup, near_dup, toxicity
from hazardlake.llm.pieces import MODEL

SF = "/root/testdata/sf0.001"
BAD = ["scoundrel", "wretch", "vermin", "grutzlig"]


def texts(n, seed):
    rnd = random.Random(seed)
    syllables = "an be co du er fi go ha in jo ka le mi no or pe".split()
    out = []
    for k in range(n):
        words = ["".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(rnd.randint(5, 200))]
        if k % 4 == 0:
            for _ in range(rnd.randint(1, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(BAD) + rnd.choice(["", ",", ".", "en"])
        out.append((" ".join(words), int(k % 4 == 0)))
    return out


def test_gradients():
    rng = np.random.default_rng(0)
    types = gru.Types([b"one two three four", b"two six", b"seven eight nine"])
    net = gru.Network(np.sort(types.hashes[:4]))
    row, of, used = gru.windows(types.first, types.of, window=3, stride=2)
    label, weight = np.array([1, 0, 1, 0])[row].astype(np.float32), np.ones(len(row), np.float32)
    _, grad = net.gradients(types, of, used, label, weight)
    for name, g in grad.items():
        way = rng.standard_normal(g.shape).astype(np.float32)
        way *= (g != 0) if name in ("char", "word") else 1
        start, found = net.p[name], []
        for step in (0.01, -0.01):
            net.p[name] = start + np.float32(step) * way
            found.append(net.gradients(types, of, used, label, weight)[0])
        net.p[name] = start
        assert (found[0] - found[1]) / 0.02 == pytest.approx(float((g * way).sum()), rel=0.05, abs=2e-3), name


def test_windows_cover_all_words():
    types = gru.Types([b"", b"a b", " ".join(map(str, range(100))).encode(), b"..!"])
    row, of, used = gru.windows(types.first, types.of)
    assert set(row.tolist()) == {1, 2} and (row == 2).sum() == 4
    assert set(of[row == 2][used[row == 2]].tolist()) == set(types.of[types.first[2]:types.first[3]].tolist())


def test_held_out_accuracy_and_odd_rows(spark, odd_docs, no_docs):
    rows = texts(400, 1)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    net = toxicity.learn(docs, labels)
    got = toxicity.score(docs, net).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.score, rows[r.doc_id][1]) for r in got if r.held]
    ranks = np.argsort(np.argsort([s for s, _ in held]))
    y = np.array([y for _, y in held])
    assert (ranks[y == 1].mean() - ranks[y == 0].mean()) / len(y) * 2 > 0.85
    odd = toxicity.score(odd_docs, net).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if not (r.text or "").strip()}) == 1
    assert toxicity.score(no_docs, net).count() == 0
    again = toxicity.score(docs, toxicity.learn(docs.repartition(3), labels)).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}


def test_no_labels_no_network(spark, odd_docs):
    labels = spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int")
    net = toxicity.learn(odd_docs, labels)
    assert net is None and {r.score for r in toxicity.score(odd_docs, net).collect()} == {0.0}


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def table(odd_docs):
    return odd_docs.select("doc_id", "text", "lang", "source", "n_chars")


def test_toxic_documents_go(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    got = stage("toxicity")(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in scores if r.score < 0.7)


def test_repeated_lines_go(spark, table):
    got = stage("line dedup")(spark, table, SF)
    assert got.columns == table.columns
    want = line_dedup.dedup_lines(table).collect()
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got.collect()) == Counter((r.doc_id, r.text, len(r.text)) for r in want)


def test_one_of_near_copies_stays(spark, table):
    got = stage("n-gram Jaccard join")(spark, table, SF).collect()
    least = {r.doc_id: r.class_id for r in near_dup.jaccard_classes(table).collect() if r.doc_id is not None}
    rows = table.collect()
    worded = lambda r: bool((r.text or "").strip(" \t\n\x0b\f\r"))
    assert sorted(r.doc_id for r in got if r.doc_id is not None and worded(r)) == sorted(
        {r.doc_id for r in rows if r.doc_id is not None and worded(r) and least[r.doc_id] == r.doc_id})
    assert Counter(r.text for r in got if r.doc_id is None or not worded(r)) == Counter(r.text for r in rows if r.doc_id is None or not worded(r))


def test_texts_of_one_doc_id_are_not_lost(spark):
    """Rows (1, A), (1, B), (2, B and a word), (2, A): one of A and one of the Bs stay, others are copies."""
    rng = random.Random(1)
    a, b = (" ".join(rng.choice("abcdefghij") * 3 + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(2))
    rows = [(1, a, "x"), (1, b, "y"), (2, b + " word", "z"), (2, a, "u"), (3, a, "v"), (3, a, "v"), (None, a, "n"), (4, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    got = corpus_pipeline.keep_one_of_near_copies(spark, df, None).collect()
    texts = Counter(r.text for r in got if r.doc_id is not None)
    assert texts[a] == 1 and texts[b] + texts[b + " word"] == 1 and texts[None] == 1 and len(got) == 4


def test_clashing_columns(spark):
    """Columns named like the stages' own pass through."""
    line = "This line is often found in documents"
    rows = [(i, f"{line}\nown {i}", "s", i, i, i) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _version int, _lines int, _dropped int")
    got = {tuple(r) for r in corpus_pipeline.drop_repeated_lines(spark, df, None).collect()}
    assert got == {(i, f"own {i}" if i < 3 else f"{line}\nown {i}", "s", i, i, i) for i in range(4)}
    names = ["_words", "_n", "_copy", "_rows", "_times", "_doc_id"]
    df = spark.createDataFrame([(i, "one two", "s", *[7 + i] * 6) for i in range(3)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = corpus_pipeline.mix_sources(spark, df, None)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == {tuple(r) for r in df.collect()}


def test_stages_follow_each_other(spark):
    import sentencepiece
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        now = f(spark, now, SF)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter((r.doc_id, tuple(model.encode(r.text))) for r in now.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_stages_of_nothing(spark, no_docs):
    now = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, f in corpus_pipeline.STAGES:
        now = f(spark, now, SF)
        assert now.count() == 0
        now = spark.createDataFrame([], now.schema)
