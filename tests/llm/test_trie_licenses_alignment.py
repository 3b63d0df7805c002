"""Prefix trie, licence scan and token alignment against plain versions of them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hazardlake.llm import license_scan, prefix_trie, token_alignment


# ---- prefix trie

def plain_trie(rows):
    """Nodes by their whole sequences of turns."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0), key, role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        inner = {n[:-1] for n in members if n}
        ended = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                    sum(len(n) == len(node) + 1 for n in below), sum(n not in inner for n in below),
                    sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
                    hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return sorted(out, key=str)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(seed):
    rnd, rows = random.Random(seed), []
    for c in [*range(60), 100, 101, 205, 350, 351, -7]:
        for t in range(rnd.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, rnd.choice([t, t, 0, None]), rnd.choice(["user", "user", None, ""]), rnd.choice(["a", "a", "a", "bb", "é漢", None, ""])))
    rows += [(70, t, "user", "a") for t in range(90)] + [(71, t, "user", "a") for t in range(70)]  # long chains
    return rows + rows[:5] + [(None, 1, "user", "x")]


@pytest.mark.parametrize("piece", [1 << 15, 20])
def test_trie_equals_plain_trie(spark, monkeypatch, piece):
    """In one piece and with components split by joins; ties, NULLs, repeated rows, extra columns."""
    rows = conversations(3)
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, weight int")
    monkeypatch.setattr(prefix_trie.subtree_sums, "__defaults__", (piece,))
    got = prefix_trie.conversation_trie(df.repartition(7)).select(*NODE).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(none).collect() == []
    nulls = spark.createDataFrame([(None, 1, "a", "b")], none.schema)
    assert prefix_trie.conversation_trie(nulls).collect() == []


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    """A conversation that is nearly the whole table, numbered and summed over several partitions."""
    rows = [(3, t, "user", f"t{t}") for t in range(3000)] + [(0, t, "user", f"t{t}") for t in range(2990)] + [(100, 0, "x", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(prefix_trie.subtree_sums, "__defaults__", (1500,))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.conversation_trie(df).select(*NODE).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {(r["conv_id"], r["depth"]): r for r in got}
    assert len(got) == 3000 + 1 + 1
    assert by[0, 2990]["n_convs"] == 2 and by[3, 3000]["n_leaves"] == 1
    assert by[0, 1]["saved_tokens"] == sum(len(f"t{t}") for t in range(2990))


def test_decomposition_of_random_forests():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 300, 2000):
        for shape in ("wide", "deep", "mixed"):
            parent = np.array([-1 if i == 0 or rng.random() < 0.02 else
                               {"wide": int(rng.integers(0, i)) // 8, "deep": i - 1, "mixed": int(rng.integers(max(0, i - 5), i))}[shape]
                               for i in range(n)])
            own, values = rng.integers(1, 9, n), rng.integers(-5, 99, (n, 2))
            weight, total = own.copy(), values.copy()
            for i in range(n - 1, 0, -1):
                if parent[i] >= 0:
                    weight[parent[i]] += weight[i]
                    total[parent[i]] += total[i]
            shuffle = rng.permutation(n)
            back = np.argsort(shuffle)
            p = parent[shuffle]
            p = np.where(p < 0, -1, back[p])
            assert (prefix_trie.decompose(p, weight[shuffle], values[shuffle]) == total[shuffle]).all()


# ---- licences

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    words, found = plain_words(text), []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))


def test_base_places_equal_plain_search(spark, docs, odd_docs):
    texts = [r["text"] for r in docs.select("text").collect() + odd_docs.select("text").collect()]
    rnd, some = random.Random(2), "cc by General public LICENSE license all rights reserved ALL the this work under".split()
    texts += [rnd.choice(["", " ", "-"]).join(rnd.choice(some) + rnd.choice([" ", ", ", "\n", "é", "-"]) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    automaton = license_scan.Automaton()
    assert [automaton.scan((t or "").encode())[:5] for t in texts] == [plain_base(t) for t in texts]


def test_matching_statistics(monkeypatch):
    """Matches are all runs of a notice's words, MATCH long or more, that can grow on neither side."""
    rnd = random.Random(4)
    notices = {k: [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(5, 14)))] for k in "wxyz"}
    automaton = license_scan.Automaton({"a b": "ab", "b c d": "bcd"}, notices)
    runs = {tuple(t.split()[i:j]) for ts in notices.values() for t in ts for i in range(len(t.split())) for j in range(i + 1, len(t.split()) + 1)}
    runs |= {("a", "b"), ("b", "c"), ("c", "d"), ("b", "c", "d")}
    inner = {r for ts in notices.values() for t in ts for i in range(len(t.split())) for j in range(i + 1, len(t.split()) + 1) for r in [tuple(t.split()[i:j])]}
    for part in (1 << 20, 7):
        monkeypatch.setattr(license_scan, "PART", part)
        for _ in range(200):
            words = [rnd.choice("abcde") for _ in range(rnd.randint(0, 60))]
            n, places, matches = automaton.stream(" ".join(words).encode())
            want = set()
            for j in range(1, len(words) + 1):
                i = min((i for i in range(j) if tuple(words[i:j]) in runs), default=None)
                if i is not None and j - i >= license_scan.MATCH and (j == len(words) or tuple(words[i:j + 1]) not in runs):
                    want.add((i, j))
            assert n == len(words) and {m[:2] for m in matches} == want
            for i, j, state in matches:
                ends = {(k, e) for k, (ts,) in enumerate(notices.values()) for e in range(j - i, len(ts.split()) + 1) if ts.split()[e - j + i:e] == words[i:j]}
                assert set(automaton.places[state]) == ends and tuple(words[i:j]) in inner


def test_notices_are_found_whole_and_changed():
    automaton = license_scan.Automaton()
    for label, texts in license_scan.NOTICES.items():
        for t in texts:
            got = automaton.scan(f"Some words before. {t.upper()} And some after.".encode())
            assert label in got[5].split(",") and got[6] == 1.0
            assert (label, 3, 3 + len(plain_words(t)), 1.0) in got[7]
    mit = license_scan.NOTICES["mit"][1].split()
    changed = " ".join(w if i % 20 else "changed" for i, w in enumerate(mit, 1))
    got = automaton.scan(changed.encode())
    assert got[5] == "mit" and 0.8 <= got[6] < 1
    assert automaton.scan(" ".join(mit[:20]).encode())[5] == "" and 0 < automaton.scan(" ".join(mit[:20]).encode())[6] < 0.8
    assert automaton.scan(b"nothing of the kind")[4:] == ("", "", 0.0, [])
    twice = automaton.scan(" ".join(mit + ["x"] * 30 + mit).encode())[7]
    assert len(twice) == 2 and twice[0][2] <= twice[1][1]


def test_license_scan_of_odd_rows(spark, odd_docs, no_docs):
    got = license_scan.scan_licenses(odd_docs)
    assert [c for c in got.columns if c not in odd_docs.columns] == ["n_base", "first_word", "last_word", "base_labels", "labels", "license_spans"]
    rows = got.select("doc_id", "text", "n_words", "labels", "score").collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in odd_docs.collect())
    assert all(r["n_words"] == len(plain_words(r["text"])) for r in rows)
    assert license_scan.scan_licenses(no_docs).count() == 0


# ---- alignment

def plain_alignment(pair, texts):
    """Groups by sets of ends, links by listing them all, counts over documents."""
    docs = []
    for a, b in zip(*pair.encode([t or "" for t in texts])):
        ends = [np.cumsum([len(raw[i]) for i in ids]).tolist() for raw, ids in ((pair.raw_a, a), (pair.raw_b, b))]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for e in common:
            p, q = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        docs.append((a, b, groups, Counter((x, y) for g, h in groups for x in g for y in h)))
    count = Counter(k for d in docs for k in d[3])
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for a, b, groups, links in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(a), len(b), len(groups), sum(links.values()), sum(n for k, n in links.items() if count[k] == top[k[0]]),
                    sum(n * count[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def test_common_ends_of_random_arrays():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 900):
        for keep in (0.2, 0.6, 0.95):
            size = n * 4
            a, b = (np.unique(np.append(np.flatnonzero(rng.random(size) < keep), size)) for _ in range(2))
            cuts = np.flatnonzero(np.isin(a, b))[::3]
            for stride in (3, 128):
                hit_a, hit_b = token_alignment.common_ends(a, b, cuts, stride)
                assert (hit_a == np.isin(a, b)).all() and (hit_b == np.isin(b, a)).all()
    assert token_alignment.common_ends(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))[0].size == 0


def test_alignment_equals_plain_alignment(spark, monkeypatch):
    rnd = random.Random(7)
    letters = "aàé '\n\t  The the of tion\u0085　漢字😀1²_-.<|endoftext|></s>"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    texts += [None, "", " ", "a▁b", "<|endoftext|>", "</s>", "aaaa" * 300, "漢" * 400, "the cat", "the cat", "the cat", " ".join(["tion"] * 2000)]
    rows = [(i % 100, t, "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slice string, n int")
    for budget, many in ((token_alignment.SLICE, token_alignment.MANY), (300, 6)):
        monkeypatch.setattr(token_alignment, "SLICE", budget)
        monkeypatch.setattr(token_alignment, "MANY", many)
        found = token_alignment.align(df.repartition(3))
        want = [(i, *r) for (i, *_), r in zip(rows, plain_alignment(token_alignment.Pair(), texts))]
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_encodings_are_the_models_own():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    first = Tokenizer.from_file(token_alignment.MODEL_A)
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=token_alignment.MODEL_B)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab é漢😀'\n\t  <|endoftext|> \xa0") for _ in range(50)) for _ in range(200)]
    a, b = token_alignment.Pair().encode(texts)
    assert a == [first.encode(" " + t, add_special_tokens=False).ids for t in texts] and b == second.encode(texts)


def test_long_texts_in_parts(monkeypatch):
    pair = token_alignment.Pair()
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["word", "é", " ", "  ", " the", "\n", ". "]) for _ in range(300)) for _ in range(30)] + [" " * 50, "x" * 90, "a " * 60]
    whole = pair.encode(texts)
    monkeypatch.setattr(token_alignment, "LONG", 20)
    assert pair.encode(texts) == whole


def test_alignment_of_no_rows(spark, no_docs):
    assert token_alignment.align(no_docs).collect() == []
