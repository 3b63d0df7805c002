"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

A text's two encodings are arrays of byte offsets at which tokens end. While both end together at
one index shift (a diagonal), tokens pair off one to one: the arrays are compared there in runs of
doubling length. Where a run breaks, the side that is behind steps on until both end together
again; that is one irregular group, after which the shift is another. Many stretches of a batch are
walked at once, each from an offset where both are known to end.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, table, texts_in

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a slice of texts, first tokens between two starts of walks, longest probe, and
#: links of a group above which its repeated ids are counted before they are paired.
SLICE, STRIDE, PROBE, MANY = 1 << 20, 128, 64, 1024
#: Characters from which a text is given to the second model in parts.
LONG = 1 << 20
#: Fixed value: how the byte-level model cuts a text before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANK = "▁"


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, from their files' contents; workers build the encoders when first needed."""

    def __init__(self, path_a: str = MODEL_A, path_b: str = MODEL_B):
        from sentencepiece import SentencePieceProcessor

        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)
        letters, special = _byte_letters(), {t["content"] for t in model["added_tokens"] if t["special"]}
        vocab = model["model"]["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids of the byte-level model must rise in the order of its merges")
        self.ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        with open(path_b, "rb") as f:
            self.proto = f.read()
        b = SentencePieceProcessor(model_proto=self.proto)
        self.raw_a: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for raw, i in self.ranks.items():
            self.raw_a[i] = raw
        self.raw_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else
                      b"" if b.is_control(i) else b.id_to_piece(i).replace(BLANK, " ").encode() for i in range(b.get_piece_size())]
        self.ready = None

    def __getstate__(self):
        return self.__dict__ | {"ready": None}

    def _open(self):
        if self.ready is None:
            import tiktoken
            from sentencepiece import SentencePieceProcessor

            lengths = [np.array([len(r) for r in raw], np.int64) for raw in (self.raw_a, self.raw_b)]
            ends = [[str(i).encode() + s for i in range(len(raw)) for s in (b",", stop)]
                    for raw, stop in ((self.raw_a, b"|"), (self.raw_b, b";"))]
            self.ready = (tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={}),
                          SentencePieceProcessor(model_proto=self.proto), lengths, ends[0] + ends[1])
        return self.ready

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of blank and text by the first model and of the text by the second, which adds the blank.

        A text without tokens, or one that either model does not give back, has no ids. Very long
        texts go through the second model in parts, cut before single blanks, where no piece runs on.
        """
        first, second, _, _ = self._open()
        a, b = [], []
        for t in texts:
            if not t:
                a.append([])
                b.append([])
                continue
            raw = (" " + t).encode("utf-8", "replace")
            x = first.encode_ordinary(" " + t)
            y = second.encode(t) if len(t) < LONG else [i for part in _parts(t) for i in second.encode(part)]
            same = b"".join(map(self.raw_a.__getitem__, x)) == raw and b"".join(map(self.raw_b.__getitem__, y)) == raw
            a.append(x if same else [])
            b.append(y if same else [])
        return a, b


def _parts(text: str):
    """Parts of a text between single blanks, LONG characters or more each but the last."""
    start = 0
    while start < len(text):
        cut = text.find(" ", start + LONG)
        while cut > 0 and (text[cut - 1] in (" ", BLANK) or text[cut + 1:cut + 2] in (" ", BLANK, "")):
            cut = text.find(" ", cut + 1)
        yield text[start:] if cut < 0 else text[start:cut]
        if cut < 0:
            return
        start = cut + 1


def common_ends(a: np.ndarray, b: np.ndarray, cuts: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Which ends of each array also occur in the other: two masks.

    ``a`` and ``b`` rise strictly and share their last value; ``cuts`` are indices into ``a`` at
    which both are known to end. More starts are found at every ``stride``-th end of ``a`` that ``b``
    has too. All walks go on together until the last has met the next one's start.
    """
    hit_a, hit_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    if not len(a):
        return hit_a, hit_b
    tried = np.arange(stride - 1, len(a), stride)
    at = np.searchsorted(b, a[tried])
    tried = tried[b[np.minimum(at, len(b) - 1)] == a[tried]]
    stop_a = np.union1d(np.union1d(cuts, tried), [len(a) - 1])
    stop_b = np.searchsorted(b, a[stop_a])
    i, j = np.concatenate([[0], stop_a[:-1] + 1]), np.concatenate([[0], stop_b[:-1] + 1])
    end_a, end_b = stop_a + 1, stop_b + 1
    probe = np.ones(len(i), np.int64)
    while len(i):
        # Compare a run on the diagonal of each walk; what is equal before the first difference pairs off.
        n = np.minimum(probe, np.minimum(end_a - i, end_b - j))
        begin = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(begin, n)
        x, y = np.repeat(i, n) + step, np.repeat(j, n) + step
        differ = a[x] != b[y]
        seen = np.concatenate([[0], np.cumsum(differ)])
        paired = (seen[1:] == np.repeat(seen[begin], n))
        hit_a[x[paired]], hit_b[y[paired]] = True, True
        run = np.bincount(np.repeat(np.arange(len(n)), n)[paired], minlength=len(n))
        i, j = i + run, j + run
        broken = np.flatnonzero(run < n)
        probe = np.where(run < n, 1, np.minimum(probe * 2, PROBE))
        # An irregular group: the side behind steps on until both end together.
        if len(broken):
            p, q, open_ = i[broken], j[broken], np.arange(len(broken))
            while len(open_):
                left, right = a[p[open_]], b[q[open_]]
                p[open_] += left < right
                q[open_] += right < left
                open_ = open_[left != right]
            hit_a[p], hit_b[q] = True, True
            i[broken], j[broken] = p + 1, q + 1
        on = i < end_a
        i, j, end_a, end_b, probe = i[on], j[on], end_a[on], end_b[on], probe[on]
    return hit_a, hit_b


def _linked(group_a, ids_a, group_b, ids_b, n_groups) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, a, b, times) of all pairs of ids within a group; ids sorted by group."""
    p, q = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    large = np.flatnonzero(p * q > MANY)
    times_a, times_b = np.ones(len(ids_a), np.int64), np.ones(len(ids_b), np.int64)
    if len(large):  # count repeated ids first, so that a long group of few ids has few pairs
        sides = []
        for group, ids in ((group_a, ids_a), (group_b, ids_b)):
            order = np.lexsort((ids, group))
            order = np.concatenate([order[np.isin(group[order], large)], np.flatnonzero(~np.isin(group, large))])
            g, x = group[order], ids[order]
            new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | ~np.isin(g[1:], large)]))
            count = np.diff(np.append(new, len(g)))
            again = np.argsort(g[new], kind="stable")
            sides.append((g[new][again], x[new][again], count[again]))
        (group_a, ids_a, times_a), (group_b, ids_b, times_b) = sides
        p, q = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    first_b = np.cumsum(q) - q
    each = q[group_a]
    left = np.repeat(np.arange(len(ids_a)), each)
    within = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
    right = first_b[group_a][left] + within
    return group_a[left], ids_a[left], ids_b[right], times_a[left] * times_b[right]


def align_texts(pair: Pair, texts: list[str]) -> dict:
    """Alignment of some texts: counts per text, hashes of groups, and linked pairs with their times.

    ``pairs`` are the distinct id pairs of the texts as a * n_b + b, ``docs`` in how many of the
    texts each occurs; ``doc``, ``pair`` (index into pairs) and ``times`` list them by text.
    """
    _, _, (len_a, len_b), names = pair._open()
    a, b = pair.encode(texts)
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    ids_a, ids_b = (np.fromiter((i for x in side for i in x), np.int64, int(n.sum())) for side, n in ((a, n_a), (b, n_b)))
    ends_a, ends_b = np.cumsum(len_a[ids_a]), np.cumsum(len_b[ids_b])
    some = n_a > 0
    hit_a, hit_b = common_ends(ends_a, ends_b, np.cumsum(n_a)[some] - 1)
    group_a, group_b = (np.cumsum(h) - h for h in (hit_a, hit_b))
    total = int(hit_a.sum())
    doc_a = np.repeat(np.arange(len(texts)), n_a)
    doc_of = doc_a[hit_a]
    n_groups = np.bincount(doc_of, minlength=len(texts))
    # Groups as text: a group's first ids, then its second ids, each id with what follows it.
    many_a, many_b = np.bincount(group_a, minlength=total), np.bincount(group_b, minlength=total)
    merged = np.empty(len(ids_a) + len(ids_b), np.int64)
    merged[np.arange(len(ids_a)) + (np.cumsum(many_b) - many_b)[group_a]] = 2 * ids_a + hit_a
    merged[np.arange(len(ids_b)) + np.cumsum(many_a)[group_b]] = 2 * (ids_b + len(len_a)) + hit_b
    written = list(map(names.__getitem__, merged.tolist()))
    ends = np.cumsum(n_a + n_b).tolist()
    digests = [hashlib.sha256(b"".join(written[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip([0, *ends[:-1]], ends)]
    group, x, y, times = _linked(group_a, ids_a, group_b, ids_b, total)
    wide = len(len_a) * len(len_b)
    key = doc_of[group] * wide + x * len(len_b) + y if len(group) else np.zeros(0, np.int64)
    order = np.argsort(key)
    key, times = key[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
    times = np.add.reduceat(times, new) if len(new) else times
    key = key[new]
    doc = key // wide
    pairs, index, docs = np.unique(key % wide, return_inverse=True, return_counts=True)
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(doc, times, len(texts)).astype(np.int64),
            "groups_sha256": digests, "pairs": pairs, "docs": docs, "doc": doc, "pair": index, "times": times, "n_ids_b": len(len_b)}


_ENCODED = ("slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "pair array<int>, times array<int>, a array<int>, b array<int>, docs array<int>")
_FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _lists(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(kind)))


def encoded_slices(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """Aligned documents: a row for each, and for each slice of documents one with its distinct pairs.

    Rows of documents have ``pair``, places in their slice's list of pairs, and ``times``; rows of
    slices have ``a``, ``b`` and ``docs`` (documents of the slice that hold the pair linked) instead.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pair(model_a, model_b))

    def run(batches):
        pair, number = shared.value, TaskContext.get().partitionId() << 32
        none = pa.array([None], pa.list_(pa.int32()))
        for batch in batches:
            texts = texts_in(batch.column(1))
            for i, j in slices([len(t) for t in texts], SLICE):
                found = align_texts(pair, texts[i:j])
                n = j - i
                stops = np.searchsorted(found["doc"], np.arange(n + 1))
                empty = pa.concat_arrays([none] * n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), batch.column(0).slice(i, n), *(pa.array(found[c]) for c in ("n_a", "n_b", "n_groups", "n_links")),
                     pa.array(found["groups_sha256"], pa.string()), _lists(found["pair"], stops, np.int32), _lists(found["times"], stops, np.int32),
                     empty, empty, empty], names=[c.split()[0] for c in _ENCODED.split(", ")])
                if len(found["pairs"]):
                    whole = np.array([0, len(found["pairs"])])
                    blank = pa.array([None], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), *[blank] * 5, pa.array([None], pa.string()), none, none,
                         _lists(found["pairs"] // found["n_ids_b"], whole, np.int32), _lists(found["pairs"] % found["n_ids_b"], whole, np.int32),
                         _lists(found["docs"], whole, np.int32)], names=[c.split()[0] for c in _ENCODED.split(", ")])
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ENCODED)


def _score(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Counts of a slice's pairs applied to its documents."""
    order = np.argsort(pairs.column("place").to_numpy())
    n, best = (pairs.column(c).to_numpy()[order] for c in ("n", "best"))
    docs = docs.combine_chunks()
    lists = docs.column("pair").combine_chunks()
    at, times = lists.flatten().to_numpy(), docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    n_best, count_sum = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
    np.add.at(n_best, row, times * best[at])
    np.add.at(count_sum, row, times * n[at])
    return pa.table([*(docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(count_sum),
                     docs.column("groups_sha256")], names=[c.split()[0] for c in _FOUND.split(", ")])


def align(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Every row of ``docs(doc_id, text)`` is a document of its own, so repeated rows count as often
    as they come, and NULL ids stay; other columns are not read. NULL and empty texts, and those
    that one of the models does not give back (the second has U+2581 for a blank), have no tokens:
    zeros and ''. Texts are whole; one longer than a slice is a slice of its own. A pair's count is
    summed from the slices' lists of distinct pairs, and only these lists are joined with it, so a
    frequent pair is one row a slice, not one a document.
    """
    encoded = stored(encoded_slices(docs, model_a, model_b))
    listed = encoded.where(F.col("a").isNotNull()).select(
        "slice", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "p")).select("slice", "place", "p.a", "p.b", "p.docs")
    counts = stored(listed.groupBy("a", "b").agg(F.sum("docs").alias("n")))
    top = counts.groupBy("a").agg(F.max("n").alias("most"))
    judged = counts.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    pairs = listed.join(judged, ["a", "b"]).select(F.col("slice").alias("of"), "place", "n", "best")
    rows = encoded.where(F.col("a").isNull()).select("slice", *(c.split()[0] for c in _ENCODED.split(", ")[1:9]))
    return rows.groupBy("slice").cogroup(pairs.groupBy("of")).applyInArrow(_score, _FOUND)


def op13_token_alignment(spark, sf_dir) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
