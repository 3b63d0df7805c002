"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Each tree of the forest sorts the sets of shingles by a label of several minimum hashes, which lays
its prefix trie out as a sorted list. A set first meets those that share its whole label; the prefix
is then shortened, for sets that are not linked yet, down to the length at which a pair at the
threshold shares one in some tree with the wanted probability. Sets that meet are linked if their
hashes of all trees agree as often as those of such pairs do, so texts that merely share a template
do not chain. Linked groups are verified on their shingles, in blocks, each pair once, and only
counts and spanning links leave a block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, mix64, stored, table, text_slices
from .components import components
from .hashing import Words

SHINGLE, THRESHOLD = 5, 0.8
#: Trees, minimum hashes of a label, and the share of pairs at the threshold that must be found.
TREES, LABEL, RECALL = 16, 10, 0.999
#: Bytes of one hash in a label, and rows of a tree that are compared at once.
BYTES, ROWS = 2, 100_000
#: Documents and shingles of one block of a large group; a task holds two blocks.
BLOCK_DOCS, BLOCK_SHINGLES = 1000, 400_000


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, label: int = LABEL) -> int:
    """The longest prefix that pairs at the threshold share in some tree with probability ``recall``."""
    length = label
    while length > 1 and 1 - (1 - threshold ** length) ** trees < recall:
        length -= 1
    return length


def least_agreement(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = TREES * LABEL) -> int:
    """The most of ``hashes`` minimum hashes that pairs at the threshold have in common with probability ``recall``."""
    below = 0.0
    for m in range(hashes + 1):
        below += math.comb(hashes, m) * threshold ** m * (1 - threshold) ** (hashes - m)
        if below > 1 - recall:
            return m
    return hashes


def shingles(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of texts, as (text, hash), sorted. A text of fewer words is one shingle."""
    words = Words(texts)
    grams = words.grams(k, 5)
    at = np.arange(len(grams))
    inside = words.row[:len(grams)] == words.row[k - 1:] if len(grams) else np.zeros(0, bool)
    row, h = words.row[at[inside]], grams[inside]
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = words.run(words.sums(5), words.first[short], words.first[short] + n[short])
    row, h = np.concatenate([row, short]), np.concatenate([h, whole])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])[:len(row)]
    return row[new], h[new]


def signatures(docs: DataFrame, k: int, trees: int, length: int) -> DataFrame:
    """(doc_id, set1, set2, n, labels, sketch) of every row with doc_id.

    set1 and set2 are 128 bits that name the set of shingles, n its size, ``labels`` the trees'
    labels one after the other, ``sketch`` a byte of each of their hashes. The low bits of a least
    hash are kept, since the high ones are nearly all zero.
    """
    rng = np.random.default_rng(6)
    factors = (rng.integers(1, 1 << 62, trees * length, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    schema = "doc_id long, set1 long, set2 long, n long, labels binary, sketch binary"

    def cut(data: bytes, width: int, filled) -> pa.Array:
        return pa.array([data[p * width:(p + 1) * width] if f else None for p, f in enumerate(filled)], pa.binary())

    def run(batches):
        for b in batches:
            known = np.flatnonzero(b.column(0).is_valid().to_numpy(zero_copy_only=False))
            b = b.take(pa.array(known))
            for i, j, texts in text_slices(b.column(1)):
                row, h = shingles(texts, k)
                begin = np.searchsorted(row, np.arange(j - i))
                n = np.diff(np.append(begin, len(row)))
                some = np.flatnonzero(n)
                names = np.zeros((2, j - i), np.uint64)
                least = np.zeros((j - i, trees * length), ">u2")
                if len(some):
                    for s in (0, 1):
                        names[s, some] = np.add.reduceat(mix64(h ^ (MULT + np.uint64(s))), begin[some])
                    for c, f in enumerate(factors):
                        least[some, c] = np.minimum.reduceat(h * f >> np.uint64(24), begin[some]) & np.uint64(0xFFFF)
                filled = (n > 0).tolist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)), pa.array(n, pa.int64()),
                     cut(least.tobytes(), BYTES * trees * length, filled),
                     cut(least.astype(np.uint8).tobytes(), trees * length, filled)],
                    names=["doc_id", "set1", "set2", "n", "labels", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches by links (a, b)."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def forest_links(labels: np.ndarray, sketch: np.ndarray, block: np.ndarray, floor: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) between rows of the same block whose sketches agree in ``least`` bytes.

    Rows are sorted by block and label. Prefixes are shortened from whole labels to ``floor``
    hashes; at each length a row is held against the first of its prefix, unless they are linked
    already. Rows that share the shortest prefix and are still in different groups then meet each other.
    """
    n = len(labels)
    apart = np.ones(n, int) * -1
    if n > 1:
        differs = labels[1:] != labels[:-1]
        apart[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), labels.shape[1])
        apart[1:][block[1:] != block[:-1]] = -1
    at, a, b, root = np.arange(n), [], [], np.arange(n)
    for length in range(labels.shape[1], floor - 1, -1):
        head = np.maximum.accumulate(np.where(apart < length, at, 0))
        rows = np.flatnonzero(root != root[head])
        for part in np.array_split(rows, max(1, -(-len(rows) // ROWS))):
            near = part[(sketch[part] == sketch[head[part]]).sum(axis=1) >= least]
            a.append(near)
            b.append(head[near])
        root = _roots(n, np.concatenate(a), np.concatenate(b))
    begin = np.flatnonzero(apart < floor)
    size = np.diff(np.append(begin, n))
    run = np.repeat(np.arange(len(begin)), size)
    mixed = np.zeros(len(begin), bool)
    mixed[run[root != root[begin[run]]]] = True
    for m in np.unique(size[mixed]).tolist():
        starts = begin[mixed & (size == m)]
        for part in np.array_split(starts, max(1, len(starts) * m * m // ROWS)):
            rows = part[:, None] + np.arange(m)
            for d in range(1, m):  # each pair of places d apart, of all runs of this size at once
                x, y = rows[:, d:].ravel(), rows[:, :m - d].ravel()
                open_ = root[x] != root[y]
                x, y = x[open_], y[open_]
                near = (sketch[x] == sketch[y]).sum(axis=1) >= least
                a.append(x[near])
                b.append(y[near])
    root = _roots(n, np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(root != at)
    return moved, root[moved]


def _meet(trees: int, length: int, floor: int, least: int):
    """Rows (tree, prefix, i, j, label, rep, sketch) sorted so: links of whole blocks of a tree's prefix."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(table):
        keys = [table.column(c).combine_chunks() for c in range(4)]
        new = np.ones(table.num_rows, bool)
        if table.num_rows > 1:
            new[1:] = False
            for key in keys:
                new[1:] |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        flat = lambda c, kind, w: np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(-1, w)
        a, b = forest_links(flat(4, ">u2", length), flat(6, np.uint8, trees * length), np.cumsum(new), floor, least)
        ids = table.column(5).to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], schema=schema), np.flatnonzero(new)[-1]

    def run(batches):
        kept = None  # rows since the start of the last block that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            last = [table.column(c)[-1].as_py() for c in range(4)]
            same = pc.and_(pc.and_(pc.equal(table.column(0), last[0]), pc.equal(table.column(1), last[1])),
                           pc.and_(pc.equal(table.column(2), last[2]), pc.equal(table.column(3), last[3])))
            whole = table.num_rows - int(pc.sum(same).as_py())
            if whole:
                yield links(table.slice(0, whole))[0]
            kept = table.slice(whole)
        if kept is not None:
            yield links(kept)[0]

    return run


def candidate_links(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, label: int = LABEL) -> DataFrame:
    """Links (a, b) that span what the forest finds among sets (rep, labels, sketch).

    A pair at the threshold is linked, at once or through others, with probability ``recall`` or
    more: half of the misses are left to prefixes, half to the sketch. A prefix of many sets is
    cut in blocks of two chunks of about ``BLOCK_DOCS`` sets.
    """
    half = (1 + recall) / 2
    floor, least = prefix_length(threshold, half, trees, label), least_agreement(threshold, half, trees * label)
    width = BYTES * label
    of_tree = F.expr(f"substring(labels, 1 + {width} * tree, {width})")
    named = sets.where(F.col("labels").isNotNull())
    prefixes = (named.select("rep", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
                .select("rep", "tree", of_tree.alias("label"))
                .withColumn("prefix", F.expr(f"substring(label, 1, {BYTES * floor})")))
    shared = (prefixes.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
              .select("tree", "prefix", F.ceil(F.col("c") / BLOCK_DOCS).alias("chunks")))
    met = (prefixes.join(shared, ["tree", "prefix"])
           .withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
           .select("rep", "tree", "label", "prefix", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
           .join(named.select("rep", "sketch"), "rep")
           .select("tree", "prefix", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "label", "rep", "sketch"))
    blocks = met.repartition("tree", "prefix", "i", "j").sortWithinPartitions("tree", "prefix", "i", "j", "label", "rep")
    return blocks.mapInArrow(_meet(trees, label, floor, least), "a long, b long")


def common_counts(row: np.ndarray, h: np.ndarray, m: int) -> np.ndarray:
    """How many shingles each two of m texts have in common."""
    order = np.argsort(h)
    row, h = row[order], h[order]
    key = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])[:len(h)]) - 1
    df = np.bincount(key)
    begin = np.cumsum(df) - df
    counts = np.zeros(m * m, np.float32)
    for d in np.unique(df[(df > 1) & (df < 32)]).tolist():
        docs = row[begin[df == d][:, None] + np.arange(d)]
        for part in np.array_split(docs, max(1, len(docs) * d * d // 4_000_000)):
            pairs = part[:, :, None] * m + part[:, None, :]
            counts += np.bincount(pairs.ravel(), minlength=m * m)
    counts = counts.reshape(m, m)
    heavy = np.flatnonzero(df >= 32)
    for part in np.array_split(heavy, max(1, -(-len(heavy) // 4096))):
        if len(part):
            column = np.full(len(df), -1)
            column[part] = np.arange(len(part))
            mine = column[key] >= 0
            has = np.zeros((m, len(part)), np.float32)
            has[row[mine], column[key[mine]]] = 1
            counts += has @ has.T
    return counts


def _verify(k: int, threshold: float):
    """Rows (group, i, j, chunk, doc_id, text) sorted by block: links of each document in its block."""
    schema = pa.schema([("doc_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def links(chunks, ids, texts, across):
        ids, chunks = np.array(ids), np.array(chunks)
        m = len(ids)
        row, h = shingles([t.encode("utf-8", "replace") for t in texts], k)
        n = np.bincount(row, minlength=m)
        both = common_counts(row, h, m)
        near = (both > 0) & (both >= threshold * (n[:, None] + n - both) - 1e-6) & (ids[:, None] != ids)
        if across:
            near &= chunks[:, None] != chunks
        root = ids.copy()
        while True:
            least = np.minimum(root, np.where(near, root, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
            if (least == root).all():
                break
            root = least
        degree = near.sum(axis=1)
        some = degree > 0
        return pa.RecordBatch.from_arrays([pa.array(x[some], pa.int64()) for x in (ids, degree, root)], schema=schema)

    def run(batches):
        block, rows = None, {}
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in range(3))))
            for key, *row in zip(keys, *(b.column(c).to_pylist() for c in range(3, 6))):
                if key != block:
                    if len(rows) > 1:
                        yield links(*zip(*rows), block[1] != block[2])
                    block, rows = key, {}
                rows[tuple(row)] = True  # a repeated row counts once
        if len(rows) > 1:
            yield links(*zip(*rows), block[1] != block[2])

    return run


def jaccard_classes(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL,
                    trees: int = TREES) -> DataFrame:
    """(doc_id, copy_of, class_id, n_links) of every row of ``docs`` (doc_id, text).

    A document is the set of its shingles of ``k`` words (runs of other characters than ASCII
    white space, unchanged). Documents with equal sets are copies, named by their least doc_id as
    ``copy_of``; only one of them is compared. ``n_links`` counts the other sets of similarity
    ``threshold`` or more, and ``class_id`` is the least doc_id that such links reach. NULL and
    blank texts are copies of each other without links. Rows without doc_id have no class. Rows
    that repeat a doc_id are one document, with the links of all its texts.

    A pair at the threshold is found with probability ``recall``, a nearer one with more (see
    ``candidate_links``); what is found is verified exactly. Groups of any size are verified whole: beyond ``BLOCK_DOCS``
    documents in blocks, each pair of documents in one block, at a cost that is quadratic in the
    group alone.
    """
    signed = stored(signatures(docs, k, trees, LABEL))
    # A set's labels and size are the same in all its copies, so any of them will do.
    sets = stored(signed.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"),
                                                     F.any_value("labels").alias("labels"), F.any_value("sketch").alias("sketch")))
    groups = components(candidate_links(sets, threshold, recall, trees))
    size = (groups.join(sets.select(F.col("rep").alias("node"), "n"), "node").groupBy("component")
            .agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("chunks")))
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    members = (groups.join(size, "component").withColumn("chunk", own)
               .select("component", F.col("node").alias("doc_id"), "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
               .select("component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = (members.join(texts, "doc_id").select("component", "i", "j", "chunk", "doc_id", "text")
              .repartition("component", "i", "j").sortWithinPartitions("component", "i", "j"))
    found = stored(blocks.mapInArrow(_verify(k, threshold), "doc_id long, links long, root long"))
    degree = found.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("n_links"))
    classes = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))).withColumnsRenamed(
        {"node": "rep", "component": "class_id"})
    named = (sets.select("set1", "set2", "rep").join(degree, "rep", "left").join(classes, "rep", "left")
             .select("set1", "set2", "rep", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return signed.select("doc_id", "set1", "set2").join(named, ["set1", "set2"]).select(
        "doc_id", F.col("rep").alias("copy_of"), "class_id", F.col("n_links").cast("long")).unionAll(
        docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), *[F.lit(None).cast("long")] * 2, F.lit(0).cast("long")))


def op6_jaccard_join(spark, sf_dir) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
