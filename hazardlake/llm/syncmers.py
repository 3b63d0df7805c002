"""Document fingerprints from closed syncmers.

A k-mer of characters is an anchor if the least of its inner s-mers lies at one of its edges. That
depends on the k-mer alone, so an edit moves no anchor outside its reach, and anchors of two texts
can be matched by hash and compared by position.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, slices, table, texts_in

#: Characters of a k-mer and of an inner s-mer.
K, S = 24, 8
SLICE = 1 << 20
_ANCHOR = np.dtype([("hash", ">u4"), ("place", ">u4")])
_MULTS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _smers(points: np.ndarray) -> np.ndarray:
    """Hashes of all runs of 8 code points, by doubling."""
    h, width = mix64(points.astype(np.uint64) + np.uint64(1)), 1
    for m in _MULTS:
        h = h[:-width] * m + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    return h


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed syncmers of each text: (text, place, hash), in order."""
    size = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < K:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    s = _smers(points)
    inner = K - S + 1
    least, width = s, 1
    while width * 2 <= inner:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if width < inner:
        least = np.minimum(least[:len(s) - inner + 1], least[inner - width:])
    n = len(least)
    closed = np.flatnonzero((s[:n] == least) | (s[inner - 1:inner - 1 + n] == least))
    begin = np.cumsum(size) - size
    row = np.searchsorted(begin, closed, "right") - 1
    place = closed - begin[row]
    inside = place + K <= size[row]
    closed, row, place = closed[inside], row[inside], place[inside]
    return row, place, mix64(s[closed] * _MULTS[0] + s[closed + S] * _MULTS[1] + s[closed + K - S])


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """All anchors of each text, each hash once at its first place, in order of place.

    A text without anchors, as all shorter than a k-mer are, has one anchor for all its characters.
    """
    row, place, h = anchors(texts)
    high = (h >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((place, high, row))
    row, place, high = row[order], place[order], high[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (high[1:] != high[:-1])])[:len(row)]
    row, place, high = row[new], place[new], high[new]
    order = np.lexsort((place, row))
    row, place, high = row[order], place[order], high[order]
    both = np.empty(len(row), _ANCHOR)
    both["hash"], both["place"] = high, place
    begin = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    out = []
    for t, i, j in zip(texts, begin[:-1], begin[1:]):
        if i == j:
            whole = hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:4]
            out.append(np.array([(int.from_bytes(whole, "big"), 0)], _ANCHOR))
        else:
            out.append(both[i:j])
    return out


def to_string(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), _ANCHOR)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the anchors of both texts that they have in common, in the same order (0 to 1)."""
    ha, hb = a["hash"].astype(np.int64), b["hash"].astype(np.int64)
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    places = b["place"].astype(np.int64)[j][np.argsort(i)]
    if (np.diff(places) > 0).all():
        run = len(places)
    else:  # the longest rising run of places in the other text
        tails: list[int] = []
        for p in places.tolist():
            k = bisect_left(tails, p)
            tails[k:k + 1] = [p]
        run = len(tails)
    return run / (len(ha) + len(hb) - len(i))


def fingerprint(docs: DataFrame, to: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of the text as a string; a column of that name is replaced.

    NULL counts as the empty text. Equal texts have equal fingerprints. Whole texts are read, in
    slices, and nothing is shuffled.
    """
    kept = [f for f in docs.schema.fields if f.name != to]
    names = [f.name for f in kept]

    def run(batches):
        for b in batches:
            texts = texts_in(b.column("text"))
            for i, j in slices([len(t) for t in texts], SLICE):
                part = b.slice(i, j - i)
                found = [to_string(f) for f in fingerprints(texts[i:j])]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found, pa.string())],
                                                 names=[*names, to])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(to, T.StringType())]))


def in_sequence(docs: DataFrame, rows_each: int = 2500, most: int = 10_000) -> DataFrame:
    """(range, borrowed, doc_id, text), ranges of doc_id in partitions sorted from large to small.

    The first row of every range is lent to the range above it, where it comes last, so each row
    finds its successor in its own partition; the last range is lent the very first row. Borders
    of ranges are ids that occur, so no range is empty. Equal ids stay together, ordered by text;
    NULL ids come last. There are at most ``most`` ranges, which stream, so their size does not
    matter for memory; only the borders reach the driver.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    borders: list[int] = []
    if n := source.agg(F.count("doc_id")).first()[0]:
        parts = min(most, -(-n // rows_each))
        found = source.agg(F.percentile_approx("doc_id", [(i + 1) / parts for i in range(parts - 1)] or [1.0], 100 * parts).alias("q"),
                           F.max("doc_id").alias("top")).first()
        borders = sorted({*found.q, found.top}) if parts > 1 else [found.top]
    edges = np.array(borders, np.int64)
    schema = "range int, borrowed int, doc_id long, text string"
    arrow = pa.schema([("range", pa.int32()), ("borrowed", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string())])

    def assign(batches):
        for b in batches:
            ids = b.column(0)
            value = ids.fill_null(int(edges[0]) if len(edges) else 0).to_numpy()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            own = np.searchsorted(edges, value)
            lent = np.flatnonzero(known & (edges[own] == value)) if len(edges) else np.zeros(0, np.int64)
            to = (own[lent] + 1) % max(1, len(edges))
            for rows, where, flag in ((np.arange(b.num_rows), own, 0), (lent, to, 1)):
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int32()), pa.array(np.full(len(rows), flag), pa.int32()), part.column(0), part.column(1)], schema=arrow)

    return (source.mapInArrow(assign, schema).repartitionByRange(max(1, len(edges)), "range")
            .sortWithinPartitions(F.col("range").desc(), "borrowed", F.col("doc_id").desc_nulls_last(), "text"))


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


_COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


def _compare(batches):
    """Fingerprints of rows in sequence, of their edited texts, and likenesses."""

    def some(rows, more):
        """Results of all rows but the last, which is there as a successor; of that too if no more come."""
        texts = [r[3] for r in rows]
        own = [i for i, r in enumerate(rows[:-1] if more else rows) if not r[1]]
        after = [min(i + 1, len(rows) - 1) for i in own]
        changed = [edited(texts[i], texts[k]) for i, k in zip(own, after)]
        prints, others = fingerprints(texts), fingerprints(changed)
        columns = ([rows[i][2] for i in own], [len(texts[i]) for i in own],
                   [hashlib.sha256(c.encode("utf-8", "replace")).hexdigest() for c in changed],
                   [to_string(prints[i]) for i in own], [to_string(p) for p in others],
                   [likeness(prints[i], p) for i, p in zip(own, others)],
                   [likeness(prints[i], prints[k]) for i, k in zip(own, after)])
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = [x.split()[0] for x in _COMPARED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    held, size = [], 0
    for b in batches:
        ranges, flags, ids = (b.column(k).to_pylist() for k in range(3))
        for row in zip(ranges, flags, ids, texts_in(b.column(3))):
            held.append(row)
            size += len(row[3])
            if size > SLICE and len(held) > 1:
                yield some(held, True)
                held, size = held[-1:], len(row[3])
    if held:
        yield some(held, False)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and how like these and the next texts are.

    The edited text has its last third (rounded down) replaced by as many first characters of the
    next document, in descending doc_id; after the last comes the first. A single document follows
    itself. NULL counts as the empty text. Texts are shuffled once.
    """
    return in_sequence(docs).mapInArrow(_compare, _COMPARED)


def op4_syncmers(spark, sf_dir) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
