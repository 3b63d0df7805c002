"""Substring dedup: documents are parsed into factors that occur in earlier documents.

The reference is the whole corpus, indexed in blocks: every window of ``width`` words belongs to
the block of its anchor, the k-gram with the least hash in it, and every document is factored
against all blocks that own one of its windows. A segment is a longest run of windows with one
anchor place. Copies of whole segments are found by their hashes while a block streams by in sorted
order; only where an anchor has several different segments are single windows looked up. The parse
is greedy: a factor grows as long as its windows continue in the same place of the same earlier
document; windows across the border of two factors are looked up like all others, so a duplicate
that no one factor holds is found too.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stored, table, text_slices
from .hashing import Words

WIDTH, GRAM = 13, 5
#: A span is its first window's place times this, plus its number of windows.
PACK = 16

_KEYED = "anchor long, segment long, segment2 long, doc_id long, version long, span long"
_SPANS = "doc_id long, version long, span long, ref_doc long, ref_span long"
_KEYED_ARROW = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("span", pa.int64())])
#: With the second of a segment's two hashes, as blocks are made.
_TWICE_ARROW = _KEYED_ARROW.insert(2, pa.field("segment2", pa.int64()))
_SPAN_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "version", "span", "ref_doc", "ref_span")])


def _record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
                                      schema=schema)


def _without_reference(doc, version, span) -> pa.RecordBatch:
    return _record(_SPAN_ARROW, doc, version, span, *[pa.nulls(len(doc), pa.int64())] * 2)


def _segments(words: Words, width: int, gram: int):
    """Anchor, two segment hashes, text row, first window (in its text) and windows of all segments."""
    n = len(words.h) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none, none, none, none, none
    keys = words.grams(gram, 1)
    best, place = keys[:n].copy(), np.arange(n)
    for j in range(1, width - gram + 1):
        less = keys[j:j + n] < best
        place = np.where(less, np.arange(j, j + n), place)
        np.minimum(best, keys[j:j + n], out=best)
    inside = np.flatnonzero(words.row[:n] == words.row[width - 1:])
    if not len(inside):
        return none.view(np.uint64), none, none, none, none, none
    p, r = place[inside], words.row[inside]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (r[1:] != r[:-1])]))
    start, count = inside[new], np.diff(np.append(new, len(inside)))
    # Rows of one block share the anchor, so there only these hashes tell segments apart.
    one, two = (words.run(words.sums(salt), start, start + count + width - 1).view(np.int64) for salt in (2, 5))
    return keys[p[new]], one, two, r[new], start - words.first[r[new]], count


def _with_version(docs: DataFrame, version: str) -> DataFrame:
    """Add 0, or a hash of the text where rows of one doc_id have different texts."""
    least, most = fresh(docs, "_least", "_most")
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    several = stored(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(text).alias(least), F.max(text).alias(most))
                     .where(F.col(least) != F.col(most)).select("doc_id", least))
    own = F.when(F.col(least).isNotNull(), text).otherwise(F.lit(0))
    return docs.join(several, "doc_id", "left").withColumn(version, own).select(*docs.columns, version)


def _keyed_spans(docs: DataFrame, version: str, width: int, gram: int, repeats: bool) -> DataFrame:
    """Segments of documents, combined by slice: of equal ones those of the least doc_id go on.

    With ``repeats``: the others, which are copies of these. So a passage that is everywhere sends
    one row a slice to its block.
    """

    def run(batches):
        for b in batches:
            ids = b.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids, versions = ids.fill_null(0).to_numpy(), b.column(2).to_numpy()
            for i, j, texts in text_slices(b.column(1)):
                anchor, one, two, row, start, count = _segments(Words(texts), width, gram)
                keep = known[i:j][row]
                anchor, one, two, row, start, count = (x[keep] for x in (anchor, one, two, row, start, count))
                doc, ver, span = ids[i:j][row], versions[i:j][row], start * PACK + count
                order = np.lexsort((span, ver, doc, two, one, anchor))
                anchor, one, two, doc, ver, span = (x[order] for x in (anchor, one, two, doc, ver, span))
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])[:len(anchor)]
                head = np.flatnonzero(new)[np.cumsum(new) - 1]
                copy = doc != doc[head]
                if repeats:
                    yield _record(_SPAN_ARROW, doc[copy], ver[copy], span[copy], doc[head][copy], span[head][copy])
                else:
                    yield _record(_TWICE_ARROW, *(x[~copy] for x in (anchor.view(np.int64), one, two, doc, ver, span)))

    return docs.select(F.col("doc_id").cast("long"), "text", version).mapInArrow(run, _SPANS if repeats else _KEYED)


def _resolve(batches):
    """Spans of a block, sorted by (anchor, segment hashes, doc_id, version, span), as they stream by.

    A segment's later documents refer to its first one. Spans of first documents come without a
    reference if their anchor has other segments too, whose windows they may share.
    """
    anchor = segments = doc = span = None  # of the group open at the end of the last batch
    several, held = False, [np.zeros(0, np.int64)] * 3
    for b in batches:
        if not b.num_rows:
            continue
        a, *hashes, d, v, p = (c.to_numpy() for c in b.columns)
        new_anchor = np.concatenate([[anchor is None or a[0] != anchor], a[1:] != a[:-1]])
        new = new_anchor.copy()
        for k, s in enumerate(hashes):
            new |= np.concatenate([[segments is None or s[0] != segments[k]], s[1:] != s[:-1]])
        group = np.cumsum(new)
        at = np.flatnonzero(new)
        first_doc = np.concatenate([[0 if doc is None else doc], d[at]])[group]
        first_span = np.concatenate([[0 if span is None else span], p[at]])[group]
        own = d == first_doc
        # Segments of each anchor so far; number 0 goes on from the last batch.
        number = np.cumsum(new_anchor)
        kinds = np.bincount(number, new, minlength=number[-1] + 1)
        kinds[0] += (1 + several) if anchor is not None else 0
        many = kinds > 1
        if many[0]:
            yield _without_reference(*held)
        if many[0] or number[-1] > 0:
            held = [x[:0] for x in held]
        check = own & many[number]
        wait = own & ~many[number] & (number == number[-1])
        held = [np.concatenate([x, y[wait]]) for x, y in zip(held, (d, v, p))]
        yield _record(_SPAN_ARROW, d[~own], v[~own], p[~own], first_doc[~own], first_span[~own])
        yield _without_reference(d[check], v[check], p[check])
        anchor, segments, doc, span = a[-1], [s[-1] for s in hashes], first_doc[-1], first_span[-1]
        several = bool(many[number[-1]])


def _windows(width: int):
    """Hashes of the windows in the given spans of each text."""
    schema = pa.schema([(c, pa.int64()) for c in ("w1", "w2", "doc_id", "version", "place")])

    def run(batches):
        for b in batches:
            spans = b.column(3)
            asked = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            b = b.take(pa.array(asked))
            for i, j, texts in text_slices(b.column(1)):
                words, part = Words(texts), b.slice(i, j - i)
                lists = part.column(3)
                size = lists.value_lengths().to_numpy()
                flat = lists.flatten().to_numpy()
                row = np.repeat(np.arange(j - i), size)
                count = flat % PACK
                place = np.repeat(flat // PACK, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                row = np.repeat(row, count)
                at = place + words.first[row]
                fits = at + width <= words.first[row + 1]
                at, row, place = at[fits], row[fits], place[fits]
                w1, w2 = (words.run(words.sums(salt), at, at + width).view(np.int64) for salt in (3, 4))
                yield _record(schema, w1, w2, part.column(0).to_numpy()[row], part.column(2).to_numpy()[row], place)

    return run


def _removed(lists: pa.ListArray, first: np.ndarray, width: int):
    """Greedy parse: factors (row, start, length, ref_doc, ref_start) and the words they cover."""
    size = lists.value_lengths().fill_null(0).to_numpy()
    flat = lists.flatten()
    span, ref_doc, ref_span = (flat.field(k).to_numpy() for k in ("span", "ref_doc", "ref_span"))
    row = np.repeat(np.arange(len(size)), size)
    start, count, ref = span // PACK, span % PACK, ref_span // PACK
    order = np.lexsort((start, row))
    row, start, count, ref, ref_doc = (x[order] for x in (row, start, count, ref, ref_doc))
    goes_on = ((row[1:] == row[:-1]) & (start[1:] == start[:-1] + count[:-1]) & (ref_doc[1:] == ref_doc[:-1])
               & (ref[1:] - start[1:] == ref[:-1] - start[:-1]))
    head = np.flatnonzero(np.concatenate([[True], ~goes_on])[:len(row)])
    stop = np.append(head[1:], len(row)) - 1 if len(head) else head
    length = start[stop] + count[stop] + width - 1 - start[head]
    change = np.zeros(first[-1] + 1, np.int64)
    begin = first[row[head]] + start[head]
    np.add.at(change, begin, 1)
    np.add.at(change, np.minimum(begin + length, first[row[head] + 1]), -1)
    return (row[head], start[head], length, ref_doc[head], ref[head]), np.cumsum(change[:-1]) > 0


def remove_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Remove each word covered by a window of ``width`` words that an earlier document also has.

    Earlier means a smaller doc_id. Words are runs of other characters than ASCII white space,
    unchanged. Returns the columns of ``docs`` with the kept words joined by blanks as text, and
    ``n_words``, ``n_removed`` and ``factors`` (start, length, ref_doc, ref_start, in words; factors
    may overlap at their borders). Columns of these three names are replaced, others pass through.
    NULL and empty texts have no words. Rows without doc_id lose and remove nothing. Rows that
    repeat a doc_id never remove each other; where their texts differ each is parsed on its own. Segments and windows are compared by 128 bits of hash.
    """
    if not gram < width < PACK + gram:
        raise ValueError("gram < width < gram + 16")
    kept = [f for f in docs.schema.fields if f.name not in ("n_words", "n_removed", "factors")]
    names = [f.name for f in kept]
    version, spans = fresh(docs, "_version", "_spans")
    # Documents are read by both joins below in the same form, so they are shuffled once.
    base = _with_version(docs.select(*names), version)
    keyed = _keyed_spans(base, version, width, gram, repeats=False)
    blocks = keyed.repartition("anchor").sortWithinPartitions("anchor", "segment", "segment2", "doc_id", "version", "span")
    resolved = stored(blocks.mapInArrow(_resolve, _SPANS))
    one = ["doc_id", F.col("version").alias(version)]  # sets, as rows alike in both find the same
    asked = resolved.where(F.col("ref_doc").isNull()).groupBy(*one).agg(F.collect_set("span").alias(spans))
    windows = (base.join(asked, ["doc_id", version], "left").select(F.col("doc_id").cast("long"), "text", version, spans)
               .mapInArrow(_windows(width), "w1 long, w2 long, doc_id long, version long, place long"))
    index = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "place")).alias("ref"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = (windows.join(index, ["w1", "w2"]).where(F.col("ref.doc_id") < F.col("doc_id"))
             .select("doc_id", "version", (F.col("place") * PACK + 1).alias("span"), F.col("ref.doc_id").alias("ref_doc"),
                     (F.col("ref.place") * PACK + 1).alias("ref_span")))
    factors = (resolved.where(F.col("ref_doc").isNotNull()).unionByName(found)
               .unionByName(_keyed_spans(base, version, width, gram, repeats=True))
               .groupBy(*one).agg(F.collect_set(F.struct("span", "ref_doc", "ref_span")).alias(spans)))
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("factors", T.ArrayType(T.StructType(
                               [T.StructField(x, T.LongType()) for x in ("start", "length", "ref_doc", "ref_start")])))])

    def parse(batches):
        for b in batches:
            at = b.schema.names.index("text")
            for i, j, texts in text_slices(b.column("text")):
                part = b.slice(i, j - i)
                words = [t.split() for t in texts]
                n = np.array([len(w) for w in words])
                first = np.concatenate([[0], np.cumsum(n)])
                (row, *columns), gone = _removed(part.column(spans), first, width)
                out = [b" ".join(compress(w, (~gone[first[k]:first[k + 1]]).tolist())).decode() for k, w in enumerate(words)]
                lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
                offsets = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
                factors = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["start", "length", "ref_doc", "ref_start"]))
                own = [part.column(x) for x in names]
                own[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(lost, pa.int64()), factors],
                                                 names=[*names, "n_words", "n_removed", "factors"])

    return base.join(factors, ["doc_id", version], "left").select(*names, spans).mapInArrow(parse, schema)


def op1_substring_dedup(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
    w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
          FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM d WHERE len(ws) >= 13)),
    f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
    gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM w JOIN f USING (k) WHERE first < doc_id),
    words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
    left_over AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS kept, count(*) AS n
                  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i WHERE gone.i IS NULL GROUP BY words.doc_id)
    SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN left_over USING (doc_id)"""
