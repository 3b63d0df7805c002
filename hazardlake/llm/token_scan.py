"""Token counts from flat token files without an index, by a scan for the separator."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, table, texts_in
from .pieces import MODEL, SLICE, shared_encoder

#: The end-of-document id of the default model, its </s>, which no text is encoded to.
EOD = 2
BLOCK = 1 << 16

FLAT = "file int, block long, data binary, first long, doc_ids array<long>"
_ARROW = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("first", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64()))])


def write_flat(docs: DataFrame, model: str = MODEL, eod: int = EOD, block_tokens: int = BLOCK) -> DataFrame:
    """Flat token files of documents: ids of 16 bits (32 for larger vocabularies), ``eod`` after each.

    A task writes one file as numbered blocks (file, block, data) that end wherever they are full;
    nothing in them says where a document begins. Rows without data list doc_ids in the order
    written, from ordinal ``first`` on. NULL texts have no ids, only the separator.
    """
    shared = shared_encoder(docs.sparkSession, model)

    def run(batches):
        encoder, file, ordinal, block = shared.value, TaskContext.get().partitionId(), 0, 0
        kind = np.uint16 if len(encoder.pieces) <= 1 << 16 else np.uint32
        held: np.ndarray = np.zeros(0, kind)
        end = np.array([eod], kind)
        for b in batches:
            texts, ids = texts_in(b.column(1)), b.column(0)
            for i, j in slices([len(t) for t in texts], SLICE):
                parts = [held]
                for r in encoder.encode(texts[i:j]):
                    parts += [np.frombuffer(r, np.int32).astype(kind), end] if r else [end]
                held = np.concatenate(parts)
                n = len(held) // block_tokens
                rows = [(file, block + k, held[k * block_tokens:(k + 1) * block_tokens].tobytes(), None, None) for k in range(n)]
                rows.append((file, None, None, ordinal, ids.slice(i, j - i).to_pylist()))
                held, block, ordinal = held[n * block_tokens:].copy(), block + n, ordinal + j - i
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
        if len(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], f.type) for c, f in zip((file, block, held.tobytes(), None, None), _ARROW)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FLAT)


def scan_separators(blocks: DataFrame, eod: int = EOD, width: int = 2) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of every document in blocks (file, block, data).

    Each block is searched on its own. A running sum over a file's blocks, of three numbers a
    block, gives the tokens and documents before it, and a running maximum the place of the last
    separator before it, where the document that is open at its start begins. Blocks may have any
    length and hold no separator. Tokens after a file's last separator are a document that has not
    ended. Files without tokens have no documents; NULL data count as none.
    """
    kind = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[width]

    def search(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column(2)[i].as_py() or b"", kind)
                ends = np.flatnonzero(ids == eod)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([len(ids)], pa.int64()),
                     pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "n", "ends"])

    found = blocks.select("file", "block", "data").mapInArrow(search, "file int, block long, n long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("tokens"),
                          F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs"),
                          F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("final"))
    placed = placed.withColumn("ends", F.transform("ends", lambda e: e + F.col("tokens")))
    opened = placed.withColumn("open", F.coalesce(F.max(F.try_element_at("ends", F.lit(-1)) + 1).over(before), F.lit(0)))
    tail = F.col("tokens") + F.col("n")
    begins = F.concat(F.array("open"), F.transform("ends", lambda e: e + 1))
    # A last block's tail closes one more document if it holds tokens.
    unended = F.col("final") & (F.element_at("begins", -1) < tail)
    rows = (opened.withColumn("begins", begins)
            .withColumn("stops", F.when(unended, F.concat("ends", F.array(tail))).otherwise(F.col("ends")))
            .select("file", "docs", F.size("ends").alias("n_ends"), "begins",
                    F.posexplode("stops").alias("i", "stop")))
    start = F.get("begins", F.col("i"))
    return rows.select("file", (F.col("docs") + F.col("i")).alias("ordinal"), start.alias("start"),
                       (F.col("stop") - start).alias("n_tokens"), (F.col("i") < F.col("n_ends")).alias("ended"))


def op10_token_counts(spark, sf_dir) -> DataFrame:
    flat = stored(write_flat(table(spark, sf_dir, "documents")))
    counts = scan_separators(flat.where(F.col("data").isNotNull()))
    written = (flat.where(F.col("doc_ids").isNotNull())
               .select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id"))
               .select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id"))
    return counts.join(written, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "start")
