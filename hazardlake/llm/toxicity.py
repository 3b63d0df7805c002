"""Toxicity scores of whole documents by a recurrent network over all overlapping windows."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_slices
from .gru import Network, train

#: Labelled clean and toxic documents that are learnt from, and characters of one, at most.
SAMPLE, LONGEST = (1500, 500), 50_000
REJECT = 0.7


def held_out(doc_id):
    """Whether a document's label may not be learnt."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, longest: int = LONGEST) -> Network | None:
    """A network fitted in one task to a bounded sample of the labels that may be learnt.

    The sample holds at most ``sample`` clean and toxic documents, the first by a hash of doc_id,
    with texts of at most ``longest`` characters. A document is toxic if any of its labels says so.
    Only the network reaches the driver; None if the sample does not have both classes.
    """
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text")
    parts = []
    for toxic in (1, 0):
        ids = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[toxic])
        parts.append(texts.join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text").limit(2 * sample[toxic])
                     .select("doc_id", F.col("text").cast("binary").alias("text"), F.col("toxic").cast("long").alias("toxic")))

    def fit(batches):
        found, marks = [], []
        for b in batches:
            found += b.column(1).to_pylist()
            marks += b.column(2).to_pylist()
        net = train(found, np.array(marks, np.int64)) if found else None
        if net:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(net))], pa.binary())], names=["network"])

    fitted = (parts[0].unionByName(parts[1]).repartition(1).sortWithinPartitions(F.desc("toxic"), "doc_id", "text")
              .mapInArrow(fit, "network binary").first())
    if not fitted:
        return None
    network = object.__new__(Network)
    vars(network).update(pickle.loads(fitted.network))
    return network


def score(docs: DataFrame, network: Network | None, to: str = "score") -> DataFrame:
    """Add the probability that a text is toxic, that of its worst window.

    Whole texts are read, in slices; NULL, empty and wordless texts get the network's probability
    of nothing, and all texts 0 if there is no network. A column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kept = [f for f in docs.schema.fields if f.name != to]
    names = [f.name for f in kept]

    def run(batches):
        net = shared.value
        for b in batches:
            for i, j, texts in text_slices(b.column("text")):
                part = b.slice(i, j - i)
                found = net.scores(texts) if net else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found, pa.float64())], names=[*names, to])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(to, T.DoubleType())]))


def op3_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, network).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                       (F.col("score") >= REJECT).cast("int").alias("predicted"))
