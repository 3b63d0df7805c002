"""Training-data pipeline over the documents table: each stage calls one operator of ``hazardlake.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread
as the next one's docs. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardlake.llm.common import fresh, stored, table
from hazardlake.llm.line_dedup import dedup_lines
from hazardlake.llm.mixing import mixed
from hazardlake.llm.near_dup import jaccard_classes
from hazardlake.llm.pieces import encode
from hazardlake.llm.toxicity import REJECT, learn, score


def _with_chars(docs: DataFrame) -> DataFrame:
    """``n_chars``, where documents have it, follows the text."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7, learnt from the labels that may be learnt."""
    network = learn(docs, table(spark, sf_dir, "labels"))
    to, = fresh(docs, "_toxicity")
    return score(docs, network, to=to).where(F.col(to) < REJECT).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of 20 characters or more that three documents have; the last keeps them."""
    return _with_chars(dedup_lines(docs)).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least doc_id, one row of it; rows without doc_id stay.

    A text without words has no shingles and is near to none, so it stays too. Where rows of one doc_id
    have different texts, each text is a document: one keeps the doc_id, the others come last in
    their classes, so no text is lost but to a near copy. Of rows alike in doc_id and text that of the
    least hash stays.
    """
    key, least, most = fresh(docs, "_key", "_least", "_most")
    version = F.xxhash64("text")
    texts = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(version).alias(least), F.max(version).alias(most))
    several = texts.where(F.col(least) != F.col(most)).drop(most)
    later = F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    keyed = docs.join(several, "doc_id", "left").withColumn(
        key, F.when(F.col(least).isNull() | (version == F.col(least)), F.col("doc_id")).otherwise(later))
    classes = jaccard_classes(keyed.select(F.col(key).alias("doc_id"), "text"))
    others = classes.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias(key)).distinct()
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    first = keyed.where(F.col("doc_id").isNotNull() & worded).join(others, key, "left_anti")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns)))
    return (first.withColumn(least, place).where(F.col(least) == 1).select(*docs.columns)
            .unionByName(docs.where(F.col("doc_id").isNull() | ~worded)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: a row for each time, none for 0."""
    return mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    encoded = encode(docs.select("doc_id", "text"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Scores, similarities of sampled signatures, budgets and encodings have no SQL; tests hold every
#: stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
