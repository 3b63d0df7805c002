"""Line dedup in DataFrame functions only: explode, hash, count documents, drop, reassemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, fresh


def line_key(line):
    """A line without blanks at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _numbered(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, text hash, line number, two hashes) of every line long enough to count."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("_version"),
                        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("_pos", "_line"))
    keys = lines.select("doc_id", "_version", "_pos", line_key(F.col("_line")).alias("_key"))
    return (keys.where(F.length("_key") >= min_chars)
            .select("doc_id", "_version", "_pos", F.xxhash64("_key").alias("_h1"),
                    F.xxhash64(F.lit(1), F.col("_key")).alias("_h2")))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Drop lines found in ``min_docs`` or more documents, except in the largest doc_id with them.

    Returns the columns of ``docs`` with the remaining text, and ``n_lines`` (before) and
    ``n_dropped``; columns of these two names are replaced, all others pass through. A NULL or
    empty text is one empty line. Rows that share a doc_id are one document, so repeated rows
    are treated alike; rows without doc_id neither count nor lose lines. Hashes have 128 bits.
    Counts are summed before the shuffle, so a line that is everywhere is no hot group there; on
    the way back adaptive execution splits its rows.
    """
    lines = _numbered(docs, min_chars)
    frequent = (lines.groupBy("_h1", "_h2")
                .agg(F.count_distinct("doc_id").alias("_n"), F.max("doc_id").alias("_last"))
                .where(F.col("_n") >= min_docs))
    version, whole_lines, gone = fresh(docs, "_version", "_lines", "_dropped")
    dropped = (lines.join(frequent, ["_h1", "_h2"]).where(F.col("doc_id") < F.col("_last"))
               .groupBy("doc_id", F.col("_version").alias(version)).agg(F.collect_set("_pos").alias(gone)))
    passed = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = docs.select(*passed, F.xxhash64("text").alias(version),
                        F.split(F.coalesce("text", F.lit("")), "\n").alias(whole_lines))
    found = whole.drop("text").join(dropped, ["doc_id", version], "left")
    every = F.sequence(F.lit(0), F.size(whole_lines) - 1)
    kept = F.transform(F.array_except(every, gone), lambda p: F.get(whole_lines, p))
    text = F.array_join(F.when(F.col(gone).isNull(), F.col(whole_lines)).otherwise(kept), "\n")
    return found.select(*[text.alias("text") if c == "text" else F.col(c) for c in passed],
                        F.size(whole_lines).cast("long").alias("n_lines"),
                        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))


def op5_line_dedup(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def sql(documents: str = "documents", columns: str = "") -> str:
    """The same in DuckDB's SQL: rows (doc_id, lines, kept) from a table with doc_id and text."""
    blanks = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    return f"""
    WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents}),
    lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split),
    keyed AS (SELECT *, translate(trim(line, {blanks}), '{UPPER}', '{LOWER}') AS k FROM lines),
    often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20
              GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
    marked AS (SELECT keyed.doc_id, line, i, coalesce(keyed.doc_id < last, false) AS gone
               FROM keyed LEFT JOIN often ON keyed.k = often.k)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
    FROM marked GROUP BY doc_id"""


ORACLE = f"SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM ({sql()})"
