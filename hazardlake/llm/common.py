"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlake.sources.tables import checkpoint_dir

#: Characters that separate words, and the words between them as a Java pattern.
SPACE = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the folder that all executors share and go on from the files.

    Cuts the lineage like a checkpoint, but in columns and compressed. The files go when the
    session ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before those that are columns of ``docs`` already."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def word_count(text):
    """Words of a text as a column; NULL and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def slices(sizes, budget: int = 4 << 20):
    """Cut rows with these sizes into runs of about ``budget`` bytes, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(column, budget: int = 1 << 20):
    """Runs (i, j, texts as UTF-8 bytes) of a text column; NULL is empty. Only a run is unpacked."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, j in slices(sizes, budget):
        yield i, j, pc.fill_null(column.slice(i, j - i).cast(pa.binary()), b"").to_pylist()


def texts_in(column) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
