"""Readers, writers and lineage cuts."""

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = {"csv": ",", "tsv": "\t"}


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL at ingest, so that aggregates skip it."""
    return df.select(*[
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def read_csv(spark: SparkSession, path: str, schema, sep: str = ",") -> DataFrame:
    """Delimited text with a header. The schema is given, so the file is read once."""
    return nan_to_null(
        spark.read.csv(path, header=True, schema=schema, sep=sep, nullValue="NA", escape='"')
    )


def read_tsv(spark: SparkSession, path: str, schema) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def write_results(df: DataFrame, path: str, fmt: str = "csv", partition_by=()) -> None:
    """Write ``df`` as csv, tsv or another format; NULL is NA in text, as the readers expect it."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt in TEXT:
        writer.csv(path, header=True, escape='"', sep=TEXT[fmt], nullValue="NA")
    else:
        writer.format(fmt).save(path)


def stage(df: DataFrame, path: str, partition_by=()) -> DataFrame:
    """Write a pipeline stage to shared storage and go on from the written table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, inputs, settings: dict) -> str:
    """A name for what a stage is made from: files (or folders of files) with sizes and times, and settings."""
    found = []
    for path in inputs:
        place, system = _place(spark, path)
        top = system.getFileStatus(place)
        for status in system.listStatus(place) if top.isDirectory() else [top]:
            found.append([status.getPath().toString(), status.getLen(), status.getModificationTime()])
    text = json.dumps([sorted(found), settings], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def finished_stage(spark: SparkSession, folder: str, name: str, inputs, settings: dict, build) -> DataFrame:
    """The table of stage ``name`` below ``folder``: read if it is finished, else made by ``build()`` and written.

    A stage is known by the fingerprint of its input files and settings. One without Spark's mark
    of success was cut off and is written anew. Once a stage is written, its versions of other
    fingerprints are deleted, so a folder holds one version of every stage. A stage name belongs
    to one run at a time.
    """
    now = fingerprint(spark, inputs, settings)
    path = f"{folder}/{name}/{now}"
    mark, system = _place(spark, f"{path}/_SUCCESS")
    if not system.exists(mark):
        build().write.mode("overwrite").parquet(path)
        for status in system.listStatus(_place(spark, f"{folder}/{name}")[0]):
            if status.getPath().getName() != now:
                system.delete(status.getPath(), True)
    return spark.read.parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; it goes when the session ends."""
    path = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    return path


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Only a session whose executors are threads of the driver may leave it unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="hazardlake-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by ``spark.checkpoint.dir``."""
    sc = df.sparkSession.sparkContext
    folder = checkpoint_dir(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()


SMALL_ROWS = 500_000  # rows of a table of statistics that every executor may hold


def beside(df: DataFrame) -> DataFrame:
    """A table of statistics, checkpointed, for joins with far longer tables.

    Up to SMALL_ROWS rows it is broadcast, so that the long table is not shuffled; its size is counted,
    as adaptive execution learns it only after the long side has been written.
    """
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def stored(df: DataFrame) -> DataFrame:
    """The rows as Parquet in a scratch folder: a checkpoint that keeps repeated keys once a page."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
