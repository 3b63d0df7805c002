"""Matrix blocks of model rows and their distributed sums.

A model step (one gradient, one Gram matrix, one assignment round) is one scan over the rows:
every task turns its Arrow batches into numpy blocks and emits one vector of partial sums, and
the vectors are added in a tree. What reaches the driver has the size of the model, not of the
data. All models of a run (folds, modalities, combinations) share each scan: ``grp`` names the
model a row belongs to.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.sources.tables import cut_lineage

SEGMENT = 1 << 17     # doubles per segment in the tree
PARTITION_BYTES = 64 << 20


class ModelRows:
    """Rows of one or more models, checkpointed, spread evenly and cached for many scans."""

    def __init__(self, df: DataFrame, columns=()):
        spark = df.sparkSession
        df = cut_lineage(df.select("grp", "sample_id", *columns, "features"))
        sizes = df.groupBy("grp").agg(
            F.count("*").alias("n"), F.max(F.size("features")).alias("p"),
            F.min(F.size("features")).alias("p_min"),
            F.count_if(F.exists("features", lambda v: v.isNull())).alias("gaps"))
        models = sorted(sizes.collect(), key=lambda r: r["grp"])
        bad = [r["grp"] for r in models if r["p"] != r["p_min"] or r["gaps"]]
        if bad:
            raise ValueError(f"feature vectors of unequal length or with NULLs in models {bad}")
        self.groups = [r["grp"] for r in models]
        self.n = np.array([r["n"] for r in models], dtype=float)
        self.p = [r["p"] for r in models]
        # Enough partitions for the cores, and for none to hold more than PARTITION_BYTES.
        volume = 8 * sum(n * p for n, p in zip(self.n, self.p))
        self.partitions = max(spark.sparkContext.defaultParallelism, math.ceil(volume / PARTITION_BYTES))
        names = F.array(*[F.lit(g) for g in self.groups])
        self.df = (df.withColumn("gid", (F.array_position(names, F.col("grp")) - 1).cast("int"))
                   .repartition(self.partitions, "grp", "sample_id").sortWithinPartitions("gid")
                   .persist(StorageLevel.MEMORY_AND_DISK))

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.df.unpersist()

    def sums(self, add, size: int) -> np.ndarray:
        """Sum over all tasks of the vector that ``add(gid, columns, total)`` fills in place."""
        def run(batches):
            total, seen = np.zeros(size), False
            for batch in batches:
                for gid, cols in split_models(batch):
                    add(gid, cols, total)
                    seen = True
            if seen:
                part = TaskContext.get().partitionId()
                for seg in range(0, size, SEGMENT):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([seg], pa.int64()),
                         pa.array([total[seg:seg + SEGMENT].tobytes()], pa.binary())],
                        names=["part", "seg", "payload"])
        parts = self.df.mapInArrow(run, "part int, seg bigint, payload binary")
        fan = max(1, math.isqrt(self.partitions))
        for slot in (F.col("part") % fan, F.lit(0)):
            parts = (parts.withColumn("part", slot.cast("int")).groupBy("part", "seg")
                     .applyInPandas(_add_payloads, "part int, seg bigint, payload binary"))
        total = np.zeros(size)
        for row in sorted(parts.collect(), key=lambda r: (r["seg"], r["part"])):
            piece = np.frombuffer(row["payload"])
            total[row["seg"]:row["seg"] + len(piece)] += piece
        return total

    def map(self, fn, schema: str) -> DataFrame:
        """Row output of a fitted model: ``fn(gid, columns)`` returns a dict of arrays."""
        names = [f.split()[0] for f in schema.split(", ")]
        def run(batches):
            for batch in batches:
                for gid, cols in split_models(batch):
                    out = fn(gid, cols)
                    yield pa.RecordBatch.from_arrays([to_arrow(out[c]) for c in names], names=names)
        return self.df.mapInArrow(run, schema)


def _add_payloads(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b) for b in pdf.sort_values("payload")["payload"])
    return pd.DataFrame({"part": pdf["part"][:1], "seg": pdf["seg"][:1],
                         "payload": [total.tobytes()]})


def to_arrow(values):
    if isinstance(values, np.ndarray) and values.ndim == 2:
        flat = pa.array(np.ascontiguousarray(values).ravel())
        offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), flat)
    return values if isinstance(values, pa.Array) else pa.array(values)


def split_models(batch):
    """(model, columns) per model in a batch; list columns become 2-D float blocks."""
    gids = batch.column("gid").to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, gids[1:] != gids[:-1]]) if len(gids) else []
    for a, b in zip(starts, np.r_[starts[1:], len(gids)] if len(gids) else []):
        part = batch.slice(int(a), int(b - a))
        cols = {}
        for name, col in zip(part.schema.names, part.columns):
            if pa.types.is_list(col.type):
                cols[name] = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
            elif pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
                cols[name] = col
            else:
                cols[name] = col.to_numpy(zero_copy_only=False)
        yield int(gids[a]), cols
