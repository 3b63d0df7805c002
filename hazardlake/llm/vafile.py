"""Exact top-k search with a vector-approximation file.

Every component is quantised to a cell of its dimension. Products of a query with the edges of a
vector's cells bound the true score from both sides. A scan of the cells gives every query a floor,
the kth largest lower bound seen; vectors whose upper bound is below it are out. Of the others the
exact vectors are read from the largest upper bound down, until no upper bound left reaches the kth
exact score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Cells per dimension, queries that one scan serves, and rows whose bounds are held at once.
CELLS, QUERIES, ROWS = 64, 2048, 1024
#: Stands where a query has no kth vector yet.
NOBODY = np.iinfo(np.int64).max


def scaled(embeddings: DataFrame, factor: int = 256) -> DataFrame:
    """(vec_id, v): components as floor(factor * x), of vectors whose components are all finite.

    Only vectors of the most frequent length take part, of equally frequent ones the longest; empty
    ones never do.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = embeddings.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad)
    usual = sound.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return (sound.where(F.size("embedding") == (usual.dims if usual else 0))
            .select(F.col("vec_id").cast("long"),
                    F.transform("embedding", lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("long")).alias("v")))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


class Cells:
    """Edges of equal cells between the least and the largest value of each dimension."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int = CELLS):
        self.low, self.cells = low, cells
        self.width = np.maximum(1, -((low - high - 1) // cells))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.width).astype(np.uint8)

    def bounds(self, cells: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of all vectors in these cells with all queries."""
        first = (self.low + cells * self.width).astype(np.float64)
        last = first + (self.width - 1)
        up, down = np.maximum(queries, 0).T.astype(np.float64), np.minimum(queries, 0).T.astype(np.float64)
        return first @ up + last @ down, last @ up + first @ down


def build(vectors: DataFrame, cells: int = CELLS) -> tuple[DataFrame, Cells]:
    """The approximation file: (vec_id, dims, cells, v), written once to the shared folder."""
    spread = (vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.min("x"), F.max("x")).orderBy("i").collect())
    grid = Cells(np.array([r[1] for r in spread], np.int64), np.array([r[2] for r in spread], np.int64), cells)

    def quantise(batches):
        for b in batches:
            codes = grid.of(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1)],
                                             names=["vec_id", "cells", "v"])

    return stored(vectors.mapInArrow(quantise, "vec_id long, cells binary, v array<long>")), grid


def _search(grid: Cells, asked: np.ndarray, queries: np.ndarray, k: int):
    """Scan one partition: the k best of its vectors for every query."""

    def run(batches):
        n = len(asked)
        best = np.full((n, k), -(1 << 62))
        who = np.full((n, k), NOBODY)
        floor = np.full(n, -np.inf)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids = part.column(0).to_numpy()
                cells = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)
                lower, upper = grid.bounds(cells, queries)
                itself = ids[:, None] == asked
                lower[itself] = upper[itself] = -np.inf
                # Rows that repeat a vec_id count once: k different ones must reach the floor.
                by_id = np.argsort(ids, kind="stable")
                first = np.flatnonzero(np.diff(ids[by_id], prepend=ids[by_id[0]] - 1))
                least = lower if len(first) == len(ids) else np.maximum.reduceat(lower[by_id], first)
                if len(least) >= k:
                    floor = np.maximum(floor, np.partition(least, len(least) - k, axis=0)[len(least) - k])
                floor = np.maximum(floor, best[:, -1])
                open_ = upper >= floor
                exact = _matrix(part.column(2))
                for q in np.flatnonzero(open_.any(axis=0)).tolist():
                    rows = np.flatnonzero(open_[:, q])
                    rows = rows[np.argsort(-upper[rows, q], kind="stable")]
                    for i in range(0, len(rows), 64):
                        some = rows[i:i + 64]
                        if upper[some[0], q] < best[q, -1]:
                            break
                        score, ident = np.append(best[q], exact[some] @ queries[q]), np.append(who[q], ids[some])
                        order = np.lexsort((ident, -score))
                        if len(set(ident[order[:k]].tolist())) < k:  # of each vec_id the best
                            order = order[np.sort(np.unique(ident[order], return_index=True)[1])]
                        order = order[:k]
                        best[q], who[q] = -(1 << 62), NOBODY
                        best[q, :len(order)], who[q, :len(order)] = score[order], ident[order]
        q, r = np.nonzero(who != NOBODY)
        yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(who[q, r]), pa.array(best[q, r])],
                                         names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products.

    Both tables have (vec_id, v), all v of one length; a query is not its own result, ties go to
    the smaller vec_id, and all vectors are results if there are fewer than k. Queries come in
    blocks of ``QUERIES``, which is what a task holds; each block scans the file once, and a
    partition sends at most k different vectors a query on. Rows that repeat a vec_id are one vector
    or one query: the best score of their rows counts. An empty table has no results. Scores must stay below 2^53.
    """
    empty = "query_id long, vec_id long, score long"
    file, grid = build(vectors)
    asked = stored(queries.select("vec_id", "v").distinct())
    n = asked.count()
    spark = vectors.sparkSession
    parts = []
    blocks = -(-n // QUERIES)
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, blocks)))
    for i in range(blocks):
        rows = asked.where(block == i).orderBy("vec_id", "v").toArrow()
        if not rows.num_rows or not len(grid.low):
            continue
        ids, q = rows.column(0).to_numpy(), _matrix(rows.column(1).combine_chunks())
        parts.append(file.mapInArrow(_search(grid, ids, q, k), empty))
    found = spark.createDataFrame([], empty)
    for p in parts:
        found = found.unionByName(p)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_vafile(spark, sf_dir) -> DataFrame:
    vectors = scaled(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE = """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
          FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5"""
