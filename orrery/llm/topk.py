"""Exact top-k inner products by distributed histogram selection.

Queries come in blocks of bounded size, each sent to all tasks.  For a block every row is scored in each round, and each
task reports for each query how many scores fall into each bin.  The global histogram tells which bin holds the k-th best
score; the next round splits that bin, until a bin is one integer and the k-th value is known exactly.  A last pass keeps
what is above that value, and of the ties the smallest ids.

A task reports only bins from that of its own k-th best score up: the global k-th score is never lower, so that all counts
that decide are whole.  Of ties at the k-th value a task hands on its k smallest ids; no others can be chosen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, table

#: Queries sent to the tasks at once: BLOCK x dimensions x 8 bytes, 2 MB for 64 dimensions.
BLOCK = 4096
#: The widths of the bins, as powers of two, round by round; the last must be 0.
SHIFTS = (10, 0)
SCALE = 256.0
_LEAST = -(2**63)


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): rows with an id and a vector of finite components."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        "id IS NOT NULL AND v IS NOT NULL AND forall(v, c -> c IS NOT NULL AND abs(c) < double('infinity'))")


def _vectors(column: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of dimensions: the rows' places, and their vectors as integers held in doubles."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale), np.concatenate([[0], np.cumsum(lengths)])
    out = {}
    for d in np.unique(lengths):
        at = np.nonzero(lengths == d)[0]
        out[int(d)] = at, flat[starts[at][:, None] + np.arange(d)[None, :]].reshape(len(at), int(d))
    return out


def _scores(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles while they hold every partial sum, else Python's integers, held within a long."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, q.shape[1]) < 2**53:
        return q @ rows.T
    exact = np.frompyfunc(int, 1, 1)
    return np.clip(np.dot(exact(q), exact(rows).T), _LEAST + 1, 2**63 - 1).astype(np.int64)


class Block:
    """A block of queries as the tasks see it."""

    def __init__(self, ids: np.ndarray, vectors: pa.Array, scale: float):
        self.ids, self.by_dim, self.scale = ids, _vectors(vectors, scale), scale

    def scored(self, batches: Iterator[pa.RecordBatch], floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per slice of rows: query places, (rows' ids), scores as a matrix, and where they count: not the query's own row, not under its floor."""
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for d, (at, rows) in _vectors(batch.column(1), self.scale).items():
                if d in self.by_dim:
                    of, q = self.by_dim[d]
                    step = max(1, 4_000_000 // len(of))  # bounds a matrix of scores to 32 MB
                    for i in range(0, len(at), step):
                        s, ids = _scores(q, rows[i:i + step]), own[at[i:i + step]]
                        counts = s >= floor[of][:, None]
                        same = np.nonzero(np.isin(ids, self.ids[of]))[0]
                        counts[:, same] &= self.ids[of][:, None] != ids[same][None, :]
                        yield of, ids, s, counts


def _best(kth: np.ndarray, best: np.ndarray, of: np.ndarray, s: np.ndarray, counts: np.ndarray, k: int) -> None:
    """Raises each query's k best scores so far (in place)."""
    masked = np.where(counts, s, _LEAST)
    part = np.partition(masked, max(0, masked.shape[1] - k), axis=1)[:, -k:]
    both = np.concatenate([best[of], part.astype(best.dtype)], axis=1)
    best[of] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
    kth[of] = best[of].min(axis=1)


def _tally(q: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Distinct (query, bin) with their counts, as three rows."""
    order = np.lexsort((bins, q))
    q, bins = q[order], bins[order]
    first = np.nonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (bins[1:] != bins[:-1])]))[0]
    return np.stack([q[first], bins[first], np.diff(np.append(first, len(q)))])


def _histogram(block, k: int, shift: int, floor: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        best, kth = np.full((len(b.ids), k), _LEAST, dtype=np.int64), floor.copy()
        seen: list[np.ndarray] = []
        for of, _, s, counts in b.scored(batches, floor):
            _best(kth, best, of, s, counts, k)
            kth = np.maximum(kth, floor)
            i, j = np.nonzero(counts & (s >= kth[of][:, None]))
            if len(i):
                seen.append(_tally(of[i], s[i, j].astype(np.int64) >> shift))
        if seen:
            q, bins, n = np.concatenate(seen, axis=1)
            keep = bins >= kth[q] >> shift
            yield pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (q, bins, n)], names=["q", "bin", "n"])

    return run


def _chosen(block, k: int, value: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        held = [np.empty(0, dtype=np.int64)] * 3
        for of, ids, s, counts in b.scored(batches, value):
            i, j = np.nonzero(counts)
            held = [np.concatenate([x, y]) for x, y in zip(held, (of[i], s[i, j].astype(np.int64), ids[j]), strict=True)]
            order = np.lexsort((held[2], -held[1], held[0]))  # by query; the best first, ties by id
            held = [x[order] for x in held]
            place = np.arange(len(order)) - np.searchsorted(held[0], held[0])
            held = [x[place < k] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held], names=["q", "score", "vec_id"])

    return run


def _located(histogram: DataFrame, k: int, n: int, shift: int, floor: np.ndarray) -> np.ndarray:
    """The least score in the bin that holds each query's k-th best; one row a query of the block reaches the driver."""
    w = Window.partitionBy("q").orderBy(F.desc("bin"))
    reached = histogram.groupBy("q", "bin").agg(F.sum("n").alias("n")).withColumn("to", F.sum("n").over(w)).filter(F.col("to") >= k)
    out = floor.copy()
    for q, b in reached.groupBy("q").agg(F.max("bin").alias("bin")).collect():
        out[q] = max(out[q], b << shift)
    return out


def top_k(spark: SparkSession, corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = SCALE, block: int = BLOCK, shifts: tuple[int, ...] = SHIFTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``corpus`` for each row of ``queries``, or all if there are fewer.

    Components become floor(scale * x).  A row whose vector is null or holds a null or non-finite component, or whose id
    is null, takes no part; nor do a query's own id and vectors of other dimensions than the query's.  Ties go to smaller
    ids; rows that repeat an id each count.  A score beyond a long counts as the largest or least long.  A query without
    any other row has no result; empty tables give an empty one.
    """
    scratch, found = Scratch(spark, "topk"), None
    rows, schema = usable(corpus, id_col, vector_col), "query_id long, rank int, vec_id long, score long"
    waiting = usable(queries, id_col, vector_col).toLocalIterator()
    for number in range(2**31):
        part = list(islice(waiting, block))
        if not part:
            break
        ids = np.array([r.id for r in part], dtype=np.int64)
        shared = spark.sparkContext.broadcast(Block(ids, pa.array([r.v for r in part], pa.list_(pa.float64())), scale))
        floor = np.full(len(part), _LEAST + 1, dtype=np.int64)
        for shift in shifts:
            floor = _located(rows.mapInArrow(_histogram(shared, k, shift, floor), "q long, bin long, n long"), k, len(part), shift, floor)
        w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        best = rows.mapInArrow(_chosen(shared, k, floor), "q long, score long, vec_id long").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        named = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "q long, query_id long")
        best.join(F.broadcast(named), "q").select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(scratch.path("best"))
        found = scratch.path("best")
    return spark.read.schema(schema).parquet(found) if found else spark.createDataFrame([], schema)


def op9_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(spark, rows, rows.filter("vec_id % 50 = 0"), 5)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
