"""Exact top-k by an impact-ordered, score-at-a-time index.

Vectors are dealt to blocks. In a block, every dimension's components are quantised to a few levels; the rows of one
dimension and level are a posting segment, with its largest and smallest component. For a query, segments are
processed by descending contribution: each adds its upper contribution to the accumulators
of its rows. What a row can still gain is at most the sum over dimensions of the best segment left. Processing
stops once it is proved that few rows can be members: the k-th best exact score found so far exceeds the
accumulator and possible gain of all others. Every possible member is then rescored exactly. Segments that
can only lower a score need no processing.

Every query meets every block: the queries of a block arrive as a stream after its vectors, so a task holds one
block and one batch of queries. The best k of each block are merged by a window over each query's few rows.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without
vec_id. Components missing from the shorter of two vectors count as zero. A query's own rows are those with its vec_id; a
vec_id in several rows asks once, with its smallest vector, and each of its rows is a
candidate for others. Ties go to the smaller vec_id. Scores must fit in 63 bits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafsift.llm.batches import give_back, stored

#: Vectors in a block.
BLOCK_ROWS = 8192
LEVELS = 16
#: Segments processed between two attempts at the proof.
STEP = 64


class ImpactIndex:
    """Posting segments of the vectors ``x`` (rows by dimensions, integers)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")  # ties then go to the smaller id
        self.ids, self.x = ids[order], x[order]
        low, high = self.x.min(axis=0), self.x.max(axis=0)
        width = (high - low) // LEVELS + 1
        rows, dims, top, bottom = [], [], [], []
        for d in range(self.x.shape[1]):
            column = self.x[:, d]
            level = (column - low[d]) // width[d]
            by = np.argsort(level, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(level[by])) + 1):
                rows.append(part)
                dims.append(d)
                top.append(column[part].max())
                bottom.append(column[part].min())
        self.rows, self.dims = rows, np.array(dims)
        self.top, self.bottom = np.array(top), np.array(bottom)

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k rows whose id is not ``own``, best first."""
        allowed = self.ids != own
        weight = q[self.dims]
        gain = np.maximum(weight * self.top, weight * self.bottom)
        order = np.argsort(-gain, kind="stable")
        order = order[gain[order] > 0]
        total = np.zeros(len(self.ids), np.int64)
        few = max(4 * k, len(self.ids) // 64)
        possible = np.flatnonzero(allowed)
        for begin in range(0, len(order) + 1, STEP):
            left = order[begin:]
            if begin and len(possible) > k:
                best_left = np.zeros(len(q), np.int64)
                np.maximum.at(best_left, self.dims[left], gain[left])
                bound = total[possible] + best_left.sum()
                likely = possible[np.argpartition(-bound, k)[: 2 * k]]
                least = np.partition(self.x[likely] @ q, -k)[-k]
                possible = possible[bound >= least]
            if len(possible) <= few or not len(left):
                break
            for segment in left[:STEP].tolist():
                total[self.rows[segment]] += gain[segment]
        scores = self.x[possible] @ q
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible][best], scores[best]


def _matrix(arrays: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of integers as rows of ``width`` (the longest list's, if not given), filled with zeros."""
    sizes = arrays.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = arrays.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if width is None else width
    out = np.zeros((len(sizes), max(width, int(sizes.max()))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out[:, :width]


def quantised(vectors: DataFrame, step: float = 1 / 256) -> DataFrame:
    """(vec_id, x): floor(component / step) of every vector that takes part."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine)
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c / step).cast("long")).alias("x"))


def search(vectors: DataFrame, asks: Column, k: int = 5, step: float = 1 / 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector that ``asks`` (a condition on vec_id), its best k others."""
    rows = stored(quantised(vectors, step).withColumn("row", F.monotonically_increasing_id()), "impact-vectors")
    n_blocks = max(1, -(-rows.count() // block_rows))
    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")  # by row, as an id may repeat any number of times
    queries = rows.filter(asks).groupBy("vec_id").agg(F.min("x").alias("x"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "x")
    both = rows.select(block.alias("block"), F.lit(0).alias("kind"), "vec_id", "x").unionByName(asked)
    both = both.repartition(n_blocks, "block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        index, current = None, None
        for batch in batches:
            for part in _runs(batch):
                number, kind = part.column("block")[0].as_py(), part.column("kind")[0].as_py()
                if number != current:
                    index, current, held = None, number, []
                if kind == 0:
                    held.append(part)
                    continue
                if index is None and held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    index = ImpactIndex(table.column("vec_id").to_numpy(), _matrix(table.column("x").combine_chunks()))
                    held = []
                    give_back()
                if index is not None:
                    yield _answers(index, part, k)

    found = both.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The stretches of a batch with one block and one kind."""
    if batch.num_rows:
        key = batch.column("block").to_numpy(zero_copy_only=False).astype(np.int64) * 2 + batch.column("kind").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def _answers(index: ImpactIndex, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
    ids = queries.column("vec_id").to_numpy(zero_copy_only=False)
    vectors = _matrix(queries.column("x"), index.x.shape[1])
    found = [index.search(q, own, k) for own, q in zip(ids.tolist(), vectors)]
    counts = [len(f[0]) for f in found]
    columns = [np.repeat(ids, counts), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])
