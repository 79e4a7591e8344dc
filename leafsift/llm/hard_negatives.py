"""Hard negatives by exact inner products over Kronecker-packed integers.

Candidates are dealt to blocks, anchors to groups. In a block, every dimension becomes one wide integer: the components
of all candidates, biased so that none is negative, stand in separated fields of it. An anchor multiplies each wide integer once
by its own component; the fields of the sum are the biased scores of all candidates, and one further bias per anchor keeps
them from borrowing. A field is wide enough for the largest sum that the block and group can make, so nothing carries over and the
unpacked scores are exact.

Every group of anchors meets every block once in each of two passes: the first finds the best candidates of the anchor's own label
(its positives), the second, which knows their scores, the best candidates of other labels between ``low`` and ``high`` hundredths of each.
A task holds one block and one group at a time, whatever the labels: they are compared after scoring, so a label that holds a
third of all rows changes nothing. What leaves a unit is a few rows for each anchor; windows over those merge the blocks.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without a label.
Components missing from the shorter of two vectors count as zero. Rows are told apart by a number of their own: a repeated vec_id that asks
does so for each of its rows, and its other rows are candidates. Rows without vec_id are candidates and come last among ties. Components and scores
of any size are exact; a score beyond a long is held at its end. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafsift.llm.batches import give_back, stored

#: The most vectors in a block and anchors in a group, in the mean; smaller tables are dealt to up to SPREAD blocks.
BLOCK_ROWS, GROUP_ROWS, SPREAD = 16384, 2048, 32
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Packed:
    """The rows of ``x`` (integers, int64 or Python's) as one wide integer per dimension."""

    def __init__(self, x: np.ndarray, widest_anchor: int):
        self.rows = len(x)
        self.shift = -int(x.min()) if x.size else 0
        self.span = int(x.max()) + self.shift if x.size else 0
        bits = max(1, (self.span * widest_anchor).bit_length())
        self.width = 4 if bits <= 32 else -(-bits // 64) * 8
        biased = x + self.shift
        self.columns = [int.from_bytes(self._fields(biased[:, d]), "little") for d in range(x.shape[1])]
        self.ones = int.from_bytes((b"\x01" + b"\x00" * (self.width - 1)) * self.rows, "little")

    def _fields(self, values: np.ndarray) -> bytes:
        if self.width <= 8:
            return values.astype(f"<u{self.width}").tobytes()
        return b"".join(int(v).to_bytes(self.width, "little") for v in values)

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The inner product of each row with ``anchor``: one multiplication for each of its components."""
        lift = self.span * sum(-a for a in anchor if a < 0)
        total = self.ones * lift
        for a, column in zip(anchor, self.columns):
            if a:
                total += a * column
        raw = total.to_bytes(self.width * self.rows, "little")
        less = lift + self.shift * sum(anchor)
        if self.width <= 8 and abs(less) < 1 << 62:
            fields = np.frombuffer(raw, f"<u{self.width}")
            if self.width == 4 or int(fields.max(initial=0)) < 1 << 62:
                return fields.astype(np.int64) - less
        exact = (int.from_bytes(raw[i : i + self.width], "little") - less for i in range(0, len(raw), self.width))
        return np.array([min(MOST, max(LEAST, v)) for v in exact], np.int64)


def whole(arrays: pa.Array, width: int) -> np.ndarray:
    """Lists of whole doubles as rows of ``width`` integers, filled with zeros: int64, or Python's where those are too short."""
    sizes = arrays.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = arrays.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and np.abs(flat).max() >= 1 << 53:
        values, out = np.array([int(v) for v in flat], object), np.zeros((len(sizes), width), object)
    else:
        values, out = flat.astype(np.int64), np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def labelled(vectors: DataFrame, label: Column, step: float = 1 / 256) -> DataFrame:
    """(row, vec_id, label, x): floor(component / step), as whole doubles, of every row that takes part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & (F.size("embedding") > 0) & fine)
    # Not floor(): that gives longs, which the largest components exceed.
    down = lambda c: F.when(F.abs(c / step) >= float(1 << 52), c / step).otherwise(F.floor(c / step).cast("double"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("embedding", down).alias("x"))


def _shares(rows: int, most: int) -> int:
    return max(-(-rows // most), min(SPREAD, -(-rows // 512)), 1)


def _dealt(shares: int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int")


def _copied(shares: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int, pick: Callable, schema: str) -> DataFrame:
    """``pick(scores, labels, rows, ids, anchor)`` for every anchor and block; its rows carry the anchor's number and id first."""

    def unit(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = [part.split()[0] for part in schema.split(", ")]
        out: list[tuple] = []
        if asked.num_rows and held.num_rows:
            asked, held = asked.combine_chunks(), held.combine_chunks()
            q, x = (t.column("x").combine_chunks() if isinstance(t.column("x"), pa.ChunkedArray) else t.column("x") for t in (asked, held))
            width = max(int(np.max(a.value_lengths().to_numpy(zero_copy_only=False))) for a in (q, x))
            whole_q = whole(q, width).tolist()
            packed = Packed(whole(x, width), max(sum(map(abs, a)) for a in whole_q))
            labels, numbers = held.column("label").to_numpy(), held.column("row").to_numpy()
            ids = held.column("vec_id").fill_null(MOST).to_numpy()
            for a, vector in zip(asked.drop_columns(["x"]).to_pylist(), whole_q):
                for found in pick(packed.scores(vector), labels, numbers, ids, a):
                    out.append((a["row"], a["vec_id"], *found))
            give_back()
        columns = list(zip(*out)) or [()] * len(names)
        return pa.table([pa.array([None if v == MOST and n.endswith("_id") else v for v in c], pa.int64()) for n, c in zip(names, columns)], names=names)

    left = anchors.withColumn("block", _copied(blocks)).withColumn("part", _dealt(groups))
    right = rows.withColumn("part", _copied(groups)).withColumn("block", _dealt(blocks))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(unit, schema)


def _best(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The k of ``places`` with the highest scores, ties to smaller ids, best first."""
    if len(places) > k:
        places = places[scores[places] >= np.partition(scores[places], -k)[-k]]
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def positives_of(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int, k: int) -> DataFrame:
    """(anchor_row, anchor_id, positive_id, positive_score, place): the first k other rows of each anchor's label."""

    def pick(scores, labels, numbers, ids, anchor) -> Iterator[tuple]:
        for at in _best(scores, ids, np.flatnonzero((labels == anchor["label"]) & (numbers != anchor["row"])), k):
            yield int(ids[at]), int(scores[at])

    found = _met(anchors, rows, blocks, groups, pick, "anchor_row long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mine(
    vectors: DataFrame,
    label: Column,
    asks: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    step: float = 1 / 256,
    block_rows: int = BLOCK_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row that ``asks`` (a condition on vec_id).

    A negative has another label, and low * positive_score <= 100 * negative_score <= high * positive_score. Two negatives of equal rank and score
    may only differ in rows that share a vec_id.
    """
    rows = stored(labelled(vectors, label, step), "negatives-vectors")
    anchors = rows.filter(asks).select(*(F.col(c).alias(c) for c in rows.columns))  # columns of their own, as they meet ``rows`` again
    blocks, groups = _shares(rows.count(), block_rows), max(1, -(-anchors.count() // group_rows))
    first = stored(positives_of(anchors, rows, blocks, groups, positives), "negatives-positives")
    bars = first.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("bars"))  # at most ``positives`` each
    known = anchors.join(bars, anchors["row"] == bars["anchor_row"]).drop("anchor_row")

    def pick(scores, labels, numbers, ids, anchor) -> Iterator[tuple]:
        ends = [(low * b["positive_score"], high * b["positive_score"]) for b in anchor["bars"]]
        bounds = [(-(-least // 100), most // 100) for least, most in ends]
        other = labels != anchor["label"]
        near = np.flatnonzero(other & (scores >= min(b[0] for b in bounds)) & (scores <= max(b[1] for b in bounds)))
        for bar, (least, most) in zip(anchor["bars"], bounds):
            inside = near[(scores[near] >= least) & (scores[near] <= most)]
            for at in _best(scores, ids, inside, negatives):
                yield bar["place"], MOST if bar["positive_id"] is None else bar["positive_id"], bar["positive_score"], int(ids[at]), int(scores[at])

    schema = "anchor_row long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _met(known, rows, blocks, groups, pick, schema)
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
