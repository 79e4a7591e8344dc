"""Similar pairs of unit vectors, and greedy diversification by them.

**Similar pairs.** Every vector's terms are ordered, rarest first. The head of a kept vector ends where the norm of what follows falls below the
threshold: by Cauchy-Schwarz a unit vector that meets none of the head cannot reach it. Only heads are indexed; a pair met there is a
candidate if its sum so far and the rest of the norm can reach the threshold, and gets the rest of its sum once. Kept vectors are cut into as few parts of bounded
size as hold them. One part alone goes to the tasks, beside the first row of each, and the rows stay where they are. Several parts meet the rows by a shuffle: a row is sent to the parts
whose heads share a word with it, found by an equi-join on words. A task holds one part and one batch of rows.

**Highest cosine.** It has no threshold, but the best kept row tells which others can still be better: entries are added in levels, dearest last, until few or none can.

**Diversification** keeps a row unless it resembles a better kept one. The best open rows are taken as a lead; its similar pairs are an acyclic graph
from worse to better rows, and every row whose better neighbours are all settled settles itself, in rounds over buckets of
neighbouring ranks. Then open rows that resemble a row kept in this lead are dropped where they are, so that only vectors of rows that stay are moved, and the next lead is taken, larger as long as leads hold few pairs. Pairs
of all rows are so never formed where rows are much alike, and where they are not a few leads take all rows. The result equals that
of the row-by-row loop for any sizes. No vector passes through the driver.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafsift.operators.vectors import pieces
from leafsift.session import cut, release, scratch_path, stored

VECTOR_ROWS = "score double, id bigint, terms array<string>, weights array<double>"
_CELLS = 1_000_000  # similarity cells and postings held at once in a task
_BUCKET = 8192  # neighbouring rows that settle in one task
_LEAD = 262_144  # the most rows of a lead
_ENTRIES = 8_000_000  # entries of kept rows in a part
_PART_ROWS = 131_072  # the most kept rows of a part of that size
_LEVELS = (0.3, 0.12, 0.0)  # what the entries left out up to each level may have of a kept vector's norm
_GROUPS = 32  # of the words left out: each has norms of its own
_SQUARES = 1_000_000  # cells of a block of rows in the search for the highest cosine
_STEP = 65_536  # postings added to them at once
_TASKS = 32  # the least number of tasks that rows are dealt to where all kept rows are one part
_TRIED = 16  # kept rows of one row that are tried at most before a level is added


class Postings:
    """Entries of some vectors by word."""

    def __init__(self, word: np.ndarray, owner: np.ndarray, weight: np.ndarray, words: int) -> None:
        order = np.argsort(word, kind="stable")
        self.start = np.searchsorted(word[order], np.arange(words + 1))
        self.owner, self.weight = owner[order], weight[order]

    def meet(self, row: np.ndarray, word: np.ndarray, weight: np.ndarray, count: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row * count + owner, product) of every entry with its postings, a bounded number at a time."""
        fan = self.start[word + 1] - self.start[word]
        reach = np.cumsum(fan)
        at = 0
        while at < len(row):
            # as many entries as have a bounded number of postings, one at least
            done = reach[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(reach, done + most, side="right")))
            n = fan[at:end]
            posting = np.repeat(self.start[word[at:end]] - (reach[at:end] - n - done), n)
            posting += np.arange(len(posting))
            cell, product = np.repeat(row[at:end] * count, n), np.repeat(weight[at:end], n)
            cell += self.owner.take(posting, mode="clip")
            product *= self.weight.take(posting, mode="clip")
            yield cell, product
            at = end


class PrefixIndex:
    """Heads and tails of unit vectors for a threshold; at 0 everything is head."""

    def __init__(self, terms: pa.ListArray, weights: pa.ListArray, threshold: float) -> None:
        self.count, self.threshold = len(terms), threshold
        owner = np.repeat(np.arange(self.count), terms.value_lengths().to_numpy(zero_copy_only=False))
        weight = weights.flatten().to_numpy(zero_copy_only=False).astype(float)
        found = terms.flatten().dictionary_encode()
        self.words = found.dictionary.cast(pa.string())
        word = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((word, np.bincount(word, minlength=len(self.words))[word], owner))
        owner, word, weight = owner[order], word[order], weight[order]
        # what of each vector's square is left at each entry, itself included
        square = np.cumsum((weight * weight)[::-1])[::-1]
        ends = np.append(square, 0.0)[np.searchsorted(owner, np.arange(self.count), side="right")]
        left = np.sqrt(np.maximum(0, square - ends[owner]))
        head = left >= threshold * (1 - 1e-9) - 1e-12
        self.rest = np.zeros(self.count)
        np.maximum.at(self.rest, owner[~head], left[~head])
        self.head = Postings(word[head], owner[head], weight[head], len(self.words))
        self.tail = Postings(word[~head], owner[~head], weight[~head], len(self.words))

    @property
    def head_words(self) -> pa.Array:
        return self.words.take(pa.array(np.flatnonzero(np.diff(self.head.start))))

    def cells(self, terms: pa.ListArray, weights: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, rows x kept): exact cosines where they reach the threshold, anything below it elsewhere."""
        sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(terms)), sizes)
        value = weights.flatten().to_numpy(zero_copy_only=False).astype(float)
        norm = np.sqrt(np.bincount(row, value * value, len(terms)))
        found = pc.index_in(terms.flatten(), value_set=self.words)
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        word, row, value = found.fill_null(0).to_numpy(zero_copy_only=False)[hit], row[hit], value[hit]
        step = max(1, _CELLS // max(1, self.count))
        for first in range(0, len(terms), step):
            rows = min(step, len(terms) - first)
            lo, hi = np.searchsorted(row, [first, first + rows])
            mine = row[lo:hi] - first, word[lo:hi], value[lo:hi]
            sums = np.zeros(rows * self.count)
            for cell, product in self.head.meet(*mine, self.count, _CELLS):
                sums += np.bincount(cell, product, len(sums))
            if self.rest.any():
                reach = (sums.reshape(rows, self.count) + self.rest * norm[first : first + rows, None]).ravel()
                likely = (sums > 0) & (reach >= self.threshold - 1e-12)
                some = likely.reshape(rows, self.count).any(axis=1)[mine[0]]
                for cell, product in self.tail.meet(*(part[some] for part in mine), self.count, _CELLS):
                    kept = likely[cell]
                    sums += np.bincount(cell[kept], product[kept], len(sums))
                sums[~likely] = 0.0
            yield first, sums.reshape(rows, self.count)

    def pairs(self, terms: pa.ListArray, weights: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, kept, cosine) of all pairs that reach the threshold."""
        rows, owners, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for first, cells in self.cells(terms, weights):
            row, owner = np.nonzero(cells >= self.threshold)
            rows.append(row + first)
            owners.append(owner)
            values.append(cells[row, owner])
        return np.concatenate(rows), np.concatenate(owners), np.concatenate(values)


class BestIndex:
    """Entries of kept vectors in levels, for the highest cosine of a row to any kept row.

    Entries that weigh little for the rows they meet, small ones of frequent words, are in the later levels. After a level a cosine is at most the sum so far and, by Cauchy-Schwarz,
    the product of the norms of what is left. The kept row that can reach most is taken in full, and so are the few that can reach more than it has; where there are many, the next level is added.
    """

    def __init__(self, terms: pa.ListArray, weights: pa.ListArray) -> None:
        self.count = len(terms)
        owner = np.repeat(np.arange(self.count, dtype=np.int32), terms.value_lengths().to_numpy(zero_copy_only=False))
        weight = weights.flatten().to_numpy(zero_copy_only=False).astype(float)
        found = terms.flatten().dictionary_encode()
        self.words = found.dictionary.cast(pa.string())
        word = found.indices.to_numpy(zero_copy_only=False)
        square = weight * weight
        order = np.lexsort((square / np.bincount(word, minlength=len(self.words))[word], owner))
        owner, word, weight, square = owner[order], word[order], weight[order], square[order]
        del order
        # what each vector's entries up to each one have of its square, the cheapest to leave out first
        share = np.cumsum(square)
        before = np.append(0.0, share)[np.searchsorted(owner, np.arange(self.count))]
        share -= before[owner]
        whole = np.bincount(owner, square, self.count)
        level = np.zeros(len(owner), np.int8)
        for left in _LEVELS[:-1]:
            level += share < (left * left * whole)[owner]
        del share, square
        # the entries outside the first level, by vector: those outside a level stand before the others
        late = level > 0
        slots = np.flatnonzero(np.bincount(word[late], minlength=len(self.words)))
        self.slots, self.slot = len(slots), np.full(len(self.words), -1, np.int32)
        self.slot[slots] = np.arange(len(slots))
        self.late_slot, self.late_weight = self.slot[word[late]], weight[late]
        self.late_start = np.cumsum(np.append(0, np.bincount(owner[late], minlength=self.count)))
        self.levels = [self._level(level == number, level > number, owner, word, weight) for number in range(len(_LEVELS))]

    def _level(self, mine: np.ndarray, after: np.ndarray, owner: np.ndarray, word: np.ndarray, weight: np.ndarray) -> tuple[Postings, np.ndarray, np.ndarray, np.ndarray]:
        """Postings of a level; of what is left after it the number of entries by vector, each word's group and the norms, vectors x groups."""
        postings = Postings(word[mine], owner[mine], weight[mine], len(self.words))
        owner, word, square = owner[after], word[after], weight[after] ** 2
        mass = np.bincount(word, square, len(self.words))
        group = np.full(len(mass), -1, np.int16)
        heavy = np.argsort(-mass, kind="stable")[: np.count_nonzero(mass)]
        # the heaviest words stand alone, the others share groups of equal mass
        alone, others = heavy[: _GROUPS // 2], heavy[_GROUPS // 2 :]
        group[alone] = np.arange(len(alone))
        if len(others):
            reach = np.cumsum(mass[others])
            group[others] = len(alone) + np.minimum(_GROUPS - len(alone) - 1, (reach / reach[-1] * (_GROUPS - len(alone))).astype(np.int64))
        norms = np.sqrt(np.bincount(owner * _GROUPS + group[word], square, self.count * _GROUPS)).reshape(self.count, _GROUPS)
        # more than any rounding of these short numbers takes away
        return postings, np.bincount(owner, minlength=self.count), group, np.ascontiguousarray((norms * (1 + 1e-5)).T, np.float32)

    @property
    def head_words(self) -> pa.Array:
        return self.words

    def best(self, terms: pa.ListArray, weights: pa.ListArray) -> np.ndarray:
        """Highest cosine of each row to any kept row, or the highest product where vectors have other lengths."""
        out = np.zeros(len(terms))
        if not self.count or not len(terms):
            return out
        row = np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy(zero_copy_only=False))
        value = weights.flatten().to_numpy(zero_copy_only=False).astype(float)
        entries = terms.flatten().dictionary_encode()
        # the batch has fewer different words than the kept rows
        at = pc.index_in(self.words, value_set=entries.dictionary)
        code = np.full(len(entries.dictionary), -1, np.int64)
        code[at.drop_null().to_numpy(zero_copy_only=False)] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        word = code[entries.indices.to_numpy(zero_copy_only=False)]
        hit = word >= 0
        row, word, value = row[hit], word[hit], value[hit]
        step = max(1, min(_SQUARES // self.count, 32 * _SQUARES // max(1, self.slots)))
        grid = np.zeros(step * self.slots)  # values of a block of rows at the words of late entries
        edges = np.searchsorted(row, np.arange(0, len(terms) + step, step))
        for first, lo, hi in zip(range(0, len(terms), step), edges, edges[1:]):
            mine = row[lo:hi] - first, word[lo:hi], value[lo:hi]
            out[first : first + step] = self._block(min(step, len(terms) - first), *mine, grid)
        return out

    def _block(self, rows: int, row: np.ndarray, word: np.ndarray, value: np.ndarray, grid: np.ndarray) -> np.ndarray:
        out, number = np.zeros(rows), np.arange(rows)  # of the rows that are open
        slot = self.slot[word]
        set_ = (row * self.slots + slot)[slot >= 0]
        grid[set_] = value[slot >= 0]
        sums = np.zeros(rows * self.count)
        for postings, size, group, norms in self.levels:
            for cell, product in postings.meet(row, word, value, self.count, _STEP):
                np.add.at(sums, cell, product)
            of = group[word]
            left = np.flatnonzero(of >= 0)
            if not len(left):
                out[number] = sums.reshape(-1, self.count).max(axis=1)
                break
            own = np.sqrt(np.bincount(row[left] * _GROUPS + of[left], value[left] ** 2, len(number) * _GROUPS))
            reach = (own.reshape(-1, _GROUPS).astype(np.float32) @ norms).ravel()
            reach += sums
            ahead = reach.reshape(-1, self.count).argmax(axis=1) + np.arange(len(number)) * self.count
            sure = self._full(ahead, sums, number, size, grid)
            reach[ahead] = -np.inf
            least = (sure - 1e-6 * np.abs(sure)).astype(np.float32)
            likely = np.flatnonzero(reach.reshape(-1, self.count) > least[:, None])
            done = np.bincount(likely // self.count, minlength=len(number)) <= _TRIED
            likely = likely[done[likely // self.count]]
            np.maximum.at(sure, likely // self.count, self._full(likely, sums, number, size, grid))
            out[number[done]] = sure[done]
            if done.all():
                break
            still = ~done[row]
            row, word, value = (np.cumsum(~done) - 1)[row[still]], word[still], value[still]
            sums, number = sums.reshape(-1, self.count)[~done].ravel(), number[~done]
        grid[set_] = 0.0
        return out

    def _full(self, cell: np.ndarray, sums: np.ndarray, number: np.ndarray, size: np.ndarray, grid: np.ndarray) -> np.ndarray:
        """The products of some cells: their sums so far and what is left of the kept rows, ``size`` entries of each."""
        r, owner = np.divmod(cell, self.count)
        n = size[owner]
        ends = np.cumsum(n)
        at = np.repeat(self.late_start[owner] - (ends - n), n)
        at += np.arange(len(at))
        product = grid[np.repeat(number[r] * self.slots, n) + self.late_slot[at]] * self.late_weight[at]
        return sums[cell] + np.bincount(np.repeat(np.arange(len(cell)), n), product, len(cell))


def kept_parts(kept: DataFrame, budget: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``target, terms, weights, _part`` and the columns ``keep``, stored: parts of neighbouring ranks with about ``budget`` entries each, and at most 131,072 rows where that is 8,000,000."""
    reach = Window.partitionBy("_slice").orderBy("rank")
    least = max(1, budget // _PART_ROWS)  # so that rows of few entries fill a part as well
    # rows of one slice of ranks: their number is bounded, and so is what the window holds
    sliced = kept.withColumn("_slice", F.floor((F.col("rank") - 1) / 4096)).withColumn("_n", F.greatest(F.size("terms"), F.lit(least)).cast("bigint"))
    # one row a slice, without vectors
    before = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("_slice").agg(F.sum("_n").alias("_all")).select(F.col("_slice").alias("_of"), F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    begun = sliced.join(F.broadcast(starts), F.col("_slice").eqNullSafe(F.col("_of")))
    within = F.floor((F.col("_start") + F.sum("_n").over(reach) - F.col("_n")) / budget)
    return stored(begun.select(F.col("id").cast("bigint").alias("target"), "terms", F.col("weights").cast("array<double>"), *keep, within.alias("_part")), "kept")


def _stretches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The stretches of a batch with one part, one share and one kind."""
    key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_part", "_share", "_kind")])
    edges = [0, *(np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def _met(rows: DataFrame, parts: DataFrame, numbers: int, made, work, schema: str, keep: tuple[str, ...] = (), entries: int = 200_000) -> DataFrame:
    """``work(index, targets, stretch)`` for every stretch of rows, of so many ``entries``, and every part of kept rows whose heads it may meet.

    ``made(terms, weights)`` is the index of a part. Targets are the kept rows, without their vectors. Both have the columns ``keep``. ``numbers`` is the number of different parts.
    """
    rows = rows.select(F.col("id").cast("bigint"), "terms", F.col("weights").cast("array<double>"), *keep)
    if numbers > 1:
        return _by_parts(rows, parts, numbers, made, work, schema, keep, entries)
    # every task makes the index of the part again: a few tasks for each core
    rows = rows.coalesce(max(_TASKS, 4 * rows.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, targets = None, None
        for batch in batches:
            if index is None and batch.num_rows:
                held = batch.column("_held").slice(0, 1).flatten()
                terms, weights = (pa.concat_arrays([held.field(n)]) for n in ("terms", "weights"))
                index, targets = made(terms, weights), pa.RecordBatch.from_arrays([held.field(n) for n in ("target", *keep)], ["target", *keep])
            for piece in pieces([batch], entries):
                yield work(index, targets, piece)

    # one row: no more vectors than a part has
    held = parts.agg(F.collect_list(F.struct("target", "terms", "weights", *keep)).alias("_held")).select("_held", F.lit(True).alias("_first"))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return rows.withColumn("_first", first).join(F.broadcast(held), "_first", "left").drop("_first").mapInArrow(run, schema)


def _by_parts(rows: DataFrame, parts: DataFrame, numbers: int, made, work, schema: str, keep: tuple[str, ...], entries: int) -> DataFrame:
    shares = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // numbers)

    def heads(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        found = made(*_lists(part)).head_words
        return pa.table([pa.array(np.full(len(found), part.column("_part")[0].as_py())), found], ["_part", "word"])

    words = stored(parts.groupBy("_part").applyInArrow(heads, "_part bigint, word string"), "heads")
    routes = rows.select("id", F.explode("terms").alias("word")).join(words, "word").select("id", "_part").distinct()
    copies = parts.select("_part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share"), F.lit(0).alias("_kind"), F.col("target").alias("id"), "terms", "weights", *keep)
    sent = rows.join(routes, "id").select("_part", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int").alias("_share"), F.lit(1).alias("_kind"), "id", "terms", "weights", *keep)
    both = copies.unionByName(sent).repartition("_part", "_share").sortWithinPartitions("_part", "_share", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        index, targets, unit = None, None, None
        for batch in batches:
            for part in _stretches(batch) if batch.num_rows else ():
                now = part.column("_part")[0].as_py(), part.column("_share")[0].as_py()
                if now != unit:
                    index, held, unit = None, [], now
                if part.column("_kind")[0].as_py() == 0:
                    held.append(part)
                    continue
                if held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    index, targets, held = made(*_lists(table)), table.select(["id", *keep]).rename_columns(["target", *keep]).to_batches()[0], []
                if index is not None:
                    for piece in pieces([part.select(["id", "terms", "weights", *keep])], entries):
                        yield work(index, targets, piece)

    return both.mapInArrow(run, schema)


def _lists(rows: pa.Table) -> tuple[pa.ListArray, pa.ListArray]:
    return rows.column("terms").combine_chunks(), rows.column("weights").combine_chunks()


def similar_to(rows: DataFrame, kept: DataFrame, threshold: float, budget: int = _ENTRIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, target, similarity`` of every row of ``rows(id, terms, weights)`` to the rows of ``kept(rank, id, terms, weights)`` it resembles at least that much.

    Columns ``keep``, which both have, follow for the row and, as ``target_`` and the name, for the kept one. Vectors have length 1 or less; ids are unique. Jobs run while the frame is built.
    """
    parts = kept_parts(kept, budget, keep)
    return _similar(rows, parts, _numbers(parts), threshold, keep)


def _numbers(parts: DataFrame) -> int:
    return parts.select("_part").distinct().count()


def _similar(rows: DataFrame, parts: DataFrame, numbers: int, threshold: float, keep: tuple[str, ...] = ()) -> DataFrame:
    names = ["id", "target", "similarity", *keep, *(f"target_{c}" for c in keep)]

    def near(index: PrefixIndex, targets: pa.RecordBatch, part: pa.RecordBatch) -> pa.RecordBatch:
        row, owner, value = index.pairs(part.column("terms"), part.column("weights"))
        mine = [part.column(c).take(pa.array(row)) for c in ("id", *keep)]
        theirs = [targets.column(c).take(pa.array(owner)) for c in ("target", *keep)]
        return pa.RecordBatch.from_arrays([mine[0], theirs[0], pa.array(value), *mine[1:], *theirs[1:]], names)

    kinds = [rows.schema[c].dataType.simpleString() for c in keep] * 2
    schema = "id bigint, target bigint, similarity double" + "".join(f", `{c}` {k}" for c, k in zip(names[3:], kinds))
    return _met(rows, parts, numbers, partial(PrefixIndex, threshold=threshold), near, schema, keep)


def best_similarity(rows: DataFrame, kept: DataFrame, budget: int = _ENTRIES) -> DataFrame:
    """``id, similarity``: the highest cosine of every row to any row of ``kept``, 0 where no word is shared. Jobs run while the frame is built."""

    def highest(index: BestIndex, targets: pa.RecordBatch, part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(index.best(part.column("terms"), part.column("weights")))], ["id", "similarity"])

    parts = kept_parts(kept, budget)
    numbers = _numbers(parts)
    found = _met(rows, parts, numbers, BestIndex, highest, "id bigint, similarity double", entries=1_000_000)
    ids = rows.select(F.col("id").cast("bigint").alias("id"))
    if numbers <= 1:
        # every row is there once: what follows reads no vector
        found = stored(found, "best")
        ids = found.select("id")
        release(parts)
    best = found.groupBy("id").agg(F.max("similarity").alias("_best"))
    return ids.join(best, "id", "left").select("id", F.coalesce("_best", F.lit(0.0)).alias("similarity"))


def without_similar(rows: DataFrame, kept: DataFrame, threshold: float, budget: int = _ENTRIES) -> DataFrame:
    """The rows ``score, id, terms, weights`` whose id has no row that resembles one of ``kept(rank, score, id, terms, weights)`` at least that much, stored.

    Where ``kept`` is one part, rows are judged where they are and those that resemble it lose their vectors there.
    """
    parts = kept_parts(kept, budget, ("score",))
    numbers = _numbers(parts)
    if numbers > 1:
        like = _similar(rows, parts, numbers, threshold).select("id").distinct()
        return stored(rows.join(like, "id", "left_anti"), "open")

    def judge(index: PrefixIndex, targets: pa.RecordBatch, part: pa.RecordBatch) -> pa.RecordBatch:
        terms, weights = part.column("terms"), part.column("weights")
        like = np.zeros(part.num_rows, bool)
        like[index.pairs(terms, weights)[0]] = True
        there = pa.array(like & part.column("id").is_valid().to_numpy(zero_copy_only=False))  # what has no id has no like id
        terms, weights = (pc.if_else(there, pa.scalar(None, c.type), c) for c in (terms, weights))
        return pa.RecordBatch.from_arrays([part.column("score"), part.column("id"), terms, weights, there], ["score", "id", "terms", "weights", "_like"])

    judged = stored(_met(rows, parts, numbers, partial(PrefixIndex, threshold=threshold), judge, VECTOR_ROWS + ", _like boolean", ("score",)), "judged")
    like = judged.filter("_like").select("id").distinct()
    out = stored(judged.filter("NOT _like").drop("_like").join(like, "id", "left_anti"), "open")
    release(judged, parts)
    return out


def settle(pairs: DataFrame) -> tuple[DataFrame, int]:
    """``hi, kept`` for every worse end of ``pairs(hi, lo)`` (numbers, lo < hi is the better row), and the rounds it took.

    A row is dropped if a kept row is among its better neighbours, and kept if all of them are dropped. A row that is no worse end is kept.
    Rows of a bucket settle in order as far as the rows of other buckets are known; a round settles the first open bucket at least.
    """
    open_ = pairs.select("hi", "lo")
    ends = open_.select(F.col("hi").alias("lo"), F.lit(False).alias("_end")).distinct()
    joined = open_.join(ends, "lo", "left").select("hi", "lo", F.when(F.col("_end").isNull(), True).alias("kept"))
    out, rounds = None, 0

    def pass_through(bucket: pa.Table) -> pa.Table:
        hi, lo = (bucket.column(c).to_numpy() for c in ("hi", "lo"))
        state = bucket.column("kept").to_pylist()
        order = np.lexsort((lo, hi))
        found: dict[int, bool | None] = {}
        for i in order.tolist():
            own = found.get(hi[i], True)  # kept until a better neighbour says otherwise
            if own is False:
                continue
            better = state[i] if state[i] is not None else found.get(lo[i])
            found[hi[i]] = False if better else None if better is None or own is None else True
        return pa.table([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.bool_())], ["hi", "kept"])

    while True:
        rounds += 1
        found = joined.withColumn("bucket", F.floor(F.col("hi") / _BUCKET)).groupBy("bucket").applyInArrow(pass_through, "hi bigint, kept boolean")
        fresh = stored(found, "settled")
        known = fresh.filter("kept is not null")
        out = known if out is None else out.unionByName(known)
        left = fresh.filter("kept is null").select("hi")
        if not left.take(1):
            return out, rounds
        # a better row that is still open is no worse end of a known row, so it has no state; one that never is a worse end keeps its own
        open_ = stored(joined.join(left, "hi", "left_semi"), "pairs")
        now = known.select(F.col("hi").alias("lo"), F.col("kept").alias("_now"))
        joined = open_.join(now, "lo", "left").select("hi", "lo", F.coalesce("kept", "_now").alias("kept"))


def diversify(
    ranked: DataFrame, top: int | None = None, threshold: float = 0.05, block: int = 64, budget: int = _ENTRIES, vectors: bool = False, pairs: int = 20_000_000
) -> DataFrame:
    """``rank, score, id`` of the kept rows of ``ranked(score, id, terms, weights)``; ``vectors`` adds terms and weights.

    ``ranked`` is read twice, so it should be a stored table or cheap to make.
    Rows are taken by score, then id. The first lead has ``block`` rows; later ones grow as long as about ``pairs`` similar pairs at most are expected in
    one. Without ``top`` every row is settled. Jobs run while the frame is built.
    """
    spark = ranked.sparkSession
    order = [F.desc("score"), F.asc("id")]
    rows = ranked.select(F.col("score").cast("double"), F.col("id").cast("bigint"), "terms", F.col("weights").cast("array<double>"))
    open_, own = rows, []
    path = scratch_path(spark, "diversified")
    size, count, number = block, 0, 0
    while top is None or count < top:
        # one partition, in order: no vectors, and no more rows than a lead may have
        lead = open_.select("score", F.col("id").alias("_id")).orderBy(F.desc("score"), F.asc("_id")).limit(size)
        lead = lead.select("_id", F.monotonically_increasing_id().alias("n"))
        led = stored(open_.join(lead, F.col("id") == F.col("_id")).drop("_id"), "lead")
        taken = led.agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("score", "id"), "n").alias("last")).first()
        if not taken["n"]:
            break
        numbered = led.select(F.col("n").alias("id"), (F.col("n") + 1).alias("rank"), "terms", "weights")
        near = stored(similar_to(numbered, numbered, threshold, budget).filter("target < id").select(F.col("id").alias("hi"), F.col("target").alias("lo")), "pairs")
        found = near.count()
        kept, rounds = led, 0
        if found:
            state, rounds = settle(near)
            kept = led.join(state.filter(~F.col("kept")).select(F.col("hi").alias("n")), "n", "left_anti")
        kept.select("score", "id", "terms", "weights", "n").write.parquet(f"{path}/lead={number}")
        kept = spark.read.schema(VECTOR_ROWS + ", n bigint").parquet(f"{path}/lead={number}")
        fresh = kept.count()
        logging.getLogger(__name__).info("lead %d: %d rows, %d pairs, %d rounds, %d kept", number, taken["n"], found, rounds, fresh)
        number, count = number + 1, count + fresh
        if taken["n"] < size:
            break
        if top is None or count < top:
            last = taken["last"]
            left = open_.filter((F.col("score") < last["score"]) | ((F.col("score") == last["score"]) & (F.col("id") > last["id"])))
            after = without_similar(left, kept.withColumn("rank", F.col("n") + 1), threshold, budget)
            release(led, near, *own)
            open_, own = after, [after]
        dense = found / taken["n"] ** 2
        size = int(min(_LEAD, 8 * size, max(block, (pairs / dense) ** 0.5 if dense else _LEAD)))
    if not number:
        return spark.createDataFrame([], "rank int, score double, id bigint" + (", terms array<string>, weights array<double>" if vectors else ""))
    every = spark.read.schema(VECTOR_ROWS).option("recursiveFileLookup", "true").parquet(path)
    every = global_rank(every, *order).filter(F.lit(True) if top is None else F.col("rank") <= top)
    return every.select(F.col("rank").cast("int").alias("rank"), "score", "id", *(["terms", "weights"] if vectors else []))


def global_rank(df: DataFrame, *order, partitions: int | None = None) -> DataFrame:
    """Adds ``rank`` over all rows without gathering them in one task.

    Rows are range partitioned, numbered per partition and shifted by the sizes of
    the partitions before. ``order`` must be a total order. The partitioned rows are stored when this is called.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    numbered = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return (
        numbered.join(F.broadcast(shifts), "_part")
        .withColumn("rank", (F.col("_row") + F.col("_shift")).cast("bigint"))
        .drop("_part", "_row", "_shift")
    )
