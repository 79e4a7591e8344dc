"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become token pieces; only documents beyond the capacity are cut. Pieces are dealt
to cells of about ``CELL_ROWS``. Each cell is solved on several islands, each with a
population of packings. Crossover puts whole well-filled bins of one packing into another,
takes out the bins that hold any of their pieces again, and best-fits the pieces so displaced. After
each epoch the elite of an island moves to the next island. A cell ends early once it meets
its lower bound. The badly filled bins of all cells are dissolved and packed again
as new, fewer cells, until one cell is left or nothing is gained.

Defined results: a null or empty text is the end token alone; repeated rows and equal or
missing doc_ids are separate documents (rows are told apart by a number of their own); an empty
table gives no piece. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsift.llm import word_bpe
from leafsift.llm.batches import Bytes, Words, pack, per_slice, ragged, spread_repeats, stored, sums_between

CELL_ROWS = 1500
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 2, 6, 4
#: Bins below this share of the capacity are dissolved for the next level.
WELL_FILLED = 0.995


# ---------------------------------------------------------------- pieces


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document; ids are little-endian unsigned 32-bit numbers."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        encoder = word_bpe.load(tokenizer)
        words = Words.of(Bytes.of(part.column("text")))
        ids, counts = encoder.encode(words.distinct)
        starts = np.cumsum(counts) - counts
        each = counts[words.ids]
        totals = sums_between(each, words.first) + 1
        bounds = np.concatenate([[0], np.cumsum(totals)])
        flat = np.full(bounds[-1], end_id, dtype="<u4")
        inner = np.ones(len(flat), dtype=bool)
        inner[bounds[1:] - 1] = False
        flat[inner] = ids[ragged(starts[words.ids], each)]
        n_pieces = -(-totals // capacity)
        piece = spread_repeats(n_pieces)
        begin = piece * capacity
        length = np.minimum(capacity, np.repeat(totals, n_pieces) - begin)
        offsets = 4 * np.append(np.repeat(bounds[:-1], n_pieces) + begin, bounds[-1])
        doc = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(totals)), n_pieces)))
        body = pack(flat.view(np.uint8), offsets).cast(pa.binary())
        return pa.RecordBatch.from_arrays(
            [doc, pa.array(piece.astype(np.int32)), pa.array(begin), pa.array(length), body], ["doc_id", "piece", "start", "length", "ids"]
        )

    return per_slice(docs, work, "doc_id long, piece int, start long, length long, ids binary")


# ---------------------------------------------------------------- one packing problem


class Packing:
    """Which bin each piece is in; bins are numbered from 0 without gaps."""

    __slots__ = ("bins", "fills")

    def __init__(self, bins: np.ndarray, lengths: np.ndarray):
        used, self.bins = np.unique(bins, return_inverse=True)
        self.fills = np.bincount(self.bins, lengths, minlength=len(used)).astype(np.int64)

    def cost(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first; then the less even filling, which leaves more room in one place."""
        return len(self.fills), -float(np.square(self.fills / capacity).sum())


def best_fit(bins: np.ndarray, fills: list[int], pieces: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Put each of ``pieces``, in their order, where it leaves the least room; ``fills`` are the open bins' fills, by number."""
    room = sorted((capacity - fill, number) for number, fill in enumerate(fills) if fill < capacity)
    out = bins.copy()
    number = len(fills)
    for piece in pieces.tolist():
        size = int(lengths[piece])
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            left, own = room.pop(at)
        else:
            left, own, number = capacity, number, number + 1
        out[piece] = own
        if left > size:
            bisect.insort(room, (left - size, own))
    return out


def cross(one: Packing, other: Packing, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """``one`` with some well-filled bins of ``other``: the bins they clash with go, and what these held besides is fitted anew."""
    full = other.fills / capacity
    order = np.argsort(-full + rng.random(len(full)) * 0.01)
    chosen = np.zeros(len(full), dtype=bool)
    chosen[order[: max(1, int(len(full) * rng.uniform(0.2, 0.6)))]] = True
    injected = chosen[other.bins]
    clashing = np.zeros(len(one.fills), dtype=bool)
    clashing[one.bins[injected]] = True
    # the worst bins that are left go too: without that, no room is ever made
    worst = np.argsort(np.where(clashing, np.inf, one.fills))[: max(1, len(one.fills) // 20)]
    clashing[worst] = True
    bins = np.where(injected, len(one.fills) + other.bins, one.bins)
    displaced = np.flatnonzero(clashing[one.bins] & ~injected)
    kept = np.ones(len(bins), dtype=bool)
    kept[displaced] = False
    numbers, dense = np.unique(bins[kept], return_inverse=True)
    bins[kept] = dense
    fills = np.bincount(dense, lengths[kept], minlength=len(numbers)).astype(np.int64).tolist()
    displaced = displaced[np.argsort(-lengths[displaced], kind="stable")]
    return Packing(best_fit(bins, fills, displaced, lengths, capacity), lengths)


def beginning(lengths: np.ndarray, capacity: int, rng: np.random.Generator, first: bool) -> Packing:
    """Best fit, longest first; for all but the first packing with the order blurred."""
    size = lengths if first else lengths * rng.uniform(0.7, 1.3, len(lengths))
    order = np.argsort(-size, kind="stable")
    return Packing(best_fit(np.zeros(len(lengths), np.int64), [], order, lengths, capacity), lengths)


def evolve(lengths: np.ndarray, capacity: int, seeds: list[np.ndarray], rng: np.random.Generator, generations: int = GENERATIONS, population: int = POPULATION) -> list[Packing]:
    """The population after some generations, best first; it stops at the lower bound."""
    bound = -(-int(lengths.sum()) // capacity)
    group = [Packing(s, lengths) for s in seeds]
    cost = lambda p: p.cost(capacity)
    while len(group) < population:
        group.append(beginning(lengths, capacity, rng, first=not group))
        if len(group[-1].fills) == bound:
            return [group[-1]]
    for _ in range(generations):
        group.sort(key=cost)
        if len(group[0].fills) == bound:
            break
        a, b = rng.integers(0, len(group), 2), rng.integers(0, len(group), 2)
        pair = [group[int(a.min())], group[int(b.min())]]
        if pair[0] is pair[1]:
            pair[1] = group[(group.index(pair[0]) + 1) % len(group)]
        group += [cross(pair[0], pair[1], lengths, capacity, rng), cross(pair[1], pair[0], lengths, capacity, rng)]
        group = sorted(group, key=cost)[:population]
    return sorted(group, key=cost)


# ---------------------------------------------------------------- islands as Spark jobs

_STATE = "cell long, island int, bins binary, used int, done boolean"


def _state(cell, island, packing: Packing, done: bool) -> dict:
    return {"cell": cell, "island": island, "bins": packing.bins.astype("<u2").tobytes(), "used": len(packing.fills), "done": done}


def _epoch(rows: DataFrame, capacity: int, seed: int) -> DataFrame:
    """One epoch on each row (cell, island, lengths, population); the elite is sent to the next island as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], dtype=np.int64)
                rng = np.random.default_rng([seed, row["cell"], row["island"]])
                seeds = [np.frombuffer(p, "<u2").astype(np.int64) for p in sorted(row["population"])]
                group = evolve(lengths, capacity, seeds, rng)
                done = len(group[0].fills) == -(-int(lengths.sum()) // capacity)
                out = [_state(row["cell"], row["island"], p, done) for p in (group[:1] if done else group)]
                if not done:
                    out.append(_state(row["cell"], (row["island"] + 1) % ISLANDS, group[0], False))
                yield pa.RecordBatch.from_pylist(out, pa.schema([("cell", pa.int64()), ("island", pa.int32()), ("bins", pa.binary()), ("used", pa.int32()), ("done", pa.bool_())]))

    return rows.mapInArrow(run, _STATE)


def _solve(items: DataFrame, n_cells: int, capacity: int, level: int) -> DataFrame:
    """(cell, rows, lengths, bins): the best packing found of every cell of ``items`` (row, length)."""
    cell = F.pmod(F.xxhash64("row", F.lit(level)), F.lit(n_cells))
    cells = items.groupBy(cell.alias("cell")).agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("items"))
    cells = stored(cells.select("cell", F.col("items.row").alias("rows"), F.col("items.length").alias("lengths")), "packing-cells")
    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))
    # Each island is a row of its own, spread over the tasks.
    work = cells.select("cell", "lengths", islands.alias("island"), F.array().cast("array<binary>").alias("population"))
    found = stored(_epoch(work.repartition(F.col("cell"), F.col("island")), capacity, 100 * level), "packing-epoch")
    for epoch in range(1, EPOCHS):
        ended = found.filter("done").select("cell").distinct()
        open_ = found.join(ended, "cell", "left_anti").groupBy("cell", "island").agg(F.collect_set("bins").alias("population"))
        work = open_.join(cells.select("cell", "lengths"), "cell").select("cell", "lengths", "island", "population")
        found = stored(found.unionByName(_epoch(work, capacity, 100 * level + epoch)), "packing-epoch")
    best = found.groupBy("cell").agg(F.min_by("bins", F.struct("used", "bins")).alias("bins"))
    return cells.join(best, "cell")


def _places(solved: DataFrame, capacity: int, level: int) -> DataFrame:
    """(row, length, sequence_id, offset, fill) of every piece of the solved cells."""
    names = ("row", "length", "sequence_id", "offset", "fill")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, lengths = np.array(row["rows"], np.int64), np.array(row["lengths"], np.int64)
                bins = np.frombuffer(row["bins"], "<u2").astype(np.int64)
                order = np.argsort(bins, kind="stable")
                rows, lengths, bins = rows[order], lengths[order], bins[order]
                before = np.cumsum(lengths) - lengths
                first = np.searchsorted(bins, bins)
                fills = np.bincount(bins, lengths).astype(np.int64)
                sequence = (level << 56) | (row["cell"] << 16) | bins
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows, lengths, sequence, before - before[first], fills[bins])], list(names))

    return solved.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def place(pieces: DataFrame, capacity: int = 4096, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``pieces`` with sequence_id and offset: rows with a ``length`` of 1..capacity packed into few sequences of that capacity.

    Jobs run while the frame is built. A row of the full capacity is a sequence of its own.
    """
    table = stored(pieces.withColumn("packing_row", F.monotonically_increasing_id()), "packing-pieces")
    items = table.select(F.col("packing_row").alias("row"), F.col("length").cast("long").alias("length"))
    placed = items.filter(F.col("length") >= capacity).select("row", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = items.filter(F.col("length") < capacity)
    left, level = open_.count(), 0
    while left:
        n_cells = -(-left // cell_rows)
        solved = stored(_places(_solve(open_, n_cells, capacity, level), capacity, level), "packing-places")
        settled = (F.col("fill") >= WELL_FILLED * capacity) if n_cells > 1 else F.lit(True)
        again = solved.filter(~settled).count() if n_cells > 1 else 0
        if again > 0.9 * left:  # the lengths allow no better fill: what each cell has left over, its worst tenth at most, still meets that of the others
            worst = solved.agg(F.percentile_approx("fill", 0.1, 10_000)).first()[0]
            settled = F.col("fill") >= worst
            again = solved.filter(~settled).count()
        placed = placed.unionByName(solved.filter(settled).select("row", "sequence_id", "offset"))
        open_, left, level = solved.filter(~settled).select("row", "length"), again, level + 1
    return table.join(placed.withColumnRenamed("row", "packing_row"), "packing_row").drop("packing_row")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the tokens of each sequence, from placed pieces with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda body, p: F.concat(body, p["ids"])).alias("ids"))
