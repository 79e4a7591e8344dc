"""Conversations repaired at least cost by weighted interval parsing.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles: nothing, or exchanges of user and assistant after at most one system
row. Rows may be kept, given the role user or assistant, or deleted, and empty rows of either role may be inserted anywhere. Of the cheapest ways the one
whose audit (the initials K, R, D, I of its edits in order) comes first is taken.

The repair grammar is in Chomsky normal form. A nonterminal X(p,q) stands for the edits that lead the pattern from state p to state q (start,
after s, after u, after a); its rules are X(p,q) -> X(p,r) X(r,q), and X(p,q) -> an edit of one row. Insertions are closed beforehand: the cheapest
chains between all states are put before each row and after the last. A cell of a span holds, for each nonterminal, the least (cost, audit).
Spans are combined bottom-up by length. Every derivation passes some state at every place, so all ways to split a span give one and the
same cell, and one split of each span is enough: n - 1 combinations for n rows. Of two ways of equal cost neither audit starts the other (the longer one would
cost more), so the least parts give the least whole.

Rows are ordered by one range sort over all conversations, so a conversation of any length lies in as many partitions as it needs; rows equal in all
columns are counted first and sorted once. Tasks parse stretches of at most ``STRETCH`` rows without their texts; only the cells of
stretches meet per conversation, and edits go back to rows by row number, one to one.

Defined results: a null conv_id is a conversation of its own; nulls of role and text are one space. Rows are taken by turn, nulls first, then by role, the
first 32 characters and the MD5 of the text; rows equal in all of these are repeats of the first. Blank: nothing but white space [\\x20\\x09-\\x0D].
Duplicate: role and text stood earlier in the conversation. Truncated: the last character that is no white space is none of ``.!?``. A row has the
first of these faults. A role with another initial than s, u, a (or none) can't be kept. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsift.llm.batches import stored

SPACE = " \t\n\x0b\x0c\r"
#: Rows of a conversation that are parsed at once.
STRETCH = 4096
START, S, U, A = STATES = range(4)
#: The pattern: where each initial leads.
STEPS = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
ENDS = (START, A)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

Cell = dict[tuple[int, int], tuple[int, str]]


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans together: X(p,q) -> X(p,r) X(r,q)."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            if (more := right.get((r, q))) is not None:
                whole = cost + more[0]
                held = out.get((p, q))
                if held is None or whole < held[0] or (whole == held[0] and audit + more[1] < held[1]):
                    out[p, q] = (whole, audit + more[1])
    return out


def parsed(cells: list[Cell]) -> Cell:
    """The cell of all spans in a row, bottom-up: neighbours of equal length first."""
    while len(cells) > 1:
        odd = cells[len(cells) // 2 * 2 :]
        cells = [combined(a, b) for a, b in zip(cells[::2], cells[1::2])] + odd
    return cells[0]


@cache
def insertions() -> Cell:
    """The cheapest chains of insertions between all states."""
    cell: Cell = {(p, p): (0, "") for p in STATES}
    one = cell | {(p, q): (INSERT, "I") for x in "ua" for p, q in STEPS[x].items()}
    for _ in STATES:
        cell = combined(cell, one)
    return cell


@cache
def row_cell(initial: str, fault: str, copies: int = 1) -> Cell:
    """A row that stands ``copies`` times, after any insertions; all copies but the first can only be deleted."""
    cell: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if fault in ("", "truncated"):
        more = TRUNCATED if fault else 0
        for x in "ua":
            cell |= {edge: (REROLE + more, "R") for edge in STEPS[x].items()}
        cell |= {edge: (more, "K") for edge in STEPS.get(initial, {}).items()}
    cell = {edge: (cost + DELETE * (copies - 1), audit + "D" * (copies - 1)) for edge, (cost, audit) in cell.items()}
    return combined(insertions(), cell)


def finished(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    whole = combined(cell, insertions())
    return min(whole[START, q] for q in ENDS if (START, q) in whole)


def role_at(place: int, length: int) -> str | None:
    """The role that row ``place`` of a repaired conversation must have; None: the system row, which is always a kept one."""
    at = place - length % 2
    return None if at < 0 else "assistant" if at % 2 else "user"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after faults drawn by crc32 of ``conv_id:turn``, modulo 20."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("draw"),
        spaced("role").alias("role"),
        spaced("text").alias("text"),
    ).filter("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("one")).drop("one")


def _clean(rows: DataFrame) -> DataFrame:
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"))


KEYS = ("conv_id", "turn", "role", "key")


def joined(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """An equi-join on columns of the same names, where null equals null; they stay once."""
    for name in names:
        right = right.withColumnRenamed(name, f"right_{name}")
    same = [F.col(name).eqNullSafe(F.col(f"right_{name}")) for name in names]
    return left.join(right, same, how).drop(*(f"right_{name}" for name in names))


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, copies, fault, number): the distinct rows in order, without their texts.

    Numbers rise along each conversation; within a partition of the sort they rise by one.
    """
    rows = _clean(rows)
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(last.isin(".", "!", "?"), "").otherwise("truncated")
    narrow = rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("key"), F.substring("text", 1, 32).alias("head"), fault.alias("fault"))
    narrow = narrow.groupBy(*KEYS, "head", "fault").agg(F.count(F.lit(1)).alias("copies"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = narrow.groupBy("conv_id", "role", "key").agg(F.min(when).alias("first"))
    both = joined(narrow, first, "conv_id", "role", "key")
    again = ~F.col("first.turn").eqNullSafe(F.col("turn")) & (F.col("fault") != "blank")
    faulty = both.select(*KEYS, "head", "copies", F.when(again, "duplicate").otherwise(F.col("fault")).alias("fault"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "head", "key"]
    placed = faulty.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(placed.withColumn("number", F.monotonically_increasing_id()).drop("head"), "repair-rows")


STRETCHES = "conv_id long, number long, copies array<long>, blank long, duplicate long, truncated long, illegal long, head string, tail string, edges array<int>, costs array<long>, audits array<string>"
LEGAL = ("su", "ua", "au")


def _stretches(rows: DataFrame) -> DataFrame:
    """One row for each stretch of neighbours of a conversation: its cell, its counts, its outer initials."""
    schema = pa.schema([pa.field(n, {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}[t]) for n, t in (x.split() for x in STRETCHES.split(", "))])

    def close(run: list[tuple]) -> dict:
        initials = [r[2] for r in run]
        cell = parsed([row_cell(x, f, c) if c < 9 else row_cell.__wrapped__(x, f, c) for _, _, x, f, c in run])
        count = lambda kind: sum(f == kind for _, _, _, f, _ in run)
        repeats = [c - 1 for *_, c in run]
        return {
            "conv_id": run[0][0],
            "number": run[0][1],
            "copies": [c for *_, c in run],
            "blank": count("blank") + sum(n for n, r in zip(repeats, run) if r[3] == "blank"),
            "duplicate": count("duplicate") + sum(n for n, r in zip(repeats, run) if r[3] != "blank"),
            "truncated": count("truncated"),
            "illegal": sum(repeats) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "head": initials[0],
            "tail": initials[-1],
            "edges": [4 * p + q for p, q in cell],
            "costs": [c for c, _ in cell.values()],
            "audits": [a for _, a in cell.values()],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[dict] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "number", "initial", "fault", "copies"))):
                if held and (row[0] != held[-1][0] or row[1] != held[-1][1] + 1 or len(held) == STRETCH):
                    done.append(close(held))
                    held = []
                held.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if held:
            yield pa.RecordBatch.from_pylist([close(held)], schema)

    initial = F.substring("role", 1, 1).alias("initial")
    return rows.select("conv_id", "number", initial, "fault", "copies").mapInArrow(run, STRETCHES)


PARSES = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits array<struct<number:bigint,place:bigint,edit:string,role:string>>"


def _conversations(stretches: DataFrame) -> DataFrame:
    """One row for each conversation, followed by rows that hold its edits (with a null audit), at most about STRETCH in each."""
    names = [x.split()[0] for x in PARSES.split(", ", 7)]
    edit = pa.struct([("number", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string())])
    schema = pa.schema(list(zip(names, [pa.int64()] * 6 + [pa.string(), pa.list_(edit)])))

    def whole(parts: list[dict]) -> Iterator[dict]:
        cells = [{divmod(e, 4): (c, a) for e, c, a in zip(p["edges"], p["costs"], p["audits"])} for p in parts]
        cost, audit = finished(parsed(cells))
        sums = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
        sums["illegal"] += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(parts, parts[1:]))
        conv_id = parts[0]["conv_id"]
        yield {"conv_id": conv_id, **sums, "cost": cost, "audit": audit, "edits": []}
        length, at, place = len(audit) - audit.count("D"), 0, 0
        for n, part in enumerate(parts):
            edits = []
            for k, copies in enumerate(part["copies"]):
                while audit[at] == "I":
                    edits.append({"number": None, "place": place, "edit": "I", "role": role_at(place, length)})
                    at, place = at + 1, place + 1
                if audit[at] != "D":
                    edits.append({"number": part["number"] + k, "place": place, "edit": audit[at], "role": role_at(place, length) if audit[at] == "R" else None})
                    place += 1
                at += copies
            for _ in range(len(audit) - at if n == len(parts) - 1 else 0):
                edits.append({"number": None, "place": place, "edit": "I", "role": role_at(place, length)})
                place += 1
            yield {"conv_id": conv_id, "edits": edits}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if held and row["conv_id"] != held[-1]["conv_id"]:
                    out += whole(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist(list(whole(held)), schema)

    return stretches.repartition("conv_id").sortWithinPartitions("conv_id", "number").mapInArrow(run, PARSES)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of ``rows(conv_id, turn, role, text)``: what each conversation needed, and its repaired rows.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conversation that has rows, and
    (conv_id, place, turn, role, text, edit), places from 0; inserted rows have no turn.
    """
    lines = numbered(rows)
    found = stored(_conversations(_stretches(lines)), "repair-conversations")
    wide = "decimal(38,0)"
    gaps = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count_distinct("turn")
    turns = lines.groupBy("conv_id").agg(F.least(F.coalesce(gaps, F.lit(0)), F.lit((1 << 63) - 1).cast(wide)).cast("long").alias("gaps"))
    whole = found.filter(F.col("audit").isNotNull())
    summary = joined(whole, turns, "conv_id").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edits = found.filter(F.col("audit").isNull()).select("conv_id", F.explode("edits").alias("e")).select(F.col("conv_id").alias("conv"), "e.*")
    edits = edits.withColumnRenamed("role", "new_role")
    kept = edits.filter("number is not null").join(lines.select(*KEYS, "number"), "number").drop("conv", "number")
    clean = _clean(rows)
    texts = clean.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("key"), "text")
    texts = texts.groupBy(*KEYS).agg(F.min("text").alias("text"))  # one text each
    known = joined(kept, texts, *KEYS).select("conv_id", "place", "turn", F.coalesce("new_role", "role").alias("role"), "text", "edit")
    added = edits.filter("number is null").select(F.col("conv").alias("conv_id"), "place", F.lit(None).cast("long").alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"), "edit")
    return summary, known.unionByName(added)
