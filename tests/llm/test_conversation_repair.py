import hashlib
import itertools
import random
import re
import zlib

import compare
import pytest

from leafsift.llm import conversation_repair as repair
from leafsift.llm import queries
from leafsift.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string, number long, audit string, key string"


def test_query_agrees_with_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        sf = f"/root/testdata/{sf}"
        assert compare.difference(QUERIES["op11_conversation_repair"](spark, sf), compare.connect(sf), SQL["op11_conversation_repair"]) is None


def cheapest(rows, most=None):
    """(cost, audit) by trying all edits: ``rows`` are (initial, fault)."""
    best = None

    def go(i, initials, cost, audit, room):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best or (cost, audit), (cost, audit))
        if room:
            for x in "ua":
                go(i, initials + x, cost + 3, audit + "I", room - 1)
        if i < len(rows):
            x, fault = rows[i]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                if x in "sua":
                    go(i + 1, initials + x, cost + more, audit + "K", room)
                for y in "ua":
                    go(i + 1, initials + y, cost + 3 + more, audit + "R", room)
            go(i + 1, initials, cost + 4, audit + "D", room)

    go(0, "", 0, "", len(rows) + 2 if most is None else most)
    return best


def test_least_audit_equals_all_edits_tried():
    rng = random.Random(1)
    kinds = [(x, f) for x in "suax" for f in ("", "blank", "truncated")]
    for rows in [[k] for k in kinds] + [list(k) for k in itertools.product(kinds, repeat=2)] + [[rng.choice(kinds) for _ in range(rng.randint(3, 5))] for _ in range(40)]:
        assert repair.finished(repair.parsed([repair.row_cell(*r) for r in rows])) == cheapest(rows, 4)


def test_every_split_of_every_span_gives_the_same_cell():
    """The whole triangle of spans with all splits, as the general algorithm fills it."""
    rng = random.Random(2)
    for n in (1, 2, 3, 5, 8, 13):
        ones = [repair.row_cell(rng.choice("suax"), rng.choice(("", "", "blank", "truncated")), rng.choice((1, 1, 3))) for _ in range(n)]
        spans = {(i, i + 1): cell for i, cell in enumerate(ones)}
        for length in range(2, n + 1):
            for i in range(n - length + 1):
                cells = [repair.combined(spans[i, k], spans[k, i + length]) for k in range(i + 1, i + length)]
                assert all(c == cells[0] for c in cells)
                spans[i, i + length] = cells[0]
        assert repair.parsed(ones) == spans[0, n]


def brute(table):
    """Straight from the definition; rows of one turn come by role, first 32 characters and MD5."""
    out = {}
    for conv in dict.fromkeys(r[0] for r in table):
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            rows += [(turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in rows:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, *_ in rows if t is not None}
        cost, audit = cheapest([(r[1][:1] or "?", f) for r, f in zip(rows, faults)], 3)
        size, place, lines, left = len(audit) - audit.count("D"), 0, [], iter(rows)
        for e in audit:
            row = None if e == "I" else next(left)
            if e != "D":
                role = row[1] if e == "K" else ("user", "assistant")[(place - size % 2) % 2]
                lines.append(f"{role}:{row[2] if row else ''}")
                place += 1
        count = faults.count
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table():
    rng = random.Random(7)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 5)):
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "No", "é?", "", " \t\n", None, "Why! \n", "Yes."])))
    rows += [(50, 1, "user", "same.")] * 4 + [(51, 2**63 - 1, "user", "a."), (51, -(2**63), "assistant", "b.")] + [(52, None, "user", "x" * 40 + "."), (52, None, "user", "x" * 41 + ".")]
    return rows


@pytest.mark.parametrize("stretch", [4096, 1])
def test_query_equals_brute_force_on_odd_rows(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(repair, "STRETCH", stretch)
    rows = table()
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r["conv_id"]: tuple(r[n] for n in names) for r in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    want = brute(rows)
    want[51] = (2**63 - 1, *want[51][1:]) if want[51][0] >= 2**63 else want[51]
    assert got == want


def test_long_conversation_and_repaired_rows(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(9001) if t % 1000] + [(2, 0, "system", "Be brief."), (2, 1, "user", "Hm."), (2, 1, "user", "Hm.")]
    summary, repaired = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r["conv_id"]: r for r in summary.collect()}
    assert (found[1]["gaps"], found[1]["illegal"], found[1]["duplicate"]) == (8, 8, 0) and found[2]["audit"] == "KKDI" and found[2]["duplicate"] == 1
    lines = [r for r in repaired.filter("conv_id = 1").orderBy("place").collect()]
    assert [r["place"] for r in lines] == list(range(len(lines))) and len(lines) % 2 == 0
    assert all(r["role"] == ("user", "assistant")[r["place"] % 2] for r in lines)
    assert len(found[1]["audit"]) == 8991 + found[1]["audit"].count("I")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_conversation_repair(spark, str(tmp_path)).count() == 0
