import random
import re

import compare
import samples
from pyspark.sql import functions as F

from leafsift.llm import decontamination
from leafsift.llm.queries import QUERIES, SQL

ITEMS = "item_id long, text string, mark long, words string"


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op12_decontamination"](spark, sf)
    assert compare.difference(found, compare.connect(sf), SQL["op12_decontamination"]) is None
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items, span):
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, body in items:
            v = words(body)
            n = min(span, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), sorted(ids)))
    return out


def check(spark, docs, items, span, gram):
    benchmark = spark.createDataFrame([(*i, 1, "w") for i in items], ITEMS)
    found = decontamination.scan(samples.docs(spark, docs), benchmark, span=span, gram=gram)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()), key=key)
    assert got == sorted(brute(docs, items, span), key=key)
    return got


def test_equals_brute_force_on_texts_of_few_words(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("aBc") for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(120)]
    items = [(i, text(rng.randint(5, 30))) for i in range(12)]
    for span, gram in ((6, 3), (7, 7), (5, 1)):
        assert any(r[2] for r in check(spark, docs, items, span, gram))


def test_short_items_repeats_ties_and_odd_texts(spark):
    passage = "One two THREE four five, six-seven eight 9 ten eleven twelve"
    item = "four five six seven"
    docs = samples.ODD + [
        (20, passage),
        (21, "x " + passage.lower().replace(" ", "\n\t") + " y"),
        (22, "a b " + item),
        (23, samples.LONG + passage + " " + samples.LONG),
        (24, (passage + " ") * 300),
        (25, "été Étés ÉTÉ one"),
        (25, "one two three four five six seven eight 9"),
    ]
    items = [(1, passage), (1, "été étés"), (2, None), (3, ""), (4, "..."), (5, item), (None, "no id at all"), (10, "one"), (6, passage + " tail"), (7, "ÉTÉ")]
    got = {r[0]: r for r in check(spark, docs, items, 10, 5)}
    assert got[20][3] == ["1", "10", "5", "6"] and got[23][2] == got[20][2] and got[None][2:] == (4, [])


def test_every_offset_of_a_shared_window(spark):
    rng = random.Random(9)
    other = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    window = other(10)
    docs = [(i, " ".join(other(i) + window + other(37 - i))) for i in range(38)] + [(90 + i, " ".join(window[:i] + ["z"] + window[i:])) for i in range(1, 10)]
    got = check(spark, docs, [(3, " ".join(other(13) + window + other(8)))], 10, 5)
    assert [r[2] for r in got] == [10] * 38 + [0] * 9


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    rows = decontamination.scan(samples.docs(spark, samples.ODD), none).collect()
    assert len(rows) == len(samples.ODD) and not any(r["n_hit"] for r in rows)
    assert decontamination.scan(samples.docs(spark, []), none).count() == 0
    assert decontamination.scan(samples.docs(spark, []), none.select(F.lit(1).alias("item_id"), F.lit("a b").alias("text"))).count() == 0
