import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import ODD, by_id, docs

from leafsift.llm import passages, quality_rules
from leafsift.llm.batches import Bytes, Words
from leafsift.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] >= 2 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


TEXTS = [t for _, t in ODD] + ["a b c a b c a b", "x\nx\n x\nx\n\n\n", "###$$$ a|b <> & %%\n\na", "a\r\na\r\na"]


def test_counts_by_brute_force():
    found = quality_rules.statistics(Bytes.of(pa.array(TEXTS)))
    for i, text in enumerate(TEXTS):
        for name, want in base_counts(text).items():
            assert found[name][i] == want, (name, text and text[:40])


def test_query_counts_and_verdicts(spark):
    rows = by_id(QUERIES["op3_quality_rules"](spark, SF))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert rows.keys() == texts.keys()
    for doc_id, (row,) in rows.items():
        want = base_counts(texts[doc_id])
        assert {k: row[k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert row["base_failed"] == failed and not (failed and row["kept"])
    judged = [(row["kept"], labels[i]) for i, (row,) in rows.items() if i in labels and not row["base_failed"]]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.97


def test_held_out_accuracy_of_the_forest(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.col("doc_id") % 3 == 0
    forest = quality_rules.train(d, labels.filter(~held))
    rows = quality_rules.judge(d, forest).filter(~F.col("base_failed")).join(labels.filter(held), "doc_id").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in rows]) > 0.95


def test_forest_is_monotonic_and_flat_arrays_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] ** 2 + rng.normal(size=3000) > 0).astype(float)
    forest = quality_rules.fit_forest(x, y, directions=(1, 0, -1), trees=30)
    for feature, sign in ((0, 1), (2, -1)):
        rows = rng.normal(size=(50, 3))
        last = None
        for value in np.linspace(-4, 4, 60):
            rows[:, feature] = value
            margin = forest.margin(rows)
            assert last is None or (sign * (margin - last) >= -1e-12).all()
            last = margin
    rows = rng.normal(size=(40, 3))
    for row, margin in zip(rows, forest.margin(rows)):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert total == pytest.approx(margin)
    assert np.mean((forest.probability(x) > 0.5) == y) > 0.7


def test_odd_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.train(docs(spark, ODD), none) is None
    rows = quality_rules.judge(docs(spark, ODD), None).collect()
    assert len(rows) == len(ODD) and sum(r["doc_id"] == 9 for r in rows) == 2
    kept = quality_rules.keep(docs(spark, ODD), None)
    assert kept.columns == docs(spark, ODD).columns and {r["doc_id"] for r in kept.collect()} == set()
    assert quality_rules.judge(docs(spark, []), None).count() == 0
    assert quality_rules.keep(docs(spark, []), None).count() == 0


def test_labels_twice_or_null(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in quality_rules.labelled_ids(labels, "quality", 10).collect()} == {(1, 0), (3, 1)}


# ---------------------------------------------------------------- passages


def test_classifier_held_out_accuracy_and_folds(spark):
    rows = by_id(QUERIES["op6_quality_classifier"](spark, SF))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, (row,) in rows.items():
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.5)
    held = [(row["predicted"], labels[i]) for i, (row,) in rows.items() if row["held_out"] and i in labels]
    assert len(held) > 80 and np.mean([p == q for p, q in held]) > 0.95


def test_gradients_by_differences():
    rng = np.random.default_rng(4)
    p = passages.Parameters.fresh(rng, 0.6)
    for name in p.names():
        setattr(p, name, getattr(p, name).astype(np.float64))
    sizes = np.array([130, 10, 0, 70])
    bounds, at = passages.passage_bounds(np.concatenate([[0], np.cumsum(sizes)]))
    bag, labels = np.repeat(np.arange(4), np.diff(at)), np.array([1.0, 0, 1, 0])
    word, shape = rng.integers(0, 50, 210), rng.integers(0, 20, 210)

    def loss():
        s = passages.represent(p, passages._means(p, word, shape, bounds), bag, 4)["score"]
        return -np.mean(labels * np.log(s) + (1 - labels) * np.log(1 - s))

    found = passages.gradients(p, word, shape, bounds, bag, labels)
    for name in p.names():
        x = getattr(p, name)
        for _ in range(4):
            place = tuple(rng.integers(0, min(n, 20)) for n in x.shape)
            old = x[place]
            x[place] = old + 1e-5
            up = loss()
            x[place] = old - 1e-5
            down = loss()
            x[place] = old
            assert found[name][place] == pytest.approx((up - down) / 2e-5, abs=1e-7), name


def test_attention_finds_the_passage_that_decides():
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(300):
        word = rng.integers(0, 200, passages.PASSAGE_WORDS * 4)
        if i % 2:
            begin = passages.PASSAGE_WORDS * rng.integers(0, 4)
            word[begin : begin + 30] = 999
        bags.append((word, np.zeros(len(word), np.int64)))
        labels.append(i % 2)
    p = passages.fit(bags, np.array(labels, float), rounds=20)
    hits = 0
    for word, shape in bags[1:60:2]:
        bounds, at = passages.passage_bounds(np.array([0, len(word)]))
        v = passages.represent(p, passages._means(p, word, shape, bounds), np.zeros(4, int), 1)
        assert v["score"][0] > 0.5 and v["weight"].sum() == pytest.approx(1)
        hits += bounds[np.argmax(v["weight"])] <= np.flatnonzero(word == 999)[0] < bounds[np.argmax(v["weight"]) + 1]
    assert hits >= 27


def test_passages_of_odd_rows(spark):
    one = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    model = passages.train(docs(spark, ODD), one, F.lit(True))
    assert model.parameters is None and model.prior == 1.0
    assert {r["score"] for r in passages.score(docs(spark, ODD), model).collect()} == {1.0}
    assert passages.train(docs(spark, ODD), one.limit(0), F.lit(True)).prior == 0.5
    two = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (9, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    model = passages.train(docs(spark, ODD), two, F.lit(True))
    rows = passages.score(docs(spark, ODD), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1  # null, empty and blank alike
    assert passages.score(docs(spark, []), model).count() == 0
    kept = passages.keep(docs(spark, ODD), model)
    assert kept.columns == docs(spark, ODD).columns


def test_repeats_by_brute_force():
    rng = np.random.default_rng(1)
    word, bounds = rng.integers(0, 4, 30), np.array([0, 10, 10, 25, 30])
    found = passages.repeats(word, bounds)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        own = word[a:b].tolist()
        same = sum(x == y for x, y in zip(own, own[1:])) / max(1, len(own))
        assert found[i].tolist() == [same, (len(own) - len(set(own))) / max(1, len(own))]


def test_buckets_split_shapes():
    words = Words.of(Bytes.of(pa.array(["Hello hello HELLO!! a1 |"])))
    word, shape = passages.buckets(words)
    assert word[0] == word[1] and len(set(shape.tolist())) == 5


def test_of_a_repeated_id_the_same_row_is_learnt_in_any_order(spark):
    from leafsift.llm.quality_rules import one_of_each

    rows = [(1, "b", 2), (1, "a", 9), (1, None, 9), (2, None, None), (None, "x", 1), (None, "w", 1)]
    for order in (rows, rows[::-1]):
        found = one_of_each(spark.createDataFrame(order, "doc_id long, a string, n int").repartition(3)).collect()
        assert sorted(map(tuple, found), key=str) == sorted([(1, None, 9), (2, None, None), (None, "w", 1)], key=str)
