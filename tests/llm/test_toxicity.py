import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import ODD, by_id, docs

from leafsift.llm import toxicity
from leafsift.llm.queries import QUERIES

CLEAN = "the quiet river runs past an old mill and over the stones into the green valley below".split()
RUDE = ["blorkhead", "snargle", "blorkish", "snargling"]


def corpus(n=300, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [CLEAN[j] for j in rng.integers(0, len(CLEAN), int(rng.integers(20, 200)))]
        if i % 5 == 0:
            for _ in range(max(1, len(words) // 40)):
                words.insert(int(rng.integers(0, len(words))), RUDE[int(rng.integers(0, 4))])
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


def frames(spark, rows):
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs(spark, [(i, t) for i, t, _ in rows]), labels


def test_planted_words_are_caught_and_clean_texts_left_alone(spark):
    rows = corpus()
    d, labels = frames(spark, rows)
    held = F.col("doc_id") % 3 == 0
    model = toxicity.train(d, labels, ~held & (F.col("doc_id") % 2 == 0), ~held & (F.col("doc_id") % 2 == 1))
    scores = by_id(toxicity.score(d, model))
    for i, _, y in rows:
        if i % 3 == 0:
            assert (scores[i][0]["score"] >= 0.5) == bool(y)


def grams_of(words, order):
    out = Counter()
    for w in words:
        padded = b"\x01" * (order - 1) + w.encode() + b" "
        out.update(padded[i : i + order] for i in range(len(padded) - order + 1))
    return out


def test_ratios_equal_plain_kneser_ney(spark):
    rows = corpus(60, 1)
    d, labels = frames(spark, rows)
    order = 4
    labelled = d.select("doc_id", "text").join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id")
    counted = toxicity.count_grams(labelled, order).cache()
    counts = [grams_of([w for _, t, y in rows if y == c for w in t.split()], order) for c in (0, 1)]
    number = lambda g: int.from_bytes(g, "big")
    found = {r["gram"]: (r["ordinary"], r["toxic"]) for r in counted.collect()}
    assert found == {number(g): (counts[0][g], counts[1][g]) for g in counts[0] | counts[1]}

    def discount(values):
        one, two = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return min(0.95, max(0.1, one / max(1, one + 2 * two)))

    finer, shared = set(counts[0] | counts[1]), []
    for _ in range(order - 1):
        level = Counter(g[1:] for g in finer)
        shared.append((level, discount(level.values())))
        finer = set(level)

    def backoff(g):  # g is order-1 bytes
        level, d0 = shared[order - 1 - len(g)]
        lower = 1 / 256 if len(g) == 1 else backoff(g[1:])
        same = {h: n for h, n in level.items() if h[:-1] == g[:-1]}
        total = sum(same.values())
        return (max(level[g] - d0, 0) + sum(min(d0, n) for n in same.values()) * lower) / total

    def probability(c, g):
        d0 = discount([counts[c][x] for x in counts[0] | counts[1]])
        same = {h: n for h, n in counts[c].items() if h[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return backoff(g[1:])
        return (max(counts[c][g] - d0, 0) + sum(min(d0, n) for n in same.values()) * backoff(g[1:])) / total

    of_grams, of_contexts = toxicity.log_ratios(counted, order)
    ratios = {r["key"]: r["value"] for r in of_grams.collect()}
    for g in list(counts[0] | counts[1])[::7]:
        assert ratios[number(g)] == pytest.approx(np.log(probability(1, g)) - np.log(probability(0, g)))
    assert of_contexts.count() == len({g[:-1] for g in counts[0] | counts[1]})
    context = next(iter(counts[0]))[:-1]
    assert sum(probability(0, g) for g in set(counts[0] | counts[1]) if g[:-1] == context) <= 1 + 1e-9


def test_counting_a_bounded_number_of_rows_and_released_tables(spark, monkeypatch):
    rows = corpus(80, 5)
    d, labels = frames(spark, rows)
    labelled = d.select("doc_id", "text").join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id")
    whole = {tuple(r) for r in toxicity.count_grams(labelled, 5).collect()}
    monkeypatch.setattr(toxicity, "HELD_ROWS", 50)
    assert {tuple(r) for r in toxicity.count_grams(labelled, 5).collect()} == whole
    model = toxicity.train(d, labels, F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1)
    twice = [{r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()} for _ in range(2)]
    last = toxicity.score(d, model)
    model.release()
    assert twice[0] == twice[1] == {r["doc_id"]: r["score"] for r in last.collect()}


def test_grams_stay_inside_words():
    found = toxicity.WordGrams.of(pa.array(["Ab, ab! c", None]), 3)
    assert len(found.lengths) == 2 and found.lengths.tolist() == [3, 2]
    assert [int(g).to_bytes(3, "big") for g in found.grams] == [b"\x01\x01a", b"\x01ab", b"ab ", b"\x01\x01c", b"\x01c "]


def test_odd_rows_one_class_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, ODD), none, F.lit(True), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs(spark, ODD), model).collect()} == {0.0}
    rows = corpus(100, 2)
    d, labels = frames(spark, rows)
    assert toxicity.train(d, labels.filter("toxic = 1"), F.lit(True), F.lit(True)).prior == 1.0
    model = toxicity.train(d, labels, F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1)
    scores = toxicity.score(docs(spark, ODD), model).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)
    assert len({r["score"] for r in scores if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_query_folds_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = by_id(QUERIES["op8_toxicity"](spark, sf))
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, (row,) in rows.items():
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and row["predicted"] == int(row["score"] >= 0.5)
    held = [(row["predicted"], labels[i]) for i, (row,) in rows.items() if row["held_out"] and i in labels]
    assert np.mean([p == y for p, y in held]) > 0.9


def test_every_ratio_reaches_the_score(spark, monkeypatch):
    """Document features equal a plain sum over the full n-gram tables, however few keys are sent to the tasks."""
    monkeypatch.setattr(toxicity, "HOT_GRAMS", 40)
    monkeypatch.setattr(toxicity, "HOT_WORDS", 8)
    rows = corpus(60, 3)
    d, labels = frames(spark, rows)
    model = toxicity.train(d, labels, F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1)
    grams, contexts = ({r["key"]: r["value"] for r in t.collect()} for t in (model.grams, model.contexts))
    new = "Blorkhead, riverstone (snargle) zzz the the"
    extra = [(1000, new), (1000, new), (None, new), (1001, None)]
    found = model.features(docs(spark, [(i, t) for i, t, _ in rows] + extra)).collect()
    assert len(found) == len(rows) + len(extra)
    for r in found:
        text = new if r["doc_id"] in (1000, None) else dict((i, t) for i, t, _ in rows).get(r["doc_id"]) or ""
        words, sums = [w.strip(toxicity.TRIM) for w in text.lower().split()], np.zeros(toxicity.FEATURES)
        for w in words:
            keys = [int.from_bytes(g, "big") for g in grams_of([w], toxicity.ORDER).elements()]
            whole = sum(grams.get(k, contexts.get(k >> 8, 0.0)) for k in keys)
            each = whole / len(keys)
            sums += [max(whole - 2, 0), max(each - 0.25, 0), max(each - 0.5, 0), max(each - 0.75, 0), min(max(whole, -1), 1)]
        means = sums / max(1, len(words))
        assert [r[c] for c in toxicity.NAMES] == pytest.approx([*np.log1p(50 * means[:4]), means[4]], abs=1e-4)


def test_curve_has_one_row_of_each_id(spark, monkeypatch):
    rows = corpus(40, 4)
    d, labels = frames(spark, rows)
    d = d.unionByName(docs(spark, [(1, f"again {i} blorkish") for i in range(30)]))
    seen = []
    monkeypatch.setattr(toxicity, "fit_curve", lambda x, y: seen.append(x) or np.zeros(toxicity.FEATURES + 1))
    toxicity.train(d, labels, F.col("doc_id") % 2 == 0, F.col("doc_id") < 20)
    assert [len(x) for x in seen] == [20]
