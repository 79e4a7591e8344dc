import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafsift.operators import diversify as D
from leafsift.operators import keywords as K
from leafsift.operators import linear as M
from leafsift.operators import vectors as W
from leafsift.operators.encoding import as_examples


def examples(spark, rows, partitions=3):
    data = [(float(y), sorted(x), [x[i] for i in sorted(x)]) for y, x in rows]
    return spark.createDataFrame(data, "y double, idx array<int>, value array<double>").repartition(partitions)


def random_rows(seed, n, width):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = {i: rng.choice([1.0, 2.5, -1.0]) for i in rng.sample(range(width), 5)}
        y = 1 if x.get(0, 0) + x.get(1, 0) - x.get(2, 0) + rng.gauss(0, 0.7) > 0 else -1
        rows.append((y, x))
    return rows


def objective_and_gradient(rows, w, c, width):
    g, loss = np.zeros(width + 1), 0.0
    for y, x in rows:
        x = {**x, width: 1.0}
        slack = max(0.0, 1 - y * sum(w[i] * v for i, v in x.items()))
        loss += slack**2
        for i, v in x.items():
            g[i] -= 2 * c * slack * y * v
    return np.abs(w).sum() + c * loss, g


def test_fit_meets_the_optimality_conditions(spark):
    width, c = 40, 0.3
    rows = random_rows(1, 150, width)
    fit = M.fit_l1_svm(examples(spark, rows), c, width=width, tol=1e-8)
    objective, g = objective_and_gradient(rows, fit.weights, c, width)
    assert abs(objective - fit.objective) < 1e-8
    for w, slope in zip(fit.weights, g):
        if w == 0:
            assert abs(slope) <= 1 + 1e-6
        else:
            assert abs(slope + np.sign(w)) <= 1e-6
    assert 0 < np.count_nonzero(fit.weights) < width
    rng = np.random.default_rng(0)
    for _ in range(200):
        other = fit.weights + rng.normal(0, 0.05, width + 1) * (rng.random(width + 1) < 0.3)
        assert objective_and_gradient(rows, other, c, width)[0] >= objective - 1e-9


def test_small_working_set_and_partitions_give_the_same_fit(spark):
    rows = random_rows(2, 120, 40)
    one = M.fit_l1_svm(examples(spark, rows, 1), 0.2, width=40, tol=1e-8)
    many = M.fit_l1_svm(examples(spark, rows, 6), 0.2, width=40, tol=1e-8, working_size=8)
    assert np.allclose(one.weights, many.weights, atol=1e-5)


def test_duality_gap_proves_the_optimum_and_shows_what_is_none(spark):
    rows, c, width = random_rows(7, 90, 25), 0.3, 25
    data = examples(spark, rows).withColumn("weight", F.lit(2.0))
    model = lambda w: spark.createDataFrame([("m", -1 if i == width else i, float(v)) for i, v in enumerate(w)], "model string, idx int, weight double")
    best = M.fit_l1_svm(data, c, width=width, tol=1e-9)
    found = M.duality_gap(data, model(best.weights), c).first()
    assert abs(found["primal"] - best.objective) < 1e-6 and -1e-6 < found["gap"] < 1e-5 * found["primal"]
    rng = np.random.default_rng(0)
    for w in (np.zeros(width + 1), best.weights + 0.1, best.weights * 0.9, rng.normal(size=width + 1)):
        off = M.duality_gap(data, model(w), c).first()
        slack = np.array([max(0.0, 1 - y * (sum(w[i] * v for i, v in x.items()) + w[-1])) for y, x in rows])
        assert abs(off["primal"] - (np.abs(w).sum() + c * 2 * (slack**2).sum())) < 1e-6
        assert off["dual"] <= best.objective + 1e-6 and off["gap"] > 1e-3 * off["primal"]  # never above the optimum


def test_weighted_rows_equal_repeated_rows(spark):
    rows = random_rows(3, 60, 20)
    repeated = [r for i, r in enumerate(rows) for _ in range(1 + i % 3)]
    data = [(float(y), float(1 + i % 3), sorted(x), [x[k] for k in sorted(x)]) for i, (y, x) in enumerate(rows)]
    weighted = spark.createDataFrame(data, "y double, weight double, idx array<int>, value array<double>")
    a = M.fit_l1_svm(weighted, 0.2, width=20, tol=1e-8)
    b = M.fit_l1_svm(examples(spark, repeated), 0.2, width=20, tol=1e-8)
    assert np.allclose(a.weights, b.weights, atol=1e-6)


def test_a_fit_that_stops_early_says_so(spark):
    rows = random_rows(4, 80, 30)
    with pytest.raises(RuntimeError, match="not converged"):
        M.fit_l1_svm(examples(spark, rows), 0.3, width=30, max_rounds=1, tol=1e-9)
    rough = M.fit_l1_svm(examples(spark, rows), 0.3, width=30, max_rounds=1, tol=1e-9, inexact=True)
    assert not rough.converged and rough.violation > 1e-9


def test_more_features_held_than_the_working_set(spark):
    rows = random_rows(5, 400, 60)
    fit = M.fit_l1_svm(examples(spark, rows), 1.0, width=60, tol=1e-3, working_size=16)
    assert np.count_nonzero(fit.weights) > 20 and fit.converged


def test_the_model_of_many_events_on_few_articles_is_solved():
    # every article is liked and hated thousands of times and has more features than there are articles
    rng = np.random.default_rng(6)
    x = (rng.random((100, 256)) < np.linspace(0.9, 0.02, 256)).astype(float)
    n = 24000 + rng.integers(-300, 300, (2, 100))
    h, g = 0.2 * x.T @ (x * n.sum(axis=0)[:, None]), 0.2 * x.T @ (n[1] - n[0])
    d = M._solve_model(np.zeros(256), g, h)
    assert M.violations(d, g + h @ d).max() < 1e-3 and np.count_nonzero(d) > 10


def test_features_without_a_position_are_no_part_of_an_example(spark):
    rows = spark.createDataFrame([(1, 5, 1.0), (1, None, 1.0), (1, 2, 1.0), (2, None, 1.0)], "id long, idx int, value double")
    assert {r["id"]: (r["idx"], r["value"]) for r in as_examples(rows, ["id"]).collect()} == {1: ([2, 5], [1.0, 1.0]), 2: ([], [])}


def test_a_working_set_has_violators_and_held_features():
    w, off = np.zeros(40), np.zeros(40)
    w[:20], off[10:35] = 1.0, np.arange(25) + 1.0
    assert M._working_set(w, off, 8).tolist()[:4] == [34, 33, 32, 31]
    assert sorted(M._working_set(w, off, 40)) == list(range(35))
    assert len(set(M._working_set(w, off, 8).tolist())) == 8


def test_one_class_and_no_rows_are_refused(spark):
    with pytest.raises(ValueError, match="both classes"):
        M.fit_l1_svm(examples(spark, [(1, {0: 1.0})]), 0.1, width=3)
    with pytest.raises(ValueError, match="both classes"):
        M.fit_l1_svm(examples(spark, [(1, {0: 1.0})]).limit(0), 0.1, width=3)


def test_model_is_stored_and_scores(spark, tmp_path):
    fit = M.fit_l1_svm(examples(spark, [(1, {0: 1.0}), (-1, {1: 1.0})] * 20), 1.0, width=3)
    M.save_model(fit.to_frame(spark, "tiny"), str(tmp_path / "m"))
    model = M.load_model(spark, str(tmp_path / "m"), "tiny")
    entries = [(1, [(0, 1.0)]), (2, [(1, 1.0)]), (3, [(2, 1.0)])]
    encoded = spark.createDataFrame(entries, "id long, entries array<struct<idx:int,value:double>>")
    scores = {r["id"]: r["score"] for r in M.decision_values(encoded, model).collect()}
    assert scores[1] > 0 > scores[2] and abs(scores[3] - fit.weights[3]) < 1e-9
    shown = {r["idx"]: r["weight"] for r in M.nonzero_weights(model).collect()}
    assert shown == {i: int(fit.weights[i] * 1e3) / 1e3 for i in np.flatnonzero(fit.weights[:3])}


def loop(rows, threshold):
    """The plain row-by-row rule on dense vectors."""
    kept = []
    for score, id_, vector in sorted(rows, key=lambda r: (-r[0], r[1])):
        norm = {t: w for t, w in vector.items()}
        if all(sum(w * k[2].get(t, 0) for t, w in norm.items()) < threshold for k in kept):
            kept.append((score, id_, norm))
    return [(k[0], k[1]) for k in kept]


def vectors(spark, rows):
    data = [(s, i, sorted(v), [v[t] for t in sorted(v)]) for s, i, v in rows]
    return spark.createDataFrame(data, "score double, id long, terms array<string>, weights array<double>").repartition(5)


def random_vectors(seed, n, vocabulary, per_row):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.sample(range(vocabulary), rng.randint(0, per_row))
        raw = {f"w{w}": rng.random() + 0.1 for w in words}
        if i % 3 == 0:
            raw["hot"] = 0.2  # a third of all rows share one word
        norm = sum(x * x for x in raw.values()) ** 0.5 or 1.0
        rows.append((round(rng.random(), 1), i, {t: x / norm for t, x in raw.items()}))
    return rows


@pytest.mark.parametrize("block,budget", [(2, 10), (16, 60), (256, 2_000_000)])
def test_diversified_equals_the_loop(spark, block, budget):
    rows = random_vectors(block, 120, 150, 6)
    got = D.diversify(vectors(spark, rows), top=1000, threshold=0.05, block=block, budget=budget).orderBy("rank").collect()
    want = loop(rows, 0.05)
    assert [(r["score"], r["id"]) for r in got] == want and 5 < len(want) < 120
    top = D.diversify(vectors(spark, rows), top=5, block=block, budget=budget).orderBy("rank").collect()
    assert [(r["score"], r["id"]) for r in top] == want[:5]


def test_more_than_five_thousand_kept_rows_equal_the_loop(spark):
    """No limit: nearly every row has a word of its own; every seventh repeats the row seven before."""
    rows = []
    for i in range(6500):
        words = {f"own{i}": 1.0} if i % 7 else {f"own{max(0, i - 6)}": 1.0}
        rows.append((float(i % 100), i, words))
    got = D.diversify(vectors(spark, rows), threshold=0.5, budget=3000).orderBy("rank").collect()
    seen, want = set(), []
    for score, id_, words in sorted(rows, key=lambda r: (-r[0], r[1])):  # equal words or none in common
        if not words.keys() & seen:
            seen |= words.keys()
            want.append((score, id_))
    assert [(r["score"], r["id"]) for r in got] == want and len(want) > 5000
    assert [r["rank"] for r in got] == list(range(1, len(want) + 1))


def test_similarities_to_kept_rows_in_parts(spark):
    rows = random_vectors(6, 60, 25, 6)
    by_id = {i: v for _, i, v in rows}
    frame = vectors(spark, rows)
    kept = frame.filter("id < 20").withColumn("rank", (F.col("id") + 1).cast("int"))
    cosine = lambda a, b: sum(w * by_id[b].get(t, 0) for t, w in by_id[a].items())
    for budget in (7, 10_000):
        near = {(r["id"], r["target"]): r["similarity"] for r in D.similar_to(frame, kept, 0.3, budget).collect()}
        want = {(i, k): cosine(i, k) for i in by_id for k in range(20) if cosine(i, k) >= 0.3}
        assert near.keys() == want.keys() and all(abs(near[p] - want[p]) < 1e-12 for p in want)
        best = {r["id"]: r["similarity"] for r in D.best_similarity(frame, kept, budget).collect()}
        assert all(abs(best[i] - max(cosine(i, k) for k in range(20))) < 1e-12 for i in by_id)
    assert D.similar_to(frame, kept.limit(0), 0.3).count() == 0


def test_kept_vectors_do_not_pass_through_the_driver(spark, monkeypatch):
    """Many parts of kept rows meet the rows they may resemble by equi-joins; no part of them is collected."""
    rows = random_vectors(4, 60, 30, 8)
    frame = vectors(spark, rows)
    kept = frame.withColumn("rank", (F.col("id") + 1).cast("int"))
    monkeypatch.setattr(type(frame), "toArrow", lambda self: pytest.fail("kept rows on the driver"))
    for found in (D.similar_to(frame, kept, 0.3, 20), D.best_similarity(frame, kept, 20)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("MapInArrow") == 1
        assert found.count() >= len(rows)
    assert D.diversify(frame, threshold=0.3).count() == len(loop(rows, 0.3))


@pytest.mark.parametrize("threshold", [0.0, 0.05, 0.3, 0.7, 0.95, 1.0])
def test_prefix_index_equals_all_products(monkeypatch, threshold):
    import pyarrow as pa

    rows = [v for _, _, v in random_vectors(11, 90, 40, 9)] + [{}, {"hot": 1.0}, {"w1": 0.6, "w2": 0.8}, {"w1": 0.6, "w2": 0.8}]
    lists = pa.array([sorted(v) for v in rows], pa.list_(pa.string())), pa.array([[v[t] for t in sorted(v)] for v in rows], pa.list_(pa.float64()))
    cosine = np.array([[sum(w * b.get(t, 0) for t, w in a.items()) for b in rows[:50]] for a in rows])
    want = {(i, j) for i, j in zip(*np.nonzero(cosine >= threshold)) if abs(cosine[i, j] - threshold) > 1e-9 or threshold in (0.0, 1.0)}
    for cells in (4_000_000, 70):
        monkeypatch.setattr(D, "_CELLS", cells)
        index = D.PrefixIndex(lists[0].slice(0, 50), lists[1].slice(0, 50), threshold)
        row, owner, value = index.pairs(*lists)
        if threshold == 1.0:  # sums of squares may miss it by a rounding
            assert set(zip(row, owner)) <= {(i, j) for i, j in zip(*np.nonzero(cosine >= 1 - 1e-9))}
        else:
            assert set(zip(row, owner)) >= want and np.allclose(value, cosine[row, owner]) and (value >= threshold).all()
    if threshold >= 0.95:
        assert len(index.head.owner) < len(index.tail.owner)


@pytest.mark.parametrize("squares,step,tried,groups", [(1_000_000, 65_536, 16, 32), (130, 3, 0, 2), (1, 1, 2, 4)])
def test_highest_cosine_equals_all_products(monkeypatch, squares, step, tried, groups):
    import pyarrow as pa

    for name, value in (("_SQUARES", squares), ("_STEP", step), ("_TRIED", tried), ("_GROUPS", groups)):
        monkeypatch.setattr(D, name, value)
    rows = [v for _, _, v in random_vectors(12, 90, 40, 14)] + [{}, {"hot": 1.0}, {"nowhere": 1.0}, {"w1": 0.6, "w2": 0.8}, {"w1": -0.6, "w2": -0.8}, {"w3": 3.0, "hot": 40.0}]
    kept = rows[:50] + [rows[7], {}, {"hot": 1.0}]
    lists = lambda some: (pa.array([list(v) for v in some], pa.list_(pa.string())), pa.array([list(v.values()) for v in some], pa.list_(pa.float64())))
    cosine = np.array([[sum(w * b.get(t, 0) for t, w in a.items()) for b in kept] for a in rows])
    assert np.allclose(D.BestIndex(*lists(kept)).best(*lists(rows)), cosine.max(axis=1), rtol=0, atol=1e-12)
    assert D.BestIndex(*lists([])).best(*lists(rows)).tolist() == [0.0] * len(rows) and len(D.BestIndex(*lists(kept)).best(*lists([]))) == 0


def test_highest_cosine_meets_few_postings_of_frequent_words(monkeypatch):
    """Kept rows share words that weigh little: a row whose best is far ahead of the others meets hardly any of their entries."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = []
    for i in range(400):
        words = {f"own{i}": 0.9, **{f"often{j}": 0.08 * rng.random() for j in rng.sample(range(12), 8)}}
        norm = sum(x * x for x in words.values()) ** 0.5
        rows.append({t: x / norm for t, x in words.items()})
    lists = pa.array([list(v) for v in rows], pa.list_(pa.string())), pa.array([list(v.values()) for v in rows], pa.list_(pa.float64()))
    met, meet = [], D.Postings.meet

    def counted(self, *args):
        for found in meet(self, *args):
            met.append(len(found[0]))
            yield found

    monkeypatch.setattr(D.Postings, "meet", counted)
    best = D.BestIndex(*lists).best(*lists)
    assert np.allclose(best, 1.0) and sum(met) < 400 * 400 * 8 * 8 / 12 / 10


def test_highest_cosine_by_id(spark):
    """A row for each row, with the highest cosine of all rows of its id; 0 without an id. In one part rows are met by few tasks, and once only."""
    rows = [(1, ["a", "b"], [0.6, 0.8]), (1, ["c"], [1.0]), (2, ["b"], [1.0]), (2, ["b"], [1.0]), (None, ["a"], [1.0]), (3, ["z"], [1.0]), (4, [], [])]
    rows = spark.createDataFrame(rows, "id bigint, terms array<string>, weights array<double>").repartition(100)
    kept = spark.createDataFrame([(1, 7, ["a"], [1.0]), (2, 8, ["b", "c"], [0.6, 0.8])], "rank int, id bigint, terms array<string>, weights array<double>")
    for budget in (1, 4_000_000):
        found = D.best_similarity(rows, kept, budget)
        got = sorted(((r["id"] or 0, round(r["similarity"], 9)) for r in found.collect()))
        assert got == [(0, 0.0), (1, 0.8), (1, 0.8), (2, 0.6), (2, 0.6), (3, 0.0), (4, 0.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "terms" not in plan
    assert {r["similarity"] for r in D.best_similarity(rows, kept.limit(0)).collect()} == {0.0}
    assert D.similar_to(rows, kept, 0.3).rdd.getNumPartitions() <= max(32, 4 * spark.sparkContext.defaultParallelism)


def test_prefixes_send_rows_to_few_parts(spark):
    """At a high threshold a row is sent only to the parts whose heads share a word with it."""
    rows = [(float(i), i, {f"own{i // 2}": 0.9, "common": 0.19**0.5}) for i in range(200)]
    frame = vectors(spark, rows)
    kept = frame.withColumn("rank", (F.col("id") + 1).cast("int"))
    found = D.similar_to(frame, kept, 0.8, 10).collect()
    assert {(r["id"], r["target"]) for r in found} == {(i, j) for i in range(200) for j in (i - i % 2, i - i % 2 + 1)}
    parts = D.kept_parts(kept, 10)
    assert parts.select("_part").distinct().count() > 20


@pytest.mark.parametrize("budget", [20, 4_000_000])
def test_few_kept_rows_of_distant_ranks_are_one_part(spark, budget):
    """Parts are filled whatever the ranks; rows stay where they are if there is one."""
    rows = random_vectors(9, 60, 30, 8)
    by_id = {i: v for _, i, v in rows}
    frame = vectors(spark, rows)
    kept = frame.filter("id < 25").withColumn("rank", F.col("id") * 5000 + 1)
    parts = D.kept_parts(kept, budget).groupBy("_part").agg(F.sum(F.size("terms")).alias("n")).collect()
    assert len(parts) == 1 if budget > 20 else 1 < len(parts) < 12 and max(p["n"] for p in parts) < 30
    found = D.similar_to(frame, kept, 0.3, budget, keep=("score",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange hashpartitioning" in plan) == (budget == 20)
    score = {i: s for s, i, _ in rows}
    got = {(r["id"], r["target"]): (r["score"], r["target_score"]) for r in found.collect()}
    cosine = {(a, b): sum(w * by_id[b].get(t, 0) for t, w in by_id[a].items()) for a in by_id for b in range(25)}
    assert got == {(a, b): (score[a], score[b]) for (a, b), c in cosine.items() if c >= 0.3}


@pytest.mark.parametrize("budget", [3, 4_000_000])
def test_rows_that_resemble_kept_ones_are_left_out_by_id(spark, budget):
    """All rows of an id go if one does; rows without an id stay. No vector of a row that goes is moved where kept rows are one part."""
    rows = [(1.0, 1, ["a"], [1.0]), (1.0, 2, ["b"], [1.0]), (1.0, 2, ["c"], [1.0]), (1.0, 3, ["c", "d"], [0.6, 0.8]), (1.0, 4, [], []), (1.0, 5, ["e"], [1.0])]
    rows = spark.createDataFrame(rows, D.VECTOR_ROWS)
    kept = spark.createDataFrame([(1, 9.0, 8, ["b"], [1.0]), (9000, 9.0, 9, ["a", "x"], [0.6, 0.8])], "rank int, " + D.VECTOR_ROWS)
    left = D.without_similar(rows, kept, 0.5, budget)
    assert sorted(map(tuple, left.select("id", "terms", "weights", "score").collect())) == [(3, ["c", "d"], [0.6, 0.8], 1.0), (4, [], [], 1.0), (5, ["e"], [1.0], 1.0)]
    if budget > 3:
        nameless = rows.unionByName(spark.createDataFrame([(0.5, None, ["b"], [1.0])], D.VECTOR_ROWS))
        assert {r["id"] for r in D.without_similar(nameless, kept, 0.5, budget).collect()} == {None, 3, 4, 5}


def graph_loop(n, edges):
    better = {}
    for hi, lo in edges:
        better.setdefault(hi, []).append(lo)
    kept = {}
    for i in range(n):
        kept[i] = not any(kept[j] for j in better.get(i, ()))
    return kept


@pytest.mark.parametrize("bucket", [1, 7, 8192])
def test_rounds_settle_chains_stars_and_random_graphs(spark, monkeypatch, bucket):
    monkeypatch.setattr(D, "_BUCKET", bucket)
    rng = random.Random(bucket)
    n = 24
    graphs = {
        "chain": [(i, i - 1) for i in range(1, n)],
        "star": [(i, 0) for i in range(1, n)],
        "late star": [(n - 1, i) for i in range(n - 1)],
        "random": sorted({(max(a, b), min(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(40)) if a != b}),
    }
    for name, edges in graphs.items():
        state, rounds = D.settle(spark.createDataFrame(edges, "hi long, lo long").repartition(3))
        got = {r["hi"]: r["kept"] for r in state.collect()}
        want = graph_loop(n, edges)
        assert all(got[i] == want[i] for i in got) and {hi for hi, _ in edges} <= got.keys()
        assert rounds <= -(-n // bucket) and (rounds == 1 or bucket < n)
        assert rounds == 1 or "star" not in name


def test_a_long_chain_of_rows_equals_the_loop(spark):
    """Every row resembles its neighbours only, so every second stays."""
    rows = [(float(-i), i, {f"e{i}": 0.5**0.5, f"e{i + 1}": 0.5**0.5}) for i in range(3000)]
    assert [r["id"] for r in D.diversify(vectors(spark, rows), threshold=0.4).orderBy("rank").collect()] == list(range(0, 3000, 2))


def test_chain_keeps_both_ends(spark):
    rows = [(3.0, 1, {"x": 1.0}), (2.0, 2, {"x": 0.6, "y": 0.8}), (1.0, 3, {"y": 1.0})]
    kept = D.diversify(vectors(spark, rows), top=10, threshold=0.5).collect()
    assert sorted(r["id"] for r in kept) == [1, 3]


def test_no_candidates_give_an_empty_list(spark):
    assert D.diversify(vectors(spark, [(1.0, 1, {"a": 1.0})]).limit(0), top=3).count() == 0


def test_global_rank(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("s"))
    got = D.global_rank(df, F.desc("s"), F.asc("id"), partitions=6).collect()
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert {r["id"]: r["rank"] for r in got} == {i: n + 1 for n, i in enumerate(want)}


DOCS = [(1, "apple apple pear the the the"), (2, "pear the plum"), (3, "the fig the plum plum"), (4, ""), (5, "the")]


def test_listed_and_rare_words_weigh_alike(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    results = []
    for most in (0, 1, 3, 2000):
        monkeypatch.setattr(W, "LIST_WORDS", most)
        results.append(sorted((r["id"], r["word"], round(r["weight"], 12)) for r in W.vector_entries(W.tfidf_vectors(docs, "id", "text")).collect()))
    assert results[0] == results[1] == results[2] == results[3] and len(results[0]) == 10
    idf = {w: np.log(6 / (1 + df)) + 1 for w, df in {"the": 4, "apple": 1, "pear": 2, "plum": 2, "fig": 1}.items()}
    raw = np.array([2 * idf["apple"], idf["pear"], 3 * idf["the"]])
    assert np.allclose([r[2] for r in results[0][:3]], raw / np.linalg.norm(raw))


def test_only_words_that_can_lead_are_weighed_and_ranked_alike(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices([f"w{j}" for j in range(60)], k=rng.randrange(0, 90)))) for i in range(40)]
    docs = spark.createDataFrame(texts, "id long, text string")
    every, some = (W.weighted_documents(docs, "id", "text", best=best) for best in (None, 4))
    assert some.select(F.sum(F.size("terms"))).first()[0] < every.select(F.sum(F.size("terms"))).first()[0]
    want = {r["id"]: [(-w, t) for w, t in sorted((-round(w, 9), t) for t, w in zip(r["terms"], r["weights"]))[:4]] for r in every.collect()}
    for most in (0, 10, 1000):
        monkeypatch.setattr(W, "LIST_WORDS", most)
        found = {i: [] for i in want}
        for r in K.top_keywords(docs, "id", "text", 4).orderBy("id", "rank").collect():
            found[r["id"]].append((r["weight"], r["word"]))
        assert {i: [(round(w, 9), t) for w, t in v] for i, v in found.items()} == {i: [(round(w, 9), t) for w, t in v] for i, v in want.items()}


def test_words_of_one_document_need_no_list_where_the_corpus_is_known(spark, monkeypatch):
    # two words in many documents, one of its own in each
    docs = spark.createDataFrame([(i, f"often both own{i}") for i in range(30)], "id long, text string")
    monkeypatch.setattr(W, "LIST_WORDS", 5)
    rows = K.top_keywords(docs.filter("id < 10"), "id", "text", 2, idf=W.corpus_idf(docs, "text"), complete=True)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r["id"], r["word"]) for r in rows.filter("rank = 1").collect()} == {(i, f"own{i}") for i in range(10)}


def test_a_list_longer_than_the_entries_is_looked_up():
    names, values = pa.array([f"w{i}" for i in range(1000)]), np.arange(1000.0)
    found = W._listed_idf(pa.array(["w7", "none", "w7", "w999"]), names, values, -1.0)
    assert found.tolist() == [7.0, -1.0, 7.0, 999.0]


def test_rank_words_favours_the_hub_in_each_document():
    texts = ["hub a hub b hub c hub d", "a b", "x y x z x"]
    words = sorted({w for t in texts for w in t.split()})
    doc = np.array([i for i, t in enumerate(texts) for _ in t.split()])
    word = np.array([words.index(w) for t in texts for w in t.split()])
    owner, found, score = K._rank_words(doc, word, np.array([2, 5, 2]))
    for i, hub in ((0, "hub"), (2, "x")):
        mine = np.flatnonzero(owner == i)
        assert words[found[mine[np.argmax(score[mine])]]] == hub
    alone = K._rank_words(doc[doc == 2] * 0, word[doc == 2], np.array([2]))[2]
    assert np.allclose(alone, score[owner == 2])


def test_edges_are_counted_in_the_row_and_summed_over_repeated_ids(spark):
    texts = [(1, "a b a c"), (2, "a b"), (2, "b a d"), (None, "x y"), (None, "y x"), (3, None), (4, "z")]
    rows = spark.createDataFrame(texts, "id bigint, text string")
    want = {}
    for i, text in texts:
        w = (text or "").split()
        for j in range(len(w)):
            for k in range(j + 1, min(j + 3, len(w))):
                for pair in ((w[j], w[k]), (w[k], w[j])):
                    want[i, *pair] = want.get((i, *pair), 0) + 1
    tokens = F.split("text", " ")
    assert {tuple(r)[:3]: r["weight"] for r in K.cooccurrence_edges(rows, "id", tokens, 3).collect()} == want
    grouped = K.cooccurrence_edges(rows, "id", tokens, 3, grouped=True).collect()
    assert len({(r["id"], r["src"]) for r in grouped}) == len(grouped)
    assert {(r["id"], r["src"], e["dst"]): e["weight"] for r in grouped for e in r["edges"]} == want
    alone = K.cooccurrence_edges(rows.filter("id = 1"), "id", tokens, 3, grouped=True)
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_a_batch_are_taken_a_bounded_number_of_tokens_at_a_time(monkeypatch):
    sizes = []
    rank = K._rank_words
    monkeypatch.setattr(K, "_rank_words", lambda doc, word, width: sizes.append(len(doc)) or rank(doc, word, width))
    texts = pa.array([[f"w{(i * 7 + j) % 50}" for j in range(1000)] for i in range(600)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), texts, pa.array([5] * 600, pa.int32())], ["id", "tokens", "span"])
    rows = pa.Table.from_batches(list(K._rank_batches(3)([batch])))
    assert rows.num_rows == 1800 and max(sizes) <= 200_000 and sum(sizes) == 600_000


def test_fallback_sources(spark):
    docs = spark.createDataFrame([(1, "red fox jumps red fox"), (2, "the of about fox"), (3, "the and"), (4, "")], "id long, text string")
    rows = K.tags_with_fallback(docs, "id", "text").collect()
    assert {(r["id"], r["source"]) for r in rows} == {(1, "wide"), (2, "wide"), (3, "tfidf")}
