import compare
import numpy as np
from pyspark.sql import functions as F

from leafsift.llm import impact_search
from leafsift.llm.impact_search import ImpactIndex
from leafsift.llm.queries import QUERIES, SQL


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare.difference(QUERIES["op2_impact_search"](spark, sf), compare.connect(sf), SQL["op2_impact_search"]) is None


def brute(ids, x, own, q, k):
    rows = sorted((-int(v @ q), int(i)) for i, v in zip(ids, x) if i != own)
    return [(i, -s) for s, i in rows[:k]]


def test_index_equals_brute_force():
    rng = np.random.default_rng(3)
    for rows, dims, spread in ((1, 4, 9), (3, 4, 9), (700, 8, 3), (2000, 32, 200), (1500, 16, 1)):
        x = rng.integers(-spread, spread + 1, (rows, dims))
        x[rows // 2 :] = x[rows // 2]  # many ties
        ids = rng.permutation(rows)
        index = ImpactIndex(ids, x)
        for own in range(0, min(rows, 40)):
            q = x[list(ids).index(own)] if own % 2 else rng.integers(-spread, spread + 1, dims)
            found = list(zip(*(a.tolist() for a in index.search(q, own, 5))))
            assert found == brute(ids, x, own, q, 5)


def test_zero_query_and_all_negative_scores():
    x = np.array([[-1, -2], [-3, -1], [-2, -2]])
    index = ImpactIndex(np.arange(3), x)
    assert index.search(np.array([0, 0]), 9, 2)[0].tolist() == [0, 1]
    assert index.search(np.array([5, 5]), 9, 5)[1].tolist() == [-15, -20, -20]


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "s", 2) for i, e in rows], "vec_id long, embedding array<float>, score int, rank string, block int")


def test_odd_vectors_and_many_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(120)]
    odd = [(200, None), (250, [1.0, None, 2.0]), (300, [float("nan")] * 6), (350, [float("inf")] * 6), (400, []), (None, [1.0] * 6), (450, [1.0, 2.0]), (50, rows[50][1])]
    found = impact_search.search(table(spark, rows + odd), F.col("vec_id") % 50 == 0, k=5, block_rows=16).collect()
    held = [(i, np.floor(np.array(e + [0.0] * (6 - len(e)), np.float32).astype(float) * 256).astype(int)) for i, e in rows + [(450, [1.0, 2.0]), (50, rows[50][1])]]
    for own in (0, 50, 100, 450):
        q = next(v for i, v in held if i == own)
        want = brute([i for i, _ in held], [v for _, v in held], own, q, 5)
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == own)
        assert [m[1:] for m in mine] == want and [m[0] for m in mine] == [1, 2, 3, 4, 5]
    assert {r["query_id"] for r in found} == {0, 50, 100, 450}


def test_few_and_no_rows(spark):
    assert impact_search.search(table(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    assert impact_search.search(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert impact_search.search(table(spark, [(0, [1.0]), (1, [2.0])]), F.col("vec_id") % 50 == 0).count() == 1


def test_one_id_on_most_rows_is_dealt_to_all_blocks(spark):
    rows = [(7 if i % 3 else i, [float(i % 11), 1.0]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = impact_search.search(vectors, F.col("vec_id") % 30 == 0, block_rows=40).collect()
    x = [(i, [int(256 * c) for c in v]) for i, v in rows]
    for q, v in x:
        if q % 30 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in x if i != q)[:5]
            got = sorted((r["rank"], -r["score"], r["vec_id"]) for r in found if r["query_id"] == q)
            assert [g[1:] for g in got] == want
