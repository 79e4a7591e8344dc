import random

import compare
import numpy as np
from pyspark.sql import functions as F

from leafsift.llm import hard_negatives
from leafsift.llm.hard_negatives import Packed
from leafsift.llm.queries import QUERIES, SQL


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare.difference(QUERIES["op13_hard_negatives"](spark, sf), compare.connect(sf), SQL["op13_hard_negatives"]) is None


def test_packed_products_are_exact():
    rng = random.Random(5)
    for rows, dims, size in ((1, 1, 1), (7, 3, 9), (300, 16, 160), (50, 8, 1 << 30), (20, 4, 1 << 52), (9, 3, 1 << 90)):
        x = [[rng.randint(-size, size) for _ in range(dims)] for _ in range(rows)]
        asks = [[rng.randint(-size, size) for _ in range(dims)] for _ in range(5)] + [[0] * dims, [-size] * dims, [size] * dims]
        packed = Packed(np.array(x, object if size > 1 << 53 else np.int64), max(sum(map(abs, a)) for a in asks))
        for a in asks:
            want = [max(hard_negatives.LEAST, min(hard_negatives.MOST, sum(p * q for p, q in zip(a, v)))) for v in x]
            assert packed.scores(a).tolist() == want


def brute(rows, step):
    """Straight from the definition; rows are (id, vector, label)."""
    fine = [(i, [int(c // step) for c in np.array(e, np.float32).astype(float)], y) for i, e, y in rows if y is not None and e and all(c is not None and np.isfinite(c) for c in e)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for n, (i, a, y) in enumerate(fine):
        if i is None or i % 10:
            continue
        scored = [(dot(a, c), j, z == y) for m, (j, c, z) in enumerate(fine) if m != n]
        for s, j, _ in sorted((r for r in scored if r[2]), key=key)[:3]:
            near = sorted((r for r in scored if not r[2] and 50 * s <= 100 * r[0] <= 90 * s), key=key)[:4]
            out += [(i, j, k, r[1], s, r[0]) for k, r in enumerate(near, 1)]
    return out


def test_odd_rows_many_blocks_and_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [round(float(v), 1) for v in rng.normal(size=4)], int(rng.choice([1, 1, 1, 2, 3]))) for i in range(150)]
    rows += [(200, None, 1), (210, [1.0, None], 1), (220, [float("nan")], 1), (230, [float("inf")], 1), (240, [], 1), (250, [1.0, 1.0], None)]
    rows += [(None, [1.0, 1.0, 1.0, 1.0], 1), (None, [-1.0, 1.0], 2), (260, [0.5], 2), (10, rows[10][1], rows[10][2]), (270, [0.0] * 4, 1), (280, [1.0] * 6, 3)]
    table = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], "vec_id long, embedding array<float>, label int, row int, place string, block int").repartition(3)
    found = hard_negatives.mine(table, F.col("label"), F.col("vec_id") % 10 == 0, positives=3, negatives=4, low=50, high=90, step=1 / 4, block_rows=20, group_rows=5)
    key = lambda row: tuple((v is None, v or 0) for v in row)
    got = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found.collect()]
    assert got and sorted(got, key=key) == sorted(brute(rows, 0.25), key=key)


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)]):
        assert hard_negatives.mine(spark.createDataFrame(rows, schema), F.col("label"), F.col("vec_id") % 100 == 0).count() == 0
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [1e30], 2), (3, [0.9], 2)]
    assert [r["negative_id"] for r in hard_negatives.mine(spark.createDataFrame(rows, schema), F.col("label"), F.col("vec_id") % 100 == 0).collect()] == [3]
