import re

import compare
import numpy as np
from pyspark.sql import functions as F
from samples import ODD, by_id, docs

from leafsift.llm import licenses
from leafsift.llm.queries import QUERIES, SQL


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[a-z0-9]+", low)


def runs(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(text, least=0.8):
    """Containment by exact shingles, window by window."""
    own, out = runs(text), {}
    windows = [set(own[a : a + 64]) for a in range(0, max(1, len(own)), 32)]
    for name, template in licenses.TEMPLATES.items():
        distinct = list(dict.fromkeys(runs(template)))
        best = [max(len(w & set(distinct[a : a + 32])) for w in windows) for a in range(0, len(distinct), 32)]
        if sum(best) / len(distinct) >= least:
            out[name] = sum(best) / len(distinct)
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = by_id(QUERIES["op5_license_scans"](spark, sf))
    found = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = brute(r["text"])
        (row,) = rows[r["doc_id"]]
        assert row["licenses"] == ",".join(sorted(want)) and row["n_licenses"] == len(want)
        found += bool(want)
    assert found == 39


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare.difference(QUERIES["op5_license_scans"](spark, sf), compare.connect(sf), SQL["op5_license_scans"]) is None


def test_planted_notices_whole_cut_and_mixed(spark):
    rng = np.random.default_rng(0)
    filler = lambda n: " ".join("w%d" % x for x in rng.integers(0, 10**6, n))
    texts = []
    for i, (name, template) in enumerate(sorted(licenses.TEMPLATES.items()) * 3):
        w = template.split()
        if i % 3 == 1:
            w[len(w) // 2] = "changed"
        if i % 3 == 2:
            w = w[: len(w) // 2]
        texts.append(filler(int(rng.integers(0, 90))) + " " + " ".join(w).upper() + "\n" + filler(70))
    texts.append(" ".join(licenses.TEMPLATES.values()))
    rows = by_id(licenses.scan(docs(spark, list(enumerate(texts)))))
    for i, text in enumerate(texts):
        assert {f["name"]: round(f["containment"], 9) for f in rows[i][0]["licenses"]} == {k: round(v, 9) for k, v in brute(text).items()}
    assert len(rows[len(texts) - 1][0]["licenses"]) == len(licenses.TEMPLATES)


def test_odd_rows(spark):
    rows = licenses.scan(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD) and not any(r["licenses"] for r in rows)
    assert licenses.scan(docs(spark, [])).count() == 0
    none = spark.createDataFrame([], "name string, text string")
    assert licenses.scan(docs(spark, ODD), templates=none).count() == len(ODD)
    few = spark.createDataFrame([("short", "four words are few"), ("null", None), (None, "a name that is null has none"), ("one", "this one is found in texts"), ("one", None)], "name string, text string")
    texts = [(1, "Say: THIS one, is found in texts"), (None, "this one is found in texts"), (1, "a name that is null has none"), (2, None)]
    found = licenses.scan(docs(spark, texts), templates=few).collect()
    assert sorted((r["doc_id"] or 0, [f["name"] for f in r["licenses"]]) for r in found) == [(0, ["one"]), (1, []), (1, ["one"]), (2, [])]


def test_plan_has_no_python(spark):
    plan = QUERIES["op5_license_scans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_bands_retrieve_every_template_that_exact_comparison_finds(spark):
    """Whole texts of many templates, with a share of their words changed; those near the threshold are where bands could miss."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 4000, n)]
    templates = {f"T{i}": words(int(n)) for i, n in enumerate(rng.integers(5, 1500, 60))}
    texts = []
    for name, w in templates.items():
        for changed in (0.0, 0.01, 0.03, 0.05):
            at = rng.random(len(w)) < changed
            texts.append(words(40) + [f"x{i}" if a else v for i, (v, a) in enumerate(zip(w, at))] + words(30))
    table = spark.createDataFrame([(n, " ".join(w)) for n, w in templates.items()], "name string, text string")
    d = docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    every = table.select("name").crossJoin(d.select(F.md5(F.col("text").cast("binary")).alias("key")))
    got = {r["doc_id"]: {f["name"]: f["containment"] for f in r["licenses"]} for r in licenses.scan(d, templates=table).collect()}
    monkey, licenses.retrieve = licenses.retrieve, lambda texts, bands: every  # all pairs
    try:
        want = {r["doc_id"]: {f["name"]: f["containment"] for f in r["licenses"]} for r in licenses.scan(d, templates=table).collect()}
    finally:
        licenses.retrieve = monkey
    assert got == want and sum(len(v) for v in want.values()) > 100 and min(min(v.values()) for v in want.values() if v) < 0.85


def test_short_notices_beside_long_ones_at_every_offset(spark):
    names = sorted(licenses.TEMPLATES, key=lambda n: len(runs(licenses.TEMPLATES[n])))
    short = [n for n in names if len(runs(licenses.TEMPLATES[n])) < 10]
    texts = []
    for a in short:
        for b in [n for n in names if n not in short]:
            for offset in range(32):
                filler = " ".join(f"w{offset}x{i}" for i in range(offset))
                pair = [licenses.TEMPLATES[a], licenses.TEMPLATES[b]]
                texts += [" ".join([filler, *pair]), " ".join([filler, *pair[::-1]])]
    rows = by_id(licenses.scan(docs(spark, list(enumerate(texts)))))
    for i, text in enumerate(texts):
        assert {f["name"]: round(f["containment"], 9) for f in rows[i][0]["licenses"]} == {k: round(v, 9) for k, v in brute(text).items()}
