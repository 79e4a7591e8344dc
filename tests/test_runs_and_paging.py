import random
import re

import pytest
from pyspark.sql import functions as F

from leafsift.operators import listing as L
from leafsift.operators.vectors import corpus_idf
from leafsift.plans.paging import Place, day_folders, page_by_day
from leafsift.sources.runs import Runs, spans
from leafsift.sources.tables import append_articles
from leafsift.streaming import crawl as C
from leafsift.streaming import feedback as S


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_runs_cover_the_batches_and_stay_few(fan):
    for n in range(1001):
        live = spans(n, fan)
        assert [b for a, e in live for b in range(a, e)] == list(range(n))
        size, levels = 1, 1
        while size * fan <= n:
            size, levels = size * fan, levels + 1
        assert len(live) <= (fan - 1) * levels


def test_rows_of_all_batches_and_lookups(spark, tmp_path):
    store = Runs(spark, str(tmp_path / "r"), "k string, v bigint", "k", buckets=4, fan=2)
    assert store.read().count() == 0
    rng, held = random.Random(1), []
    for number in range(7):
        rows = [(rng.choice(["a", "b", "c", None, "d", "é"]), number) for _ in range(0 if number == 3 else 5)]
        frame = spark.createDataFrame(rows, "k string, v bigint").withColumn("extra", F.lit(1))
        before = store.before(number, spark.createDataFrame([("a",), ("zz",), ("a",)], "k string"))
        assert sorted(map(tuple, before.collect())) == sorted(r for r in held if r[0] == "a")
        for _ in range(2):  # as after a failure
            store.append(number, frame)
        held += rows
        assert sorted(map(tuple, store.read().collect()), key=str) == sorted(held, key=str)
        assert store.live() == spans(number + 1, 2)
    folders = [p.name for p in (tmp_path / "r").iterdir() if p.name.startswith("run-")]
    assert len(folders) <= len(spans(7, 2)) + 2  # old runs go with the next batch


def test_a_batch_that_ends_while_merging_runs_again(spark, tmp_path, monkeypatch):
    store = Runs(spark, str(tmp_path / "r"), "k string, n bigint", "k", buckets=2, fan=2, combine=lambda r: r.groupBy("k").agg(F.sum("n").alias("n")))
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n bigint")
    store.append(0, one)
    write = Runs._write
    for ended in (1, 2):  # before the batch's own run, before the merge
        calls = []

        def fails(self, rows, span):
            calls.append(span)
            if len(calls) == ended:
                raise RuntimeError("ended")
            write(self, rows, span)

        monkeypatch.setattr(Runs, "_write", fails)
        with pytest.raises(RuntimeError):
            store.append(1, one)
        monkeypatch.setattr(Runs, "_write", write)
        assert {tuple(r) for r in store.before(1, one).collect()} == {("a", 1), ("b", 2)}
    store.append(1, one)
    store.append(2, one)
    assert {tuple(r) for r in store.read().collect()} == {("a", 3), ("b", 6)}
    assert store.live() == [(0, 2), (2, 3)] and not (tmp_path / "r" / "run-000000000-000000001").exists()


def test_a_lookup_opens_touched_buckets_only(spark, tmp_path):
    store = Runs(spark, str(tmp_path / "r"), "k string", "k", buckets=16)
    store.append(0, spark.range(400).select(F.col("id").cast("string").alias("k")))
    found = store.before(1, spark.createDataFrame([("17",)], "k string"))
    assert [r[0] for r in found.collect()] == ["17"]
    assert "Exchange hashpartitioning(bucket" not in found._jdf.queryExecution().executedPlan().toString()
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = \d+", plan) and "LeftSemi, BuildRight" in plan


def test_new_urls_over_many_batches(spark, tmp_path):
    urls, held = str(tmp_path / "in"), set()
    rng = random.Random(2)
    for _ in range(10):
        rows = [f"http://h/{rng.randrange(60)}" + rng.choice(["", "#x"]) for _ in range(20)] + [None]
        held |= {r.split("#")[0] if r else None for r in rows}
        spark.createDataFrame([(r,) for r in rows], "url string").coalesce(1).write.mode("append").parquet(urls)
    stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).parquet(urls)
    S.run_to_end(C.new_urls(stream, str(tmp_path / "seen"), str(tmp_path / "state"), buckets=4))
    store = C.seen_urls(spark, str(tmp_path / "seen"), 4)
    found = [r[0] for r in store.read().collect()]
    assert {u for u in found if u} == {u for u in held if u} and len([u for u in found if u]) == len({u for u in held if u})
    assert store.live() == spans(10, 8)


def test_frequencies_kept_up_equal_those_of_all_documents(spark, tmp_path):
    rng = random.Random(3)
    store = C.word_frequencies(spark, str(tmp_path / "f"), 4)
    store.fan = 2
    texts = [(i, None if i == 5 else " ".join(rng.choice(["red", "green", "blue", "été", "stone", f"word{i}"]) for _ in range(6))) for i in range(20)]
    for number in range(5):
        part = spark.createDataFrame(texts[4 * number : 4 * number + 4], "id long, text string")
        mine = {r["word"]: (r["df"], round(r["idf"], 12)) for r in C.add_frequencies(store, number, part).collect()}
        whole = corpus_idf(spark.createDataFrame(texts[: 4 * number + 4], "id long, text string"), "text")
        every = {r["word"]: (r["df"], round(r["idf"], 12)) for r in whole.collect()}
        words = {w for _, t in texts[4 * number : 4 * number + 4] for w in (t or "").split()}
        assert mine == {w: every[w] for w in words}


DATES = ["2024-01-01 10:00:00", "2024-01-01 09:00:00", "2024-01-02 00:00:00", "2024-02-01 00:00:00", "2023-12-31 00:00:00", None]


def test_pages_follow_and_precede_each_other(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"http://s{i % 3}/x", rng.choice(DATES), rng.choice([None, 0.0, 0.5, 0.25])) for i in range(30)]
    articles = spark.createDataFrame(rows, "id long, link string, date string, score double")
    path = str(tmp_path / "t")
    assert page_by_day(spark, path).count() == 0
    append_articles(articles, path)
    assert list(day_folders(spark, path)) == ["2024-02-01", "2024-01-02", "2024-01-01", "2023-12-31", ""]
    for where in (lambda a: a, lambda a: L.by_site(a, "s1")):
        whole = where(articles).orderBy(*L.default_order()).collect()
        ids, place, got, places = [r["id"] for r in whole], None, [], []
        while page := page_by_day(spark, path, place, limit=8, where=where).collect():
            got.append([r["id"] for r in page])
            place = Place(page[-1]["date"], page[-1]["score"], page[-1]["id"])
            places.append(Place(page[0]["date"], page[0]["score"], page[0]["id"]))
        assert [i for p in got for i in p] == ids
        for at in range(1, len(got)):
            back = page_by_day(spark, path, places[at], back=True, limit=8, where=where).collect()
            assert [r["id"] for r in back] == got[at - 1]


def test_a_deep_page_opens_its_own_days_only(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i // 20:02d} 00:00:00", float(i)) for i in range(400)]
    path = str(tmp_path / "t")
    append_articles(spark.createDataFrame(rows, "id long, date string, score double"), path)
    page = page_by_day(spark, path, Place("2024-01-10 00:00:00", 185.0, 185))
    assert [r["id"] for r in page.collect()] == [184, 183, 182, 181, 180, 179, 178, 177, 176, 175]
    assert {f.split("/")[-2] for f in page.inputFiles()} <= {"day=2024-01-10", "day=2024-01-09", "day=2024-01-08"}
