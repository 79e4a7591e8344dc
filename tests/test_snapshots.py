import pytest
from pyspark.sql import functions as F

from leafsift.plans import storing
from leafsift.sources import snapshots
from leafsift.sources.schemas import TABLES


def articles(spark, rows):
    return spark.createDataFrame([(i, date, score, likes) for i, date, score, likes in rows], "id long, date string, score double, n_like int")


def likes(spark, ids, first=0):
    rows = [(first + n, "like", '{"article_id": %d}' % i) for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id long, name string, evt_attr string").withColumn("time", F.lit("2024-01-01").cast("timestamp"))


ROWS = [(1, "2024-01-01 10:00:00", 0.5, None), (2, "2024-01-01 11:00:00", None, 3), (3, "2024-01-02 10:00:00", 0.1, 0), (4, None, 0.2, 1)]


def filled(spark, path):
    store = storing.article_store(spark, str(path))
    store.append(articles(spark, ROWS))
    return store


def state(store, version=None):
    return {r["id"]: (r["score"], r["n_like"]) for r in store.read(version=version).collect()}


def test_changes_versions_and_partitions(spark, tmp_path):
    store = filled(spark, tmp_path / "t")
    before = store.manifest().folders
    assert set(before) == {"2024-01-01", "2024-01-02", ""} and store.read().schema.simpleString().count(":") == len(TABLES["article"].split(","))
    storing.store_scores(store, spark.createDataFrame([(1, 9.0), (77, 1.0)], "id long, score double"))
    after = store.manifest().folders
    assert {v for v in before if before[v] != after[v]} == {"2024-01-01"}  # only what was touched
    assert state(store) == {1: (9.0, None), 2: (None, 3), 3: (0.1, 0), 4: (0.2, 1)} and state(store, 1)[1] == (0.5, None)
    assert {r["id"] for r in store.read(["2024-01-02", "none"]).collect()} == {3}
    store.append(articles(spark, [(5, "2024-01-02 12:00:00", None, None)]))
    assert state(store).keys() == {1, 2, 3, 4, 5} and store.versions() == [1, 2, 3]
    assert store.vacuum(keep=1) == 1 and store.versions() == [3] and state(store).keys() == {1, 2, 3, 4, 5}


def test_a_batch_of_likes_counts_once(spark, tmp_path):
    store = filled(spark, tmp_path / "t")
    one, other = likes(spark, [1, 1, 3, 99]), likes(spark, [1], first=50)
    assert storing.store_likes(store, one) and not storing.store_likes(store, one.orderBy(F.desc("id")).repartition(3))
    assert storing.store_likes(store, other) and not storing.store_likes(store, other)
    assert {i: n for i, (_, n) in state(store).items()} == {1: 3, 2: 3, 3: 1, 4: 1}
    assert storing.store_likes(store, one, ("clicks", 7)) and not storing.store_likes(store, one, ("clicks", 7)) and not storing.store_likes(store, other, ("clicks", 6))
    assert state(store)[1] == (0.5, 5)


def test_samples_removed_to_the_last_row_of_a_partition(spark, tmp_path):
    store = storing.sample_store(spark, str(tmp_path / "s"))
    assert store.read().count() == 0
    storing.append_samples(store, spark.createDataFrame([(1, "a", 1), (2, "b", -1), (65, "c", 1)], "id long, body string, y int"))
    for _ in range(2):
        storing.remove_samples(store, spark.createDataFrame([(2,), (65,), (500,)], "id long"))
    assert [r["id"] for r in store.read().collect()] == [1]


@pytest.mark.parametrize("at", ["partitions chosen", "data written", "manifest written", "manifest renamed"])
def test_a_job_ended_between_two_steps_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch, at):
    store = filled(spark, tmp_path / "t")
    old, events = state(store), likes(spark, [1, 3, 3])

    def end(name):
        if name == at:
            raise KeyboardInterrupt(name)

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "step", end)
        with pytest.raises(KeyboardInterrupt):
            storing.store_likes(store, events)
    new = {**old, 1: (0.5, 1), 3: (0.1, 2)}
    assert state(store) == (new if at == "manifest renamed" else old)
    assert storing.store_likes(store, events) == (at != "manifest renamed")  # run again
    assert state(store) == new


def test_two_jobs_cannot_commit_one_version(spark, tmp_path, monkeypatch):
    store = filled(spark, tmp_path / "t")
    other = storing.article_store(spark, store.path)

    def meanwhile(name):
        if name == "partitions chosen":
            monkeypatch.setattr(snapshots, "step", lambda name: None)
            storing.store_scores(other, spark.createDataFrame([(3, 7.0)], "id long, score double"))

    monkeypatch.setattr(snapshots, "step", meanwhile)
    with pytest.raises(snapshots.Conflict):
        storing.store_scores(store, spark.createDataFrame([(1, 9.0)], "id long, score double"))
    assert state(store)[3] == (7.0, 0) and state(store)[1] == (0.5, None)
