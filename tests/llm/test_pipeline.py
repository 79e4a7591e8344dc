"""Each stage on its own input, against plain Python with the same fitted models."""

import corpus_pipeline
import numpy as np
from samples import ODD, docs
from test_packing import check_places, ids_of
from test_quality import base_counts
from test_secret_scans import base
from test_simhash import fingerprint, groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark, tmp_path):
    docs_in = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_in, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((name, [r.asDict() for r in docs_in.collect()], [r.asDict() for r in out.collect()]))
        if k < 4:
            assert out.columns == COLUMNS
        docs_in = out

    (_, given, kept) = seen[0]
    assert all(row in given for row in kept)
    ids = {r["doc_id"] for r in kept}
    assert np.mean([(r["doc_id"] in ids) == bool(labels[r["doc_id"]]) for r in given if r["doc_id"] in labels]) > 0.95

    (_, given, kept) = seen[1]
    ids = {r["doc_id"] for r in kept}
    for r in given:
        counts = base_counts(r["text"])
        if counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]:
            assert r["doc_id"] not in ids
        elif labels.get(r["doc_id"]) == 1:
            assert r["doc_id"] in ids

    (_, given, kept) = seen[2]
    prints = sorted((r["doc_id"], fingerprint(r["text"])) for r in given)
    assert sorted(r["doc_id"] for r in kept) == sorted(set(groups(prints)))
    assert all(row in given for row in kept)

    (_, given, kept) = seen[3]
    assert sorted(r["doc_id"] for r in given) == sorted(r["doc_id"] for r in kept)
    before = {r["doc_id"]: r["text"] for r in given}
    for r in kept:
        assert not base(r["text"]) and r["n_chars"] == len(r["text"])
        if not base(before[r["doc_id"]]) and "[SECRET]" not in r["text"]:
            assert r["text"] == before[r["doc_id"]]

    (_, given, placed) = seen[4]
    used = check_places(placed, 4096)
    assert sum(r["length"] for r in placed) == sum(len(ids_of(r["text"])) for r in given)
    assert len(used) <= -(-sum(r["length"] for r in placed) // 4096) + 1


def test_run_equals_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_odd_rows_and_empty_tables_go_through(spark, tmp_path):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for j, rows in enumerate((ODD, [])):
            given = docs(spark, rows)
            out = stage(spark, given, SF)
            out.write.parquet(f"{tmp_path}/{k}-{j}")
            back = spark.read.parquet(f"{tmp_path}/{k}-{j}")
            if k < 4:
                assert back.columns == given.columns
            if not rows:
                assert back.count() == 0
