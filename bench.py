"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local threads.
Every query runs to the end over whole tables; rows go to a sink that drops them. The given files have one
row group each, which one task would read alone; before the clock starts the tables are copied
into as many files as there are threads, as any large table has.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "p01_title u01_links u09_frontier h01_nodes h11_page_text f24_vector_v2 e07_sparse_rows h07_main_content h08_ranked_blocks "
    "h10_articles s13_labelled_blocks t01_words t02_body_keywords t03_textrank t06_new_tags t07_tfidf t10_article_features "
    "t12_profile_similarity a11_counters j01_feedback j06_tags_of l04_default_order w04_global_rank ml02_article_scores "
    "ml04_training_rows ml01_like_model ml06_diversified ml07_daily_list st03_live_counters"
).split()


def main() -> None:
    from leafsift.session import build_session
    from queries import registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    queries = registry.queries()
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-checkpoints-"))
    laid_out = tempfile.mkdtemp(prefix="bench-tables-")
    for file in sorted(os.listdir(sf_dir)):
        spark.read.parquet(f"{sf_dir}/{file}").repartition(int(cpus)).write.parquet(f"{laid_out}/{file}")
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, laid_out).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
