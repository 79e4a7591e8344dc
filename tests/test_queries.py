"""Every registered query against its SQL, on whole tables at the smallest scale."""

import re
from concurrent.futures import ThreadPoolExecutor

import compare
import pytest

from queries import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def outcome(spark, con, name):
    try:
        if name in SQL:
            return compare.difference(QUERIES[name](spark, SF), con.cursor(), SQL[name])
        return None if QUERIES[name](spark, SF).count() else "no rows"
    except Exception as error:  # noqa: BLE001
        return f"{type(error).__name__}: {str(error)[:2000]}"


@pytest.fixture(scope="module")
def outcomes(spark):
    """All queries, several at a time: most of each is planning."""
    con = compare.connect(SF)
    with ThreadPoolExecutor(6) as pool:
        return dict(zip(QUERIES, pool.map(lambda name: outcome(spark, con, name), QUERIES)))


def test_every_sql_has_a_query():
    assert not SQL.keys() - QUERIES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(outcomes, name):
    assert outcomes[name] is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", "f24_vector_v2 h07_main_content t02_body_keywords t10_article_features a11_counters j01_feedback ml02_article_scores".split())
def test_plans_have_no_cross_join_or_row_udf(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(QUERIES["a11_counters"](spark, SF))
    assert "ReadSchema: struct<user_id:bigint,event_type:string,props:string>" in text
    text = plan(QUERIES["a01_distinct"](spark, SF))
    assert "ReadSchema: struct<lang:string,source:string>" in text


def test_block_features_shuffle_nothing(spark):
    assert "Exchange hashpartitioning" not in plan(QUERIES["f24_vector_v2"](spark, SF))


def shuffled_columns(df) -> set[str]:
    """Names of all columns that any exchange of the plan moves."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    inputs = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)
    return {name for columns in inputs for name in re.findall(r"(\w+)#", columns)}


@pytest.mark.parametrize("name", ["h03_element_html", "h07_main_content", "s13_labelled_blocks"])
def test_no_exchange_carries_html(spark, name):
    from leafsift.operators.samples import training_rows
    from queries import views

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large to broadcast
    try:
        df = training_rows(views.fragments(spark, SF)) if name == "s13_labelled_blocks" else QUERIES[name](spark, SF)
        moved = shuffled_columns(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not moved & {"html", "_html", "body", "raw", "attrs"}


def test_scores_are_taken_without_an_exchange(spark):
    from leafsift.operators.encoding import with_article_entries
    from leafsift.operators.linear import decision_values
    from queries import views

    schema = "id bigint, f_site string, f_title_keywords string, f_content_keywords string, f_date string, f_content_len bigint, f_img_n int"
    rows = with_article_entries(spark.createDataFrame([], schema), views.as_of())
    assert "id" not in shuffled_columns(decision_values(rows, views.model(spark)))
