"""Fitted models and the daily list."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafsift.operators.encoding import as_examples
from leafsift.operators.linear import duality_gap, fit_l1_svm, load_model, save_model
from leafsift.operators.samples import training_rows
from leafsift.plans import ranking as R
from leafsift.session import cut, scratch_path
from queries import pages as P
from queries import registrar
from queries import text as T
from queries import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


# A fit has no closed form, but its result can be proved: the stored weights and the examples give a dual point, and no weights can do better than
# its value. SQL counts the classes and says that the gap must be closed; every weight of a case that has a closed form is compared in ml01_weights.
_CHECK = "n::BIGINT AS n_rows, p::BIGINT AS n_positive, (n - p)::BIGINT AS n_negative, true AS gap_closed, true AS uses_features"


def _checked(spark, counted, examples, fit, c):
    path = scratch_path(spark, "model")
    save_model(fit.to_frame(spark, "fitted"), path)
    model = load_model(spark, path, "fitted")
    held = model.agg(F.count_if((F.col("idx") >= 0) & (F.col("weight") != 0)).alias("held"))
    gap = duality_gap(examples, model, c).select((F.col("gap") <= 1e-3 * F.col("primal")).alias("gap_closed"))
    positive = F.sum(F.when(F.col("y") > 0, F.col("n")).otherwise(0))
    found = counted.agg(F.sum("n").alias("n_rows"), positive.alias("n_positive"), (F.sum("n") - positive).alias("n_negative"))
    parts = [part.withColumn("_", F.lit(1)) for part in (found, gap, held)]  # one row each
    joined = parts[0].join(parts[1], "_").join(parts[2], "_")
    return joined.select("n_rows", "n_positive", "n_negative", "gap_closed", (F.col("held") > 0).alias("uses_features"))


@query("ml01_block_model",
       f"WITH {P._FRAGMENTS} SELECT {_CHECK} FROM (SELECT count(*) AS n, count(*) FILTER (y = 1) AS p FROM fragments WHERE body <> '')")
def ml01_blocks(spark, sf):
    samples = V.fragments(spark, sf).filter(F.col("body") != "")
    examples = as_examples(training_rows(samples), ["id"]).join(samples.select("id", "y"), "id")
    examples = cut(examples)
    fit = fit_l1_svm(examples, R.BLOCK_C, tol=1e-4)
    return _checked(spark, examples.select("y", F.lit(1).cast("bigint").alias("n")), examples, fit, R.BLOCK_C)


@query("ml01_like_model",
       f"WITH {V.SQL_ARTICLES} SELECT {_CHECK} FROM (SELECT count(*) AS n, count(*) FILTER (name = 'like') AS p "
       "FROM article_event WHERE name IN ('like', 'hate') AND k IN (SELECT id FROM articles))")
def ml01_likes(spark, sf):
    weighted = cut(R.weighted_rows(V.events(spark, sf), V.articles(spark, sf)))
    fit = R.fit_like_model(weighted, V.as_of())
    return _checked(spark, weighted.select("y", "n"), R.like_examples(weighted, V.as_of()), fit, R.LIKE_C)


@query("ml01_weights",
       # each label twice, as (1, q) and (-1, -q): the intercept is 0 by symmetry, and each feature has an optimum of its own: that of
       # |w| + C (N (1 - w)^2 + M (1 + w)^2) with N and M the rows that agree and disagree, here at C = 1/2
       "SELECT idx, round(sign(p - m) * greatest(0, 2 * abs(p - m) - 1) / (2 * (p + m)), 6) AS weight FROM (SELECT doc_id % 97 AS idx, "
       "count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS m FROM labels GROUP BY doc_id % 97) "
       "UNION ALL SELECT -1, 0.0::DOUBLE")
def ml01_weights(spark, sf):
    q = F.when(F.col("quality") == 1, 1.0).otherwise(-1.0)
    sides = F.explode(F.array(F.lit(1.0), F.lit(-1.0)))
    rows = V.table(spark, sf, "labels").select(F.array((F.col("doc_id") % 97).cast("int")).alias("idx"), q.alias("q"), sides.alias("y"))
    fit = fit_l1_svm(rows.select("y", "idx", F.array(F.col("q") * F.col("y")).alias("value")), 0.5, width=97, tol=1e-9)
    weights = [(i, float(w)) for i, w in enumerate(fit.weights[:-1])] + [(-1, float(fit.weights[-1]))]
    asked = rows.select(F.explode("idx").alias("idx")).distinct().unionByName(spark.range(1).select(F.lit(-1).alias("idx")))
    found = asked.join(spark.createDataFrame(weights, "idx int, w double"), "idx")
    return found.select(F.col("idx").cast("bigint").alias("idx"), (F.round("w", 6) + 0.0).alias("weight"))


_C = 0.001


@query("ml01_intercept",
       # only the intercept b: the optimum of |b| + C (p (1 - b)^2 + m (1 + b)^2) for |b| < 1
       f"SELECT round(sign(p - m) * greatest(0, 2 * {_C} * abs(p - m) - 1) / (2 * {_C} * (p + m)), 6) AS intercept FROM "
       "(SELECT count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS m FROM labels)")
def ml01_intercept(spark, sf):
    y = F.when(F.col("quality") == 1, 1).otherwise(-1)
    none = [F.array().cast("array<int>").alias("idx"), F.array().cast("array<double>").alias("value")]
    fit = fit_l1_svm(V.table(spark, sf, "labels").select(y.alias("y"), *none), _C, tol=1e-9)
    return spark.range(1).select(F.lit(round(float(fit.weights[-1]), 6)).alias("intercept"))


_CHOSEN = (
    f"WITH {V.SQL_ARTICLES}, fresh AS (SELECT * FROM articles WHERE score > 0.1 AND "
    f"strptime(date, '%Y-%m-%d %H:%M:%S') > TIMESTAMP '{V.AS_OF_TEXT}' - INTERVAL 48 HOUR), {T.sql_vectors('fresh')}, "
    # a text without words is like nothing and always kept
    f"{T.sql_kept('SELECT id, score FROM fresh')}"
)


@query("ml07_daily_list", _CHOSEN + " SELECT k.rank, f.id, f.score, f.title, f.link, f.date FROM kept k JOIN fresh f USING (id) WHERE k.rank <= 5000")
def ml07(spark, sf):
    rows = R.daily_list(V.articles(spark, sf), V.as_of())
    return rows.select(F.col("rank").cast("bigint").alias("rank"), "id", "score", "title", "link", "date")


@query("ml07_daily_page", _CHOSEN + " SELECT k.rank, f.id FROM kept k JOIN fresh f USING (id) WHERE k.rank <= 5")
def ml07_page(spark, sf):
    return R.daily_list(V.articles(spark, sf), V.as_of(), top=5).select(F.col("rank").cast("bigint").alias("rank"), "id")


