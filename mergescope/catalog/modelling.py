"""Queries that train models. Tests check the properties of those without SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import views
from ..operators import balance, binning, indexing, linear, prep
from ..plans import cleaning, modelling as m
from ..session import materialise, new_path
from ..sources import sinks
from ..sources.files import read_csv
from .preparation import basic
from .registry import HASH, query

FEATURES = ["title_length", "description_length", "num_commits", "num_reviewers", "review_time", "num_approvals"]
LINES = ["lines_added", "lines_deleted", "files_changed"]


def model_table(spark, sf):
    """Pull features without nulls, with both targets; the inputs of a target are not among its features."""
    from ..plans.pulls import file_totals

    df = basic(spark, sf).join(file_totals(views.files(spark, sf)), "pr_id", "left")
    df = prep.fill_zero(df)
    effort = df.withColumn("effort", 2.0 * F.col("lines_added") + 2.0 * F.col("lines_deleted") + 3.0 * F.col("num_comments"))
    return cleaning.binarise_at_median(materialise(effort, "pulls"), "effort", "target")


def small_classifiers(inputs, classes=2):
    return m.classifier_candidates(inputs, classes, trees=(10, 20), depths=(5,), leaves=(1,), hidden=((8,), (8, 4)), iterations=20)


def small_regressors():
    return m.regressor_candidates(trees=(10, 20), depths=(5,), leaves=(1,), costs=(1.0, 10.0), rounds=(5,))


def through_csv(table, schema):
    """A comparison as it is handed on: written as CSV and read back."""
    path = new_path(table.sparkSession, "comparison")
    sinks.write_csv(table, path)
    return read_csv(table.sparkSession, path, schema)


@query("classification_comparison", "Q9 T1 T2 T3 T8 T11 T12 T13 K4 E19")
def _(spark, sf):
    table, _ = m.classification_job(spark, model_table(spark, sf), "pr_id", FEATURES, "target", small_classifiers(len(FEATURES)), k=3)
    return through_csv(table, m.CLASSIFICATION_ROW)


@query("regression_comparison", "Q9 T4 T5 T8 T11 T12 K4 E19")
def _(spark, sf):
    table, _ = m.regression_job(spark, model_table(spark, sf), "pr_id", FEATURES, "target", small_regressors(), k=3)
    return through_csv(table, m.REGRESSION_ROW)


@query("spark_ml_comparison", "Q10 M4 M6 M9 M10 M12 M13 E1")
def _(spark, sf):
    table, _ = ml_job(spark, sf)
    return table


@query("model_prediction_distribution", "Q10 E17")
def _(spark, sf):
    _, spread = ml_job(spark, sf)
    return spread


def ml_job(spark, sf):
    df = model_table(spark, sf).select(F.col("pr_id").alias("id"), "repository_name", "num_commits", "num_reviewers", "num_approvals", "files_changed", "target")
    return m.spark_ml_job(spark, df, "target", small_classifiers(4), keep=4, k=3)


@query("balanced_comparison", "Q11 M1 M3 M11 M16 M18 M19")
def _(spark, sf):
    lab = views.labelled(spark, sf)
    facts = lab.withColumns({"words": F.when(F.col("n_chars") % 7 > 0, F.floor(F.col("n_chars") / 6)), "source_length": F.length("source"), "lang_code": F.ascii("lang")})
    features = ["n_chars", "words", "source_length", "lang_code"]
    table, _ = m.balanced_job(spark, facts, "doc_id", features, "quality", small_classifiers(3), keep=3, k=3)
    return table


def folded(spark, sf, label="target"):
    df = model_table(spark, sf)
    table = m.to_vector(df, FEATURES, [F.col("pr_id").alias("id"), F.col(label).cast("double").alias("label")])
    return m.training_table(m.with_folds(table, "id", "label", 5), "folds")


EFFORT = """SELECT pr_id id, (effort >= median(effort) OVER ())::DOUBLE AS label FROM
  (SELECT pr_id, 2.0::DOUBLE * coalesce(a, 0) + 2.0::DOUBLE * coalesce(d, 0) + 3.0::DOUBLE * (comments + review_comments) effort
   FROM pulls LEFT JOIN (SELECT pr_id, sum(additions) a, sum(deletions) d FROM files GROUP BY pr_id) USING (pr_id))"""
FIFTH = HASH % "id::VARCHAR"
PLACE = HASH % "(id::VARCHAR||'fold')"


@query("tuning_folds", "T8 T9 T10 M13 Q9", f"""
SELECT * FROM (WITH split AS (SELECT *, {FIFTH} % 100 < 20 AS is_test FROM ({EFFORT})),
placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {PLACE}, id) - 1 AS place, count(*) OVER (PARTITION BY label) n FROM split WHERE NOT is_test)
SELECT id, label, is_test, NULL::INT fold FROM split WHERE is_test UNION ALL
SELECT id, label, is_test, ({' + '.join(f'(place >= floor(n * {i} / 5::DOUBLE))::INT' for i in range(1, 5))})::INT FROM placed)""", "pulls files")
def _(spark, sf):
    """The rows that models are tuned and tested on, with the folds of the former."""
    table = m.to_vector(model_table(spark, sf), FEATURES, [F.col("pr_id").alias("id"), F.col("target").cast("double").alias("label")])
    train, test = balance.random_split(m.training_table(table), "id")
    folds = m.with_folds(train, "id", "label", 5).select("id", "label", F.lit(False).alias("is_test"), F.col("fold").cast("int").alias("fold"))
    return folds.unionByName(test.select("id", "label", F.lit(True).alias("is_test"), F.lit(None).cast("int").alias("fold")))


@query("linear_predictions", "E6 K4", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(s * l_quantity + i, 3) prediction, round(l_extendedprice - s * l_quantity - i, 3) error FROM lineitem,
 (SELECT regr_slope(l_extendedprice, l_quantity) s, regr_intercept(l_extendedprice, l_quantity) i FROM lineitem)""")
def _(spark, sf):
    """What a fitted model says of each row."""
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    table = m.to_vector(views.table(spark, sf, "lineitem"), ["l_quantity"], [*names, F.col("l_extendedprice").cast("double").alias("label")])
    made = linear.LeastSquares().fit(table).transform(table)
    return made.select(*names, F.round("prediction", 3).alias("prediction"), F.round(F.col("label") - F.col("prediction"), 3).alias("error"))


@query("grid_scores", "T8 T9 T11")
def _(spark, sf):
    forest = small_classifiers(len(FEATURES))[0]
    tuned = m.grid_search(forest, folded(spark, sf), "accuracy", 5)
    return m.grid_scores(spark, forest, tuned)


@query("fold_scores", "T9 A26")
def _(spark, sf):
    return m.fold_scores(spark, m.forest_classifier(numTrees=10), folded(spark, sf), "accuracy")


@query("forest_importances", "T1 T13")
def _(spark, sf):
    model = m.forest_classifier(numTrees=10).fit(folded(spark, sf))
    return m.feature_importances(spark, model, FEATURES)


@query("stacked_classifier", "T6 T10")
def _(spark, sf):
    df = folded(spark, sf)
    train, test = balance.random_split(df, "id", salt="stack")
    bases, last = m.stacking_classifier(len(FEATURES), 2)
    stack = m.fit_stacks(bases, {"logistic": last}, train)["logistic"]
    scored = materialise(m.predictions(stack, test), "predictions")
    return spark.createDataFrame([m.classification_row("StackingClassifier", scored, 2)], m.CLASSIFICATION_ROW)


@query("stacked_regressor", "T7")
def _(spark, sf):
    df = folded(spark, sf)
    train, test = balance.random_split(df, "id", salt="stack")
    bases = m.stacking_bases()
    rows = []
    for name, stack in m.fit_stacks(bases, m.stacking_regressors(), train).items():
        done = materialise(stack.transform(test).select(F.col("label").alias("y"), "prediction"), "predictions")
        numbers = m.evaluate.regression_metrics(done, features=len(FEATURES)).first().asDict()
        rows.append({"model": f"Stacking{name}", **numbers, "training_time": 0.0, "prediction_time": 0.0})
    return spark.createDataFrame(rows, m.REGRESSION_ROW)


@query("learning_curve", "C3 A26")
def _(spark, sf):
    return m.learning_curve(spark, m.forest_classifier(numTrees=5), folded(spark, sf), "id", "accuracy")


@query("three_class_models", "T2 T3 E4")
def _(spark, sf):
    identity = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    df = views.scored_multi(spark, sf, [identity.alias("id")])
    table = m.training_table(m.to_vector(df, ["p0", "p1", "p2"], ["id", F.col("y").cast("double").alias("label")]))
    train, test = balance.random_split(table, "id")
    folds = m.training_table(m.with_folds(train, "id", "label", 2), "folds")
    tuned = [c for c in m.classifier_candidates(3, 3, hidden=((6,),), iterations=20) if not c.name.startswith("Random")]
    table, _ = m.compare_classifiers(spark, tuned, folds, test, 3, "f1", 2)
    return table


@query("indexed_priorities", "M9", """
SELECT o_orderkey, r::DOUBLE priority_index FROM orders JOIN
 (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 r FROM orders GROUP BY 1) USING (o_orderpriority)""")
def _(spark, sf):
    orders = views.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    indexed = indexing.encode(orders, indexing.fit_dictionary(orders, ["o_orderpriority"]), ["o_orderpriority"])
    return indexed.select("o_orderkey", F.col("o_orderpriority").alias("priority_index"))


SUPPLIER = "CASE WHEN l_tax > 0 THEN l_suppkey::VARCHAR END"


@query("indexed_parts", "M9", f"""
WITH rows AS (SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR part, {SUPPLIER} supplier FROM lineitem),
parts AS (SELECT part, row_number() OVER (ORDER BY count(*) DESC, part) - 1 i FROM rows WHERE l_linenumber < 3 GROUP BY 1),
suppliers AS (SELECT supplier, row_number() OVER (ORDER BY count(*) DESC, supplier) - 1 i FROM rows WHERE l_linenumber < 3 AND supplier IS NOT NULL GROUP BY 1)
SELECT l_orderkey, l_linenumber, coalesce(p.i, (SELECT count(*) FROM parts))::DOUBLE part, coalesce(s.i, (SELECT count(*) FROM suppliers))::DOUBLE supplier
FROM rows LEFT JOIN parts p USING (part) LEFT JOIN suppliers s USING (supplier)""")
def _(spark, sf):
    """A dictionary of many values, fitted on some rows; null and unseen values share the next number."""
    lines = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"),
                                                      F.when(F.col("l_tax") > 0, F.col("l_suppkey").cast("string")).alias("supplier"))
    dictionary = indexing.fit_dictionary(lines.where("l_linenumber < 3"), ["part", "supplier"])
    return indexing.encode(lines, dictionary, ["part", "supplier"])


BINNED = ["l_extendedprice", "l_partkey", "l_quantity", "l_linenumber"]


def binned_sql(c: str, bins: int) -> str:
    cuts = ", ".join(f"{i}::DOUBLE / {bins}" for i in range(1, bins))
    table = f"""(SELECT l_returnflag l, len(list_filter(edges, lambda e: e < v)) v FROM
      (SELECT l_returnflag, {c}::DOUBLE v, (SELECT list_distinct(quantile_cont({c}::DOUBLE, [{cuts}])) FROM lineitem) edges FROM lineitem))"""
    return f"""SELECT '{c}' feature, sum((o - e) ** 2 / e) statistic, (count(DISTINCT v) - 1) * (count(DISTINCT l) - 1) degrees FROM
     (SELECT v, l, coalesce(o, 0) o, r * cc / (SELECT count(*) FROM lineitem)::DOUBLE e FROM (SELECT v, count(*) r FROM {table} GROUP BY 1)
      CROSS JOIN (SELECT l_returnflag l, count(*) cc FROM lineitem GROUP BY 1) LEFT JOIN (SELECT v, l, count(*) o FROM {table} GROUP BY 1, 2) USING (v, l))"""


@query("binned_chi_square", "M12", f"SELECT feature, round(statistic, 5) statistic, degrees FROM ({' UNION ALL '.join(binned_sql(c, 16) for c in BINNED)})")
def _(spark, sf):
    scores = binning.binned_chi_square(views.table(spark, sf, "lineitem"), BINNED, "l_returnflag", 16)
    return scores.withColumn("statistic", F.round("statistic", 5))


@query("selected_features", "M12 K2", f"""
SELECT feature FROM ({' UNION ALL '.join(binned_sql(c, 32) for c in BINNED)}) ORDER BY statistic / degrees DESC LIMIT 2""")
def _(spark, sf):
    lines = views.table(spark, sf, "lineitem")
    chosen = binning.select_features(lines, BINNED, "l_returnflag", 2)
    return spark.createDataFrame([(c,) for c in chosen], "feature string")


@query("assembled_vectors", "M10", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::DOUBLE first, l_discount::DOUBLE AS last, 3 size FROM lineitem""")
def _(spark, sf):
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    made = m.to_vector(views.table(spark, sf, "lineitem"), ["l_quantity", "l_tax", "l_discount"], names)
    made = made.withColumn("v", vector_to_array("features"))
    return made.select(*names, F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(2)).alias("last"), F.size("v").alias("size"))


SUMS = "avg(l_quantity) ma, avg(l_discount) mb, avg(l_extendedprice) my, regr_sxx(l_quantity, l_quantity) aa, regr_sxx(l_discount, l_discount) bb, regr_sxy(l_quantity, l_discount) ab, regr_sxy(l_extendedprice, l_quantity) ay, regr_sxy(l_extendedprice, l_discount) yb"


@query("linear_fit", "E19 T12", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS "intercept" FROM lineitem""")
def _(spark, sf):
    """A fitted line, through a CSV."""
    found, base = linear.least_squares(views.table(spark, sf, "lineitem"), F.array(F.col("l_quantity").cast("double")), F.col("l_extendedprice"))
    return through_csv(spark.createDataFrame([(round(float(found[0]), 4), round(base, 2))], "slope double, intercept double"), "slope double, intercept double")


@query("ridge_fits", "T7", f"""
SELECT penalty, round(a, 4) quantity, round(b, 3) discount, round(my - a * ma - b * mb, 2) AS "intercept" FROM
 (SELECT penalty, my, ma, mb, (ay * (bb + penalty) - yb * ab) / d a, (yb * (aa + penalty) - ay * ab) / d b FROM
  (SELECT *, (aa + penalty) * (bb + penalty) - ab * ab AS d FROM (SELECT {SUMS} FROM lineitem), (SELECT unnest([0, 1, 1000])::DOUBLE penalty)))""")
def _(spark, sf):
    """Least squares and ridge with two features, each from one aggregated matrix."""
    lines = views.table(spark, sf, "lineitem")
    x = F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"))
    rows = []
    for penalty in (0.0, 1.0, 1000.0):
        (a, b), base = linear.least_squares(lines, x, F.col("l_extendedprice"), penalty)
        rows.append((penalty, round(float(a), 4), round(float(b), 3), round(base, 2)))
    return spark.createDataFrame(rows, "penalty double, quantity double, discount double, intercept double")
