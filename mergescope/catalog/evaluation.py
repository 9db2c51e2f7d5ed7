"""Queries over metrics and curve tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import evaluate
from .registry import VIEWS, query

R = 8


def rounded(df, places=R):
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


CELLS = """SELECT y, prediction, coalesce(n, 0) n FROM
  (SELECT DISTINCT y FROM {t} UNION SELECT DISTINCT prediction FROM {t}) a(y) CROSS JOIN
  (SELECT DISTINCT y FROM {t} UNION SELECT DISTINCT prediction FROM {t}) b(prediction)
  LEFT JOIN (SELECT y, prediction, count(*) n FROM {t} GROUP BY ALL) USING (y, prediction)"""
REPORT = """SELECT c AS class, coalesce(h / nullif(g, 0)::DOUBLE, 1) AS "precision", coalesce(h / nullif(s, 0)::DOUBLE, 1) recall,
  coalesce(2 * h / nullif(s + g, 0)::DOUBLE, 1) f1_score, s support FROM
  (SELECT c, count(*) FILTER (WHERE y = c AND prediction = c) h, count(*) FILTER (WHERE prediction = c) g, count(*) FILTER (WHERE y = c) s
   FROM (SELECT DISTINCT y c FROM {t} UNION SELECT DISTINCT prediction FROM {t}), {t} GROUP BY c)"""


VIEWS["report"] = REPORT.format(t="scored_multi")


@query("confusion_matrix", "E6", CELLS.format(t="scored_multi"), "scored_multi")
def _(spark, sf):
    return evaluate.confusion(views.scored_multi(spark, sf))


ODD = "(SELECT y, CASE WHEN prediction = 2 THEN 3 ELSE prediction END prediction FROM scored_multi)"


@query("unseen_class_confusion", "E6", CELLS.format(t=ODD), "scored_multi")
def _(spark, sf):
    df = views.scored_multi(spark, sf)
    return evaluate.confusion(df.withColumn("prediction", F.when(F.col("prediction") == 2, 3).otherwise(F.col("prediction"))))


@query("class_report", "E7", f"""SELECT class, round("precision", 8) AS "precision", round(recall, 8) recall, round(f1_score, 8) f1_score, support
FROM ({REPORT.format(t='scored_multi')})""", "scored_multi")
def _(spark, sf):
    return rounded(evaluate.class_report(views.scored_multi(spark, sf)))


@query("full_report", "E7", f"""
SELECT class::VARCHAR AS name, round("precision", 8) AS "precision", round(recall, 8) recall, round(f1_score, 8) f1_score, support FROM report
UNION ALL SELECT 'accuracy', a, a, a, s FROM (SELECT round(sum(recall * support) / sum(support), 8) a, sum(support)::BIGINT s FROM report)
UNION ALL SELECT 'macro avg', round(avg("precision"), 8), round(avg(recall), 8), round(avg(f1_score), 8), sum(support)::BIGINT FROM report
UNION ALL SELECT 'weighted avg', round(sum("precision" * support) / sum(support), 8), round(sum(recall * support) / sum(support), 8),
  round(sum(f1_score * support) / sum(support), 8), sum(support)::BIGINT FROM report""", "scored_multi report")
def _(spark, sf):
    return rounded(evaluate.full_report(views.scored_multi(spark, sf)))


@query("classification_summary", "E1 E2", f"""
SELECT round(sum(recall * support) / sum(support), 8) accuracy, round(sum("precision" * support) / sum(support), 8) AS "precision",
  round(sum(recall * support) / sum(support), 8) recall, round(sum(f1_score * support) / sum(support), 8) f1_score FROM ({REPORT.format(t='scored_multi')})""", "scored_multi")
def _(spark, sf):
    return rounded(evaluate.classification_summary(views.scored_multi(spark, sf)))


@query("specificity", "E3", "SELECT round(avg((prediction = 0)::INT), 8) specificity FROM scored WHERE y = 0", "scored")
def _(spark, sf):
    return rounded(evaluate.specificity(views.scored(spark, sf)))


@query("log_loss", "E5", """
SELECT round(-avg(ln(least(greatest(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))), 7) logloss
FROM scored_multi""", "scored_multi")
def _(spark, sf):
    p = F.when(F.col("y") == 0, F.col("p0")).when(F.col("y") == 1, F.col("p1")).otherwise(F.col("p2"))
    return rounded(evaluate.log_loss(views.scored_multi(spark, sf), p), 7)


def steps_sql(y: str, score: str, table: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT *, sum(pos) OVER ({part}ORDER BY score DESC) tp, sum(neg) OVER ({part}ORDER BY score DESC) fp FROM
     (SELECT {key}{score} score, sum(({y})::INT) pos, sum(1 - ({y})::INT) neg FROM {table} GROUP BY {key}{score})"""


STEPS = steps_sql("y = 1", "score", "scored")
LONG = "(SELECT y, 0 AS class, p0 score FROM scored_multi UNION ALL SELECT y, 1, p1 FROM scored_multi UNION ALL SELECT y, 2, p2 FROM scored_multi)"
CLASS_STEPS = steps_sql("y = class", "score", LONG, "class")
SCORES = {0: "p0", 1: "p1", 2: "p2"}


def binary_steps(spark, sf):
    return evaluate.score_steps(views.scored(spark, sf), F.col("y") == 1, F.col("score"))


@query("score_steps", "W4 W5", f"SELECT score, pos::BIGINT pos, neg::BIGINT neg, tp::BIGINT tp, fp::BIGINT fp FROM ({STEPS})", "scored")
def _(spark, sf):
    return binary_steps(spark, sf)


@query("roc_points", "C1 W4", f"""
SELECT class, score, round(fp / sum(neg) OVER (PARTITION BY class), 8) fpr, round(tp / sum(pos) OVER (PARTITION BY class), 8) tpr FROM ({CLASS_STEPS})
UNION ALL SELECT DISTINCT class, NULL, 0, 0 FROM {LONG}""", "scored_multi")
def _(spark, sf):
    steps = evaluate.class_steps(views.scored_multi(spark, sf), "y", SCORES)
    return evaluate.roc_points(steps, ["class"]).withColumns({c: F.round(c, R) for c in ("fpr", "tpr")})


@query("precision_recall_points", "C2 W5", f"""
SELECT class, score, tp::DOUBLE / (tp + fp)::DOUBLE AS "precision", tp::DOUBLE / (sum(pos) OVER (PARTITION BY class))::DOUBLE recall FROM ({CLASS_STEPS})
UNION ALL SELECT DISTINCT class, NULL, 1, 0 FROM {LONG}""", "scored_multi")
def _(spark, sf):
    steps = evaluate.class_steps(views.scored_multi(spark, sf), "y", SCORES)
    return evaluate.pr_points(steps, ["class"])


AREA = """SELECT {key} sum((x - px) * (t + pt) / 2) / (max(x) * max(t)) roc_auc FROM
  (SELECT {key} fp::DOUBLE x, tp::DOUBLE t, lag(fp, 1, 0) OVER ({part} ORDER BY score DESC) px, lag(tp, 1, 0) OVER ({part} ORDER BY score DESC) pt FROM ({steps})) {group}"""


@query("roc_auc", "E4", f"SELECT round(roc_auc, 8) roc_auc FROM ({AREA.format(key='', part='', steps=STEPS, group='')})", "scored")
def _(spark, sf):
    return rounded(evaluate.roc_auc(binary_steps(spark, sf)))


CLASS_AREAS = AREA.format(key="class,", part="PARTITION BY class", steps=CLASS_STEPS, group="GROUP BY class")


@query("class_roc_auc", "C1 E4", f"SELECT class, round(roc_auc, 8) roc_auc FROM ({CLASS_AREAS})", "scored_multi")
def _(spark, sf):
    return rounded(evaluate.roc_auc(evaluate.class_steps(views.scored_multi(spark, sf), "y", SCORES), ["class"]))


@query("roc_auc_one_vs_rest", "E4", f"SELECT round(avg(roc_auc), 8) roc_auc FROM ({CLASS_AREAS})", "scored_multi")
def _(spark, sf):
    return rounded(evaluate.auc_one_vs_rest(views.scored_multi(spark, sf), "y", SCORES))


PAIR_LONG = "(" + " UNION ALL ".join(
    f"SELECT '{a}|{b}' pair, y = {pos} hit, p{pos} score, {pos} AS class FROM scored_multi WHERE y IN ({a}, {b})"
    for a, b in ((0, 1), (0, 2), (1, 2)) for pos in (a, b)) + ")"
PAIR_STEPS = steps_sql("hit", "score", PAIR_LONG, "pair, class")
PAIR_AREAS = AREA.format(key="pair, class,", part="PARTITION BY pair, class", steps=PAIR_STEPS, group="GROUP BY pair, class")


@query("roc_auc_one_vs_one", "E4", f"""
SELECT round(sum(a * n) / sum(n), 8) roc_auc FROM (SELECT pair, avg(roc_auc) a FROM ({PAIR_AREAS}) GROUP BY pair)
JOIN (SELECT pair, count(*) n FROM {PAIR_LONG} GROUP BY pair) USING (pair)""", "scored_multi")
def _(spark, sf):
    return rounded(evaluate.auc_one_vs_one(views.scored_multi(spark, sf), "y", SCORES))


@query("pr_auc", "E8", f"""
SELECT round(sum((t - pt) * (pr + coalesce(ppr, 1)) / 2) / max(t), 8) pr_auc FROM
 (SELECT tp::DOUBLE t, lag(tp, 1, 0) OVER (ORDER BY score DESC) pt, tp / (tp + fp)::DOUBLE pr, lag(tp / (tp + fp)::DOUBLE) OVER (ORDER BY score DESC) ppr FROM ({STEPS}))""", "scored")
def _(spark, sf):
    return rounded(evaluate.pr_auc(binary_steps(spark, sf)))


E = "(y - prediction)"
METRICS_SQL = f"""SELECT avg(abs({E})) mae, avg({E} ** 2) mse, sqrt(avg({E} ** 2)) rmse, 1 - sum({E} ** 2) / sum((y - my) ** 2) r2,
  1 - (sum({E} ** 2) / sum((y - my) ** 2)) * (count(*) - 1) / (count(*) - 20 - 1) adjusted_r2,
  avg(abs({E}) / greatest(abs(y), 2.220446049250313e-16)) mape, 1 - var_pop({E}) / var_pop(y) evs, max(abs({E})) max_err,
  avg(prediction - y) mbd, sum({E} ** 2) / sum((y - my) ** 2) rse,
  avg(CASE WHEN abs({E}) <= 1 THEN {E} ** 2 / 2 ELSE abs({E}) - 0.5::DOUBLE END) huber
  FROM (SELECT *, avg(y) OVER () my FROM regressed)"""


def metrics_rounded(names) -> str:
    return ", ".join(f"round({n}, 6) {n}" for n in names)


REGRESSION = ["mae", "mse", "rmse", "r2", "adjusted_r2", "mape", "evs", "max_err", "mbd", "rse", "huber"]


@query("regression_metrics", "E9 E10 E11 E12 E13 E14 E15 E16", f"SELECT {metrics_rounded(REGRESSION)} FROM ({METRICS_SQL})", "regressed")
def _(spark, sf):
    return rounded(evaluate.regression_metrics(views.regressed(spark, sf), features=20), 6)


@query("prediction_distribution", "E17", "SELECT prediction, count(*) n FROM scored_multi GROUP BY 1", "scored_multi")
def _(spark, sf):
    return views.scored_multi(spark, sf).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query("metrics_in_long_form", "E18", f"""
SELECT 'quantity' model, metric, round(value, 6) AS "value" FROM ({METRICS_SQL}) UNPIVOT (value FOR metric IN (mae, mse, r2, huber))""", "regressed")
def _(spark, sf):
    table = evaluate.regression_metrics(views.regressed(spark, sf), features=20).withColumn("model", F.lit("quantity"))
    return rounded(evaluate.long_metrics(table, ["mae", "mse", "r2", "huber", "not_there"]), 6)


@query("transposed_report", "E20", f"""
SELECT metric, round(max(value) FILTER (WHERE class = 0), 8) "0", round(max(value) FILTER (WHERE class = 1), 8) "1", round(max(value) FILTER (WHERE class = 2), 8) "2"
FROM (SELECT class, "precision"::DOUBLE AS "precision", recall::DOUBLE recall, f1_score::DOUBLE f1_score, support::DOUBLE support FROM ({REPORT.format(t='scored_multi')}))
UNPIVOT (value FOR metric IN ("precision", recall, f1_score, support)) GROUP BY metric""", "scored_multi")
def _(spark, sf):
    report = evaluate.class_report(views.scored_multi(spark, sf)).withColumnRenamed("class", "name")
    return rounded(evaluate.transposed_report(report, ["0", "1", "2"]))


KEYS = ["pr_id", "position", "file_id", "reviewer"]


@query("residuals", "C4", f"SELECT {', '.join(KEYS)}, round(prediction, 6) prediction, round(y - prediction, 6) residual FROM regressed", "regressed")
def _(spark, sf):
    return rounded(evaluate.residuals(views.regressed(spark, sf), keep=KEYS), 6)


@query("residual_histogram", "C5", """
SELECT b::INT AS bin, coalesce(n, 0) n, round(lo + b * ((hi - lo) / 20), 8) low, round(lo + (b + 1) * ((hi - lo) / 20), 8) high
FROM (SELECT unnest(range(20)) b) CROSS JOIN (SELECT min(r) lo, max(r) hi FROM (SELECT round(y - prediction, 6) r FROM regressed))
LEFT JOIN (SELECT least(floor((r - lo) / ((hi - lo) / 20)), 19)::INT b, count(*) n FROM
  (SELECT r, min(r) OVER () lo, max(r) OVER () hi FROM (SELECT round(y - prediction, 6) r FROM regressed)) GROUP BY 1) USING (b)""", "regressed")
def _(spark, sf):
    r = evaluate.residuals(views.regressed(spark, sf)).select(F.round("residual", 6).alias("residual"))
    return rounded(evaluate.residual_histogram(r, 20))


@query("predicted_vs_actual", "C6", f"""
SELECT {', '.join(KEYS)}, round(y, 6) actual, round(prediction, 6) prediction, round(min(y) OVER (), 6) low, round(max(y) OVER (), 6) high FROM regressed""", "regressed")
def _(spark, sf):
    return rounded(evaluate.predicted_vs_actual(views.regressed(spark, sf), keep=KEYS), 6)


@query("fold_statistics", "A26 C3", """
SELECT size, round(avg(score), 8) mean_score, round(stddev_pop(score), 8) std_score FROM
 (SELECT l_linenumber size, l_suppkey % 5 fold, avg((l_returnflag = 'R')::INT) score FROM lineitem GROUP BY ALL) GROUP BY size""")
def _(spark, sf):
    scores = views.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("size"), (F.col("l_suppkey") % 5).alias("fold")).agg(
        F.avg((F.col("l_returnflag") == "R").cast("int")).alias("score"))
    return rounded(evaluate.fold_statistics(scores, ["size"]))
