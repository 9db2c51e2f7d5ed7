"""Metrics of predictions. Every metric is an aggregate over a table of (truth, prediction, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_totals

LOG_LOSS_EPSILON = 2.220446049250313e-16
MAPE_EPSILON = 2.220446049250313e-16


# --- classification from the confusion counts ------------------------------------------------------
def confusion(df: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """(y, prediction, n) for every pair of classes seen as truth or prediction, zero cells included.

    The rows are counted once; everything after works on at most classes x classes rows.
    """
    counts = df.groupBy(F.col(y).alias("y"), F.col(p).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(F.explode(F.array("y", "prediction")).alias("c"))
    classes = sides.agg(F.array_sort(F.collect_set("c")).alias("classes"))
    grid = classes.select(F.explode("classes").alias("y"), "classes").select("y", F.explode("classes").alias("prediction"))
    return grid.join(counts, ["y", "prediction"], "left").select("y", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(df: DataFrame, y: str = "y", p: str = "prediction", zero_division: float = 1.0) -> DataFrame:
    """(class, precision, recall, f1_score, support), one row per class."""
    cells = confusion(df, y, p)
    side = F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("truth"), F.lit(0).alias("guess"),
                 F.when(F.col("y") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).alias("truth"), F.col("n").alias("guess"), F.lit(0).alias("hit")),
    ))
    sums = cells.select(side.alias("s")).groupBy("s.class").agg(
        F.sum("s.truth").alias("truth"), F.sum("s.guess").alias("guess"), F.sum("s.hit").alias("hit"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(zero_division))

    return sums.select(
        "class",
        ratio(F.col("hit"), F.col("guess")).alias("precision"),
        ratio(F.col("hit"), F.col("truth")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("truth") + F.col("guess")).alias("f1_score"),
        F.col("truth").alias("support"),
    )


def full_report(df: DataFrame, y: str = "y", p: str = "prediction", zero_division: float = 1.0) -> DataFrame:
    """Class rows plus accuracy, macro and weighted averages, under a text name."""
    report = class_report(df, y, p, zero_division)
    numbers = ["precision", "recall", "f1_score"]
    rows = report.select(F.col("class").cast("string").alias("name"), *numbers, "support")
    total = F.sum("support")
    averages = report.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in numbers],
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(f"weighted_{c}") for c in numbers],
        (F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"),
        total.alias("support"),
    )
    summary = averages.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("name"), *[F.col("accuracy").alias(c) for c in numbers], "support"),
        F.struct(F.lit("macro avg").alias("name"), *[F.col(f"macro_{c}").alias(c) for c in numbers], "support"),
        F.struct(F.lit("weighted avg").alias("name"), *[F.col(f"weighted_{c}").alias(c) for c in numbers], "support"),
    )).alias("s")).select("s.*")
    return rows.unionByName(summary)


def classification_summary(df: DataFrame, y: str = "y", p: str = "prediction", zero_division: float = 1.0) -> DataFrame:
    """One row: accuracy and the support-weighted precision, recall and F1."""
    report = class_report(df, y, p, zero_division)
    total = F.sum("support")
    return report.agg(
        (F.sum(F.when(F.col("support") > 0, F.col("recall") * F.col("support")).otherwise(0.0)) / total).alias("accuracy"),
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1_score")],
    )


def specificity(df: DataFrame, y: str = "y", p: str = "prediction", negative=0) -> DataFrame:
    """Recall of the negative class; 0 without any such row."""
    hit = F.when(F.col(y) == negative, (F.col(p) == negative).cast("double"))
    return df.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("specificity"))


def log_loss(df: DataFrame, truth_probability: Column) -> DataFrame:
    """Mean negative logarithm of the probability given to the true class, clipped away from 0 and 1."""
    eps = F.lit(LOG_LOSS_EPSILON)
    clipped = F.least(F.greatest(truth_probability, eps), F.lit(1.0) - eps)
    return df.agg((-F.avg(F.log(clipped))).alias("logloss"))


# --- ranking metrics -----------------------------------------------------------------------------
def score_steps(df: DataFrame, positive: Column, score: Column, by: list[str] | None = None) -> DataFrame:
    """(by, score, pos, neg, tp, fp): counts at and above each distinct score, from the highest down.

    Rows with equal scores are merged before anything is ordered.
    """
    by = by or []
    grouped = df.select(*by, score.cast("double").alias("score"), positive.cast("long").alias("_pos")).groupBy(*by, "score").agg(
        F.sum("_pos").alias("pos"), F.sum(1 - F.col("_pos")).alias("neg"))
    return running_totals(grouped, ["score"], {"tp": "pos", "fp": "neg"}, by, descending=True)


def _totals(steps: DataFrame, by: list[str]) -> DataFrame:
    totals = steps.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    if by:
        # One row per class.
        return steps.join(F.broadcast(totals), by)
    row = totals.first()
    return steps.withColumns({"all_pos": F.lit(row["all_pos"]), "all_neg": F.lit(row["all_neg"])})


def roc_points(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, score, fpr, tpr) of each distinct score, and the origin with a null score.

    A rate over no rows, as with one class, is null.
    """
    by = by or []
    points = _totals(steps, by).select(
        *by, "score", F.try_divide("fp", "all_neg").alias("fpr"), F.try_divide("tp", "all_pos").alias("tpr"))
    zero = F.lit(0.0)
    start = steps.groupBy(*by).agg(F.lit(None).cast("double").alias("score"), zero.alias("fpr"), zero.alias("tpr"))
    return points.unionByName(start)


def roc_auc(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the curve: each step adds a trapezoid known from its own row, so no neighbour is looked up."""
    by = by or []
    area = F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2)
    sums = steps.groupBy(*by).agg(
        F.sum(area).alias("_area"), F.sum("pos").cast("double").alias("_p"), F.sum("neg").cast("double").alias("_n"))
    return sums.select(*by, (F.col("_area") / F.nullif(F.col("_p") * F.col("_n"), F.lit(0.0))).alias("roc_auc"))


def pr_points(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, score, precision, recall) of each distinct score, and the end point (1, 0) with a null score.

    Recall is null where there are no positives.
    """
    by = by or []
    points = _totals(steps, by).select(
        *by, "score", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", "all_pos").alias("recall"))
    end = steps.groupBy(*by).agg(
        F.lit(None).cast("double").alias("score"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def pr_auc(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Trapezoids over recall. The point before a step follows from the step's own counts; null without positives."""
    by = by or []
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))
    area = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")) + before) / 2
    return steps.groupBy(*by).agg(F.try_divide(F.sum(area), F.sum("pos")).alias("pr_auc"))


def _long_scores(df: DataFrame, y: str, scores: dict) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(s).cast("double").alias("score")) for c, s in scores.items()]))
    return df.select(F.col(y).alias("y"), each.alias("s")).select("y", "s.class", "s.score")


def class_steps(df: DataFrame, y: str, scores: dict) -> DataFrame:
    """Score steps of each class against the rest; ``scores`` maps class to score column."""
    long = _long_scores(df, y, scores)
    return score_steps(long, F.col("y") == F.col("class"), F.col("score"), ["class"])


def auc_one_vs_rest(df: DataFrame, y: str, scores: dict, weighted: bool = False) -> DataFrame:
    steps = class_steps(df, y, scores)
    if not weighted:
        return roc_auc(steps, ["class"]).agg(F.avg("roc_auc").alias("roc_auc"))
    support = df.groupBy(F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    per_class = roc_auc(steps, ["class"]).join(F.broadcast(support), "class")
    return per_class.agg((F.sum(F.col("roc_auc") * F.col("n")) / F.sum("n")).alias("roc_auc"))


def auc_one_vs_one(df: DataFrame, y: str, scores: dict, weighted: bool = True) -> DataFrame:
    """Mean over class pairs of both directions' areas, weighted by the rows of the pair.

    Each row enters the pairs its class takes part in: classes - 1 pairs, two scores each.
    """
    classes = list(scores)
    pairs = [
        F.struct(F.lit(f"{a}|{b}").alias("pair"), F.lit(pos).alias("class"), F.col(scores[pos]).cast("double").alias("score"),
                 F.col(y).isin(a, b).alias("member"))
        for i, a in enumerate(classes) for b in classes[i + 1:] for pos in (a, b)
    ]
    long = df.select(F.col(y).alias("y"), F.explode(F.array(*pairs)).alias("s")).where("s.member")
    long = long.select("y", "s.pair", "s.class", "s.score")
    steps = score_steps(long, F.col("y") == F.col("class"), F.col("score"), ["pair", "class"])
    sizes = steps.groupBy("pair").agg((F.sum(F.col("pos") + F.col("neg")) / 2).alias("n"))
    areas = roc_auc(steps, ["pair", "class"]).groupBy("pair").agg(F.avg("roc_auc").alias("auc")).join(F.broadcast(sizes), "pair")
    if weighted:
        return areas.agg((F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("roc_auc"))
    return areas.agg(F.avg("auc").alias("roc_auc"))


# --- regression ----------------------------------------------------------------------------------
def regression_metrics(df: DataFrame, y: str = "y", p: str = "prediction", features: int = 1, delta: float = 1.0) -> DataFrame:
    """All regression metrics in one pass, one row. Ratios to the variance of a constant target are null."""
    t, e = F.col(y).cast("double"), F.col(y).cast("double") - F.col(p).cast("double")
    size = F.abs(e)
    sums = df.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg(size).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.avg(size / F.greatest(F.abs(t), F.lit(MAPE_EPSILON))).alias("mape"),
        F.max(size).alias("max_err"),
        F.avg(-e).alias("mbd"),
        F.avg(F.when(size <= delta, e * e / 2).otherwise(delta * (size - delta / 2))).alias("huber"),
        F.var_pop(t).alias("var_y"),
        F.var_pop(e).alias("var_e"),
    )
    r2 = 1 - F.try_divide("mse", "var_y")
    return sums.select(
        "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"),
        (1 - F.try_divide((1 - r2) * (F.col("n") - 1), F.col("n") - features - 1)).alias("adjusted_r2"),
        "mape", (1 - F.try_divide("var_e", "var_y")).alias("evs"), "max_err", "mbd",
        F.try_divide("mse", "var_y").alias("rse"), "huber",
    )


# --- tables behind charts ------------------------------------------------------------------------
def residuals(df: DataFrame, y: str = "y", p: str = "prediction", keep: list[str] | None = None) -> DataFrame:
    return df.select(*(keep or []), F.col(p).alias("prediction"), (F.col(y) - F.col(p)).alias("residual"))


def residual_histogram(df: DataFrame, bins: int = 20, residual: str = "residual") -> DataFrame:
    """(bin, n, low, high) over equal widths between the extremes; every bin present."""
    edge = df.agg(F.min(residual).alias("lo"), F.max(residual).alias("hi")).first()
    lo, hi = float(edge["lo"]), float(edge["hi"])
    width = (hi - lo) / bins or 1.0
    place = F.least(F.floor((F.col(residual) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"),
        (F.lit(lo) + F.col("bin") * width).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"))


def predicted_vs_actual(df: DataFrame, y: str = "y", p: str = "prediction", keep: list[str] | None = None) -> DataFrame:
    """Each pair with the range of the truth, for the diagonal."""
    edge = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).first()
    return df.select(*(keep or []), F.col(y).alias("actual"), F.col(p).alias("prediction"),
                     F.lit(edge["lo"]).alias("low"), F.lit(edge["hi"]).alias("high"))


def long_metrics(table: DataFrame, metrics: list[str], model: str = "model") -> DataFrame:
    """(model, metric, value) of the metrics the table has."""
    present = [F.col(m).cast("double").alias(m) for m in metrics if m in table.columns]
    names = [m for m in metrics if m in table.columns]
    return table.select(model, *present).unpivot([model], names, "metric", "value")


def transposed_report(report: DataFrame, names: list[str]) -> DataFrame:
    """A report with metrics as rows and classes as columns."""
    numbers = ["precision", "recall", "f1_score", "support"]
    long = report.select("name", *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(["name"], numbers, "metric", "value")
    return long.groupBy("metric").pivot("name", names).agg(F.first("value"))


def fold_statistics(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Mean and population deviation of fold scores."""
    return scores.groupBy(*by).agg(F.avg(value).alias("mean_score"), F.stddev_pop(value).alias("std_score"))
