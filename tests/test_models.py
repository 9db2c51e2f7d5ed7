"""Linear models, indexing, bins and stacking against closed forms and brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from mergescope.operators import binning, indexing, linear
from mergescope.plans import modelling


def table(spark, x, y, **more):
    rows = [([float(v) for v in np.atleast_1d(a)], float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "x array<double>, label double").withColumn("features", array_to_vector("x"))


def objective(w, b, x, y, cost, epsilon):
    return cost * np.maximum(np.abs(y - x @ w - b) - epsilon, 0).sum() + 0.5 * (w ** 2).sum()


def test_support_vector_regression_on_a_line(spark):
    """All points fit a tube of width 1 round y = 2 x + 1, x = 0..10: the flattest line inside has slope 2 - 2 / 10."""
    x = np.arange(11.0)
    found = linear.LinearSVR(cost=100.0, epsilon=1.0, maxIter=20).fit(table(spark, x, 2 * x + 1))
    assert found.coefficients[0] == pytest.approx(1.8, abs=0.01) and found.intercept == pytest.approx(2.0, abs=0.05)


def test_support_vector_regression_ignores_outliers_and_is_a_minimum(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = x @ [1.5, -0.5] + 3 + rng.normal(size=200) * 0.05
    y[:10] += 50
    found = linear.LinearSVR(cost=2.0, epsilon=0.1, maxIter=20, tol=1e-6).fit(table(spark, x, y))
    assert np.allclose(found.coefficients, [1.5, -0.5], atol=0.05) and found.intercept == pytest.approx(3, abs=0.05)
    best = objective(found.coefficients, found.intercept, x, y, 2.0, 0.1)
    for step in rng.normal(size=(200, 3)) * 0.02:
        assert objective(found.coefficients + step[:2], found.intercept + step[2], x, y, 2.0, 0.1) >= best * 0.999


def test_ridge_against_closed_form(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(60, 3)) * [1, 10, 0.1] + 1e4, rng.normal(size=60)
    c = x - x.mean(axis=0)
    for penalty in (0.0, 2.0):
        w, b = linear.least_squares(table(spark, x, y), F.col("x"), F.col("label"), penalty)
        want = np.linalg.solve(c.T @ c + penalty * np.eye(3), c.T @ (y - y.mean()))
        assert np.allclose(w, want, rtol=1e-6) and b == pytest.approx(y.mean() - want @ x.mean(axis=0), rel=1e-6)
    with pytest.raises(ValueError):
        linear.least_squares(table(spark, x, y).where("false"), F.col("x"), F.col("label"))


def test_costs_are_tuned(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 1))
    df = table(spark, x, 3 * x[:, 0]).withColumn("fold", (F.abs(F.hash("label")) % 2).cast("int"))
    candidate = next(c for c in modelling.regressor_candidates(costs=(1e-4, 10.0)) if c.name == "LinearSVR")
    tuned = modelling.grid_search(candidate, df, "mse", 2)
    assert tuned.avgMetrics[1] < tuned.avgMetrics[0] and tuned.bestModel.coefficients[0] == pytest.approx(3, abs=0.2)


def test_penalties_reach_the_machine_inside_one_against_the_rest(spark):
    svm = next(c for c in modelling.classifier_candidates(2, 3) if c.name == "LinearSVC")
    assert len(svm.grid) == 3
    inner = [svm.estimator.copy(params).getClassifier().getRegParam() for params in svm.grid]
    assert inner == [0.01, 0.1, 1.0] and svm.estimator.getClassifier().getMaxIter() == 100


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_dictionary_against_brute_force(spark, hot):
    rng = random.Random(3)
    seen = [rng.choice(["a", "a", "a", "b", "", "é", "z9", None, *map(str, range(12))]) for _ in range(300)]
    later = seen[:40] + ["new", None, "B"]
    schema = "id long, s string, t string"
    df = spark.createDataFrame([(i, s, "same") for i, s in enumerate(seen)], schema)
    dictionary = indexing.fit_dictionary(df, ["s", "t"])
    counts = Counter(s for s in seen if s is not None)
    order = sorted(counts, key=lambda s: (-counts[s], s.encode()))
    want = [float(order.index(s)) if s in counts else float(len(order)) for s in later]
    got = indexing.encode(spark.createDataFrame([(i, s, None) for i, s in enumerate(later)], schema), dictionary, ["s", "t"], hot).orderBy("id").collect()
    assert [r.s for r in got] == want and {r.t for r in got} == {1.0}
    assert indexing.fit_dictionary(df.where("false"), ["s"]).count() == 0


def test_bins_and_selection(spark):
    """A column of more than 10,000 distinct values; nulls are a category; noise comes last."""
    df = spark.range(12_000).select(
        F.col("id").cast("double").alias("wide"), F.when(F.col("id") % 3 > 0, F.lit(1.0)).alias("gaps"),
        F.pmod(F.hash("id"), F.lit(97)).alias("noise"), (F.col("id") < 5000).cast("int").alias("y"))
    edges = binning.bin_edges(df, ["wide", "gaps"], 4)
    assert edges["wide"] == [2999.75, 5999.5, 8999.25] and edges["gaps"] == [1.0]
    assert binning.select_features(df, ["noise", "gaps", "wide"], "y", 1) == ["wide"]
    rows = {r.feature: r for r in binning.binned_chi_square(df, ["wide", "gaps"], "y", 4).collect()}
    assert rows["wide"].degrees == 3 and rows["gaps"].degrees == 1


def test_tail_of_chi_square():
    for statistic, degrees, want in [(3.841458821, 1, 0.05), (18.30703805, 10, 0.05), (2.705543454, 1, 0.1), (0.5, 4, 0.973500979), (200.0, 3, 4.2e-43)]:
        assert binning.chi_square_tail(statistic, degrees) == pytest.approx(want, rel=0.02)


class Remembering(Estimator):
    """Its model tells whether it was fitted on a row's fold."""

    def _fit(self, df):
        return Remembered([r["fold"] for r in df.select("fold").distinct().collect()])


class Remembered(Model):
    def __init__(self, folds=()):
        super().__init__()
        self.folds = folds

    def _transform(self, df):
        return df.withColumn("prediction", F.col("fold").isin(self.folds).cast("double"))


class Keeping(Estimator):
    def _fit(self, df):
        model = Remembered()
        model.scores = df
        return model


def test_stacked_scores_come_from_models_that_did_not_see_the_row(spark):
    from pyspark.ml.functions import vector_to_array

    df = table(spark, np.arange(20.0), np.arange(20.0)).withColumn("fold", (F.col("label") % 4).cast("int"))
    stack = modelling.fit_stacks([Remembering(), Remembering()], {"last": Keeping()}, df, k=4)["last"]
    scores = stack.last.scores.select(vector_to_array("_stack").alias("s")).collect()
    assert len(scores) == 20 and {tuple(r.s) for r in scores} == {(0.0, 0.0)}
    assert all(sorted(b.folds) == [0, 1, 2, 3] for b in stack.bases)


class Watching(Keeping):
    """Notes how the rows of each fit are dealt out, and by which plan."""

    def __init__(self):
        super().__init__()
        self.seen = []

    def copy(self, extra=None):
        return self

    def _fit(self, df):
        sizes = [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
        self.seen.append((sizes, df._jdf.queryExecution().executedPlan().toString()))
        return Remembered([0])


@pytest.mark.parametrize("job", ["grid", "folds", "curve", "stack"])
def test_training_tables_are_dealt_evenly_and_kept(spark, job):
    """Hundreds of passes meet neither hundreds of tasks of a few rows nor one with most of them, and no Python."""
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(4000).select("id", F.col("id").cast("double").alias("label"), array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
    df = df.withColumn("fold", (F.col("id") % 2).cast("int")).repartition(150, F.col("id") % 3)
    watch = Watching()
    if job == "grid":
        modelling.grid_search(modelling.Candidate("w", watch, [{}, {}]), df, "mse", 2)
    elif job == "folds":
        modelling.fold_scores(spark, watch, df, "mse", 2)
    elif job == "curve":
        modelling.learning_curve(spark, watch, df, "id", "mse", 2, 2)
    else:
        modelling.fit_stacks([watch], {"last": Keeping()}, df, k=2)
    assert len(watch.seen) == {"grid": 5, "folds": 2, "curve": 4, "stack": 3}[job]
    for sizes, plan in watch.seen:
        assert len(sizes) == cores and max(sizes) < 3 * sum(sizes) / cores
        assert "InMemoryTableScan" in plan and "EvalPython" not in plan.split("InMemoryRelation")[0]


def test_few_models_are_fitted_at_a_time_on_many_rows():
    assert [modelling.workers(n, 4) for n in (0, 10 ** 6, 10 ** 7, 10 ** 9)] == [4, 4, 2, 1]


def folded_rows(spark, classes):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 3)) * [1.0, 40.0, 0.1] + [0.0, 300.0, 5.0]
    y = np.clip(np.round(x[:, 0] + x[:, 1] / 80 - 3.75 + rng.normal(size=700) * 0.5 + (classes - 1) / 2), 0, classes - 1)
    df = table(spark, x, y).withColumn("fold", F.pmod(F.hash("x"), F.lit(3)).cast("int"))
    return df.repartition(4, "label", "x").cache()


@pytest.mark.parametrize("classes", [2, 3])
def test_machines_fitted_together_are_those_of_spark(spark, classes):
    from mergescope.operators import together

    df = folded_rows(spark, classes)
    svm = next(c for c in modelling.classifier_candidates(3, classes, penalties=(0.0, 0.1), iterations=12) if c.name == "LinearSVC")
    tasks = [(svm.estimator.copy(params), fold) for params in svm.grid for fold in (None, 1)]
    with together.blocked(df, "features", "label", [None, 0, 1, 2]) as blocks:
        found = together.fitter(svm.estimator)(blocks, tasks)
    for model, (estimator, fold) in zip(found, tasks):
        want = estimator.fit(df if fold is None else df.where(F.col("fold") != fold))
        machines = [want] if classes == 2 else want.models
        assert np.allclose(model.weights, [[*m.coefficients, m.intercept] for m in machines], rtol=1e-5, atol=1e-8)
        shown = [m.transform(df).select("rawPrediction", "prediction").collect() for m in (model, want)]
        assert [r.prediction for r in shown[0]] == [r.prediction for r in shown[1]]
        assert np.allclose([r.rawPrediction for r in shown[0]], [r.rawPrediction for r in shown[1]], rtol=1e-4, atol=1e-6)


@pytest.mark.parametrize("classes", [2, 3])
def test_networks_fitted_together_are_those_of_spark(spark, classes):
    from mergescope.operators import together

    df = folded_rows(spark, classes)
    shapes = [modelling.network_classifier(3, classes, hidden, maxIter=8) for hidden in ((4,), (3, 2))]
    tasks = [(e, fold) for e in shapes for fold in (None, 2)]
    with together.blocked(df, "features", "label", [None, 0, 1, 2]) as blocks:
        found = together.fitter(shapes[0])(blocks, tasks)
    for model, (estimator, fold) in zip(found, tasks):
        want = estimator.fit(df if fold is None else df.where(F.col("fold") != fold))
        assert np.allclose(model.weights.toArray(), want.weights.toArray(), rtol=1e-4, atol=1e-6)


def test_models_of_all_folds_share_their_passes(spark, monkeypatch):
    """Six machines ask for no more passes than the slowest of them, and rows without a label are refused as before."""
    from mergescope.operators import together

    df, passes, sums = folded_rows(spark, 2), [], together.Blocks.sums
    monkeypatch.setattr(together.Blocks, "sums", lambda self, *a: passes.append(1) or sums(self, *a))
    svm = modelling.svm_classifier(maxIter=10)
    with together.blocked(df, "features", "label", [None, 0, 1, 2]) as blocks:
        alone = []
        for fold in (None, 0, 1, 2):
            together.fit_machines(blocks, [(svm, fold)])
            alone.append(len(passes))
            passes.clear()
        together.fit_machines(blocks, [(svm, fold) for fold in (None, 0, 1, 2)])
        assert len(passes) < 0.6 * sum(alone)
    with pytest.raises(Exception, match="no features, label or fold"):
        modelling.grid_search(modelling.Candidate("svm", svm), df.withColumn("label", F.when(F.col("label") > 0, 1.0)), "accuracy", 3)
    assert together.fitter(modelling.forest_classifier()) is None and together.fitter(svm.copy({svm.standardization: False})) is None
