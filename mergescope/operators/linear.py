"""Linear models from sums over rows.

Each pass adds up, task by task, a few numbers per row in numpy; the sums of tasks meet in one aggregation. What reaches
the driver is as large as a matrix of the features, whatever the number of rows. The equations are solved there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Summand = Callable[[np.ndarray, np.ndarray], np.ndarray]


def summed(df: DataFrame, features: Column, label: Column, summand: Summand) -> np.ndarray:
    """The sum over batches of ``summand(x, y)``, an array of fixed shape. Rows with a null label take no part.

    ``features`` is an array column of one length; x gets a last column of ones.
    """
    rows = df.select(features.alias("x"), label.cast("double").alias("y")).where("x is not null and y is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                lists = batch.column("x")
                x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
                part = np.asarray(summand(np.column_stack([x, np.ones(len(x))]), batch.column("y").to_numpy(zero_copy_only=False)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel().astype(float))], ["place", "part"])

    parts = rows.mapInArrow(run, "place long, part double")
    sums = parts.groupBy("place").agg(F.sum("part").alias("total")).toPandas().sort_values("place")
    return sums["total"].to_numpy()


def least_squares(df: DataFrame, features: Column, label: Column, penalty: float = 0.0) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of the smallest sum of squares plus ``penalty`` times the coefficients' squares."""

    def gram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.column_stack([x, y])
        return z.T @ z

    # Sums around the means keep their digits where columns are far from 0.
    mean = summed(df, features, label, lambda x, y: np.column_stack([x, y]).sum(axis=0))
    if not len(mean):
        raise ValueError("no rows to fit")
    mean = mean / mean[-2]
    centre = mean[:-2]

    def centred(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return gram(x[:, :-1] - centre, y - mean[-1])

    size = len(centre) + 1
    g = summed(df, features, label, centred).reshape(size, size)
    inner, outer = g[:-1, :-1] + penalty * np.eye(size - 1), g[:-1, -1]
    weights = np.linalg.lstsq(inner, outer, rcond=None)[0]
    return weights, float(mean[-1] - weights @ centre)


class LinearPredictor(Model, HasFeaturesCol, HasPredictionCol):
    """Predicts by coefficients and intercept."""

    def __init__(self, coefficients: np.ndarray | None = None, intercept: float = 0.0, features: str = "features"):
        super().__init__()
        self.coefficients, self.intercept = coefficients, intercept
        self._set(featuresCol=features)

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(self.getFeaturesCol())
        terms = [F.get(x, F.lit(i)) * F.lit(float(w)) for i, w in enumerate(self.coefficients)]
        return df.withColumn(self.getPredictionCol(), sum(terms, F.lit(float(self.intercept))))


class LeastSquares(Estimator, HasFeaturesCol, HasLabelCol):
    """Least squares, ridge with a penalty, from one aggregated matrix."""

    penalty = Param(Params._dummy(), "penalty", "weight of the coefficients' squares", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", penalty=0.0):
        super().__init__()
        self._setDefault(penalty=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> LinearPredictor:
        features = self.getFeaturesCol()
        found = least_squares(df, vector_to_array(features), F.col(self.getLabelCol()), self.getOrDefault(self.penalty))
        return LinearPredictor(*found, features)


def _equations(x: np.ndarray, y: np.ndarray, theta: np.ndarray, width: float, cost: float, epsilon: float) -> np.ndarray:
    """A Newton step's equations: the matrix of errors within the rounded kinks, and the pull of all errors."""
    error = y - x @ theta
    over = np.maximum(np.abs(error) - epsilon, 0)
    curved = (over > 0) & (over < width)
    pull = np.sign(error) * np.minimum(over / width, 1)
    return cost * np.append((x[curved].T @ x[curved] / width).ravel(), x.T @ pull)


class LinearSVR(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter):
    """Linear support vector regression: cost times what errors exceed epsilon, plus half the coefficients' squares.

    The kinks of the loss are rounded off by parabolas of a width that shrinks from round to round. Each round takes Newton
    steps: one pass sums the normal equations, in which errors on a parabola have weight and errors beyond pull with constant
    force; another sums the objective along the step for many lengths at once, and the best one is taken. A round ends when
    a step gains less than ``tol`` of the objective, and after ``maxIter`` steps.
    """

    cost = Param(Params._dummy(), "cost", "weight of the errors beyond epsilon", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "errors up to this size cost nothing", TypeConverters.toFloat)
    tol = Param(Params._dummy(), "tol", "gain of a step at which to stop", TypeConverters.toFloat)

    #: Widths of the rounded kinks, in deviations of the least squares' errors, and lengths of a step that are tried.
    WIDTHS = (0.3, 0.03, 0.003)
    LENGTHS = np.append(0.0, 2.0 ** -np.arange(12))

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", cost=1.0, epsilon=0.1, maxIter=6, tol=1e-4):
        super().__init__()
        self._setDefault(cost=1.0, epsilon=0.1, maxIter=6, tol=1e-4)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> LinearPredictor:
        features, label = vector_to_array(self.getFeaturesCol()), F.col(self.getLabelCol())
        cost, epsilon = self.getOrDefault(self.cost), self.getOrDefault(self.epsilon)
        start = least_squares(df, features, label, 1.0 / cost)
        theta = np.append(start[0], start[1])
        size, lengths = len(theta), self.LENGTHS
        count, square = summed(df, features, label, lambda x, y: np.array([len(y), ((y - x @ theta) ** 2).sum()]))
        # The intercept is free; a trace of weight keeps its equation solvable when no error is on a parabola.
        ridge = np.append(np.ones(size - 1), 1e-9)
        for width in np.array(self.WIDTHS) * max(np.sqrt(square / count), epsilon, 1e-6):
            sums = summed(df, features, label, lambda x, y: _equations(x, y, theta, width, cost, epsilon))
            for _ in range(self.getMaxIter()):
                slope = sums[size * size:] - np.append(theta[:-1], 0.0)
                step = np.linalg.solve(sums[:size * size].reshape(size, size) + np.diag(ridge), slope)

                def along(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                    """The objective along the step, and the equations at its end, where most steps go."""
                    errors = (y - x @ theta)[:, None] - (x @ step)[:, None] * lengths
                    over = np.maximum(np.abs(errors) - epsilon, 0)
                    loss = cost * np.where(over < width, over ** 2 / (2 * width), over - width / 2).sum(axis=0)
                    return np.append(loss, _equations(x, y, theta + step, width, cost, epsilon))

                found = summed(df, features, label, along)
                total = found[:len(lengths)] + 0.5 * ((theta[:-1, None] + step[:-1, None] * lengths) ** 2).sum(axis=0)
                best = int(total.argmin())
                theta = theta + step * lengths[best]
                if total[0] - total[best] <= self.getOrDefault(self.tol) * total[0]:
                    break
                sums = found[len(lengths):] if lengths[best] == 1 else summed(df, features, label, lambda x, y: _equations(x, y, theta, width, cost, epsilon))
        return LinearPredictor(theta[:-1], float(theta[-1]), self.getFeaturesCol())
