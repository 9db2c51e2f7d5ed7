"""Support vector machines and networks of many folds and parameters, fitted together.

Spark ML fits one model at a time, and each asks for hundreds of passes over the rows. Here the models that differ in fold,
penalty, class or layers take their steps side by side: every pass computes the value and gradient that each of them asks for
next, in numpy on blocks of rows, and only these sums reach the driver. The objectives, starting points, searches and
stopping rules are those of Spark ML's ``LinearSVC`` (orthant-wise limited-memory quasi-Newton steps, by backtracking) and
``MultilayerPerceptronClassifier`` (limited-memory quasi-Newton steps, by strong Wolfe conditions).
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasRawPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Point = tuple[float, np.ndarray]
# A search yields the point it needs and then those it may need next, and is sent what is known of the first of them.
Search = Generator[list[np.ndarray], list[Point], np.ndarray]

# Rows that numpy works on at a time; steps that a search remembers, and values that its stopping rule looks back on.
CHUNK, MEMORY, LOOK_BACK = 2048, 10, 20
# Machines that one pass weighs: while fewer are sought, lengths that a search may try next are weighed with those it tries.
COLUMNS, AHEAD = 32, 8
# Rows of a block that is kept, and rows that Spark ML's networks stack.
BLOCK, STACK = 16384, 128


# --- searches: each returns the point it ends at ---------------------------------------------------------
class SearchFailed(Exception):
    """A line search found no step."""


@np.errstate(divide="ignore", invalid="ignore", over="ignore")
def _descent(grad: np.ndarray, steps: list, changes: list) -> np.ndarray:
    """The quasi-Newton direction from the last steps and changes of the gradient, newest first."""
    if not steps:
        return -grad
    product = steps[0] @ changes[0]
    if not product >= 0:
        raise SearchFailed("the curvature is negative")
    scale, d, weights = product / (changes[0] @ changes[0]), grad.copy(), []
    rho = [s @ c for s, c in zip(steps, changes)]
    for s, c, r in zip(steps, changes, rho):
        weights.append(s @ d / r)
        if np.isnan(weights[-1]):
            raise SearchFailed("a step or a change is zero")
        d -= weights[-1] * c
    d *= scale
    for s, c, r, w in reversed(list(zip(steps, changes, rho, weights))):
        d += (w - c @ d / r) * s
    return -d


def _wolfe(value: float, slope: float, first: float) -> Generator[float, tuple[float, float], float]:
    """A length that meets the strong Wolfe conditions; yields lengths, is sent the value and slope there."""
    if slope > 0:
        raise SearchFailed("not a descent")

    def between(a: tuple, b: tuple) -> float:
        """Where a cubic through both ends is least, at least a tenth of the way from either."""
        (s, f, u), (t, g, v) = (a, b) if a[0] <= b[0] else (b, a)
        p = u + v - 3 * (f - g) / (s - t)
        q = np.sqrt(p * p - u * v)
        at = t - (t - s) * (v + q - p) / (v - u + 2 * q)
        low, high = s + 0.1 * (t - s), s + 0.9 * (t - s)
        return low if at < low else high if at > high else at

    def zoom(low: tuple, high: tuple) -> Generator[float, tuple[float, float], float]:
        for _ in range(10):
            t = between(low, high)
            here = (t, *(yield t))
            if here[1] > value + 1e-4 * t * slope or here[1] >= low[1]:
                high = here
            else:
                if abs(here[2]) <= 0.9 * abs(slope):
                    return t
                if here[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = here
        raise SearchFailed("zoom")

    t, low = first, (0.0, value, slope)
    for i in range(10):
        here = (t, *(yield t))
        if not np.isfinite(here[1]):
            t /= 2.0
        elif here[1] > value + 1e-4 * t * slope or (here[1] >= low[1] and i > 0):
            return (yield from zoom(low, here))
        elif abs(here[2]) <= 0.9 * abs(slope):
            return t
        elif here[2] >= 0:
            return (yield from zoom(here, low))
        else:
            low, t = here, t * 1.5
    raise SearchFailed("line")


def _backtrack(value: float, slope: float, first: float, shrink: float) -> Generator[float, tuple[float, float], float]:
    """A length by shrinking and growing; yields lengths, is sent the value and slope there. As in Spark ML's search the first
    length is not tried before it has shrunk, and the last one is taken if none fits."""
    t = first * shrink
    for _ in range(19):
        here, pull = yield t
        if here > value + t * pull * 1e-4:
            factor = shrink
        elif pull < 0.9 * slope:
            factor = 2.1
        elif pull > -0.9 * slope:
            factor = shrink
        else:
            return t
        last, t = t, t * factor
        if not 1e-10 <= t <= 1e10:
            raise SearchFailed("length")
    return last


def _lengths_ahead(t: float, shrink: float) -> list[float]:
    """A length and those that backtracking may try after it, shorter ones mostly."""
    shorter = [t]
    while len(shorter) < AHEAD:
        shorter.append(shorter[-1] * shrink)
    return [*shorter[:2], t * 2.1, *shorter[2:]]


def quasi_newton(x: np.ndarray, most: int, tol: float, orthants: bool) -> Search:
    """Limited-memory quasi-Newton steps, with ``orthants`` such as do not leave the orthant of the last point."""
    (value, grad), = yield [x]
    start, seen, steps, changes, n, failed = value, [np.inf], [], [], 0, False
    while n < most and not (len(seen) > 1 and abs(value - max(seen)) <= tol * abs(start)) and np.linalg.norm(grad) > max(tol * value, 1e-8):
        try:
            d = _descent(grad, steps, changes)
            if orthants:
                d = np.where(d * grad < 0, d, 0.0)
                side = np.where(x != 0, np.sign(x), np.sign(-grad))
                shrink = 0.1 if n < 1 else 0.5
                search = _backtrack(value, d @ grad, 0.5 / np.linalg.norm(grad) if n < 1 else 1.0, shrink)
            else:
                search = _wolfe(value, d @ grad, 1.0 / np.linalg.norm(d) if n == 0 else 1.0)
            t, known = next(search), {}
            while True:
                last = t
                if t not in known:
                    ahead = [t] if not orthants else _lengths_ahead(t, shrink)
                    points = [x + d * u for u in ahead]
                    if orthants:
                        points = [np.where(np.sign(p) == side, p, 0.0) for p in points]
                    known |= {u: (p, *found) for u, p, found in zip(ahead, points, (yield points))}
                try:
                    t = search.send((known[t][1], known[t][2] @ d))
                except StopIteration as end:
                    t = end.value
                    break
            if not orthants and t * np.linalg.norm(grad) < 1e-10:
                raise SearchFailed("length")
        except SearchFailed:
            if failed:
                break
            failed, steps, changes = True, [], []
            continue
        failed, n = False, n + 1
        new, value, slope = known[last]
        steps, changes = [new - x, *steps][:MEMORY], [slope - grad, *changes][:MEMORY]
        x, grad, seen = new, slope, [*seen, value][-LOOK_BACK:]
    return x


def side_by_side(searches: list[Search], evaluate: Callable[[dict[int, list[np.ndarray]]], dict[int, list[Point]]]) -> list[np.ndarray]:
    """What each search returns, when all that still run are told their points' values by one call at a time."""
    asked, done = {i: next(s) for i, s in enumerate(searches)}, [None] * len(searches)
    while asked:
        for i, points in evaluate(asked).items():
            try:
                asked[i] = searches[i].send(points)
            except StopIteration as end:
                done[i] = end.value
                del asked[i]
    return done


# --- rows in blocks --------------------------------------------------------------------------------
Part = Callable[[np.ndarray, np.ndarray, int, np.ndarray | None], list[tuple[int, np.ndarray]]]


@dataclass
class Blocks:
    """Rows of a training table: blocks of one fold, each a matrix of features and, last, the label.

    Spark ML's networks take the mean over stacks of 128 rows, of which the last of a partition may be smaller. ``weights``
    has what its rows weigh if a fold is left out, a column for each of ``left_out``; without it all weigh 1 / 128.
    """

    table: DataFrame
    width: int
    left_out: list[int | None]

    def sums(self, part: Part, sizes: list[int]) -> list[np.ndarray]:
        """Sums over all rows, in the order of partitions; ``part(x, y, fold, weights)`` gives (place, array) for some places."""
        width, columns = self.width, len(self.left_out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = [np.zeros(n) for n in sizes]
            for batch in batches:
                for fold, data, weights in zip(batch.column("fold").to_pylist(), batch.column("data"), batch.column("weights")):
                    rows = np.frombuffer(data.as_buffer()).reshape(-1, width + 1)
                    heavy = np.frombuffer(weights.as_buffer()).reshape(-1, columns) if weights.is_valid else None
                    for at in range(0, len(rows), CHUNK):
                        chunk = rows[at:at + CHUNK]
                        for place, found in part(chunk[:, :-1], chunk[:, -1], fold, None if heavy is None else heavy[at:at + CHUNK]):
                            totals[place] += found
            yield pa.RecordBatch.from_pydict({"sums": [np.concatenate(totals).tobytes()]}, pa.schema([("sums", pa.binary())]))

        whole = sum((np.frombuffer(r["sums"]) for r in self.table.mapInArrow(run, "sums binary").collect()), np.zeros(sum(sizes)))
        return np.split(whole, np.cumsum(sizes)[:-1])


def stack_weights(folds: np.ndarray, left_out: list[int | None]) -> np.ndarray:
    """What the rows of a partition weigh if a fold is left out: one over the rows of their stack."""
    weights = np.full((len(folds), len(left_out)), 1.0 / STACK)
    for column, fold in enumerate(left_out):
        inside = np.arange(len(folds)) if fold is None else np.flatnonzero(folds != fold)
        rest = len(inside) % STACK
        if rest:
            weights[inside[-rest:], column] = 1.0 / rest
    return weights


@contextmanager
def blocked(df: DataFrame, features: str, label: str, left_out: list[int | None]) -> Iterator[Blocks]:
    """The rows of a table with a ``fold`` in blocks, kept in memory, dealt as the table is. A task holds a partition."""
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), F.col("fold").cast("int").alias("fold"))
    schema = pa.schema([("fold", pa.int32()), ("data", pa.binary()), ("weights", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, places = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, y = batch.column("x"), batch.column("y")
            if lists.null_count or y.null_count or batch.column("fold").null_count:
                raise ValueError("a row to train on has no features, label or fold")
            parts.append(np.column_stack([lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1), y.to_numpy()]))
            places.append(batch.column("fold").to_numpy())
        if not parts:
            return
        data, folds = np.concatenate(parts), np.concatenate(places)
        parts.clear()
        if not np.isfinite(data).all():
            raise ValueError("a row to train on is not finite")
        weights = stack_weights(folds, left_out)
        last = (weights != 1.0 / STACK).any(axis=1)
        for fold in np.unique(folds):
            inside = np.flatnonzero((folds == fold) & ~last)
            for at in range(0, len(inside), BLOCK):
                yield pa.RecordBatch.from_pydict({"fold": [int(fold)], "data": [data[inside[at:at + BLOCK]].tobytes()], "weights": [None]}, schema)
            inside = np.flatnonzero((folds == fold) & last)
            if len(inside):
                yield pa.RecordBatch.from_pydict({"fold": [int(fold)], "data": [data[inside].tobytes()], "weights": [weights[inside].tobytes()]}, schema)

    first = rows.first()
    if first is None:
        raise ValueError("no rows to fit")
    table = rows.mapInArrow(run, "fold int, data binary, weights binary").cache()
    try:
        yield Blocks(table, len(first["x"]), left_out)
    finally:
        table.unpersist()


# --- support vector machines -----------------------------------------------------------------------
class Margins(Model, HasFeaturesCol, HasPredictionCol, HasRawPredictionCol):
    """Linear machines: one between two classes, or one a class against the rest."""

    def __init__(self, weights: np.ndarray | None = None, features: str = "features"):
        super().__init__()
        self.weights = weights
        self._set(featuresCol=features)

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(self.getFeaturesCol())
        margins = [sum((F.get(x, F.lit(i)) * F.lit(float(v)) for i, v in enumerate(w[:-1])), F.lit(0.0)) + F.lit(float(w[-1])) for w in self.weights]
        raw = F.array(*([-margins[0], margins[0]] if len(margins) == 1 else margins))
        df = df.withColumn("_raw", raw)
        best = F.col("_raw")[1] > 0 if len(margins) == 1 else F.array_position("_raw", F.array_max("_raw")) - 1
        return df.withColumn(self.getRawPredictionCol(), array_to_vector("_raw")).withColumn(self.getPredictionCol(), best.cast("double")).drop("_raw")


def _hinges(blocks: Blocks, weights: np.ndarray, classes: np.ndarray, left_out: list) -> np.ndarray:
    """Of each machine, a row of ``weights``: the sum of its hinge losses and the gradient, over the rows out of its fold."""
    chosen = {f: np.array([g is None or g != f for g in left_out]) for f in blocks.left_out if f is not None}
    chosen = {f: (np.flatnonzero(use), weights[use, :-1].T.copy(), weights[use, -1].copy(), classes[use]) for f, use in chosen.items()}
    shape = (len(weights), weights.shape[1] + 1)

    def part(x: np.ndarray, y: np.ndarray, fold: int, _) -> list[tuple[int, np.ndarray]]:
        use, inner, base, positive = chosen[fold]
        if not len(use):
            return []
        sign = np.where(y[:, None] == positive, 1.0, -1.0)
        loss = x @ inner
        loss += base
        loss *= sign
        np.subtract(1.0, loss, out=loss)
        sign *= loss > 0
        np.maximum(loss, 0.0, out=loss)
        found = np.zeros(shape)
        found[use] = np.column_stack([loss.sum(axis=0), -(sign.T @ x), -sign.sum(axis=0)])
        return [(0, found.ravel())]

    return blocks.sums(part, [shape[0] * shape[1]])[0].reshape(shape)


def _facts(blocks: Blocks, folds: list) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of the rows out of each of the folds: their number, the greatest label and the features' means and deviations."""
    width, facts = blocks.width, []
    names = sorted({r["fold"] for r in blocks.table.select("fold").distinct().collect()})
    at = {f: i for i, f in enumerate(names)}
    sizes = [1 + 2 * width] * len(names)
    counts = blocks.sums(lambda x, y, fold, _: [(at[fold], np.concatenate([[len(x)], x.sum(axis=0), np.zeros(width)]))], sizes)
    mean = sum(counts)[1:1 + width] / sum(counts)[0]
    moments = blocks.sums(lambda x, y, fold, _: [(at[fold], np.concatenate([[len(x)], (x - mean).sum(axis=0), ((x - mean) ** 2).sum(axis=0)]))], sizes)
    found = blocks.table.mapInArrow(_greatest(width), "fold int, y double").groupBy("fold").agg(F.max("y").alias("y"))
    greatest = {r["fold"]: int(r["y"]) for r in found.collect()}
    for left_out in folds:
        inside = [f for f in names if f != left_out]
        if not inside:
            raise ValueError("no rows to fit")
        n, first, second = np.split(sum(moments[at[f]] for f in inside), [1, 1 + width])
        spread = np.sqrt(np.maximum(second - first ** 2 / n, 0.0) / np.maximum(n - 1, 1))
        facts.append((int(n[0]), max(greatest[f] for f in inside), mean + first / n, spread))
    return facts


def _greatest(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = [float(np.frombuffer(d.as_buffer()).reshape(-1, width + 1)[:, -1].max()) for d in batch.column("data")]
            yield pa.RecordBatch.from_pydict({"fold": batch.column("fold"), "y": most}, pa.schema([("fold", pa.int32()), ("y", pa.float64())]))

    return run


def fit_machines(blocks: Blocks, tasks: list[tuple[Estimator, int | None]]) -> list[Margins]:
    """A model for each (estimator, fold left out): support vector machines, also one against the rest."""
    facts, machines = _facts(blocks, [fold for _, fold in tasks]), []
    for place, (estimator, fold) in enumerate(tasks):
        rest = isinstance(estimator, OneVsRest)
        one = estimator.getClassifier() if rest else estimator
        machines += [(place, one, c, fold) for c in (range(facts[place][1] + 1) if rest else [1])]
    classes, folds = np.array([float(c) for *_, c, _ in machines]), [fold for *_, fold in machines]
    # Machines are sought for features of mean 0 and deviation 1; the matrix leads from there to the features themselves.
    maps = []
    for place, *_ in machines:
        _, _, mean, spread = facts[place]
        scale = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
        maps.append(np.diag(np.append(scale, 1.0)))
        maps[-1][-1, :-1] = -mean * scale

    def evaluate(asked: dict[int, list[np.ndarray]]) -> dict[int, list[Point]]:
        room, found = max(1, COLUMNS // len(asked)), {i: [] for i in asked}
        order = [(i, x) for i, points in asked.items() for x in points[:room]]
        places = [i for i, _ in order]
        totals = _hinges(blocks, np.array([maps[i] @ x for i, x in order]), classes[places], [folds[i] for i in places])
        for (i, x), total in zip(order, totals):
            place, one, *_ = machines[i]
            penalised = one.getRegParam() * np.append(x[:-1], 0.0)
            found[i].append((total[0] / facts[place][0] + 0.5 * penalised @ x, total[1:] @ maps[i] / facts[place][0] + penalised))
        return found

    searches = [quasi_newton(np.zeros(blocks.width + 1), one.getMaxIter(), one.getTol(), True) for _, one, *_ in machines]
    found = [m @ x for m, x in zip(maps, side_by_side(searches, evaluate))]
    return [Margins(np.array([w for w, m in zip(found, machines) if m[0] == place]), e.getFeaturesCol()) for place, (e, _) in enumerate(tasks)]


# --- networks --------------------------------------------------------------------------------------
def network_loss(layers: list[int], weights: np.ndarray, x: np.ndarray, y: np.ndarray, heavy: np.ndarray | float) -> np.ndarray:
    """The rows' weights, the weighted sum of their cross entropies, and its gradient: sigmoids in the hidden layers, softmax
    at the end."""
    # Units are rows and the table's rows columns, so that sums over units are fast.
    parts, at, outs = [], 0, [x.T]
    for into, out in zip(layers, layers[1:]):
        parts.append((at, weights[at:at + into * out].reshape(into, out), weights[at + into * out:at + into * out + out, None]))
        at += into * out + out
    found = np.empty(len(weights) + 2)
    with np.errstate(over="ignore", divide="ignore"):
        for _, w, b in parts[:-1]:
            hidden = w.T @ outs[-1]
            hidden += b
            np.negative(hidden, out=hidden)
            np.exp(hidden, out=hidden)
            hidden += 1.0
            outs.append(np.reciprocal(hidden, out=hidden))
        delta = parts[-1][1].T @ outs[-1]
        delta += parts[-1][2]
        delta -= delta.max(axis=0)
        np.exp(delta, out=delta)
        delta /= delta.sum(axis=0)
        truth = y == np.arange(layers[-1])[:, None]
        losses = np.log(np.where(truth, delta, 0.0).sum(axis=0))
    delta -= truth
    if np.isscalar(heavy):
        found[:2] = heavy * len(y), -heavy * losses.sum()
    else:
        found[:2] = heavy.sum(), -(heavy @ losses)
    delta *= heavy
    for i in range(len(parts) - 1, -1, -1):
        at, w, b = parts[i]
        found[2 + at:2 + at + w.size] = (outs[i] @ delta.T).ravel()
        found[2 + at + w.size:2 + at + w.size + len(b)] = delta.sum(axis=1)
        if i:
            delta = w @ delta
            delta *= outs[i]
            delta *= 1.0 - outs[i]
    return found


def fit_networks(blocks: Blocks, tasks: list[tuple[Estimator, int | None]]) -> list[Model]:
    """A network for each (estimator, fold left out). Spark ML's own estimator draws the first weights, and makes the model
    of the last ones by a fit without a step."""
    facts = _facts(blocks, [fold for _, fold in tasks])
    spark = blocks.table.sparkSession
    for (estimator, _), (_, greatest, *_) in zip(tasks, facts):
        if greatest >= estimator.getLayers()[-1] or blocks.width != estimator.getLayers()[0]:
            raise ValueError(f"layers {estimator.getLayers()} for {blocks.width} features and labels up to {greatest}")

    def unmoved(estimator: Estimator, weights: np.ndarray | None = None) -> Model:
        still = estimator.copy({estimator.maxIter: 0} | ({} if weights is None else {estimator.initialWeights: Vectors.dense(weights)}))
        row = (Vectors.dense([0.0] * blocks.width), 0.0)
        return still.fit(spark.createDataFrame([row], [estimator.getFeaturesCol(), estimator.getLabelCol()]))

    def evaluate(asked: dict[int, list[np.ndarray]]) -> dict[int, list[Point]]:
        order, left_out = list(asked), [tasks[i][1] for i in asked]
        layers, points = [tasks[i][0].getLayers() for i in order], [p[0] for p in asked.values()]

        columns = [blocks.left_out.index(f) for f in left_out]

        def part(x: np.ndarray, y: np.ndarray, fold: int, weights: np.ndarray | None) -> list[tuple[int, np.ndarray]]:
            return [(n, network_loss(layers[n], points[n], x, y, 1.0 / STACK if weights is None else weights[:, c]))
                    for n, (f, c) in enumerate(zip(left_out, columns)) if f is None or f != fold]

        totals = blocks.sums(part, [len(p) + 2 for p in points])
        return {i: [(total[1] / total[0], total[2:] / total[0])] for i, total in zip(order, totals)}

    starts = {}
    for estimator, _ in tasks:
        key = (tuple(estimator.getLayers()), estimator.getSeed())
        starts[key] = starts[key] if key in starts else unmoved(estimator).weights.toArray()
    searches = [quasi_newton(starts[tuple(e.getLayers()), e.getSeed()], e.getMaxIter(), e.getTol(), False) for e, _ in tasks]
    return [unmoved(e, found) for (e, _), found in zip(tasks, side_by_side(searches, evaluate))]


def fitter(estimator: Estimator) -> Callable[[Blocks, list[tuple[Estimator, int | None]]], list[Model]] | None:
    """How models of an estimator's kind are fitted together; none for other kinds and for settings not thought of here."""
    one = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    weighted = any(e.hasParam("weightCol") and e.isSet("weightCol") for e in (one, estimator))
    if type(one) is LinearSVC:
        plain = one.getFitIntercept() and one.getStandardization() and one.getThreshold() == 0
        return fit_machines if plain and not weighted else None
    if type(estimator) is MultilayerPerceptronClassifier:
        return fit_networks if estimator.getSolver() == "l-bfgs" and not estimator.isSet(estimator.initialWeights) else None
    return None
