"""Exact interpolated quantiles of any number of rows, with bounded memory."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECT_ROWS = 1_000_000
SKETCH_ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], direct_rows: int = DIRECT_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of several numeric columns, nulls ignored.

    The built-in exact aggregate keeps all distinct values in one task, so it only serves up to ``direct_rows``
    values. Beyond that the wanted ranks of a column are enclosed by one bounded sketch; the next pass counts the rows
    at and between all the bounds of all columns, and a last one picks from the few rows that lie around the ranks.
    Every pass but the last moves a few rows per task, and their number does not depend on how many ranks are wanted.
    ``df`` is read in each pass, so it should be a written table. Results are exact.
    """
    if not columns:
        return {}
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    if sum(counts.values()) <= direct_rows:
        wanted = F.array(*[F.lit(p) for p in probabilities])
        row = df.agg(*[F.percentile(F.col(c).cast("double"), wanted).alias(c) for c in columns]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probabilities) for c in columns}
    places = {c: [(counts[c] - 1) * p for p in probabilities] for c in columns if counts[c]}
    ranks = {c: sorted({f(place) for place in found for f in (math.floor, math.ceil)}) for c, found in places.items()}
    values = _order_statistics(df, ranks, counts, direct_rows, accuracy)
    result: dict[str, list[float | None]] = {}
    for c in columns:
        result[c] = []
        for place in places.get(c, [None] * len(probabilities)):
            if place is None:
                result[c].append(None)
                continue
            low, high = values[c, math.floor(place)], values[c, math.ceil(place)]
            result[c].append(low + (high - low) * (place - math.floor(place)) if high != low else low)
    return result


def _order_statistics(df, ranks, counts, direct_rows, accuracy):
    """Value at each (column, 0-based rank).

    A column's ``edges`` divide its values into places: 2i + 1 are those equal to edge i, 2i those between the edges
    i - 1 and i. A rank is known once it falls on an edge, and picked once few values lie between the edges around it.
    """
    names = list(ranks)
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    edges = [np.array([])] * len(names)
    tallies = [np.array([counts[c]]) for c in names]
    found: dict[tuple[str, int], float] = {}
    while True:
        picked: dict[tuple[int, int], list[int]] = {}
        large: dict[tuple[int, int], list[int]] = {}
        for i, c in enumerate(names):
            ends = np.cumsum(tallies[i])
            for rank in ranks[c]:
                place = int(np.searchsorted(ends, rank, "right"))
                if place % 2:
                    found[c, rank] = float(edges[i][place // 2])
                    continue
                within = rank - int(ends[place] - tallies[i][place])
                (picked if tallies[i][place] <= direct_rows else large).setdefault((i, place), []).append(within)
        if not large:
            break
        sketches = []
        for (i, place), inside in large.items():
            value, last = F.col(f"c{i}"), max(int(tallies[i][place]) - 1, 1)
            if place // 2 > 0:
                value = F.when(F.col(f"c{i}") > F.lit(float(edges[i][place // 2 - 1])), value)
            if place // 2 < len(edges[i]):
                value = F.when(F.col(f"c{i}") < F.lit(float(edges[i][place // 2])), value)
            around = sorted({min(max(rank / last + margin, 0.0), 1.0) for rank in inside for margin in (-2.0 / accuracy, 2.0 / accuracy)})
            sketches.append(F.percentile_approx(value, around, accuracy).alias(f"s{len(sketches)}"))
        for (i, _), bounds in zip(large, numbers.agg(*sketches).first()):
            edges[i] = np.unique(np.append(edges[i], bounds))
        tallies = _tally(numbers, edges)
    if picked:
        asked = [(i, place, rank) for (i, place), inside in picked.items() for rank in inside]
        starts = [np.cumsum(t) - t for t in tallies]
        for i, place, rank, value in _pick(numbers, edges, asked):
            found[names[i], rank + int(starts[i][place])] = value
    return found


def _place(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, values, "left") + np.searchsorted(edges, values, "right")


def _columns(batch: pa.RecordBatch, edges: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, its values without nulls, their places) of a batch."""
    for i, cuts in enumerate(edges):
        values = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
        yield i, values, _place(values, cuts)


def _tally(numbers: DataFrame, edges: list[np.ndarray]) -> list[np.ndarray]:
    """How many values each place of each column holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(2 * len(cuts) + 1, dtype=np.int64) for cuts in edges]
        for batch in batches:
            for i, _, places in _columns(batch, edges):
                sums[i] += np.bincount(places, minlength=len(sums[i]))
        for i, part in enumerate(sums):
            at = np.flatnonzero(part)
            yield pa.record_batch([pa.array(np.full(len(at), i)), pa.array(at), pa.array(part[at])], ["column", "place", "n"])

    tallies = [np.zeros(2 * len(cuts) + 1, dtype=np.int64) for cuts in edges]
    for row in numbers.mapInArrow(run, "column long, place long, n long").groupBy("column", "place").agg(F.sum("n").alias("n")).collect():
        tallies[row["column"]][row["place"]] = row["n"]
    return tallies


def _pick(numbers: DataFrame, edges: list[np.ndarray], asked: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """(column, place, rank, value) of the asked ranks within their place."""
    wanted = [np.array(sorted({place for j, place, _ in asked if j == i}), dtype=np.int64) for i in range(len(edges))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, values, places in _columns(batch, edges):
                kept = np.isin(places, wanted[i])
                yield pa.record_batch([pa.array(np.full(kept.sum(), i)), pa.array(places[kept]), pa.array(values[kept])], ["column", "place", "value"])

    # Few rows, and no more than one task can sort in any place.
    inside = numbers.mapInArrow(run, "column long, place long, value double").groupBy("column", "place").agg(F.sort_array(F.collect_list("value")).alias("sorted"))
    ranks = numbers.sparkSession.createDataFrame(asked, "column long, place long, rank long")
    rows = inside.join(F.broadcast(ranks), ["column", "place"]).select("column", "place", "rank", F.element_at("sorted", (F.col("rank") + 1).cast("int")).alias("value"))
    return [tuple(row) for row in rows.collect()]
