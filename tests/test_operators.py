"""Operators against brute force on small fixtures, including the ways taken only by large inputs."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergescope.operators import balance, evaluate, prep
from mergescope.operators.hashing import slice_by_hash
from mergescope.operators.joins import lookup_join
from mergescope.operators import neighbours
from mergescope.operators.neighbours import nearest
from mergescope.operators.ordered import dense_ranks, running_totals
from mergescope.operators.quantiles import exact_quantiles


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_quantiles_narrow_to_the_exact_value(spark, limit):
    rng = random.Random(1)
    a = [rng.expovariate(1) ** 4 for _ in range(3000)]
    b = [7.0] * 1000 + [8.0] * 1100 + [float(rng.randrange(50)) for _ in range(900)]
    data = [(x, y if i % 5 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(data, "a double, b double").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9999, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs, direct_rows=limit, accuracy=50 if limit == 10 else 10_000)
    kept = [y for _, y in data if y is not None]
    assert got["a"] == pytest.approx(list(np.quantile(a, probs)), rel=1e-12)
    assert got["b"] == pytest.approx(list(np.quantile(kept, probs)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.0]}


def test_lookup_join_keeps_every_row(spark):
    left = spark.createDataFrame([(0 if i % 3 else i % 40, i) for i in range(600)], "k int, v int")
    right = spark.createDataFrame([(k, f"n{k}") for k in range(0, 40, 2)], "k int, name string")
    want = sorted((0 if i % 3 else i % 40, i) for i in range(600))
    want = [(k, v, f"n{k}" if k % 2 == 0 else None) for k, v in want]
    got = lookup_join(left, right, ["k"])
    assert sorted(map(tuple, got.select("k", "v", "name").collect()), key=str) == sorted(want, key=str)
    inner = lookup_join(left, right, ["k"], how="inner")
    assert inner.count() == sum(name is not None for *_, name in want)


def test_running_totals_cross_ranges(spark):
    data = [(g, i, (i * 7) % 5) for g in "ab" for i in range(200 if g == "a" else 3)]
    df = spark.createDataFrame(data, "g string, i int, n long")
    got = rows(running_totals(df, ["i"], {"t": "n"}, ["g"], descending=True, partitions=5), "g", "i", "t")
    want = sorted((g, i, sum(n for h, j, n in data if h == g and j >= i)) for g, i, _ in data)
    assert got == want


def test_dense_ranks_beyond_one_task(spark):
    words = sorted({f"w{(i * 37) % 101:03d}" for i in range(101)})
    df = spark.createDataFrame([("c", w) for w in reversed(words)], "column string, value string")
    assert rows(dense_ranks(df, "value", ["column"], "code", max_rows=5), "value", "code") == [(w, i) for i, w in enumerate(words)]


@pytest.mark.parametrize("bits", [1, 16])
def test_slices_have_exact_sizes(spark, bits):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(300)], "id long, c string")
    cuts = [F.floor(F.col("n") * q) for q in (0.1, 0.5)]
    got = slice_by_hash(df, "id", "c", cuts, bits=bits).groupBy("c", "slice").count()
    assert rows(got, "c", "slice", "count") == [("cold", 0, 10), ("cold", 1, 40), ("cold", 2, 50), ("hot", 0, 20), ("hot", 1, 80), ("hot", 2, 100)]


def nearest_by_force(points, labels, k):
    out = {}
    for i in range(len(points)):
        gaps = np.round(np.sqrt(((points - points[i]) ** 2).sum(axis=1)), 9)
        order = [j for j in np.lexsort((np.arange(len(points)), gaps)) if j != i and labels[j] == labels[i]][:k]
        out[i] = [(r + 1, int(j), float(gaps[j])) for r, j in enumerate(order)]
    return out


def nearest_found(df, k, block, **kw):
    found = {}
    for r in nearest(df, k, "id", "vec", "label", block_rows=block, **kw).collect():
        found.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    return {i: sorted(v) for i, v in found.items()}


def vectors(spark, points, labels):
    return spark.createDataFrame([(i, labels[i], p.tolist()) for i, p in enumerate(points)], "id long, label string, vec array<double>")


@pytest.mark.parametrize("block,step", [(2048, 1), (30, 7), (3, 1)])
def test_neighbours_equal_brute_force(spark, block, step):
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(size=(90, 3)) * np.array([1, 5, 0.1]), 3)
    points[10] = points[11]
    points[60:75] = points[60]
    labels = ["a" if i < 70 else "b" for i in range(88)] + ["lone", "lone"]
    df = vectors(spark, points, labels)
    none = spark.createDataFrame([(500, "a", None)], df.schema)
    some = df.where(F.col("id") % step == 0) if step > 1 else None
    want = {i: v for i, v in nearest_by_force(points, labels, 4).items() if i % step == 0}
    assert nearest_found(df.unionByName(none), 4, block, queries=some) == want


def test_neighbours_of_no_rows_and_equal_rows(spark):
    empty = spark.createDataFrame([], "id long, label string, vec array<double>")
    assert nearest_found(empty, 3, 5) == {}
    same = np.ones((40, 2))
    assert nearest_found(vectors(spark, same, ["a"] * 40), 3, 4) == nearest_by_force(same, ["a"] * 40, 3)


def test_rows_go_to_few_cells(spark):
    """A class of very many blocks: most cells are out of a row's reach, and the answers are those of all pairs."""
    rng = np.random.default_rng(8)
    points = np.round(rng.normal(size=(40, 6))[rng.integers(0, 40, 3000)] * 10 + rng.normal(size=(3000, 6)) * 0.3, 4)
    labels = ["a"] * 3000
    df = vectors(spark, points, labels)
    placed, depth = neighbours.place(df, 32)
    cells = neighbours.boxes(placed, 6, 32)
    sizes = [r["n"] for r in cells.collect()]
    assert len(sizes) > 90 and max(sizes) <= 32 and sum(sizes) == 3000
    want = nearest_by_force(points, labels, 4)
    asked = placed.join(spark.createDataFrame([(i, v[-1][2]) for i, v in want.items()], "id long, radius double"), "id")
    bounds = asked.groupBy("label", "cell").agg(F.max("radius").alias("radius"))
    pairs = neighbours.cell_pairs(cells, bounds, 6, depth)
    assert neighbours.route(asked, pairs, 6).count() / 3000 < len(sizes) / 20
    assert nearest_found(df, 4, 32) == want


def test_smote_properties(spark):
    rng = np.random.default_rng(5)
    data = [(i, i % 4 == 0, rng.normal(size=2).tolist()) for i in range(60)]
    df = spark.createDataFrame(data, "id long, label boolean, vec array<double>")
    got = balance.smote(df, "id", "label", "vec", k=3).collect()
    counts = {flag: sum(r["label"] == flag for r in got) for flag in (True, False)}
    assert counts == {True: 45, False: 45}
    by_id = {i: v for i, _, v in data}
    for r in got:
        if r["base_id"] is not None:
            a, b = np.array(by_id[r["base_id"]]), np.array(by_id[r["neighbour_id"]])
            gap = (np.array(r["vec"]) - a) / (b - a)
            assert np.allclose(gap, gap[0]) and 0 <= gap[0] < 1
    with pytest.raises(ValueError):
        balance.smote(df.where(~F.col("label") | (F.col("id") == 0)), "id", "label", "vec")


def test_oversampling_evens_classes(spark):
    df = spark.createDataFrame([(i, i % 7 == 0) for i in range(100)], "id long, c boolean")
    got = balance.random_oversample(df, "id", "c")
    assert rows(balance.class_distribution(got, "c"), "c", "n") == [(False, 85), (True, 85)]
    assert got.where("copy = 0").count() == 100
    under = balance.random_undersample(df, "id", "c")
    assert rows(balance.class_distribution(under, "c"), "c", "n") == [(False, 15), (True, 15)]


def test_scaling_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (4.0, 5.0, None)], "a double, flat double, none double")
    scaled = prep.fit_standard(df, ["a", "flat"]).transform(df)
    got = scaled.agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"), F.max(F.abs("flat")).alias("f")).first()
    assert got["m"] == pytest.approx(0) and got["s"] == pytest.approx(1) and got["f"] == 0
    robust = prep.fit_robust(df, ["a", "flat"]).transform(df).select("a", "flat").collect()
    assert [r["a"] for r in robust] == pytest.approx([-1 / 1.5, 0, 2 / 1.5]) and [r["flat"] for r in robust] == [0, 0, 0]
    assert prep.drop_empty_columns(df).columns == ["a", "flat"]


def test_modes_and_fills(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, "b"), (None, "a")], "x int, y string")
    assert prep.modes(df, ["x", "y"]) == {"x": 1, "y": "a"}
    assert prep.medians(df, ["x"]) == {"x": median([1, 1, 2, 2])}


def test_auc_of_ties_and_perfect_order(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.1)], "y int, s double")
    steps = evaluate.score_steps(df, F.col("y") == 1, F.col("s"))
    assert evaluate.roc_auc(steps).first()["roc_auc"] == pytest.approx(0.875)
    flat = evaluate.score_steps(df.withColumn("s", F.lit(0.5)), F.col("y") == 1, F.col("s"))
    assert evaluate.roc_auc(flat).first()["roc_auc"] == pytest.approx(0.5)


def test_confusion_of_a_class_never_true(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "y int, prediction int")
    cells = {(r["y"], r["prediction"]): r["n"] for r in evaluate.confusion(df).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 3 and cells[2, 2] == 0
    report = {r["class"]: r for r in evaluate.class_report(df).collect()}
    assert report[2]["recall"] == 1.0 and report[2]["precision"] == 0.0 and report[2]["support"] == 0


def test_anova_of_a_constant_feature_comes_last(spark):
    df = spark.createDataFrame([(0, 1.0, 3.0), (0, 2.0, 3.0), (1, 5.0, 3.0), (1, 6.5, 3.0)], "y int, a double, flat double")
    best = prep.top_features(prep.anova_f(df, ["flat", "a"], "y"), None).collect()
    assert [r["feature"] for r in best] == ["a", "flat"] and best[1]["f_score"] is None


def test_grown_and_cut_rows_all_have_a_key_and_a_fold(spark):
    from mergescope.plans.modelling import with_folds

    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, i % 5 == 0, rng.normal(size=2).tolist()) for i in range(80)], "id long, label boolean, vec array<double>")
    even = balance.over_then_under(df, "id", "label", "vec", k=3)
    assert rows(balance.class_distribution(even, "label"), "label", "n") == [(False, 64), (True, 64)]
    assert even.select("key").distinct().count() == 128 and even.where("key is null").count() == 0
    folds = with_folds(even.select(F.col("key").alias("id"), "label"), "id", "label", 4)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [32, 32, 32, 32]


def test_many_quantiles_cost_no_more_passes(spark):
    """However many ranks are wanted, a column has one sketch and all columns share three passes after the count."""
    df = spark.range(0, 4000, 1, 3).select(
        (F.col("id") * 7919 % 4001).cast("double").alias("a"), F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("id") % 5).alias("b"),
        F.when(F.col("id") % 2 == 0, -F.col("id")).cast("double").alias("c"), F.lit(None).cast("double").alias("none"))
    probs = [i / 32 for i in range(1, 32)]
    sc = spark.sparkContext
    sc.setJobGroup("quantiles", "")
    try:
        got = exact_quantiles(df, ["a", "b", "c", "none"], probs, direct_rows=600, accuracy=100)
        jobs = len(sc.statusTracker().getJobIdsForGroup("quantiles"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    table = df.toPandas()
    assert got["a"] == pytest.approx(list(np.quantile(table["a"], probs)), rel=1e-12)
    assert got["c"] == pytest.approx(list(np.quantile(table["c"].dropna(), probs)), rel=1e-12)
    nan = sorted(float(v) for v in table["b"].dropna()) + [float("nan")] * int(table["b"].isna().sum())
    assert [repr(v) for v in got["b"]][:20] == [repr(float(np.interp(p * 3999, range(4000), nan))) for p in probs][:20] and np.isnan(got["b"][-1])
    assert got["none"] == [None] * 31 and jobs <= 16


def test_chi_square_counts_its_rows_once(spark):
    scores = prep.chi_square(spark.range(8).selectExpr("id % 2 v", "id % 2 y"), ["v"], "y")
    assert scores.inputFiles() and rows(scores, "feature", "statistic", "degrees") == [("v", 8.0, 1)]


def test_coding_leaves_the_rows_of_a_hot_value_where_they_are(spark, monkeypatch):
    """Codes are ranks whatever a value's frequency, and no task gets all the rows of a hot value or of null."""
    monkeypatch.setattr(prep, "COMMON_VALUES", 16)
    rows = [(i, "hot" if i % 2 else f"v{i % 97}x" if i % 8 else None, i % 3 == 0, f"w{i % 50}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, a string, b boolean, c string").repartition(8, "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded = prep.category_codes(df, ["a", "b", "c"])
        got = coded.collect()
        dealt = prep.category_codes(df, ["a", "b"]).withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert coded.columns == df.columns
    ranks = [{v: n for n, v in enumerate(sorted({r[k] for r in rows} - {None}))} | {None: -1} for k in (1, 2, 3)]
    assert sorted((r.id, r.a, r.b, r.c) for r in got) == [(i, ranks[0][a], ranks[1][b], ranks[2][c]) for i, a, b, c in rows]
    for value in ("hot", None):
        places = [r["at"] for r in dealt if r.a == ranks[0][value]]
        assert max(places.count(p) for p in set(places)) < len(places) / 3


def test_standardise_takes_medians_of_columns_with_nulls_only(spark, monkeypatch):
    from mergescope.plans import cleaning

    asked, medians = [], prep.medians
    monkeypatch.setattr(prep, "medians", lambda df, columns: asked.append(list(columns)) or medians(df, columns))
    df = spark.createDataFrame([(1.0, 4.0, "b"), (3.0, None, "a"), (5.0, 8.0, None)], "x double, y double, z string")
    got = sorted((round(r.x, 4), round(r.y, 4), r.z) for r in cleaning.standardise(df, []).collect())
    assert got == [(-1.2247, -1.2247, 1), (0.0, 0.0, 0), (1.2247, 1.2247, 2)]
    cleaning.standardise(df.select("x", "z"), [])
    assert asked == [["y"], []]
