import numpy as np

from mergescope.llm import ann
from mergescope.llm.common import setup


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = [(-float((x[q_i] * x[i]).sum()), ids[i]) for q_i in [ids.index(q)] for i in range(len(ids)) if ids[i] != q]
        out[q] = [(i, -v) for v, i in sorted(s)[:k]]
    return out


def rows_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_exact_scores(spark, sf):
    setup(spark)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    p = table.toPandas()
    ids, x = p.vec_id.tolist(), np.stack(p.embedding).astype(float)
    got = rows_of(ann.search(table, ann.F.col("vec_id") % 20 == 0))
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found in got.items():
        for i, s in found:
            assert abs(s - float((x[ids.index(q)] * x[ids.index(i)]).sum())) < 1e-12


def test_ties_copies_and_bad_vectors(spark, monkeypatch):
    setup(spark)
    monkeypatch.setattr(ann, "ROWS", 16)
    monkeypatch.setattr(ann, "QUERIES", 4)
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=4).round(1).tolist()) for i in range(150)]
    good += [(i, [1.0, 0.0, -1.0, 2.0]) for i in range(200, 260)]
    bad = [(300, None), (320, [0.0] * 4), (340, [1.0, None, 0.0, 0.0]), (360, [float("nan"), 1.0, 0.0, 0.0]), (380, [float("inf")] * 4), (400, [1.0]), (None, [1.0] * 4)]
    good = [g for g in good if any(g[1])]
    t = spark.createDataFrame(good + bad + good[:30], "vec_id long, embedding array<double>").withColumn("rank", ann.F.lit("x"))
    got = rows_of(ann.search(t, ann.F.col("vec_id") % 20 == 0, 5, 1.0))
    ids = [i for i, _ in good]
    want = brute(ids, np.array([v for _, v in good]), [i for i in ids if i % 20 == 0], 5)
    assert set(got) == set(want)
    for q in want:
        assert [round(s, 9) for _, s in got[q]] == [round(s, 9) for _, s in want[q]]
    same = [i for i, _ in got[200] if i >= 200]
    assert same == [201, 202, 203, 204, 205][:len(same)]


def test_more_tied_rows_than_asked_for(spark):
    """Different vectors of equal products: the smallest ids win, in one block and over all."""
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(0, 2, (900, 12)), axis=0).astype(float)
    x = rng.permutation(x[x.any(axis=1)])
    ids = list(range(len(x)))
    want = brute(ids, x, ids[:30], 5)
    who, found, _ = ann._best(x[:30], np.arange(len(x)), x, ~np.eye(30, len(x), dtype=bool), 5)
    assert all(found[who == q].tolist() == [i for i, _ in want[q]] for q in range(30))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = rows_of(ann.search(t, ann.F.col("vec_id") < 30, 5, 1.0))
    assert got == want


def test_few_rows(spark):
    t = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 1.0]), (20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert rows_of(ann.search(t, ann.F.col("vec_id") % 20 == 0)) == {0: [(20, 5.0), (1, 2.5)], 20: [(0, 5.0), (1, 2.5)]}
    assert ann.search(t.where("false"), ann.F.lit(True)).collect() == []
