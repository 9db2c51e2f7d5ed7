import random
import tracemalloc

import numpy as np
import pytest

from mergescope.llm import toxicity
from mergescope.llm.common import setup


def corpus(rng, n):
    syllables = ["an", "er", "the", "on", "re", "ing", "ou", "ti", "st", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(1, 3) if toxic else 0):
            bad = rng.choice(["grumpf", "zlotnik", "murkel"]) + rng.choice(["", "s", "er", "!"])
            words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    np.seterr(over="ignore")
    rows = corpus(random.Random(1), 500)
    return toxicity.learn([t for _, t, _ in rows], np.array([y for _, _, y in rows]))


def test_held_out_accuracy_and_gaps(model):
    rows = corpus(random.Random(2), 300)
    p = toxicity.Scorer(model)([t for _, t, _ in rows])
    y = np.array([y for _, _, y in rows])
    assert ((p >= 0.5) == y).mean() > 0.97
    bad = toxicity.Scorer(model)(["the on gruumpf anon ere", "the on zzlotnikk anon ere", "the m u r k e l anon ere", "GRUMPF***", "on the sting " + "an" * 400])
    assert bad.tolist()[0] > 0.5 and bad[1] > 0.5 and bad[2] > 0.5 and bad[3] > 0.5 and bad[4] < 0.5


def test_fit_holds_its_rows_once(monkeypatch):
    rng = random.Random(4)
    rows = [(f"murkel{i % 7} " * (i % 3 == 0) + " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(60)), int(i % 3 == 0)) for i in range(900)]
    made = []
    step = toxicity._machine
    monkeypatch.setattr(toxicity, "_machine", lambda x, *rest: made.append(x.nbytes) or step(x, *rest))
    tracemalloc.start()
    toxicity.learn([t for t, _ in rows], np.array([y for _, y in rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == toxicity.ROUNDS and max(made) > 20e6
    assert peak < max(made) + 120e6


def test_folded_weights_equal_the_landmark_kernel():
    words = ["idiot", "id.iot", "clown", "the", "ab"]
    marks = ["idiot", "clowns", "other"]
    lookup, table = toxicity._landmarks(marks)
    k = toxicity._kernel(words, lookup, table)
    for a, w in enumerate(words):
        for b, m in enumerate(marks):
            assert abs(k[a, b] - kernel(w, m)) < 1e-5
    folded = toxicity._folded(lookup, table, np.array([0.5, -1.0, 2.0]), 0.25)
    assert np.allclose(folded.words(words, folded.dense()), k @ [0.5, -1, 2] + 0.25, atol=1e-5)


def kernel(x, y):
    """By enumeration of subsequences."""
    from itertools import combinations

    def bag(s):
        s = "\x02" + s + "\x03"
        out, norm = {}, 0.0
        for size in (3, 4):
            for at in combinations(range(len(s)), size):
                gaps = at[-1] - at[0] - size + 1
                if gaps <= toxicity.GAPS:
                    key = "".join(s[i] for i in at)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** gaps
                    norm += toxicity.DECAY ** (2 * gaps)
        return {k: v / norm ** 0.5 for k, v in out.items()}

    a, b = bag(x), bag(y)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_operator_on_odd_rows(spark, docs, model):
    setup(spark)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "the grumpf on"), (4, "the grumpf on"), (5, "the on " * 20_000), (6, "x" * 5000), (None, "murkel")]
    out = toxicity.score(docs(rows).withColumnRenamed("n_chars", "score"), model).collect()
    got = {r.doc_id: r.score for r in out}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert got[1] == got[2] == got[3] < 0.5 < got[4] and got[5] < 0.5 < got[None]
    assert toxicity.score(docs([]), model).collect() == []


def test_fit_reads_bounded_rows_and_needs_both_labels(spark):
    rows = [(i, "the on ing", 0) for i in range(20)]
    t = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert toxicity.fit(t, t, 5) is None
    both = t.unionAll(t.select(t.doc_id + 100, toxicity.F.lit("the grumpf on"), toxicity.F.lit(1)))
    assert toxicity.fit(both, both, 5) is not None
    assert toxicity.score(t, None).first().score == 0.0
