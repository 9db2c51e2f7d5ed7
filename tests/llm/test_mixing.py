import hashlib
import random
from collections import Counter
from fractions import Fraction

import pytest

from mergescope.llm import mixing
from mergescope.llm.common import setup


def shares(sizes, weights, epochs):
    """Shares by repeated resharing of what is beyond each limit, in whole fractions."""
    got = {s: Fraction(0) for s in sizes}
    rest, free = Fraction(sum(sizes.values())), set(sizes)
    while rest > 0 and free:
        unit = rest / sum(weights[s] for s in free)
        rest = Fraction(0)
        for s in sorted(free, key=str):
            got[s] += unit * weights[s]
            if got[s] > epochs * sizes[s]:
                rest += got[s] - epochs * sizes[s]
                got[s] = Fraction(epochs * sizes[s])
        free = {s for s in free if got[s] < epochs * sizes[s]}
    return got


def brute(rows, epochs=3):
    names = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    size = lambda t: len((t or "").encode().split())
    sizes = {s: sum(size(t) for _, q, t in rows if q == s) for s in names}
    target = shares(sizes, {s: i % 3 + 1 for i, s in enumerate(names)}, epochs)
    out = []
    for s in names:
        key = lambda r: hashlib.md5(f"mix{'' if r[0] is None else r[0]}:{r[2] or ''}".encode()).digest()
        mine = sorted((r for r in rows if r[1] == s), key=key)
        stream = [(i, w) for i, r in enumerate(mine) for w in range(size(r[2]))]
        taken = Counter(stream[x % len(stream)][0] for x in range(int(target[s]))) if stream else {}
        out += [(r[0], size(r[2]), sizes[s], float(target[s]), taken.get(i, 0)) for i, r in enumerate(mine)]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, source string, text string, size int, taken string")
    return [tuple(r) for r in mixing.mix(df, **kw).drop("source").collect()]


def same(got, want):
    order = lambda r: [str(x) for x in (r[0], r[1], r[2], r[4])]
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_random_sources_against_brute_force(spark):
    setup(spark)
    rng = random.Random(3)
    text = lambda: " ".join("ab"[: rng.randint(1, 2)] for _ in range(rng.randint(0, 30)))
    rows = [(i, rng.choice(["a", "a", "a", "b", "ä", "Z", None]), text()) for i in range(300)]
    rows += [(1000, "tiny", "one two three"), (1001, "zero", None), (1002, "zero", " \t\n"), (None, "a", "x y"), (None, None, "x y z")]
    same(run(spark, rows), brute(rows))


def test_resharing_in_several_rounds(spark):
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate([("a", 1), ("b", 3), ("c", 10), ("d", 40), ("e", 200), ("f", 5000)])]
    got = run(spark, rows)
    same(got, brute(rows))
    assert all(taken <= 3 * size for _, size, _, _, taken in got)


def test_taken_words_meet_the_budget_and_reruns_agree(spark):
    rows = [(i, f"s{i % 4}", "w " * (i % 50)) for i in range(400)]
    got = run(spark, rows)
    by = {}
    for _, _, total, target, taken in got:
        words, _ = by.get((total, target), (0, 0))
        by[total, target] = (words + taken, target)
    assert all(words == int(target) for words, target in by.values())
    assert sorted(got) == sorted(run(spark, rows[::-1]))
    assert sorted(got) != sorted(run(spark, rows, seed="other"))


def test_very_many_equal_rows(spark):
    rows = [(7, "a", "one two three")] * 2500 + [(8, "b", "x y"), (9, "c", "z " * 400)]
    same(run(spark, rows), brute(rows))


def test_empty_and_wordless(spark):
    assert run(spark, []) == []
    assert sorted(run(spark, [(1, "a", None), (2, None, "")])) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
