import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from mergescope.llm import lexical
from mergescope.llm.common import setup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(LOWER))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for i, bag, length in bags:
            m = 100 - 90 + 90 * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if bag[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, rows, items, **kw):
    setup(spark)
    b = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, term string")
    got = lexical.search(lexical.build(docs(rows)), b, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    """Small blocks, shards and windows, so that small tables have many of each."""
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "SHARD_TERMS", 700)
    monkeypatch.setattr(lexical, "WINDOW", 8)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 3)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "ß", "A1", "a1", "x-y", "don't"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(25)] + [(5, text(9)), (None, text(20)), (2000, None), (2001, "... !"), (2002, "w1 " * 900)]
    items = [(i, text(rng.randint(1, 12))) for i in range(20)] + [(3, "w1 w2"), (4, None), (5, ""), (None, "w3 w59"), (6, "nowhere"), (7, "ünï A1 a1"), (7, "ünï A1 a1")]
    return rows, items


@pytest.mark.parametrize("seed", [1, 2])
def test_small_blocks_against_brute_force(spark, docs, small, seed):
    rows, items = corpus(seed)
    assert run(spark, docs, rows, items) == brute(rows, items)


def test_default_sizes_against_brute_force(spark, docs):
    rows, items = corpus(3, 900)
    assert run(spark, docs, rows, items) == brute(rows, items)
    assert run(spark, docs, rows, items, k=3) == brute(rows, items, 3)


def test_blocks_are_rejected_before_they_are_decompressed(small):
    """A common term's blocks stay packed where a rare term decides."""
    shard = lexical.Shard()
    rng = random.Random(4)
    for i in range(400):
        shard.add(i, [b"common"] + [b"f%d" % rng.randrange(50)] * 3 + [b"rare"] * (30 if i in (3, 11, 200) else 0))
    table = shard.pack(0)
    rows = {r["term"]: r for r in table.to_pylist()}
    stats = (400, shard.total)
    scale = lexical.norm(np.array(shard.lengths), stats)
    common, rare = (lexical.Postings(rows[t], scale, stats) for t in ("common", "rare"))
    docs, scores = lexical.best([(common, 1), (rare, 5000)], 400, np.arange(400), 2)
    assert set(docs.tolist()) < {3, 11, 200}
    assert common.done.sum() < len(common.done) / 2
    assert (np.diff(scores) <= 0).all()


def test_postings_survive_packing(monkeypatch):
    """Steps and frequencies of one, two and four bytes."""
    monkeypatch.setattr(lexical, "BLOCK", 4)
    shard = lexical.Shard()
    want = {}
    for i in range(70_000):
        tf = {0: 1, 7: 300, 69_999: 70_000}.get(i, 2 if i % 20_000 == 3 else 0)
        shard.add(i, [b"a"] * tf + [b"pad"])
        if tf:
            want[i] = tf
    rows = {r["term"]: r for r in shard.pack(5).to_pylist()}
    stats = (70_000, shard.total)
    p = lexical.Postings(rows["a"], lexical.norm(np.array(shard.lengths), stats), stats)
    p.load(np.arange(len(p.lasts)))
    assert p.docs.tolist() == list(want) and p.df == len(want)
    assert p.impacts.tolist() == lexical.impact(np.array(list(want.values())), p.scale[p.docs]).tolist()
    assert (np.repeat(p.maxima, p.counts) >= p.impacts).all() and p.bound == p.impacts.max()


def test_empty_tables(spark, docs):
    assert run(spark, docs, [], [(1, "a")]) == []
    assert run(spark, docs, [(1, "a")], []) == []
    assert run(spark, docs, [(1, None)], [(1, "a")]) == []
