import random

import numpy as np

from mergescope.llm import near_dup
from mergescope.llm.common import setup


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * 3 + str(rng.randrange(99))
    return words


def run(docs, rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.groups(docs(rows)).collect()}


def test_against_brute_force(spark, docs):
    setup(spark)
    np.seterr(over="ignore")
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(rng.choice([3, 6, 30, 120]))]
        rows += [" ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 25)))) for _ in range(15)]
    # A chain: each copy is near the one before, the ends are not alike.
    chain = [f"w{i}" for i in range(100)]
    for _ in range(12):
        rows.append(" ".join(chain))
        chain = edited(rng, chain, 2)
    rows += ["", None, "  \n ", "one two", "ONE\ttwo", "x " * 4000, "x " * 4001, "same text here"] + ["same text here"] * 5
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(order[i], t) for i, t in enumerate(rows)]
    assert run(docs, rows) == brute(rows)


def test_large_bucket_in_blocks(spark, docs, monkeypatch):
    setup(spark)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(2)
    base = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([1, 2, 3, 4])))) for i in range(60)]
    assert run(docs, rows) == brute(rows)


def test_blocks_by_weight_and_only_where_components_differ(spark, docs, monkeypatch):
    """Long texts make blocks of their own, and blocks of one component alone are not paired."""
    setup(spark)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "WEIGHT", 300)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([1, 2, 3])))) for i in range(50)]
    assert run(docs, rows) == brute(rows)
    schema = "rep long, slot int, key long, hub long, n long"
    members = spark.createDataFrame([(i, 0, 7, 0, 64) for i in range(64)], schema)
    classes = spark.createDataFrame([(i, bytes(128), 1) for i in range(64)], "rep long, sig binary, n long")
    comp = spark.createDataFrame([(i, 0) for i in range(63)], "id long, component long")
    got = near_dup.mixed_blocks(members, classes, comp).collect()
    odd = {r.block for r in got if r.rep == 63}
    assert all(odd & {r.i, r.j} for r in got) and len({r.rep for r in got}) == 64


def test_one_id_with_different_texts(docs):
    """Texts under one id are judged apart, and each is confirmed on itself."""
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    got = near_dup.groups(docs([(1, x), (1, y), (2, y + " end"), (3, x + " end"), (1, y)])).collect()
    by = {}
    for r in got:
        by.setdefault(r.component, []).append((r.doc_id, r.component_id))
    assert sorted(map(sorted, by.values())) == [[(1, 1), (1, 1), (2, 1)], [(1, 1), (3, 1)]]
    assert len(near_dup.survivors(near_dup.groups(docs([(1, x), (1, y), (2, y)]))).collect()) == 2


def test_empty_table_and_null_id(docs):
    assert run(docs, []) == {}
    got = near_dup.groups(docs([(None, "a b c d e f"), (None, "a b c d e f"), (4, None), (5, "g h"), (None, "G h")])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [
        ("4", 0, "4"), ("5", 1, "5"), ("None", 1, "5"), ("None", 2, "None"), ("None", 2, "None")]
