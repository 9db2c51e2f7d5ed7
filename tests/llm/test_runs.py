import hashlib
import random
import zlib

import numpy as np

from mergescope.llm import queries, runs


def brute(a):
    """Every stretch of equal words at distance q, by trying every q; equal stretches keep the smallest period."""
    found = {}
    n = len(a)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and a[j] == a[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def check(documents):
    got = runs.find([np.array(d, np.int64) for d in documents])
    for d, rows in zip(documents, got):
        assert [tuple(r) for r in rows.tolist()] == brute(d), d


def test_all_short_binary_documents():
    for n in range(0, 13):
        check([[x >> i & 1 for i in range(n)] for x in range(2 ** n)])


def test_random_documents():
    rng = random.Random(1)
    for size in (1, 2, 3, 30):
        check([[rng.randrange(size) for _ in range(rng.randint(0, 120))] for _ in range(150)])


def test_planted_periods():
    rng = random.Random(2)
    docs = []
    for _ in range(400):
        d = []
        for _ in range(rng.randint(1, 4)):
            d += [rng.randrange(4) for _ in range(rng.randint(0, 9))]
            unit = [rng.randrange(rng.choice([2, 2, 3, 9])) for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.4:
                unit = unit[:rng.randint(1, 5)] * rng.randint(2, 6) + unit
            reach = len(unit) * rng.randint(2, 6) + rng.randrange(len(unit))
            d += (unit * 7)[:reach]
        docs.append(d)
    check(docs)


def test_periodic_units_within_a_run():
    """Units that are themselves nearly periodic make blocks with progressions of occurrences."""
    docs = []
    for d in range(1, 6):
        for inner in range(3, 12):
            for tail in range(0, d + 2):
                unit = (list(range(d)) * inner) + [90 + i for i in range(tail)] + [0]
                docs.append([7] * 3 + (unit * 5)[: len(unit) * 4 + tail] + [8])
    check(docs)


def words_of(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def want(doc_id, text):
    words = words_of(doc_id, text)
    rows, gone = brute(words), set()
    for s, n, q in rows:
        gone |= set(range(s + q, s + n))
    best = min(rows, key=lambda r: (-r[1], r[0], r[2])) if rows else (None, None, None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(rows), *best, 1000 * best[1] // best[2] if rows else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in rows).encode()), digest(kept))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("a é  B c".split(" ")) + rng.choice(["", "\t", "\n x"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(150)]
    rows += [(None, "a a a a a a a"), (3, None), (4, ""), (5, " \x0b"), (6, "z " * 3000), (6, "z " * 3000), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, kept string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.ENTRIES["op11_runs"].run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((want(*r) for r in rows), key=str)
    assert any(r[1] > 0 for r in got.collect())


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = [d for d in docs if len(d.text or "") < 3000]
    got = {r.doc_id: tuple(r) for r in queries.ENTRIES["op11_runs"].run(spark, sf).collect()}
    assert len(got) == len(docs)
    assert all(got[d.doc_id] == want(d.doc_id, d.text) for d in short)


def test_empty_table_and_several_passes(spark, docs, monkeypatch):
    assert runs.collapse(docs([])).collect() == []
    found = list(runs._passes([b"a b c"] * 5, list(range(5)), None))
    assert sum(map(len, found)) == 5
    monkeypatch.setattr(runs, "PASS_WORDS", 6)
    assert [len(p) for p in runs._passes([b"a b c", b"d", None, b"a b", b"x"], list(range(5)), None)] == [4, 1]
