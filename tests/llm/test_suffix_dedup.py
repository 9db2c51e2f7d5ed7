import random
from collections import Counter

import pytest

from mergescope.llm import suffix_dedup
from mergescope.llm.common import setup


def brute(rows, size):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s:s + size] for _, b in texts for s in range(len(b) - size + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if seen[b[s:s + size]] > 1:
                gone[s:s + size] = b"\1" * size
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def run(docs, rows):
    got = suffix_dedup.deduplicate(docs(rows)).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got), key=str)


def test_merge_of_runs():
    rng = random.Random(8)
    for _ in range(200):
        parts = [[bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(1, 9))]
        runs = []
        for strings in parts:
            order, common, tails = suffix_dedup.front_coded(strings)
            assert [strings[i] for i in order] == sorted(strings) and all(strings[i].endswith(t) for i, t in zip(order, tails))
            runs.append((sorted(strings), common))
        merged = suffix_dedup.merge_runs(runs)
        out = [runs[r][0][k] for r, k, _ in merged]
        assert out == sorted(x for p in parts for x in p)
        for x, y, (_, _, common) in zip(out, out[1:], merged[1:]):
            assert x[:common] == y[:common] and (common == min(len(x), len(y)) or x[common] != y[common])


@pytest.mark.parametrize("heavy", [2000, 1])
def test_against_brute_force(spark, docs, monkeypatch, heavy):
    setup(spark)
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 20)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcé 日") for _ in range(n))
    shared = [text(n) for n in (140, 150, 160, 200, 420)]
    rows = [(i, "".join(text(rng.randrange(120)) + (rng.choice(shared) if rng.random() < 0.8 else "") for _ in range(rng.randrange(5)))) for i in range(40)]
    rows += [(50, "x" * 199), (51, "y" * 200), (52, "z" * 201), (53, "ab" * 700), (54, None), (55, ""), (56, "x" * 150)]
    rows += [(3, rows[4][1]), (4, rows[4][1]), (4, rows[4][1]), (None, rows[5][1])]
    assert run(docs, rows) == brute(rows, 200)


def test_no_task_holds_a_passage_in_many_surroundings(spark, docs, monkeypatch):
    setup(spark)
    most, whole = 5, suffix_dedup._merge

    def checked(batches):
        def counted():
            seen = {}
            for b in batches:
                for k in b["key"]:
                    seen[k] = seen.get(k, 0) + 1
                    assert seen[k] <= most, "a key's rows all reach one task"
                yield b
        return whole(counted())

    monkeypatch.setattr(suffix_dedup, "HEAVY", most)
    monkeypatch.setattr(suffix_dedup, "_merge", checked)
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage = text(210)
    rows = [(i, text(250) + passage + text(250)) for i in range(60)]
    assert run(docs, rows) == brute(rows, 200)


def test_passages_are_not_written_and_texts_are_shuffled_once(spark, docs, monkeypatch):
    setup(spark)
    written, whole = {}, suffix_dedup.materialise

    def counted(df, name="table", rows=0):
        out = whole(df, name, rows)
        written[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "materialise", counted)
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage = text(300)
    rows = [(i, text(1500) + (passage if i < 2 else "")) for i in range(20)] + [(None, text(100) + passage)]
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = suffix_dedup.deduplicate(docs(rows))
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found.collect()), key=str)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert got == brute(rows, 200)
    # The shared passage's few rows, and not those of the other passages.
    assert sum(written.values()) < sum(len(suffix_dedup.passages(t.encode())[0]) for _, t in rows) / 4
    assert "ReusedExchange" in plan


def test_null_id_and_zero_with_one_text_are_told_apart(docs):
    rng = random.Random(14)
    text = "".join(rng.choice("abcdefgh") for _ in range(500))
    rows = [(0, text), (None, text), (0, text[:250]), (None, None), (0, None)]
    assert run(docs, rows) == brute(rows, 200)


def test_empty_table(docs):
    assert run(docs, []) == []


def test_equal_windows_pick_one_place_in_long_periodic_text():
    """Past 16 MiB too, windows of one content have their anchor at the same place."""
    _, starts, n, before = suffix_dedup.passages(b"ab" * (17 << 19))
    assert n.max() <= 2 and before.max() <= 1
