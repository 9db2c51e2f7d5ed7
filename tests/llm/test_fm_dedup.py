import random

import numpy as np
import pytest

from mergescope.llm import fm_dedup
from mergescope.llm.common import setup


def brute(rows, size):
    parsed = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in parsed:
        for s in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[s:s + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in parsed:
        gone = set()
        for s in range(len(w) - size + 1):
            if i is not None and first[tuple(w[s:s + size])] < i:
                gone |= set(range(s, s + size))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def run(docs, rows):
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in fm_dedup.deduplicate(docs(rows)).collect()), key=str)


def test_index_finds_all_windows():
    rng = np.random.default_rng(0)
    tokens = np.r_[rng.integers(1, 4, 300), 0, rng.integers(1, 4, 300), 0]
    index = fm_dedup.FMIndex(tokens, 6)
    got = {}
    for who, start, group in index.match(tokens, np.array([300, 601]), np.array([300, 300])):
        for w, s, g in zip(who, start, group):
            got[int(w) * 301 + int(s)] = sorted(index.order[index.low[g]:index.high[g]].tolist())
    text = tokens.tolist()
    for at in [*range(295), *range(301, 596)]:
        assert got[at] == [k for k in range(len(text) - 5) if text[k:k + 6] == text[at:at + 6]]


@pytest.mark.parametrize("depth", [1, 2, 6, 20])
def test_foreign_passages_against_brute_force(depth):
    """Passages that the index does not hold, with words it has never seen: every true window is met, and none else."""
    rng = np.random.default_rng(depth)
    for kinds, n in ((2, 300), (4, 300), (30, 600), (1, 50)):
        inside = rng.integers(1, kinds + 1, n)
        tokens = np.r_[inside[:n // 2], 0, inside[n // 2:], 0]
        index = fm_dedup.FMIndex(tokens, depth)
        parts = [rng.integers(1, kinds + 3, 400), np.r_[inside[20:90], kinds + 2, inside[5:200]], inside[:0], inside[n // 3:n // 3 + depth]]
        stream = np.concatenate(parts)
        lengths = np.array([len(p) for p in parts])
        got = {}
        for who, start, group in index.match(stream, np.cumsum(lengths), lengths):
            got.update({(int(w), int(s)): sorted(index.order[index.low[g]:index.high[g]].tolist()) for w, s, g in zip(who, start, group)})
        text = tokens.tolist()
        want = {}
        for w, part in enumerate(parts):
            for s in range(len(part) - depth + 1):
                places = [k for k in range(len(text) - depth + 1) if text[k:k + depth] == part[s:s + depth].tolist()]
                if places:
                    want[w, s] = places
        assert got == want


@pytest.mark.parametrize("heavy", [2000, 1])
def test_against_brute_force(spark, docs, monkeypatch, heavy):
    setup(spark)
    monkeypatch.setattr(fm_dedup, "HEAVY", heavy)
    monkeypatch.setattr(fm_dedup, "SHARD_WORDS", 400)
    rng = random.Random(4)
    word = lambda: rng.choice("abcdeé") + str(rng.randrange(40))
    passages = [[word() for _ in range(rng.choice([49, 50, 51, 60, 130]))] for _ in range(6)]
    rows = []
    for i in range(50):
        w = []
        for _ in range(rng.randrange(5)):
            w += [word() for _ in range(rng.randrange(30))]
            w += rng.choice(passages) if rng.random() < 0.7 else []
        rows.append((i, " \n".join(w)))
    rows += [(60, "x " * 300), (61, "x " * 70), (62, "x " * 200), (63, None), (64, ""), (5, rows[5][1]), (7, rows[5][1]), (None, rows[5][1])]
    rows += [(70, rows[3][1])] * 3
    rng.shuffle(rows)
    assert run(docs, rows) == brute(rows, 50)


def test_no_task_holds_a_passage_in_many_surroundings(spark, docs, monkeypatch):
    setup(spark)
    most, whole = 5, fm_dedup._search

    def checked(batches):
        def counted():
            seen = {}
            for b in batches:
                for k in b["key"]:
                    seen[k] = seen.get(k, 0) + 1
                    assert seen[k] <= most, "a key's rows all reach one task"
                yield b
        return whole(counted())

    monkeypatch.setattr(fm_dedup, "HEAVY", most)
    monkeypatch.setattr(fm_dedup, "_search", checked)
    rng = random.Random(12)
    word = lambda: "w" + str(rng.randrange(10**6))
    passage = [word() for _ in range(55)]
    rows = [(i, " ".join([word() for _ in range(60)] + passage + [word() for _ in range(60)])) for i in range(60)]
    assert run(docs, rows) == brute(rows, 50)


def test_empty_table(docs):
    assert run(docs, []) == []
