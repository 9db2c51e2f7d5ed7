from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergescope.llm import chat
from mergescope.llm.common import setup


def lines(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, place long, text string, seen string")


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return chat.Model(norm(rng.random(6)), norm(rng.random((6, 6))), norm(rng.random((6, chat.SYMBOLS))))


def test_chunks_give_the_path_of_the_whole(spark, model, monkeypatch):
    setup(spark)
    monkeypatch.setattr(chat, "LINES", 3)
    rng = np.random.default_rng(2)
    rows = [(c, i, ["User: hi", "A: yes?", "", "word " * 30, None][rng.integers(5)], "x") for c in (1, 2, 3) for i in range([1, 4, 6][c - 1])]
    rows += [(None, 0, "Q: a", "x"), (9, 0, "same", "x"), (9, 0, "same", "x")]
    t = lines(spark, rows).drop("seen")
    seen = {}
    for r in chat.observed(t).collect():
        seen.setdefault(r.conv_id, {})[r.number] = r.seen
    got = {}
    for r in chat.decode(t, model).collect():
        got.setdefault(r.conv_id, {})[r.number] = r.state
    assert got.keys() == seen.keys()
    for c, s in seen.items():
        s = [s[i] for i in range(len(s))]

        def score(path):
            return model.start[path[0]] + sum(model.emit[p, o] for p, o in zip(path, s)) + sum(model.move[a, b] for a, b in zip(path, path[1:]))

        path = [got[c][i] for i in range(len(s))]
        assert score(path) >= max(map(score, product(range(6), repeat=len(s)))) - 1e-9


def test_held_out_roles(spark, sf):
    setup(spark)
    conversations = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    made = chat.transcripts(conversations)
    model = chat.learn(chat.known(made))
    held = made.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 == 0)
    want = {(r.conv_id, r.number): r.state for r in chat.observed(held).collect()}
    got = {(r.conv_id, r.number): r.state for r in chat.decode(held.drop("state"), model).collect()}
    assert want.keys() == got.keys()
    assert np.mean([want[k] // 2 == got[k] // 2 for k in want]) > 0.9
    marked = {r.conv_id for r in conversations.where(F.pmod(F.xxhash64("conv_id"), F.lit(4)) < 3).collect()}
    assert np.mean([want[k] == got[k] for k in want if k[0] in marked]) > 0.98
    source = {}
    for r in conversations.collect():
        if r.conv_id in marked:
            source.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    turns = {}
    for r in chat.turns(held.drop("state"), model).collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
        assert r.rendered == f"<|{r.role}|>\n{r.text}\n<|end|>"
    same = [sorted(turns[c]) == sorted((t, r, x.strip("\n")) for t, r, x in source[c]) for c in turns if c in source]
    assert np.mean(same) > 0.95


def test_empty_table(spark, model):
    assert chat.turns(lines(spark, []).drop("seen"), model).collect() == []
