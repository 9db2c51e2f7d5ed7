import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from mergescope.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_equals_tiktoken_on_odd_texts():
    rng = random.Random(3)
    pool = "aaaabbcc  \n\t's'tll.,!?éüß日本語한국어😀👍🏽‍\x85  \x1c\x00١٢½Ⅷ"
    texts = ["", " ", "  a", "a  ", "a \n b", "<|endoftext|>"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    got = bpe.encode_words(texts, PATH, public_tokenizers.PATTERN, {})
    assert [g.tolist() for g in got] == [PLAIN.encode_ordinary(t) for t in texts]


def test_long_texts_and_a_small_memory(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    texts = ["word " * 100 + "x" * 300, "é" * 200 + " tail  end", "same same same"] * 2
    known = {}
    for part in (texts[:3], texts[3:]):
        got = bpe.encode_words(part, PATH, public_tokenizers.PATTERN, known)
        assert [g.tolist() for g in got] == [PLAIN.encode_ordinary(t) for t in part]


def test_operator_offsets_and_round_trip(docs):
    rows = [(1, "Der Fluß 😀 läuft."), (2, None), (3, ""), (3, ""), (4, "a " * 5000)]
    table = docs(rows).withColumnRenamed("n_chars", "ids")
    out = bpe.decode(bpe.encode(table, offsets=True)).collect()
    assert len(out) == 5
    for r in out:
        assert bytes(r.decoded).decode() == (r.text or "")
        assert len(r.ids) == len(r.starts) == len(r.ends) and r.lang == "en"
        covered = {i for s, e in zip(r.starts, r.ends) for i in range(s, e)}
        assert covered == set(range(len(r.text or "")))


def test_query_digests(spark, sf):
    from mergescope.llm.queries import ENTRIES

    out = {r.doc_id: r for r in ENTRIES["op6_byte_bpe"].run(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = PLAIN.encode_ordinary(d.text)
        r = out.pop(d.doc_id)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
    assert not out


def test_empty_table(docs):
    assert bpe.encode_digests(docs([])).collect() == []
