import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from test_decontam import brute as contaminated
from test_near_dup import brute as near

from mergescope.llm import bpe, toxicity
from mergescope.llm.common import setup
from mergescope.llm.queries import toxic_model


def test_stages_against_brute_force(spark, sf):
    setup(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxic_model(spark, sf)
    if model is not None:
        score = toxicity.Scorer(model)([t for _, t in rows])
        rows = [r for r, s in zip(rows, score) if s < 0.5]
    groups = near(rows)
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    hit = {r[0] for r in contaminated(rows, items, 10) if r[4]}
    rows = [r for r in rows if r[0] not in hit]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-2]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, _ in rows)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == {i for i, _ in rows}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)))
    for r in corpus_pipeline.replace_personal_data(spark, kept, sf).collect():
        ids = plain.encode_ordinary(r.text)
        assert out[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and r.n_chars == len(r.text)


def test_stages_on_odd_rows(spark, sf, docs):
    setup(spark)
    rows = [(1, None), (2, ""), (3, "plain words of a clean text"), (3, "plain words of a clean text"), (None, "x@example.com"), (4, "Plain words of a clean text")]
    table = docs(rows).withColumnRenamed("source", "score").withColumnRenamed("lang", "sig")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, sf)
        assert table.columns == ["doc_id", "text", "sig", "score", "n_chars"]
    got = sorted(((str(r.doc_id), r.text) for r in table.collect()))
    assert {r.score for r in table.collect()} == {"src0"} and {r.sig for r in table.collect()} == {"en"}
    assert [i for i, _ in got] == ["1", "2", "3", "None"] and "@" in got[-1][1] and got[-1][1] != "x@example.com"


def test_texts_that_share_an_id_are_judged_apart(spark, sf, docs):
    setup(spark)
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = [(1, x), (1, y), (2, y + " end"), (None, x + " end"), (None, "some other words in a line"), (None, "some other words in a line"), (None, "")]
    table = docs(rows).withColumnRenamed("lang", "_row").withColumnRenamed("source", "row")
    got = corpus_pipeline.drop_near_duplicates(spark, table, sf).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", x), ("1", y), ("None", "some other words in a line"), ("None", "")])
