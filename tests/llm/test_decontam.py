import random
import re

from mergescope.llm import decontam
from mergescope.llm.common import setup


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size):
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(size, len(b))
            if item is None or not n:
                continue
            wins = {tuple(b[s:s + n]) for s in range(len(b) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in wins:
                    hit |= set(range(s, s + n))
                    ids.add(str(item))
        out.append((i, len(w), len(hit), tuple(sorted(ids)), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, rows, items, size=10):
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs(rows), b, size).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got), key=str)


def test_random_small_alphabet_against_brute_force(spark, docs):
    setup(spark)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("aB,é x1") + rng.choice(["", "z"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(7, text(30)), (8, None), (9, ""), (None, text(40))]
    rows += [rows[0]] * 3
    items = [(i, text(rng.randint(0, 9))) for i in range(25)] + [(3, text(9)), (None, "a b"), (99, None), (98, "B"), (97, "x1 a")]
    for size in (4, 10):
        assert run(spark, docs, rows, items, size) == brute(rows, items, size)


def test_empty_tables(spark, docs):
    assert run(spark, docs, [], [(1, "a b c")]) == []
    assert run(spark, docs, [(1, "a b c")], []) == [(1, 3, 0, (), False)]


def test_long_document_and_hot_item(spark, docs):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, ("filler " * 5000) + passage + " end"), (2, passage.upper()), (3, "two three")]
    items = [(i, passage) for i in range(40)]
    assert run(spark, docs, rows, items) == brute(rows, items, 10)
