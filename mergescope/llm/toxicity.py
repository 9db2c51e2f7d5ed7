"""Toxicity by a support vector machine over a string subsequence kernel with Nyström landmarks.

The kernel compares words by the subsequences of three and four characters they share, each weighted by DECAY per
character it skips and skipping at most GAPS; so ``id.iot`` and ``idddiot`` stay close to ``idiot``, and an inflected
insult to its stem. A word is lower-cased, stripped of outer punctuation and marked at both ends; runs of three or more
single characters count as one word too; words longer than PART characters are read in overlapping parts. The
subsequences are hashed to 2^BITS numbers, and a word's vector is scaled by the root of its summed squared weights.

Only documents carry labels, so their sentences' words are learned as bags: every word of a clean document is negative,
and of each toxic one the word that scores highest now is positive, in ROUNDS of refitting with the
hardest clean words. Landmarks are chosen by
pivoted Cholesky from words that toxic documents favour and from clean ones. The machine is fitted in the Nyström space;
as the kernel is linear in the subsequences, its landmark expansion folds into one weight per subsequence for scoring.
A logistic curve, fitted on labelled documents kept from the machine, turns a document's two highest word scores and its
length into a probability.

Bounds: SAMPLE documents of each label, those with the smallest hash of doc_id, NEGATIVES different words of clean
documents, again by hash, and a POOL of words that landmarks are chosen from. Scoring reads every word of every text. Null and empty texts have no words and get the curve's
value for none; ties and repeated rows score alike; without labels of both kinds the score is 0 for all. An input column
named like the output is replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow

DECAY, GAPS, BITS, PART = 0.6, 2, 22, 24
SAMPLE, NEGATIVES, LANDMARKS, ROUNDS = 2500, 150_000, 384, 5
# Words that landmarks are chosen from: those that most toxic documents have, and clean ones by hash.
POOL = (1500, 500)
# Clean words that join the negatives in a round, because they score highest.
HARD = 5000
# Share of toxic documents whose common word is positive without being the highest of one.
COMMON = 0.05
# Words whose scores a worker remembers.
REMEMBERED = 400_000
_EDGE = "\x02\x03"


def unit(token: str) -> str:
    """A token without outer punctuation, in lower case."""
    t = token.lower()
    if t.isalnum():
        return t
    first, last = 0, len(t)
    while first < last and not t[first].isalnum():
        first += 1
    while last > first and not t[last - 1].isalnum():
        last -= 1
    return t[first:last]


def tokens(text: str | None) -> list[str]:
    """Tokens between white space, and each run of three or more single characters joined."""
    found = (text or "").split()
    single = [i for i, t in enumerate(found) if len(t) == 1]
    runs, start = [], 0
    for k in range(1, len(single) + 1):
        if k == len(single) or single[k] != single[k - 1] + 1:
            if k - start >= 3:
                runs.append("".join(found[single[start]:single[k - 1] + 1]))
            start = k
    return found + runs


def _shapes(length: int) -> list[tuple[tuple[int, ...], float]]:
    """Places of every subsequence of a word of this length, with its weight."""
    out = []
    for size in (3, 4):
        gaps = [()]
        for _ in range(size - 1):
            gaps = [(*g, k) for g in gaps for k in range(GAPS + 1 - sum(g))]
        for g in gaps:
            steps = np.cumsum([0, *[k + 1 for k in g]]).tolist()
            out += [(tuple(s + d for d in steps), DECAY ** sum(g)) for s in range(length - steps[-1])]
    return out


@dataclass
class Shapes:
    known: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)

    def of(self, length: int) -> tuple[np.ndarray, ...]:
        if length not in self.known:
            shapes = _shapes(length)
            places = np.array([[*p, *([length] * (4 - len(p)))] for p, _ in shapes], np.int64).reshape(-1, 4)
            weights = np.array([w for _, w in shapes], np.float32)
            self.known[length] = places, weights, np.sqrt((weights ** 2).sum()) if len(weights) else np.float32(1)
        return self.known[length]


SHAPES = Shapes()


def features(words: list[str]) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """For each length of word: which words, their subsequences' numbers, the weights and the norm."""
    marked = np.array([_EDGE[0] + w + _EDGE[1] for w in words])
    lengths = np.char.str_len(marked)
    for length in np.unique(lengths).tolist():
        who = np.flatnonzero(lengths == length)
        places, weights, norm = SHAPES.of(length)
        if not len(weights):
            continue
        for at in range(0, len(who), 2048):
            some = who[at:at + 2048]
            codes = np.zeros((len(some), length + 1), np.uint64)
            codes[:, :length] = marked[some].astype(f"U{length}").view(np.uint32).reshape(len(some), length)
            h = codes[:, places[:, 0]]
            for k in range(1, 4):
                h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(29)) ^ codes[:, places[:, k]]
            h = h * np.uint64(0xBF58476D1CE4E5B9)
            yield some, (h >> np.uint64(64 - BITS)).astype(np.int64), weights, float(norm)


def parts(word: str) -> list[str]:
    if len(word) <= PART:
        return [word]
    return [word[i:i + PART] for i in range(0, len(word) - PART // 2, PART // 2)]


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float
    curve: np.ndarray

    def dense(self) -> np.ndarray:
        beta = np.zeros(1 << BITS, np.float32)
        beta[self.index] = self.weight
        return beta

    def words(self, words: list[str], beta: np.ndarray) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for some, idx, weights, norm in features(words):
            out[some] += (beta[idx] @ weights) / norm
        return out


def evidence(best: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(best)), np.clip(best, -3, 3), np.clip(second, -3, 3), np.log1p(n)], axis=1)


class Scorer:
    """Scores of documents with one memory of word scores."""

    def __init__(self, model: Model):
        self.model, self.beta, self.known = model, model.dense(), {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        bags = [tokens(t) for t in texts]
        used = set().union(*bags)
        fresh = [t for t in used if t not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {t: self.known[t] for t in used if t in self.known}
        if fresh:
            cut = [parts(unit(t)) for t in fresh]
            ends = np.cumsum([0, *map(len, cut)])
            scores = np.maximum.reduceat(self.model.words([p for c in cut for p in c], self.beta), ends[:-1])
            self.known.update(zip(fresh, scores.tolist()))
        best, second = np.full(len(bags), -3.0), np.full(len(bags), -3.0)
        for i, bag in enumerate(bags):
            if bag:
                s = np.fromiter(map(self.known.__getitem__, bag), np.float64, len(bag))
                best[i] = s.max()
                if len(s) > 1:
                    second[i] = np.partition(s, -2)[-2]
        z = evidence(best, second, np.array([len(b) for b in bags])) @ self.model.curve
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _kernel(words: list[str], lookup: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernel of words with the landmarks whose subsequences ``lookup`` numbers as rows of ``table``."""
    out = np.zeros((len(words), table.shape[1]), np.float32)
    for some, idx, weights, norm in features(words):
        rows = lookup[idx]
        who, col = np.nonzero(rows)
        if not len(who):
            continue
        for at in range(0, len(who), 16_384):
            w, c = who[at:at + 16_384], col[at:at + 16_384]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            at_row, scale = rows[w, c], (weights[c] / norm)[:, None]
            # Some landmarks at a time, as all their weights together are many times the result.
            for k in range(0, table.shape[1], 64):
                part = table[at_row, k:k + 64]
                part *= scale
                out[some[w[first]], k:k + 64] += np.add.reduceat(part, first, axis=0)
    return out


def _landmarks(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the words' subsequences, and a table of their scaled weights per word; row 0 is empty."""
    index, value, owner = [], [], []
    for some, idx, weights, norm in features(words):
        index.append(idx.ravel())
        value.append(np.tile(weights / norm, len(some)))
        owner.append(np.repeat(some, idx.shape[1]))
    index, value, owner = (np.concatenate(x) for x in (index, value, owner))
    ids, row = np.unique(index, return_inverse=True)
    lookup = np.zeros(1 << BITS, np.int32)
    lookup[ids] = np.arange(1, len(ids) + 1)
    table = np.zeros((len(ids) + 1, len(words)), np.float32)
    np.add.at(table, (row + 1, owner), value)
    return lookup, table


def _pivots(gram: np.ndarray, count: int) -> list[int]:
    """Pivoted Cholesky: each time the word that the chosen ones describe worst."""
    left, low, chosen = gram.diagonal().astype(np.float64).copy(), np.zeros((0, len(gram))), []
    for _ in range(min(count, len(gram))):
        p = int(left.argmax())
        if left[p] < 1e-3:
            break
        row = (gram[p] - low[:, p] @ low) / np.sqrt(left[p])
        chosen.append(p)
        low = np.vstack([low, row])
        left -= row ** 2
        left[p] = -1
    return chosen


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    size = x.shape[1] + 1
    w = np.zeros(size)
    reg = np.full(size, ridge * weight.sum())
    reg[-1] *= 1e-3
    for _ in range(30):
        inside = np.flatnonzero(y * (x @ w[:-1].astype(x.dtype) + w[-1]) < 1)
        square, side = np.diag(reg), np.zeros(size)
        for at in range(0, len(inside), 2048):
            some = inside[at:at + 2048]
            a = np.hstack([x[some], np.ones((len(some), 1), x.dtype)]).astype(np.float64)
            square += (a * weight[some][:, None]).T @ a
            side += a.T @ (weight * y)[some]
        new = np.linalg.solve(square, side)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _folded(lookup: np.ndarray, table: np.ndarray, alpha: np.ndarray, bias: float) -> Model:
    """The landmark expansion as one weight per subsequence."""
    # Some rows at a time, as a copy of the whole table in doubles is the driver's peak.
    beta = np.concatenate([np.zeros(0), *(table[i:i + 8192].astype(np.float64) @ alpha for i in range(1, len(table), 8192))])
    return Model(np.flatnonzero(lookup), beta[lookup[lookup > 0] - 1].astype(np.float32), bias, np.eye(4)[1])


def learn(texts: list[str], labels: np.ndarray) -> Model | None:
    """Fit on documents; a quarter of each label, every fourth, is kept for the curve."""
    # One of equal texts, so that copies do not speak for their words.
    once = list({(t, int(y)): None for t, y in zip(texts, labels)})
    texts, labels = [t for t, _ in once], np.array([y for _, y in once], np.int64)
    if not (labels == 1).any() or not (labels == 0).any():
        return None
    turn = np.zeros(len(labels), np.int64)
    for v in (0, 1):
        turn[labels == v] = np.arange((labels == v).sum())
    held = turn % 4 == 3
    if not (held & (labels == 1)).any():
        held[:] = True
    fit = ~held | held.all()
    toxic = labels[fit] == 1
    counts: dict[str, list[int]] = {}
    bags = []
    for i, t in zip(np.flatnonzero(fit), toxic):
        bag = {p for u in tokens(texts[i]) for p in parts(unit(u)) if p}
        for w in bag:
            counts.setdefault(w, [0, 0])[int(t)] += 1
        if t:
            bags.append(sorted(bag))
    n_toxic, n_clean = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    # A word may be a witness if clean documents have it far more seldom; a few wrong labels do no harm.
    may = {w for w, (c, t) in counts.items() if t and (not c or t * n_clean > 10 * c * n_toxic)}
    clean = sorted((w for w, c in counts.items() if c[0] and w not in may), key=lambda w: xxhash.xxh3_64_intdigest(w))[:NEGATIVES]
    names = sorted(may, key=lambda w: (-counts[w][1], w))
    if not names or not clean:
        return None
    pool = names[:POOL[0]] + clean[:POOL[1]]
    # A few columns at a time, as a table holds every subsequence of its words.
    gram = np.hstack([_kernel(pool, *_landmarks(pool[i:i + 128])) for i in range(0, len(pool), 128)])
    marks = [pool[i] for i in _pivots(gram, LANDMARKS)]
    del gram
    lookup, table = _landmarks(marks)
    value, vector = np.linalg.eigh(_kernel(marks, lookup, table).astype(np.float64))
    root = (vector / np.sqrt(np.maximum(value, 1e-4))) @ vector.T
    at = {w: i for i, w in enumerate(names)}
    mine = [[at[w] for w in bag if w in at] for bag in bags]
    common = {at[w]: counts[w][1] for w in names if counts[w][1] >= max(5, COMMON * n_toxic)}
    score = np.array([counts[w][1] for w in names], np.float64)
    del bags, counts, may
    used = np.arange(min(HARD * 3, len(clean)))
    # One array holds the rows of all rounds: the negatives from row ``most`` on, the positives of a round before them.
    most = len(common) + len(mine)
    rows = np.empty((most + min(len(used) + HARD * (ROUNDS - 1), len(clean)), len(marks)), np.float32)

    def place(words: list[str], row: int) -> None:
        np.matmul(_kernel(words, lookup, table), root.astype(np.float32), out=rows[row:row + len(words)])

    place([clean[i] for i in used], most)
    for step in range(ROUNDS):
        # Words that a good part of all toxic documents have are positive in any case.
        chosen = dict(common)
        for bag in mine:
            if bag:
                k = max(bag, key=lambda i: (score[i], -i))
                chosen[k] = chosen.get(k, 0) + 1
        pos = np.array(sorted(chosen))
        mass = np.sqrt([chosen[k] for k in pos])
        place([names[k] for k in pos], most - len(pos))
        x = rows[most - len(pos):most + len(used)]
        y = np.r_[np.ones(len(pos)), -np.ones(len(used))]
        w, bias = _machine(x, y, np.r_[mass / mass.sum(), np.full(len(used), 2 / len(used))] * 1000)
        model = _folded(lookup, table, root @ w, bias)
        beta = model.dense()
        score = model.words(names, beta)
        # The clean words that score highest join the negatives, which the last round needs no more.
        hard = np.setdiff1d(np.argsort(-model.words(clean, beta), kind="stable")[:HARD], used) if step < ROUNDS - 1 else []
        if len(hard):
            place([clean[i] for i in hard], most + len(used))
            used = np.r_[used, hard]
    del rows, x
    kept = np.flatnonzero(held)
    probe = Scorer(model)
    best = []
    for i in kept:
        # The curve's own evidence of each document, before it is known.
        bag = tokens(texts[i])
        s = np.sort(probe.model.words([p for t in bag for p in parts(unit(t))], probe.beta)) if bag else np.zeros(0)
        best.append((s[-1] if len(s) else -3.0, s[-2] if len(s) > 1 else -3.0, len(bag)))
    b = np.array(best)
    model.curve = _logistic(evidence(b[:, 0], b[:, 1], b[:, 2]), (labels[kept] == 1).astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on (doc_id, text) and (doc_id, toxic): at most ``sample`` labels of each value, those with the smallest hash
    of doc_id. The chosen ids are so few that they are broadcast, and no other text moves."""
    parts = [labels.where(F.col("toxic") == value).select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
             for value in (0, 1)]
    chosen = parts[0].unionAll(parts[1])
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").collect()
    rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r.doc_id)), r.doc_id, r.text))
    return learn([r.text for r in rows], np.array([r.toxic for r in rows]))


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the probability that a text is toxic."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    scorer: list[Scorer] = []

    def run(t: pa.Table) -> pa.Table:
        if not scorer:
            scorer.append(Scorer(model))
        keep = t.select([c for c in t.column_names if c != out])
        return keep.append_column(out, pa.array(scorer[0](t.column(text).to_pylist()), pa.float64()))

    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns if c != out]
    return arrow(docs, run, ", ".join([*kept, f"`{out}` double"]))


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
