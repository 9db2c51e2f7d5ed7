"""Byte-level byte-pair encoding and decoding with the tokenizers library over Arrow batches.

The rank file becomes a merge list: every pair of tokens whose bytes join to a token is a merge, in the order of that
token's rank, and a piece that is a token itself is taken whole. Texts enter as bytes mapped to printable characters
(one character per byte), so a token may end inside a character; decoding maps characters back to bytes and joins them
before any UTF-8 is read, which puts split characters together again.

A space between two non-space characters always starts a match, so a text can be cut there without changing its ids.
The cuts give words, and each worker remembers the ids that the library gave for a bounded number of words.

Null text counts as empty and gives no tokens. Repeated rows are encoded each by itself, an empty table gives no rows,
other columns pass through unchanged; a column of the input named like an output column is replaced. A very long text
is cut where the pattern must end a match anyway, so pieces are encoded one after the other with bounded memory.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow

RANKS = "byte_bpe_multi_50k.tiktoken"
# Characters of one call of the library.
CHUNK = 1 << 18
# Words whose ids a worker remembers, and the longest of them.
REMEMBERED, WORD = 600_000, 48
_CUT = re.compile(r"(?<=\S)(?= \S)")
_WIDE = re.compile(r" (?:\s|$|(?<=\s ))")


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 characters for themselves, others from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, following = [], 256
    for byte in range(256):
        out.append(chr(byte if byte in keep else following))
        following += byte not in keep
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    text = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                merges.append((text[token[:i]], text[token[i:]]))
    made = Tokenizer(models.BPE(
        vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=200_000))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
    return made


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    """Bytes of every id, through the reversed byte table of the tokenizer's own vocabulary."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocab = tokenizer(path, public_tokenizers.PATTERN).get_vocab()
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token)
    return out


def pieces(text: str, size: int = CHUNK) -> list[str]:
    """Cut a long text at places where a match of the pattern ends in any case; without such a place it stays whole."""
    out, start = [], 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size)
        if found is None:
            break
        out.append(text[start:found.start()])
        start = found.start()
    return [*out, text[start:]]


def encode_texts(texts: list[str], path: str, pattern: str, offsets: bool = False) -> list[tuple]:
    """(ids, character starts, character ends) of each text; the last two are None without ``offsets``."""
    made = tokenizer(path, pattern)
    run = made.encode_batch if offsets else made.encode_batch_fast
    parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
    ids: list[list] = [[] for _ in texts]
    spans: list[list] = [[] for _ in texts]
    base = [0] * len(texts)
    at = 0
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end][1]) <= CHUNK):
            size += len(parts[end][1])
            end += 1
        for (i, p), e in zip(parts[at:end], run([p for _, p in parts[at:end]], add_special_tokens=False)):
            ids[i].append(np.asarray(e.ids, dtype="<u4"))
            if offsets and e.offsets:
                spans[i].append(np.asarray(e.offsets, dtype=np.int64) + base[i])
            base[i] += len(p)
        at = end
    out = []
    for i in range(len(texts)):
        s = np.concatenate(spans[i]) if spans[i] else np.zeros((0, 2), np.int64)
        out.append((np.concatenate(ids[i]) if ids[i] else np.zeros(0, "<u4"), s[:, 0] if offsets else None, s[:, 1] if offsets else None))
    return out


def cut(text: str) -> list[str]:
    """Words, each with the space before it."""
    if text[:1] == " " or _WIDE.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]]


def encode_words(texts: list[str], path: str, pattern: str, known: dict[str, bytes]) -> list[np.ndarray]:
    """Ids of each text; ``known`` holds the ids of words met before and gets those met now."""
    made = tokenizer(path, pattern)
    cuts = [cut(t) for t in texts]
    used = set().union(*cuts)
    fresh = [w for w in used if w not in known]
    if len(known) + len(fresh) > REMEMBERED:
        kept = {w: known[w] for w in used if w in known}
        known.clear()
        known.update(kept)
    at = 0
    while at < len(fresh):
        end, size = at, 0
        while end < len(fresh) and (end == at or size + len(fresh[end]) <= CHUNK):
            size += len(fresh[end])
            end += 1
        part = fresh[at:end]
        if size > CHUNK:
            known[part[0]] = encode_texts(part, path, pattern)[0][0].tobytes()
        else:
            for w, e in zip(part, made.encode_batch_fast(part, add_special_tokens=False)):
                known[w] = array("I", e.ids).tobytes()
        at = end
    out = [np.frombuffer(b"".join(map(known.__getitem__, c)), dtype="<u4") for c in cuts]
    for w in fresh:
        if len(w) > WORD:
            del known[w]
    return out


def decode_ids(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), kind))


def _without(df: DataFrame, names: list[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns if c not in names]


def encode(df: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN,
           offsets: bool = False) -> DataFrame:
    """Add ``ids`` (array of int) and, if asked for, ``starts`` and ``ends``: the characters each token touches."""
    path = path or public_tokenizers.path(RANKS)
    new = ["ids", "starts", "ends"] if offsets else ["ids"]

    known: dict[str, bytes] = {}

    def run(t: pa.Table) -> pa.Table:
        texts = [x or "" for x in t.column(text).to_pylist()]
        got = encode_texts(texts, path, pattern, True) if offsets else [(x,) for x in encode_words(texts, path, pattern, known)]
        keep = t.select([c for c in t.column_names if c not in new])
        for k, c in enumerate(new):
            keep = keep.append_column(c, _lists([g[k] for g in got], pa.int32()))
        return keep

    return arrow(df, run, ", ".join(_without(df, new) + [f"{c} array<int>" for c in new]))


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``decoded``, the bytes of an array of ids; a null array gives no bytes."""
    path = path or public_tokenizers.path(RANKS)

    def run(t: pa.Table) -> pa.Table:
        table = byte_table(path)
        out = [b"".join([table[i] for i in x or ()]) for x in t.column(ids).to_pylist()]
        keep = t.select([c for c in t.column_names if c != "decoded"])
        return keep.append_column("decoded", pa.array(out, pa.binary()))

    return arrow(df, run, ", ".join(_without(df, ["decoded"]) + ["decoded binary"]))


def encode_digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """The digests of ids and decoded bytes per document, with encoding and decoding in one pass over the batches."""
    path = path or public_tokenizers.path(RANKS)
    known: dict[str, bytes] = {}

    def run(t: pa.Table) -> pa.Table:
        table = byte_table(path)
        counts, first, second = [], [], []
        for ids in encode_words([x or "" for x in t.column("text").to_pylist()], path, public_tokenizers.PATTERN, known):
            counts.append(len(ids))
            first.append(hashlib.sha256(ids.tobytes()).hexdigest())
            second.append(hashlib.sha256(decode_ids(ids, table)).hexdigest())
        return pa.table({"doc_id": t.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
                         "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())})

    return arrow(df.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
