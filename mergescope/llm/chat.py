"""Transcripts to role-marked turns by a hidden Markov model over lines.

A transcript is lines of text without known speakers. Hidden states are a role and whether the line begins a turn;
what is seen of a line is its speaker marker, whether the line before is empty, whether it ends with a question mark and
its length. Start, transition and emission probabilities are counted, with one added to each, from turns whose roles are
known. Viterbi finds the likeliest states; among equal ones those with the smaller number win, judged from the end.

A long transcript is cut into chunks of LINES lines. Each chunk gives the best score from every state before it to every
state at its end, a table of 36 numbers; a pass over these tables fixes the states at the cuts, and every chunk then
finds its own path between them. So no task holds more than a chunk, and the path is the one of the whole transcript.

Turns are rendered as ``<|role|>`` line, text, ``<|end|>``, without marker and outer empty lines. Null text is an empty
line, a null conv_id names one transcript of its own, an unknown role teaches nothing. Lines that tie in order are taken
by their text; repeated rows are lines of their own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import by_group

ROLES = ["system", "user", "assistant"]
STATES = 2 * len(ROLES)
LINES = 512
# Words that name a speaker at the start of a line, by the role they hint at.
SPEAKERS = {"system": ["system", "instruction"], "user": ["user", "human", "question", "q"], "assistant": ["assistant", "ai", "bot", "answer", "a"]}
MARKER = r"^\s*(?:#+ ?|\*\*|<\|)?(?i:(" + "|".join(w for ws in SPEAKERS.values() for w in ws) + r"))(?:\|>|\*\*)?\s*[:>]\s?"
SYMBOLS = 4 * 3 * 2 * 4


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def marker(text: Column) -> Column:
    word = F.lower(F.regexp_extract(text, MARKER, 1))
    known = [F.when(word.isin(ws), i + 1) for i, ws in enumerate(SPEAKERS.values())]
    return F.coalesce(*known, F.lit(0))


def observed(lines: DataFrame) -> DataFrame:
    """Add ``number`` and ``seen`` to lines (conv_id, place, text, ...); the order is place, then text."""
    w = Window.partitionBy("conv_id").orderBy("place", "text")
    before = F.lag("text").over(w)
    text = F.coalesce("text", F.lit(""))
    gap = F.when(before.isNull(), 0).when(F.trim(before) == "", 1).otherwise(2)
    size = F.length(text)
    length = F.when(size == 0, 0).when(size < 80, 1).when(size < 240, 2).otherwise(3)
    asks = F.when(F.rtrim(text).endswith("?"), 1).otherwise(0)
    return lines.withColumn("text", text).withColumn("gap", gap).withColumn("number", F.row_number().over(w) - 1).withColumn(
        "seen", ((marker(F.col("text")) * 3 + F.col("gap")) * 2 + asks) * 4 + length).drop("gap")


def learn(labelled: DataFrame) -> Model:
    """Counts of (conv_id, place, text, state); the tables have as many rows as there are states and symbols."""
    seen = observed(labelled.where("state is not null"))
    last = F.lag("state").over(Window.partitionBy("conv_id").orderBy("number"))
    counts = seen.withColumn("last", F.coalesce(last, F.lit(-1))).groupBy("last", "state", "seen").count().collect()
    start, move, emit = np.ones(STATES), np.ones((STATES, STATES)), np.ones((STATES, SYMBOLS))
    for r in counts:
        emit[r.state, r.seen] += r["count"]
        if r["last"] < 0:
            start[r.state] += r["count"]
        else:
            move[r["last"], r.state] += r["count"]
    return Model(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), np.log(emit / emit.sum(axis=1, keepdims=True)))


def step(model: Model, scores: np.ndarray, seen: int) -> tuple[np.ndarray, np.ndarray]:
    """Best scores after one more line, and the states they come from; the last axis is the state."""
    ways = scores[..., :, None] + model.move
    back = ways.argmax(axis=-2)
    return np.take_along_axis(ways, back[..., None, :], axis=-2)[..., 0, :] + model.emit[:, seen], back


def _table(model: Model):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        seen = part["seen"].to_numpy()
        if part["chunk"].iat[0] == 0:
            scores = np.tile(model.start + model.emit[:, seen[0]], (STATES, 1))
        else:
            scores, _ = step(model, np.where(np.eye(STATES) > 0, 0.0, -np.inf), seen[0])
        for s in seen[1:]:
            scores, _ = step(model, scores, s)
        return pd.DataFrame({"key": part["key"].iloc[:1], "chunk": part["chunk"].iloc[:1], "table": [scores.ravel().tolist()]})

    return run


def _cuts(part: pd.DataFrame) -> pd.DataFrame:
    """States at the ends of a transcript's chunks."""
    best, backs = None, []
    for t in part["table"]:
        t = np.asarray(t).reshape(STATES, STATES)
        ways = t if best is None else best[:, None] + t
        back = ways.argmax(axis=0)
        backs.append(back)
        best = ways[back, np.arange(STATES)]
    ends = [int(best.argmax())]
    for back in backs[:0:-1]:
        ends.append(int(back[ends[-1]]))
    ends = ends[::-1]
    return pd.DataFrame({"key": part["key"].to_numpy(), "chunk": part["chunk"].to_numpy(), "before": [-1, *ends[:-1]], "after": ends})


def _path(model: Model):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        seen, before = part["seen"].to_numpy(), int(part["before"].iat[0])
        if before < 0:
            scores, backs = model.start + model.emit[:, seen[0]], []
        else:
            scores = np.full(STATES, -np.inf)
            scores[before] = 0.0
            scores, _ = step(model, scores, seen[0])
            backs = []
        for s in seen[1:]:
            scores, back = step(model, scores, s)
            backs.append(back)
        states = [int(part["after"].iat[0])]
        for back in backs[::-1]:
            states.append(int(back[states[-1]]))
        return pd.DataFrame({"key": part["key"], "number": part["number"], "state": states[::-1]})

    return run


def decode(lines: DataFrame, model: Model) -> DataFrame:
    """Lines (conv_id, place, text) with ``number`` and the Viterbi ``state``."""
    seen = observed(lines).withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    seen = seen.withColumn("chunk", F.floor(F.col("number") / LINES).cast("long"))
    seen = materialise(seen.select("conv_id", "key", "chunk", "number", "seen", "text"), "lines")
    # Ordered by number within a chunk: the number is part of the sort but not of the group.
    short = seen.select("key", "chunk", "number", "seen")
    tables = materialise(_sorted(short, ["key", "chunk"], _table(model), "key string, chunk long, table array<double>", ["number"]), "tables")
    cuts = _sorted(tables, ["key"], _cuts, "key string, chunk long, before int, after int", ["chunk"])
    states = _sorted(short.join(cuts, ["key", "chunk"]), ["key", "chunk"], _path(model), "key string, number int, state int", ["number"])
    return seen.join(states, ["key", "number"])


def _sorted(df: DataFrame, keys: list[str], function, schema: str, order: list[str]) -> DataFrame:
    return by_group(df, keys, lambda part: function(part.sort_values(order, kind="stable")), schema)


def turns(lines: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turn, role, text, rendered) of each transcript."""
    found = decode(lines, model)
    w = Window.partitionBy("key").orderBy("number")
    begins = F.when(F.col("state") % 2 == 0, 1).otherwise(0)
    found = found.withColumn("turn", F.greatest(F.sum(begins).over(w) - 1, F.lit(0)))
    body = F.when(F.col("state") % 2 == 0, F.regexp_replace("text", MARKER, "")).otherwise(F.col("text"))
    found = found.withColumn("line", F.struct("number", body.alias("body"), "state"))
    each = found.groupBy("key", "turn").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list("line")).alias("lines"))
    role = F.get(F.array(*[F.lit(r) for r in ROLES]), F.floor(F.get("lines", F.lit(0))["state"] / 2).cast("int"))
    text = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["body"]), "\n"), r"^\n+|\n+$", "")
    out = each.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return out.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Lines (conv_id, place, text, state) of turns in one of four transcript styles, chosen by the hash of conv_id.

    Styles differ in their markers and in whether a blank line parts the turns; the last marks only the first turn.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    role = F.col("role")
    named = lambda names: F.when(role == "system", names[0]).when(role == "user", names[1]).otherwise(names[2])
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("first", first)
    mark = (F.when(style == 0, named(["System: ", "User: ", "Assistant: "])).when(style == 1, named(["### System: ", "### Human: ", "### Assistant: "]))
            .when(style == 2, named(["Instruction: ", "Q: ", "A: "])).otherwise(F.when(F.col("first") == 0, named(["System: ", "User: ", "Assistant: "])).otherwise("")))
    body = F.split(F.concat(mark, "text"), "\n")
    body = F.when(style.isin(1, 3) & (F.col("first") > 0), F.concat(F.array(F.lit("")), body)).otherwise(body)
    blank = F.when(style.isin(1, 3) & (F.col("first") > 0), 1).otherwise(0)
    number = F.coalesce(*[F.when(role == r, i) for i, r in enumerate(ROLES)])
    c = c.select("conv_id", "first", number.alias("role_no"), blank.alias("blank"), F.posexplode(body).alias("at", "line"))
    # A blank line between turns belongs to the turn before it, whose role is not the one that begins.
    state = F.when(F.col("at") < F.col("blank"), F.lit(None)).otherwise(2 * F.col("role_no") + F.when(F.col("at") == F.col("blank"), 0).otherwise(1))
    lines = c.select("conv_id", F.struct("first", "at").alias("place"), F.col("line").alias("text"), state.alias("state"))
    held = F.last("state", ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("place"))
    return lines.withColumn("state", F.coalesce("state", F.when(held % 2 == 0, held + 1).otherwise(held)).cast("int"))


def known(conversations: DataFrame) -> DataFrame:
    """Conversations to learn from: those whose crc32 of conv_id is not divisible by five."""
    return conversations.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 != 0)
