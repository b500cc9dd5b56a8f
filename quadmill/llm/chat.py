"""Chat formatting: a hidden Markov model recovers who speaks in a transcript before its turns are rendered.

Each line is observed through its speaker marker (if it begins with one), its length class and its shape (how it begins
and ends). The states are a role's opening line and its further lines; Viterbi gives the likeliest path, and each
opening line starts a turn. All odds are counted over labelled turns as they stand in transcripts: who opens, who
follows whom, how often each role's opening and further lines begin with each kind of marker or none, and what
their lengths and shapes are.

A transcript is decoded in segments of SEGMENT turns, so a conversation that holds a third of all rows is many
groups. Where it has several, each first tells the best score from every state before it to every state at its end;
chained, these tell the state in which the whole transcript's path passes each border, and the segments are decoded
between these. The result is that of the whole transcript, and turns that span a border are put together again.

Defined results: null and empty texts are one empty line; turns of equal number are ordered by role and text; a row
without a conversation id or a turn number is a conversation of its own; null markers are none; roles other than the
known ones are not learned from; repeated rows are lines twice; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts, small_batches

ROLES = ("system", "user", "assistant")
#: The names that mark a speaker, by role.
MARKERS = {
    "system": ["system", "instruction", "instructions", "context"],
    "user": ["user", "human", "question", "q", "customer", "prompt"],
    "assistant": ["assistant", "ai", "bot", "answer", "a", "model", "agent"],
}
ROLE_OF = {name: role for role, names in MARKERS.items() for name in names}
MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|<\|?|\[)?(" + "|".join(sorted(ROLE_OF, key=len, reverse=True)) + r")(?:\*\*|\|?>|\])?\s*:[ \t]?", re.IGNORECASE)
SEGMENT, CLASSES, SHAPES, KINDS = 512, 14, 16, 4
STATES = 2 * len(ROLES)
START, STATE = -1, range(STATES)


def ones(*shape: int):
    return field(default_factory=lambda: np.ones(shape))


@dataclass
class Counts:
    """What is counted over turns, each with one seen beforehand. A state is twice its role's number, and one more for further lines."""

    opens: np.ndarray = ones(3)
    follows: np.ndarray = ones(3, 3)
    mark: np.ndarray = ones(STATES, KINDS)
    length: np.ndarray = ones(STATES, CLASSES)
    shape: np.ndarray = ones(STATES, SHAPES)

    def arrays(self) -> list[np.ndarray]:
        return [self.opens, self.follows, self.mark, self.length, self.shape]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def add(self, role: str, before: str | None, first: bool, text: str) -> None:
        r = ROLES.index(role)
        if first:
            self.opens[r] += 1
        elif before in ROLES:
            self.follows[ROLES.index(before), r] += 1
        for i, line in enumerate(text.split("\n")):
            s = 2 * r + (i > 0)
            kind, length, shape = seen(line)[:3]
            self.mark[s, kind] += 1
            self.length[s, length] += 1
            self.shape[s, shape] += 1


class Model:
    """Log odds, from counts."""

    def __init__(self, counts: Counts | None = None):
        c = counts or Counts()
        lines = c.mark.sum(axis=1)
        goes_on = lines[1::2] / (lines[0::2] + lines[1::2])
        self.start = np.full(STATES, -np.inf)
        self.start[0::2] = np.log(c.opens / c.opens.sum())
        self.on = np.log(goes_on).tolist()
        self.change = (np.log(1 - goes_on)[:, None] + np.log(c.follows / c.follows.sum(axis=1, keepdims=True))).tolist()
        self.mark, self.length, self.shape = (np.log(x / x.sum(axis=1, keepdims=True)) for x in (c.mark, c.length, c.shape))
        self.known: dict[tuple[int, int, int], list[float]] = {}

    def emission(self, kind: int, length: int, shape: int) -> list[float]:
        """Log odds of what is seen of a line, by state."""
        key = kind, length, shape
        if key not in self.known:
            self.known[key] = (self.mark[:, kind] + self.length[:, length] + self.shape[:, shape]).tolist()
        return self.known[key]

    def forward(self, rows: list[list[float]], before: list[float] | None) -> tuple[list[float], list[tuple[int, ...]]]:
        """Best scores by state at the last line, and from which state each line's came; before: scores at the line before, none at the beginning."""
        on, change, back = self.on, self.change, []
        score = before
        for row in rows:
            if score is None:
                score = [a + b for a, b in zip(self.start.tolist(), row, strict=True)]
                back.append((START,) * STATES)
                continue
            best = [(score[2 * r], 2 * r) if score[2 * r] >= score[2 * r + 1] else (score[2 * r + 1], 2 * r + 1) for r in range(3)]
            new, came = [], []
            for j in range(3):
                top, at = best[0][0] + change[0][j], 0
                for r in (1, 2):
                    if (x := best[r][0] + change[r][j]) > top:
                        top, at = x, r
                new += [top + row[2 * j], best[j][0] + on[j] + row[2 * j + 1]]
                came += [best[at][1], best[j][1]]
            score = new
            back.append(tuple(came))
        return score, back

    def path(self, rows: list[list[float]], entry: int = START, leave: int | None = None) -> list[int]:
        """The likeliest states; entry: the state at the line before, leave: at the last line, where these are settled."""
        score, back = self.forward(rows, None if entry == START else [0.0 if s == entry else -np.inf for s in STATE])
        state = int(np.argmax(score)) if leave is None else leave
        out = [state]
        for came in back[:0:-1]:
            state = came[state]
            out.append(state)
        return out[::-1]


def length_class(n: int) -> int:
    return min(CLASSES - 1, n.bit_length())


def seen(line: str) -> tuple[int, int, int, int]:
    """Marker kind (0 for none, else the role's number and 1), length class and shape of a line, and where its marker ends."""
    m = MARKER.match(line)
    end = m.end() if m else 0
    rest = line[end:].strip()
    head = 0 if not rest else 1 if rest[0].isupper() else 2 if rest[0].isalnum() else 3
    tail = 0 if not rest or rest[-1] == "." else 1 if rest[-1] == "?" else 2 if rest[-1].isalnum() else 3
    return 1 + ROLES.index(ROLE_OF[m[1].lower()]) if m else 0, length_class(len(line) - end), 4 * head + tail, end


def parse(text: str, model: Model, entry: int = START, leave: int | None = None) -> list[tuple[str, str, bool]]:
    """(role, text, whether it opens here) of each turn of a transcript; markers are taken off opening lines."""
    lines = text.split("\n")
    found = [seen(line) for line in lines]
    turns: list[tuple[str, list[str], bool]] = []
    for state, line, own in zip(model.path([model.emission(*x[:3]) for x in found], entry, leave), lines, found, strict=True):
        if state % 2 == 0 or not turns:
            turns.append((ROLES[state // 2], [line[own[3] :] if state % 2 == 0 else line], state % 2 == 0))
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(own), opens) for role, own, opens in turns]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


def marked(turns: DataFrame) -> DataFrame:
    """conv_id, turn, segment, role, body: the turns as they stand in transcripts, by their marker or, where there is no such column, their role's name."""
    marker = F.coalesce(F.col("marker"), F.lit("")) if "marker" in turns.columns else F.when(F.col("role").isin(*ROLES), F.concat("role", F.lit(": "))).otherwise("")
    body = F.concat(marker, F.coalesce(F.col("text"), F.lit("")))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.floor(F.col("turn") / SEGMENT).cast("long").alias("segment"), "role", body.alias("body"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    before = counts.flat()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            counts.add(*row)
    new = counts.flat() - before
    at = np.flatnonzero(new)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(new[at].astype(np.int64))], names=["slot", "n"])


def fit(turns: DataFrame) -> Model:
    """Counts over all turns with a known role (and of changes of speaker, all within segments); a few hundred numbers come back."""
    small_batches(turns.sparkSession)
    rows = marked(turns)
    order = Window.partitionBy("conv_id", "segment").orderBy("turn", "role", "body")
    known = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    with_before = known.select("role", F.lag("role").over(order).alias("before"), (F.lag("turn").over(order).isNull() & (F.col("segment") == 0)).alias("first"), "body")
    alone = rows.where(F.col("conv_id").isNull() | F.col("turn").isNull()).select("role", F.lit(None).cast("string").alias("before"), F.lit(False).alias("first"), "body")
    counts = Counts()
    flat = counts.flat()
    for r in with_before.union(alone).where(F.col("role").isin(*ROLES)).mapInArrow(_counted, "slot int, n long").groupBy("slot").sum("n").collect():
        flat[r[0]] += r[1]
    at = 0
    for x in counts.arrays():
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    return Model(counts)


PIECE = "conv_id long, segment long, i long, opens boolean, role string, text string"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """(conversation, segment, entry, leave) and the bodies of each group of sorted rows; a row without a conversation or turn is one."""
    key, bodies = None, []
    for batch in batches:
        for conv, turn, segment, entry, leave, body in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            now = conv, segment, entry, leave
            if bodies and (now != key or conv is None or turn is None):
                yield key, bodies
                bodies = []
            key = now
            bodies.append(body)
    if bodies:
        yield key, bodies


def _pieces(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "segment", "i", "opens", "role", "text"])
            rows.clear()
            return made

        for (conv, segment, entry, leave), bodies in _grouped(batches):
            rows += [(conv, segment, i, opens, role, text) for i, (role, text, opens) in enumerate(parse("\n".join(bodies), model, START if entry is None else entry, leave))]
            if len(rows) >= 2000:
                yield out()
        if rows:
            yield out()

    return run


def _scores(model: Model):
    """Of each segment the best scores at its end: from the beginning, then from each state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, segment, _, _), bodies in _grouped(batches):
            rows = [model.emission(*seen(line)[:3]) for line in "\n".join(bodies).split("\n")]
            ways = [None, *([0.0 if s == t else -np.inf for t in STATE] for s in STATE)]
            scores = [x for way in ways for x in model.forward(rows, way)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([segment], pa.int64()), pa.array([scores], pa.list_(pa.float64()))], names=["conv_id", "segment", "scores"])

    return run


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """entry and leave of each segment of a conversation: a Viterbi path over its segments."""
    rows = rows.sort_values("segment")
    tables = [np.asarray(x, dtype=np.float64).reshape(1 + STATES, STATES) for x in rows["scores"]]
    now, back = tables[0][0], []
    for table in tables[1:]:
        ways = now[:, None] + table[1:]
        back.append(ways.argmax(axis=0))
        now = ways.max(axis=0)
    leave = [int(now.argmax())]
    for came in reversed(back):
        leave.append(int(came[leave[-1]]))
    leave.reverse()
    return pd.DataFrame({"conv_id": rows["conv_id"], "segment": rows["segment"], "entry": [START, *leave[:-1]], "leave": leave})


def format_chats(turns: DataFrame, model: Model) -> DataFrame:
    """conv_id, n (from 0 in each conversation), role, text, rendered: a row for each turn that the transcripts hold."""
    spark = turns.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = marked(turns)
    several = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "segment").distinct().groupBy("conv_id").count().where("count > 1").select("conv_id")
    several = scratch.write(several)
    unset = [F.lit(None).cast("int").alias(c) for c in ("entry", "leave")]

    def ordered(df: DataFrame) -> DataFrame:
        # What has no conversation or turn is dealt by its text.
        spread = F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), F.xxhash64("body"))
        return df.repartition(parts(spark), "conv_id", "segment", spread).sortWithinPartitions("conv_id", "segment", "turn", "role", "body").select("conv_id", "turn", "segment", "entry", "leave", "body")

    some = not several.isEmpty()
    one = rows.join(several, "conv_id", "left_anti") if some else rows
    done = ordered(one.select("*", *unset)).mapInArrow(_pieces(model), PIECE).select("conv_id", F.col("i").alias("n"), "role", "text")
    if some:
        many = rows.where("turn IS NOT NULL").join(several, "conv_id", "left_semi")
        loose = rows.where("turn IS NULL").join(several, "conv_id", "left_semi")
        scores = ordered(many.select("*", *unset)).mapInArrow(_scores(model), "conv_id long, segment long, scores array<double>")
        borders = scores.groupBy("conv_id").applyInPandas(_chained, "conv_id long, segment long, entry int, leave int")
        pieces = scratch.write(ordered(many.join(borders, ["conv_id", "segment"])).mapInArrow(_pieces(model), PIECE))
        before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
        opened = pieces.groupBy("conv_id", "segment").agg(F.count_if("opens").alias("k"), F.min(F.col("opens").cast("int")).alias("whole")).select("conv_id", "segment", "whole", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
        # A segment that begins within a turn numbers that one as the turn before its own.
        numbered = pieces.join(opened, ["conv_id", "segment"]).select("conv_id", "segment", (F.col("offset") + F.col("i") + F.col("whole") - 1).alias("n"), "role", "text")
        whole = numbered.groupBy("conv_id", "n", "role").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "text"))), lambda x: x["text"]), "\n").alias("text"))
        alone = ordered(loose.select("*", *unset)).mapInArrow(_pieces(model), PIECE).select("conv_id", F.col("i").alias("n"), "role", "text")
        done = done.unionByName(whole.select("conv_id", "n", "role", "text")).unionByName(alone)
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    return done.select("conv_id", "n", "role", "text", rendered.alias("rendered"))
