"""Chat transcripts: speaker roles by a hidden Markov model, canonical rendering.

A state is a role together with "first line of a turn" or "further line".  Each
line is seen as a few categories: the speaker marker at its head, its length, its
first and last character.  Counts over labelled transcripts give the model, and
Viterbi's algorithm the best states of all lines of a conversation.  Long
conversations are decoded in parts: a part is a matrix in the (max, +) algebra,
matrices of consecutive parts are multiplied level by level, and the states at the
parts' borders lead to the same path as one pass over all lines would.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.session import written

from .exprs import clear_of

ROLES = ("system", "user", "assistant")
#: Names that transcripts give their speakers (fixed values).
NAMES = ("system", "instructions", "user", "human", "prompter", "customer", "q",
         "assistant", "ai", "bot", "gpt", "model", "a")
NONE = "none"
MARKER = re.compile(r"\s*(?:#{1,4}\s*(%(n)s)\s*:?|\[(%(n)s)\]\s*:?|<\|(%(n)s)\|>|\*\*(%(n)s):?\*\*:?|(%(n)s)\s*:)(?:\s+|$)"
                    % {"n": "|".join(sorted(NAMES, key=len, reverse=True))}, re.IGNORECASE)
#: Turns in a part, and matrices multiplied in one task.
PART, FAN = 64, 256
STATES = tuple((role, first) for role in ROLES for first in (True, False))
SIZES = (len(NAMES) + 1, 16, 5, 5)
#: Least value of a log probability: finite, so that any sequence has a best path.
FLOOR = -60.0


def categories(line: str) -> tuple[int, int, int, int]:
    """Marker, length class, kinds of the first and the last character."""
    found = MARKER.match(line)
    marker, body = (NAMES.index(found[found.lastindex].lower()), line[found.end():]) if found else (len(NAMES), line)
    body = body.strip()

    def kind(c):
        return 0 if not c else 1 if c == "?" else 2 if c in ".!:;" else 3 if c.isupper() or c.isdigit() else 4
    return marker, min(len(body).bit_length(), 15), kind(body[:1]), kind(body[-1:])


def content(line: str) -> str:
    """A line without its speaker marker."""
    found = MARKER.match(line)
    return line[found.end():] if found else line


@dataclass(frozen=True)
class Model:
    start: np.ndarray                 # log probability per state
    move: np.ndarray                  # from state, to state
    emit: tuple[np.ndarray, ...]      # per category: state, value

    def scores(self, lines: list[str]) -> np.ndarray:
        seen = np.array([categories(x) for x in lines]).reshape(-1, len(SIZES))
        return sum(e[:, seen[:, j]].T for j, e in enumerate(self.emit))

    def matrix(self, lines: list[str]) -> np.ndarray:
        """Best scores from the state before the lines to that of the last line."""
        out = np.where(np.eye(len(STATES), dtype=bool), 0.0, -np.inf)
        for row in self.scores(lines):
            out = (out[:, :, None] + self.move[None]).max(1) + row[None]
        return out

    def decode(self, lines: list[str], before: int | None, after: int | None) -> list[int]:
        """The best states, given the state before the lines and that of the last one, or None where they are free."""
        score = self.scores(lines)
        if not len(score):
            return []
        best = [(self.start if before is None else self.move[before]) + score[0]]
        back = []
        for row in score[1:]:
            every = best[-1][:, None] + self.move
            back.append(every.argmax(0))
            best.append(every.max(0) + row)
        path = [int(best[-1].argmax()) if after is None else after]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def fit(transcripts: DataFrame) -> Model:
    """A model from labelled transcript rows ``(conv_id, turn, role, text)``.

    Counts over all rows: tasks count their own, and the sums (a fixed number)
    come to the driver.  Roles other than ROLES are not learned from.  Every
    count starts at a half, so a model without rows is uniform.
    """
    parts = _parts(transcripts.where(F.col("role").isin(list(ROLES))))
    width = len(STATES) * (1 + len(STATES) + sum(SIZES))

    def count(t):
        start, move, emit = np.zeros(len(STATES)), np.zeros((len(STATES),) * 2), [np.zeros((len(STATES), n)) for n in SIZES]
        for _, part, rows in _each(t):
            last = None
            for _, role, text, copies in rows:
                for i, line in enumerate(lines_of(text)):
                    state = STATES.index((role, i == 0))
                    if last is not None:
                        move[last, state] += copies
                    elif part == 0:
                        start[state] += copies
                    for table, value in zip(emit, categories(line)):
                        table[state, value] += copies
                    last = state
        flat = np.concatenate([start, move.ravel(), *(e.ravel() for e in emit)])
        return pa.table({"i": np.arange(width, dtype=np.int32), "n": flat})

    sums = np.zeros(width)
    for i, n in parts.groupBy("_task").applyInArrow(count, "i int, n double").groupBy("i").agg(F.sum("n")).collect():
        sums[i] = n

    def logs(x):
        x = x + 0.5
        return np.maximum(np.log(x / x.sum(-1, keepdims=True)), FLOOR)
    k = len(STATES)
    tables, at = [], k + k * k
    for n in SIZES:
        tables.append(logs(sums[at:at + k * n].reshape(k, n)))
        at += k * n
    return Model(logs(sums[:k]), logs(sums[k:k + k * k].reshape(k, k)), tuple(tables))


def _parts(rows: DataFrame, size: int = PART) -> DataFrame:
    """Distinct rows with ``_copies``, ``_part`` (a range of turns, null for a row
    without a turn, which stands alone) and ``_task``."""
    rows = rows.select("conv_id", "turn", "role", "text").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("_copies"))
    rows = written(rows.withColumn("_part", F.floor(F.col("turn") / size)), "chat-rows")
    tasks = max(1, rows.count() // 20_000)
    alone = F.when(F.col("_part").isNull(), F.xxhash64("role", "text")).otherwise(0)
    return rows.withColumn("_alone", alone).withColumn("_task", F.pmod(F.xxhash64("conv_id", "_part", "_alone"), F.lit(tasks)))


def _each(t) -> Iterator[tuple]:
    """Parts of a task's rows: (conversation, part, rows by turn as (turn, role, text, copies))."""
    groups: dict[tuple, list] = {}
    columns = [t.column(c).to_pylist() for c in ("conv_id", "_part", "_alone", "turn", "role", "text", "_copies")]
    for n, (conv, part, alone, turn, role, text, copies) in enumerate(zip(*columns)):
        key = (conv, part, alone) if part is not None else (conv, None, alone, n)
        groups.setdefault(key, []).append((turn, role, text, copies))
    for key, rows in groups.items():
        yield key[0], key[1], sorted(rows, key=lambda r: (r[0] or 0, r[1] or "", r[2] or ""))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).max(1)


def _borders(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """States before and at the end of each part: from written ``(conv_id,
    _part, m)`` of conversations with several parts rows ``(_c, _p, before,
    after)``; level by level, ``fan`` matrices a task.  All rows of a first
    part's matrix are alike: whatever came before it, its start is free."""
    k = len(STATES)
    low = matrices.groupBy("conv_id").agg(F.min("_part").alias("_l")).withColumnRenamed("conv_id", "_c")
    levels = [written(matrices.join(low, F.col("conv_id").eqNullSafe(F.col("_c"))).select(
        "conv_id", "_part", "m", (F.col("_part") - F.col("_l")).alias("n")), "chat-matrices")]
    key = matrices.schema["conv_id"].dataType.simpleString()

    def multiply(name, t):
        rows = sorted(zip(t.column("n").to_pylist(), t.column("m").to_pylist()))
        out = np.array(rows[0][1]).reshape(k, k)
        for _, m in rows[1:]:
            out = _product(out, np.array(m).reshape(k, k))
        return pa.table({"conv_id": t.column("conv_id").slice(0, 1), "n": pa.array([name[1].as_py()], pa.int64()),
                         "m": pa.array([out.ravel().tolist()], pa.list_(pa.float64()))})

    while levels[-1].agg(F.max("n")).first()[0]:
        up = levels[-1].withColumn("g", F.floor(F.col("n") / fan)).groupBy("conv_id", "g").applyInArrow(
            multiply, f"conv_id {key}, n bigint, m array<double>")
        levels.append(written(up, "chat-level"))

    def top(t: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in t:
            after = [int(np.array(m).reshape(k, k)[0].argmax()) for m in b.column("m").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("n"), pa.array([None] * len(after), pa.int32()),
                                              pa.array(after, pa.int32())], ["conv_id", "n", "before", "after"])

    state = levels[-1].mapInArrow(top, f"conv_id {key}, n bigint, before int, after int")

    def descend(t):
        rows = sorted(zip(t.column("n").to_pylist(), t.column("m").to_pylist()))
        before, after = t.column("before")[0].as_py(), t.column("after")[0].as_py()
        vectors = []
        for i, (_, m) in enumerate(rows):
            m = np.array(m).reshape(k, k)
            vectors.append(m[before or 0] if i == 0 else (vectors[-1][:, None] + m).max(0))
        ends = [after]
        for i in range(len(rows) - 1, 0, -1):
            ends.append(int((vectors[i - 1] + np.array(rows[i][1]).reshape(k, k)[:, ends[-1]]).argmax()))
        ends = ends[::-1]
        return pa.table({"conv_id": pa.array([t.column("conv_id")[0].as_py()] * len(rows), t.schema.field("conv_id").type),
                         "n": pa.array([n for n, _ in rows], pa.int64()),
                         "before": pa.array([before, *ends[:-1]], pa.int32()), "after": pa.array(ends, pa.int32())})

    for level in reversed(levels[:-1]):
        parent = state.select(F.col("conv_id").alias("_c"), F.col("n").alias("g"), "before", "after")
        down = level.withColumn("g", F.floor(F.col("n") / fan)).alias("l").join(
            parent.alias("p"), F.col("l.conv_id").eqNullSafe(F.col("_c")) & (F.col("l.g") == F.col("p.g"))).select(
            "l.conv_id", "l.g", "n", "m", "before", "after")
        state = written(down.groupBy("conv_id", "g").applyInArrow(descend, f"conv_id {key}, n bigint, before int, after int"), "chat-states")
    named = levels[0].select(F.col("conv_id").alias("_c"), F.col("n").alias("_n"), "_part")
    return named.join(state, F.col("_c").eqNullSafe(F.col("conv_id")) & (F.col("_n") == F.col("n"))).select(
        F.col("_c"), F.col("_part").alias("_p"), "before", "after")


def parse(rows: DataFrame, model: Model, part: int = PART, fan: int = FAN) -> DataFrame:
    """Turns of transcripts: rows ``(conv_id, part, turn_no, role, continued,
    n_lines, n_copies, first_turn, text, rendered)``.

    ``rows`` are ``(conv_id, turn, text)``; the lines of a conversation are those
    of its rows by ``turn``.  A turn is a first line with the further lines after
    it; at the border of a part (``part`` turn numbers) a turn may go on in a row
    with ``continued``.  ``text`` has no speaker marker; ``rendered`` is the
    canonical form.  Repeated rows are parsed once and counted in ``n_copies``
    (the least count of the turn's rows).  A null text is one empty line; a row
    without a turn number is parsed on its own, and null conversations are one
    conversation.  Other columns are ignored.
    """
    rows = _parts(rows.withColumn("role", F.lit(None).cast("string")), part)
    key = rows.schema["conv_id"].dataType.simpleString()
    many = rows.where("_part IS NOT NULL").groupBy("conv_id").agg(F.min("_part").alias("_l"), F.max("_part").alias("_h")).where("_l < _h")
    many = written(many.select(F.col("conv_id").alias("_c"), F.col("_l")), "chat-long")

    def matrices(t):
        first = {c: low for c, low in zip(t.column("conv_id").to_pylist(), t.column("_l").to_pylist())}
        out = []
        for conv, p, group in _each(t):
            lines = [x for r in group for x in lines_of(r[2])]
            m = model.matrix(lines)
            if p == first[conv]:
                # The first part is entered by the start probabilities, whatever the row.
                score = model.scores(lines)
                v = model.start + score[0]
                for row in score[1:]:
                    v = (v[:, None] + model.move).max(0) + row
                m = np.tile(v, (len(STATES), 1))
            out.append((conv, p, m.ravel().tolist()))
        c, p, m = zip(*out)
        return pa.table({"conv_id": pa.array(c, t.schema.field("conv_id").type), "_part": pa.array(p, pa.int64()),
                         "m": pa.array(m, pa.list_(pa.float64()))})

    if many.isEmpty():
        placed = rows.withColumns({"before": F.lit(None).cast("int"), "after": F.lit(None).cast("int")})
    else:
        long = rows.where("_part IS NOT NULL").join(many, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
        borders = _borders(written(long.groupBy("_task").applyInArrow(
            matrices, f"conv_id {key}, _part bigint, m array<double>"), "chat-parts"), fan)
        placed = rows.join(borders, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")), "left").drop("_c", "_p")

    def decode(t):
        ends = {}
        for c, p, b, a in zip(*(t.column(x).to_pylist() for x in ("conv_id", "_part", "before", "after"))):
            ends[c, p] = (b, a)
        out = []
        for conv, p, group in _each(t):
            lines = [(x, r[0], r[3]) for r in group for x in lines_of(r[2])]
            before, after = ends[conv, p] if p is not None else (None, None)
            turns = []
            for (line, turn, copies), s in zip(lines, model.decode([x for x, _, _ in lines], before, after)):
                role, first = STATES[s]
                if first or not turns or turns[-1][0] != role:
                    turns.append([role, not first, [], copies, turn])
                turns[-1][2].append(content(line))
                turns[-1][3] = min(turns[-1][3], copies)
            for n, (role, continued, body, copies, turn) in enumerate(turns):
                text = "\n".join(body)
                out.append((conv, p, n, role, continued, len(body), copies, turn, text, render(role, text)))
        kinds = (t.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(),
                 pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=OUT)

    return placed.groupBy("_task").applyInArrow(decode, f"conv_id {key}, part bigint, turn_no bigint, role string, continued boolean, "
                                                "n_lines bigint, n_copies bigint, first_turn bigint, text string, rendered string")


OUT = ["conv_id", "part", "turn_no", "role", "continued", "n_lines", "n_copies", "first_turn", "text", "rendered"]


def render(role: str, text: str) -> str:
    """The canonical form of a turn; its own signs in the text are broken up."""
    return f"<|{role}|>\n{text.replace('<|', '< |')}\n<|end|>"


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """Rows of structured conversations as a log would hold them: the speaker is
    only in the text, in a style that differs by conversation, and a quarter of
    the turns do not name theirs.  ``role`` stays as the label."""
    conversations = clear_of(conversations, ["_style"]).withColumn("_style", F.pmod(F.xxhash64("conv_id"), F.lit(5)))
    role = F.coalesce("role", F.lit("user"))

    def named(user: str, assistant: str, system: str) -> Column:
        return F.when(role == "user", user).when(role == "assistant", assistant).otherwise(system)
    styles = [named("User: ", "Assistant: ", "System: "), named("### Human: ", "### AI: ", "### Instructions: "),
              named("[USER] ", "[ASSISTANT] ", "[SYSTEM] "), named("Q: ", "A: ", "System: "),
              named("<|user|> ", "<|assistant|> ", "<|system|> ")]
    marker = F.element_at(F.array(*styles), (F.col("_style") + 1).cast("int"))
    silent = F.pmod(F.xxhash64("conv_id", "turn", F.lit("speaker")), F.lit(4)) == 0
    return conversations.withColumn("text", F.when(silent, F.col("text")).otherwise(F.concat(marker, "text"))).drop("_style")
