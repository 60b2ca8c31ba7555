"""Best-fit packing into sequences of several permitted lengths.

Texts are cut into pieces no longer than the largest length.  Pieces are dealt
into groups of bounded size by a hash; within a group, from the longest piece
down, each goes into the open bin that it leaves least room in.  If none has
room, the bin size of least cost for the tokens it is likely to hold is opened,
and in the end each bin shrinks to the smallest permitted length that holds its
contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from cohortlens.session import written

from .exprs import WORD, clear_of, set_apart
from .text import _SEP, slices, utf8

LENGTHS = (512, 1024, 2048, 4096)
#: Pieces in a group, on average: what one packing task holds at a time.
GROUP = 20_000
PLACED = ("piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_used", "bin_length")


def cost(length: int, largest: int) -> float:
    """Cost of a sequence: its tokens, attention that grows with the square of
    its length, and a fixed part for each sequence."""
    return 32 + length + length * length / (4 * largest)


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the length of each bin; ``sizes`` are
    above 0, at most the largest length, and fall.
    """
    lengths = sorted(lengths)
    price = [cost(c, lengths[-1]) for c in lengths]
    rising = list(reversed(sizes))
    total = [0]
    for s in rising:
        total.append(total[-1] + s)
    room: list[tuple[int, int]] = []   # (free tokens, bin), in order
    used: list[int] = []
    bins, offsets = [], []
    for at, size in enumerate(sizes):
        place = bisect_left(room, (size, -1))
        if place < len(room):
            free, b = room.pop(place)
        else:
            rest = len(sizes) - at - 1   # pieces still to come: the first of the rising ones
            best = None
            for c, p in zip(lengths, price):
                if c >= size:
                    # What is still to come and would fit fills the bin.
                    fill = min(c - size, total[min(rest, bisect_left(rising, c - size + 1))])
                    worth = p / (size + fill)
                    if best is None or worth < best[0]:
                        best = (worth, c)
            b, free = len(used), best[1]
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        if free > size:
            insort(room, (free - size, b))
    return bins, offsets, [lengths[bisect_left(lengths, u)] for u in used]


def _cut(docs: DataFrame, text: str, longest: int, with_text: bool) -> DataFrame:
    """A row per piece: ``piece``, ``start`` (words before it), ``n_tokens``; its text if wanted."""
    if not with_text:
        counted = docs.withColumn("_n", F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")).drop(text)
        last = F.greatest(F.ceil(F.col("_n") / longest) - 1, F.lit(0).cast("bigint"))
        return counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn(
            "start", F.col("piece") * longest).withColumn(
            "n_tokens", F.least(F.lit(longest).cast("bigint"), F.col("_n") - F.col("start"))).drop("_n")
    others = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(text, T.StringType()),
                           *(T.StructField(c, T.LongType()) for c in ("piece", "start", "n_tokens"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            data, offsets = utf8(b.column(text))
            rows, parts, place, start, size = [], [], [], [], []
            for i in range(b.num_rows):
                own = data[offsets[i]:offsets[i + 1]]
                word = ~_SEP[own]
                begin = np.flatnonzero(word & ~np.concatenate(([False], word[:-1]))) if len(own) else np.zeros(0, int)
                # A piece ends where the next one's first word begins: the pieces joined are the text.
                edges = [0, *begin[longest::longest], len(own)] if len(begin) else [0, len(own)]
                for j, (x, y) in enumerate(zip(edges, edges[1:])):
                    rows.append(i)
                    parts.append(own[x:y].tobytes())
                    place.append(j)
                    start.append(j * longest)
                    size.append(min(longest, len(begin) - j * longest))
            kept = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(c) for c in others), pa.array(parts, pa.binary()).cast(pa.string()),
                 *(pa.array(c, pa.int64()) for c in (place, start, size))], [*others, text, "piece", "start", "n_tokens"])

    return docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`")).mapInArrow(cut, schema)


def _number_repeats(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``_repeat``, which counts the rows of one ``_key`` from 0.

    Rows of one key are alike, so any order will do: that of the tasks they are
    in, each of which counts its own, so that a key of very many rows meets in no task.
    """
    pieces = pieces.withColumn("_task", F.shiftright("_row", 33))
    own = Window.partitionBy("_key", "_task").orderBy("_row")
    earlier = Window.partitionBy("_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.groupBy("_key", "_task").agg(F.count("*").alias("_held")).select(
        "_key", "_task", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"))
    numbered = pieces.withColumn("_own", F.row_number().over(own) - 1)
    return numbered.join(before, ["_key", "_task"]).withColumn("_repeat", F.col("_own") + F.col("_before")).drop(
        "_task", "_own", "_before")


def pack(docs: DataFrame, text: str = "text", lengths: Sequence[int] = LENGTHS, group: int = GROUP,
         with_text: bool = True) -> DataFrame:
    """A row per piece of each text: the other columns of ``docs``, the piece's
    text (if ``with_text``), ``piece``, ``start`` and ``n_tokens`` (in words of
    the text), ``bin_id``, ``bin_offset``, ``bin_used`` and ``bin_length``.

    Tokens are words; a text longer than the largest length is cut, and its
    pieces joined are the text.  A null, empty or blank text is one piece of no
    tokens without a bin.  Repeated rows are packed each on their own.  Columns
    with the added names are replaced.  Which piece shares a bin with which follows
    from a 64-bit hash of the whole row (columns that hold maps aside), never from the
    number of tasks; rows that are alike are told apart by a count.

    Writes the pieces, then their places: two jobs while it is built.
    """
    docs, at, restored = set_apart(clear_of(docs, PLACED))
    hashed = docs.withColumn("_hash", F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind]))
    cut = written(_cut(hashed, at(text), max(lengths), with_text).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    slim = cut.where("n_tokens > 0").select("_row", "n_tokens", F.xxhash64("_hash", "piece").alias("_key"))
    groups = max(1, -(-slim.count() // group))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "_key", "_repeat"], ascending=[False, True, True])
        bins, offsets, size = best_fit(pdf["n_tokens"].tolist(), lengths)
        bins = np.array(bins)
        used = np.bincount(bins, weights=pdf["n_tokens"])
        return pd.DataFrame({"_row": pdf["_row"], "bin_id": (int(pdf["_group"].iloc[0]) << 24) + bins, "bin_offset": offsets,
                             "bin_used": used[bins].astype(int), "bin_length": np.array(size)[bins]})

    placed = _number_repeats(slim).withColumn("_group", F.pmod(F.xxhash64("_key", "_repeat"), F.lit(groups))).groupBy(
        "_group").applyInPandas(place, "_row bigint, bin_id bigint, bin_offset bigint, bin_used bigint, bin_length bigint")
    # Without its text a piece has the row's other columns only.
    kept = [c for name, c in restored.items() if with_text or name.lower() != text.lower()]
    return cut.join(written(placed, "places"), "_row", "left").select(*kept, *PLACED)
