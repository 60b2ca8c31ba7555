"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of ``e`` edits is cut into ``e + 1`` pieces:
any passage within the budget holds one of them unchanged.  Exact piece hits
are found in one scan over each text for all items, and the passage around each
hit is verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import written
from .exprs import clear_of
from .text import slices

MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()),
                                  T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def normal(text: str) -> str:
    """Lower case, with runs of white space as one space."""
    return " ".join(text.lower().split())


def origin(text: str) -> list[int]:
    """For each character of ``normal(text)`` its place in ``text``, and the end."""
    out, gap = [], False
    for i, c in enumerate(text):
        if c.isspace():
            gap = bool(out)
            continue
        if gap:
            out.append(i - 1)
            gap = False
        out.extend([i] * len(c.lower()))
    return [*out, len(text.rstrip())]


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` consecutive parts of an item with their places."""
    n = budget + 1
    edges = [len(item) * j // n for j in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


class Pattern:
    """Myers' algorithm for one item, as bit vectors in whole numbers."""

    def __init__(self, item: str):
        self.size = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best_end(self, text: str, budget: int) -> tuple[int, int] | None:
        """Least distance of the item to a part of ``text`` that ends before
        the returned place (the first such), or None above the budget."""
        every, last = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score = every, 0, self.size
        best, at = budget + 1, 0
        get = self.masks.get
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | (~(xh | up) & every)
            mh = up & xh
            if ph & last:
                score += 1
            elif mh & last:
                score -= 1
            ph, mh = ph << 1 & every, mh << 1 & every
            up, down = mh | (~(xv | ph) & every), ph & xv
            if score < best:
                best, at = score, j + 1
        return None if best > budget else (best, at)


class Matcher:
    """All items of a block: an automaton over their pieces, and their patterns."""

    def __init__(self, items: Sequence[tuple[int, str]], rate: float):
        import ahocorasick
        self.items = [(i, t, int(len(t) * rate)) for i, t in items]
        self.forward = [Pattern(t) for _, t, _ in self.items]
        self.backward = [Pattern(t[::-1]) for _, t, _ in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, e) in enumerate(self.items):
            for at, piece in pieces(t, e):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """Per item the best passage of a normalised text: (item_id, distance, start, end)."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, at in where:
                _, item, e = self.items[n]
                a = end + 1 - size - at
                a, b = max(0, a - e), min(len(text), a + len(item) + e)
                found = windows.setdefault(n, [])
                # Hits come in the order of the text, so windows of an item mostly extend the last one.
                if found and found[-1][0] <= b and a <= found[-1][1]:
                    found[-1] = [min(a, found[-1][0]), max(b, found[-1][1])]
                else:
                    found.append([a, b])
        out = []
        for n, spans in windows.items():
            item_id, item, e = self.items[n]
            best = None
            for a, b in spans:
                if b - a < len(item) - e:
                    continue
                got = self.forward[n].best_end(text[a:b], e if best is None else best[0] - 1)
                if got:
                    best = (got[0], a + got[1])
            if best:
                distance, end = best
                _, back = self.backward[n].best_end(text[max(0, end - len(item) - distance):end][::-1], distance)
                out.append((item_id, distance, end - back, end))
        return sorted(out)


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, text: str = "text",
               block_bytes: int = 4 << 20) -> DataFrame:
    """Every column of ``docs`` and ``matches``: for each item of ``benchmark``
    (``item_id``, ``text``) that a text holds within ``rate`` edits per
    character, its best passage as (item_id, distance, start, end) by item.

    Texts and items are compared in lower case with white space joined; places
    count code points of the text as it is, end exclusive; of equally near
    passages the one that ends first is given.  Null or blank items match
    nothing, a null or empty text has no matches, repeated rows are all kept, and
    a column named ``matches`` is replaced.  The items come to the driver, which
    sends them to the tasks in blocks of at most ``block_bytes`` of text (an item
    longer than that alone).  Each further block is one more scan of the texts, whose
    result so far is written before it: a plan, and what its tasks receive, holds
    one block, however long the benchmark.
    """
    docs = clear_of(docs, ["matches"]).withColumn("matches", F.array().cast(MATCH))
    for n, block in enumerate(blocks(benchmark, block_bytes)):
        docs = _search(written(docs, "matched") if n else docs, block, rate, text)
    return docs


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items, normalised, in blocks; one block is on the driver at a time."""
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    block, size = [], 0
    for item_id, t in items.orderBy("item_id", "text").toLocalIterator():
        t = normal(t)
        if not t:
            continue
        if block and size + 4 * len(t) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item_id, t))
        size += 4 * len(t)
    if block:
        yield block


def _search(docs: DataFrame, items: list[tuple[int, str]], rate: float, text: str) -> DataFrame:
    schema, names = docs.schema, docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        kind = None
        for b in slices(batches, text):
            place = names.index("matches")
            rows = b.column(place).to_pylist()
            for i, t in enumerate(b.column(text).to_pylist()):
                got = matcher.search(normal(t)) if t else []
                if got:
                    back = origin(t)
                    rows[i] = sorted([*rows[i], *({"item_id": item, "distance": d, "start": back[s], "end": back[e - 1] + 1}
                                                  for item, d, s, e in got)], key=lambda m: (m["item_id"], m["distance"]))
            kind = kind or b.schema.field(place).type
            columns = list(b.columns)
            columns[place] = pa.array(rows, kind)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(scan, schema)
