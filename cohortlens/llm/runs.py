"""Periodic runs of words, found from Lyndon arrays that grouping yields.

A run is a stretch of words that repeats with a smallest period and that no
neighbouring word extends.  Every run with two or more periods holds, under an
order of the words or under its reverse, a Lyndon word of one period that is
the longest Lyndon word at each of the places where it starts.  The longest
Lyndon words of all positions come from the first phase of Baier's suffix
sorter (grouping by Lyndon prefix): positions start in groups by their word,
groups are taken from the highest down, and each chain of ``m`` neighbouring
members of a group joins the position before it, whose Lyndon prefix grows by
``m`` copies of the group's.  A chain is therefore a Lyndon root repeated ``m``
times; longest common extensions to both sides make it the run.

Both orders of all texts of a slice are grouped in step, in NumPy: a round takes
the highest group left of every text, so a slice costs as many rounds as its
longest text has groups, and work in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .exprs import clear_of
from .text import _SEP, slices, utf8

SLICE_BYTES = 6 << 20
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word of a buffer of texts, and per text the
    index of its first word (with the total at the end)."""
    word = ~_SEP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, last = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    begins = np.flatnonzero(begin)
    return begins, np.flatnonzero(last) + 1, np.searchsorted(begins, offsets)


def word_numbers(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number per word, equal for equal words: the words and the gaps between
    them are one Arrow array over the bytes as they are, which is then encoded."""
    if not len(begins):
        return np.zeros(0, np.int64)
    cuts = np.empty(2 * len(begins), np.int64)
    cuts[0::2], cuts[1::2] = begins, ends
    pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    return pieces.dictionary_encode().indices.to_numpy(zero_copy_only=False)[0::2].astype(np.int64)


def lyndon_chains(numbers: np.ndarray, at: np.ndarray, least: int, lengths: np.ndarray | None = None):
    """Chains of at least ``least`` equal Lyndon roots: ``(first word, root
    length, roots)`` over both orders of every text ``at[d]:at[d + 1]``.

    ``lengths``, of twice as many entries as words, receives the Lyndon array of
    both orders.
    """
    n, texts = len(numbers), len(at) - 1
    none = 2 * n
    found = ([], [], [])
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in found)
    # Positions of the second order lie n behind those of the first.
    place = np.int32 if 8 * n < 1 << 31 else np.int64
    pred, succ = np.arange(-1, none, dtype=place), np.arange(1, none + 2, dtype=place)
    filled = np.flatnonzero(np.diff(at))
    for shift in (0, n):
        pred[at[filled] + shift] = none
        succ[at[filled + 1] - 1 + shift] = none
    lam = np.empty(none + 1, place) if lengths is None else lengths
    lam[:] = 1

    # Groups by word: classes of the first order, and again for the second with the links reversed.
    text_of = np.repeat(np.arange(texts), np.diff(at))
    key = text_of * (int(numbers.max()) + 1) + numbers
    order = np.argsort(key, kind="stable")
    key = key[order]
    opens = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    del key
    classes = len(opens)
    room = 2 * classes + none + 1
    nil = room - 1
    log = np.empty(2 * none, place)
    log[:n], log[n:none] = order, order + n
    start, end, size = np.empty(room, place), np.empty(room, place), np.zeros(room, place)
    lower, higher = np.full(room, nil, place), np.full(room, nil, place)
    closes = np.append(opens[1:], n)
    start[:classes], end[:classes] = opens, closes
    start[classes:2 * classes], end[classes:2 * classes] = opens + n, closes + n
    size[:2 * classes] = np.tile(closes - opens, 2)
    group = np.empty(none + 1, place)
    group[log[:none]] = np.repeat(np.arange(2 * classes), size[:2 * classes])
    owner = text_of[order[opens]]
    same = np.flatnonzero(owner[1:] == owner[:-1])
    higher[same], lower[same + 1] = same + 1, same
    lower[same + classes], higher[same + 1 + classes] = same + 1 + classes, same + classes
    new_owner = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    current = np.concatenate((np.append(new_owner[1:], classes) - 1, new_owner + classes))
    groups, logged = 2 * classes, none

    while len(current):
        # Members that are still in the highest group of each text, by position.
        a, spans = start[current], end[current] - start[current]
        total = int(spans.sum())
        if total == len(current):
            members, own = log[a], current
        else:
            shift = np.cumsum(spans)
            members = log[np.arange(total) + np.repeat(a - shift + spans, spans)]
            own = np.repeat(current, spans)
        here = group[members] == own
        if not here.all():
            members = members[here]
        before = pred[members]
        head = np.empty(len(members), bool)
        head[0] = True
        np.not_equal(before[1:], members[:-1], out=head[1:])
        heads = np.flatnonzero(head)
        if len(heads) == len(members):
            count, first, last, p = np.ones(len(heads), np.int64), members, members, before
        else:
            stops = np.append(heads[1:], len(members))
            count, first, last, p = stops - heads, members[heads], members[stops - 1], before[heads]
        root = lam[first]
        if least <= 1 or (count >= least).any():
            many = count >= least
            for store, values in zip(found, (first, root, count)):
                store.append(values[many])
        behind = succ[last]
        succ[p], pred[behind] = behind, p
        # The positions before the chains move to new groups right above their own.
        real = p != none
        if not real.all():
            p, count, root = p[real], count[real], root[real]
        if len(p):
            lam[p] += count * root
            old = group[p]
            rank = old.astype(np.int64) * (int(count.max()) + 1) + count
            by = np.argsort(rank, kind="stable")
            p, old, rank = p[by], old[by], rank[by]
            fresh = np.empty(len(p), bool)
            fresh[0] = True
            np.not_equal(rank[1:], rank[:-1], out=fresh[1:])
            at_new = np.flatnonzero(fresh)
            made = len(at_new)
            ids = np.arange(groups, groups + made)
            sizes = np.append(at_new[1:], len(p)) - at_new
            log[logged:logged + len(p)] = p
            start[ids] = at_new + logged
            end[ids] = start[ids] + sizes
            size[ids] = sizes
            group[p] = np.repeat(ids, sizes)
            source = old[at_new]
            lead = np.empty(made, bool)
            lead[0] = True
            np.not_equal(source[1:], source[:-1], out=lead[1:])
            if lead.all():
                bottom, top, parent = ids, ids, source
                size[parent] -= sizes
            else:
                np.subtract.at(size, source, sizes)
                lowest = np.flatnonzero(lead)
                bottom, top, parent = ids[lowest], ids[np.append(lowest[1:], made) - 1], source[lowest]
                inner = ids[1:][~lead[1:]]
                lower[inner], higher[inner - 1] = inner - 1, inner
            above = higher[parent]
            lower[bottom], higher[top], lower[above], higher[parent] = parent, above, top, bottom
            empty = size[parent] == 0
            if empty.any():
                gone, base = parent[empty], bottom[empty]
                below = lower[gone]
                lower[base], higher[below] = below, base
            groups += made
            logged += len(p)
        current = lower[current]
        current = current[current != nil]
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in found)


def common_extension(numbers: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from ``a`` and ``b`` on, forwards (``step`` 1) or
    backwards (-1), up to ``room`` words: word by word for all pairs at first,
    then in stretches for each pair that goes on."""
    got, live = np.zeros(len(a), np.int64), np.flatnonzero(room > 0)
    for t in range(16):
        live = live[numbers[a[live] + step * t] == numbers[b[live] + step * t]]
        got[live] = t + 1
        live = live[room[live] > t + 1]
        if not len(live):
            return got
    for i in live:
        t, most = 16, int(room[i])
        while t < most:
            m = min(most - t, max(t, 64))
            x, y = (int(v) + step * t for v in (a[i], b[i]))
            unlike = numbers[x:x + m] != numbers[y:y + m] if step > 0 else (
                numbers[x - m + 1:x + 1] != numbers[y - m + 1:y + 1])[::-1]
            stop = int(unlike.argmax()) if unlike.any() else m
            t += stop
            if stop < m:
                break
        got[i] = t
    return got


def find_runs(numbers: np.ndarray, at: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows ``(text, start, length, period)`` by text, start and period of all runs
    with ``length >= max(min_length, min_exponent * period)``."""
    first, period, roots = lyndon_chains(numbers, at, min_exponent - 1)
    first = np.where(first >= len(numbers), first - len(numbers), first)
    text = np.searchsorted(at, first, "right") - 1
    stop = first + period * roots
    # Less than one more root fits on either side of a chain.
    left = common_extension(numbers, first - 1, first + period - 1, np.minimum(period, first - at[text]), -1)
    right = common_extension(numbers, stop, stop - period, np.minimum(period, at[text + 1] - stop), 1)
    start, length = first - left - at[text], stop + right - first + left
    able = length >= np.maximum(min_length, min_exponent * period)
    return np.unique(np.column_stack((text, start, length, period))[able], axis=0)


def _dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 1] + runs[:, 3], 1)
    np.add.at(steps, runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(steps[:-1]) > 0


def periodic_runs(df: DataFrame, text: str = "text", min_length: int = 6, min_exponent: int = 4,
                  runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Periodic runs of the words of each text, and the text with each run cut
    to its first period.

    Adds ``runs``, an array of (start, length, period) in words by start and
    period, of all runs with at least ``min_length`` words and ``min_exponent``
    (2 or more) periods, and ``collapsed``, the words that no run holds behind
    its first period, joined by a space.  A word is a run of characters that are
    neither space nor 0x09-0x0D.  A null text has no words, no runs and the empty
    text as ``collapsed``.  Columns of those two names are replaced, other columns
    stay, each row is worked on by itself.  Texts are grouped about 6 MB at a
    time; a longer text is alone, takes about 200 bytes a word, and rounds in its
    number of different Lyndon words.
    """
    if min_exponent < 2:
        raise ValueError("a run repeats at least twice")
    df = clear_of(df, [runs, collapsed])
    schema = T.StructType([*df.schema.fields, T.StructField(runs, T.ArrayType(RUN, False), False),
                           T.StructField(collapsed, T.StringType(), False)])
    run_type = pa.struct([pa.field(c, pa.int64()) for c in RUN.names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
            begins, ends, at = word_bounds(data, offsets)
            numbers = word_numbers(data, begins, ends)
            rows = find_runs(numbers, at, min_length, min_exponent)
            per_text = np.searchsorted(rows[:, 0], np.arange(batch.num_rows + 1))
            body, out = data.tobytes(), []
            for d in range(batch.num_rows):
                words = body[offsets[d]:offsets[d + 1]].split()
                own = rows[per_text[d]:per_text[d + 1]]
                if len(own):
                    words = [words[i] for i in np.flatnonzero(~_dropped(own, len(words)))]
                out.append(b" ".join(words))
            listed = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(rows[:, j]) for j in (1, 2, 3)], fields=list(run_type)))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed, pa.array(out, pa.binary()).cast(pa.string())],
                                             names=schema.names)

    return df.mapInArrow(search, schema)
