"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

The suffixes that are indexed start at content-chosen positions: within every
string of ``LENGTH`` bytes the position whose next ``GRAM`` bytes hash least.
Equal strings choose the same position, so any repeat is seen at such a suffix.
A batch's suffixes are dealt out by the hash of their first bytes and sorted by that
of their surroundings (all strings that chose the position).  The sorted array is
scanned against those of earlier batches; arrays of equal size are merged, so
that there are at most logarithmically many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cohortlens.session import bound_batches, written

from .text import PIECE, _power, mix, slices, utf8

LENGTH, GRAM = 50, 16
#: Bytes of text whose suffixes make up one bucket, on average.
BUCKET_BYTES = 24 << 20
#: Buckets to compare are so many times more, as an entry with its bytes is about four times one without.
FINER = 4
#: Ids of whole copies that may be broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
_U = np.uint64
_LOW = _U(0xFFFFFFFF)
_NAMES = ["bucket", "kind", "owner", "codes", "ids", "grams"]
_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
_ROWS = "bucket int, kind int, owner int, codes binary, ids binary, grams binary"
_PLACE = _U((1 << 23) - 1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


def _prefix(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power(len(part) + 1)
    total = np.zeros(len(part) + 1, _U)
    np.cumsum(_BYTE[part] * up[:len(part)], out=total[1:])
    return total, down


def anchors(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Chosen positions of texts: arrays of the text's index, the first and last
    start of the strings that chose the position, the position, the hash of its
    gram and a code: the 64 bits of a hash of all those strings and where the
    position is in them."""
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for low in range(0, len(data), PIECE):
        part = data[low:low + PIECE + LENGTH - 1]
        n = len(part)
        if n < LENGTH:
            break
        total, down = _prefix(part)
        grams = total[GRAM:] - total[:n - GRAM + 1]
        grams *= down[:n - GRAM + 1]
        least, span, wide = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1, LENGTH - GRAM + 1
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wide:
            least = np.minimum(least[:len(least) - (wide - span)], least[wide - span:])
        place = (least & _PLACE).astype(np.int32)
        own = row[low:low + n]
        inside = own[:n - LENGTH + 1] == own[LENGTH - 1:]
        new = place[1:] != place[:-1]
        new |= own[1:n - LENGTH + 1] != own[:n - LENGTH]
        s1 = np.flatnonzero(np.concatenate(([True], new)) & inside)
        if not len(s1):
            continue
        # A run of strings ends before the next one begins, or with the last string of its text.
        at, whose = place[s1].astype(np.int64), own[s1]
        s2 = np.minimum(np.append(s1[1:], n - LENGTH + 1) - 1, np.minimum(offsets[whose + 1] - low, n) - LENGTH)
        code = mix((total[s2 + LENGTH] - total[s1]) * down[s1] + mix(((at - s1) * 64 + (s2 - s1) + 1).astype(_U)))
        yield whose, s1 + low, s2 + low, at + low, mix(grams[at]), code


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _begins(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))), [len(x)])) if len(x) else np.zeros(1, np.int64)


def _least_id(code: np.ndarray, ids: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries (code, id, gram) sorted by code and id; the last array has the least id of each code, entry by entry."""
    order = np.lexsort((ids, code))
    code, ids, gram = code[order], ids[order], gram[order]
    at = _begins(code)
    return code, ids, gram, np.repeat(ids[at[:-1]], np.diff(at))


def _by_owner(code: np.ndarray, ids: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of kind 1: codes with their ids, packed by a hash of the id."""
    group = (mix(ids.astype(_U)) % _U(buckets)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    code, ids, group = code[order], ids[order], group[order]
    at = _begins(group)
    return [(int(group[x]), 1, int(group[x]), code[x:y].tobytes(), ids[x:y].tobytes()) for x, y in zip(at[:-1], at[1:])]


def suffix_entries(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows ``(bucket, kind, owner, codes, ids, grams)``: per slice of texts and
    bucket the codes with the ids they are in and 32 bits of their grams' hashes
    (kind 0); codes that an earlier text of the slice has too (kind 1), which
    need not be compared further and have no grams."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            ids = b.column("id").to_numpy()
            got = [(r, k, c) for r, _, _, _, k, c in anchors(*utf8(b.column("text")))]
            if not got:
                continue
            row, key, code = (np.concatenate(x) for x in zip(*got))
            own = ids[row]
            bucket, gram = _bucket(key, buckets), (key & _LOW).astype(np.uint32)
            order = np.lexsort((own, code, bucket))
            code, own, bucket, gram = code[order], own[order], bucket[order], gram[order]
            first = np.concatenate(([True], (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])))
            least = np.repeat(own[first], np.diff(np.append(np.flatnonzero(first), len(own))))
            rows = [(*r, None) for r in _by_owner(code[own > least], own[own > least], buckets)]
            code, own, bucket, gram = code[first], own[first], bucket[first], gram[first]
            at = _begins(bucket)
            rows += [(int(bucket[x]), 0, None, code[x:y].tobytes(), own[x:y].tobytes(), gram[x:y].tobytes())
                     for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)
    return docs.mapInArrow(emit, _ROWS)


def _arrays(t, kind, wanted):
    codes = [c.as_buffer() for c, k in zip(t.column("codes"), kind) if k == wanted]
    ids = [i.as_buffer() for i, k in zip(t.column("ids"), kind) if k == wanted]
    return np.frombuffer(b"".join(codes), _U), np.frombuffer(b"".join(ids), np.int64)


def _grams(t, kind, wanted):
    return np.frombuffer(b"".join(g.as_buffer() for g, k in zip(t.column("grams"), kind) if k == wanted), np.uint32)


class SuffixIndex:
    """Sorted suffix arrays of the texts added so far, as written tables, level by level.

    ``add`` takes texts whose ids are all larger than those before.  Level ``i``
    holds ``2**i`` batches or is free; adding merges the full levels below the
    first free one with the batch, in the job that scans them.
    """

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.levels: list[DataFrame | None] = []

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """Adds ``(id, text)``, and returns a written table ``(bucket, kind, owner,
        codes, ids, grams)``: codes that are wholly in earlier texts with the ids of the
        later ones, packed by ``owner``, a hash of the id (kind 1), and codes to compare byte by byte, as they share their gram with others
        of other texts, each with its first text (kind 2).  With ``last`` the
        batch itself is not kept in the index."""
        buckets = self.buckets
        free = next((i for i, level in enumerate(self.levels) if level is None), len(self.levels))
        rows = suffix_entries(docs, self.buckets)
        for i, level in enumerate(self.levels):
            if level is not None:
                rows = rows.union(level.withColumn("kind", F.lit(10 + i)))

        def scan(t):
            kind = t.column("kind").to_numpy()
            bucket = t.column("bucket")[0].as_py()
            out = [(bucket, 1, o, c, i, None) for o, c, i, k in zip(*(t.column(x).to_pylist() for x in ("owner", "codes", "ids")), kind) if k == 1]
            code, ids, gram, least = _least_id(*_arrays(t, kind, 0), _grams(t, kind, 0))
            levels = {int(k): (*_arrays(t, kind, k), _grams(t, kind, k)) for k in np.unique(kind) if k >= 10}
            known = np.zeros(len(code), bool)
            for c, _, _ in levels.values():
                place = np.searchsorted(c, code)
                known |= (place < len(c)) & (c[np.minimum(place, len(c) - 1)] == code) if len(c) else False
            whole = known | (ids > least)
            out += [(bucket, *row[1:], None) for row in _by_owner(code[whole], ids[whole], buckets)]
            # Codes that are new, with all codes of the same gram before them.
            fresh = ~known & (ids == least)
            fresh[1:] &= code[1:] != code[:-1]
            new = code[fresh], ids[fresh], gram[fresh]
            wanted = np.unique(new[2])
            near = [new]
            for level in levels.values():
                place = np.searchsorted(wanted, level[2])
                same = (place < len(wanted)) & (wanted[np.minimum(place, len(wanted) - 1)] == level[2]) if len(wanted) else np.zeros(len(level[2]), bool)
                near.append(tuple(x[same] for x in level))
            # A code may be in several levels: the one with the least id counts.
            c, i, g, low = _least_id(*(np.concatenate(x) for x in zip(*near)))
            order = np.flatnonzero(i == low)
            order = order[np.argsort(g[order], kind="stable")]
            c, i, g = c[order], i[order], g[order]
            at = _begins(g)
            if len(c):
                mixed = np.minimum.reduceat(i, at[:-1]) != np.maximum.reduceat(i, at[:-1])
                mixed = np.repeat(mixed, np.diff(at))
                out.append((bucket, 2, None, c[mixed].tobytes(), i[mixed].tobytes(), None))
            if not last:
                merged = [new, *(levels[k] for k in levels if k < 10 + free)]
                c, i, g, low = _least_id(*(np.concatenate(x) for x in zip(*merged)))
                c, i, g = c[i == low], i[i == low], g[i == low]
                out.append((bucket, 3, None, c.tobytes(), i.tobytes(), g.tobytes()))
            return pa.table([pa.array(x, y) for x, y in zip(zip(*out), _TYPES)], names=_NAMES) if out else t.slice(0, 0)

        made = written(rows.groupBy("bucket").applyInArrow(scan, _ROWS), "suffixes")
        if not last:
            self.levels[:free + 1] = [None] * free + [made.where("kind = 3")]
        return made.where("kind < 3")


def _strings(count: np.ndarray, chunks: Iterator[pa.Array]) -> np.ndarray:
    """Hashes of all strings of entries with so many strings each, whose bytes are
    in chunks, entry by entry.  Prefix sums take many times the bytes, so that they
    are made for about ``PIECE`` bytes at a time."""
    out, done, entry = np.empty(int(count.sum(dtype=np.int64)), _U), 0, 0
    ends = np.cumsum(count.astype(np.int64) + LENGTH - 1)
    before = 0
    for chunk in chunks:
        data, _ = utf8(chunk)
        last = int(np.searchsorted(ends, before + len(data), "right"))
        while entry < last:
            begin = int(ends[entry - 1]) if entry else 0
            to = min(last, max(entry + 1, int(np.searchsorted(ends, begin + PIECE, "right"))))
            n, end = count[entry:to].astype(np.int64), ends[entry:to] - begin
            total, down = _prefix(data[begin - before:begin - before + int(end[-1])])
            size = int(n.sum())
            start = np.repeat(end - n - LENGTH + 1 - (np.cumsum(n) - n), n) + np.arange(size)
            out[done:done + size] = mix((total[start + LENGTH] - total[start]) * down[start])
            done, entry = done + size, to
        before += len(data)
    return out


def _compare(rows: DataFrame) -> DataFrame:
    """Of rows ``(bucket, codes, ids, left, count, bytes)`` per id and code a mask
    of the strings that are in a text with a smaller id, by the position's place in
    them.  Equal strings have it at the same place, so that places are taken one by one."""
    def compare(t):
        def get(name, kind):
            return np.frombuffer(b"".join(x.as_buffer() for x in t.column(name)), kind)
        code, ids, left, count = get("codes", _U), get("ids", np.int64), get("left", np.uint8), get("count", np.uint8)
        string = _strings(count, t.column("bytes").chunks)
        first = np.cumsum(count, dtype=np.int64) - count
        mask = np.zeros(len(code), _U)
        for place in range(LENGTH - GRAM + 1):
            step = left.astype(np.int16) - place
            has = np.flatnonzero((step >= 0) & (step < count))
            if not len(has):
                continue
            own, whose = string[first[has] + step[has]], ids[has]
            order = np.argsort(own)
            own, whose, has = own[order], whose[order], has[order]
            at = _begins(own)
            least = np.repeat(np.minimum.reduceat(whose, at[:-1]), np.diff(at))
            mask[has[least < whose]] |= _U(1) << _U(place)
        some = mask != 0
        return pa.table({"id": ids[some], "code": code[some].astype(np.int64), "mask": mask[some].astype(np.int64)})
    return rows.groupBy("bucket").applyInArrow(compare, "id bigint, code bigint, mask bigint")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", batches: int = 2,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of ``docs``: the id, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256`` and ``kept`` (the bytes that are left).

    A byte goes if it is in a string of 50 bytes that also starts in a text with
    a smaller id, judged on the texts as given.  A null text is empty.  A null id
    is neither smaller nor larger than another: its text stays and takes nothing
    from others.  Rows with equal ids do not count against each other.  Columns
    other than id and text are ignored.  Ids are whole numbers.

    Texts are added to a ``SuffixIndex`` in ``batches`` ranges of ids, one job
    each.  Whole copies of a text are set aside first.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # Equal texts by two hashes and the size; only the first needs to be indexed.
    marked = docs.where("id IS NOT NULL").select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(17), "text").alias("h2"),
                                                 F.octet_length("text").cast("bigint").alias("n"))
    marked = written(marked, "texts")
    total, = marked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()
    equal = written(marked.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("_m")).where(
        f"rep <> _m AND n >= {LENGTH}").drop("_m"), "equal-texts")
    # An id can have several texts: a copy is a text, not an id.
    copies = written(marked.join(equal, ["h1", "h2", "n"]).where("id > rep").select("id", "h1", "h2").distinct(), "text-copies")
    gone = copies.withColumnsRenamed({"id": "_i", "h1": "_h1", "h2": "_h2"})
    keyed = docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(17), "text")})
    on = (F.col("id") == F.col("_i")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    few = copies.count() <= BROADCAST_IDS
    own = keyed.where("id IS NOT NULL").join(F.broadcast(gone) if few else gone, on, "left_anti").select("id", "text")

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // bucket_bytes)
    index = SuffixIndex(buckets)
    edges = marked.agg(F.percentile_approx("id", F.array(*[F.lit(j / batches) for j in range(1, batches)]), 10000)).first()[0] if batches > 1 else []
    edges = sorted(set(edges or []))
    found = None
    for j in range(len(edges) + 1):
        part = own
        if j > 0:
            part = part.where(F.col("id") > edges[j - 1])
        if j < len(edges):
            part = part.where(F.col("id") <= edges[j])
        got = index.add(part, last=j == len(edges))
        found = got if found is None else found.union(got)

    def by_text(t):
        code, ids = _arrays(t, np.ones(t.num_rows, int), 1)
        order = np.lexsort((code, ids))
        code, ids = code[order], ids[order]
        at = _begins(ids)
        return pa.table({"id": pa.array(ids[at[:-1]], pa.int64()),
                         "whole": pa.array([code[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())})

    whole = found.where("kind = 1").groupBy("owner").applyInArrow(by_text, "id bigint, whole binary")

    def unpack(t: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in t:
            for bucket, c, i in zip(b.column("bucket").to_pylist(), b.column("codes"), b.column("ids")):
                codes, ids = np.frombuffer(c.as_buffer(), np.int64), np.frombuffer(i.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), bucket, np.int32)), pa.array(codes)], ["id", "bucket", "code"])

    partly = found.where("kind = 2").select("bucket", "codes", "ids").mapInArrow(unpack, "id bigint, bucket int, code bigint").distinct()
    partly = partly.groupBy("id").agg(F.collect_list("code").alias("partly"))
    names = ["bucket", "codes", "ids", "left", "count", "bytes"]

    def contexts(t: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(t, "text"):
            data, offsets = utf8(b.column("text"))
            ids, wanted = b.column("id").to_numpy(), b.column("partly")
            flat = np.asarray(wanted.flatten().to_numpy(zero_copy_only=False)).astype(np.int64).view(_U)
            asked = np.repeat(np.arange(b.num_rows), [len(x) for x in wanted])
            parts = [(r, s, e, a, k, c) for r, s, e, a, k, c in anchors(data, offsets)]
            if not parts:
                continue
            row, s1, s2, at, key, code = (np.concatenate(x) for x in zip(*parts))
            hit = _places(row, code, asked, flat) >= 0
            row, s1, s2, at, key, code = (x[hit] for x in (row, s1, s2, at, key, code))
            # One of equal entries of a text is enough.
            bucket = _bucket(key, buckets * FINER)
            order = np.lexsort((code, row, bucket))
            order = order[np.concatenate(([True], (np.diff(code[order].view(np.int64)) != 0) | (np.diff(row[order]) != 0)))] if len(order) else order
            rows, edge = [], _begins(bucket[order])
            for x, y in zip(edge[:-1], edge[1:]):
                o = order[x:y]
                body = b"".join(data[p:q].tobytes() for p, q in zip(s1[o], s2[o] + LENGTH))
                rows.append((int(bucket[o[0]]), code[o].tobytes(), ids[row[o]].tobytes(), (at[o] - s1[o]).astype(np.uint8).tobytes(),
                             (s2[o] - s1[o] + 1).astype(np.uint8).tobytes(), body))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(
                    zip(*rows), (pa.int32(), *[pa.binary()] * 5))], names)

    text_of = docs.where("id IS NOT NULL")
    some = text_of.join(partly, "id").mapInArrow(contexts, "bucket int, codes binary, ids binary, left binary, count binary, bytes binary")
    masks = _compare(some).groupBy("id").agg(F.collect_list("code").alias("codes"), F.collect_list("mask").alias("masks"))
    info = written(whole.join(masks, "id", "full"), "repeats")
    copied = copies.select(F.col("id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).groupBy("id").agg(
        F.collect_set(F.struct("_h1", "_h2")).alias("_copies"))
    facts = written(info.join(copied, "id", "full"), "facts")
    joined = docs.join(facts, "id", "left").withColumn("_copy", F.coalesce(F.array_contains(
        "_copies", F.struct(F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(17), "text").alias("_h2"))), F.lit(False))).drop("_copies")

    def finish(t: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(t, "text"):
            data, offsets = utf8(b.column("text"))
            change = np.zeros(len(data) + 1, np.int32)
            told = np.flatnonzero(pc.or_(b.column("whole").is_valid(), b.column("codes").is_valid()).to_numpy(zero_copy_only=False))
            if len(told):
                some = b.take(pa.array(told))
                inner, places = utf8(some.column("text"))
                whole = [np.frombuffer(w.as_py() or b"", _U) for w in some.column("whole")]
                part = [np.array(c.as_py() or [], np.int64).view(_U) for c in some.column("codes")]
                bits = np.array([m for x in some.column("masks") for m in (x.as_py() or [])], np.int64).view(_U)
                own, every = np.repeat(np.arange(len(told)), [len(w) for w in whole]), np.concatenate(whole)
                partly, listed = np.repeat(np.arange(len(told)), [len(p) for p in part]), np.concatenate(part)
                shift = (offsets[told] - places[:-1])
                for row, s1, s2, at, _, code in anchors(inner, places):
                    s1, s2, at = s1 + shift[row], s2 + shift[row], at + shift[row]
                    hit = _places(row, code, own, every) >= 0
                    np.add.at(change, s1[hit], 1)
                    np.add.at(change, s2[hit] + LENGTH, -1)
                    where = _places(row, code, partly, listed)
                    near = np.flatnonzero(where >= 0)
                    for o in range(LENGTH - GRAM + 1):
                        on = near[(bits[where[near]] >> _U(o)) & _U(1) == 1]
                        np.add.at(change, at[on] - o, 1)
                        np.add.at(change, at[on] - o + LENGTH, -1)
            removed = np.cumsum(change[:-1]) > 0
            out = []
            copy = b.column("_copy").to_numpy(zero_copy_only=False)
            for i in range(b.num_rows):
                x, y = int(offsets[i]), int(offsets[i + 1])
                off = removed[x:y] if not copy[i] else np.ones(y - x, bool)
                kept = data[x:y][~off].tobytes()
                spans = int(off[0]) + int((off[1:] & ~off[:-1]).sum()) if len(off) else 0
                out.append((y - x, int(off.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, k) for x, k in zip(zip(*out), (
                pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.select("id", "text", "whole", "codes", "masks", "_copy").mapInArrow(
        finish, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)


def _places(row: np.ndarray, code: np.ndarray, own: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """For each (row, code), by rising row, the place of an equal pair in (own, listed), or -1."""
    out = np.full(len(code), -1)
    if not len(listed) or not len(code):
        return out
    order = np.lexsort((listed, own))
    own, listed = own[order], listed[order]
    begin = _begins(row)
    left = np.searchsorted(own, row[begin[:-1]])
    right = np.searchsorted(own, row[begin[:-1]], "right")
    for x, y, a, b in zip(begin[:-1], begin[1:], left, right):
        if a < b:
            place = a + np.searchsorted(listed[a:b], code[x:y])
            good = (place < b) & (listed[np.minimum(place, b - 1)] == code[x:y])
            out[x:y][good] = order[place[good]]
    return out
