"""Similarity join of shingle sets with PartEnum signatures.

Two sets link when their Jaccard similarity is at least ``NUM/DEN``.  Sets are
put into size bands; within an instance (two neighbouring bands) similar sets
differ in at most ``k`` shingles.  The shingle domain is cut into first-level
parts, so many that in some part similar sets differ by at most ``MISSED``
shingles; each part is cut into ``SECOND`` sub-parts, and every subset that
leaves out ``MISSED`` of them gives a signature of the shingles that fall into
it.  Similar sets therefore share a signature.  What shares one is a candidate
and is verified with the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.session import written

from .components import components
from .exprs import clear_of
from .text import mix, shingle_sets, slices, utf8

NUM, DEN = 4, 5
MISSED, SECOND = 1, 3
#: Signatures in one reduce group, on average.
GROUP = 1_500_000
#: Members of a signature that are compared with each other in one task.
BLOCK = 2048
#: Ids of texts to verify that may be broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
_U = np.uint64


def _ends(limit: int = 1 << 40) -> np.ndarray:
    """Largest sizes of the bands; sets two bands apart are never similar."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, out[-1] * DEN // NUM))
    return np.array(out)


ENDS = _ends()


def similar(size_a, size_b, common):
    return DEN * common >= NUM * (size_a + size_b - common)


def most_apart(total):
    """Largest symmetric difference of similar sets with ``total`` shingles together."""
    return total * (DEN - NUM) // (DEN + NUM)


@dataclass(frozen=True)
class Instance:
    parts: int             # first-level parts
    sure: int              # of these, parts that similar sets at least have in agreement
    bounds: np.ndarray     # where sub-parts begin in the range of hashes
    subsets: np.ndarray    # (subsets, SECOND) whether a sub-part is in the subset
    tags: np.ndarray       # (parts, subsets)


@lru_cache(maxsize=None)
def instance(i: int) -> Instance:
    """Parts for the bands ``i - 1`` and ``i``.

    There are some parts more than the pigeonhole needs, so that a set with few
    empty subsets need not emit signatures of nothing, which many share.
    """
    k = int(most_apart(2 * int(ENDS[i])))
    if k == 0:
        parts, sure, second, left = 1, 1, 1, 0
    else:
        need = k // (MISSED + 1)
        sure = 1 + (need + 8) // 10 + (2 if need > 3 else 0)
        parts, second, left = need + sure, SECOND, MISSED
    n = parts * second
    bounds = np.array([(j << 64) // n for j in range(1, n)], _U)
    subsets = np.array([[j in c for j in range(second)] for c in combinations(range(second), second - left)])
    tags = mix(np.arange(parts * len(subsets), dtype=np.uint64) + _U(((i + 1) << 40) & (2 ** 64 - 1)))
    return Instance(parts, sure, bounds, subsets, tags.reshape(parts, -1))


def signatures(own: np.ndarray) -> np.ndarray:
    """Signatures of one set (sorted hashes), for its two instances."""
    band = int(np.searchsorted(ENDS, len(own)))
    total = np.zeros(len(own) + 1, _U)
    np.cumsum(mix(own ^ _U(0xA5A5A5A5A5A5A5A5)), out=total[1:])
    out = []
    for i in (band, band + 1):
        plan = instance(i)
        edge = np.concatenate(([0], np.searchsorted(own, plan.bounds), [len(own)]))
        value = (total[edge[1:]] - total[edge[:-1]]).reshape(plan.parts, -1)
        filled = (edge[1:] > edge[:-1]).reshape(plan.parts, -1)
        chosen = value @ plan.subsets.T.astype(_U)
        some = filled @ plan.subsets.T
        sig = mix(chosen + plan.tags)
        # Enough parts in agreement have no empty subset: signatures of nothing are not needed.
        out.append(sig[some] if (~some).any(1).sum() < plan.sure else sig.ravel())
    return np.concatenate(out)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of the hashes in buckets, two to four per shingle: sets differ by
    at least as many shingles as their sketches do in bits.  A sketch is folded
    to half its size by xor of its halves."""
    bits = max(64, 1 << int(2 * len(own) - 1).bit_length()) if len(own) else 64
    odd = np.bincount((mix(own) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def _fold(data: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8)
    while len(x) > size:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x


def shingle_table(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """Rows ``(doc_id, n_shingles, h1, h2, sketch)``: the size, a hash of the whole set, and its sketch."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            rows = [(len(s), int(mix(s).sum(dtype=_U).astype(np.int64)),
                     int(mix(s ^ _U(0x1234567)).sum(dtype=_U).astype(np.int64)), sketch(s).tobytes())
                    for s in shingle_sets(*utf8(b.column(text)), k)]
            n, h1, h2, sk = zip(*rows)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(n, pa.int64()), pa.array(h1, pa.int64()),
                                              pa.array(h2, pa.int64()), pa.array(sk, pa.binary())],
                                             ["doc_id", "n_shingles", "h1", "h2", "sketch"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(
        measure, f"doc_id {kind}, n_shingles bigint, h1 bigint, h2 bigint, sketch binary")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _runs(keys: np.ndarray) -> np.ndarray:
    """Begins of runs of equal values, and the end."""
    return np.concatenate((np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), [len(keys)]))


def signature_blobs(docs: DataFrame, id_col: str, text: str, k: int, buckets: int) -> DataFrame:
    """Signatures of all sets, packed per slice of texts and bucket: rows
    ``(bucket, kind, left, right)`` of signatures and ids (kind 0) and of links
    found already within a slice (kind 1).

    Within a slice the members of a signature that are verified to be similar to
    its first one are represented by it: a signature that a third of all texts
    share arrives as one entry per slice.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            known = b.column(id_col).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(id_col).fill_null(0).to_numpy()
            sets = list(shingle_sets(*utf8(b.column(text)), k))
            parts = [signatures(s) if len(s) and ok else np.zeros(0, _U) for s, ok in zip(sets, known)]
            sig = np.concatenate(parts)
            who = np.repeat(np.arange(len(sets)), [len(p) for p in parts])
            if not len(sig):
                continue
            order = np.argsort(sig, kind="stable")
            s, w = sig[order], who[order]
            begin = _runs(s)
            first = np.repeat(w[begin[:-1]], np.diff(begin))
            pair = np.unique(first[w != first] * len(sets) + w[w != first])
            left, right = pair // len(sets), pair % len(sets)
            good = np.array([similar(len(sets[x]), len(sets[y]), _common(sets[x], sets[y])) for x, y in zip(left, right)], bool)
            linked = pair[good] if len(pair) else pair
            hidden = (w != first) & np.isin(first * len(sets) + w, linked)
            kept = np.sort(order[~hidden])  # by text again: equal ids stand together
            sig, who = sig[kept], who[kept]
            bucket = ((sig >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, low, own = bucket[order], sig[order].astype(np.uint32), ids[who[order]]
            at = _runs(bucket)
            rows = [(int(bucket[x]), 0, low[x:y].tobytes(), own[x:y].tobytes()) for x, y in zip(at[:-1], at[1:])]
            if len(linked):
                x, y = ids[linked // len(sets)], ids[linked % len(sets)]
                rows.append((int(mix(x[:1].astype(_U))[0] % _U(buckets)), 1, x.tobytes(), y.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "kind", "left", "right"])
    return docs.select(id_col, text).mapInArrow(emit, "bucket int, kind int, left binary, right binary")


def shared_signatures(blobs: DataFrame) -> DataFrame:
    """Per bucket, rows ``(kind, x, y, n)``: members ``(group, id)`` of
    signatures with several ids (0), pairs of a signature's least id with the
    others and their number of signatures in the bucket (1), links (2).

    Similar sets share many signatures, mostly with the same members: a group is
    named by a hash of its members, so that equal ones count as one."""
    def reduce(key, t):
        kind = t.column("kind").to_numpy()
        left, right = t.column("left").to_pylist(), t.column("right").to_pylist()
        sig = np.frombuffer(b"".join(l for l, q in zip(left, kind) if q == 0), np.uint32)
        own = np.frombuffer(b"".join(r for r, q in zip(right, kind) if q == 0), np.int64)
        a = np.frombuffer(b"".join(l for l, q in zip(left, kind) if q == 1), np.int64)
        b = np.frombuffer(b"".join(r for r, q in zip(right, kind) if q == 1), np.int64)
        order = np.argsort(sig, kind="stable")
        sig, own = sig[order], own[order]
        same = np.concatenate(([False], sig[1:] == sig[:-1])) if len(sig) else np.zeros(0, bool)
        several = same.copy()
        several[:-1] |= same[1:]
        sig, own = sig[several], own[several]
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        if len(sig):
            new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])))
            sig, own = sig[new], own[new]
        begin = _runs(sig) if len(sig) else np.zeros(1, np.int64)
        size = np.diff(begin)
        keep = np.repeat(size > 1, size)
        least = np.repeat(own[begin[:-1]], size)
        star = keep & (own != least)
        pairs, count = np.unique(np.stack([least[star], own[star]]), axis=1, return_counts=True)
        # One group of members is told once, under the sum of its ids' hashes.
        names = np.add.reduceat(mix(own), begin[:-1]) if len(sig) else np.zeros(0, _U)
        first = np.zeros(len(names), bool)
        first[np.unique(names, return_index=True)[1]] = True
        told = np.repeat((size > 1) & first, size)
        marked = np.repeat(names, size)[told].astype(np.int64)
        n = [len(marked), pairs.shape[1], len(a)]
        return pa.table({"kind": np.repeat(np.array([0, 1, 2], np.int32), n), "x": np.concatenate((marked, pairs[0], a)),
                         "y": np.concatenate((own[told], pairs[1], b)),
                         "n": np.concatenate((np.zeros(n[0], np.int64), count, np.zeros(n[2], np.int64)))})
    return blobs.groupBy("bucket").applyInArrow(reduce, "kind int, x bigint, y bigint, n bigint")


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """Of the pairs ``(a, b)`` (a written table) those whose sets are similar.

    Only the texts in pairs are read into sets again.  Their ids are broadcast
    if there are at most ``BROADCAST_IDS``, else joined by a shuffle.
    """
    ids = written(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), "pair-ids")
    few = ids.count() <= BROADCAST_IDS
    needed = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(ids) if few else ids, "_id", "left_semi")

    def collect_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            blobs = [s.tobytes() for s in shingle_sets(*utf8(b.column("_text")), k)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(blobs, pa.binary())], ["_id", "_set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("_set_a"), b.column("_set_b")):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                good.append(bool(similar(len(p), len(q), _common(p, q))))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    sets = written(needed.mapInArrow(collect_set, "_id bigint, _set binary"), "pair-sets")
    both = pairs.select("a", "b").join(sets.select(F.col("_id").alias("a"), F.col("_set").alias("_set_a")), "a").join(
        sets.select(F.col("_id").alias("b"), F.col("_set").alias("_set_b")), "b")
    return both.mapInArrow(compare, "a bigint, b bigint")


def unresolved_pairs(members: DataFrame, hidden: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of ids of different components that share a signature and whose
    sizes and sketches do not rule out that they are similar.

    ``members`` are ``(sig, id)``, ``hidden`` ``(id, other)`` the ids that others
    stand for, ``labels`` ``(id, component)``, ``sets`` ``(id, n, sketch)`` (all
    written).  A signature with very many members is compared in blocks of a
    bounded size, each pair of blocks a task's work.
    """
    labelled = written(members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "members")
    open_ = labelled.groupBy("sig").agg(F.min("component").alias("_l"), F.max("component").alias("_h")).where("_l <> _h")
    left = written(labelled.join(written(open_.select("sig"), "open"), "sig", "left_semi"), "open-members")
    behind = left.join(hidden, "id").select("sig", F.col("other").alias("id"), "component")
    whole = left.select("sig", "id", "component").union(behind).distinct()
    whole = written(whole.join(sets, "id"), "open-sets")
    sizes = written(whole.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")), "open-sizes")
    total = sizes.agg(F.sum(F.col("_blocks") * F.col("_blocks"))).first()[0] or 0
    tasks = max(1, total * 64 // BLOCK, whole.count() // 100_000)
    mine = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    dealt = whole.join(sizes, "sig").withColumn("_own", mine).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn(
        "_x", F.least("_own", "_other")).withColumn("_y", F.greatest("_own", "_other")).withColumn(
        "_task", F.pmod(F.xxhash64("sig", "_x", "_y"), F.lit(tasks)))

    def compare(t):
        sig, own = t.column("sig").to_numpy(), t.column("id").to_numpy()
        comp, n = t.column("component").to_numpy(), t.column("n").to_numpy()
        x, y, o = t.column("_x").to_numpy(), t.column("_y").to_numpy(), t.column("_own").to_numpy()
        marks = t.column("sketch").to_pylist()
        order = np.lexsort((own, y, x, sig))
        step = np.stack([sig[order], x[order], y[order]])
        begin = np.concatenate(([0], np.flatnonzero((step[:, 1:] != step[:, :-1]).any(0)) + 1, [len(order)]))
        found: set[tuple[int, int]] = set()
        for s, e in zip(begin[:-1], begin[1:]):
            at = order[s:e]
            small = min(len(marks[i]) for i in at)
            bits = np.stack([_fold(marks[i], small) for i in at])
            for j in range(len(at) - 1):
                rest = at[j + 1:]
                apart = np.bitwise_count(bits[j + 1:] ^ bits[j]).sum(1, dtype=np.int64)
                ok = (comp[rest] != comp[at[j]]) & (apart <= most_apart(n[rest] + n[at[j]]))
                ok &= DEN * np.minimum(n[rest], n[at[j]]) >= NUM * np.maximum(n[rest], n[at[j]])
                ok &= (x[at[j]] == y[at[j]]) | (o[rest] != o[at[j]])
                found.update((min(int(own[at[j]]), int(i)), max(int(own[at[j]]), int(i))) for i in own[rest[ok]])
        a, b = zip(*sorted(found)) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.select("_task", "sig", "id", "component", "n", "sketch", "_x", "_y", "_own").groupBy("_task").applyInArrow(
        compare, "a bigint, b bigint").distinct()


def join_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """Per row of ``docs``: the id, ``n_shingles`` and ``component_id``, the least
    id that similarity links lead to.

    The result is exact.  A null, empty or blank text has an empty set and no
    links; a text with fewer than ``k`` words has one shingle.  Repeated rows are
    all kept; rows that share an id are one document for linking.  A null id has
    no links and a null component.  Columns other than id and text are ignored.
    Ids are whole numbers.

    Equal sets are linked by a hash of 128 bits.  Of the others, first one pair
    per text (the one with most signatures in common) is verified; signatures
    whose members are then still in different components are compared in full.
    Runs its jobs while it is built; their tables go to the shared folder.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    docs_args = (docs, "doc_id", "_text", k)
    table = written(shingle_table(*docs_args), "sets")
    filled = table.where("doc_id IS NOT NULL AND n_shingles > 0")
    total = filled.agg(F.sum("n_shingles")).first()[0] or 0
    equal = written(filled.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("_m"))
                    .where("rep <> _m").drop("_m"), "equal-sets")
    same = written(filled.select("h1", "h2", "n_shingles", "doc_id").join(equal, ["h1", "h2", "n_shingles"]).where(
        "doc_id <> rep").select("doc_id", "rep").distinct(), "copies")
    links = same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # Copies need no signatures; an id with several sets keeps those of all its texts.
    several = filled.groupBy("doc_id").agg(F.min("h1").alias("_l"), F.max("h1").alias("_h")).where("_l <> _h").select("doc_id")
    alike = written(same.select("doc_id").distinct().join(several, "doc_id", "left_anti"), "alike")
    few = alike.count() <= BROADCAST_IDS
    unlike = docs.join(F.broadcast(alike) if few else alike, "doc_id", "left_anti")

    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // GROUP)
    shared = written(shared_signatures(signature_blobs(unlike, "doc_id", "_text", k, buckets)), "signatures")
    local = shared.where("kind = 2").select(F.col("x").alias("a"), F.col("y").alias("b"))

    star = shared.where("kind = 1").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("n").alias("n"))
    best = star.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    near = written(verified(written(best.select("a", "b"), "first-pairs"), *docs_args), "first-links")
    found = written(links.union(local).union(near), "links-1")
    labels = written(components(found).withColumnRenamed("node", "id"), "labels-1")

    members = shared.where("kind = 0").select(F.col("x").alias("sig"), F.col("y").alias("id")).distinct()
    hidden = written(local.select(F.col("a").alias("id"), F.col("b").alias("other")).distinct(), "hidden")
    sizes = written(filled.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["id", "n", "sketch"]), "sketches")
    rest = written(unresolved_pairs(members, hidden, labels, sizes), "second-pairs")
    more = written(verified(rest, *docs_args), "second-links")
    labels = written(components(found.union(more)), "labels")
    return table.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """``docs`` with one document of each group of similar ones, that with the
    least id; rows without an id or without words all stay."""
    joined = join_similar(docs, id_col, text, k).where(f"component_id <> `{id_col}`").select(id_col).distinct()
    return docs.join(written(joined, "similar"), id_col, "left_anti")
