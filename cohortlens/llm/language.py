"""Language identification by the nearest of several centroids per language.

A text is a vector of byte n-gram counts, hashed to a fixed number of features,
damped, weighted by inverse document frequency and brought to unit length.  Each
language has a few centroids from spherical k-means over a bounded sample of
labelled texts.  A text takes the language of the most similar centroid and is
rejected if it is farther from all of them than labelled texts of its length are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cohortlens.session import written

from .exprs import clear_of
from .text import slices, utf8

FEATURES = 1 << 12
#: Upper ends of the length classes (in n-grams) that have a distance limit of their own.
LENGTHS = (25, 50, 100, 200, 400, 800, 1600)
#: Lengths (in bytes) at which sample texts are cut to learn those limits.
CUTS = (25, 100, 400)
UNKNOWN = "und"


def _kinds() -> np.ndarray:
    """Byte values as they count: letters in lower case and all bytes beyond
    ASCII as they are, everything else as a space."""
    out = np.full(256, 32, np.uint32)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


_KIND = _kinds()


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of byte 1- to 3-grams per text, hashed; runs of other characters count as one space."""
    n = len(offsets) - 1
    kind = _KIND[data]
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != 32) | (kind[:-1] != 32) | (row[1:] != row[:-1])
    kind, row = kind[keep], row[keep]
    out = np.zeros(n * FEATURES, np.float32)
    for size in (1, 2, 3):
        m = len(kind) - size + 1
        if m <= 0:
            continue
        code = np.full(m, size, np.uint32)
        for j in range(size):
            code = code * np.uint32(0x01000193) ^ (kind[j:j + m] * np.uint32(0x9E3779B1))
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        place = row[:m] * FEATURES + (code >> np.uint32(20)).astype(np.int64)
        inside = row[:m] == row[size - 1:]
        out += np.bincount(place[inside], minlength=n * FEATURES).astype(np.float32)
    return out.reshape(n, FEATURES)


@dataclass(frozen=True)
class Model:
    languages: list[str]      # of each centroid
    idf: np.ndarray           # per feature
    centroids: np.ndarray     # unit vectors
    limits: np.ndarray        # least similarity per centroid and length class

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest centroid, its cosine, and whether it is too far."""
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        return best, score, score < self.limits[best, _length_class(counts)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _length_class(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, counts.sum(1) / 3)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` different labelled texts of every language, chosen
    by a hash of their words alone.

    The bound is this parameter, whatever the size of the data: every language
    keeps the texts with the least hashes, one of each, however many copies there
    are.  Runs small jobs for the greatest hash that each language keeps.
    """
    marked = labelled.select("lang", "text", F.xxhash64("text").alias("_h"))
    hashes = written(marked.select("lang", "_h").distinct(), "language-hashes")
    sizes = hashes.groupBy("lang").agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))

    def ends(few: DataFrame) -> DataFrame:
        ranked = few.withColumn("_r", rank).where(F.col("_r") <= per_language)
        return written(ranked.groupBy("lang").agg(F.max("_h").alias("_end"), F.max("_r").alias("_r"), F.first("_n").alias("_n")), "language-ends")

    # Among about four times as many of the least hashes as wanted; all of them if that is too few.
    placed = hashes.join(F.broadcast(sizes), "lang")
    below = (4.0 * per_language / F.col("_n") * 2.0 ** 64 - 2.0 ** 63).cast("bigint")
    last = ends(placed.where((F.col("_n") <= 4 * per_language) | (F.col("_h") <= below)))
    if last.where(F.col("_r") < F.least("_n", F.lit(per_language))).count() or last.count() < sizes.count():
        last = ends(placed)
    # A row per language.
    near = marked.join(F.broadcast(last.select("lang", "_end")), "lang").where("_h <= _end")
    return near.dropDuplicates(["lang", "_h"]).select("lang", "text")


def fit(labelled: DataFrame, per_language: int = 250, centroids: int = 4, rounds: int = 12,
        margin: float = 0.3) -> Model | None:
    """A model from rows ``(lang, text)``; None without a labelled text.

    At most ``per_language`` texts a language are used (bounded sample of
    labelled rows), of every language there is.  Their feature counts, 20 KB for
    each text, are written, and each language's centroids are found in a task of
    their own; only centroids and limits come to the driver: 64 KB a language.
    A length class's limit is ``margin`` times the least similarity of pieces of
    the sample of that length; a text of the shortest class shows too little to
    be rejected.
    """
    rows = sample(labelled.where("lang IS NOT NULL AND text IS NOT NULL"), per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            data, offsets = utf8(_lowered(b.column("text")))
            full = np.minimum(features(data, offsets), 65535).astype(np.uint16)
            # The same texts cut short, for the distance limits of short texts.
            cut = []
            for end in CUTS:
                size = np.minimum(np.diff(offsets), end)
                part = np.concatenate([data[o:o + s] for o, s in zip(offsets[:-1], size)] or [data[:0]])
                cut.append(np.minimum(features(part, np.concatenate(([0], np.cumsum(size)))), 255).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), pa.array([r.tobytes() for r in full], pa.binary()),
                 pa.array([np.stack(r).tobytes() for r in zip(*cut)], pa.binary())], ["lang", "counts", "cut"])

    table = written(rows.mapInArrow(count, "lang string, counts binary, cut binary"), "language-counts")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for c in b.column("counts"):
                total += np.frombuffer(c.as_buffer(), np.uint16) > 0
                n += 1
        # The last row counts texts.
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(np.append(total, n))], ["feature", "n"])

    found = table.select("counts").mapInArrow(present, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    seen = np.zeros(FEATURES + 1, np.int64)
    for feature, n in found.collect():
        seen[feature] = n
    if not seen[-1]:
        return None
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])).astype(np.float32) + np.float32(0.1)

    def learn(t: pa.Table) -> pa.Table:
        # The least bytes first: the result does not depend on the order of the rows.
        got = sorted(zip(t.column("counts").to_pylist(), t.column("cut").to_pylist()))
        counts = np.stack([np.frombuffer(c, np.uint16) for c, _ in got]).astype(np.float32)
        cuts = np.stack([np.frombuffer(c, np.uint8).reshape(-1, FEATURES) for _, c in got])
        center, least = _centroids(counts, cuts, idf, centroids, rounds)
        return pa.table({"lang": t.column("lang").slice(0, 1), "size": pa.array([len(center)]),
                         "centroids": pa.array([center.tobytes()], pa.binary()), "least": pa.array([least.tobytes()], pa.binary())})

    learnt = table.groupBy("lang").applyInArrow(learn, "lang string, size bigint, centroids binary, least binary")
    got = sorted(learnt.collect(), key=lambda r: r["lang"])
    return Model([r["lang"] for r in got for _ in range(r["size"])], idf,
                 np.frombuffer(b"".join(r["centroids"] for r in got), np.float32).reshape(-1, FEATURES),
                 np.frombuffer(b"".join(r["least"] for r in got)).reshape(-1, len(LENGTHS) + 1) * margin)


def _centroids(counts: np.ndarray, cuts: np.ndarray, idf: np.ndarray, centroids: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of one language's texts, and the least similarity of its pieces per centroid and length class."""
    own = _unit(np.log1p(counts) * idf)
    center = own[np.linspace(0, len(own) - 1, min(centroids, len(own))).astype(int)]
    for _ in range(rounds):
        near = (own @ center.T).argmax(1)
        center = _unit(np.stack([own[near == c].sum(0) if (near == c).any() else center[c] for c in range(len(center))]))
    center = center.astype(np.float32)
    least = np.full((len(center), len(LENGTHS) + 1), np.inf)
    for part in [counts, *(cuts[:, j].astype(np.float32) for j in range(cuts.shape[1]))]:
        cosine = _unit(np.log1p(part) * idf) @ center.T
        np.minimum.at(least, (cosine.argmax(1), _length_class(part)), cosine.max(1))
    # The limit never falls with length; a class without a labelled text takes that of shorter ones.
    least[:, 0] = 0
    for j in range(1, least.shape[1]):
        least[:, j] = np.where(np.isinf(least[:, j]), least[:, j - 1], np.maximum(least[:, j], least[:, j - 1] * 0.9))
    return center, least


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Every column of ``docs``, ``lang_pred``, ``score`` and ``rejected``.

    ``lang_pred`` is the language of the nearest centroid, ``und`` (score 0,
    rejected) for a null text or one without letters, and for every text if the
    model is None.  ``score`` is the cosine.  Only the text is looked at; repeated
    rows get equal results, and columns with the added names are replaced.
    """
    docs = clear_of(docs, ["lang_pred", "score", "rejected"])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages) if model else None
        for b in slices(batches, text, 1 << 20):
            column = b.column(text)
            letters = pc.match_substring_regex(column.cast(pa.large_string()), r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            lang = np.full(len(letters), UNKNOWN, object)
            score, far = np.zeros(len(letters)), np.ones(len(letters), bool)
            if model is not None and letters.any():
                data, offsets = utf8(_lowered(column))
                # A slice is one long text or some short ones: rows of counts are bounded by blocks.
                for a in range(0, len(letters), 512):
                    z = min(a + 512, len(letters))
                    best, s, f = model.predict(features(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a]))
                    lang[a:z], score[a:z], far[a:z] = names[best], s, f
                lang[~letters], score[~letters], far[~letters] = UNKNOWN, 0.0, True
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(far)],
                                             [*b.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(label, schema)
