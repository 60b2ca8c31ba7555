"""Centroid clustering, periodic runs and source mixing against brute force and on odd input."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import mixing, runs, vafile
from cohortlens.llm.queries import with_periodic_tails

from .test_text_operators import WORD

# ---- centroid clustering -------------------------------------------------------


def brute_clusters(rows, k, rounds, dims, scale=256):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    told = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (told(r[0]), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        near = [min((square(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if step < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, c) in zip(kept, near) if c == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    share = [sum(d for d, c in near if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((-1 if i is None else i), c, d, share[c], sum(share), digest[c]) for (i, _), (d, c) in zip(kept, near))


def clusters(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id bigint, embedding array<float>, `row` string, v int")
    out = vafile.centroid_clusters(df, **options)
    assert out.columns == ["vec_id", "embedding", "row", "v", *vafile.RESULT]
    return sorted(((-1 if r.vec_id is None else r.vec_id), *[r[c] for c in vafile.RESULT]) for r in out.collect())


def test_clusters_agree_with_plain_k_means(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.gauss(i % 3, 0.4))) for _ in range(5)]) for i in range(150)]
    rows += [(500, [0.0] * 5), (500, [0.0] * 5), (500, [1.0] * 5), (None, [0.5] * 5)]   # repeated ids and rows, a null id
    rows += [(600, None), (601, []), (602, [1.0] * 4), (603, [1.0, None, 1.0, 1.0, 1.0]), (604, [float("nan")] * 5),
             (605, [float("inf")] * 5)]
    for bits in (1, 6):
        assert clusters(spark, rows, k=7, rounds=3, dims=5, bits=bits) == brute_clusters(rows, 7, 3, 5)
    assert clusters(spark, rows[:4], k=7, rounds=2, dims=5) == brute_clusters(rows[:4], 7, 2, 5)
    assert clusters(spark, [], k=7, dims=5) == [] == clusters(spark, rows[-6:], k=7, dims=5)


def test_ties_and_large_components(spark):
    rows = [(i, [0.25, 0.25]) for i in range(30)]                 # every distance ties
    assert clusters(spark, rows, k=4, rounds=2, dims=2) == brute_clusters(rows, 4, 2, 2)
    out = clusters(spark, [(1, [3e38, -3e38]), (2, [0.0, 0.0]), (3, [3e38, -3e38])], k=2, rounds=1, dims=2)
    assert len(out) == 3 and all(0 <= r[2] < 1 << 62 for r in out)


def test_intervals_hold_every_distance():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-300, 300, (400, 6)), rng.integers(-200, 200, (9, 6))
    cells = vafile.Cells(x[:50], x.min(axis=0), x.max(axis=0), 3)
    near, far = cells.tables(c)
    codes, own = cells.encode(x), (x * x).sum(axis=1)[:, None]
    exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    least, most = (sum(t[d][codes[:, d]] for d in range(6)) + own for t in (near, far))
    assert (least <= exact).all() and (exact <= most).all()
    may = vafile.decide(codes, near, far)
    assert may[np.arange(400), exact.argmin(axis=1)].all() and may.sum() < may.size / 2


# ---- periodic runs ---------------------------------------------------------------

def brute_lyndon(s):
    def is_lyndon(w):
        return all(w < w[j:] for j in range(1, len(w)))
    return [max(m for m in range(1, len(s) - i + 1) if is_lyndon(s[i:i + m])) for i in range(len(s))]


def brute_runs(w, least=6, exponent=4):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q) and not any(
                    q % r == 0 and all(w[x] == w[x + r] for x in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def word_texts(rng, count, most):
    for _ in range(count):
        words = [f"w{rng.randrange(rng.choice((1, 2, 3, 9)))}" for _ in range(rng.randrange(most))]
        if words and rng.random() < 0.6:
            part = words[-rng.randrange(1, 7):]
            words += (part * 9)[:rng.randrange(30)]
        yield words


def test_lyndon_arrays_of_both_orders():
    rng = random.Random(9)
    for _ in range(60):
        texts = [[rng.randrange(rng.choice((1, 2, 4))) for _ in range(rng.randrange(25))] for _ in range(rng.randrange(1, 4))]
        numbers, at = np.array([x for t in texts for x in t], np.int64), np.cumsum([0, *map(len, texts)])
        arrays = np.ones(2 * len(numbers) + 1, np.int64)
        runs.lyndon_chains(numbers, at, 1, arrays)
        for d, t in enumerate(texts):
            assert list(arrays[at[d]:at[d + 1]]) == brute_lyndon(t)
            assert list(arrays[len(numbers) + at[d]:len(numbers) + at[d + 1]]) == brute_lyndon([-x for x in t])


def collapsed(words, found):
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_agree_with_plain_search(spark):
    rng = random.Random(12)
    texts = [" \t".join(w) for w in word_texts(rng, 250, 40)] + [None, "", " \n ", "a a a a a", "a a a a a a", "é b " * 9,
                                                                 "x " * 30, "x " * 30, "A a " * 8, "\x1c " * 7]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, Runs string")
    for least, exponent in ((6, 4), (2, 2)):
        out = runs.periodic_runs(df, min_length=least, min_exponent=exponent)
        assert out.columns == ["doc_id", "text", "runs", "collapsed"]
        rows = out.collect()
        assert len(rows) == len(texts)
        for r in rows:
            words = WORD.findall(r.text or "")
            want = brute_runs(words, least, exponent)
            assert [tuple(x) for x in r.runs] == want and r.collapsed == collapsed(words, want)
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_very_long_text_and_long_period(spark):
    rng = random.Random(5)
    period = [f"v{rng.randrange(1000)}" for _ in range(20_000)]
    words = [f"u{i}" for i in range(3000)] + (period * 5)[:90_007] + ["end"] + ["so"] * 60_000
    df = spark.createDataFrame([(1, " ".join(words)), (2, "a " * 9)], "doc_id bigint, text string")
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in runs.periodic_runs(df).collect()}
    assert found == {1: [(3000, 90_007, 20_000), (93_008, 60_000, 1)], 2: [(0, 9, 1)]}


def test_tails_repeat_by_the_rule(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(w) if w else None) for i, w in enumerate(word_texts(rng, 300, 60))] + [(None, "a b c d")]
    out = {r.doc_id: r.text for r in with_periodic_tails(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    for i, t in texts[:-1]:
        w, h = WORD.findall(t or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert out[i].split() == [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        else:
            assert (out[i] or "") == (t or "")


# ---- mixing ------------------------------------------------------------------------

def brute_mix(rows, weights=(5, 2, 1), most=3, seed="mix"):
    """Targets by lowering the share of full sources, words by walking each source's order."""
    names = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    size = {s: sum(len(WORD.findall(t or "")) for _, x, t in rows if x == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        left, shares = total - sum(most * size[s] for s in full), sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * weight[s] > most * size[s] * shares}
        if not over:
            break
        full |= over
    budget = {s: most * size[s] if s in full else left * weight[s] // shares for s in names}
    target = {s: float(most * size[s]) if s in full else left * weight[s] / shares for s in names}
    out = []
    for s in names:
        key = lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest()[:15], r[0], len(WORD.findall(r[2] or "")))
        own, at = sorted((r for r in rows if r[1] == s), key=key), 0
        passes, rest = divmod(budget[s], size[s]) if size[s] else (0, 0)
        for r in own:
            n = len(WORD.findall(r[2] or ""))
            out.append((r[0], n, size[s], target[s], at, passes * n + max(0, min(n, rest - at))))
            at += n
    return sorted(out)


def mix_rows(seed, n=400):
    rng = random.Random(seed)
    sources = ["big"] * 6 + ["é", "z", "Z", "", "~", None, None, "tiny1"]
    return [(i, rng.choice(sources), rng.choice([None, "", " ".join(["w"] * rng.randrange(1, 50))])) for i in range(n)] + [
        (1000, "rare", "one two three"), (1001, "empty", None), (1002, "rare2", "one")]


def test_mix_agrees_with_plain_walk(spark):
    for seed, span in ((1, 100_000), (2, 7)):
        rows = mix_rows(seed)
        df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id bigint, source string, text string, _key int, Size string")
        mixed = mixing.mix(df, range_rows=span)
        assert mixed.columns == ["doc_id", "source", "text", "_key", "size", "source_size", "target", "start", "taken"]
        got = sorted((r.doc_id, r["size"], r.source_size, r.target, r.start, r.taken) for r in mixed.collect())
        assert got == brute_mix(rows)
        per_source = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max(
            F.col("taken") - 3 * F.col("size")).alias("over")).collect()
        assert all(0 <= r.g - r.t < 1 and r.over <= 0 for r in per_source)
    texts = mixing.mixed_texts(mixed).select("doc_id", "pass_no", "text", "taken").collect()
    for d, taken in {(r.doc_id, r.taken) for r in texts}:
        own = sorted((r.pass_no, len(WORD.findall(r.text))) for r in texts if r.doc_id == d)
        assert sum(n for _, n in own) == taken and [p for p, _ in own] == list(range(len(own)))


def test_mix_of_repeats_nulls_and_nothing(spark):
    schema = "doc_id bigint, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, "a", None), (None, None, "")], schema)).collect()
    assert [(r["size"], r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2
    rows = [(None, "a", "x y"), (None, "a", "x y"), (3, None, "x y z"), (3, None, "x y z"), (4, "b", "q")]
    mixed = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert sum(r.taken for r in mixed) in range(9, 12) and all(r.taken <= 3 * r["size"] for r in mixed)
