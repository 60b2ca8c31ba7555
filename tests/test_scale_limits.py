"""Operators on both sides of limits they once had."""

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import graph, missing, ordering, views


def _brute_combinations(held, names, max_size):
    return {"&".join(c): sum(set(c) <= h for h in held.values())
            for size in range(1, max_size + 1) for c in combinations(names, size)}


@pytest.mark.parametrize("k,max_size", [(1, None), (4, None), (5, 2), (9, None), (22, 3), (62, 2)])
def test_combinations_of_many_instruments(spark, k, max_size):
    rng = np.random.default_rng(k)
    names = [f"n{i}" for i in range(k)]
    held = {s: {n for n in names if rng.random() < 0.4} for s in range(60)}
    rows = [(s, n) for s, h in held.items() for n in h for _ in range(2)] + [(999, "other"), (None, names[0])]
    got = views.combination_counts(spark.createDataFrame(rows, "subjectkey int, instrument string"), names, max_size)
    want = _brute_combinations({**held, None: {names[0]}}, names, max_size or k)
    found = got.collect()
    assert {r["combination"]: r["subjects"] for r in found} == want and len(found) == len(want)
    assert all(r["size"] == r["combination"].count("&") + 1 for r in found)


def test_all_combinations_of_22_instruments(spark):
    names = [f"n{i}" for i in range(22)]
    rows = spark.createDataFrame([(1, n) for n in names] + [(2, "n0"), (2, "n21")], "subjectkey int, instrument string")
    out = views.combination_counts(rows, names)
    assert out.agg(F.count("*"), F.sum("subjects")).first()[:] == ((1 << 22) - 1, (1 << 22) - 1 + 3)


def test_combinations_without_members(spark):
    out = views.combination_counts(spark.createDataFrame([], "subjectkey int, instrument string"), ["a", "b"])
    assert sorted((r["combination"], r["subjects"]) for r in out.collect()) == [("a", 0), ("a&b", 0), ("b", 0)]
    with pytest.raises(ValueError):
        views.combination_counts(out, [str(i) for i in range(63)])


def _values(kind, rng, n):
    if kind == "many":
        return rng.normal(size=n)
    if kind == "ties":  # nine tenths share one value
        return np.where(rng.random(n) < 0.9, 3.0, rng.normal(size=n) * 10)
    return rng.integers(0, 3, n).astype(float)


@pytest.mark.parametrize("kind", ["many", "ties", "few"])
def test_quantiles_narrow_until_bounded(spark, monkeypatch, kind):
    monkeypatch.setattr(ordering, "SKETCH_ACCURACY", 50)
    monkeypatch.setattr(ordering, "SMALL_GROUP", 40)
    monkeypatch.setattr(ordering, "GRID", 50)
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": rng.choice(["a", "b", None], 30_000, p=[0.9, 0.05, 0.05]), "x": _values(kind, rng, 30_000)})
    widest = []
    narrow = ordering._narrow

    def watched(data, keys, brackets):
        out = narrow(data, keys, brackets)
        lo, hi, v = F.col("b.lo"), F.col("b.hi"), F.col("_v")
        inside = (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))
        each = ordering.join_summary(data, out, keys).select(*keys, "_v", F.explode("_b").alias("b"))
        widest.append(each.where(inside).groupBy(*keys, "b.prob").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(ordering, "_narrow", watched)
    probs = [0.0, 0.003, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = ordering.exact_quantiles(spark.createDataFrame(frame).repartition(4), ["g"], "x", probs).collect()
    assert widest and (widest[0] or 0) <= 40
    assert len(got) == 3 * len(probs)
    for r in got:
        x = frame.x[frame.g.isna() if r["g"] is None else frame.g == r["g"]]
        assert r["quantile"] == pytest.approx(np.quantile(x, r["prob"]), abs=1e-12)


def test_quantiles_of_five_million_values(spark):
    df = spark.range(5_000_000).select((F.col("id") * 7919 % 5_000_000).cast("double").alias("x"))
    got = {r["prob"]: r["quantile"] for r in ordering.exact_quantiles(df, [], "x", [0.25, 0.5, 0.9]).collect()}
    assert got == pytest.approx({p: p * 4_999_999 for p in (0.25, 0.5, 0.9)})


def test_rank_by_more_buckets_is_the_same(spark, monkeypatch):
    df = spark.range(5000).withColumn("h", ordering.hash32("id")).withColumn("g", F.col("id") % 2)
    one = ordering.with_rank(df, ["g"], "h", ["id"]).toPandas()
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 7)
    many = ordering.with_rank(df, ["g"], "h", ["id"]).toPandas()
    assert one.sort_values("id")["rank"].tolist() == many.sort_values("id")["rank"].tolist()


@pytest.mark.parametrize("blocks", [3, 31, 40, 130])
def test_mcar_with_many_blocks(spark, blocks):
    n = 240
    frame = pd.DataFrame({"subjectkey": range(n), **{f"b{i}": np.ones(n) for i in range(blocks)}})
    out = missing.inject_mcar(spark.createDataFrame(frame), {f"k{i}": [f"b{i}"] for i in range(blocks)}, 0.2).toPandas()
    lost = out.sort_values("subjectkey").drop(columns="subjectkey").isna().to_numpy()
    bits = np.array([tuple(r) for r in spark.createDataFrame(frame).orderBy("subjectkey").select(*[
        missing._high_bit(missing.hashed_draw("subjectkey", salt=i + 1)) for i in range(blocks)]).collect()], bool)
    sizes = Counter(map(tuple, bits))
    hits = Counter(tuple(b) for b, row in zip(bits, lost) if row.any())
    assert all((row == b).all() or not row.any() for b, row in zip(bits, lost))
    for pattern, size in sizes.items():
        if any(pattern):
            assert hits[pattern] == (0 if all(pattern) else int(np.ceil(0.2 * size)))


@pytest.mark.parametrize("patterns", [1, 16, 62, 200])
def test_mar_patterns_have_no_limit(spark, patterns):
    names = [f"f{i}" for i in range(6)]
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"subjectkey": range(1500), **{c: rng.normal(size=1500) for c in names}})
    df = spark.createDataFrame(frame)
    out = missing.inject_mar(df, names, 0.3, patterns=patterns, draw=missing.arithmetic_draw)
    lost = out.toPandas().set_index("subjectkey").sort_index().isna().to_numpy()
    table = {r["_pattern"]: r for r in missing.mar_patterns(spark, 6, patterns, 0.3, 0, missing.arithmetic_draw).collect()}
    draws = {r[0]: (r[1], r[2]) for r in df.select(
        "subjectkey", missing.arithmetic_draw("subjectkey", 1) % patterns, missing.arithmetic_draw("subjectkey", 5)).collect()}
    groups = {}
    for s in frame.subjectkey:
        groups.setdefault(draws[s][0], []).append(s)
    for p, members in groups.items():
        keep, weigh = np.array(table[p]["_keep"]), np.array(table[p]["_weigh"])
        x = frame[names].to_numpy()[members]
        sums = np.where(keep & weigh, x, 0.0).sum(axis=1)
        for s, total in zip(members, sums):
            quarter = min(4 * int((sums < total).sum()) // len(members), 3)
            hit = not keep.all() and (len(members) == 1 or draws[s][1] / 2**32 < table[p]["_chance"][quarter])
            assert (lost[s] == (hit & ~keep)).all()
    with pytest.raises(ValueError):
        missing.inject_mar(df, names, patterns=0)


@pytest.mark.parametrize("tile", [4096, 16])
def test_cooccurrence_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(graph, "TILE", tile)
    rng = np.random.default_rng(5)
    rows = [(s, g) for s in range(150) for g in {"all", *rng.choice(["a", "b", "c", "d", "e", "f", "g"], 3)}]
    members = spark.createDataFrame(rows + rows[:20], "subjectkey int, group_id string")
    profile = {}
    for s, g in rows:
        profile[s] = tuple(sorted({*profile.get(s, ()), g}))
    sizes = Counter(profile.values())
    want = {(a, b): len(set(a) & set(b)) for a in sizes for b in sizes if a != b or sizes[a] > 1}
    got = {(tuple(r["profile_a"]), tuple(r["profile_b"])): r["n"] for r in graph.cooccurrence(members).collect()}
    assert got == want
    row = graph.cooccurrence_rows(members, spark.createDataFrame([(3,)], "subjectkey int")).collect()
    assert {r["other"]: r["n"] for r in row} == {
        s: len(set(profile[3]) & set(p)) for s, p in profile.items() if s != 3}


def test_a_group_of_many_profiles_is_cut_into_small_tiles(spark):
    ids = spark.range(100_000)
    members = ids.select(F.col("id").alias("subjectkey"), F.lit("all").alias("group_id")).unionByName(
        ids.select(F.col("id").alias("subjectkey"), F.concat(F.lit("own"), "id").alias("group_id")))
    sizes = graph.membership_profiles(members).groupBy("profile").agg(F.count("*").alias("subjects"))
    flat = sizes.select("profile", "subjects", F.explode("profile").alias("_g"))
    for side in graph._tiled(flat, flat):
        per_task = side.where("_g = 'all'").groupBy("_g", "_ta", "_tb").count()
        most, tiles = per_task.agg(F.max("count"), F.count("*")).first()
        assert most < 1.2 * graph.TILE and tiles == 25 ** 2
    one = graph.cooccurrence_rows(members, spark.createDataFrame([(7,)], "subjectkey long"))
    assert one.agg(F.count("*"), F.sum("n")).first()[:] == (99_999, 99_999)
