"""Cells of nearby rows as a tree of tables, for exact neighbour search.

Rows are split by group, by which features they lack (rare patterns share a
pool), and then by feature medians until a cell holds at most a given number of
rows.  Cuts come from a bounded sample of each node, as they decide how much is
visited and never a result.  Every level is a table of nodes with the limits of
their features; its size grows with the rows, none of it is held by the driver.

A query first meets the rows of its home cell.  The k-th distance found there
bounds how far its k nearest rows can be, and with that bound it goes down the
levels, past every node whose limits (and, for the last level, whose centre and
radius by the triangle inequality) are farther.  Queries travel in packs of one
home cell, so each step is an equi join of packs with the children of a node.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import SUMMARY_ROWS, col
from ..session import written
from .ordering import first_rows, hash32

CUT_SAMPLE = 2048
DEPTH = 5
CHILD_BLOCK = 64
PACK_ROWS = 1024
#: Blocks up to which no levels are made between groups and blocks.
FEW_BLOCKS = 1024
#: Bytes of packs that a task gathers before it hands them on.
OUT_BYTES = 4 << 20
POOL = "pool"
LEAST_FAMILY = 32
FEW_FEATURES, FEW_FEATURES_ROWS, MANY_FEATURES_ROWS, LEAST_ROWS = 16, 512, 4096, 256
# Fewer rows than this are compared with all queries: the tree would cost more.  The rows found are the same.
TINY_ROWS = 4096


# ---- bounds -----------------------------------------------------------------

def box_bounds(q: np.ndarray, box: dict) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper distance bounds, queries x nodes, from the limits
    (``lo``, ``hi``), the present values per feature (``count``) and the rows (``n``)."""
    d, shape = q.shape[1], (len(q), len(box["n"]))
    near, far, most, least = (np.zeros(shape) for _ in range(4))
    for j in range(d):
        here = np.isfinite(q[:, j])[:, None]
        x = np.where(here[:, 0], q[:, j], 0.0)[:, None]
        some, always = here & (box["count"][:, j] > 0), here & (box["count"][:, j] == box["n"])
        lo, hi = box["lo"][:, j], box["hi"][:, j]
        near += np.where(always, np.maximum(np.maximum(lo - x, x - hi), 0.0) ** 2, 0.0)
        far += np.where(some, np.maximum(np.abs(x - lo), np.abs(x - hi)) ** 2, 0.0)
        most += some
        least += always
    with np.errstate(divide="ignore", invalid="ignore"):
        lower = np.where(most > 0, near * d / most, np.inf)
        upper = np.where(least > 0, far * d / least, np.inf)
    return lower, upper


def ball_bound(q: np.ndarray, box: dict) -> np.ndarray:
    """Squared lower bound by the triangle inequality over the features that a
    query shares with a node whose rows all have the same ones."""
    here = np.isfinite(q)
    there = box["count"] == box["n"][:, None]
    x, c = np.where(here, q, 0.0), np.where(there, box["center"], 0.0)
    h, t = here.astype(float), there.astype(float)
    square = (x * x) @ t.T + h @ (c * c).T - 2.0 * (x @ c.T)
    shared = h @ t.T
    with np.errstate(divide="ignore", invalid="ignore"):
        # The product loses digits; what it may lose is taken off.
        slack = 1e-12 * ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1))
        apart = np.sqrt(np.maximum(square - slack, 0.0)) - box["radius"]
        return np.where(np.isfinite(box["radius"]) & (shared > 0), np.maximum(apart, 0.0) ** 2 * q.shape[1] / shared, 0.0)


def reach(upper: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Per query the smallest upper bound within which k rows are certain."""
    order = np.argsort(upper, axis=1)
    enough = np.cumsum(counts[order], axis=1) >= k
    at = np.take_along_axis(upper, order, axis=1)[np.arange(len(upper)), enough.argmax(axis=1)]
    return np.where(enough.any(axis=1), at, np.inf)


def needed_reach(q: np.ndarray, upper: np.ndarray, box: dict, k: int, fill: bool) -> np.ndarray:
    """``reach`` for all rows, or to fill gaps for the rows that have each missing feature."""
    if not fill:
        return reach(upper, box["n"], k)
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        gap = ~np.isfinite(q[:, j])
        if gap.any():
            out[gap] = np.maximum(out[gap], reach(upper[gap], box["count"][:, j], k))
    return out


# ---- building ---------------------------------------------------------------

def _subtree(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and cut of each inner node of a binary tree in heap order: the
    widest feature at its middle; feature -1 where rows do not differ."""
    inner = (1 << depth) - 1
    feature, cut = np.full(inner, -1), np.zeros(inner)
    members = {0: np.arange(len(x))}
    for node in range(inner):
        rows = members.pop(node, np.zeros(0, int))
        if len(rows) < 2:
            continue
        part = x[rows]
        present = np.isfinite(part)
        n = np.maximum(present.sum(axis=0), 1)
        filled = np.where(present, part, 0.0)
        mean = filled.sum(axis=0) / n
        spread = (np.where(present, part - mean, 0.0) ** 2).sum(axis=0)
        j = int(np.argmax(spread))
        values = part[present[:, j], j]
        if not len(values) or values.min() == values.max():
            continue
        middle = np.median(values)
        middle = middle if middle > values.min() else values[values > middle].min()
        feature[node], cut[node] = j, middle
        right = part[:, j] >= middle
        members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
    return feature, cut


def _route(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Which of the tree's last places each row falls to."""
    at = np.zeros(len(x), int)
    while at.size and at[0] < len(feature):
        j = feature[at]
        right = (x[np.arange(len(x)), np.maximum(j, 0)] >= cut[at]) & (j >= 0)
        at = 2 * at + 1 + right
    return at - len(feature)


def _decoded(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), float).reshape(-1, d)


def as_points(df: DataFrame, keep: Sequence[str], features: Sequence[str], lacking: bool = False) -> DataFrame:
    """``(*keep, _x, _pattern)``: features as bytes, and which of them are there."""
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("_x", T.BinaryType()),
                           T.StructField("_pattern", T.StringType())])
    names, head, d = schema.names, len(keep), len(features)

    def pack(batches):
        for batch in batches:
            x = np.empty((batch.num_rows, d))
            for j in range(d):
                x[:, j] = batch.column(head + j).to_numpy(zero_copy_only=False)
            there, kept = np.isfinite(x), [batch.column(i) for i in range(head)]
            if lacking:
                some = ~there.all(axis=1)
                x, there, kept = x[some], there[some], [c.filter(pa.array(some)) for c in kept]
            if not len(x):
                continue
            bits = np.packbits(there, axis=1)
            kinds, which = np.unique(bits.view(f"V{bits.shape[1]}").ravel(), return_inverse=True)
            ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(8 * d)
            held = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])
            patterns = pa.array([k.tobytes().hex() for k in kinds]).take(pa.array(which.ravel()))
            yield pa.RecordBatch.from_arrays([*kept, held, patterns], names)

    values = [col(c).cast("double").alias(f"_v{j}") for j, c in enumerate(features)]
    rows = df.select(*[col(c) for c in keep], *values)
    if lacking:
        # Rows that lack nothing need not go to Python.
        missing = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        rows = rows.where(F.exists(F.array(*[f"_v{j}" for j in range(d)]), missing))
    return rows.mapInArrow(pack, schema)


CUTS = "_node string, _feature array<int>, _cut array<double>, _mean array<double>"


def _with(rows: DataFrame, small: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join with a written table, sent to all tasks if it has few rows."""
    return rows.join(F.broadcast(small) if small.count() <= SUMMARY_ROWS else small, keys, how)


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by the keys to all tasks: adaptive execution joins partitions of
    few bytes, and a few bytes of a node are much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _cuts(state: DataFrame, sizes: DataFrame, row_id: str, d: int, leaf_rows: int) -> DataFrame:
    """The split of every open node with more than ``leaf_rows`` rows."""
    drawn = state.select("_node", "_x", hash32(row_id, seed=11).alias("_draw"))
    sample = first_rows(_with(drawn, sizes, "_node"), ["_node"], [F.col("_draw")], CUT_SAMPLE)

    def split(pdf):
        depth = int(min(DEPTH, max(1, np.ceil(np.log2(pdf["_n"].iloc[0] / leaf_rows)))))
        x = _decoded(pdf["_x"], d)
        feature, cut = _subtree(x, depth)
        there = np.isfinite(x)
        mean = np.where(there, x, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
        return pd.DataFrame({"_node": [pdf["_node"].iloc[0]], "_feature": [feature.tolist()], "_cut": [cut.tolist()],
                             "_mean": [mean.tolist()]})

    return written(_spread(sample.select("_node", "_x", "_n"), "_node").groupBy("_node").applyInPandas(split, CUTS), "cuts")


def _descend(state: DataFrame, cuts: DataFrame, d: int, path: bool) -> DataFrame:
    """Rows one level further down: ``_node`` is the child's name."""
    names = state.columns
    joined = _with(state, cuts, "_node", "left")

    def step(batches):
        for pdf in batches:
            node, opened = pdf["_node"].to_numpy(object).copy(), pdf["_open"].to_numpy(bool).copy()
            for name, part in pdf.groupby("_node", sort=False).indices.items():
                feature = pdf["_feature"].iat[part[0]]
                # No cut, or rows that do not differ: the node is a cell.
                if feature is None or feature[0] < 0:
                    opened[part] = False
                    continue
                feature = np.asarray(feature, int)
                x = _decoded(pdf["_x"].iloc[part], d)
                x = np.where(np.isfinite(x), x, np.asarray(pdf["_mean"].iat[part[0]], float))
                to = _route(x, feature, np.asarray(pdf["_cut"].iat[part[0]], float))
                node[part] = [f"{name}.{t}" for t in to]
            out = pdf[names].copy()
            out["_node"], out["_open"] = node, opened
            if path:
                out["_path"] = [[*p, n] for p, n in zip(out["_path"], node)]
            yield out

    return joined.mapInPandas(step, T.StructType([state.schema[c] for c in names]))


@dataclass
class CellTree:
    """``blocks``: the rows of the cells, a row per block with its limits;
    ``levels``: from the groups down, each parent's children in rows of at most
    CHILD_BLOCK; ``cuts``: how a level's nodes were split; ``families``: the first
    nodes of each group; ``flat``: no tree, a group's children are its blocks."""

    blocks: DataFrame
    levels: list[DataFrame]
    cuts: list[DataFrame]
    families: DataFrame | None
    d: int
    n_blocks: int
    flat: bool
    leaf_rows: int


def _block_schema(id_type) -> T.StructType:
    number, some = T.DoubleType(), T.BinaryType()
    return T.StructType([
        T.StructField("_path", T.ArrayType(T.StringType())), T.StructField("_cell", T.StringType()),
        T.StructField("_donor_ids", T.ArrayType(id_type)), T.StructField("_donors", some), T.StructField("n", T.LongType()),
        T.StructField("lo", some), T.StructField("hi", some), T.StructField("count", some), T.StructField("center", some),
        T.StructField("radius", number)])


BOX = ["n", "lo", "hi", "count", "center", "radius"]
NODE = T.StructType([T.StructField("_path", T.ArrayType(T.StringType())), T.StructField("_node", T.StringType()),
                     T.StructField("_parent", T.StringType()), T.StructField("n", T.LongType()),
                     *[T.StructField(c, T.BinaryType()) for c in BOX[1:5]], T.StructField("radius", T.DoubleType())])
LEVEL = "_node string, _children array<string>, n array<bigint>, lo binary, hi binary, count binary, center binary, radius array<double>"


def _limits(x: np.ndarray) -> dict:
    present = np.isfinite(x)
    count = present.sum(axis=0).astype(float)
    lo, hi = np.where(present, x, np.inf).min(axis=0), np.where(present, x, -np.inf).max(axis=0)
    lo, hi = np.where(count > 0, lo, 0.0), np.where(count > 0, hi, 0.0)
    center = np.where(count > 0, np.where(present, x, 0.0).sum(axis=0) / np.maximum(count, 1), 0.0)
    pure = bool((present == present[0]).all())
    apart = np.sqrt((np.where(present, x - center, 0.0) ** 2).sum(axis=1)).max()
    return {"n": len(x), "lo": lo.tobytes(), "hi": hi.tobytes(), "count": count.tobytes(), "center": center.tobytes(),
            "radius": float(apart) * (1 + 1e-12) if pure else float("inf")}


def build(points: DataFrame, row_id: str, d: int, leaf_rows: int | None = None) -> CellTree:
    """The tree over ``(_group, row_id, _x, _pattern)``; runs a few jobs a level."""
    points = written(points, "points")
    rows, tiny = points.count(), leaf_rows is None
    if leaf_rows is None:
        # Larger cells move less data where many features leave little to prune; a small table still makes several.
        leaf_rows = min(FEW_FEATURES_ROWS if d <= FEW_FEATURES else MANY_FEATURES_ROWS, max(LEAST_ROWS, rows // 8))
    tiny = tiny and rows <= TINY_ROWS
    id_type = points.schema[row_id].dataType
    cuts, families = [], None
    if tiny:
        state = points.select(F.array("_group").alias("_path"), F.col("_group").alias("_node"), row_id, "_x")
        counts = written(state.groupBy("_node").agg(F.count("*").alias("_n")), "counts")
    else:
        patterns = points.groupBy("_group", "_pattern").agg(F.count("*").alias("_rows"))
        own = F.col("_rows") >= max(LEAST_FAMILY, leaf_rows // 8)
        named = F.concat("_group", F.lit("|"), F.when(own, F.col("_pattern")).otherwise(POOL))
        families = written(patterns.select("_group", "_pattern", "_rows", named.alias("_family")), "families")
        state = _with(points, families.drop("_rows"), ["_group", "_pattern"]).select(
            F.array("_group", "_family").alias("_path"), F.col("_family").alias("_node"), row_id, "_x", F.lit(True).alias("_open"))
    while not tiny:
        counts = written(state.groupBy("_node", "_open").agg(F.count("*").alias("_n")), "counts")
        large = counts.where(F.col("_open") & (F.col("_n") > leaf_rows)).select("_node", "_n")
        if not large.take(1):
            break
        cuts.append(_cuts(state, large, row_id, d, leaf_rows))
        state = written(_descend(state, cuts[-1], d, True), "state")
    sizes = counts.select("_node", F.ceil(F.col("_n") / leaf_rows).cast("int").alias("_parts"))
    placed = _with(state, sizes, "_node").withColumn("_part", F.pmod(hash32(row_id, seed=7), F.col("_parts")).cast("int"))
    schema = _block_schema(id_type)

    def block(pdf):
        pdf = pdf.sort_values(row_id)
        x, path = _decoded(pdf["_x"], d), list(pdf["_path"].iloc[0])
        row = {"_path": path, "_cell": f"{path[-1]}#{pdf['_part'].iloc[0]}", "_donor_ids": pdf[row_id].to_numpy(),
               "_donors": x.tobytes(), **_limits(x)}
        return pd.DataFrame([row], columns=schema.names)

    placed = _spread(placed.select("_node", "_part", "_path", row_id, "_x"), "_node", "_part")
    blocks = written(placed.groupBy("_node", "_part").applyInPandas(block, schema), "blocks")
    depth, n_blocks = len(cuts) + (1 if tiny else 2), blocks.count()
    nodes = blocks.select("_path", F.col("_cell").alias("_node"), *BOX)
    if n_blocks <= FEW_BLOCKS:
        # Every block is looked at from the group: few bounds, and no packs copied from level to level.
        nodes = nodes.withColumn("_parent", F.get("_path", F.lit(0)))
        return CellTree(blocks, [_children(nodes, d, True)], cuts, families, d, n_blocks, tiny, leaf_rows)
    levels = []
    for level in range(depth - 1, -1, -1):
        nodes = nodes.withColumn("_parent", F.get("_path", F.lit(level)))
        levels.insert(0, _children(nodes, d, level in (0, depth - 1)))
        if level:
            nodes = _spread(nodes.select(*NODE.names), "_parent").groupBy("_parent").applyInPandas(_joined(d), NODE).drop("_parent")
            # Deep trees: a level is computed once.
            nodes = written(nodes, "nodes") if depth > 4 else nodes
    return CellTree(blocks, levels, cuts, families, d, n_blocks, tiny, leaf_rows)


def _joined(d: int):
    def whole(pdf):
        stack = lambda c: np.frombuffer(b"".join(pdf[c]), float).reshape(-1, d)
        count, lo, hi = stack("count"), stack("lo"), stack("hi")
        total = count.sum(axis=0)
        least = np.where(count > 0, lo, np.inf).min(axis=0)
        most = np.where(count > 0, hi, -np.inf).max(axis=0)
        row = {"_path": list(pdf["_path"].iloc[0]), "_node": pdf["_parent"].iloc[0], "_parent": "", "n": int(pdf["n"].sum()), "lo": np.where(total > 0, least, 0.0).tobytes(),
               "hi": np.where(total > 0, most, 0.0).tobytes(), "count": total.tobytes(), "center": np.zeros(d).tobytes(),
               "radius": float("inf")}
        return pd.DataFrame([row])[NODE.names]
    return whole


def _children(nodes: DataFrame, d: int, many: bool) -> DataFrame:
    """Children of each parent, at most CHILD_BLOCK to a row; a split makes few,
    but a group may have many families and a cell of copies many blocks."""
    def gather(pdf):
        out = []
        for s in range(0, len(pdf), CHILD_BLOCK):
            part = pdf.iloc[s:s + CHILD_BLOCK]
            out.append({"_node": part["_parent"].iloc[0], "_children": part["_node"].tolist(), "n": part["n"].tolist(),
                        **{c: b"".join(part[c]) for c in ("lo", "hi", "count", "center")}, "radius": part["radius"].tolist()})
        return pd.DataFrame(out)

    nodes = nodes.select("_parent", "_node", *BOX)
    if not many:
        return _spread(nodes, "_parent").groupBy("_parent").applyInPandas(gather, LEVEL)
    counts = nodes.groupBy("_parent").agg(F.ceil(F.count("*") / CHILD_BLOCK).cast("int").alias("_rows"))
    dealt = nodes.join(counts, "_parent").withColumn("_deal", F.pmod(hash32("_node"), F.col("_rows")))
    return _spread(dealt, "_parent", "_deal").groupBy("_parent", "_deal").applyInPandas(gather, LEVEL)


# ---- searching --------------------------------------------------------------

def _box_of(row: dict, d: int) -> dict:
    out = {c: np.frombuffer(row[c], float).reshape(-1, d) for c in ("lo", "hi", "count", "center")}
    return {**out, "n": np.asarray(row["n"], float), "radius": np.asarray(row["radius"], float)}


def home_cells(tree: CellTree, queries: DataFrame, fill: bool) -> DataFrame:
    """``queries`` (``_group, _x, _pattern`` and more) with ``_node``, the cell to
    meet first: in the family of the query's own pattern if it fills a cell, else
    (and always to fill gaps) in the family that lacks least; the cuts lead from
    there, a missing value counts as the node's mean."""
    lacks = F.length(F.regexp_replace("_pattern", "f", ""))
    best = tree.families.groupBy("_group").agg(
        F.min_by("_family", F.struct(F.col("_family").endswith("|" + POOL), lacks, -F.col("_rows"))).alias("_best"))
    state = queries.join(best, "_group")
    if fill:
        node = F.col("_best")
    else:
        state = _with(state, tree.families.where(F.col("_rows") >= tree.leaf_rows).select("_group", "_pattern", "_family"),
                      ["_group", "_pattern"], "left")
        node = F.coalesce("_family", "_best")
    state = state.withColumn("_node", node).drop("_family", "_best").withColumn("_open", F.lit(True))
    for i, found in enumerate(tree.cuts):
        # One Python step a stage: a task that runs several at once holds the memory of all.
        state = _descend(written(state, "homes") if i else state, found, tree.d, False).withColumn("_open", F.lit(True))
    return state.drop("_open")


def pack_schema(head: Sequence[T.StructField], id_type) -> T.StructType:
    return T.StructType([*head, T.StructField("_group", T.StringType()), T.StructField("_node", T.StringType()),
                         T.StructField("_ids", T.ArrayType(id_type)), T.StructField("_m", T.BinaryType()),
                         T.StructField("_far", T.BinaryType())])


def packs(points: DataFrame, head: Sequence[str], row_id: str, schema: T.StructType, far: bool) -> DataFrame:
    """Rows of a node in packs of bounded size; rows of one node lie together."""
    def gather(batches):
        for pdf in batches:
            out = []
            for node, part in pdf.groupby("_node", sort=False):
                for s in range(0, len(part), PACK_ROWS):
                    some = part.iloc[s:s + PACK_ROWS]
                    bound = some["_far"].to_numpy(float) if far else np.full(len(some), np.inf)
                    out.append((*[some[c].iloc[0] for c in head], some["_group"].iloc[0], node, some[row_id].to_numpy(),
                                b"".join(some["_x"]), bound.tobytes()))
            if out:
                yield pd.DataFrame(out, columns=schema.names)

    return points.repartition(F.col("_node"), F.pmod(hash32(row_id, seed=5), F.lit(16))).sortWithinPartitions("_node").mapInPandas(
        gather, schema)


def _visit(batches, fixed: Sequence[str], names: Sequence[str], d: int, k: int, fill: bool):
    """Packs beside their node's children, to packs at those that may hold a near
    row.  A pack may go to every child, so what was made is handed on after each
    OUT_BYTES, whatever a batch holds."""
    table = lambda rows: pd.DataFrame(rows, columns=[*fixed, "_node", "_ids", "_m", "_far"])[list(names)]
    for pdf in batches:
        out, held = [], 0
        for row in pdf.to_dict("records"):
            box = _box_of(row, d)
            q, far, ids = np.frombuffer(row["_m"]).reshape(-1, d), np.frombuffer(row["_far"]), np.asarray(row["_ids"])
            lower, upper = box_bounds(q, box)
            lower = np.maximum(lower, ball_bound(q, box))
            far = np.minimum(far, needed_reach(q, upper, box, k, fill))
            near = (lower <= far[:, None] * (1 + 1e-9) + 1e-9) & np.isfinite(lower)
            for j in np.flatnonzero(near.any(axis=0)):
                those = near[:, j]
                out.append((*[row[c] for c in fixed], row["_children"][j], ids[those], q[those].tobytes(), far[those].tobytes()))
                held += 8 * (d + 2) * int(those.sum())
                if held > OUT_BYTES:
                    yield table(out)
                    out, held = [], 0
        if out:
            yield table(out)


def down(tree: CellTree, packed: DataFrame, k: int, fill: bool, tasks: int) -> DataFrame:
    """Packs of queries at every cell that may hold one of their k nearest rows:
    ``_node`` becomes the block's name.  Each level is a stage of its own, as a
    task that runs several Python steps at once holds the memory of all.  Copies of
    the children of few nodes keep every task busy."""
    d, schema, names = tree.d, packed.schema, packed.columns
    fixed = [c for c in names if c not in ("_node", "_ids", "_m", "_far")]
    at = packed.withColumn("_node", F.col("_group"))
    for level in tree.levels:
        if not tree.flat:
            level = written(level, "level")
            copies = max(1, -(-tasks // max(1, level.select("_node").distinct().count())))
            level = level.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(tasks, "_node", "_copy")
            at = at.withColumn("_copy", F.pmod(F.hash(F.col("_ids")[0]), F.lit(copies))).repartition(tasks, "_node", "_copy")
        at = at.join(level, ["_node"] if tree.flat else ["_node", "_copy"]).mapInPandas(lambda batches: _visit(batches, fixed, names, d, k, fill), schema)
    return at
