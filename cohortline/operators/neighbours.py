"""Exact k-nearest-neighbour classification without comparing all pairs.

Training points are split level by level into leaves of a bounded number of points: each node too large for a leaf is cut at
quantiles of its widest dimension. Nodes with their boxes are a table, however many there are. A query point goes down to the deepest
node around it that has k points; its k-th neighbour there bounds the search, and a second descent follows only the children whose boxes come
that near. Leaves asked for by many query points are given to several tasks, and many small leaves to one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.session import materialize

LEAF_ROWS = 1000    # training points of a leaf at most; several times k, so that a leaf alone bounds the search
SLICE_ROWS = 20_000  # query points compared with a leaf in one task
CHILDREN = 16        # parts of a node at most; a digit of its name
HOME_LEAST = 256     # points of a node at least that bound a search, where there are as many: fewer give a wide bound
HOME_ROWS = CHILDREN * LEAF_ROWS  # and at most; the box of a larger node is the bound
FEW_NODES = 10_000   # nodes of a level at most that are broadcast
GROUP_ROWS = 20_000  # query points, or training points, that small leaves of one call in a task have together, about


def _distance(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Of each row of ``a`` to its own points in ``b``: rows x dims and rows x points x dims give rows x points."""
    d = np.abs(a[:, None, :] - b)
    if p == 1:
        return d.sum(axis=2)
    if p == 2:
        return np.sqrt((d * d).sum(axis=2))
    return (d ** p).sum(axis=2) ** (1.0 / p)


def _blocks(units: pd.Series, asked: pd.Series, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of query points with their training points, as row numbers: a vector, and a matrix with a line for each.

    ``units`` and ``asked`` name the unit of each training and query point. Units of one size are compared at once, however many
    there are; the points of a unit keep their order.
    """
    codes, names = pd.factorize(units)
    at = pd.Index(names).get_indexer(asked)
    order, sizes = np.argsort(codes, kind="stable"), np.bincount(codes, minlength=len(names))
    starts = np.cumsum(sizes) - sizes
    rows = np.flatnonzero(at >= 0)
    rows = rows[np.argsort(sizes[at[rows]], kind="stable")]
    for part in np.split(rows, np.flatnonzero(np.diff(sizes[at[rows]])) + 1):
        if len(part):
            n = int(sizes[at[part[0]]])
            step = max(1, 4_000_000 // (n * dims))
            for a in range(0, len(part), step):
                some = part[a:a + step]
                yield some, order[starts[at[some]][:, None] + np.arange(n)]


def _length(parts: Sequence[Column], p: float) -> Column:
    if p == 1:
        return reduce(lambda a, b: a + b, parts)
    if p == 2:
        return F.sqrt(reduce(lambda a, b: a + b, [x * x for x in parts]))
    return F.pow(reduce(lambda a, b: a + b, [F.pow(x, F.lit(float(p))) for x in parts]), F.lit(1.0 / p))


@dataclass
class Tree:
    """Training points in leaves, and the nodes above them.

    ``nodes``: ``node`` (a path of hexadecimal digits), ``parent``, ``level``, ``n`` points, ``leaf``, the dimension ``dim`` and the places
    ``cuts`` at which it is split, and the box as ``lo`` and ``hi``. ``points``: key, label, ``x`` and ``leaf``.
    """

    nodes: DataFrame
    points: DataFrame
    levels: int


def build_tree(points: DataFrame, dims: int, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Split ``points`` with an array column ``x`` of ``dims`` numbers into leaves of at most ``leaf_rows`` points.

    A node whose points are all equal stays one leaf. A level is three small aggregates and one rewrite of the points
    that are not in a leaf yet; points of a node are never brought together.
    """
    probs = [i / CHILDREN for i in range(1, CHILDREN)]
    here = points.withColumn("_node", F.lit(""))
    levels, leaves = [], []
    while True:
        here = materialize(here)
        box = here.groupBy("_node").agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.min(F.get("x", F.lit(i))) for i in range(dims)]).alias("lo"),
            F.array(*[F.max(F.get("x", F.lit(i))) for i in range(dims)]).alias("hi"))
        width = F.zip_with("hi", "lo", lambda h, low: h - low)
        box = materialize(box.withColumn("_width", F.array_max(width)).withColumn(
            "dim", (F.array_position(width, F.col("_width")) - 1).cast("int")).withColumn(
            "leaf", (F.col("n") <= leaf_rows) | (F.col("_width") <= 0)).drop("_width"))
        open_nodes = box.where("NOT leaf").select("_node", "dim", F.get("lo", F.col("dim")).alias("_lo"), F.get("hi", F.col("dim")).alias("_hi"))
        done = open_nodes.isEmpty()
        value = F.get("x", F.col("dim"))
        if done:
            cuts = None
        else:  # cuts lie below the greatest value, so at least two children have points; the middle serves if quantiles do not
            quantiles = here.join(open_nodes, "_node").groupBy("_node").agg(
                F.percentile_approx(value, probs, 2000).alias("_q"), F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
            middle = F.col("_lo") + (F.col("_hi") - F.col("_lo")) / 2
            middle = F.when(middle < F.col("_hi"), middle).otherwise(F.col("_lo"))
            parts = F.least(F.lit(CHILDREN), F.ceil(F.col("n") / leaf_rows)).cast("int")  # no smaller leaves than needed
            picked = F.transform(F.sequence(F.lit(1), parts - 1), lambda j: F.get("_q", F.round(j * CHILDREN / parts).cast("int") - 1))
            below = F.array_distinct(F.filter(picked, lambda q: q < F.col("_hi")))
            cuts = materialize(quantiles.select("_node", F.when(F.size(below) > 0, below).otherwise(F.array(middle)).alias("cuts")))
            box = box.join(cuts, "_node", "left")
        if done:
            box = box.withColumn("cuts", F.lit(None).cast("array<double>"))
        levels.append(box.select(
            F.col("_node").alias("node"), F.expr("left(_node, length(_node) - 1)").alias("parent"), F.length("_node").alias("level"),
            "n", "leaf", "dim", "cuts", "lo", "hi"))
        leaves.append(here.join(box.where("leaf").select("_node"), "_node").withColumnRenamed("_node", "leaf"))
        if done:
            break
        digit = F.lower(F.hex(F.size(F.filter("cuts", lambda c: c < value))))
        here = here.join(open_nodes.select("_node", "dim"), "_node").join(cuts, "_node").withColumn(
            "_node", F.concat("_node", digit)).select(*here.columns)
    return Tree(materialize(reduce(DataFrame.unionByName, levels)), materialize(reduce(DataFrame.unionByName, leaves)), len(levels))


def _near(p: float, dims: int) -> Column:
    """The least distance of a point to a box."""
    part = lambda i: F.greatest(F.lit(0.0), F.get("lo", F.lit(i)) - F.get("x", F.lit(i)), F.get("x", F.lit(i)) - F.get("hi", F.lit(i)))
    return _length([part(i) for i in range(dims)], p)


def _far(p: float, dims: int) -> Column:
    part = lambda i: F.greatest(F.abs(F.get("x", F.lit(i)) - F.get("lo", F.lit(i))), F.abs(F.get("hi", F.lit(i)) - F.get("x", F.lit(i))))
    return _length([part(i) for i in range(dims)], p)


def _grouped(wanted: DataFrame, points: DataFrame, key: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Query points and points of leaves with ``_unit`` and ``_group``.

    A unit is a leaf and at most about ``rows`` query points that ask for it; a leaf asked for by more has a copy for each slice
    of them. Units share a group as far as they are small, as each group is a call of its own.
    """
    load = wanted.groupBy("leaf").agg(F.count(F.lit(1)).alias("_asking"), F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_slices"))
    sizes = points.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).join(load, "leaf")
    groups = max(-(-(t or 0) // GROUP_ROWS) for t in (1, *sizes.agg(F.sum("_asking"), F.sum(F.col("_n") * F.col("_slices"))).first()))
    load = load.drop("_asking")
    unit = F.concat_ws(":", "leaf", "_slice")
    named = lambda df: df.withColumn("_unit", unit).withColumn("_group", F.pmod(F.xxhash64("_unit"), F.lit(groups))).drop("leaf", "_slice", "_slices")
    cut = wanted.join(load, "leaf").withColumn("_slice", F.pmod(F.xxhash64(key), F.col("_slices")).cast("int"))
    copies = points.join(load, "leaf").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    return named(cut), named(copies)


def leaves_near(tree: Tree, queries: DataFrame, dims: int, key: str, k: int, p: float, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``(key, x, radius, leaf)``: the leaves that can hold one of the ``k`` nearest points of each query point, none of which is farther than ``radius``."""
    spark = queries.sparkSession
    node = tree.nodes.select("node", "level", "n", "leaf", "dim", "cuts", "lo", "hi")
    at = queries.withColumns({"node": F.lit(""), "home": F.lit(None).cast("string"), "radius": F.lit(float("inf")), "small": F.lit(False)})
    for level in range(tree.levels):  # the way down to the deepest node of k points or more; names with "-" are of no node
        at = at.join(node.where(F.col("level") == level).drop("level"), "node", "left")
        enough = F.coalesce((F.col("n") >= k) & ((F.col("n") >= HOME_LEAST) | ~F.col("small")), F.lit(False))
        digit = F.lower(F.hex(F.size(F.filter("cuts", lambda c: c < F.get("x", F.col("dim"))))))
        at = at.select(
            key, "x", F.when(enough, F.col("node")).otherwise(F.col("home")).alias("home"),
            F.when(enough, F.least("radius", _far(p, dims))).otherwise(F.col("radius")).alias("radius"),
            F.when(enough, F.col("n") <= HOME_ROWS).otherwise(F.col("small")).alias("small"),
            F.concat("node", F.when(~F.col("leaf"), digit).otherwise("-")).alias("node"))
    at = materialize(at.drop("node"))

    def kth(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = np.full(len(right), np.inf)
        if len(left) and len(right):
            t, q = np.stack(left["x"].to_numpy()), np.stack(right["x"].to_numpy())
            for rows, near in _blocks(left["_unit"], right["_unit"], dims):
                if near.shape[1] >= k:
                    found[rows] = np.partition(_distance(q[rows], t[near], p), k - 1, axis=1)[:, k - 1]
        return pd.DataFrame({key: right[key].to_numpy(), "radius": found})

    asked = at.where("small").select(key, "x", F.col("home").alias("leaf"))
    above = tree.nodes.where("leaf").select(F.col("node").alias("leaf"), F.explode(F.transform(
        F.sequence(F.lit(0), F.length("node")), lambda i: F.col("node").substr(F.lit(1), i))).alias("home"))
    homes = above.join(asked.select(F.col("leaf").alias("home")).distinct(), "home")
    stored = tree.points.select("leaf", "x").join(homes, "leaf").select(F.col("home").alias("leaf"), "x")
    cut, copies = _grouped(asked, stored, key, slice_rows)
    key_type = queries.schema[key].dataType.simpleString()
    own = copies.groupBy("_group").cogroup(cut.groupBy("_group")).applyInPandas(kth, f"`{key}` {key_type}, radius double")
    radius = at.select(key, "radius").unionByName(own).groupBy(key).agg((F.min("radius") * (1 + 1e-12)).alias("radius"))
    pairs = queries.join(radius, key).repartition(2 * spark.sparkContext.defaultParallelism, key)
    pairs = materialize(pairs.select(key, "x", "radius", F.lit("").alias("node"), F.lit(tree.levels == 1).alias("leaf")))
    children = tree.nodes.select("node", "parent", "level", "leaf", "lo", "hi")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = [pairs.where("leaf").drop("node").withColumn("leaf", F.lit(""))]
    for level in range(1, tree.levels):  # a level is written, as the join by which a few rows become many would run in a task or two
        box = children.where(F.col("level") == level).drop("level")
        pairs = pairs.where("NOT leaf").select(key, "x", "radius", F.col("node").alias("parent"))
        if CHILDREN ** level <= FEW_NODES:
            pairs = pairs.join(F.broadcast(box), "parent")
        else:
            pairs = pairs.repartition(parts, "parent").join(box.repartition(parts, "parent"), "parent")
        pairs = materialize(pairs.where(_near(p, dims) <= F.col("radius")).select(key, "x", "radius", "node", "leaf"))
        out.append(pairs.where("leaf").select(key, "x", "radius", F.col("node").alias("leaf")))
    return reduce(DataFrame.unionByName, out)


def nearest_neighbours(train: DataFrame, test: DataFrame, features: Sequence[str], key: str, label: str,
                       k: int = 5, p: float = 2, leaf_rows: int = LEAF_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The k nearest training rows of each test row: key, neighbour, its label, distance and rank.

    Ties in distance go to the lower training key. Rows with a missing feature are left out.
    """
    features, dims = list(features), len(features)
    x = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    key_type, test_type = train.schema[key].dataType.simpleString(), test.schema[key].dataType.simpleString()
    known = train.dropna(subset=features).select(key, F.col(label).cast("int").alias("_label"), x)
    queries = materialize(test.dropna(subset=features).select(key, x))

    # Copies of one point are equally far from everything: the k lowest keys of them are enough.
    same = Window.partitionBy("x").orderBy(key)
    points = known.dropna().withColumn("_rn", F.row_number().over(same)).filter(F.col("_rn") <= k).drop("_rn")
    tree = build_tree(points, dims, leaf_rows)
    wanted, stored = _grouped(leaves_near(tree, queries, dims, key, k, p, slice_rows), tree.points, key, slice_rows)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [key, "neighbour", "label", "distance"]
        found = [pd.DataFrame({n: [] for n in names})]
        if not len(left) or not len(right):
            return found[0]
        left = left.sort_values(key)  # stable sorts by distance keep the lower key first
        t, ids, labels = np.stack(left["x"].to_numpy()), left[key].to_numpy(), left["_label"].to_numpy()
        q, asking, radius = np.stack(right["x"].to_numpy()), right[key].to_numpy(), right["radius"].to_numpy()
        for rows, near in _blocks(left["_unit"], right["_unit"], dims):
            d = _distance(q[rows], t[near], p)
            take = np.argsort(d, axis=1, kind="stable")[:, :k]
            d, near = np.take_along_axis(d, take, 1), np.take_along_axis(near, take, 1)
            line, place = np.nonzero(d <= radius[rows][:, None])
            near = near[line, place]
            found.append(pd.DataFrame(dict(zip(names, (asking[rows[line]], ids[near], labels[near], d[line, place]), strict=True))))
        return pd.concat(found[1:] or found)

    best = stored.groupBy("_group").cogroup(wanted.groupBy("_group")).applyInPandas(
        compare, f"`{key}` {test_type}, neighbour {key_type}, label int, distance double")
    rank = Window.partitionBy(key).orderBy("distance", "neighbour")
    return best.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def knn_classify(train: DataFrame, test: DataFrame, features: Sequence[str], key: str, label: str, k: int = 5,
                 weights: str = "uniform", p: float = 2, **limits) -> DataFrame:
    """Vote of the k nearest training rows: key, prediction and probability of label 1.

    With ``weights="distance"`` a vote counts 1/distance, and exact matches alone decide if there
    are any. A tied vote goes to the lower label.
    """
    found = nearest_neighbours(train, test, features, key, label, k, p, **limits)
    if weights == "distance":
        found = found.withColumn("_exact", F.when(F.col("distance") == 0, 1).otherwise(0))
        vote = F.when(F.col("distance") == 0, F.lit(1.0)).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
        exact_first = F.col("_any_exact") == F.col("_exact")
        flags = found.groupBy(key).agg(F.max("_exact").alias("_any_exact"))
        found = found.join(flags, key).filter(exact_first | (F.col("_any_exact") == 0))
    else:
        vote = F.lit(1.0)
    votes = found.groupBy(key, "label").agg(F.sum(vote).alias("_v"))
    return votes.groupBy(key).agg(
        F.max_by("label", F.struct(F.col("_v"), -F.col("label"))).alias("prediction"),
        (F.sum(F.when(F.col("label") == 1, F.col("_v")).otherwise(0.0)) / F.sum("_v")).alias("probability"))
