"""Mixing sources by weights that change over the training run; DataFrame functions only.

A source has a schedule: a weight at each of some times between 0 and 1, linear between them. The integral over the whole run
is its weight, which gives its share of all words to take, its target. The integral up to a time is the demand that must be
met by then; its inverse gives each document the time at which the words before it, in a stable order, are used up. Documents
are range-sorted by that time. A source whose target exceeds its size begins anew, up to a limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.ordering import sums_before
from cohortline.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
KNOTS = "array<struct<at:double,weight:double>>"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled(sources: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]]) -> DataFrame:
    """``(source, knots)``: the given schedules dealt in turn to the distinct sources by code point, null last."""
    ranked = sums_before(sources.select("source").distinct(), [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    turn = F.col("place") % len(schedules)
    knots = F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("at"), F.lit(float(w)).alias("weight")) for t, w in s]) for s in schedules])
    return ranked.select("source", F.get(knots, turn.cast("int")).cast(KNOTS).alias("knots"))


def _segments() -> dict[str, Column]:
    """The pieces of a schedule with the integral before each, and the whole integral."""
    areas = F.expr("transform(sequence(1, size(knots) - 1), i -> (knots[i].at - knots[i - 1].at) * (knots[i].weight + knots[i - 1].weight) / 2)")
    pieces = F.expr("""transform(sequence(1, size(knots) - 1), i -> named_struct(
        'at', knots[i - 1].at, 'to', knots[i].at, 'weight', knots[i - 1].weight,
        'slope', coalesce(try_divide(knots[i].weight - knots[i - 1].weight, knots[i].at - knots[i - 1].at), 0D),
        'before', aggregate(slice(areas, 1, i - 1), 0D, (s, a) -> s + a)))""")
    return {"areas": areas, "pieces": pieces, "weight": F.expr("aggregate(areas, 0D, (s, a) -> s + a)")}


def integrated(schedules: DataFrame) -> DataFrame:
    """``(source, pieces, weight)``; fewer than two knots, or none, weigh nothing."""
    out = schedules.where("size(knots) > 1").select("source", F.col("knots").cast(KNOTS).alias("knots"))
    for name, column in _segments().items():
        out = out.withColumn(name, column)
    return out.select("source", "pieces", "weight")


def time_of(demand: str) -> Column:
    """The time at which a schedule's integral reaches ``demand``, an SQL expression: the inverse of a piecewise parabola."""
    piece = f"element_at(filter(pieces, p -> p.before <= {demand} AND p.to > p.at), -1)"
    return F.expr(f"""element_at(transform(array({piece}), p -> least(p.to, p.at + coalesce(try_divide(2 * ({demand} - p.before),
        p.weight + sqrt(greatest(0D, p.weight * p.weight + 2 * p.slope * ({demand} - p.before)))), 0D))), 1)""")


def targets(sizes: DataFrame, share: float, limit: float) -> DataFrame:
    """Add ``target`` to ``(source, source_size, weight)``: ``share`` of all sizes by weight, none above ``limit`` of its source.

    What goes above is shared anew by weight among the rest until nobody is above. All sources below their limit then have the
    same ratio of target to weight, so the sources are ordered by the ratio at which they are full, and one running sum tells who
    is. Without enough words in weighted sources each gives its limit; a source without weight gives nothing.
    """
    cap = F.col("source_size") * F.lit(float(limit))
    rows = materialize(sizes.withColumn("full", F.when(F.col("weight") > 0, cap / F.col("weight"))))
    by_ratio = rows.where("full is not null").groupBy("full").agg(F.sum(cap).alias("caps"), F.sum("weight").alias("weights"))
    before = sums_before(by_ratio, [F.col("full")], {"taken": F.col("caps"), "gone": F.col("weights")})
    whole = rows.agg((F.sum("source_size") * F.lit(float(share))).alias("n")).scalar()
    all_weights = by_ratio.agg(F.sum("weights")).scalar()
    left, rest = whole - F.col("taken"), all_weights - F.col("gone")
    open_ = before.where(F.col("full") >= left / rest).agg(F.min_by(F.struct(left.alias("left"), rest.alias("rest"), "full"), "full")).scalar()
    level = rows.withColumn("level", open_)
    return level.select("source", "source_size", "weight", F.when(F.col("full").isNull(), 0.0).when(
        F.col("full") >= F.col("level.full"), F.col("weight") * F.col("level.left") / F.col("level.rest")).otherwise(cap).alias("target"))


def mix(docs: DataFrame, schedules, share: float = 1.5, limit: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source",
        row: str | None = None, seed: str = "mix") -> DataFrame:
    """One row for each document and time it is taken, sorted by training position.

    ``schedules`` is a table ``(source, knots)`` or a function that makes one of a table of sources. Columns: ``row`` (the
    column of that name if given, else a number), ``key``, ``source``, ``size``, ``source_size``, ``target``, ``copy`` (0, 1, ...),
    ``start`` and ``words``: the piece that is taken, and ``position`` between 0 and 1. Only the last document that a source
    needs is cut, so each source gives its target, rounded down. A document that is not taken has one row with ``words`` 0 and null
    ``copy``, ``start`` and ``position``, sorted last.

    The order within a source is that of MD5 hashes of the key. Repeated keys are ordered by size and text, so reruns agree. A
    null text has no words, a null source is a source of its own, a null key is hashed as an empty one. An empty table gives no rows; other
    columns are not read. No task holds a source: rows are dealt by source and hash, so that the largest source has as many tasks as its rows need.
    """
    name = F.col(f"`{key}`")
    sized = materialize(docs.select(
        (F.col(f"`{row}`") if row else F.monotonically_increasing_id()).alias("row"), name.alias("id"), F.col(f"`{source}`").alias("source"),
        n_words(F.col(f"`{text}`")).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit(""))).cast("binary")).alias("hash"),
        F.xxhash64(F.col(f"`{text}`")).alias("tie")))
    sizes = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    scheduled = materialize(integrated(schedules(sizes) if callable(schedules) else schedules))
    same = F.col("source").eqNullSafe(F.col("of"))
    weighed = sizes.join(scheduled.withColumnRenamed("source", "of"), same, "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    aim = sums_before(targets(weighed, share, limit), [F.col("source").asc_nulls_last()], {"base": F.col("source_size")})
    aim = materialize(aim.join(scheduled.select(F.col("source").alias("of"), "pieces"), same, "left").drop("of"))

    placed = sums_before(sized, [F.col("source").asc_nulls_last(), *map(F.col, ("hash", "size", "tie"))], {"first": F.col("size")})
    joined = placed.join(aim.withColumnRenamed("source", "of"), same).withColumns({
        "first": F.col("first") - F.col("base"), "whole": F.floor("target").cast("long")})
    turns = F.array(*[F.struct(
        F.lit(e).alias("copy"), (F.col("first") + F.col("source_size") * e).alias("start"),
        F.greatest(F.lit(0), F.least(F.col("size"), F.col("whole") - F.col("first") - F.col("source_size") * e)).alias("words"))
        for e in range(max(1, int(-(-limit // 1))))])
    taken = joined.withColumn("turn", F.explode_outer(F.filter(turns, lambda t: t["words"] > 0)))
    demand = "((turn.start + turn.words / 2) / whole * weight)"
    return taken.select(
        "row", F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target", "turn.copy",
        F.when(F.col("turn").isNotNull(), F.lit(0)).cast("long").alias("start"), F.coalesce("turn.words", F.lit(0)).alias("words"),
        F.when(F.col("turn").isNotNull(), time_of(demand)).alias("position")).orderBy(
            F.col("position").asc_nulls_last(), F.col(source).asc_nulls_last(), "copy", "row")


def arranged(docs: DataFrame, schedules, **options) -> DataFrame:
    """The documents in training order, with all their columns in ``doc`` and ``copy``, ``words`` and ``position``.

    The table is written once with row numbers; its texts move once to meet their positions and once in the sort.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    flat = rows.select(F.col("row").alias("__row"), *[F.col("doc")[c].alias(c) for c in docs.columns])
    plan = mix(flat, schedules, row="__row", **options).where("words > 0").select("row", "copy", "words", "position")
    return rows.join(plan, "row").orderBy("position", "copy", "row").select("doc", "copy", "words", "position")


#: Schedules of the query: the weights 3, 1, 2 as means of a falling, a rising and a steady line.
FALLING_RISING_STEADY = [[(0, 4.5), (1, 1.5)], [(0, 0.5), (1, 1.5)], [(0, 2), (1, 2)]]


def digest(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: the words that the mix takes of it, repeats counted."""
    return mixed.groupBy("row").agg(
        F.first(F.struct(key, "size", "source_size", "target")).alias("d"), F.sum("words").alias("taken")).select("d.*", "taken")
