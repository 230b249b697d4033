"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a shape over training time, a list of (time, multiplier)
knots. The shape is integrated piece by piece; a source's words, laid end to end over as
many passes as its target asks for, are placed where the integral has demanded as many
words. So each document is assigned a position in [0, 1) by inverting the integral, and
the documents are range-sorted by it. All steps are DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline.llm.shared import WORD, settle

Knots = tuple[tuple[float, float], ...]

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
# One shape per weight: the light sources early, the middle ones level, the heavy ones late.
SHAPES: tuple[Knots, ...] = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
# About this many rows are summed up in one window; any number gives the same result.
WINDOW_ROWS = 20_000


@dataclass(frozen=True)
class _Piece:
    start: float
    width: float
    low: float  # multiplier at the start
    slope: float  # change of the multiplier per unit of time
    before: float  # demand before the piece, as a share of all demand
    total: float


def _pieces(knots: Knots) -> list[_Piece]:
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, done, out = sum(areas), 0.0, []
    if total <= 0 or knots[0][0] != 0 or knots[-1][0] != 1 or min(k[1] for k in knots) < 0:
        raise ValueError("A schedule runs from time 0 to 1 with multipliers >= 0, not all 0.")
    for (t0, m0), (t1, m1), area in zip(knots, knots[1:], areas, strict=False):
        if area > 0:
            out.append(_Piece(t0, t1 - t0, m0, (m1 - m0) / (t1 - t0), done / total, total))
        done += area
    return out


def position_of(share: Column, knots: Knots) -> Column:
    """The time at which ``share`` (0 to 1) of a source's words has been demanded."""
    column = None
    for piece in _pieces(knots):
        need = (share - F.lit(piece.before)) * piece.total
        # low t + slope t^2 / 2 = need, in the form that is stable for a slope near 0
        root = F.sqrt(F.greatest(F.lit(piece.low**2) + 2 * piece.slope * need, F.lit(0.0)))
        step = F.when(need <= 0, 0.0).otherwise(2 * need / (F.lit(piece.low) + root))
        time = F.lit(piece.start) + F.least(step, F.lit(piece.width))
        column = time if column is None else F.when(share >= piece.before, time).otherwise(column)
    return column


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = MOST_PASSES
) -> DataFrame:
    """``src``, ``source_size``, ``place``, ``weight`` and ``target`` per source key.

    ``sizes`` has ``src`` and ``size``. Sources take the weights in turn, in the order of
    ``src``. All words are shared by weight; a target stops at ``most_passes`` times its
    source and the excess is shared again among the others until none is above. Sources
    without words have a target of 0.
    """
    sums = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    in_order = sums.repartitionByRange("src").sortWithinPartitions("src")
    ranked = settle(in_order.withColumn("at", F.monotonically_increasing_id()), "sources")
    ranked = ranked.select("src", "source_size", F.shiftright("at", 33).alias("part"), "at")
    counts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    # One row per range partition of the sources.
    so_far = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    ahead = counts.select("part", (so_far - F.col("n")).alias("ahead"))
    place = F.col("ahead") + F.col("at").bitwiseAND((1 << 33) - 1)
    turns = F.array(*[F.lit(w) for w in weights])
    placed = settle(
        ranked.join(ahead, "part")
        .select("src", "source_size", place.alias("place"))
        .withColumn("weight", F.get(turns, (F.col("place") % len(weights)).cast("int"))),
        "sources",
    )
    full = most_passes * F.col("source_size")
    total = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped, before = F.lit(False), -1
    while True:
        n, taken, weight = placed.agg(
            F.count(F.when(capped, 1)),
            F.coalesce(F.sum(F.when(capped, full)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
        ).first()
        share = F.lit(total - taken).cast("double") * F.col("weight") / F.lit(float(weight or 1))
        # The set of capped sources only grows.
        if n == before or weight == 0:
            return placed.withColumn("target", F.when(capped, full.cast("double")).otherwise(share))
        before, capped = n, share > full


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most_passes: int = MOST_PASSES,
    window_rows: int = WINDOW_ROWS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """What the mix takes of every row of ``doc_id``, ``text``, ``source``.

    Returns ``doc_id``, ``source``, ``size`` (words), ``source_size``, ``target``,
    ``place`` (of the source), ``start`` (words of the source before the row, in the order
    of the MD5 of doc_id) and ``taken``. A source's words are laid out in that order, pass
    after pass, up to its target rounded down; the row at the end is taken in part. So the
    words taken of a source are its target to within one word, and no row exceeds
    ``most_passes`` times its size. A null text has size 0, a null source is a source of
    its own, after the others, rows that repeat a doc_id stand side by side, an empty
    table gives an empty plan. Columns named in ``keep`` come along, others are ignored.

    A source may hold any share of the rows: it is cut by the leading digits of the MD5,
    pieces are summed first, and each piece adds the sum of the pieces before it.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    # Null sorts after every source, as its key starts with a later letter.
    src = F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b"))
    sizes = settle(docs.select("doc_id", "source", src.alias("src"), size.alias("size"), *keep), "sizes")
    targets = source_targets(sizes, weights, most_passes)
    rows, digits = sizes.count(), 1
    while rows > window_rows * 16**digits:
        digits += 1
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    keyed = sizes.withColumn("key", key).withColumn("piece", F.substring("key", 1, digits))
    pieces = keyed.groupBy("src", "piece").agg(F.sum("size").alias("words"))
    to_here = Window.partitionBy("src").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    ahead = pieces.select("src", "piece", (F.sum("words").over(to_here) - F.col("words")).alias("ahead"))
    ahead = ahead.join(targets, "src")
    inside = (
        Window.partitionBy("src", "piece")
        .orderBy("key", "doc_id", "size", *keep)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = keyed.withColumn("local", F.sum("size").over(inside) - F.col("size"))
    joined = local.join(ahead, ["src", "piece"]).withColumn("start", F.col("ahead") + F.col("local"))
    taken = F.lit(0).cast("long")
    for turn in range(most_passes):
        room = F.floor("target") - (F.lit(turn) * F.col("source_size") + F.col("start"))
        taken = taken + F.greatest(F.lit(0), F.least(F.col("size"), room))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", "place", "start", taken.alias("taken"), *keep
    )


def passes(
    plan: DataFrame, shapes: tuple[Knots, ...] = SHAPES, most_passes: int = MOST_PASSES
) -> DataFrame:
    """The rows of ``plan``, once per pass in which they are taken: ``turn``, ``words``, ``position``.

    Rows of which nothing is taken have no pass.
    """
    turns = F.explode(F.sequence(F.lit(0), F.lit(most_passes - 1))).alias("turn")
    begin = F.col("turn") * F.col("source_size") + F.col("start")
    words = F.least(F.col("size"), F.floor("target") - begin)
    each = plan.where("taken > 0").select("*", turns).withColumn("words", words).where("words > 0")
    position = F.lit(None).cast("double")
    for n, knots in enumerate(shapes):
        here = F.col("place") % len(shapes) == n
        position = F.when(here, position_of(begin / F.col("target"), knots)).otherwise(position)
    return each.withColumn("position", position)


def with_positions(
    plan: DataFrame, shapes: tuple[Knots, ...] = SHAPES, most_passes: int = MOST_PASSES
) -> DataFrame:
    """``passes``, range-sorted by position, then by source and doc_id.

    So the files of the result follow each other in training order.
    """
    order = ["position", "source", "doc_id", "turn"]
    return passes(plan, shapes, most_passes).repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(
    plan: DataFrame, shapes: tuple[Knots, ...] = SHAPES, most_passes: int = MOST_PASSES
) -> DataFrame:
    """``plan`` with the ``positions`` of every row, an array with one per pass, in order.

    ``taken`` is the sum of the words of these passes. Rows are range-sorted by their first
    position; the ones that are not taken have no positions and come last.
    """
    rows = settle(plan.withColumn("row", F.monotonically_increasing_id()), "plan")
    placed = passes(rows, shapes, most_passes).groupBy("row").agg(
        F.sum("words").alias("words"), F.array_sort(F.collect_list("position")).alias("positions")
    )
    none = F.array().cast("array<double>")
    joined = rows.join(placed, "row", "left").select(
        *[c for c in plan.columns if c != "taken"],
        F.coalesce("words", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("positions", none).alias("positions"),
    )
    first = F.get("positions", F.lit(0)).asc_nulls_last()
    order = [first, F.col("source"), F.col("doc_id"), F.col("start")]
    return joined.repartitionByRange(*order).sortWithinPartitions(*order)
