"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1, straight between its knots.
The schedule's integral is the source's weight. Sources share ``share`` times all words by
weight; a target stops at ``cap`` times its source's words, and the excess goes to the
others by weight until none is above (found in exact whole numbers, one aggregate a round).

A source's documents lie end to end in the order of a hash, again and again, and the mix
takes the first words of that stream up to the target: so its last document may be taken
in part, none is taken more than ``cap`` times, and the words taken are the target but
for rounding. A source's demand up to time t is its target times the share of its
schedule before t; the training position of a document is the time at which the demand
reaches the document's first word: the inverse of a piecewise quadratic. Rows are then
range-sorted by position.

Running sums are taken in pieces of a source by hash, and pieces are summed on their own
table, so no task holds a source. Nulls: a null source is a source and the last one, null
texts have no words, null ids are rows like any other. Rows equal in id and text stand
next to one another in any order. Words of documents without any are never taken. A source
without words has target 0. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.dictionary import dense_rank_rows
from ..session import materialize
from .common import whole_text

Knots = Sequence[tuple[float, float]]  # (time, weight), times from 0 to 1
# Sources in order take these in turn: one that fades, one that grows, and a steady one, of weights 3, 1 and 2.
SCHEDULES: tuple[Knots, ...] = (((0, 4.5), (1, 1.5)), ((0, 0.5), (1, 1.5)), ((0, 2), (1, 2)))
SHARE, CAP = Fraction(3, 2), 2
WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 3  # hex digits of the hash that make a piece: 4,096 pieces of a source
BIG = "decimal(38,0)"


def _pieces(knots: Knots) -> list[tuple[Fraction, Fraction, Fraction, Fraction, Fraction]]:
    """Each straight piece: its times, its weights, and the area before it."""
    exact = [(Fraction(t), Fraction(w)) for t, w in knots]
    times = [t for t, _ in exact]
    if times[0] != 0 or times[-1] != 1 or times != sorted(set(times)) or min(w for _, w in exact) < 0:
        raise ValueError("knots go from time 0 to 1 in ascending order, and weights are not negative")
    found, area = [], Fraction(0)
    for (t, w), (u, v) in zip(exact, exact[1:]):
        found.append((t, u, w, v, area))
        area += (u - t) * (w + v) / 2
    if not area:
        raise ValueError("a schedule has some weight")
    return found


def integral(knots: Knots) -> Fraction:
    """The weight of a schedule: the area under it."""
    return sum(((u - t) * (w + v) / 2 for t, u, w, v, _ in _pieces(knots)), Fraction(0))


def inverse(knots: Knots, part: Column) -> Column:
    """The time at which ``part`` (0 to 1) of a schedule's area is reached."""
    pieces, total = _pieces(knots), integral(knots)
    reached, time = part * F.lit(float(total)), F.when(F.lit(False), F.lit(0.0))
    for t, u, w, v, before in pieces:
        slope, upto = (v - w) / (u - t), before + (u - t) * (w + v) / 2
        area = F.greatest(reached - F.lit(float(before)), F.lit(0.0))
        # slope/2 x² + w x = area, solved so that a level piece needs no other form.
        root = F.sqrt(F.greatest(F.lit(float(w * w)) + F.lit(float(2 * slope)) * area, F.lit(0.0)))
        x = F.coalesce(F.try_divide(F.lit(2.0) * area, F.lit(float(w)) + root), F.lit(0.0))
        time = time.when(reached < F.lit(float(upto)), F.least(F.lit(float(t)) + x, F.lit(float(u))))
    return time.otherwise(F.lit(1.0))


def targets(sized: DataFrame, schedules: Sequence[Knots] = SCHEDULES, share: Fraction = SHARE, cap: int = CAP) -> DataFrame:
    """``sized(source, source_size)``, one row a source, with rank (from 1), kind of schedule and target."""
    weights = [integral(knots) for knots in schedules]
    unit = 1
    for weight in weights:
        unit *= weight.denominator
    whole = F.lit([int(weight * unit) for weight in weights]).cast("array<bigint>")
    ranked = dense_rank_rows(sized.withColumn("_none", F.col("source").isNull()), ["_none", "source"], "rank").drop("_none")
    kind = ((F.col("rank") - 1) % len(schedules)).cast("int")
    sources = materialize(ranked.withColumn("kind", kind).withColumn("weight", F.get(whole, F.col("kind"))), "sources")
    sums = lambda rows: tuple(int(v or 0) for v in rows.agg(F.sum(F.col("source_size").cast(BIG)), F.sum("weight")).first())
    words, weight = sums(sources)
    full, level, parts = (0, 0), share.numerator * words, share.denominator * weight
    while parts:
        # Full are those whose share by weight, weight * level / parts, is not below their cap.
        over = (F.col("source_size").cast(BIG) * F.lit(cap) * F.lit(parts).cast(BIG)) <= F.col("weight").cast("decimal(9,0)") * F.lit(level).cast(BIG)
        before, full = full, sums(sources.where(over))
        if full == before:
            break
        level, parts = share.numerator * words - share.denominator * cap * full[0], share.denominator * (weight - full[1])
    most = (F.col("source_size") * cap).cast("double")
    shared = (F.col("weight").cast("decimal(9,0)") * F.lit(level).cast(BIG)).cast("double") / F.lit(float(parts)) if parts else most
    return sources.select("source", "source_size", "rank", "kind", F.least(most, shared).alias("target"))


def mix(
    docs: DataFrame, schedules: Sequence[Knots] = SCHEDULES, share: Fraction = SHARE, cap: int = CAP,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """row, doc_id, source, size, source_size, target and passes of every document.

    ``passes`` lists how often it is taken: pass from 0, words, and position from 0 to 1.
    """
    text = whole_text(text_col)
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    base = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), key.alias("key"),
        ), "sizes",
    )
    sized = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = materialize(targets(sized, schedules, share, cap), "targets")
    same = base["source"].eqNullSafe(aims["source"])
    rows = materialize(
        base.join(aims, same).select(base["*"], "source_size", "rank", "kind", "target", F.substring("key", 1, DIGITS).alias("piece")), "aimed"
    )
    before = Window.partitionBy("rank").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        rows.groupBy("rank", "piece").agg(F.sum("size").alias("words")).select("rank", "piece", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset")),
        "offsets",
    )
    inside = Window.partitionBy("rank", "piece").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["rank", "piece"])
    goal, start = F.floor(F.col("target") + 0.5), F.col("offset") + F.col("inside")

    def taken(number: int) -> Column:
        at = start + F.lit(number) * F.col("source_size")
        part = F.coalesce(F.try_divide(at.cast("double"), F.col("target")), F.lit(0.0))
        time = F.when(F.lit(False), F.lit(0.0))
        for kind, knots in enumerate(schedules):
            time = time.when(F.col("kind") == kind, inverse(knots, part))
        words = F.least(F.greatest(goal - at, F.lit(0)), F.col("size"))
        return F.struct(F.lit(number).alias("pass"), words.alias("words"), time.alias("position"))

    passes = F.filter(F.array(*[taken(i) for i in range(cap)]), lambda p: p["words"] > 0)
    return placed.select("row", "doc_id", "source", "rank", "key", "size", "source_size", "target", passes.alias("passes"))


def schedule(mixed: DataFrame) -> DataFrame:
    """A row for each time a document is taken, range-sorted by position, with its place from 1.

    Documents that are not taken come last, once, without position and place.
    """
    rows = mixed.select("*", F.explode_outer("passes").alias("_p")).select(
        *[c for c in mixed.columns if c != "passes"], F.col("_p.pass").alias("pass"), F.coalesce("_p.words", F.lit(0)).alias("words"),
        F.col("_p.position").alias("position"), F.col("_p").isNull().alias("_none"),
    )
    placed = dense_rank_rows(rows, ["_none", "position", "rank", "key", "pass"], "place")
    return placed.withColumn("place", F.when(~F.col("_none"), F.col("place"))).drop("_none")


def by_document(scheduled: DataFrame) -> DataFrame:
    """One row for each document: what the schedule takes of it, and its first place and position."""
    once = lambda c: F.min(c).alias(c)
    return scheduled.groupBy("row").agg(
        once("doc_id"), once("size"), once("source_size"), once("target"), F.sum("words").alias("taken"),
        F.count("pass").alias("passes"), F.min("place").alias("first_place"), F.min("position").alias("first_position"),
    ).drop("row")
