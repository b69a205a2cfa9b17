"""Value dictionaries with stable, dense ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in the low 33 bits


def dense_rank_rows(rows: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """Number distinct rows 1..n in key order without a global window.

    A range sort places the rows; each task numbers its own, and per-task counts
    turn into offsets. The offsets table has one row per task, so broadcasting
    it and summing it in one window is bounded by the partition count, whatever
    the number of rows. The placed rows are written first, so both passes see
    the same placement even if an executor is lost in between.
    """
    placed = materialize(
        rows.orderBy(*keys).select(
            "*",
            F.spark_partition_id().alias("_task"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_row"),
        ),
        "ranked",
    )
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_count"))
        .select("_task", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    )
    return placed.join(F.broadcast(offsets), "_task").select(
        *rows.columns, (F.col("_offset") + F.col("_row") + 1).alias(name)
    )


def fresh(existing: DataFrame, values: DataFrame, keys: list[str], distinct: bool = False) -> DataFrame:
    """``(id, keys...)`` of the values that ``existing(id, keys...)`` lacks.

    Ids continue after the greatest, in key order, so the same batch gives the same ids again.
    ``distinct`` says that no value comes twice, which saves a task from holding them all to see it.
    """
    given = values.select(*keys)
    new = (given if distinct else given.distinct()).join(existing, keys, "left_anti")
    start = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    return dense_rank_rows(new, keys).select((F.col("rank") + start).alias("id"), *keys)


def extend(existing: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """``existing(id, keys...)`` plus an id for every value it lacks. Known ids never change."""
    return existing.select("id", *keys).union(fresh(existing, values, keys))


def build(values: DataFrame, keys: list[str]) -> DataFrame:
    """A first dictionary: ids 1..n in key order."""
    return dense_rank_rows(values.select(*keys).distinct(), keys, "id").select("id", *keys)


def resolve(rows: DataFrame, column: str, dictionary: DataFrame, key: str, alias: str) -> DataFrame:
    """Add the dictionary id of a column."""
    entry = dictionary.select(F.col("id").alias(alias), F.col(key).alias(column))
    return rows.join(entry, column, "left")


def member_dictionary(members: DataFrame, classes: DataFrame, constants: DataFrame) -> DataFrame:
    """``(owner, name, descriptor)`` -> id, over the ids of their parts."""
    parts = members.select("owner", "name", "descriptor").distinct()
    steps = [("owner", classes, "name", "owner_id"), ("name", constants, "constant", "name_id"),
             ("descriptor", constants, "constant", "descriptor_id")]
    keyed = reduce(lambda rows, s: resolve(rows, *s), steps, parts)
    return dense_rank_rows(
        keyed.select("owner_id", "name_id", "descriptor_id"),
        ["owner_id", "name_id", "descriptor_id"], "id",
    )
