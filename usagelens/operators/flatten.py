"""Nested class records to flat fact tables keyed by natural keys."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsonvalues import canonical_json

DEF_KEY = ["artifact_id", "position", "name"]


def _def_key() -> list[Column]:
    return [F.col("artifact_id"), F.col("position"), F.col("name").alias("class_name")]


def class_defs(records: DataFrame) -> DataFrame:
    return records.select(*_def_key())


def class_parents(records: DataFrame) -> DataFrame:
    """Super class, when there is one, and interfaces."""
    parents = F.concat(F.array("super"), F.col("interfaces"))
    return records.select(*_def_key(), F.explode(parents).alias("parent")).where("parent IS NOT NULL")


def whole(items: str) -> Column:
    """A list of which most parts are read, for ``explode``; an empty list is none.

    Of a bare column Spark asks the size where the table is read, and so builds a list
    that is put together from other columns twice.
    """
    return F.when(F.size(items) > 0, F.col(items))


def _members(records: DataFrame, kind: str, keep: Callable[[Column], Column] | None) -> DataFrame:
    if keep is None:
        return records.select(*_def_key(), F.explode(kind).alias("m"))
    return records.select(*_def_key(), F.explode(whole(kind)).alias("m")).where(keep(F.col("m")))


def member_defs(records: DataFrame, kind: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """``kind`` is ``fields`` or ``methods``. Access flags are not kept.

    ``keep`` tells which members stay. It is asked of rows: a condition on rows is
    compiled, one inside a list is interpreted for each member.
    """
    return _members(records, kind, keep).select(
        "artifact_id", "position", "class_name",
        F.col("m.name").alias("name"), F.col("m.desc").alias("descriptor"),
    )


def class_annotations(records: DataFrame) -> DataFrame:
    return records.select(*_def_key(), F.explode("annotations").alias("a")).select(
        "artifact_id", "position", "class_name", *_annotation()
    )


def member_annotations(records: DataFrame, kind: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    return _members(records, kind, keep).select(
        "artifact_id", "position", "class_name", F.col("m.name").alias("name"),
        F.col("m.desc").alias("descriptor"), F.explode("m.annotations").alias("a"),
    ).select("artifact_id", "position", "class_name", "name", "descriptor", *_annotation())


def _annotation() -> list[Column]:
    return [F.col("a.type").alias("annotation"), canonical_json(F.col("a.members")).alias("value")]


def references(records: DataFrame, kind: str, strict_smallint: bool = False) -> DataFrame:
    """``kind`` is ``method_refs`` or ``field_refs``.

    ``strict_smallint`` keeps the 16-bit count, which fails above 32767.
    """
    listed = records.select("artifact_id", "position", "name", F.explode(whole(kind)).alias("r"))
    return listed.select(*reference_columns(strict_smallint))


def reference_columns(strict_smallint: bool = False) -> list[Column]:
    """The columns of a reference ``r`` listed beside the key of its record."""
    count = F.col("r.count").cast("int")
    return [
        *_def_key(), F.col("r.owner").alias("owner"), F.col("r.name").alias("name"), F.col("r.desc").alias("descriptor"),
        (count.cast("smallint") if strict_smallint else count).alias("count"),
    ]


def flatten_records(
    records: DataFrame, strict_smallint: bool = False, keep: Mapping[str, Callable[[Column], Column]] = {}
) -> dict[str, DataFrame]:
    """The nine fact tables. Each reads only the nested columns it needs.

    ``keep`` tells for ``fields`` and ``methods`` which members stay.
    """
    return {
        "class_defs": class_defs(records),
        "class_parents": class_parents(records),
        "field_defs": member_defs(records, "fields", keep.get("fields")),
        "method_defs": member_defs(records, "methods", keep.get("methods")),
        "class_annotations": class_annotations(records),
        "field_annotations": member_annotations(records, "fields", keep.get("fields")),
        "method_annotations": member_annotations(records, "methods", keep.get("methods")),
        "method_references": references(records, "method_refs", strict_smallint),
        "field_references": references(records, "field_refs", strict_smallint),
    }


def count_references(instructions: DataFrame, keys: list[str]) -> DataFrame:
    """Occurrences of each reference, from one row per instruction."""
    return instructions.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def broken_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows that break a uniqueness rule: a parent listed twice by one class,
    or a member key repeated in one definition. Empty when the data is sound."""
    rules = {
        "class_parents": ["artifact_id", "position", "class_name", "parent"],
        "method_defs": ["artifact_id", "position", "class_name", "name", "descriptor"],
        "field_defs": ["artifact_id", "position", "class_name", "name"],
    }
    checks = [
        tables[t].groupBy(*k).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
        .select(F.lit(t).alias("table"), "artifact_id", "class_name", "copies")
        for t, k in rules.items()
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out
