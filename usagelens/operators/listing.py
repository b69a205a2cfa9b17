"""Artifact listing, facets, scopes and the class drill-down."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsonvalues import any_depth, json_text
from .filters import Filter, all_keys, any_of, by_key, exists_any_of

# Filter keys a listing understands.
CLASS_NAME, IDENTIFIER, COORDINATES, AUTHORS = "Any class name", "Identifier", "Coordinates", "Authors"
LICENSE, CONTAINED, IN_PACK = "License", "Any contained artifact", "In pack"

# Two artifacts equal in all of these are one row when a class filter is used.
DISPLAYED = ["name", "version", "ids", "license", "authors", "metadata_json",
             "coordinates", "int_project_id", "text_project_id"]


def project_key() -> Column:
    return F.coalesce(F.col("int_project_id").cast("string"), F.col("text_project_id"))


def display(artifacts: DataFrame) -> DataFrame:
    return artifacts.select(
        F.when(F.col("name") == "", "Unknown").otherwise(F.col("name")).alias("artifact_name"),
        "version",
        F.array_join("ids", ", ").alias("identifiers"),
        "license",
        "authors",
        json_text(F.col("metadata_json"), "$.modLoader").alias("language_loader"),
        "coordinates",
        "int_project_id",
        "text_project_id",
        project_key().alias("pid"),
    )


def select_artifacts(
    artifacts: DataFrame,
    filters: Iterable[Filter] = (),
    class_defs: DataFrame | None = None,
    packs: DataFrame | None = None,
) -> DataFrame:
    """Artifact rows a filter list keeps, before projection.

    ``class_defs(artifact_id, class_name)`` serves the class filter and
    ``packs(pack_id, int_project_id)`` the pack filter. Both become semi joins on
    distinct keys, so neither multiplies rows, and an artifact with very many
    classes is one key. Only the first pack filter counts, and an empty pack
    keeps nothing.
    """
    grouped = by_key(filters)
    columns = {
        IDENTIFIER: F.get("ids", F.lit(0)),  # null on an empty array
        COORDINATES: F.col("coordinates"),
        AUTHORS: F.col("authors"),
        LICENSE: F.col("license"),
    }
    plain = [f for fs in grouped.values() for f in fs]
    kept = artifacts.where(~F.col("loader")).where(all_keys(columns, plain))
    if CONTAINED in grouped:
        kept = kept.where(exists_any_of(any_depth(F.col("nested_tree"), "id"), grouped[CONTAINED]))
    if IN_PACK in grouped:
        members = packs.where(F.col("pack_id") == grouped[IN_PACK][0].value)
        kept = kept.join(members.select("int_project_id").distinct(), "int_project_id", "left_semi")
    if CLASS_NAME in grouped:
        named = class_defs.where(any_of(F.col("class_name"), grouped[CLASS_NAME]))
        owners = named.select(F.col("artifact_id").alias("id")).distinct()
        kept = kept.join(owners, "id", "left_semi").select(DISPLAYED).distinct()
    return kept


def list_artifacts(artifacts: DataFrame, filters: Iterable[Filter] = (), **tables) -> DataFrame:
    """The listing: selected, displayed, ordered by name.

    The further sort keys give equal names an order, and let the range sort cut
    a name that many artifacts share over several tasks.
    """
    shown = display(select_artifacts(artifacts, filters, **tables))
    return shown.orderBy("artifact_name", "version", "pid")


def count_listing(artifacts: DataFrame, filters: Iterable[Filter] = (), **tables) -> DataFrame:
    return select_artifacts(artifacts, filters, **tables).agg(F.count(F.lit(1)).alias("rows"))


def facets(artifacts: DataFrame) -> DataFrame:
    """Distinct filter values per facet, from one scan and one shuffle."""
    value = lambda facet, column: F.array(F.struct(F.lit(facet).alias("facet"), column.alias("value")))
    many = lambda facet, column: F.transform(
        column, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value"))
    )
    nothing = F.array().cast("array<struct<facet:string,value:string>>")
    offered = F.concat(
        F.coalesce(many(IDENTIFIER, F.col("ids")), nothing),
        F.coalesce(many(CONTAINED, any_depth(F.col("nested_tree"), "id")), nothing),
        value(AUTHORS, F.col("authors")),
        value(LICENSE, F.col("license")),
        value(COORDINATES, F.col("coordinates")),
    )
    return (
        artifacts.select(F.inline(offered))
        .where(F.col("value").isNotNull())
        .distinct()
        .withColumn("value", F.replace(F.col("value"), F.lit('"'), F.lit("")))
    )


def in_scope(table: DataFrame, game_version: str, loader: str) -> DataFrame:
    """One scope of a table; on its partition columns this prunes directories."""
    return table.where((F.col("game_version") == game_version) & (F.col("loader") == loader))


def scopes(table: DataFrame, pattern: str = "1.%") -> DataFrame:
    return table.select("game_version", "loader").where(F.col("game_version").like(pattern)).distinct()


def typed_project_ids(artifacts: DataFrame) -> DataFrame:
    """One row per (artifact, project id), with the id spelled by its type."""
    keys = F.array(
        F.concat(F.lit("i:"), F.col("int_project_id").cast("string")),
        F.concat(F.lit("t:"), F.col("text_project_id")),
    )
    return artifacts.select("*", F.explode(F.array_compact(keys)).alias("project_key"))


def request_key(pid: Column) -> Column:
    """An id made of digits only asks for the integer project id, else the text one."""
    return F.when(
        F.rlike(pid, F.lit("^[0-9]+$")),
        F.concat(F.lit("i:"), pid.try_cast("int").cast("string")),
    ).otherwise(F.concat(F.lit("t:"), pid))


def classes_of(requests: DataFrame, artifacts: DataFrame, class_defs: DataFrame) -> DataFrame:
    """Class names of every requested project id (``requests(pid)``), by name."""
    wanted = requests.select("pid", request_key(F.col("pid")).alias("project_key")).distinct()
    found = typed_project_ids(artifacts).select("project_key", F.col("id").alias("artifact_id"))
    return (
        wanted.join(found, "project_key")
        .join(class_defs.select("artifact_id", "class_name"), "artifact_id")
        .select("pid", "class_name")
        .orderBy("pid", "class_name")
    )
