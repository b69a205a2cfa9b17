"""Keyed lookups and set membership, as joins on request tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize

INT_ID, TEXT_ID, COORDINATE = "int_id", "text_id", "coordinate"
LOADER_COORDINATE, NAME = "loader_coordinate", "name"


def lookup_keys(artifacts: DataFrame) -> DataFrame:
    """One row per (artifact, kind of key, key) the index can be asked by."""
    pair = lambda kind, column: F.struct(F.lit(kind).alias("kind"), column.alias("key"))
    keys = F.array(
        pair(INT_ID, F.col("int_project_id").cast("string")),
        pair(TEXT_ID, F.col("text_project_id")),
        pair(COORDINATE, F.col("coordinates")),
        pair(LOADER_COORDINATE, F.when(F.col("loader"), F.col("coordinates"))),
        pair(NAME, F.col("name")),
    )
    return artifacts.select("id", F.inline(keys)).where(F.col("key").isNotNull())


def lookup(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts for ``requests(kind, key)``; many artifacts may share a key."""
    asked = materialize(requests.select("kind", "key").distinct(), "requests")
    return asked.join(lookup_keys(artifacts), ["kind", "key"])


def _beside(rows: DataFrame, known: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` joined with a written or stored side that keeps all of them or drops those that meet a row.

    Rows without a key meet nothing, so they are not shuffled to the one task that null
    keys would share.
    """
    keyed = F.col(key).isNotNull()
    met = rows.where(keyed).join(known.where(keyed), key, how)
    return met.unionByName(rows.where(~keyed), allowMissingColumns=True)


def by_hash(hashes: DataFrame, known_files: DataFrame) -> DataFrame:
    """Every requested ``sha1`` with the artifact it is known for, or null; many may ask for one hash."""
    return _beside(hashes, materialize(known_files.select("sha1", "artifact_id"), "known"), "sha1", "left")


def unknown_hashes(files: DataFrame, known_files: DataFrame) -> DataFrame:
    """Files still to index: those whose hash is not known."""
    return _beside(files, materialize(known_files.select("sha1").distinct(), "known"), "sha1", "left_anti")


def members_of(artifacts: DataFrame, wanted: DataFrame, id_column: str) -> DataFrame:
    """Artifacts whose project id is in ``wanted`` (same column name)."""
    return artifacts.join(wanted.select(id_column).distinct(), id_column, "left_semi")


def not_indexed(projects: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """Projects the index has no artifact for."""
    return _beside(projects, materialize(artifacts.select(key).distinct(), "indexed"), key, "left_anti")


def duplicate_names(artifacts: DataFrame, key: str = "name", at_least: int = 2) -> DataFrame:
    """Artifacts whose name occurs at least twice, ordered by name.

    Counting first leaves one row per repeated name to join with, instead of
    holding a whole name group in one window.
    """
    repeated = (
        artifacts.groupBy(key).agg(F.count("id").alias("copies")).where(F.col("copies") >= at_least)
    )
    return artifacts.join(materialize(repeated, "repeated"), key).orderBy(key, "id")


def changed_versions(latest: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Loader artifacts whose latest version is not the indexed one, or not indexed.

    ``latest(coordinates, latest_version)``. The comparison is on the text.
    """
    indexed = artifacts.where("loader").groupBy("coordinates").agg(F.max("version").alias("version"))
    return latest.join(indexed, "coordinates", "left").where(
        F.col("version").isNull() | (F.col("version") != F.col("latest_version"))
    )
