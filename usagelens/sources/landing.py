"""Landing tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas

TABLES: dict[str, T.StructType] = {
    "class_records": schemas.CLASS_RECORD,
    "artifacts": schemas.ARTIFACT,
    "projects": schemas.PROJECT,
    "files": schemas.FILE,
    "known_files": schemas.KNOWN_FILE,
    "known_file_ids": schemas.KNOWN_FILE_ID,
    "data_files": schemas.PATH_CONTENT,
    "mappings": schemas.MAPPING,
}


def read(spark: SparkSession, table: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A landing table; ``fmt`` is ``parquet``, ``json`` or ``orc``.

    Scope columns ``game_version`` and ``loader`` come from the directory names
    when the table is laid out by scope, and prune the directories read.
    """
    scope = T.StructType([
        T.StructField("game_version", T.StringType()), T.StructField("loader", T.StringType()),
    ])
    schema = TABLES[table]
    if "loader" in schema.names:  # the artifact table's own flag has the same name
        return spark.read.schema(schema).format(fmt).load(path)
    laid_out = spark.read.schema(T.StructType([*schema.fields, *scope.fields])).format(fmt)
    return laid_out.load(path)


def latest_by_name(records: DataFrame) -> DataFrame:
    """The deciding record of every class name in an artifact."""
    every = F.struct(*[c for c in records.columns if c not in ("artifact_id", "name")])
    return records.groupBy("artifact_id", "name").agg(F.max_by(every, "position").alias("r")).select(
        "artifact_id", "name", "r.*"
    )
