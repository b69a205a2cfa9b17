"""Catalogue landing tables: packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pack_members(packs: DataFrame, files: DataFrame) -> DataFrame:
    """Files named by pack manifests: ``packs(pack_id, manifest)`` to ``files(file_id)``."""
    named = F.from_json("manifest", "files array<struct<projectID:bigint,fileID:bigint>>")["files"]
    members = packs.select("pack_id", F.explode(named).alias("m")).select(
        "pack_id", F.col("m.fileID").alias("file_id")
    )
    return members.join(files, "file_id")
