"""Artifact metadata from parsed descriptor and manifest JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import join_authors

# The version of artifacts that state none, and its placeholder.
NO_VERSION = "0.0NONE"
JAR_VERSION = "${file.jarVersion}"


def _get(doc: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(doc, path, kind)


def _kind(doc: Column, path: str) -> Column:
    return F.schema_of_variant(_get(doc, path, "variant"))


def _text_list(doc: Column, path: str, element) -> Column:
    """A JSON array joined with ``", "``, or the plain value where it is no array."""
    items = F.transform(_get(doc, path, "array<variant>"), element)
    return F.when(F.startswith(_kind(doc, path), F.lit("ARRAY")), F.array_join(items, ", ")).otherwise(
        _get(doc, path)
    )


def from_flat_descriptor(content: Column) -> Column:
    """The single-artifact descriptor rewritten to the form with a ``mods`` list.

    Licenses and authors given as lists are joined; an author may be an object
    with a name.
    """
    doc = F.try_parse_json(content)
    author = lambda a: F.when(
        F.startswith(F.schema_of_variant(a), F.lit("OBJECT")), _get(a, "$.name")
    ).otherwise(_get(a, "$"))
    one = F.struct(
        _get(doc, "$.id").alias("modId"), _get(doc, "$.version").alias("version"),
        _get(doc, "$.name").alias("displayName"), _text_list(doc, "$.authors", author).alias("authors"),
    )
    whole = F.struct(
        _text_list(doc, "$.license", lambda v: _get(v, "$")).alias("license"), F.array(one).alias("mods")
    )
    return F.when(doc.isNotNull(), F.to_json(whole))


def project_metadata(rows: DataFrame) -> DataFrame:
    """Stored columns from ``(id, descriptor, manifest, fallback_version, coordinates,
    library_name)``; ``id`` may be any key columns.

    The archive version is the manifest's, else the caller's, else a constant;
    the first listed part names the artifact and its version. Without parts the
    library name is used.
    """
    inputs = ("descriptor", "manifest", "fallback_version", "coordinates", "library_name")
    keys = [c for c in rows.columns if c not in inputs]
    doc, man = F.try_parse_json("descriptor"), F.try_parse_json("manifest")
    implementation = _get(man, "$['']['Implementation-Version']")
    parts = _get(F.col("doc"), "$.mods", "array<variant>")
    jar = F.col("jar_version")
    version = lambda p: F.replace(
        F.coalesce(_get(p, "$.version"), F.lit(NO_VERSION)), F.lit(JAR_VERSION), jar
    )
    return (
        rows.withColumns({"doc": doc, "jar_version": F.coalesce(implementation, "fallback_version", F.lit(NO_VERSION))})
        .withColumn("parts", F.coalesce(parts, F.array().cast("array<variant>")))
        .withColumn("head", F.get("parts", F.lit(0)))
        .select(
            *keys,
            F.when(F.col("head").isNull(), jar).otherwise(version(F.col("head"))).alias("version"),
            F.coalesce(_get(F.col("head"), "$.displayName"), _get(F.col("head"), "$.modId"), "library_name", F.lit("")).alias("name"),
            F.transform("parts", lambda p: _get(p, "$.modId")).alias("ids"),
            join_authors(F.transform("parts", lambda p: _get(p, "$.authors"))).alias("authors"),
            _get(F.col("doc"), "$.license").alias("license"),
            "coordinates",
        )
    )
