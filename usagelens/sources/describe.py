"""From scanned archive entries to descriptors, data files and nested trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.backfill import toml_to_json
from .metadata import from_flat_descriptor

# Entries that describe an archive.
MANIFEST = "META-INF/MANIFEST.MF"
TOML_DESCRIPTOR = "META-INF/mods.toml"
JSON_DESCRIPTOR = "fabric.mod.json"
LIBRARY_ATTRIBUTE = "FMLModType"

_LINE = r"\r?\n"


def _attributes(section: Column) -> Column:
    lines = F.filter(F.split(section, _LINE), lambda l: F.contains(l, F.lit(": ")))
    pair = lambda l: F.struct(F.substring_index(l, ": ", 1), F.regexp_extract(l, r"(?s)^.*?: (.*)$", 1))
    return F.map_from_entries(F.transform(lines, pair))


def manifest_json(text: Column) -> Column:
    """Manifest text as a JSON object of sections; ``""`` is the main one."""
    sections = F.split(F.regexp_replace(text, _LINE + " ", ""), rf"({_LINE}){{2,}}")
    named = F.filter(
        F.transform(F.slice(sections, 2, F.size(sections)), _attributes), lambda a: F.map_contains_key(a, "Name")
    )
    entry = lambda a: F.struct(F.element_at(a, "Name"), F.map_filter(a, lambda k, _: k != "Name"))
    main = F.create_map(F.lit(""), _attributes(F.get(sections, F.lit(0))))
    return F.to_json(F.map_concat(main, F.map_from_entries(F.transform(named, entry))))


def describe_archives(
    entries: DataFrame, toml_descriptor: str = TOML_DESCRIPTOR, services: tuple[str, ...] = ()
) -> DataFrame:
    """One row per archive, nested ones included, that is an artifact.

    An archive counts when its descriptor lists parts, or when its manifest or
    one of the ``services`` files marks it as a library. Loaders differ in the
    path of their TOML descriptor and in their services. The result feeds
    ``project_metadata``; a library is named by its coordinates, else its
    manifest title, else its first class.
    """
    path = F.col("path")
    toml, flat = path == toml_descriptor, path == JSON_DESCRIPTOR
    text = F.col("content").cast("string")
    pick = lambda test: F.max(F.when(test, text))
    is_class = F.endswith(path, F.lit(".class"))
    found = entries.where(path.isNotNull()).groupBy("archive", "container", "depth").agg(
        pick(toml).alias("toml"), pick(flat).alias("flat"), pick(path == MANIFEST).alias("manifest_text"),
        F.min_by("path", F.when(is_class, F.col("position"))).alias("first_class"),
        F.max("id").alias("coordinates"), F.max("version").alias("fallback_version"),
        F.max(path.isin([f"META-INF/services/{s}" for s in services])).alias("has_service"),
    )
    described = found.withColumns({
        "descriptor": F.coalesce(toml_to_json("toml"), from_flat_descriptor(F.col("flat"))),
        "manifest": manifest_json(F.coalesce("manifest_text", F.lit(""))),
    })
    main = lambda name: F.try_variant_get(F.try_parse_json("manifest"), f"$['']['{name}']", "string")
    has_parts = F.try_variant_get(F.try_parse_json("descriptor"), "$.mods[0]", "variant").isNotNull()
    library = F.col("has_service") | main(LIBRARY_ATTRIBUTE).isNotNull()
    class_name = F.replace(F.regexp_replace("first_class", r"\.class$", ""), F.lit("/"), F.lit("."))
    return described.where(has_parts | library).select(
        "archive", "container", "depth", F.col("toml").alias("metadata"),
        F.when(has_parts, F.col("descriptor")).alias("descriptor"), "manifest", "fallback_version", "coordinates",
        F.when(~has_parts, F.coalesce("coordinates", main("Implementation-Title"), class_name)).alias("library_name"),
    )


def data_files(entries: DataFrame) -> DataFrame:
    """JSON files under ``data/``, as text."""
    return entries.where(F.rlike("path", F.lit(r"^data/.+\.json$"))).select(
        "archive", "container", "path", F.col("content").cast("string").alias("content")
    )


def nested_edges(entries: DataFrame) -> DataFrame:
    """Archive containment in the form ``build_nested`` takes."""
    name = lambda container: F.concat("archive", container)
    return entries.where("depth > 0").select(
        name(F.regexp_replace("container", "![^!]*$", "")).alias("parent"), name(F.col("container")).alias("child"),
        F.col("place").alias("position"), "id", "version", (F.col("depth") - 1).alias("depth"),
    ).distinct()
