"""Archives read as one loader reads them: artifacts, contained artifacts, and the files these name.

An archive is opened in two steps. Its directory, manifest and descriptor say whether it is
an artifact and which files are wanted; then those files' bytes alone are read. Contained
archives are opened only below artifacts, so what lies under an archive that is none is
neither read nor listed. Nothing is shuffled: text leaves the task that opened the archive.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.backfill import _toml_json
from ..operators.nested import build_nested
from .archives import BATCH_BYTES, LIST_BY_COORDINATE
from .describe import LIBRARY_ATTRIBUTE, MANIFEST, manifest_json
from .metadata import from_flat_descriptor, project_metadata


@dataclass(frozen=True)
class Loader:
    """A loader's descriptor file, and the service files that make an archive a library of it.

    A TOML descriptor lists parts; contained archives are listed by coordinate. A JSON
    descriptor describes one part and lists contained archives by file; it knows no libraries.
    """

    descriptor: str
    services: tuple[str, ...] = ()

    @property
    def toml(self) -> bool:
        return self.descriptor.endswith(".toml")


# The descriptors of two loaders.
TOML_LOADER, JSON_LOADER = Loader("META-INF/mods.toml"), Loader("fabric.mod.json")

_DATA = re.compile(r"data/.+\.json", re.S)
SCAN = (
    "archive string, chain array<int>, container string, kind string, path string, text string, id string, version string, "
    "descriptor_text string, descriptor string, manifest_text string, first_class string"
)
_COLUMNS = [c.split(" ")[0] for c in SCAN.split(", ")]


class _Jar:
    """One opened archive and what its directory, manifest and descriptor say."""

    def __init__(self, content: bytes, loader: Loader):
        self.jar, self.loader = zipfile.ZipFile(io.BytesIO(content)), loader
        self.paths = list(dict.fromkeys(i.filename for i in self.jar.infolist() if not i.is_dir()))
        self.present = set(self.paths)
        self.manifest, self.text = self.read(MANIFEST), self.read(loader.descriptor)
        self.parsed = self._parsed()
        self.parts = self._parts()

    def read(self, path: str) -> str | None:
        """A file as text; null where it is missing or no UTF-8."""
        if path not in self.present:
            return None
        try:
            return self.jar.read(path).decode("utf-8")
        except UnicodeDecodeError:
            return None

    def _parsed(self) -> dict | None:
        try:
            found = json.loads(_toml_json(self.text) if self.loader.toml else self.text)
        except (TypeError, ValueError, RecursionError):
            return None
        return found if isinstance(found, dict) else None

    def _parts(self) -> list[dict]:
        if self.parsed is None:
            return []
        if not self.loader.toml:
            return [self.parsed] if all(isinstance(self.parsed.get(k), str) for k in ("id", "version")) else []
        mods = self.parsed.get("mods")
        return [m for m in mods if isinstance(m, dict)] if isinstance(mods, list) else []

    @property
    def is_artifact(self) -> bool:
        if self.parts or not self.loader.toml:
            return bool(self.parts)
        main = re.split(r"(?:\r?\n){2}", re.sub(r"\r?\n ", "", self.manifest or ""), maxsplit=1)[0]
        marked = any(line.startswith(f"{LIBRARY_ATTRIBUTE}: ") for line in main.splitlines())
        return marked or any(f"META-INF/services/{s}" in self.present for s in self.loader.services)

    def contained(self) -> list[tuple[str, str | None, str | None]]:
        """(path, id, version) of listed archives that exist; a list that cannot be read is empty."""
        try:
            if self.loader.toml:
                listed = json.loads(self.read(LIST_BY_COORDINATE) or "{}")["jars"]
                named = [(j["path"], f"{j['identifier']['group']}:{j['identifier']['artifact']}", j["version"]["artifactVersion"]) for j in listed]
            else:
                named = [(j["file"], None, None) for j in self.parsed.get("jars") or []]
        except (ValueError, KeyError, TypeError, AttributeError):
            return []
        return [item for item in named if item[0] in self.present]

    def wanted(self) -> Iterator[tuple[str, str]]:
        """(kind, path) of the files whose bytes are read; extension files are those that parts name."""
        for path in self.paths:
            if _DATA.fullmatch(path):
                yield "data", path
        if self.loader.toml:
            for path in dict.fromkeys(p["enumExtensions"] for p in self.parts if isinstance(p.get("enumExtensions"), str)):
                yield "extension", path.lstrip("/")


def _rows(archive: str, content: bytes, loader: Loader, chain: list[int], container: str, ident, version) -> Iterator[tuple]:
    place = archive, chain, container
    try:
        jar = _Jar(content, loader)
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
        if not chain:
            yield *place, "failed", None, f"{type(e).__name__}: {e}", *[None] * 6
        return  # a contained archive that cannot be opened is left out
    if chain and not loader.toml and jar.parts:
        ident, version = jar.parsed["id"], jar.parsed["version"]
    if not jar.is_artifact:
        if not chain:
            yield *place, "other", None, None, *[None] * 6
        return
    first = next((p for p in jar.paths if p.endswith(".class")), None)
    described = json.dumps(jar.parsed, ensure_ascii=False, sort_keys=True) if jar.parsed is not None else None
    yield *place, "artifact", None, None, ident, version, jar.text, described, jar.manifest, first
    for kind, path in jar.wanted():
        text = jar.read(path)
        if text is None:
            yield *place, "failed", path, "missing or no UTF-8", *[None] * 6
        else:
            yield *place, kind, path, text, *[None] * 6
    for number, (path, inner_id, inner_version) in enumerate(jar.contained()):
        yield from _rows(archive, jar.jar.read(path), loader, [*chain, number], f"{container}!{path}", inner_id, inner_version)


def scan(archives: DataFrame, loader: Loader) -> DataFrame:
    """Rows of ``(path, content)`` archives, by kind.

    ``artifact`` for the archive and every contained artifact, with descriptor and manifest;
    ``data`` and ``extension`` for wanted files; ``failed`` for an archive that cannot be
    opened or a wanted file that is not there; ``other`` for an archive that is no artifact.
    ``chain`` holds the places in the lists down to a contained archive, and is empty for the
    archive itself. Write the result before it is used more than once.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for archive, content in zip(batch["path"], batch["content"]):
                for row in _rows(archive, bytes(content), loader, [], "", None, None):
                    rows.append(row)
                    held += sum(len(v) for v in row[5:] if v)
                    if held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=_COLUMNS)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=_COLUMNS)

    return archives.select("path", "content").mapInPandas(read, SCAN)


def artifacts(scanned: DataFrame, loader: Loader) -> DataFrame:
    """The stored columns of every artifact in a scan, contained ones included, with its descriptor and manifest."""
    rows = scanned.where("kind = 'artifact'")
    text = F.col("descriptor")
    # The flat form becomes the one with parts; a library's descriptor, if any, has none.
    form = text if loader.toml else from_flat_descriptor(text)
    class_name = F.replace(F.regexp_replace("first_class", r"\.class$", ""), F.lit("/"), F.lit("."))
    described = rows.select(
        "archive", "chain", "container", F.col("descriptor_text").alias("metadata"), F.col("descriptor").alias("metadata_json"),
        form.alias("descriptor"), manifest_json(F.coalesce("manifest_text", F.lit(""))).alias("manifest"),
        F.col("version").alias("fallback_version"), F.col("id").alias("coordinates"), class_name.alias("class_name"),
    )
    title = F.try_variant_get(F.try_parse_json("manifest"), "$['']['Implementation-Title']", "string")
    named = described.withColumn("library_name", F.coalesce("coordinates", title, "class_name")).drop("class_name")
    kept = named.select("archive", "chain", "container", "metadata", "metadata_json", F.col("manifest").alias("manifest_json"), "descriptor",
                        "manifest", "fallback_version", "coordinates", "library_name")
    return project_metadata(kept).withColumnRenamed("manifest_json", "manifest")


def nested_trees(scanned: DataFrame) -> DataFrame:
    """(archive, nested_tree) of archives that contain artifacts."""
    name = lambda chain: F.concat(F.col("archive"), F.lit("!"), F.array_join(chain, "!"))
    inner = scanned.where("kind = 'artifact' AND size(chain) > 0")
    edges = inner.select(
        name(F.slice("chain", F.lit(1), F.size("chain") - 1)).alias("parent"), name(F.col("chain")).alias("child"),
        F.element_at("chain", -1).alias("position"), "id", "version", (F.size("chain") - 1).alias("depth"),
    )
    deepest = edges.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    return build_nested(edges, deepest).select(F.regexp_replace("root", "!$", "").alias("archive"), "nested_tree")


def index_rows(scanned: DataFrame, loader: Loader) -> DataFrame:
    """One row for each archive that is an artifact: all columns that its stored row takes from the archive."""
    own = artifacts(scanned, loader).where("size(chain) = 0").drop("chain", "container")
    return own.join(nested_trees(scanned), "archive", "left")


def files(scanned: DataFrame, kind: str) -> DataFrame:
    """(archive, path, content) of an archive's own ``data`` or ``extension`` files."""
    return scanned.where((F.col("kind") == kind) & (F.size("chain") == 0)).select("archive", "path", F.col("text").alias("content"))


def failures(scanned: DataFrame) -> DataFrame:
    """(archive, error) of archives that cannot be indexed, one row each."""
    message = F.concat_ws(": ", "path", "text")
    return scanned.where("kind = 'failed' AND size(chain) = 0").groupBy("archive").agg(F.min(message).alias("error"))
