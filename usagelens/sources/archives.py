"""Archive files to entry rows, nested archives included."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Where an archive lists the archives inside it.
LIST_BY_COORDINATE = "META-INF/jarjar/metadata.json"
LIST_BY_FILE = "fabric.mod.json"

ENTRY = (
    "archive string, container string, depth int, place int, position bigint, path string, "
    "id string, version string, content binary, error string"
)
BATCH_BYTES = 1 << 20


def _nested(jar: zipfile.ZipFile) -> Iterator[tuple[str, str | None, str | None]]:
    """``(path, id, version)`` of listed archives that exist."""
    present = set(jar.namelist())
    if LIST_BY_COORDINATE in present:
        for item in json.loads(jar.read(LIST_BY_COORDINATE)).get("jars") or []:
            ident = item["identifier"]
            if item["path"] in present:
                yield item["path"], f"{ident['group']}:{ident['artifact']}", item["version"]["artifactVersion"]
    if LIST_BY_FILE in present:
        for item in json.loads(jar.read(LIST_BY_FILE)).get("jars") or []:
            if item["file"] in present:
                yield item["file"], None, None


def _own_id(jar: zipfile.ZipFile) -> tuple[str | None, str | None]:
    if LIST_BY_FILE not in jar.namelist():
        return None, None
    described = json.loads(jar.read(LIST_BY_FILE))
    return described.get("id"), described.get("version")


def _entries(archive: str, container: str, depth: int, place: int, ident, version, content: bytes) -> Iterator[tuple]:
    try:
        jar = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        yield archive, container, depth, place, 0, None, ident, version, None, str(e)
        return
    with jar:
        for position, info in enumerate(i for i in jar.infolist() if not i.is_dir()):
            yield archive, container, depth, place, position, info.filename, ident, version, jar.read(info), None
        try:
            listed = list(_nested(jar))
        except (ValueError, KeyError, TypeError):
            listed = []  # an unreadable list means no nested archives
        for inner_place, (path, inner_id, inner_version) in enumerate(listed):
            inner = jar.read(path)
            if inner_id is None:
                try:
                    with zipfile.ZipFile(io.BytesIO(inner)) as z:
                        inner_id, inner_version = _own_id(z)
                except (zipfile.BadZipFile, ValueError):
                    continue
                if inner_id is None:
                    continue
            yield from _entries(archive, f"{container}!{path}", depth + 1, inner_place, inner_id, inner_version, inner)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split(" ")[0] for c in ENTRY.split(", ")]
    for batch in batches:
        rows, held = [], 0
        for archive, content in zip(batch["path"], batch["content"]):
            for row in _entries(archive, "", 0, 0, None, None, bytes(content)):
                rows.append(row)
                held += len(row[8] or b"")
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def scan_archives(archives: DataFrame) -> DataFrame:
    """Entries of ``(path, content)`` archives.

    Spark spreads the archives; one archive at a time is opened in a task, and
    entries leave it in batches of bounded bytes. ``container`` is the chain of
    nested archives an entry lies in, ``place`` the nested archive's place in the
    list of its parent, and ``id`` and ``version`` what that list calls it. An
    unreadable archive gives one row with ``error`` and does not stop the others.
    """
    return archives.select("path", "content").mapInPandas(_scan, ENTRY)


def read_archives(spark: SparkSession, path: str, pattern: str = "*.jar") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", "true"
    )
    return scan_archives(files.load(path))
