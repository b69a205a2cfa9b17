"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments. Fingerprints that differ in at most
three bits differ in at most one bit of one segment. So a table holds every fingerprint
under each of its segments, and each fingerprint asks it for its segments and for those
with one more bit set (the pair's other half has that bit clear, so one side asks).
What comes back is verified on all 64 bits. Documents with one fingerprint are one
entry of the table, so copies form no pairs; links join components.

Null texts count as empty; texts without words have fingerprint zero and are linked like
any other. ``groups`` leaves null ids without component; ``keep_one`` says what it does with them. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import one_row_each, whole_text
from .components import components

SEED = 42  # of the shingles' XXH64
SHINGLE = 3
BITS, SEGMENTS, DISTANCE = 64, 2, 3
PIECE = 1 << 22  # bytes of a text that are cut into words at once
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(text: bytes, shingle: int = SHINGLE):
    """Hashes of a text's shingles, some at a time."""
    held: list[bytes] = []
    at, whole = 0, False
    while at < len(text):
        found = _SPACE.search(text, min(at + PIECE, len(text)))
        end = found.start() if found else len(text)
        words = held + text[at:end].split()
        if len(words) >= shingle:
            whole = True
            joined = [b" ".join(some) for some in zip(*[words[i:] for i in range(shingle)])]
            yield np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64, len(joined))
        held, at = words[-(shingle - 1):] if len(words) >= shingle else words, end
    if not whole and held:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: str) -> int:
    """The fingerprint as a signed number."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in _hashes(text.encode("utf-8", "surrogatepass").lower()):
        for at in range(0, len(hashes), 1 << 16):
            some = np.ascontiguousarray(hashes[at:at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(text: str = "text") -> Column:
    @F.pandas_udf("bigint")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return made(whole_text(text))


def links(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the ids in ``classes(fp, id)`` whose fingerprints differ in 1 to 3 bits."""
    width = BITS // SEGMENTS
    mask = (1 << width) - 1
    segment = lambda s: F.expr(f"shiftrightunsigned(fp, {s * width}) & {mask}L")
    entries = F.array(*[F.struct(F.lit(s).alias("s"), segment(s).alias("value")) for s in range(SEGMENTS)])
    stored = classes.select("fp", "id", F.explode(entries).alias("e")).select(
        F.col("e.s").alias("s"), F.col("e.value").alias("value"), F.col("fp").alias("fp_b"), F.col("id").alias("b")
    )
    # -1 asks for the segment itself, i for the segment with bit i set as well.
    asked = (
        classes.select("fp", "id", F.explode(entries).alias("e"))
        .select("fp", "id", "e", F.explode(F.sequence(F.lit(-1), F.lit(width - 1))).alias("i"))
        .where("i < 0 OR shiftrightunsigned(e.value, i) & 1 = 0")
        .select(
            F.col("e.s").alias("s"), F.expr("IF(i < 0, e.value, e.value | shiftleft(1L, i))").alias("value"),
            F.col("fp").alias("fp_a"), F.col("id").alias("a"), (F.col("i") < 0).alias("same"),
        )
    )
    # Catalyst takes both sides for as small as the classes, as it does not count what explode adds; so it must not broadcast one.
    met = asked.join(stored.hint("merge"), ["s", "value"]).where("NOT same OR fp_a < fp_b")
    return met.where(f"bit_count(fp_a ^ fp_b) BETWEEN 1 AND {DISTANCE}").select("a", "b")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    made = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprints(text_col).alias("fp")), "fingerprints")
    classes = materialize(made.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    linked = components(links(classes))
    placed = materialize(
        classes.join(linked.withColumnRenamed("node", "id").hint("merge"), "id", "left")
        .select("fp", F.coalesce("component", "id").alias("component_id")), "placed"
    )
    return made.join(placed.hint("merge"), "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with its own columns: that with the least id.

    Rows with null id link like any other. They go where their component has an id, and
    else one of them stays; so does one of repeated rows.
    """
    sha = F.sha2(whole_text(), 256)
    made = materialize(docs.select("doc_id", sha.alias("sha"), fingerprints().alias("fp")), "fingerprints")
    texts = made.groupBy("fp", "doc_id", "sha").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha", "n"))
    classes = materialize(texts.groupBy("fp").agg(first.alias("first")), "classes")
    linked = components(links(classes.select("fp", F.col("fp").alias("id"))))
    joined = classes.join(linked.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    kept = joined.groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("first").alias("first"))
    return one_row_each(docs, materialize(kept.select("first.*"), "kept"), sha)
