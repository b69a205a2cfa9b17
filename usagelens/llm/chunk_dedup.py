"""Exact duplicates by recipes of content-defined chunks, in DataFrame functions alone.

A text is normalised (runs of white space become one space) and cut after the words
whose hash is a multiple of ``EVERY``: equal passages are cut alike wherever they stand.
A recipe lists the identifiers of a text's chunks in order, and texts are equal when
their recipes are. An identifier is the chunk's hash, verified: every distinct chunk is
brought together once by its hash, and where two texts share a hash they are told apart
by a number. Long documents themselves are never moved; after the chunks are verified,
eight bytes for each chunk are.

A text without white space is one chunk. Null texts count as empty. The least id of
equal texts stays; null ids stay only if all ids of their group are null. Rows with
equal ids and equal texts count one by one in the size of their group, and are reported
together; ``keep_first`` keeps one of them. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import SPACES, one_row_each, whole_text

EVERY = 64


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(whole_text(text), SPACES, " ")


def chunks(text: Column, every: int = EVERY) -> Column:
    """Chunks of a normalised text. A second space, which no such text has, marks a cut.

    Joined by spaces they are the text, with one space more if its last word asks for a cut.
    """
    marked = F.transform(F.split(text, " "), lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(every)) == 0, F.concat(w, F.lit(" "))).otherwise(w))
    return F.split(F.array_join(marked, " "), "  ")


def _hash(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.pmod(F.xxhash64(chunk), F.lit(1 << bits))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64, every: int = EVERY) -> DataFrame:
    """doc_id, text_sha256, recipe and marks of every row, as a written table.

    ``marks`` numbers the chunks whose hash is shared by different chunks, in order; it is
    empty for all but such documents.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    plain = materialize(
        source.select(
            "doc_id", F.sha2("norm", 256).alias("text_sha256"),
            F.transform(chunks(F.col("norm"), every), lambda c: _hash(c, bits)).alias("recipe"),
        ), "recipes",
    )
    pieces = source.select("doc_id", "norm", F.posexplode(chunks(F.col("norm"), every)).alias("pos", "chunk"))
    distinct = pieces.select(_hash(F.col("chunk"), bits).alias("h"), "chunk").distinct()
    shared = materialize(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "shared")
    if shared.isEmpty():
        return plain.withColumn("marks", F.array().cast("array<int>"))
    # Different chunks under one hash: number them.
    hashed = pieces.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "pos", _hash(F.col("chunk"), bits).alias("h"), "chunk")
    clashing = materialize(hashed.join(shared, "h", "left_semi").distinct(), "clashing")
    own = clashing.groupBy("h", "chunk").agg(F.lit(0)).select("h", "chunk")
    ranks = own.groupBy("h").agg(F.array_sort(F.collect_list("chunk")).alias("all")).select(
        "h", F.posexplode("all").alias("rank", "chunk")
    )
    marks = materialize(
        clashing.join(materialize(ranks, "ranks"), ["h", "chunk"]).groupBy("doc_id", "text_sha256")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rank"))), lambda m: m["rank"]).alias("marks")), "marks",
    )
    same = plain["doc_id"].eqNullSafe(marks["doc_id"]) & (plain["text_sha256"] == marks["text_sha256"])
    return materialize(
        plain.join(marks, same, "left").select(
            plain["doc_id"], plain["text_sha256"], "recipe", F.coalesce("marks", F.array().cast("array<int>")).alias("marks")
        ), "marked",
    )


def groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    listed = recipes(docs, **options).withColumn("_key", F.xxhash64("recipe", "marks"))
    same = ["_key", "recipe", "marks"]
    # Written, so that a group of very many copies is split in the join.
    classes = materialize(listed.groupBy(*same).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "classes")
    return listed.join(classes, same).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with its own columns."""
    found = groups(docs).where("kept")
    kept = materialize(found.groupBy("doc_id", F.col("text_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("n")), "kept")
    return one_row_each(docs, kept, F.sha2(normalised(), 256))
