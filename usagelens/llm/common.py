"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import materialize, tune

# ASCII white space as the contracts count it, for Java regular expressions.
SPACES = r"[\x20\x09-\x0D]+"

# Pieces in which a group is numbered; their sizes are a table of this many rows for each group.
SLICES = 1_024


def prepared(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches that are bounded in bytes, for very long texts."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def whole_text(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def one_row_each(docs: DataFrame, kept: DataFrame, sha: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``kept(doc_id, sha, n)`` names, one where ``n`` rows share id and text.

    ``sha`` is the checksum of a row's text as ``kept`` has it; ids may be null. ``kept`` must be a written table.
    It grows with the corpus, and its files tell little of what a broadcast of it would take on the driver, so it is merged.
    """
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), sha.alias("_sha"))
    same = F.col("_id").eqNullSafe(kept["doc_id"]) & (F.col("_sha") == kept["sha"])
    if kept.where("n > 1").isEmpty():
        return own.join(kept.hint("merge"), same, "left_semi").select("_row.*")
    met = own.join(kept.hint("merge"), same).select("_row", "_id", "_sha", "n")
    tied = met.where("n > 1").groupBy("_id", "_sha").agg(F.min_by("_row", F.coalesce(F.col("_row")[text_col], F.lit(""))).alias("_row"))
    return met.where("n = 1").select("_row").union(tied.select("_row")).select("_row.*")


def numbered(rows: DataFrame, within: list[str], order: list[str], name: str, slices: int = SLICES) -> DataFrame:
    """Add ``name``: gapless numbers from 0 inside each group of ``within``, without one task per group.

    Rows are dealt by hash into ``slices`` pieces of each group; a row's number is its
    place in its piece plus the size of the pieces before it. The leading columns of
    ``order`` that are named ``class_`` keep their precedence over the hash. ``rows``
    must be a written table, since it is read twice.
    """
    ranked = [c for c in order if c.startswith("class_")]
    keyed = rows.withColumn("_slice", F.pmod(F.xxhash64(*[c for c in order if c not in ranked]), F.lit(slices)))
    groups = [*within, *ranked, "_slice"]
    sizes = keyed.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
    # At most slices rows for each group and class: a table of fixed size.
    before = Window.partitionBy(*within).orderBy(*ranked, "_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size"), "offsets"
    )
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    placed = keyed.withColumn("_place", place)
    same = [placed[c].eqNullSafe(offsets[c]) for c in groups]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    kept = [placed[c] for c in rows.columns]
    return placed.join(F.broadcast(offsets), condition).select(
        *kept, (placed["_place"] - 1 + offsets["_before"]).cast("bigint").alias(name)
    )
