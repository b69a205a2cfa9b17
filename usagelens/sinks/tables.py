"""Keyed changes to tables, as new DataFrames, and a bucketed table sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..session import materialize, remove_folder


def replace_by_key(current: DataFrame, new: DataFrame, replaced: DataFrame, key: str) -> DataFrame:
    """Drop the rows of every replaced key, add the new rows.

    ``replaced`` lists the keys, so a key without new rows is emptied.
    """
    gone = materialize(replaced.select(key).distinct(), "replaced")
    return current.join(gone, key, "left_anti").select(current.columns).unionByName(new)


def cascade_delete(tables: dict[str, DataFrame], deleted: DataFrame, key: str = "artifact_id") -> dict[str, DataFrame]:
    """Every fact table without the deleted artifacts. Dictionaries are not touched.

    Facts carry the artifact id, so no chain of parent tables is walked.
    """
    gone = materialize(deleted.select(key).distinct(), "deleted")
    return {name: t.join(gone, key, "left_anti") for name, t in tables.items()}


def insert_if_absent(
    current: DataFrame, new: DataFrame, keys: list[str], order: Column, refresh: bool = False
) -> DataFrame:
    """Add rows whose key is not there yet; of several new ones the first stays.

    An existing row is kept as it is, with its old date, unless ``refresh``.
    """
    others = [c for c in current.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("n")).select(*keys, "n.*")
    if refresh:
        return current.join(first, keys, "left_anti").select(current.columns).unionByName(first)
    return current.unionByName(first.join(current, keys, "left_anti"))


def upsert_metadata(
    current: DataFrame, new: DataFrame, key: str = "id", kept_when_null: tuple[str, ...] = ("coordinates",)
) -> DataFrame:
    """Overwrite every delivered column by key, with nulls too.

    Only ``kept_when_null`` columns keep the old value where the new one is null.
    Columns ``new`` lacks stay, and keys that ``current`` lacks are ignored.
    """
    changed = [c for c in new.columns if c != key]
    fresh = new.select(key, F.struct(*changed).alias("_new"))
    joined = current.join(fresh, key, "left")
    updated = F.col("_new").isNotNull()

    def value(c: str) -> Column:
        if c not in changed:
            return F.col(c)
        if c in kept_when_null:
            return F.coalesce(f"_new.{c}", c).alias(c)
        return F.when(updated, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) for c in current.columns])


def append_artifacts(current: DataFrame, new: DataFrame, loader: bool) -> DataFrame:
    """Add artifacts that already have an id, as normal or loader-flagged ones."""
    added = new.withColumn("loader", F.lit(loader))
    return current.unionByName(added, allowMissingColumns=True)


BUCKET = "bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)


def write_buckets(table: DataFrame, path: str, key: str, buckets: int) -> None:
    """Lay a table out by key bucket, the unit a later replacement rewrites."""
    _by_bucket(table.withColumn(BUCKET, bucket_of(key, buckets))).write.partitionBy(BUCKET).parquet(path)


def _by_bucket(table: DataFrame) -> DataFrame:
    """Rows of a bucket together, by size: a hot bucket is split over several
    tasks and files, small ones share a task."""
    return table.hint("rebalance", BUCKET)


def replace_in_buckets(new: DataFrame, replaced: DataFrame, path: str, key: str, buckets: int) -> None:
    """Replace the rows of some keys in a bucketed table.

    Only buckets that hold a replaced key are read and rewritten; all others stay
    as they are. The new files are staged and moved in at commit, and ``new`` is
    computed once. The driver only sees two lists of bucket numbers, bounded by
    ``buckets``. A bucket left without rows is removed, since no file would
    overwrite it. ``new`` may only hold replaced keys. The commit moves one bucket
    after the other, so readers and lost drivers can meet a part of it: where that
    matters, use ``generations``, which publishes a change as a whole.
    """
    spark = new.sparkSession
    if not new.join(replaced.select(key).distinct(), key, "left_anti").isEmpty():
        raise ValueError(f"new rows have values of {key} that are not replaced")
    touched = {r[0] for r in replaced.select(bucket_of(key, buckets)).distinct().collect()}
    if not touched:
        return
    keyed = new.withColumn(BUCKET, bucket_of(key, buckets))
    stored = spark.read.schema(keyed.schema).parquet(path).where(F.col(BUCKET).isin(*touched))
    merged = replace_by_key(stored, keyed, replaced, key)
    filled = Observation()
    (
        _by_bucket(merged).observe(filled, F.collect_set(BUCKET).alias("buckets")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    )
    for bucket in touched - set(filled.get["buckets"]):
        remove_folder(spark, f"{path}/{BUCKET}={bucket}")
