"""Archives inside archives: flattening, expansion, search and rebuilding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsonvalues import any_depth
from ..functions.versions import version_key
from ..session import new_path, write_counted
from .filters import Filter, exists_any_of

NODE_FIELDS = ("id", "version", "sha1")


def flatten_tree(trees: DataFrame, keys: list[str], tree: str = "nested_tree") -> DataFrame:
    """One row per archive at any depth of a JSON tree column.

    Adds ``path`` (positions from the top, so sorting by it is a walk in reading
    order), ``depth``, and the node's fields. One round per level; each level is
    written to the shared folder, and the loop ends at the first empty one.
    """
    spark = trees.sparkSession
    base = new_path(spark, "tree")

    def level(source: DataFrame, path: Column) -> DataFrame:
        children = F.try_variant_get(F.try_parse_json("subtree"), "$", "array<variant>")
        nodes = source.select(*keys, path.alias("above"), F.posexplode(children))
        text = lambda f: F.try_variant_get("col", f"$.{f}", "string").alias(f)
        return nodes.select(
            *keys,
            F.concat("above", F.array("pos")).alias("path"),
            F.size("above").alias("depth"),
            *[text(f) for f in NODE_FIELDS],
            F.to_json(F.try_variant_get("col", "$.nested", "variant")).alias("subtree"),
        )

    top = trees.select(*keys, F.col(tree).alias("subtree")).where(F.col("subtree").isNotNull())
    current = level(top, F.array().cast("array<int>"))
    schema = current.schema
    written: list[str] = []
    while True:
        written.append(f"{base}/level={len(written)}")
        if not write_counted(current, written[-1]):
            break
        stored = spark.read.schema(schema).parquet(written[-1])
        current = level(stored.where(F.col("subtree").isNotNull()), F.col("path"))
    return spark.read.schema(schema).parquet(*written).drop("subtree")


def earliest(path: Column) -> Column:
    """An order key that is greatest for the first path in reading order."""
    return F.concat(F.transform(path, lambda p: -p), F.array(F.lit(1)))


def newest_per_id(
    rows: DataFrame, keys: list[str], version: Column, path: Column, carry: list[str]
) -> DataFrame:
    """The row of the greatest version per key; on a tie the earliest stays.

    ``first_seen`` is where the key first occurred, at whatever version.
    A maximum over (version key, order) is partial on the map side, so one id
    with most of the rows needs no window over its group.
    """
    best = F.max_by(F.struct(*carry), F.struct(version_key(version), earliest(path)))
    return (
        rows.groupBy(*keys).agg(best.alias("best"), F.min(path).alias("first_seen"))
        .select(*keys, "best.*", "first_seen")
    )


def expand_nested(
    candidates: DataFrame, order: str = "position", tree: str = "nested_tree", scope: tuple = ()
) -> DataFrame:
    """Every contained archive once, at its greatest version.

    Archives inside a version that loses are still visited. ``scope`` columns
    separate independent batches.
    """
    nodes = flatten_tree(candidates, [*scope, order], tree)
    place = F.concat(F.array(F.col(order).cast("bigint")), F.col("path").cast("array<bigint>"))
    carry = ["version", "sha1", order, "path", "depth"]
    return newest_per_id(nodes, [*scope, "id"], F.col("version"), place, carry)


def nested_ids(artifacts: DataFrame, keys: list[str], tree: str = "nested_tree") -> DataFrame:
    """Distinct ids at any depth per artifact, without walking levels."""
    return artifacts.select(*keys, F.explode(F.array_distinct(any_depth(F.col(tree), "id"))).alias("id"))


def containing(artifacts: DataFrame, filters: list[Filter], tree: str = "nested_tree") -> DataFrame:
    """Artifacts with at least one contained id that passes the filters."""
    return artifacts.where(exists_any_of(any_depth(F.col(tree), "id"), filters))


def build_nested(edges: DataFrame, depth: int) -> DataFrame:
    """Trees from ``edges(parent, child, position, id, version, depth)``.

    Built from the deepest level up: each step turns the children of one parent
    into an ordered JSON array and hangs it on the parent's own row. ``nested``
    is left out where empty, and a root without children has no row, that is,
    no tree. A tree is one value of one row, so it has to fit in a task.
    """
    below = None
    for level in range(depth, -1, -1):
        rows = edges.where(F.col("depth") == level)
        if below is None:
            rows = rows.withColumn("nested", F.lit(None).cast("string"))
        else:
            rows = rows.join(below, rows["child"] == below["owner"], "left").drop("owner")
        fields = [
            F.concat(F.lit('{"id":'), _quoted(F.col("id")), F.lit(',"version":'), _quoted(F.col("version"))),
            F.coalesce(F.concat(F.lit(',"nested":'), F.col("nested")), F.lit("")),
            F.lit("}"),
        ]
        ordered = F.sort_array(F.collect_list(F.struct("position", F.concat(*fields).alias("json"))))
        joined = F.array_join(F.transform(ordered, lambda n: n["json"]), ",")
        below = rows.groupBy(F.col("parent").alias("owner")).agg(
            F.concat(F.lit("["), joined, F.lit("]")).alias("nested")
        )
    return below.select(F.col("owner").alias("root"), F.col("nested").alias("nested_tree"))


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    one = F.to_json(F.array(text))
    return F.regexp_replace(one, r"^\[|\]$", "")
