"""One key holds a third of all rows: results stay whole, and joins are split."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from usagelens.operators import clean, closure, dictionary, flatten, listing, lookups, nested, remap, resolve
from usagelens.session import Scratch, materialize
from usagelens.sinks import tables

N = 300_000


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """As with tables too large to broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    for n in names:
        spark.conf.unset(n)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def hot(spark, n=N):
    """`k` is 0 in a third of the rows, else spread over many values."""
    return spark.range(n, numPartitions=8).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50_021).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("load"),
    )


def is_split(df) -> bool:
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


NO_FIELDS = "cast(array() as array<struct<name:string,desc:string,access:int,annotations:array<struct<type:string,members:string>>>>) as fields"
# Rows with k = 0: every third id, and the multiples of the modulus.
ZEROS = len([i for i in range(N) if i % 3 == 0 or i % 50_021 == 0])


def test_own_reference_cleaning_splits_the_hot_member(spark):
    refs = hot(spark).select(
        F.lit(1).alias("artifact_id"), F.col("id").alias("position"), F.sha2(F.col("load"), 512).alias("class_name"),
        F.concat(F.lit("o"), "k").alias("owner"), F.lit("m").alias("name"), F.lit("()V").alias("descriptor"),
    )
    member = "struct('m' as name, '()V' as desc, 9 as access, cast(array() as array<struct<type:string,members:string>>) as annotations)"
    records = spark.range(1, 60_000).selectExpr(
        "1 as artifact_id", "id as position", "concat('o', id) as name", "'p' as super",
        "cast(array() as array<string>) as interfaces", f"array({member}) as methods", NO_FIELDS)
    kept = clean.drop_own_references(refs, materialize(clean.removable_members(records), "removable"), "methods")
    assert kept.count() == ZEROS and is_split(kept)


def test_remapping_splits_the_hot_name(spark):
    names = hot(spark).select(F.concat(F.lit("x/"), F.col("k").cast("string")).alias("name"), "id", "load")
    mapping = spark.range(60_000).select(F.concat(F.lit("x/"), F.col("id").cast("string")).alias("original"), F.concat(F.lit("y/"), F.col("id").cast("string")).alias("mapped"))
    done = remap.remap_names(names, "name", mapping, "x/")
    assert done.where("name = 'y/0'").count() == ZEROS
    assert done.where("name like 'x/%'").count() == 0 and is_split(done)


def test_lookup_splits_the_hot_name(spark):
    artifacts = hot(spark).select(
        "id", F.col("id").cast("int").alias("int_project_id"), F.lit(None).cast("string").alias("text_project_id"),
        F.lit(None).cast("string").alias("coordinates"), F.lit(False).alias("loader"), F.concat("k", F.lit("-name")).alias("name"))
    requests = spark.createDataFrame([(lookups.NAME, "0-name"), (lookups.INT_ID, "5")], "kind string, key string")
    found = lookups.lookup(requests, artifacts)
    assert found.count() == ZEROS + 1 and is_split(found)


def test_repeated_names_keep_every_row(spark):
    named = hot(spark).select("id", F.col("k").cast("string").alias("name"), "load")
    counts = named.groupBy("name").count().where("count > 1").agg(F.sum("count")).first()[0]
    repeated = lookups.duplicate_names(named)
    assert repeated.count() == counts and is_split(repeated)


def test_newest_version_of_a_hot_id(spark):
    rows = hot(spark).select(F.col("k").alias("id"), F.col("id").cast("int").alias("n"), F.concat(F.lit("1."), F.col("id") % 1000).alias("version"))
    best = nested.newest_per_id(rows, ["id"], F.col("version"), F.array("n"), ["version", "n"])
    got = best.where("id = 0").select("version", "n", "first_seen").first()
    assert (got.version, got.n, got.first_seen) == ("1.999", 999, [0])


def test_counting_references_of_a_hot_owner(spark):
    got = flatten.count_references(hot(spark).select("k"), ["k"])
    assert got.agg(F.max("count"), F.sum("count")).first()[1] == N


def test_dictionary_over_many_values_is_dense(spark):
    ids = dictionary.build(hot(spark).select("load"), ["load"])
    got = ids.agg(F.count("id"), F.countDistinct("id"), F.min("id"), F.max("id")).first()
    assert tuple(got) == (N, N, 1, N)
    sorted_pairs = ids.orderBy("load").limit(3).collect()
    assert [r.id for r in sorted_pairs] == [1, 2, 3]


def test_classes_of_a_hot_artifact_are_complete(spark):
    artifacts = spark.range(60_000).select("id", F.col("id").cast("int").alias("int_project_id"), F.lit(None).cast("string").alias("text_project_id"))
    defs = hot(spark).select(F.col("k").alias("artifact_id"), F.col("load").alias("class_name"))
    requests = spark.range(60_000).select(F.col("id").cast("string").alias("pid"))
    got = listing.classes_of(requests, artifacts, defs)
    assert got.count() == N and is_split(got)


def test_a_round_of_the_closure_moves_no_edges(spark):
    edges = hot(spark, 60_000).select(F.col("k").alias("parent"), (F.col("id") + 1_000_000).alias("child"))
    frontier = materialize(spark.range(1000).select(F.col("id").alias("root"), F.col("id").alias("node")), "frontier")
    with Scratch(spark, "closure") as scratch:
        graph = closure.lay_out(edges, scratch, bound=1000)
        assert [(r.node, r.slices) for r in graph.hubs.collect()] == [(0, 21)]
        biggest = graph.edges.groupBy("node", "slice").count().agg(F.max("count")).first()[0]
        assert biggest < 1200
        placed = closure.one_step(frontier, 1000, graph, scratch)
        placed.collect()
        lines = placed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "slice#" in line and "Bucketed: true" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    above, least = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < least:
            above, least = [*above, line], depth(line)
            if "SortMergeJoin" in line:
                break
    assert "SortMergeJoin" in above[-1] and not any("Exchange" in line for line in above)


def test_hub_parent_in_closure(spark):
    edges = hot(spark, 60_000).select(F.col("k").alias("parent"), (F.col("id") + 1_000_000).alias("child"))
    roots = spark.range(3).select(F.col("id").alias("root"))
    got = {r.root: r["count"] for r in closure.descendants(edges, roots).groupBy("root").count().collect()}
    assert got[0] == 20_000 + len([i for i in range(0, 60_000, 50_021) if i % 3])


def test_bucket_with_most_rows_is_written_by_several_tasks(spark, tmp_path):
    import glob
    path = str(tmp_path / "t")
    table = hot(spark).select("k", F.col("load").alias("v"))
    tables.write_buckets(table, path, "k", 4)
    keys = spark.createDataFrame([(0,)], "k long")
    new = table.where("k = 0")
    tables.replace_in_buckets(new, keys, path, "k", 4)
    stored = spark.read.parquet(path)
    assert stored.count() == N
    bucket = stored.where("k = 0").select("bucket").first()[0]
    assert len(glob.glob(f"{path}/bucket={bucket}/*.parquet")) > 1


def test_shared_hashes_with_a_hot_hash(spark):
    files = hot(spark).select(F.lit("n").alias("name"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("catalogue"), F.col("k").cast("string").alias("sha1"))
    in_a, in_b = ({r[0] for r in files.where(f"catalogue = '{c}'").select("sha1").distinct().collect()} for c in "ab")
    assert resolve.shared_hashes(files).first()["common"] == len(in_a & in_b)


def test_removable_members_of_a_hot_artifact(spark):
    member = "struct(concat('m', id % 7) as name, '()V' as desc, cast(id % 16 as int) as access, cast(array() as array<struct<type:string,members:string>>) as annotations)"
    records = hot(spark, 60_000).selectExpr(
        "k as artifact_id", "id as position", "concat('c', id) as name", "'p' as super", "cast(array() as array<string>) as interfaces", f"array({member}) as methods", NO_FIELDS)
    got = clean.removable_members(records)
    assert got.count() == records.where("(id % 16) & 5 = 0 or (id % 16) & 8 <> 0").count()


def test_other_joins_with_an_aggregated_side_are_split(spark):
    rows = hot(spark)
    described = rows.select(F.concat(F.lit("(Lx/"), "k", F.lit(";)V")).alias("d"), "id", "load")
    mapping = spark.createDataFrame([("x/0", "y/0")], "original string, mapped string")
    done = remap.remap_descriptors(described, "d", mapping, "x/")
    assert done.where("d = '(Ly/0;)V'").count() == ZEROS and is_split(done)

    contained = rows.select("id", F.array("id").alias("first_seen"), F.col("k").alias("fingerprint"), "load")
    files = rows.select(F.col("k").alias("fingerprint"), F.col("id").alias("position"), F.col("id").alias("file_id"), F.lit("p").alias("project_id"))
    matched = resolve.match_fingerprints(contained, files, first_only=False)
    assert matched.count() == N and is_split(matched)

    digests = rows.select(F.col("load").alias("archive"), F.col("k").alias("digest_0"))
    copies = resolve.same_content(digests, "archive")
    assert copies.agg(F.max("copies")).first()[0] == ZEROS and is_split(copies)

    keys = rows.where("k <> 0").select("k")
    left = tables.replace_by_key(rows, rows.where("false"), keys, "k")
    assert left.count() == ZEROS and is_split(left)


def test_hot_and_missing_keys_beside_known_ones(spark):
    """A third asks for one hash, another third for none."""
    files = spark.range(N, numPartitions=8).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("0")).when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("sha1"),
        F.sha2(F.col("id").cast("string"), 256).alias("load"),
    )
    known = files.where("id % 6 < 2").groupBy("sha1").agg(F.min("id").alias("artifact_id"))
    found = lookups.by_hash(files, known)
    assert is_split(found)
    assert (found.count(), found.where("artifact_id is null").count()) == (N, N // 3 + N // 6)
    new = lookups.unknown_hashes(files, known)
    assert is_split(new) and new.count() == N // 3 + N // 6 and new.where("sha1 is null").count() == N // 3
    absent = lookups.not_indexed(files, known, "sha1")
    assert absent.columns[:1] == ["sha1"] and absent.count() == N // 3 + N // 6
