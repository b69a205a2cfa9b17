"""Sharding by balanced label propagation, in DataFrame functions alone.

Documents with equal texts are linked, each to the node of its text. Every document
starts in the shard its hash gives. In a round each node names the shard that holds most
of its documents, and documents elsewhere ask to move there; a shard takes those with
the least hash, as long as its linked documents stay within its share of all rows (its
quota). Rounds end when no one moves. Then the law ``rows`` is made exact: shards above
their share give up unlinked documents first, which cuts nothing, and those go to shards
below it, so counts differ by one at most.

A group that exceeds a shard's quota fills one shard and keeps the rest elsewhere. Only
counts come to the driver: rows and free places of each shard.

Null texts have size 1 and the checksum of the empty text; null ids are rows like any
other. Rows with equal ids are placed one by one. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import numbered, whole_text

ROUNDS = 12  # moves end long before; a round more changes no result's validity
STEPS = 1024  # pieces in which a shard takes what asks to move to it
NODE = ["node_a", "node_b", "size"]


def _constant(values: list[int], at: Column) -> Column:
    return F.get(F.lit(values).cast("array<bigint>"), at)


def _counts(rows: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(linked: DataFrame, shards: int, quota: int) -> DataFrame:
    """Move linked documents (a written table with its shards) towards their neighbours' shards."""
    for turn in range(ROUNDS):
        tallies = linked.groupBy(*NODE, "shard").agg(F.count(F.lit(1)).alias("n"))
        best = materialize(
            tallies.groupBy(*NODE).agg(F.max_by("shard", F.struct("n", -F.col("shard"))).alias("best"), F.count(F.lit(1)).alias("spread"))
            .where("spread > 1").drop("spread"), "best",
        )
        # The rows of a node with very many are plain rows beside a written side, and are split.
        asked = materialize(
            linked.join(best, NODE, "left")
            .withColumn("step", F.pmod(F.xxhash64("doc_id", "node_b", F.lit(turn)), F.lit(STEPS)))
            .withColumn("moves", F.coalesce(F.col("best") != F.col("shard"), F.lit(False))), "asked",
        )
        held = _counts(linked, shards)
        wanted = {(r["best"], r["step"]): r["count"] for r in asked.where("moves").groupBy("best", "step").count().collect()}
        taken, limits = 0, []
        for shard in range(shards):
            room, step = quota - held[shard], 0
            while step < STEPS and wanted.get((shard, step), 0) <= room:
                room -= wanted.get((shard, step), 0)
                taken += wanted.get((shard, step), 0)
                step += 1
            limits.append(step)
        if not taken:
            break
        goes = F.col("moves") & (F.col("step") < _constant(limits, F.col("best")))
        linked = asked.select("doc_id", *NODE, "crc", F.when(goes, F.col("best")).otherwise(F.col("shard")).alias("shard"))
    return linked


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row, under the law ``rows``."""
    text = whole_text(text_col)
    base = materialize(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("node_a"), F.xxhash64(text, F.lit(1)).alias("node_b"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        ).withColumn("shard", F.pmod(F.xxhash64("doc_id", "node_a"), F.lit(shards)).cast("int")), "base",
    )
    shared = materialize(base.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared")
    marked = materialize(base.join(shared.withColumn("linked", F.lit(1)), NODE, "left"), "marked")
    loose = marked.where("linked IS NULL").drop("linked")
    linked = marked.where("linked = 1").drop("linked")
    rows = marked.count()
    moved = propagate(linked, shards, rows // shards)
    columns = ["doc_id", "size", "crc", "shard", "class_linked"]
    placed = materialize(
        loose.withColumn("class_linked", F.lit(0)).select(*columns)
        .union(moved.withColumn("class_linked", F.lit(1)).select(*columns)), "placed",
    )
    # Exact counts: the fullest shards keep the odd rows.
    held = _counts(placed, shards)
    share, odd = divmod(rows, shards)
    fullest = sorted(range(shards), key=lambda s: (-held[s], s))[:odd]
    goals = [share + (s in fullest) for s in range(shards)]
    surplus = [max(0, h - g) for h, g in zip(held, goals)]
    starts = [sum(surplus[:s]) for s in range(shards)]
    ranked = numbered(placed, ["shard"], ["class_linked", "doc_id", "size", "crc"], "rank")
    # The movers of all shards, numbered through, fill the free places in order.
    number = F.col("rank") + _constant(starts, F.col("shard"))
    target, upto = F.lit(0), 0
    for shard in range(shards):
        free = max(0, goals[shard] - held[shard])
        target = F.when((number >= upto) & (number < upto + free), shard).otherwise(target) if free else target
        upto += free
    even = materialize(
        ranked.select(
            "doc_id", "size", "crc",
            F.when(F.col("rank") < _constant(surplus, F.col("shard")), target).otherwise(F.col("shard")).cast("int").alias("shard"),
        ), "even",
    )
    slotted = numbered(even, ["shard"], ["doc_id", "size", "crc"], "slot")
    return slotted.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
