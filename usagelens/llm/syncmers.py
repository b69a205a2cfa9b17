"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is a sequence of atoms: its words, those of more than eight characters cut after
every eighth. A k-mer of eight atoms is a closed syncmer when the least of its seven
inner pairs is its first or its last; whether it is chosen depends on nothing outside
it, so an unchanged passage keeps its anchors wherever it stands. ``anchors`` gives their
hashes and places; a fingerprint is the ``SKETCH`` least distinct hashes, and the
likeness of two fingerprints is the share of common hashes among the least of both.

For fingerprints every text with atoms is set between seven marks on either side, which
are no atoms, so one rule holds at every length: a text of one atom has eight k-mers, at
least one of them a syncmer, and k-mers at its ends tell short texts apart. ``anchors``
leaves out the k-mers with marks, as they depend on where a passage stands. Texts without
atoms have the empty fingerprint, and two of those are alike. Null texts count as empty. Null ids come before all others, rows with equal ids are ordered by text, and
the one document of a table follows itself. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import partitions, whole_text

SKETCH = 64
K = 8  # atoms in a k-mer; the steps of with_syncmers build on it, and on pairs inside
ATOM = r"[^\x20\x09-\x0D]{1,8}"


def _shifted(name: str, by: int) -> Column:
    return F.slice(F.col(name), F.lit(by + 1), F.greatest(F.size(name) - by, F.lit(0)))


def _zip(name: str, by: int, merge) -> Column:
    """Merge every element of an array with the one ``by`` places on; elements without partner go."""
    head = F.slice(F.col(name), F.lit(1), F.greatest(F.size(name) - by, F.lit(0)))
    return F.zip_with(head, _shifted(name, by), merge)


def _marked(atoms: Column) -> Column:
    """The hashes of a text between those of the marks; no atom has a space."""
    before, after = (F.array(*[F.xxhash64(F.lit(f"{side} {i}")) for i in range(K - 1)]) for side in ("before", "after"))
    return F.when(F.size(atoms) > 0, F.concat(before, atoms, after)).otherwise(atoms)


def with_syncmers(rows: DataFrame, text: str, name: str, marks: bool) -> DataFrame:
    """Add ``name``: for every k-mer in order its hash if it is a closed syncmer, else null.

    With ``marks``, k-mers that reach over the ends of the text count as well.

    Each step is a column of its own, used more than once by the next, so it is computed once.
    """
    kept = [F.col(c) for c in rows.columns]
    least = lambda a, b: F.least(a, b)
    mixed = lambda a, b: F.xxhash64(a, b)
    hashed = rows.select(*kept, F.transform(F.regexp_extract_all(F.col(text), F.lit(ATOM), F.lit(0)), lambda a: F.xxhash64(a)).alias("_h"))
    if marks:
        hashed = hashed.select(*kept, _marked(F.col("_h")).alias("_h"))
    return (
        hashed.select(*kept, _zip("_h", 1, mixed).alias("_s"))
        .select(*kept, "_s", _zip("_s", 1, least).alias("_m2"), _zip("_s", 2, mixed).alias("_k4"), _zip("_s", 6, least).alias("_edge"))
        .select(*kept, "_edge", _zip("_m2", 2, least).alias("_m4"), _zip("_k4", 4, mixed).alias("_k8"))
        .select(*kept, "_edge", "_k8", _zip("_m4", 3, least).alias("_m7"))
        .select(
            *kept,
            F.zip_with(F.zip_with("_edge", "_m7", lambda e, m: e == m), "_k8", lambda chosen, k: F.when(chosen, k)).alias(name),
        )
    )


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, hash) of all anchors inside the texts; positions count atoms."""
    rows = with_syncmers(docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")), "text", "k", marks=False)
    return rows.select("doc_id", F.posexplode("k").alias("position", "hash")).where("hash IS NOT NULL")


def with_sketch(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: the least distinct hashes of a text's anchors, as 32-bit numbers."""
    kept = [F.col(c) for c in rows.columns]
    short = F.transform(F.array_compact("_k"), lambda k: F.shiftright(k, 32).cast("int"))
    return with_syncmers(rows, text, "_k", marks=True).select(*kept, F.slice(F.sort_array(F.array_distinct(short)), 1, SKETCH).alias(name))


def digits(sketch: str) -> Column:
    """A sketch as text, eight hex digits for each hash."""
    return F.array_join(F.transform(sketch, lambda v: F.lower(F.lpad(F.hex(v.cast("bigint").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Common hashes among the least of both sketches, from 0 to 1."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(common / F.size(union))


def with_next(rows: DataFrame, order: str, ties: str, fields: list[str]) -> DataFrame:
    """Add next_<field> of the following row in ascending ``order``; the first follows the last.

    Rows are dealt to blocks of successive ids by counted bounds, and the first row of
    each block is also dealt to the block before, so one shuffle brings neighbours together.
    """
    spark = rows.sparkSession
    key = F.coalesce(F.col(order).cast("bigint"), F.lit(-(1 << 63)))
    wanted = 4 * partitions(spark)
    shares = [i / wanted for i in range(1, wanted)]
    found = rows.agg(F.percentile_approx(key, shares, F.lit(100 * wanted)).alias("bounds")).first()["bounds"]
    bounds = sorted(set(found or [])) or [0]
    # The number of bounds up to the key, by halving steps.
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    listed = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if len(bounds) < 50 else F.lit(bounds).cast("array<bigint>")
    block = F.aggregate(
        F.lit(steps), F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(listed, at + step - 1) <= F.col("_key")), at + step).otherwise(at),
    )
    keyed = rows.withColumn("_key", key).withColumn("_block", block)
    # One row for each block.
    firsts = {r["_block"]: r["first"] for r in keyed.groupBy("_block").agg(F.min("_key").alias("first")).collect()}
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    size = len(bounds) + 1
    first = F.get(F.lit([firsts.get(b) for b in range(size)]).cast("array<bigint>"), F.col("_block"))
    previous = F.get(F.lit([before.get(b, 0) for b in range(size)]), F.col("_block"))
    here = F.struct(F.col("_block").alias("block"), F.lit(0).alias("guest"))
    places = F.when(F.col("_key") == first, F.array(here, F.struct(previous.alias("block"), F.lit(1).alias("guest")))).otherwise(F.array(here))
    dealt = keyed.select(*rows.columns, F.explode(places).alias("_place")).select(*rows.columns, "_place.block", "_place.guest")
    ordered = Window.partitionBy("block").orderBy("guest", F.col(order).asc_nulls_first(), ties)
    return (
        dealt.select(*rows.columns, "guest", *[F.lead(f).over(ordered).alias(f"next_{f}") for f in fields])
        .where("guest = 0").drop("guest")
    )


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    own = with_sketch(docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")), "text", "sketch")
    pairs = with_next(own, "doc_id", "text", ["text", "sketch"])
    n = F.char_length("text")
    replaced = F.floor(n / 4).cast("int")
    edited = pairs.select(
        "doc_id", n.cast("bigint").alias("n_chars"), "sketch", "next_sketch",
        F.concat(F.substring(F.col("text"), F.lit(1), n - replaced), F.substring(F.col("next_text"), F.lit(1), replaced)).alias("edited"),
    )
    edited = edited.select("doc_id", "n_chars", "sketch", "next_sketch", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    return with_sketch(edited, "edited", "edited_sketch").select(
        "doc_id", "n_chars", "edited_sha256", digits("sketch").alias("fingerprint"),
        digits("edited_sketch").alias("edited_fingerprint"), likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
