"""Phrase collocations by SETM relational mining.

An occurrence relation holds a row (doc, at, id) for every place where a frequent phrase
of k words begins. Places count words and the marks between pieces, so two words are next
to one another in a piece exactly if their places are. Relations are persisted in buckets
of the document, sorted by place. A relation is merge-joined with itself at adjacent
places, which gives the phrases of k + 1 words whose first and last k words are frequent;
their pairs are group-counted, and the semi-join with the frequent pairs is the next
relation. Bucketed relations join without a shuffle; pairs are counted on the map side
before they move.

The words of a dictionary are counted as they are spelled and folded afterwards, so A to Z
are lower-cased on distinct forms only. A dictionary of up to ``BROADCAST`` rows is
broadcast; a larger one is joined by a shuffle, and the occurrences return to their buckets.

All is per lang, null being ``und``. Null texts count as empty. Rows are documents one by
one, also with equal or null ids; copies count as often as they occur. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.dictionary import dense_rank_rows
from ..session import Scratch, materialize
from .common import partitions, whole_text

MARKS = r".,;:!?\x0A-\x0D"  # between pieces
TOKEN = rf"[^\x20\x09{MARKS}]+|[{MARKS}]"
LONGEST, LEAST, TOP = 5, 100, 2000
COVERED = 100  # percent of a candidate's occurrences inside one longer candidate that drop it
BROADCAST = 200_000
SLICES = 256  # in which the best of a lang are found before they meet
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tokens(docs: DataFrame) -> DataFrame:
    """(doc, lang, at, form) of words and marks."""
    return docs.select("doc", "lang", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("at", "form"))


def _small(table: DataFrame, limit: int) -> bool:
    return table.limit(limit + 1).count() <= limit


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


class _Relations:
    """The occurrence relations of one run, level by level."""

    def __init__(self, scratch: Scratch, buckets: int, least: int, broadcast: int):
        self.scratch, self.buckets, self.least, self.broadcast = scratch, buckets, least, broadcast

    def _store(self, rows: DataFrame, name: str, placed: bool) -> DataFrame:
        """A relation in its buckets; rows that are not ``placed`` by document are shuffled first."""
        rows = rows.select("doc", "at", "id")
        if not placed:
            rows = rows.repartition(self.buckets, "doc")
        return self.scratch.write(rows, name, "doc", self.buckets, ("doc", "at"))

    def words(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The frequent words, and n of every lang."""
        forms = self.scratch.write(_tokens(docs).groupBy("lang", "form").agg(F.count(F.lit(1)).alias("n")), "forms")
        forms = forms.where(~F.col("form").rlike(f"^[{MARKS}]$")).withColumn("phrase", F.translate("form", UPPER, LOWER))
        totals = materialize(forms.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        frequent = forms.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= self.least)
        numbered = dense_rank_rows(frequent, ["lang", "phrase"], "id")
        words = materialize(
            numbered.select("id", "lang", "phrase", F.col("phrase").alias("last"), "f", F.lit(0).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("right")),
            "words",
        )
        self.forms = self.scratch.write(forms.join(words, ["lang", "phrase"]).select("lang", "form", "id"), "spelled")
        return words, totals

    def first(self, docs: DataFrame) -> DataFrame:
        """Occurrences of the frequent words."""
        small = _small(self.forms, self.broadcast)
        if small:  # whole texts move, which is less than their words would
            docs = docs.repartition(self.buckets, "doc")
        forms = F.broadcast(self.forms) if small else self.forms
        return self._store(_tokens(docs).join(forms, ["lang", "form"]), "at1", small)

    def adjacent(self, relation: DataFrame) -> DataFrame:
        """The merge join: phrases that begin one place after another one, as (doc, at, left, right)."""
        a = relation.select("doc", "at", F.col("id").alias("left"), (F.col("at") + 1).alias("then"))
        b = relation.select(F.col("doc").alias("doc_b"), F.col("at").alias("at_b"), F.col("id").alias("right"))
        met = a.hint("merge").join(b, (a["doc"] == b["doc_b"]) & (a["then"] == b["at_b"]))
        return met.select("doc", "at", "left", "right")

    def longer(self, shorter: DataFrame, relation: DataFrame, k: int) -> DataFrame:
        """The frequent phrases of ``k`` words, from those of one word less."""
        counted = self.adjacent(relation).groupBy("left", "right").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= self.least)
        pairs = self.scratch.write(counted, f"pairs{k}")
        begins = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"))
        ends = shorter.select(F.col("id").alias("right"), "last")
        named = pairs.join(begins, "left").join(ends, "right").select(
            "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f", "left", "right"
        )
        return materialize(dense_rank_rows(named, ["lang", "phrase"], "id").select("id", *named.columns), f"phrases{k}")

    def extended(self, relation: DataFrame, phrases: DataFrame, k: int) -> DataFrame:
        """The semi-join: occurrences of the frequent phrases of ``k`` words."""
        small = _small(phrases, self.broadcast)
        known = phrases.select("left", "right", "id")
        rows = self.adjacent(relation).join(F.broadcast(known) if small else known, ["left", "right"])
        return self._store(rows, f"at{k}", small)


def frequent_phrases(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", broadcast: int = BROADCAST,
) -> tuple[list[DataFrame], DataFrame]:
    """Tables (id, lang, phrase, last, f, left, right) of the frequent phrases of 1 to ``longest`` words, and n by lang.

    ``left`` and ``right`` are the ids of a phrase's first and last words but one, in the table before.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("doc"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), whole_text(text_col).alias("text")
    )
    with Scratch(spark, "occurrences") as scratch, _by_document(spark):
        relations = _Relations(scratch, partitions(spark), least, broadcast)
        words, totals = relations.words(rows)
        levels, relation = [words], relations.first(rows)
        for k in range(2, longest + 1):
            levels.append(relations.longer(levels[-1], relation, k))
            if k < longest:
                relation = relations.extended(relation, levels[-1], k)
                scratch.drop(f"at{k - 1}")
    return levels, totals


class _by_document:
    """Lets rows that are placed by document be joined by document and place without a shuffle."""

    KEY = "spark.sql.requireAllClusterKeysForCoPartition"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY)
        self.spark.conf.set(self.KEY, "false")

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.KEY, self.before)


def uncovered(levels: Sequence[DataFrame], percent: int = COVERED) -> DataFrame:
    """(lang, phrase, a, words) of the phrases of two words and more that no longer one covers.

    It is enough to look one word further: a phrase inside a longer one is inside one of
    the phrases between them, which are at least as frequent as the longer one.
    """
    kept = []
    for k, table in enumerate(levels[1:], 2):
        own = table.select("id", "lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("words"))
        if k < len(levels):
            ends = [levels[k].select(F.col(side).alias("id"), F.col("f").alias("longer")) for side in ("left", "right")]
            most = materialize(_union(ends).groupBy("id").agg(F.max("longer").alias("longer")), "longer")
            own = own.join(most, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
        kept.append(own.select("lang", "phrase", "a", "words"))
    return _union(kept)


def scored(candidates: DataFrame, levels: Sequence[DataFrame], totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) by the lowest cut of each candidate; the shortest first part wins ties."""
    counts = materialize(_union([table.select("lang", "phrase", "f") for table in levels]), "counts")
    parts = F.split("phrase", " ")
    joined = F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ")
    rest = F.array_join(F.slice(parts, F.col("k") + 1, F.col("words")), " ")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", joined.alias("first"), rest.alias("rest")
    )
    first = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    second = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    # At most 1,000 n, so the quotient is a long, although the products are not.
    wide = lambda a, b: f"CAST({a} AS decimal(19,0)) * CAST({b} AS decimal(19,0))"
    score = F.expr(f"(1000BD * ({wide('a', 'n')})) div ({wide('l', 'r')})")
    valued = cuts.join(first, ["lang", "first"]).join(second, ["lang", "rest"]).join(totals, "lang").select(
        "lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut")
    )
    return valued.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min("n").alias("n"), F.min("cut").alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )


def best(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each lang, found in slices first, so that no task ranks a lang whole."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    sliced = phrases.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    some = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, top: int = TOP, percent: int = COVERED, **options) -> DataFrame:
    """The collocations of every lang: lang, rank, phrase, a, l, r, n and score."""
    levels, totals = frequent_phrases(docs, **options)
    return best(scored(uncovered(levels, percent), levels, totals), top)
