"""What a poll of one catalogue has to index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import same_second


def latest_file_per_project(files: DataFrame, game_version: str | None, loader: str | None) -> DataFrame:
    """The first listed file of each project that fits the scope."""
    fits = F.lit(True)
    if game_version is not None:
        fits = fits & F.array_contains("game_versions", game_version)
    if loader is not None:
        fits = fits & F.array_contains("loaders", loader)
    first = F.min_by(F.struct("file_id", "published", "sha1"), F.struct("position", "file_id"))
    return (
        files.where(fits).groupBy("catalogue", "project_id").agg(first.alias("f"))
        .select("catalogue", "project_id", "f.*")
    )


def latest_release(files: DataFrame, first_listed: Column) -> DataFrame:
    """Release date per project: of the newest file, or, in catalogues where
    ``first_listed`` holds, of the first listed one."""
    listed = F.min_by("published", F.struct("position", "file_id"))
    return files.groupBy("catalogue", "project_id").agg(
        F.when(F.first(first_listed), listed).otherwise(F.max("published")).alias("latest_release")
    )


def updated_prefix(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Unknown files above the first one that is already up to date.

    ``listing(project_id, file_id, updated, available, latest_release)`` is read
    newest first. Unavailable rows and rows without a file are passed over; a
    known file whose stored date equals the project's latest release to the
    second ends the scan; other known files are passed over. A project that
    occurs twice counts once, at its newest row.

    The stop row is one aggregated value, compared with every row, so no task
    has to hold the whole ordered list.
    """
    dated = known.select("file_id", "latest_date")
    rows = listing.where(F.col("available") & F.col("file_id").isNotNull()).join(dated, "file_id", "left")
    order = F.struct("updated", "file_id")
    stop = rows.where(same_second(F.col("latest_release"), F.col("latest_date")))
    cut = stop.agg(F.max(order).alias("cut")).scalar()
    above = rows.where(F.col("latest_date").isNull()).where(F.coalesce(order > cut, F.lit(True)))
    return above.groupBy("project_id").agg(F.max(order).alias("o")).select(
        "project_id", "o.file_id", "o.updated"
    )


def newest_page(projects: DataFrame, page_limit: int) -> DataFrame:
    """The first page by release date; the limit comes before the availability test."""
    page = projects.orderBy(F.col("released").desc(), "project_id").limit(page_limit)
    return page.where("available")


def incremental_batch(
    listing: DataFrame, known: DataFrame, projects: DataFrame, indexed: DataFrame, page_limit: int
) -> DataFrame:
    """Files to index, in processing order ``(phase, at)``.

    Phase 0 are updated files, oldest first. Phase 1 are projects of the newest
    page that are neither in phase 0 nor in ``indexed(project_id)``, with their
    latest file, newest first. ``at`` ascends in both.
    """
    taken = updated_prefix(listing, known)
    page = (
        newest_page(projects, page_limit)
        .where(F.col("file_id").isNotNull())
        .groupBy("project_id").agg(F.max_by(F.struct("released", "file_id"), F.struct("released", "file_id")).alias("_last"))
        .select("project_id", "_last.*")
        .join(taken, "project_id", "left_anti")
        .join(indexed.select("project_id").distinct(), "project_id", "left_anti")
    )
    micros = lambda c: F.unix_micros(c)
    return taken.select(
        F.lit(0).alias("phase"), micros(F.col("updated")).alias("at"), "project_id", "file_id"
    ).union(
        page.select(F.lit(1), -micros(F.col("released")), "project_id", "file_id")
    )


def run_summary(outcomes: DataFrame, *by: str) -> DataFrame:
    """Counts of a run from ``outcomes(outcome, is_new, ...)``.

    ``outcome`` is ``skipped`` (no longer expected), ``index_failed``,
    ``store_failed`` (indexed, then not stored) or ``stored``.
    """
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.groupBy(*by).agg(
        F.count_if(F.col("outcome") != "skipped").alias("expected"),
        is_("stored", "store_failed").alias("indexed"),
        is_("stored").alias("stored"),
        F.count_if("is_new").alias("new"),
        is_("index_failed", "store_failed").alias("failed"),
    )


def latest_outcomes(outcomes: DataFrame, outcome: str, limit: int = 25) -> DataFrame:
    """The last entries of one outcome, for a report."""
    return outcomes.where(F.col("outcome") == outcome).orderBy(F.col("at").desc(), "candidate_id").limit(limit)
