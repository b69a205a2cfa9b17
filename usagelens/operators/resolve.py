"""Which indexed artifact a candidate file belongs to, across two catalogues.

Catalogue ``a`` has integer project ids, catalogue ``b`` text ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.versions import version_key
from ..session import condense, materialize
from .closure import descendants
from .nested import expand_nested

A, B = "a", "b"


# ---------------------------------------------------------------- fingerprints

def match_fingerprints(contained: DataFrame, files: DataFrame, first_only: bool = True) -> DataFrame:
    """Catalogue file of each contained archive with the same ``fingerprint``.

    ``contained(id, first_seen, fingerprint)``, ``files(fingerprint, position,
    file_id, project_id)``. With ``first_only`` just the first archive of a
    fingerprint is matched; where several files share one, the last listed is
    taken. Both sides are reduced to one row per fingerprint before they meet.
    """
    listed = files.groupBy("fingerprint").agg(
        F.max_by(F.struct("file_id", "project_id"), F.struct("position", "file_id")).alias("f")
    ).select("fingerprint", "f.*")
    if first_only:
        contained = contained.groupBy("fingerprint").agg(
            F.min_by(F.struct("id", "first_seen"), F.struct("first_seen", "id")).alias("c")
        ).select("fingerprint", "c.*")
    else:
        listed = materialize(listed, "listed")
    return contained.join(listed, "fingerprint")


# ------------------------------------------------------------------- expansion

def assert_unique(rows: DataFrame, column: str) -> None:
    """Fail when a value occurs twice; one repeated value reaches the driver."""
    repeated = rows.groupBy(column).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{column} occurs more than once: {repeated[0][0]}")


def expand_candidates(
    candidates: DataFrame, files: DataFrame, first_only: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Add contained archives as candidates, and collect coordinates.

    ``candidates(position, project_id, file_id, sha1, nested_tree)``,
    ``files(fingerprint, position, file_id, project_id)``; contained archives
    carry their fingerprint as ``sha1``. Returns ``(candidates, coordinates)``:

    * a contained archive that is itself a candidate only gives that candidate's
      file its coordinate;
    * one whose fingerprint belongs to a project of the batch gives that
      project's file its coordinate; a further project becomes a candidate once;
    * the others become candidates without a file.

    For one file, the coordinate met last stays. The steps that several results
    share are written once.
    """
    candidates = materialize(candidates, "candidates")
    assert_unique(candidates, "sha1")
    contained = materialize(expand_nested(candidates).select("id", "version", "sha1", "first_seen"), "contained")
    own = candidates.select("sha1", "file_id", "project_id")

    linked = contained.join(own, "sha1").select("project_id", "file_id", "id", "first_seen", F.lit(0).alias("step"))
    rest = contained.join(own, "sha1", "left_anti")

    matched = materialize(match_fingerprints(
        rest.select("id", "first_seen", F.col("sha1").alias("fingerprint")), files, first_only
    ), "matched")
    batch = candidates.where(F.col("project_id").isNotNull()).groupBy("project_id").agg(
        F.max_by("file_id", "position").alias("batch_file")
    )
    placed = matched.join(batch, "project_id", "left")
    further = (
        placed.where(F.col("batch_file").isNull()).groupBy("project_id")
        .agg(F.min_by(F.struct("file_id", "id", "fingerprint"), F.struct("first_seen", "id")).alias("f"))
        .select("project_id", F.col("f.file_id").alias("new_file"), F.col("f.id").alias("coordinate"),
                F.col("f.fingerprint").alias("sha1"))
    )
    by_print = placed.join(further.select("project_id", "new_file"), "project_id", "left").select(
        "project_id", F.coalesce("batch_file", "new_file").alias("file_id"), "id", "first_seen",
        F.lit(1).alias("step"),
    )
    coordinates = linked.union(by_print).groupBy("project_id", "file_id").agg(
        F.max_by("id", F.struct("step", "first_seen", "id")).alias("coordinate")
    )

    unmatched = rest.join(matched.select("id"), "id", "left_anti")
    no_text = F.lit(None).cast("string")
    expanded = (
        candidates.select(F.lit("listed").alias("source"), "project_id", "file_id", "sha1", no_text.alias("coordinate"))
        .union(further.select(F.lit("matched"), "project_id", "new_file", "sha1", "coordinate"))
        .union(unmatched.select(F.lit("contained"), no_text, no_text, "sha1", "id"))
    )
    return expanded, coordinates


def fill_coordinates(artifacts: DataFrame, coordinates: DataFrame, key: str) -> DataFrame:
    """Set a coordinate only where there is none."""
    new = coordinates.select(key, F.col("coordinate").alias("_new"))
    return (
        artifacts.join(new, key, "left")
        .withColumn("coordinates", F.coalesce("coordinates", "_new"))
        .select(artifacts.columns)
    )


# ------------------------------------------------------------------ resolution

def _by_project(artifacts: DataFrame) -> DataFrame:
    keys = F.array(
        F.struct(F.lit(A).alias("catalogue"), F.col("int_project_id").cast("string").alias("project_id")),
        F.struct(F.lit(B).alias("catalogue"), F.col("text_project_id").alias("project_id")),
    )
    return (
        artifacts.select(F.col("id").alias("artifact_id"), F.inline(keys)).where(F.col("project_id").isNotNull())
    )


def _one_sided(artifacts: DataFrame, names: DataFrame) -> DataFrame:
    """Artifacts known to one catalogue only, by the name and the catalogue that lacks them."""
    lacks_a = F.col("int_project_id").isNull()
    return (
        artifacts.where(lacks_a != F.col("text_project_id").isNull())
        .join(names, "name", "left_semi")
        .select(
            "id", "name",
            F.when(lacks_a, A).otherwise(B).alias("lacking"),
            F.when(lacks_a, B).otherwise(A).alias("catalogue"),
            F.coalesce("text_project_id", F.col("int_project_id").cast("string")).alias("project_id"),
        )
    )


def same_name_matches(
    candidates: DataFrame, artifacts: DataFrame, digests: DataFrame, project_files: DataFrame
) -> DataFrame:
    """The first same-name artifact of the other catalogue that holds the same thing.

    Same means equal cleaned content of the latest file, or one file hash in
    common. The artifact side is reduced to its least id per (catalogue, name,
    content) before the join. So a name shared by a third of all artifacts costs
    one row per distinct content, and never all pairs of that name.
    """
    listed = candidates.where(F.col("catalogue").isNotNull())
    names = materialize(listed.select(F.col("display_name").alias("name")).distinct(), "names")
    other = _one_sided(artifacts, names)

    def matches(own: DataFrame, theirs: DataFrame) -> DataFrame:
        offered = (
            other.join(theirs, ["catalogue", "project_id"])
            .groupBy(F.col("lacking").alias("catalogue"), F.col("name").alias("display_name"), "content")
            .agg(F.min("id").alias("artifact_id"))
        )
        return own.join(materialize(offered, "offered"), ["catalogue", "display_name", "content"]).select("candidate_id", "artifact_id")

    files = project_files.select("catalogue", "project_id", F.col("sha1").alias("content")).distinct()
    own_files = listed.select("candidate_id", "catalogue", "project_id", "display_name").join(
        files, ["catalogue", "project_id"]
    )
    own_latest = listed.withColumnRenamed("digest", "content")
    latest = digests.withColumnRenamed("digest", "content")
    return matches(own_latest, latest).union(matches(own_files, files)).groupBy("candidate_id").agg(
        F.min("artifact_id").alias("artifact_id")
    )


def resolve_entities(
    candidates: DataFrame, artifacts: DataFrame, known_files: DataFrame,
    digests: DataFrame, project_files: DataFrame,
) -> DataFrame:
    """The outcome of every candidate; the first rule that hits decides.

    ``candidates(candidate_id, catalogue, project_id, sha1, display_name,
    coordinate, version, digest)``; ``catalogue`` is null for a file without a
    project. Rules in order: ``known`` hash; indexed ``project``; ``same_name``;
    ``new``; for files without a project ``coordinate``, ``outdated`` when the
    indexed version is not older, ``new``; and ``unidentified``. For a known
    hash, ``merge_id`` is a second artifact of the candidate's project.

    Every rule reads the candidates, so they are written once; their measured
    size then lets Spark broadcast a small batch and leave the index unshuffled.
    Each rule is an inner join, and of several artifacts the least id is taken; for a
    coordinate, which many of both sides may have, before the join.
    """
    candidates = condense(candidates, "candidates")
    listed = candidates.where(F.col("catalogue").isNotNull())
    loose = candidates.where(F.col("catalogue").isNull() & F.col("coordinate").isNotNull())
    # Many artifacts and many candidates may share a coordinate: one row of each asked coordinate is left.
    asked = materialize(loose.select("coordinate").distinct(), "asked")
    at_coordinate = materialize(
        artifacts.select(F.col("coordinates").alias("coordinate"), "id", "version").join(asked, "coordinate", "left_semi")
        .groupBy("coordinate").agg(F.min("id").alias("artifact_id"), F.min_by("version", "id").alias("indexed")), "at-coordinate"
    )

    def hit(rule: str, rows: DataFrame, indexed: Column | None = None) -> DataFrame:
        version = F.lit(None).cast("string") if indexed is None else indexed
        return rows.select("candidate_id", F.lit(rule).alias("rule"), "artifact_id", version.alias("indexed"))

    hits = reduce(DataFrame.union, [
        hit("known", candidates.join(known_files.select("sha1", "artifact_id"), "sha1")),
        hit("project", listed.join(_by_project(artifacts), ["catalogue", "project_id"])),
        hit("same_name", same_name_matches(candidates, artifacts, digests, project_files)),
        hit("coordinate", loose.join(at_coordinate, "coordinate"), F.col("indexed")),
    ])
    of = lambda rule, column: F.min(F.when(F.col("rule") == rule, F.col(column)))
    decided = hits.groupBy("candidate_id").agg(
        *[of(r, "artifact_id").alias(r) for r in ("known", "project", "same_name", "coordinate")],
        F.min_by("indexed", F.when(F.col("rule") == "coordinate", F.col("artifact_id"))).alias("indexed"),
    )
    outdated = version_key(F.col("indexed")) >= version_key(F.col("version"))
    has_project = F.col("catalogue").isNotNull()
    outcome = (
        F.when(F.col("known").isNotNull(), "known")
        .when(F.col("project").isNotNull(), "project")
        .when(F.col("same_name").isNotNull(), "same_name")
        .when(has_project, "new")
        .when(F.col("coordinates_missing"), "unidentified")
        .when(F.col("at_coordinate").isNull(), "new")
        .when(outdated, "outdated")
        .otherwise("coordinate")
    )
    joined = (
        candidates.join(decided.withColumnRenamed("coordinate", "at_coordinate"), "candidate_id", "left")
        .withColumn("coordinates_missing", F.col("coordinate").isNull())
        .withColumn("outcome", outcome)
    )
    return joined.select(
        "candidate_id", "outcome",
        F.coalesce("known", "project", "same_name", "at_coordinate").alias("artifact_id"),
        F.when((F.col("outcome") == "known") & (F.col("project") != F.col("known")), F.col("project")).alias("merge_id"),
    )


# --------------------------------------------------------------------- merging

def choose_survivor(pairs: DataFrame) -> DataFrame:
    """``(a_id, a_version, b_id, b_version)`` -> who stays: the newer, on a tie ``a``."""
    keep_a = version_key(F.col("a_version")) >= version_key(F.col("b_version"))
    return pairs.select(
        F.when(keep_a, F.col("b_id")).otherwise(F.col("a_id")).alias("old_id"),
        F.when(keep_a, F.col("a_id")).otherwise(F.col("b_id")).alias("new_id"),
    )


def settle_merges(merges: DataFrame) -> DataFrame:
    """Merges that follow one another, turned into one step each.

    Every ``old_id`` goes to the least artifact at the end of its chain. Artifacts
    that only merge into each other keep the least of them.
    """
    merges = materialize(merges.select("old_id", "new_id").where("old_id <> new_id").distinct(), "merges")
    edges = merges.select(F.col("old_id").alias("parent"), F.col("new_id").alias("child"))
    reached = descendants(edges, merges.select(F.col("old_id").alias("root")))
    ends = reached.join(merges.select(F.col("old_id").alias("node")).distinct().withColumn("moves", F.lit(True)), "node", "left")
    settled = ends.groupBy(F.col("root").alias("old_id")).agg(
        F.coalesce(F.min(F.when(F.col("moves").isNull(), F.col("node"))), F.min("node")).alias("new_id")
    )
    return settled.where("old_id <> new_id")


def merge_entities(
    artifacts: DataFrame, known_files: DataFrame, merges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Fold ``old_id`` into ``new_id``; returns artifacts and known files.

    The old artifact's known files move over, it disappears, and the survivor
    takes the project id it lacks. Chains of merges go through ``settle_merges``. Its fact rows go with ``cascade_delete``.
    """
    gone = merges.select(F.col("old_id").alias("id"), "new_id")
    moved = (
        known_files.join(gone.withColumnRenamed("id", "artifact_id"), "artifact_id", "left")
        .withColumn("artifact_id", F.coalesce("new_id", "artifact_id")).select(known_files.columns)
    )
    given = artifacts.join(gone, "id").groupBy(F.col("new_id").alias("id")).agg(
        F.max("int_project_id").alias("_int"), F.max("text_project_id").alias("_text")
    )
    kept = (
        artifacts.join(gone, "id", "left_anti").join(given, "id", "left")
        .withColumns({
            "int_project_id": F.coalesce("int_project_id", "_int"),
            "text_project_id": F.coalesce("text_project_id", "_text"),
        }).select(artifacts.columns)
    )
    return kept, moved


# ------------------------------------------------------------- shared contents

def shared_hashes(files: DataFrame) -> DataFrame:
    """File hashes that one name has in both catalogues, counted per name.

    A set intersection by grouping: one row per (name, hash) and two flags, with
    no join of the two sides.
    """
    return (
        files.groupBy("name", "sha1")
        .agg(F.max(F.col("catalogue") == A).alias("in_a"), F.max(F.col("catalogue") == B).alias("in_b"))
        .where("in_a and in_b")
        .groupBy("name").agg(F.count(F.lit(1)).alias("common"))
    )


def without_timestamps(manifest: Column) -> Column:
    """Manifest text without the main attributes whose name ends in ``timestamp``.

    Continuation lines (one leading space) go with their attribute. Sections
    after the first blank line are kept as they are.
    """
    blank = F.regexp_instr(manifest, F.lit(r"\r?\n\r?\n"))
    main = F.when(blank > 0, F.substr(manifest, F.lit(1), blank)).otherwise(manifest)
    tail = F.when(blank > 0, F.substr(manifest, blank + 1)).otherwise(F.lit(""))
    dropped = F.regexp_replace(main, r"(?im)^[^:\r\n]*timestamp:[^\n]*(\n [^\n]*)*(\n|\z)", "")
    return F.concat(dropped, tail)


def clean_content(path: Column, content: Column) -> Column:
    """Hash of an entry's content; a manifest is hashed without its timestamps."""
    text = without_timestamps(content.cast("string"))
    return F.when(path == "META-INF/MANIFEST.MF", F.sha1(text.cast("binary"))).otherwise(F.sha1(content))


def same_content(digests: DataFrame, key: str) -> DataFrame:
    """For every archive, the least archive with equal digest and how many there are.

    ``digests`` has one row per archive: ``key`` and the digest columns.
    """
    digest = [c for c in digests.columns if c != key]
    groups = digests.groupBy(*digest).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"))
    copied = materialize(groups.where("copies > 1"), "copies")
    return digests.join(copied, digest).select(key, "first", "copies")
