"""Entity resolution across two catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fingerprint import entry_set_digest
from ..operators import resolve
from ..session import materialize
from .registry import Tables, query
from .roles import ARTIFACTS, FILES, artifacts, col, files, lit, text

# ---------------------------------------------------------------- shared files


@query("fingerprint_match", f"""
WITH {FILES},
first AS (SELECT sha1 AS fingerprint, min(file_id) AS id FROM files WHERE catalogue = 'a' GROUP BY 1),
listed AS (SELECT sha1 AS fingerprint, max(file_id) AS file_id, arg_max(project_id, file_id) AS project_id FROM files WHERE catalogue = 'b' GROUP BY 1)
SELECT fingerprint, id, file_id, project_id FROM first JOIN listed USING (fingerprint)""")
def fingerprint_match(t: Tables) -> DataFrame:
    """Contained archives of one catalogue against the files of the other; first input only."""
    contained, listed = _two_sides(t)
    return resolve.match_fingerprints(contained, listed).select("fingerprint", "id", "file_id", "project_id")


@query("hash_match", f"""
WITH {FILES},
listed AS (SELECT sha1 AS fingerprint, max(file_id) AS file_id, arg_max(project_id, file_id) AS project_id FROM files WHERE catalogue = 'b' GROUP BY 1)
SELECT fingerprint, f.file_id AS id, l.file_id, l.project_id FROM files f JOIN listed l ON l.fingerprint = f.sha1 WHERE f.catalogue = 'a'""")
def hash_match(t: Tables) -> DataFrame:
    """The other catalogue's rule: every input with a listed hash is matched."""
    contained, listed = _two_sides(t)
    return resolve.match_fingerprints(contained, listed, first_only=False).select(
        "fingerprint", "id", "file_id", "project_id"
    )


def _two_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    whole = files(t)
    contained = whole.where("catalogue = 'a'").select(
        col("file_id").alias("id"), F.array("position").alias("first_seen"), col("sha1").alias("fingerprint")
    )
    listed = whole.where("catalogue = 'b'").select(col("sha1").alias("fingerprint"), "position", "file_id", "project_id")
    return contained, listed


@query("hash_overlap", f"""
WITH {FILES}
SELECT lang AS name, count(*) AS common FROM (
  SELECT lang, sha1 FROM files WHERE catalogue = 'a' INTERSECT SELECT lang, sha1 FROM files WHERE catalogue = 'b'
) GROUP BY ALL""")
def hash_overlap(t: Tables) -> DataFrame:
    return resolve.shared_hashes(files(t).select(col("lang").alias("name"), "catalogue", "sha1"))


@query("normalized_duplicates", """
WITH g AS (SELECT text, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1)
SELECT doc_id, first, copies FROM documents JOIN g USING (text)""")
def normalized_duplicates(t: Tables) -> DataFrame:
    """Documents as archives: one entry per line, and a manifest whose build
    timestamp differs from document to document."""
    manifest = F.concat(
        lit("Manifest-Version: 1.0\r\nBuild-TimeStamp: "), text("doc_id"), lit("\r\n more\r\nBuilt-By: x\r\n\r\nName: a\r\nX-Timestamp: 1\r\n")
    )
    lines = F.transform(
        F.split("text", "\n", -1), lambda line, i: F.struct(F.concat(lit("line"), i.cast("string")).alias("path"), line.alias("content"))
    )
    first = F.array(F.struct(lit("META-INF/MANIFEST.MF").alias("path"), manifest.alias("content")))
    entries = t.documents.select("doc_id", F.posexplode(F.concat(first, lines)).alias("position", "e"))
    digests = entries.groupBy("doc_id").agg(
        *entry_set_digest(col("position"), col("e.path"), resolve.clean_content(col("e.path"), col("e.content").cast("binary")))
    )
    return resolve.same_content(digests, "doc_id")


# -------------------------------------------------------------------- expansion

EXPANSION = """
listing AS (
  SELECT doc_id AS position, source AS project_id, doc_id AS file_id, sha1(text) AS sha1, lang, n_chars
  FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)
),
nodes AS (
  SELECT position, 0 AS place, 'g:' || project_id || '-' || lang AS id, n_chars % 50 AS v,
         CASE WHEN n_chars % 3 = 0 THEN sha1 WHEN n_chars % 3 = 1 THEN sha1(project_id || lang) ELSE sha1(sha1) END AS sha1 FROM listing
  UNION ALL
  SELECT position, 1, 'h:' || (n_chars % 40), n_chars % 9, sha1('h' || (n_chars % 40) || lang) FROM listing
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, position, place) AS rn,
         min(position * 10 + place) OVER (PARTITION BY id) AS first_seen FROM nodes
),
contained AS (SELECT id, sha1, first_seen FROM ranked WHERE rn = 1),
offered AS (
  SELECT fingerprint, max(file_id) AS file_id, arg_max(project_id, file_id) AS project_id FROM (
    SELECT sha1(source || lang) AS fingerprint, 1000000 + doc_id AS file_id, CASE WHEN lang = 'de' THEN source ELSE 'q' || lang END AS project_id FROM documents
    UNION ALL SELECT sha1('h' || (n_chars % 40) || lang), 2000000 + doc_id, 'h' || lang FROM documents WHERE lang <> 'en'
  ) GROUP BY fingerprint
),
linked AS (SELECT l.project_id, l.file_id, c.id, 0 AS step, c.first_seen FROM contained c JOIN listing l USING (sha1)),
rest AS (SELECT * FROM contained WHERE sha1 NOT IN (SELECT sha1 FROM listing)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY sha1 ORDER BY first_seen, id) AS nth FROM rest),
matched AS (SELECT f.id, f.first_seen, f.sha1, o.file_id, o.project_id FROM firsts f JOIN offered o ON o.fingerprint = f.sha1 WHERE nth = 1),
batch AS (SELECT project_id, arg_max(file_id, position) AS batch_file FROM listing GROUP BY project_id),
placed AS (SELECT m.*, batch_file, row_number() OVER (PARTITION BY m.project_id ORDER BY first_seen, id) AS nth
           FROM matched m LEFT JOIN batch USING (project_id)),
further AS (SELECT project_id, file_id AS new_file, id, sha1 FROM placed WHERE batch_file IS NULL AND nth = 1),
given AS (
  SELECT * FROM linked
  UNION ALL
  SELECT p.project_id, coalesce(batch_file, new_file), p.id, 1, first_seen FROM placed p LEFT JOIN further USING (project_id)
)"""


def _expansion(t: Tables) -> tuple[DataFrame, DataFrame]:
    docs = t.documents.groupBy(F.sha1("text").alias("sha1")).agg(
        F.min_by(F.struct("doc_id", "source", "lang", "n_chars"), "doc_id").alias("d")
    ).select("d.*", "sha1")
    mod = lambda n: (col("n_chars") % n).cast("string")
    inner = (
        F.when(col("n_chars") % 3 == 0, col("sha1")).when(col("n_chars") % 3 == 1, F.sha1(F.concat("source", "lang")))
        .otherwise(F.sha1("sha1"))
    )
    tree = F.concat(
        lit('[{"id":"g:'), "source", lit("-"), "lang", lit('","version":"'), mod(50), lit('","sha1":"'), inner,
        lit('","nested":[{"id":"h:'), mod(40), lit('","version":"'), mod(9), lit('","sha1":"'),
        F.sha1(F.concat(lit("h"), mod(40), "lang")), lit('"}]}]'),
    )
    candidates = docs.select(
        col("doc_id").alias("position"), col("source").alias("project_id"), col("doc_id").cast("string").alias("file_id"),
        "sha1", tree.alias("nested_tree"),
    )
    offer = lambda rows, key, base, project: rows.select(
        F.sha1(key).alias("fingerprint"), (lit(base) + col("doc_id")).alias("position"),
        (lit(base) + col("doc_id")).cast("string").alias("file_id"), project.alias("project_id"),
    )
    offered = offer(
        t.documents, F.concat("source", "lang"), 1000000,
        F.when(col("lang") == "de", col("source")).otherwise(F.concat(lit("q"), "lang")),
    ).union(offer(
        t.documents.where("lang <> 'en'"), F.concat(lit("h"), mod(40), "lang"), 2000000, F.concat(lit("h"), "lang")
    ))
    return resolve.expand_candidates(candidates, offered)


@query("expand_candidates", f"""
WITH {EXPANSION}
SELECT 'listed' AS source, project_id, file_id::VARCHAR AS file_id, sha1, NULL AS coordinate FROM listing
UNION ALL SELECT 'matched', project_id, new_file::VARCHAR, sha1, id FROM further
UNION ALL SELECT 'contained', NULL, NULL, sha1, id FROM rest WHERE id NOT IN (SELECT id FROM matched)""")
def expand_candidates(t: Tables) -> DataFrame:
    return _expansion(t)[0]


@query("additional_coordinates", f"""
WITH {EXPANSION}
SELECT project_id, file_id::VARCHAR AS file_id, arg_max(id, (step, first_seen, id)) AS coordinate FROM given GROUP BY ALL""")
def additional_coordinates(t: Tables) -> DataFrame:
    return _expansion(t)[1]


@query("fill_coordinates", f"""
WITH {ARTIFACTS}
SELECT id, coalesce(coordinates, CASE WHEN s_acctbal > 0 THEN 's:' || s_name END) AS coordinates
FROM artifacts LEFT JOIN supplier ON s_suppkey = id""")
def fill_coordinates(t: Tables) -> DataFrame:
    given = t.supplier.where("s_acctbal > 0").select(
        col("s_suppkey").alias("id"), F.concat(lit("s:"), "s_name").alias("coordinate")
    )
    return resolve.fill_coordinates(artifacts(t).select("id", "coordinates"), given, "id")


# ------------------------------------------------------------------- resolution

# Candidates and the index describe the same parts with shifted keys, so that
# every rule is met by some of them.
RESOLUTION = f"""
{ARTIFACTS},
candidates AS (
  SELECT p_partkey AS candidate_id,
         CASE p_type WHEN 'PROMO' THEN 'a' WHEN 'SMALL' THEN 'b' WHEN 'ECONOMY' THEN 'a' WHEN 'LARGE' THEN 'b' END AS catalogue,
         CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN (p_partkey + 7)::VARCHAR WHEN p_type IN ('SMALL', 'LARGE') THEN 'p' || (p_partkey + 3) END AS project_id,
         sha1('f' || (p_partkey % 1499)) AS sha1, p_name AS display_name,
         CASE WHEN p_size > 10 THEN 'org.economy:' || replace(p_name, ' ', '-') || CASE WHEN p_size > 45 THEN 'x' ELSE '' END END AS coordinate,
         (p_size - 5) || '.1' AS version, p_size - 5 AS v1, sha1('d' || p_name || p_brand) AS digest
  FROM part
),
known_files AS (SELECT p_partkey AS artifact_id, sha1('f' || (p_partkey + 600)) AS sha1 FROM part WHERE p_size BETWEEN 20 AND 30),
projects AS (
  SELECT id, 'a' AS catalogue, int_project_id::VARCHAR AS project_id FROM artifacts WHERE int_project_id IS NOT NULL
  UNION ALL SELECT id, 'b', text_project_id FROM artifacts WHERE text_project_id IS NOT NULL
),
by_project AS (SELECT catalogue, project_id, min(id) AS artifact_id FROM projects GROUP BY ALL),
digests AS (
  SELECT catalogue, project_id, sha1('d' || p_name || CASE WHEN p_size > 20 THEN p_brand ELSE 'z' END) AS digest
  FROM projects JOIN part ON p_partkey = id
),
project_files AS (
  SELECT catalogue, project_id, sha1('h' || (id % 211)) AS sha1 FROM projects
  UNION ALL
  SELECT catalogue, project_id, sha1('h' || (candidate_id % 211)) FROM candidates WHERE catalogue IS NOT NULL
),
one_sided AS (
  SELECT id, name, CASE WHEN int_project_id IS NULL THEN 'a' ELSE 'b' END AS lacking,
         CASE WHEN int_project_id IS NULL THEN 'b' ELSE 'a' END AS catalogue,
         coalesce(text_project_id, int_project_id::VARCHAR) AS project_id
  FROM artifacts WHERE (int_project_id IS NULL) != (text_project_id IS NULL)
),
same_name AS (
  SELECT candidate_id, min(id) AS artifact_id FROM (
    SELECT c.candidate_id, o.id FROM candidates c JOIN one_sided o ON o.lacking = c.catalogue AND o.name = c.display_name
    JOIN digests d ON d.catalogue = o.catalogue AND d.project_id = o.project_id AND d.digest = c.digest
    UNION
    SELECT c.candidate_id, o.id FROM candidates c JOIN one_sided o ON o.lacking = c.catalogue AND o.name = c.display_name
    JOIN project_files theirs ON theirs.catalogue = o.catalogue AND theirs.project_id = o.project_id
    JOIN project_files own ON own.catalogue = c.catalogue AND own.project_id = c.project_id AND own.sha1 = theirs.sha1
  ) GROUP BY candidate_id
),
at_coordinate AS (SELECT coordinates AS coordinate, min(id) AS artifact_id FROM artifacts WHERE coordinates IS NOT NULL GROUP BY 1),
hits AS (
  SELECT c.*, k.artifact_id AS known, p.artifact_id AS project, s.artifact_id AS same, m.artifact_id AS at_id, a.p_size AS w1, a.p_partkey % 10 AS w2
  FROM candidates c LEFT JOIN known_files k USING (sha1)
  LEFT JOIN by_project p USING (catalogue, project_id)
  LEFT JOIN same_name s USING (candidate_id)
  LEFT JOIN at_coordinate m ON m.coordinate = c.coordinate AND c.catalogue IS NULL
  LEFT JOIN part a ON a.p_partkey = m.artifact_id
),
decided AS (
  SELECT candidate_id,
    CASE WHEN known IS NOT NULL THEN 'known' WHEN project IS NOT NULL THEN 'project' WHEN same IS NOT NULL THEN 'same_name'
         WHEN catalogue IS NOT NULL THEN 'new' WHEN coordinate IS NULL THEN 'unidentified' WHEN at_id IS NULL THEN 'new'
         WHEN (w1, w2) >= (v1, 1) THEN 'outdated' ELSE 'coordinate' END AS outcome,
    coalesce(known, project, same, at_id) AS artifact_id,
    CASE WHEN known IS NOT NULL AND project != known THEN project END AS merge_id
  FROM hits
)"""


@query("resolve_entities", f"WITH {RESOLUTION} SELECT * FROM decided")
def resolve_entities(t: Tables) -> DataFrame:
    kind, size, key = col("p_type"), col("p_size"), col("p_partkey")
    in_a, in_b = kind.isin("PROMO", "ECONOMY"), kind.isin("SMALL", "LARGE")
    candidates = t.part.select(
        key.alias("candidate_id"), F.when(in_a, "a").when(in_b, "b").alias("catalogue"),
        F.when(in_a, (key + 7).cast("string")).when(in_b, F.concat(lit("p"), (key + 3).cast("string"))).alias("project_id"),
        F.sha1(F.concat(lit("f"), (key % 1499).cast("string"))).alias("sha1"), col("p_name").alias("display_name"),
        F.when(size > 10, F.concat(
            lit("org.economy:"), F.replace(col("p_name"), lit(" "), lit("-")), F.when(size > 45, "x").otherwise("")
        )).alias("coordinate"),
        F.concat((size - 5).cast("string"), lit(".1")).alias("version"),
        F.sha1(F.concat(lit("d"), "p_name", "p_brand")).alias("digest"),
    )
    index = artifacts(t)
    known = t.part.where("p_size between 20 and 30").select(
        key.alias("artifact_id"), F.sha1(F.concat(lit("f"), (key + 600).cast("string"))).alias("sha1")
    )
    ids = F.array(
        F.struct(lit("a").alias("catalogue"), F.when(size > 15, key.cast("string")).alias("project_id")),
        F.struct(lit("b").alias("catalogue"), F.when(size.between(2, 30), F.concat(lit("p"), key.cast("string"))).alias("project_id")),
    )
    projects = t.part.select("p_partkey", "p_name", "p_brand", "p_size", F.inline(ids)).where("project_id is not null")
    content = F.concat(lit("d"), "p_name", F.when(size > 20, col("p_brand")).otherwise("z"))
    digests = projects.select("catalogue", "project_id", F.sha1(content).alias("digest"))
    shared = lambda df, c: df.select("catalogue", "project_id", F.sha1(F.concat(lit("h"), (col(c) % 211).cast("string"))).alias("sha1"))
    project_files = shared(projects, "p_partkey").union(shared(candidates.where("catalogue is not null"), "candidate_id"))
    return resolve.resolve_entities(candidates, index, known, digests, project_files)


PAIRS = f"""
{ARTIFACTS},
merges AS (
  SELECT CASE WHEN (a.p_size, a.p_partkey % 10) >= (b.p_size, b.p_partkey % 10) THEN b.p_partkey ELSE a.p_partkey END AS old_id,
         CASE WHEN (a.p_size, a.p_partkey % 10) >= (b.p_size, b.p_partkey % 10) THEN a.p_partkey ELSE b.p_partkey END AS new_id
  FROM supplier JOIN part a ON a.p_partkey = 2 * s_suppkey JOIN part b ON b.p_partkey = 2 * s_suppkey + 1
)"""


def _merges(t: Tables) -> DataFrame:
    pairs = t.supplier.select((col("s_suppkey") * 2).alias("a_id"), (col("s_suppkey") * 2 + 1).alias("b_id"))
    side = lambda s: artifacts(t).select(col("id").alias(f"{s}_id"), col("version").alias(f"{s}_version"))
    return resolve.choose_survivor(pairs.join(side("a"), "a_id").join(side("b"), "b_id"))


@query("merge_entities", f"""
WITH {PAIRS}
SELECT a.id, coalesce(a.int_project_id, o.int_project_id) AS int_project_id, coalesce(a.text_project_id, o.text_project_id) AS text_project_id
FROM artifacts a LEFT JOIN merges m ON m.new_id = a.id LEFT JOIN artifacts o ON o.id = m.old_id
WHERE a.id NOT IN (SELECT old_id FROM merges)""")
def merge_entities(t: Tables) -> DataFrame:
    known = t.lineitem.select(col("l_partkey").alias("artifact_id"), text("l_orderkey").alias("sha1"))
    kept, _ = resolve.merge_entities(artifacts(t), known, _merges(t))
    return kept.select("id", "int_project_id", "text_project_id")


@query("merged_known_files", f"""
WITH {PAIRS}
SELECT coalesce(new_id, l_partkey) AS artifact_id, count(*) AS files
FROM lineitem LEFT JOIN merges ON old_id = l_partkey GROUP BY ALL""")
def merged_known_files(t: Tables) -> DataFrame:
    known = t.lineitem.select(col("l_partkey").alias("artifact_id"), text("l_orderkey").alias("sha1"))
    _, moved = resolve.merge_entities(artifacts(t), known, _merges(t))
    return moved.groupBy("artifact_id").agg(F.count(lit(1)).alias("files"))


# Parts merge into the one of half their number, unless that number is a multiple of three:
# chains of many lengths. Under negative ids, neighbours merge into each other.
CHAINS = """
merges AS (
  SELECT p_partkey AS old_id, p_partkey // 2 AS new_id FROM part WHERE p_partkey % 3 <> 0
  UNION ALL SELECT -p_partkey, -xor(p_partkey, 1) FROM part),
reached AS (
  SELECT old_id AS root, new_id AS node FROM merges
  UNION SELECT r.root, m.new_id FROM reached r JOIN merges m ON m.old_id = r.node),
ends AS (
  SELECT root, coalesce(min(node) FILTER (WHERE NOT moves), min(node)) AS node
  FROM (SELECT root, node, EXISTS (SELECT 1 FROM merges WHERE old_id = node) AS moves FROM reached) GROUP BY root),
settled AS (SELECT root AS old_id, node AS new_id FROM ends WHERE root <> node)"""


@query("chained_merges", f"""
WITH RECURSIVE {CHAINS},
known AS (SELECT l_partkey AS artifact_id FROM lineitem UNION ALL SELECT -l_partkey FROM lineitem)
SELECT 'merge' AS kind, old_id, new_id, NULL::BIGINT AS files FROM settled
UNION ALL
SELECT 'files', NULL, coalesce(new_id, artifact_id), count(*) FROM known LEFT JOIN settled ON old_id = artifact_id GROUP BY ALL""")
def chained_merges(t: Tables) -> DataFrame:
    """Merges that follow one another or go in a circle, each settled in one step, and known files after them."""
    part = col("p_partkey")
    halves = t.part.where(part % 3 != 0).select(part.alias("old_id"), F.floor(part / 2).alias("new_id"))
    mutual = t.part.select((-part).alias("old_id"), (-part.bitwiseXOR(lit(1))).alias("new_id"))
    settled = materialize(resolve.settle_merges(halves.union(mutual)), "settled")
    line = text("l_orderkey").alias("sha1")
    known = t.lineitem.select(col("l_partkey").alias("artifact_id"), line).union(t.lineitem.select(-col("l_partkey"), line))
    _, moved = resolve.merge_entities(artifacts(t), known, settled)
    files = moved.groupBy("artifact_id").agg(F.count(lit(1)).alias("files"))
    none = lit(None).cast("bigint")
    return settled.select(lit("merge").alias("kind"), "old_id", "new_id", none.alias("files")).union(
        files.select(lit("files"), none, "artifact_id", "files")
    )
