"""Listing, filters, lookups and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import listing, lookups, nested
from ..operators.filters import Filter
from ..sources.catalogue import pack_members
from .registry import Tables, query
from .roles import ARTIFACTS, CLASS_DEFS, TREE_NODES, artifacts, class_defs, col, lit, text

DISPLAY_SQL = """
  SELECT CASE WHEN name = '' THEN 'Unknown' ELSE name END AS artifact_name, version,
         array_to_string(ids, ', ') AS identifiers, license, authors,
         json_extract_string(metadata_json, '$.modLoader') AS language_loader,
         coordinates, int_project_id, text_project_id,
         coalesce(int_project_id::VARCHAR, text_project_id) AS pid
"""


@query("artifact_listing", f"WITH {ARTIFACTS} {DISPLAY_SQL} FROM artifacts WHERE NOT loader")
def artifact_listing(t: Tables) -> DataFrame:
    return listing.list_artifacts(artifacts(t))


ADHOC = [
    Filter(listing.IDENTIFIER, "=~", "^[hs]"), Filter(listing.IDENTIFIER, "=", "red"),
    Filter(listing.LICENSE, "!=", "PROMO"),
    Filter(listing.AUTHORS, ">", "Brand#12"), Filter(listing.AUTHORS, "<", "Brand#11"),
    Filter(listing.COORDINATES, "!~", "ring$"), Filter(listing.COORDINATES, "=", "org.economy:small-ring"),
]
ADHOC_SQL = """
  NOT loader
  AND (regexp_matches(ids[1], '^[hs]') OR ids[1] = 'red')
  AND (license != 'PROMO')
  AND (authors > 'Brand#12' OR authors < 'Brand#11')
  AND (NOT regexp_matches(coordinates, 'ring$') OR coordinates = 'org.economy:small-ring')"""


@query("adhoc_filter", f"WITH {ARTIFACTS} {DISPLAY_SQL} FROM artifacts WHERE {ADHOC_SQL}")
def adhoc_filter(t: Tables) -> DataFrame:
    return listing.list_artifacts(artifacts(t), ADHOC)


@query("listing_count", f"WITH {ARTIFACTS} SELECT count(*) AS rows FROM artifacts WHERE {ADHOC_SQL}")
def listing_count(t: Tables) -> DataFrame:
    return listing.count_listing(artifacts(t), ADHOC)


@query("listing_by_class", f"""
WITH {ARTIFACTS}, {CLASS_DEFS},
kept AS (
  SELECT DISTINCT name, version, ids, license, authors, metadata_json, coordinates, int_project_id, text_project_id
  FROM artifacts
  WHERE NOT loader AND id IN (SELECT artifact_id FROM class_defs WHERE regexp_matches(class_name, '/1') OR class_name = 'sup/7')
)
{DISPLAY_SQL} FROM kept""")
def listing_by_class(t: Tables) -> DataFrame:
    wanted = [Filter(listing.CLASS_NAME, "=~", "/1"), Filter(listing.CLASS_NAME, "=", "sup/7")]
    return listing.list_artifacts(artifacts(t), wanted, class_defs=class_defs(t))


@query("in_pack", f"""
WITH {ARTIFACTS}
{DISPLAY_SQL} FROM artifacts
WHERE NOT loader AND int_project_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def in_pack(t: Tables) -> DataFrame:
    packs = t.lineitem.select(
        col("l_returnflag").alias("pack_id"), col("l_partkey").cast("int").alias("int_project_id")
    )
    first_counts = [Filter(listing.IN_PACK, "=", "R"), Filter(listing.IN_PACK, "=", "A")]
    return listing.list_artifacts(artifacts(t), first_counts, packs=packs)


@query("nested_id_filter", f"""
WITH {TREE_NODES}
SELECT DISTINCT artifact AS id FROM nodes
WHERE regexp_matches(id, '#1$') OR id = 'g:ring' OR id > 'g:small' OR id < 'g:Brand#11' OR NOT regexp_matches(id, '[a-z]')""")
def nested_id_filter(t: Tables) -> DataFrame:
    ask = lambda op, value: Filter(listing.CONTAINED, op, value)
    asked = [ask("=~", "#1$"), ask("=", "g:ring"), ask(">", "g:small"), ask("<", "g:Brand#11"), ask("!~", "[a-z]")]
    return nested.containing(artifacts(t), asked).select("id")


@query("nested_id_differs", f"""
WITH {TREE_NODES} SELECT DISTINCT artifact AS id FROM nodes WHERE id != 'g:ring'""")
def nested_id_differs(t: Tables) -> DataFrame:
    """``!=`` asks for one contained id that differs, not for none that is equal."""
    return nested.containing(artifacts(t), [Filter(listing.CONTAINED, "!=", "g:ring")]).select("id")


@query("facets", f"""
WITH {ARTIFACTS}, {TREE_NODES}
SELECT DISTINCT 'Identifier' AS facet, unnest(ids) AS value FROM artifacts
UNION SELECT DISTINCT 'Any contained artifact', id FROM nodes
UNION SELECT 'Authors', authors FROM artifacts WHERE authors IS NOT NULL
UNION SELECT 'License', license FROM artifacts WHERE license IS NOT NULL
UNION SELECT 'Coordinates', coordinates FROM artifacts WHERE coordinates IS NOT NULL""")
def facets(t: Tables) -> DataFrame:
    return listing.facets(artifacts(t))


@query("scope_list", """
SELECT DISTINCT (CASE WHEN l_linenumber <= 5 THEN '1.' ELSE 'x.' END) || l_linenumber AS game_version,
       l_returnflag AS loader
FROM lineitem WHERE l_linenumber <= 5""")
def scope_list(t: Tables) -> DataFrame:
    version = F.concat(F.when(col("l_linenumber") <= 5, "1.").otherwise("x."), text("l_linenumber"))
    return listing.scopes(t.lineitem.select(version.alias("game_version"), col("l_returnflag").alias("loader")))


@query("artifact_classes", f"""
WITH {ARTIFACTS}, {CLASS_DEFS},
requests AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'p' || c_custkey ELSE c_custkey::VARCHAR END AS pid FROM customer)
SELECT pid, class_name
FROM requests JOIN artifacts ON CASE WHEN regexp_full_match(pid, '[0-9]+') THEN int_project_id = try_cast(pid AS INTEGER)
                                     ELSE text_project_id = pid END
JOIN class_defs ON class_defs.artifact_id = artifacts.id""")
def artifact_classes(t: Tables) -> DataFrame:
    pid = F.when(col("c_mktsegment") == "BUILDING", F.concat(lit("p"), text("c_custkey"))).otherwise(text("c_custkey"))
    return listing.classes_of(t.customer.select(pid.alias("pid")), artifacts(t), class_defs(t))


@query("lookup_by_key", f"""
WITH {ARTIFACTS},
requests AS (
  SELECT 'int_id' AS kind, c_custkey::VARCHAR AS key FROM customer
  UNION SELECT 'text_id', 'p' || s_suppkey FROM supplier
  UNION SELECT 'coordinate', 'org.economy:' || replace(p_name, ' ', '-') FROM part
  UNION SELECT 'loader_coordinate', 'org.economy:' || replace(p_name, ' ', '-') FROM part
  UNION SELECT 'name', p_name FROM part WHERE p_brand = 'Brand#13'
)
SELECT r.kind, r.key, a.id FROM requests r JOIN artifacts a ON
  CASE r.kind WHEN 'int_id' THEN a.int_project_id::VARCHAR = r.key
              WHEN 'text_id' THEN a.text_project_id = r.key
              WHEN 'coordinate' THEN a.coordinates = r.key
              WHEN 'loader_coordinate' THEN a.loader AND a.coordinates = r.key
              ELSE a.name = r.key END""")
def lookup_by_key(t: Tables) -> DataFrame:
    ask = lambda kind, df, key: df.select(lit(kind).alias("kind"), key.alias("key"))
    coordinate = F.concat(lit("org.economy:"), F.replace(col("p_name"), lit(" "), lit("-")))
    requests = (
        ask(lookups.INT_ID, t.customer, text("c_custkey"))
        .union(ask(lookups.TEXT_ID, t.supplier, F.concat(lit("p"), text("s_suppkey"))))
        .union(ask(lookups.COORDINATE, t.part, coordinate))
        .union(ask(lookups.LOADER_COORDINATE, t.part, coordinate))
        .union(ask(lookups.NAME, t.part.where(col("p_brand") == "Brand#13"), col("p_name")))
    )
    return lookups.lookup(requests, artifacts(t))


@query("duplicate_names", f"""
WITH names AS (SELECT p_partkey AS id, p_name || '/' || p_brand || '/' || p_size AS name FROM part),
many AS (SELECT name, count(id) AS copies FROM names GROUP BY name HAVING count(id) >= 2)
SELECT names.id, name, copies FROM names JOIN many USING (name)""")
def duplicate_names(t: Tables) -> DataFrame:
    named = t.part.select(
        col("p_partkey").alias("id"), F.concat_ws("/", "p_name", "p_brand", text("p_size")).alias("name")
    )
    return lookups.duplicate_names(named)


@query("members_of_set", f"""
WITH {ARTIFACTS}
SELECT id, 'int' AS kind FROM artifacts WHERE int_project_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL
SELECT id, 'text' FROM artifacts WHERE text_project_id IN (SELECT 'p' || c_custkey FROM customer WHERE c_acctbal > 0)""")
def members_of_set(t: Tables) -> DataFrame:
    wanted = t.customer.where("c_acctbal > 0")
    ints = wanted.select(col("c_custkey").cast("int").alias("int_project_id"))
    texts = wanted.select(F.concat(lit("p"), text("c_custkey")).alias("text_project_id"))
    found = lambda df, column, kind: lookups.members_of(artifacts(t), df, column).select("id", lit(kind).alias("kind"))
    return found(ints, "int_project_id", "int").union(found(texts, "text_project_id", "text"))


@query("new_projects", """
SELECT c_custkey AS project_id FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def new_projects(t: Tables) -> DataFrame:
    projects = t.customer.select(col("c_custkey").alias("project_id"))
    indexed = t.orders.where(col("o_orderpriority") == "1-URGENT").select(col("o_custkey").alias("project_id"))
    return lookups.not_indexed(projects, indexed, "project_id")


@query("changed_versions", f"""
WITH {ARTIFACTS},
latest AS (SELECT DISTINCT 'org.' || lower(p_type) || ':' || replace(p_name, ' ', '-') AS coordinates,
                  p_size || '.0' AS latest_version FROM part),
loaders AS (SELECT 'org.' || lower(license) || ':' || replace(name, ' ', '-') AS coordinates, max(version) AS version
            FROM artifacts WHERE loader GROUP BY 1)
SELECT coordinates, latest_version, version FROM latest LEFT JOIN loaders USING (coordinates)
WHERE version IS NULL OR version != latest_version""")
def changed_versions(t: Tables) -> DataFrame:
    coordinate = lambda kind, name: F.concat(
        lit("org."), F.lower(kind), lit(":"), F.replace(col(name), lit(" "), lit("-"))
    ).alias("coordinates")
    latest = t.part.select(
        coordinate("p_type", "p_name"), F.concat(text("p_size"), lit(".0")).alias("latest_version")
    ).distinct()
    return lookups.changed_versions(
        latest, artifacts(t).withColumn("coordinates", coordinate("license", "name"))
    )


@query("pack_members", """
SELECT l_orderkey AS pack_id, p_partkey AS file_id, p_name AS file_name
FROM lineitem JOIN part ON p_partkey = l_partkey
UNION ALL
SELECT l_orderkey, p_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_suppkey""")
def packs(t: Tables) -> DataFrame:
    entry = lambda c: F.concat(lit('{"projectID":1,"fileID":'), text(c), lit("}"))
    manifest = F.concat(lit('{"name":"x","files":['), entry("l_partkey"), lit(","), entry("l_suppkey"), lit("]}"))
    listed = t.lineitem.select(col("l_orderkey").alias("pack_id"), manifest.alias("manifest"))
    catalogue = t.part.select(col("p_partkey").alias("file_id"), col("p_name").alias("file_name"))
    return pack_members(listed, catalogue).select("pack_id", "file_id", "file_name")
