"""The driver's tables in the roles the operators work on.

Every role is a projection of whole tables. The SQL text beside a role says the
same for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .registry import Tables

col, lit = F.col, F.lit


def text(column: str) -> Column:
    return F.col(column).cast("string")


# ------------------------------------------------------------------- artifacts

ARTIFACTS = """
artifacts AS (
  SELECT p_partkey AS id,
         p_size || '.' || (p_partkey % 10) AS version,
         CASE WHEN p_brand = 'Brand#13' THEN '' ELSE p_name END AS name,
         CASE WHEN p_brand = 'Brand#7' THEN []::VARCHAR[] ELSE string_split(p_name, ' ') END AS ids,
         p_type AS license,
         p_size = 50 AS loader,
         p_brand AS authors,
         CASE WHEN p_brand <> 'Brand#1' THEN '{"modLoader":"' || lower(p_type) || '"}' END AS metadata_json,
         CASE WHEN p_size < 40 THEN 'org.' || lower(p_type) || ':' || replace(p_name, ' ', '-') END AS coordinates,
         CASE WHEN p_size > 15 THEN p_partkey END::INTEGER AS int_project_id,
         CASE WHEN p_size BETWEEN 2 AND 30 THEN 'p' || p_partkey END AS text_project_id
  FROM part
)"""

# The nested tree of an artifact: word 1 contains word 2, beside the brand.
TREE_NODES = """
nodes AS (
  SELECT p_partkey AS artifact, 'g:' || split_part(p_name, ' ', 1) AS id, p_size || '.0' AS version,
         p_size AS v1, 0 AS v2, sha1(p_name) AS sha1, 0 AS place, 0 AS depth
  FROM part WHERE p_brand <> 'Brand#2'
  UNION ALL
  SELECT p_partkey, 'g:' || split_part(p_name, ' ', 2), p_size || '.' || (p_partkey % 10),
         p_size, p_partkey % 10, NULL, 1, 1
  FROM part WHERE p_brand <> 'Brand#2'
  UNION ALL
  SELECT p_partkey, 'g:' || p_brand, '1.' || p_size, 1, p_size, NULL, 2, 0
  FROM part WHERE p_brand <> 'Brand#2'
)"""


def artifacts(t: Tables) -> DataFrame:
    size, brand, key = col("p_size"), col("p_brand"), col("p_partkey")
    first, second = F.split_part("p_name", lit(" "), lit(1)), F.split_part("p_name", lit(" "), lit(2))
    minor = (key % 10).cast("string")
    tree = F.concat(
        lit('[{"id":"g:'), first, lit('","version":"'), text("p_size"), lit('.0","sha1":"'), F.sha1("p_name"),
        lit('","nested":[{"id":"g:'), second, lit('","version":"'), text("p_size"), lit("."), minor,
        lit('"}]},{"id":"g:'), brand, lit('","version":"1.'), text("p_size"), lit('"}]'),
    )
    return t.part.select(
        key.alias("id"),
        F.concat(text("p_size"), lit("."), minor).alias("version"),
        F.when(brand == "Brand#13", "").otherwise(col("p_name")).alias("name"),
        F.when(brand == "Brand#7", F.array().cast("array<string>")).otherwise(F.split("p_name", " ")).alias("ids"),
        col("p_type").alias("license"),
        (size == 50).alias("loader"),
        brand.alias("authors"),
        F.when(brand != "Brand#2", tree).alias("nested_tree"),
        F.when(brand != "Brand#1", F.concat(lit('{"modLoader":"'), F.lower("p_type"), lit('"}'))).alias("metadata_json"),
        F.when(size < 40, F.concat(lit("org."), F.lower("p_type"), lit(":"), F.replace(col("p_name"), lit(" "), lit("-")))).alias("coordinates"),
        F.when(size > 15, key).cast("int").alias("int_project_id"),
        F.when(size.between(2, 30), F.concat(lit("p"), key.cast("string"))).alias("text_project_id"),
    )


CLASS_DEFS = """
class_defs AS (SELECT DISTINCT l_partkey AS artifact_id, 'sup/' || l_suppkey AS class_name FROM lineitem)"""


def class_defs(t: Tables) -> DataFrame:
    return t.lineitem.select(
        col("l_partkey").alias("artifact_id"), F.concat(lit("sup/"), text("l_suppkey")).alias("class_name")
    ).distinct()


# ----------------------------------------------------------------------- graph

TREE_EDGES = """
edges AS (
  SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation
  UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
)"""


def tree_edges(t: Tables) -> DataFrame:
    pair = lambda df, p, pk, c, ck: df.select(
        F.concat(lit(p), text(pk)).alias("parent"), F.concat(lit(c), text(ck)).alias("child")
    )
    return (
        pair(t.nation, "r", "n_regionkey", "n", "n_nationkey")
        .union(pair(t.customer, "n", "c_nationkey", "c", "c_custkey"))
        .union(pair(t.orders, "c", "o_custkey", "o", "o_orderkey"))
    )


# Suppliers and parts share one name space here, so the graph has hubs and cycles.
CYCLIC_EDGES = """
edges AS (SELECT DISTINCT 'k' || l_suppkey AS parent, 'k' || l_partkey AS child FROM lineitem),
roots AS (SELECT parent AS root FROM edges GROUP BY parent ORDER BY count(*) DESC, parent LIMIT 1)"""


def cyclic_edges(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat(lit("k"), text("l_suppkey")).alias("parent"), F.concat(lit("k"), text("l_partkey")).alias("child")
    ).distinct()


def busiest_parent(edges: DataFrame) -> DataFrame:
    return (
        edges.groupBy("parent").agg(F.count(lit(1)).alias("n"))
        .orderBy(col("n").desc(), "parent").limit(1).select(col("parent").alias("root"))
    )


MEMBERS = """
members AS (
  SELECT DISTINCT 'k' || l_partkey AS cls, l_returnflag AS name, l_linestatus || l_linenumber AS descriptor
  FROM lineitem
)"""


def members(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat(lit("k"), text("l_partkey")).alias("cls"), col("l_returnflag").alias("name"),
        F.concat("l_linestatus", text("l_linenumber")).alias("descriptor"),
    ).distinct().select(F.concat_ws(".", "cls", "name", "descriptor").alias("id"), "*")


# --------------------------------------------------------------- class records

# One class record per line item. Equal (artifact, name, position) means equal
# records, so "the later record decides" has one answer.
RECORDS = """
records AS (
  SELECT l_orderkey AS artifact_id,
         l_linenumber::BIGINT * 1000000000000000 + l_suppkey * 1000 + l_quantity::BIGINT AS position,
         'c/P' || l_partkey || CASE WHEN l_quantity > 45 THEN '$' || l_linenumber
                                    WHEN l_quantity > 40 THEN '$A' || l_linenumber ELSE '' END AS class_name,
         CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber < 5 THEN 'java/lang/Object'
              ELSE 'c/S' || l_suppkey END AS super,
         CASE WHEN l_linenumber % 3 = 0 THEN 'i/' || l_suppkey END AS interface,
         'f' || (l_suppkey % 10) AS field, (l_suppkey % 16)::INTEGER AS field_access,
         l_quantity > 25 AS annotated,
         'm' || (l_suppkey % 10) AS method, ((l_suppkey + l_quantity::BIGINT) % 16)::INTEGER AS method_access,
         'lambda$' || l_linenumber AS lambda_name,
         l_quantity::INTEGER AS n, l_partkey
  FROM lineitem
),
method_references AS (
  SELECT artifact_id, position, class_name, class_name AS owner, method AS name, '()V' AS descriptor, n AS "count" FROM records
  UNION ALL
  SELECT artifact_id, position, class_name, 'c/P' || (l_partkey + 1), method, '()V', 1 FROM records
),
field_references AS (
  SELECT artifact_id, position, class_name, class_name AS owner, field AS name, 'I' AS descriptor, 1 AS "count" FROM records
)"""


def records(t: Tables) -> DataFrame:
    quantity, line, supplier = col("l_quantity").cast("bigint"), text("l_linenumber"), col("l_suppkey")
    suffix = F.when(quantity > 45, F.concat(lit("$"), line)).when(quantity > 40, F.concat(lit("$A"), line)).otherwise("")
    name = F.concat(lit("c/P"), text("l_partkey"), suffix)
    digit = (supplier % 10).cast("string")
    mark = F.struct(
        lit("x/Mark").alias("type"),
        F.concat(lit('{"n":'), quantity.cast("string"), lit('.0, "a":"x"}')).alias("members"),
    )
    none = F.array().cast("array<struct<type:string,members:string>>")
    member = lambda n, d, access, marks: F.struct(
        n.alias("name"), lit(d).alias("desc"), access.cast("int").alias("access"), marks.alias("annotations")
    )
    ref = lambda owner, n, d, c: F.struct(
        owner.alias("owner"), n.alias("name"), lit(d).alias("desc"), c.cast("int").alias("count")
    )
    field, method = F.concat(lit("f"), digit), F.concat(lit("m"), digit)
    line_items = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return line_items.select(
        col("l_orderkey").alias("artifact_id"),
        (col("l_linenumber").cast("bigint") * 1000000000000000 + supplier * 1000 + quantity).alias("position"),
        name.alias("name"),
        F.when(col("l_linenumber") == 1, lit(None).cast("string")).when(col("l_linenumber") < 5, "java/lang/Object")
        .otherwise(F.concat(lit("c/S"), text("l_suppkey"))).alias("super"),
        F.when(col("l_linenumber") % 3 == 0, F.array(F.concat(lit("i/"), text("l_suppkey"))))
        .otherwise(F.array().cast("array<string>")).alias("interfaces"),
        F.array(mark).alias("annotations"),
        F.array(member(field, "I", supplier % 16, F.when(quantity > 25, F.array(mark)).otherwise(none))).alias("fields"),
        F.array(
            member(method, "()V", (supplier + quantity) % 16, none),
            member(F.concat(lit("lambda$"), line), "()V", lit(10), none),
        ).alias("methods"),
        F.array(
            ref(name, method, "()V", quantity),
            ref(F.concat(lit("c/P"), (col("l_partkey") + 1).cast("string")), method, "()V", lit(1)),
        ).alias("method_refs"),
        F.array(ref(name, field, "I", lit(1))).alias("field_refs"),
    )


# ------------------------------------------------------------- catalogue files

FILES = """
files AS (
  SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS catalogue, source AS project_id,
         doc_id AS file_id, doc_id AS position, [lang, 'any'] AS game_versions,
         [CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END] AS loaders,
         sha1(text) AS sha1, n_chars, lang, source
  FROM documents
)"""


def files(t: Tables) -> DataFrame:
    return t.documents.select(
        F.when(col("doc_id") % 2 == 0, "a").otherwise("b").alias("catalogue"),
        col("source").alias("project_id"),
        col("doc_id").alias("file_id"),
        col("doc_id").alias("position"),
        F.array("lang", lit("any")).alias("game_versions"),
        F.array(F.when(col("n_chars") > 1000, "long").otherwise("short")).alias("loaders"),
        F.sha1("text").alias("sha1"),
        F.timestamp_seconds(col("doc_id")).alias("published"),
        "n_chars", "lang", "source",
    )


# -------------------------------------------------------------- update listing

UPDATES = """
updates AS (
  SELECT user_id AS project_id, event_id AS file_id, ts AS updated, event_type <> 'error' AS available,
         event_type, value
  FROM events
),
known AS (
  SELECT event_id AS file_id,
         CASE WHEN value > 200 THEN date_trunc('second', ts) ELSE ts - INTERVAL 1 DAY END AS latest_date
  FROM events WHERE value > 100
)"""


def updates(t: Tables) -> DataFrame:
    return t.events.select(
        col("user_id").alias("project_id"), col("event_id").alias("file_id"),
        col("ts").cast("timestamp").alias("updated"), (col("event_type") != "error").alias("available"),
        col("ts").cast("timestamp").alias("latest_release"), "event_type", "value",
    )


def known_updates(t: Tables) -> DataFrame:
    """Stored dates: equal to the second for some files, a day older for others."""
    ts = col("ts").cast("timestamp")
    return t.events.where("value > 100").select(
        col("event_id").alias("file_id"),
        F.when(col("value") > 200, F.date_trunc("second", ts)).otherwise(ts - F.expr("INTERVAL 1 DAY")).alias("latest_date"),
    )
