"""Closure, overriding members, nested trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.versions import version_key
from ..operators import closure, nested
from ..session import materialize
from .registry import Tables, query
from .roles import (
    CYCLIC_EDGES, MEMBERS, TREE_EDGES, TREE_NODES, artifacts, busiest_parent, col, cyclic_edges, lit, members,
    text, tree_edges,
)

BELOW = """
below AS (
  SELECT root, child AS node FROM roots JOIN edges ON parent = root
  UNION
  SELECT b.root, e.child FROM below b JOIN edges e ON e.parent = b.node
)"""


@query("descendants", f"""
WITH RECURSIVE {TREE_EDGES}, roots AS (SELECT 'r' || r_regionkey AS root FROM region), {BELOW}
SELECT root, node FROM below""")
def descendants(t: Tables) -> DataFrame:
    roots = t.region.select(F.concat(lit("r"), text("r_regionkey")).alias("root"))
    return closure.descendants(tree_edges(t), roots)


@query("descendants_cyclic", f"WITH RECURSIVE {CYCLIC_EDGES}, {BELOW} SELECT root, node FROM below")
def descendants_cyclic(t: Tables) -> DataFrame:
    edges = cyclic_edges(t)
    return closure.descendants(edges, busiest_parent(edges))


@query("descendants_by_name", f"""
WITH RECURSIVE {TREE_EDGES},
names AS (SELECT n_name AS name FROM nation UNION SELECT p_name FROM part),
classes AS (SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation UNION SELECT 'r' || r_regionkey, r_name FROM region),
roots AS (SELECT DISTINCT id AS root FROM names JOIN classes USING (name)), {BELOW}
SELECT name, node FROM below JOIN classes ON classes.id = root""")
def descendants_by_name(t: Tables) -> DataFrame:
    """Unknown names find no class and so no descendants."""
    names = t.nation.select(col("n_name").alias("name")).union(t.part.select("p_name")).distinct()
    classes = t.nation.select(F.concat(lit("n"), text("n_nationkey")).alias("root"), col("n_name").alias("name")).union(
        t.region.select(F.concat(lit("r"), text("r_regionkey")), "r_name")
    )
    return closure.descendants_by_name(tree_edges(t), classes, names).select("name", "node")


OVERRIDES = """
own AS (SELECT root, cls, name, descriptor FROM members JOIN roots ON cls = root WHERE {pattern})
SELECT root, cls || '.' || name || '.' || descriptor AS id, cls, name, descriptor FROM own
UNION
SELECT b.root, m.cls || '.' || m.name || '.' || m.descriptor, m.cls, m.name, m.descriptor
FROM below b JOIN members m ON m.cls = b.node
JOIN own ON own.root = b.root AND own.name = m.name AND own.descriptor = m.descriptor"""


@query("overriding_members", f"""
WITH RECURSIVE {CYCLIC_EDGES}, {MEMBERS}, {BELOW}, {OVERRIDES.format(pattern='true')}""")
def overriding_members(t: Tables) -> DataFrame:
    edges = materialize(cyclic_edges(t), "edges")
    return closure.overriding_members(members(t), edges, busiest_parent(edges), distinct=True)


@query("overriding_members_like", f"""
WITH RECURSIVE {CYCLIC_EDGES}, {MEMBERS}, {BELOW}, {OVERRIDES.format(pattern="regexp_matches(name, '^[AN]')")}""")
def overriding_members_like(t: Tables) -> DataFrame:
    edges = materialize(cyclic_edges(t), "edges")
    return closure.overriding_members(members(t), edges, busiest_parent(edges), "^[AN]", distinct=True)


@query("inheritance_edges", """
SELECT DISTINCT 's' || l_suppkey AS parent, 'k' || l_partkey AS child FROM lineitem
UNION
SELECT DISTINCT 'i' || l_linenumber, 'k' || l_partkey FROM lineitem""")
def inheritance_edges(t: Tables) -> DataFrame:
    line = t.lineitem.select(
        F.concat_ws(".", text("l_orderkey"), text("l_partkey")).alias("def_id"),
        F.concat(lit("k"), text("l_partkey")).alias("class_name"),
        F.array(F.concat(lit("s"), text("l_suppkey")), F.concat(lit("i"), text("l_linenumber"))).alias("parents"),
    )
    parents = line.select("def_id", F.explode("parents").alias("parent"))
    return closure.inheritance_edges(line.select("def_id", "class_name").distinct(), parents)


@query("nested_ids", f"WITH {TREE_NODES} SELECT DISTINCT artifact, id FROM nodes")
def nested_ids(t: Tables) -> DataFrame:
    return nested.nested_ids(artifacts(t).withColumnRenamed("id", "artifact"), ["artifact"])


@query("flatten_tree", f"""
WITH {TREE_NODES}
SELECT artifact, CASE place WHEN 0 THEN '0' WHEN 1 THEN '0.0' ELSE '1' END AS path, depth, id, version, sha1 FROM nodes""")
def flatten_tree(t: Tables) -> DataFrame:
    flat = nested.flatten_tree(artifacts(t).withColumnRenamed("id", "artifact"), ["artifact"])
    return flat.withColumn("path", F.array_join(col("path").cast("array<string>"), "."))


@query("expand_nested", f"""
WITH {TREE_NODES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v1 DESC, v2 DESC, artifact, place) AS rn FROM nodes)
SELECT id, version, sha1, artifact AS position, depth FROM ranked WHERE rn = 1""")
def expand_nested(t: Tables) -> DataFrame:
    candidates = artifacts(t).select(col("id").alias("position"), "nested_tree")
    return nested.expand_nested(candidates).select("id", "version", "sha1", "position", "depth")


@query("max_version_per_id", """
WITH v AS (
  SELECT p_name AS id, p_partkey, p_size, p_partkey % 10 AS minor,
         CASE p_type WHEN 'PROMO' THEN '-alpha' WHEN 'SMALL' THEN '-rc' WHEN 'ECONOMY' THEN '.Final' WHEN 'LARGE' THEN '-sp' ELSE '' END AS tail,
         CASE p_type WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 3 ELSE 2 END AS rank
  FROM part),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_size DESC, minor DESC, rank DESC, p_partkey) AS rn FROM v)
SELECT id, p_size || '.' || minor || tail AS version, p_partkey FROM ranked WHERE rn = 1""")
def max_version_per_id(t: Tables) -> DataFrame:
    kind = col("p_type")
    tail = (
        F.when(kind == "PROMO", "-alpha").when(kind == "SMALL", "-rc").when(kind == "ECONOMY", ".Final")
        .when(kind == "LARGE", "-sp").otherwise("")
    )
    rows = t.part.select(
        col("p_name").alias("id"), "p_partkey",
        F.concat(text("p_size"), lit("."), (col("p_partkey") % 10).cast("string"), tail).alias("version"),
    )
    place = F.array(col("p_partkey").cast("bigint"))
    return nested.newest_per_id(rows, ["id"], col("version"), place, ["version", "p_partkey"]).drop("first_seen")


@query("version_order", """
SELECT p_partkey, dense_rank() OVER (ORDER BY p_size, p_partkey % 10) AS version_rank FROM part""")
def version_order(t: Tables) -> DataFrame:
    """The rank of every version among the distinct ones, by sorting keys at scale."""
    from ..operators.dictionary import dense_rank_rows

    rows = t.part.select(
        "p_partkey",
        version_key(F.concat(text("p_size"), lit(".0"), (col("p_partkey") % 10).cast("string"), lit(".0"))).alias("key"),
    )
    ranks = dense_rank_rows(rows.select("key").distinct(), ["key"], "version_rank")
    return rows.join(ranks, "key").select("p_partkey", "version_rank")


@query("build_nested", """
WITH lines AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_returnflag = 'R' AS alone FROM lineitem),
inner_nodes AS (
  SELECT o, p, string_agg('{"id":"s:' || s || '","version":"' || (s % 7) || '"}', ',' ORDER BY s) AS json
  FROM (SELECT DISTINCT o, p, s FROM lines WHERE NOT alone) GROUP BY o, p),
outer_nodes AS (
  SELECT DISTINCT l.o, l.p, '{"id":"p:' || l.p || '","version":"' || (l.p % 5) || '"'
         || coalesce(',"nested":[' || i.json || ']', '') || '}' AS json
  FROM lines l LEFT JOIN inner_nodes i ON i.o = l.o AND i.p = l.p)
SELECT 'o' || o AS root, '[' || string_agg(json, ',' ORDER BY p) || ']' AS nested_tree FROM outer_nodes GROUP BY o""")
def build_nested(t: Tables) -> DataFrame:
    """Orders contain parts; parts that were not returned contain their suppliers."""
    line = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag").distinct()
    order, part, supplier = text("l_orderkey"), text("l_partkey"), text("l_suppkey")
    node = F.concat_ws("/", order, part)
    edge = lambda parent, child, position, id, version, depth: [
        parent.alias("parent"), child.alias("child"), position.alias("position"), id.alias("id"),
        version.cast("string").alias("version"), lit(depth).alias("depth"),
    ]
    outer = line.select(*edge(F.concat(lit("o"), order), node, col("l_partkey"), F.concat(lit("p:"), part), col("l_partkey") % 5, 0)).distinct()
    inner = line.where(col("l_returnflag") != "R").select(
        *edge(node, F.concat_ws("/", order, part, supplier), col("l_suppkey"), F.concat(lit("s:"), supplier), col("l_suppkey") % 7, 1)
    ).distinct()
    return nested.build_nested(outer.union(inner), 1)
