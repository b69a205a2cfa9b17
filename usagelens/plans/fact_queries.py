"""Flattening, dictionaries, cleaning, remapping, tag and extension files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import jsonvalues
from ..functions.scalars import tag_search_key
from ..operators import clean, dictionary, flatten, remap
from ..session import at_once, condense, materialize, new_path
from ..sinks.dictionaries import ANNOTATIONS, KEYS, Dictionaries
from ..sources import datafiles
from .registry import Tables, query
from .roles import RECORDS, col, lit, records, text

# ------------------------------------------------------------------ flattening


def _long(tables: dict[str, DataFrame]) -> DataFrame:
    """Several fact tables under one set of columns."""
    def shape(name: str, df: DataFrame) -> DataFrame:
        a, b = {
            "class_defs": (None, None), "class_parents": ("parent", None),
            "field_defs": ("name", "descriptor"), "method_defs": ("name", "descriptor"),
            "method_references": ("owner", "name"), "field_references": ("owner", "name"),
            "class_annotations": ("annotation", "value"), "method_annotations": ("annotation", "value"),
            "field_annotations": ("annotation", "value"),
        }[name]
        some = lambda c: (col(c) if c else lit(None)).cast("string")
        count = col("count") if "count" in df.columns else lit(1)
        return df.select(
            lit(name).alias("table_name"), "artifact_id", "position", "class_name",
            some(a).alias("a"), some(b).alias("b"), count.cast("bigint").alias("n"),
        )

    return reduce(DataFrame.union, [shape(n, df) for n, df in tables.items()])


FACTS = """
SELECT 'class_defs' AS table_name, artifact_id, position, class_name, NULL::VARCHAR AS a, NULL::VARCHAR AS b, 1::BIGINT AS n FROM {records}
UNION ALL SELECT 'class_parents', artifact_id, position, class_name, super, NULL, 1 FROM {records} WHERE super IS NOT NULL
UNION ALL SELECT 'class_parents', artifact_id, position, class_name, interface, NULL, 1 FROM {records} WHERE interface IS NOT NULL
UNION ALL SELECT 'field_defs', artifact_id, position, class_name, field, 'I', 1 FROM {records} WHERE {fields}
UNION ALL SELECT 'method_defs', artifact_id, position, class_name, method, '()V', 1 FROM {records} WHERE {methods}
"""
LAMBDAS = """
UNION ALL SELECT 'method_defs', artifact_id, position, class_name, lambda_name, '()V', 1 FROM {records}"""
REFS = """
UNION ALL SELECT 'method_references', artifact_id, position, class_name, owner, name, "count" FROM {method_refs}
UNION ALL SELECT 'field_references', artifact_id, position, class_name, owner, name, "count" FROM {field_refs}"""


@query("flatten_records", f"""
WITH {RECORDS} {FACTS.format(records='records', fields='true', methods='true')} {LAMBDAS.format(records='records')}
{REFS.format(method_refs='method_references', field_refs='field_references')}""")
def flatten_records(t: Tables) -> DataFrame:
    tables = flatten.flatten_records(records(t), strict_smallint=True)
    return _long({k: v for k, v in tables.items() if "annotations" not in k})


@query("flatten_annotations", f"""
WITH {RECORDS},
marks AS (SELECT artifact_id, position, class_name, annotated, '{{"a":"x","n":' || n || '}}' AS value FROM records)
SELECT 'class_annotations' AS table_name, artifact_id, position, class_name, 'x/Mark' AS a, value AS b, 1::BIGINT AS n FROM marks
UNION ALL
SELECT 'field_annotations', artifact_id, position, class_name, 'x/Mark', value, 1 FROM marks WHERE annotated""")
def flatten_annotations(t: Tables) -> DataFrame:
    tables = flatten.flatten_records(records(t))
    return _long({k: v for k, v in tables.items() if "annotations" in k})


@query("reference_counts", """
SELECT l_suppkey AS class_id, 'method' AS kind, l_partkey AS owner, l_returnflag AS name, l_linestatus AS descriptor,
       count(*) AS count
FROM lineitem GROUP BY ALL""")
def reference_counts(t: Tables) -> DataFrame:
    calls = t.lineitem.select(
        col("l_suppkey").alias("class_id"), lit("method").alias("kind"), col("l_partkey").alias("owner"),
        col("l_returnflag").alias("name"), col("l_linestatus").alias("descriptor"),
    )
    return flatten.count_references(calls, calls.columns)


@query("link_counts", """
WITH hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
SELECT page_id, target, count(*) AS count FROM hrefs GROUP BY ALL""")
def link_counts(t: Tables) -> DataFrame:
    """The same counting over references found in whole page texts."""
    links = t.pages.select(
        "page_id", F.explode(F.regexp_extract_all("html", lit('href="([^"]*)"'), lit(1))).alias("target")
    )
    return flatten.count_references(links, ["page_id", "target"])


@query("broken_keys", f"""
WITH {RECORDS.replace("records AS (", "numbered AS (", 1).split("method_references AS")[0].rstrip().rstrip(",")},
records AS (SELECT * REPLACE (0 AS position) FROM numbered)
SELECT 'method_defs' AS "table", artifact_id, class_name, count(*) AS copies FROM records
GROUP BY artifact_id, position, class_name, method HAVING count(*) > 1
UNION ALL
SELECT 'method_defs', artifact_id, class_name, count(*) FROM records
GROUP BY artifact_id, position, class_name, lambda_name HAVING count(*) > 1
UNION ALL
SELECT 'field_defs', artifact_id, class_name, count(*) FROM records
GROUP BY artifact_id, position, class_name, field HAVING count(*) > 1
UNION ALL
SELECT 'class_parents', artifact_id, class_name, count(*) FROM (
  SELECT artifact_id, position, class_name, super AS parent FROM records WHERE super IS NOT NULL
  UNION ALL SELECT artifact_id, position, class_name, interface FROM records WHERE interface IS NOT NULL)
GROUP BY artifact_id, position, class_name, parent HAVING count(*) > 1""")
def broken_keys(t: Tables) -> DataFrame:
    """All records of one class name in an artifact taken as one definition, so that keys repeat."""
    return flatten.broken_keys(flatten.flatten_records(records(t).withColumn("position", lit(0).cast("bigint"))))


# ---------------------------------------------------------------- dictionaries


@query("dictionary_ids", """
WITH first AS (SELECT dense_rank() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT p_name AS name FROM part)),
fresh AS (SELECT DISTINCT name FROM (SELECT p_type || '/' || p_size AS name FROM part UNION SELECT c_name FROM customer UNION SELECT p_name FROM part)
          WHERE name NOT IN (SELECT name FROM first))
SELECT id, name FROM first
UNION ALL
SELECT (SELECT max(id) FROM first) + dense_rank() OVER (ORDER BY name), name FROM fresh""")
def dictionary_ids(t: Tables) -> DataFrame:
    """A first batch of names, then an increment that keeps every given id."""
    first = dictionary.build(t.part.select(col("p_name").alias("name")), ["name"])
    more = (
        t.part.select(F.concat_ws("/", "p_type", text("p_size")).alias("name"))
        .union(t.customer.select("c_name")).union(t.part.select("p_name"))
    )
    return dictionary.extend(first, more, ["name"])


@query("json_dictionary", """
WITH v AS (SELECT DISTINCT json_extract(props, '$.k')::INTEGER AS k FROM events)
SELECT row_number() OVER (ORDER BY '{"k":' || k || '}') AS id, '{"k":' || k || '}' AS value FROM v""")
def json_dictionary(t: Tables) -> DataFrame:
    """JSON values are one entry however they are spelled."""
    spelled = t.events.select(
        F.when(col("event_type") == "click", F.replace(col("props"), lit("}"), lit(".0 }"))).otherwise(col("props")).alias("props")
    )
    return dictionary.build(spelled.select(jsonvalues.canonical_json(col("props")).alias("value")), ["value"])


@query("composite_dictionary", """
WITH m AS (SELECT DISTINCT 'k' || l_partkey AS owner, l_returnflag AS name, l_linestatus || l_linenumber AS descriptor FROM lineitem),
classes AS (SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT owner AS name FROM m)),
constants AS (SELECT row_number() OVER (ORDER BY constant) AS id, constant
              FROM (SELECT name AS constant FROM m UNION SELECT descriptor FROM m)),
keyed AS (SELECT c.id AS owner_id, n.id AS name_id, d.id AS descriptor_id
          FROM m JOIN classes c ON c.name = m.owner JOIN constants n ON n.constant = m.name
          JOIN constants d ON d.constant = m.descriptor)
SELECT row_number() OVER (ORDER BY owner_id, name_id, descriptor_id) AS id, * FROM keyed""")
def composite_dictionary(t: Tables) -> DataFrame:
    m = t.lineitem.select(
        F.concat(lit("k"), text("l_partkey")).alias("owner"), col("l_returnflag").alias("name"),
        F.concat("l_linestatus", text("l_linenumber")).alias("descriptor"),
    ).distinct()
    classes = dictionary.build(m.select(col("owner").alias("name")), ["name"])
    words = m.select(F.explode(F.array("name", "descriptor")).alias("constant"))
    return dictionary.member_dictionary(m, classes, dictionary.build(words, ["constant"]))


# Entries of the first lines' records come before all others.
FIRST_BATCH = 2_000_000_000_000_000


@query("stored_dictionaries", f"""
WITH {RECORDS},
class_values AS (
  SELECT class_name AS name, position FROM records UNION ALL SELECT super, position FROM records
  UNION ALL SELECT interface, position FROM records UNION ALL SELECT owner, position FROM method_references
  UNION ALL SELECT 'I', position FROM records UNION ALL SELECT 'x/Mark', position FROM records),
constant_values AS (
  SELECT method AS name, position FROM records UNION ALL SELECT lambda_name, position FROM records
  UNION ALL SELECT '()V', position FROM records UNION ALL SELECT field, position FROM records),
json_texts AS (SELECT '{{"a":"x","n":' || n || '}}' AS name, position FROM records),
method_values AS (
  SELECT class_name AS owner, method AS name, position FROM records UNION ALL SELECT class_name, lambda_name, position FROM records
  UNION ALL SELECT owner, name, position FROM method_references),
classes AS (SELECT row_number() OVER (ORDER BY min(position) >= {FIRST_BATCH}, name) AS id, name FROM class_values WHERE name IS NOT NULL GROUP BY name),
constants AS (SELECT row_number() OVER (ORDER BY min(position) >= {FIRST_BATCH}, name) AS id, name FROM constant_values GROUP BY name),
json_values AS (SELECT row_number() OVER (ORDER BY min(position) >= {FIRST_BATCH}, name) AS id, name FROM json_texts GROUP BY name),
m AS (SELECT owner, name, min(position) >= {FIRST_BATCH} AS late FROM method_values GROUP BY owner, name),
f AS (SELECT class_name AS owner, field AS name, min(position) >= {FIRST_BATCH} AS late FROM records GROUP BY ALL),
methods AS (
  SELECT row_number() OVER (ORDER BY late, c.id, k.id, d.id) AS id, c.id AS cls, k.id AS name, d.id AS descriptor, m.owner, m.name AS called
  FROM m JOIN classes c ON c.name = m.owner JOIN constants k ON k.name = m.name JOIN constants d ON d.name = '()V'),
fields AS (
  SELECT row_number() OVER (ORDER BY late, c.id, k.id, d.id) AS id, c.id AS cls, k.id AS name, d.id AS descriptor
  FROM f JOIN classes c ON c.name = f.owner JOIN constants k ON k.name = f.name JOIN classes d ON d.name = 'I')
SELECT 'classes' AS kind, id, name AS text, NULL::BIGINT AS cls, NULL::BIGINT AS name, NULL::BIGINT AS descriptor, NULL::BIGINT AS n FROM classes
UNION ALL SELECT 'constants', id, name, NULL, NULL, NULL, NULL FROM constants
UNION ALL SELECT 'json_values', id, name, NULL, NULL, NULL, NULL FROM json_values
UNION ALL SELECT 'methods', id, NULL, cls, name, descriptor, NULL FROM methods
UNION ALL SELECT 'fields', id, NULL, cls, name, descriptor, NULL FROM fields
UNION ALL SELECT 'uses of a method', m.id, NULL, NULL, NULL, NULL, sum(r."count")::BIGINT
FROM method_references r JOIN methods m ON m.owner = r.owner AND m.called = r.name GROUP BY m.id
UNION ALL SELECT 'uses of a value', j.id, NULL, NULL, NULL, NULL, count(*) FROM json_texts t JOIN json_values j USING (name) GROUP BY j.id""")
def stored_dictionaries(t: Tables) -> DataFrame:
    """Dictionaries of a first batch, extended by all records, and facts that hold their ids."""
    held = Dictionaries(t.spark, new_path(t.spark, "dictionaries")).create()
    facts = flatten.flatten_records(records(t))
    # Written, since both batches and their ids read them: each JSON text is parsed once.
    facts |= dict(zip(ANNOTATIONS, at_once(lambda name: condense(facts[name], name), ANNOTATIONS)))
    held.extend({name: rows.where(col("position") < FIRST_BATCH) for name, rows in facts.items()})
    held.extend(facts)
    coded = held.encode({name: facts[name] for name in ("method_references", "class_annotations")})
    none = lit(None).cast("bigint")
    shape = lambda kind, df, text, keys, n: df.select(
        lit(kind).alias("kind"), "id", text.cast("string").alias("text"),
        *[k.alias(name) for k, name in zip(keys, ("cls", "name", "descriptor"))], n.cast("bigint").alias("n"),
    )
    plain = [shape(k, held.read(k), col(KEYS[k][0]), (none,) * 3, none) for k in ("classes", "constants", "json_values")]
    members = [shape(k, held.read(k), none, (col("cls"), col("name"), col("descriptor")), none) for k in ("methods", "fields")]
    called = coded["method_references"].groupBy(col("member").alias("id")).agg(F.sum("count").alias("n"))
    valued = coded["class_annotations"].groupBy(col("value").alias("id")).agg(F.count(lit(1)).alias("n"))
    used = [shape(kind, df, none, (none,) * 3, col("n")) for kind, df in (("uses of a method", called), ("uses of a value", valued))]
    return reduce(DataFrame.union, [*plain, *members, *used])


# -------------------------------------------------------------------- cleaning

PUBLIC_FIELD, PUBLIC_METHOD = "(field_access & 5) != 0 OR annotated", "(method_access & 5) != 0"
NOT_ANONYMOUS = r"NOT regexp_matches(class_name, '\$[0-9]+$')"

# Members whose direct use by their own artifact is of no interest.
REMOVABLE = """
deciding AS (
  SELECT artifact_id, class_name, arg_max(method, position) AS method, arg_max(method_access, position) AS method_access,
         arg_max(field, position) AS field, arg_max(field_access, position) AS field_access,
         arg_max(interface IS NULL AND (super IS NULL OR super = 'java/lang/Object'), position) AS raw
  FROM records GROUP BY ALL),
own_methods AS (SELECT artifact_id, class_name AS owner, method AS name FROM deciding
                WHERE raw OR (method_access & 8) != 0 OR (method_access & 5) = 0),
own_fields AS (SELECT artifact_id, class_name AS owner, field AS name FROM deciding
               WHERE raw OR (field_access & 8) != 0 OR (field_access & 5) = 0),
kept_methods AS (SELECT * FROM method_references r ANTI JOIN own_methods USING (artifact_id, owner, name)),
kept_fields AS (SELECT * FROM field_references r ANTI JOIN own_fields USING (artifact_id, owner, name))"""


@query("clean_private", f"""
WITH {RECORDS}
SELECT artifact_id, position, class_name, 'fields' AS kind, field AS name FROM records WHERE {PUBLIC_FIELD}
UNION ALL SELECT artifact_id, position, class_name, 'methods', method FROM records WHERE {PUBLIC_METHOD}""")
def clean_private(t: Tables) -> DataFrame:
    cleaned = clean.drop_private(records(t))
    of = lambda kind: flatten.member_defs(cleaned, kind).select(
        "artifact_id", "position", "class_name", lit(kind).alias("kind"), "name"
    )
    return of("fields").union(of("methods"))


@query("clean_lambdas", f"""
WITH {RECORDS} SELECT artifact_id, position, class_name, method AS name FROM records""")
def clean_lambdas(t: Tables) -> DataFrame:
    return flatten.member_defs(clean.drop_lambdas(records(t)), "methods").drop("descriptor")


@query("clean_anonymous", f"""
WITH {RECORDS} SELECT artifact_id, position, class_name FROM records WHERE {NOT_ANONYMOUS}""")
def clean_anonymous(t: Tables) -> DataFrame:
    return flatten.class_defs(clean.drop_anonymous(records(t)))


@query("clean_own_refs", f"""
WITH {RECORDS}, {REMOVABLE}
SELECT 'methods' AS kind, artifact_id, position, class_name, owner, name, "count" FROM kept_methods
UNION ALL
SELECT 'fields', artifact_id, position, class_name, owner, name, "count" FROM kept_fields""")
def clean_own_refs(t: Tables) -> DataFrame:
    whole = records(t)
    own = materialize(clean.removable_members(whole), "removable")
    of = lambda kind, refs: clean.drop_own_references(flatten.references(whole, refs), own, kind).select(
        lit(kind).alias("kind"), "artifact_id", "position", "class_name", "owner", "name", "count"
    )
    return of("methods", "method_refs").union(of("fields", "field_refs"))


@query("clean_rules", f"""
WITH {RECORDS}, {REMOVABLE},
loader AS (SELECT * FROM records WHERE {NOT_ANONYMOUS})
SELECT 'artifact' AS rules, * FROM ({FACTS.format(records='records', fields=PUBLIC_FIELD, methods=PUBLIC_METHOD)}
{REFS.format(method_refs='kept_methods', field_refs='kept_fields')})
UNION ALL
SELECT 'loader', * FROM ({FACTS.format(records='loader', fields='true', methods='true')})""")
def clean_rules(t: Tables) -> DataFrame:
    """Both rule chains: of normal artifacts, and of loader artifacts."""
    normal = {k: v for k, v in clean.clean_artifact(records(t)).items() if "annotations" not in k}
    rules = lambda name, tables: _long(tables).select(lit(name).alias("rules"), "*")
    return rules("artifact", normal).union(rules("loader", clean.clean_loader(records(t))))


@query("annotation_filter", """
WITH a AS (
  SELECT p_partkey,
    CASE p_type WHEN 'PROMO' THEN 'Lkotlin/Metadata;' WHEN 'SMALL' THEN 'Lscala/reflect/ScalaSignature;'
      WHEN 'ECONOMY' THEN 'Lorg/spongepowered/asm/mixin/Mixin;' WHEN 'LARGE' THEN 'Lx/mixinextras/' || p_brand || ';'
      ELSE 'Lx/' || p_name || ';' END AS descriptor, p_size > 25 AS visible FROM part)
SELECT p_partkey, descriptor FROM a
WHERE NOT (suffix(descriptor, 'kotlin/Metadata;') OR contains(descriptor, 'scala/reflect/') OR contains(descriptor, 'scala3/reflect/'))
  AND (visible OR prefix(descriptor, 'Lorg/spongepowered/asm/mixin/') OR contains(descriptor, '/mixinextras/'))""")
def annotation_filter(t: Tables) -> DataFrame:
    kind = col("p_type")
    descriptor = (
        F.when(kind == "PROMO", "Lkotlin/Metadata;").when(kind == "SMALL", "Lscala/reflect/ScalaSignature;")
        .when(kind == "ECONOMY", "Lorg/spongepowered/asm/mixin/Mixin;")
        .when(kind == "LARGE", F.concat(lit("Lx/mixinextras/"), "p_brand", lit(";")))
        .otherwise(F.concat(lit("Lx/"), "p_name", lit(";")))
    )
    rows = t.part.select("p_partkey", descriptor.alias("descriptor"), (col("p_size") > 25).alias("visible"))
    return rows.where(clean.keep_annotation(col("descriptor"), col("visible"))).drop("visible")


# ------------------------------------------------------------------- remapping

MAPPING = """
mapping AS (SELECT (CASE WHEN p_size > 10 THEN 'x/P' ELSE 'w/P' END) || p_partkey AS original,
                   'y/' || replace(p_name, ' ', '$') || p_partkey AS mapped FROM part WHERE p_size <= 40)"""


def _mapping(t: Tables) -> DataFrame:
    prefix = F.when(col("p_size") > 10, "x/P").otherwise("w/P")
    return t.part.where("p_size <= 40").select(
        F.concat(prefix, text("p_partkey")).alias("original"),
        F.concat(lit("y/"), F.replace(col("p_name"), lit(" "), lit("$")), text("p_partkey")).alias("mapped"),
    )


OWNER = "(CASE WHEN l_linenumber < 6 THEN 'x/P' ELSE 'w/P' END) || l_partkey"


def _owner():
    return F.concat(F.when(col("l_linenumber") < 6, "x/P").otherwise("w/P"), text("l_partkey"))


@query("remap_names", f"""
WITH {MAPPING}, refs AS (SELECT l_orderkey, l_linenumber, {OWNER} AS owner FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN prefix(owner, 'x/') THEN mapped END, owner) AS owner
FROM refs LEFT JOIN mapping ON original = owner""")
def remap_names(t: Tables) -> DataFrame:
    refs = t.lineitem.select("l_orderkey", "l_linenumber", _owner().alias("owner"))
    return remap.remap_names(refs, "owner", _mapping(t), "x/")


@query("remap_descriptors", f"""
WITH {MAPPING},
refs AS (SELECT l_orderkey, l_linenumber, {OWNER} AS a, 'x/P' || l_suppkey AS b, l_quantity > 40 AS plain FROM lineitem),
done AS (SELECT l_orderkey, l_linenumber, plain, coalesce(CASE WHEN prefix(a, 'x/') THEN m.mapped END, a) AS a, coalesce(n.mapped, b) AS b
         FROM refs LEFT JOIN mapping m ON m.original = a LEFT JOIN mapping n ON n.original = b)
SELECT l_orderkey, l_linenumber, CASE WHEN plain THEN '(IJ)V' ELSE '(L' || a || ';I[L' || b || ';)L' || a || ';' END AS descriptor FROM done""")
def remap_descriptors(t: Tables) -> DataFrame:
    a, b = _owner(), F.concat(lit("x/P"), text("l_suppkey"))
    described = F.concat(lit("(L"), a, lit(";I[L"), b, lit(";)L"), a, lit(";"))
    refs = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.when(col("l_quantity") > 40, "(IJ)V").otherwise(described).alias("descriptor")
    )
    return remap.remap_descriptors(refs, "descriptor", _mapping(t), "x/")


RENAMES = """
classes AS (SELECT 'c/P' || p_partkey AS original, 'y/Q' || (p_partkey // 2) AS mapped FROM part WHERE p_size <= 40
            UNION ALL SELECT 'x/Mark', 'z/Mark'),
methods AS (SELECT DISTINCT 'm' || (p_partkey % 8) AS original, 'call' || ((p_partkey % 8) // 2) AS mapped FROM part),
fields AS (SELECT DISTINCT 'f' || (p_partkey % 6) AS original, 'value' || (p_partkey % 6) AS mapped FROM part)"""


def _renames(t: Tables) -> DataFrame:
    entry = lambda kind, original, mapped: t.part.select(lit(kind).alias("kind"), original.alias("original"), mapped.alias("mapped"))
    key = col("p_partkey")
    digit = lambda n, by=1: F.floor((key % n) / by).cast("string")
    classes = entry("class", F.concat(lit("c/P"), text("p_partkey")), F.concat(lit("y/Q"), F.floor(key / 2).cast("string")))
    return (
        classes.where("p_size <= 40")
        .union(entry("method", F.concat(lit("m"), digit(8)), F.concat(lit("call"), digit(8, 2))))
        .union(entry("field", F.concat(lit("f"), digit(6)), F.concat(lit("value"), digit(6))))
        .union(entry("class", lit("x/Mark"), lit("z/Mark")))
    )


@query("remap_records", f"""
WITH {RECORDS}, {RENAMES},
r AS (
  SELECT records.*, coalesce(a.mapped, class_name) AS own, coalesce(b.mapped, 'c/P' || (l_partkey + 1)) AS next,
         coalesce(m.mapped, method) AS called, coalesce(f.mapped, field) AS stored
  FROM records LEFT JOIN classes a ON a.original = class_name LEFT JOIN classes b ON b.original = 'c/P' || (l_partkey + 1)
  LEFT JOIN methods m ON m.original = method LEFT JOIN fields f ON f.original = field),
facts AS (
  SELECT 'class_defs' AS table_name, artifact_id, position, class_name, NULL AS owner, NULL AS name, NULL AS descriptor, NULL::BIGINT AS n FROM r
  UNION ALL SELECT 'class_parents', artifact_id, position, class_name, super, NULL, NULL, NULL FROM r WHERE super IS NOT NULL
  UNION ALL SELECT 'class_parents', artifact_id, position, class_name, interface, NULL, NULL, NULL FROM r WHERE interface IS NOT NULL
  UNION ALL SELECT 'field_defs', artifact_id, position, class_name, NULL, stored, '[L' || own || ';', NULL FROM r
  UNION ALL SELECT 'method_defs', artifact_id, position, class_name, NULL, called, '(L' || own || ';[Lx/Mark;)V', NULL FROM r
  UNION ALL SELECT 'method_defs', artifact_id, position, class_name, NULL, lambda_name, '(L' || own || ';[Lx/Mark;)V', NULL FROM r
  UNION ALL SELECT 'class_annotations', artifact_id, position, class_name, 'x/Mark', NULL, '{{"a":"x","n":' || n || '}}', NULL FROM r
  UNION ALL SELECT 'field_annotations', artifact_id, position, class_name, 'x/Mark', stored, '[L' || own || ';', NULL FROM r WHERE annotated
  UNION ALL SELECT 'method_references', artifact_id, position, class_name, own, called, '(L' || own || ';[Lx/Mark;)V', n + CASE WHEN own = next THEN 1 ELSE 0 END FROM r
  UNION ALL SELECT 'method_references', artifact_id, position, class_name, next, called, '(L' || own || ';[Lx/Mark;)V', 1 FROM r WHERE own <> next
  UNION ALL SELECT 'field_references', artifact_id, position, class_name, own, stored, own, 1 FROM r)
SELECT * FROM facts""")
def remap_records(t: Tables) -> DataFrame:
    """All nine fact tables of records whose names are mapped, neighbours in the mapping becoming one."""
    described = F.concat(lit("(L"), "name", lit(";[Lx/Mark;)V"))
    typed = lambda column, value: F.transform(column, lambda m: m.withField("desc", value))
    landed = records(t).withColumns({
        "methods": typed("methods", described), "method_refs": typed("method_refs", described),
        "fields": typed("fields", F.concat(lit("[L"), "name", lit(";"))), "field_refs": typed("field_refs", col("name")),
    })
    whole = condense(landed, "landed")  # as class records are, before a run reads them
    renamed = condense(remap.remap_records(whole, _renames(t), class_prefix="c/", method_prefix="m", field_prefix="f"), "renamed")
    none = lit(None).cast("string")
    shapes = {
        "class_defs": (none, none, none), "class_parents": (col("parent"), none, none),
        "field_defs": (none, col("name"), col("descriptor")), "method_defs": (none, col("name"), col("descriptor")),
        "class_annotations": (col("annotation"), none, col("value")),
        "field_annotations": (col("annotation"), col("name"), col("descriptor")),
        "method_annotations": (col("annotation"), col("name"), col("descriptor")),
        "method_references": (col("owner"), col("name"), col("descriptor")), "field_references": (col("owner"), col("name"), col("descriptor")),
    }
    facts = []
    for table, rows in flatten.flatten_records(renamed).items():
        owner, name, descriptor = shapes[table]
        n = col("count").cast("bigint") if "count" in rows.columns else lit(None).cast("bigint")
        facts.append(rows.select(
            lit(table).alias("table_name"), "artifact_id", "position", "class_name", owner.alias("owner"), name.alias("name"),
            descriptor.alias("descriptor"), n.alias("n"),
        ))
    return reduce(DataFrame.union, facts)


@query("compose_mappings", """
WITH chained AS (
  SELECT p_type AS kind, coalesce(CASE WHEN s_suppkey IS NOT NULL THEN 'o' || (s_suppkey % 17) END, 'm' || p_partkey) AS original,
         p_name || p_size AS mapped, p_partkey AS position
  FROM part LEFT JOIN supplier ON s_suppkey = p_partkey)
SELECT kind, original, arg_max(mapped, position) AS mapped FROM chained GROUP BY ALL""")
def compose_mappings(t: Tables) -> DataFrame:
    middle = lambda c: F.concat(lit("m"), text(c))
    first = t.part.select(
        col("p_type").alias("kind"), F.concat("p_name", text("p_size")).alias("original"),
        middle("p_partkey").alias("mapped"), col("p_partkey").alias("position"),
    )
    kinds = t.part.select(col("p_type").alias("kind"), col("p_partkey").alias("s_suppkey"))
    second = t.supplier.join(kinds, "s_suppkey").select(
        "kind", middle("s_suppkey").alias("original"),
        F.concat(lit("o"), (col("s_suppkey") % 17).cast("string")).alias("mapped"),
    )
    return remap.compose_mappings(first, second)


# ------------------------------------------------------- tag and extension files


@query("tag_entries", """
WITH e AS (SELECT doc_id AS artifact_id, source || '/' || lang AS tag, n_chars > 5000 AS replace, lang, source FROM documents)
SELECT artifact_id, tag, replace, 'minecraft:' || lang AS entry FROM e
UNION ALL SELECT artifact_id, tag, replace, source || ':' || lang FROM e
UNION ALL SELECT artifact_id, tag, replace, '#minecraft:' || source FROM e""")
def tag_entries(t: Tables) -> DataFrame:
    return datafiles.tag_entries(_tag_files(t))


def _tag_files(t: Tables) -> DataFrame:
    content = F.concat(
        lit('{"replace":'), F.when(col("n_chars") > 5000, "true").otherwise("false"), lit(',"values":["'), "lang",
        lit('",{"id":"'), "source", lit(":"), "lang", lit('"},{"required":false},[1],null,"#'), "source", lit('"]}'),
    )
    return t.documents.select(
        col("doc_id").alias("artifact_id"), content.alias("content"),
        F.concat(lit("data/"), "source", lit("/tags/"), "lang", lit(".json")).alias("path"),
    )


@query("tag_search_key", """
SELECT doc_id, source || '/' || lang || '/' || (n_chars % 10) AS search_key, source || '//' AS bare_key FROM documents""")
def tag_keys(t: Tables) -> DataFrame:
    tag = F.concat("source", lit(":"), (col("n_chars") % 10).cast("string"))
    return t.documents.select(
        "doc_id", tag_search_key(col("lang"), tag).alias("search_key"),
        tag_search_key(lit(None).cast("string"), col("source")).alias("bare_key"),
    )


@query("extension_entries", """
SELECT p_partkey AS artifact_id, 'x/' || p_type AS enum, p_name AS name, '(I)V' AS "constructor",
       '[' || p_size || ',{"a":1,"b":"' || p_brand || '"}]' AS parameters FROM part""")
def extension_entries(t: Tables) -> DataFrame:
    content = F.concat(
        lit('{"entries":["ignored",{"enum":"x/'), "p_type", lit('","name":"'), "p_name",
        lit('","constructor":"(I)V","parameters":['), text("p_size"), lit('.0,{"b":"'), "p_brand", lit('","a":1}]}]}'),
    )
    return datafiles.extension_entries(t.part.select(col("p_partkey").alias("artifact_id"), content.alias("content")))


# ------------------------------------------------------------------ JSON values


@query("json_extract", """
SELECT event_id, json_extract_string(props, '$.k') AS k, json_exists(props, '$.k') AS has_k,
       '{"a":[' || json_extract_string(props, '$.k') || '],"z":"' || event_type || '"}' AS canonical FROM events""")
def json_extract(t: Tables) -> DataFrame:
    k = jsonvalues.json_text(col("props"), "$.k")
    document = F.concat(lit('{ "z" : "'), "event_type", lit('", "a" : ['), k, lit(".00] }"))
    return t.events.select(
        "event_id", k.alias("k"), k.isNotNull().alias("has_k"), jsonvalues.canonical_json(document).alias("canonical")
    )


@query("json_sanitize", """
SELECT event_id, CASE WHEN value > 100 THEN '"+inf"' WHEN event_type = 'error' THEN '"-inf"' ELSE value::VARCHAR END AS number,
       event_type || props AS cleaned FROM events""")
def json_sanitize(t: Tables) -> DataFrame:
    number = (
        F.when(col("value") > 100, lit(float("inf"))).when(col("event_type") == "error", lit(float("-inf")))
        .otherwise(col("value"))
    )
    return t.events.select(
        "event_id", jsonvalues.json_number(number).alias("number"),
        jsonvalues.strip_nul(F.concat("event_type", lit("\x00"), "props", lit("\x00"))).alias("cleaned"),
    )
