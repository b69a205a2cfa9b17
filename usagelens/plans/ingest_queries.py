"""Incremental ingest, keyed sinks, sources, backfills and streaming."""

from __future__ import annotations

import io
import json
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.fingerprint import content_fingerprint
from ..functions.jsonvalues import canonical_json, json_text
from ..operators import backfill, incremental, listing, lookups
from ..session import materialize, new_path
from ..sinks import generations, tables
from ..sources import archives, datafiles, loaders, metadata
from ..streaming.ingest import ingest
from .registry import Tables, query
from .roles import (
    ARTIFACTS, CLASS_DEFS, FILES, UPDATES, artifacts, class_defs, col, files, known_updates, lit, text, updates,
)

# ----------------------------------------------------------------- catalogue


@query("latest_file_per_project", f"""
WITH {FILES}
SELECT catalogue, project_id, arg_min(file_id, position) AS file_id, arg_min(sha1, position) AS sha1
FROM files WHERE list_contains(game_versions, 'en') AND list_contains(loaders, 'long') GROUP BY ALL""")
def latest_file_per_project(t: Tables) -> DataFrame:
    return incremental.latest_file_per_project(files(t), "en", "long").drop("published")


@query("latest_release", """
WITH f AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS catalogue, user_id AS project_id, event_id, ts FROM events)
SELECT catalogue, project_id,
       epoch_us(CASE WHEN catalogue = 'b' THEN arg_min(ts, event_id) ELSE max(ts) END) AS latest_release
FROM f GROUP BY catalogue, project_id""")
def latest_release(t: Tables) -> DataFrame:
    listed = t.events.select(
        F.when(col("user_id") % 2 == 0, "a").otherwise("b").alias("catalogue"), col("user_id").alias("project_id"),
        col("event_id").alias("position"), col("event_id").alias("file_id"), col("ts").cast("timestamp").alias("published"),
    )
    newest = incremental.latest_release(listed, col("catalogue") == "b")
    return newest.withColumn("latest_release", F.unix_micros("latest_release"))


# One page of the listing by release date. The limit is the operator.
PAGE = """
page AS (SELECT user_id AS project_id, event_id, ts AS released, event_type, value FROM events
         ORDER BY ts DESC, user_id LIMIT 300)"""


def _projects(t: Tables) -> DataFrame:
    return t.events.select(
        col("user_id").alias("project_id"), col("ts").cast("timestamp").alias("released"),
        (col("event_type") != "error").alias("available"),
        F.when(col("value") > 5, col("event_id")).alias("file_id"),
    )


@query("newest_page", f"WITH {PAGE} SELECT project_id, epoch_us(released) AS released FROM page WHERE event_type <> 'error'")
def newest_page(t: Tables) -> DataFrame:
    return incremental.newest_page(_projects(t), 300).select("project_id", F.unix_micros("released").alias("released"))


@query("incremental_batch", f"""
WITH {UPDATES}, {PAGE},
joined AS (SELECT u.*, k.latest_date FROM updates u LEFT JOIN known k USING (file_id) WHERE available),
stop AS (SELECT max(updated) AS cut FROM joined WHERE date_trunc('second', updated) = date_trunc('second', latest_date)),
taken AS (SELECT project_id, max(updated) AS updated, arg_max(file_id, updated) AS file_id
          FROM joined WHERE latest_date IS NULL AND updated > (SELECT cut FROM stop) GROUP BY project_id),
newest AS (SELECT project_id, released, event_id AS file_id FROM page p
           WHERE event_type <> 'error' AND value > 5
             AND project_id NOT IN (SELECT project_id FROM taken) AND project_id NOT IN (SELECT s_suppkey FROM supplier)
           QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY released DESC) = 1)
SELECT 0 AS phase, epoch_us(updated) AS "at", project_id, file_id FROM taken
UNION ALL
SELECT 1, -epoch_us(released), project_id, file_id FROM newest""")
def incremental_batch(t: Tables) -> DataFrame:
    indexed = t.supplier.select(col("s_suppkey").alias("project_id"))
    return incremental.incremental_batch(updates(t), known_updates(t), _projects(t), indexed, 300)


@query("updated_prefix", f"""
WITH {UPDATES},
joined AS (SELECT u.*, k.latest_date FROM updates u LEFT JOIN known k USING (file_id) WHERE available),
stop AS (SELECT max(updated) AS cut FROM joined WHERE date_trunc('second', updated) = date_trunc('second', latest_date))
SELECT project_id, epoch_us(max(updated)) AS updated, arg_max(file_id, updated) AS file_id
FROM joined WHERE latest_date IS NULL AND updated > (SELECT cut FROM stop) GROUP BY project_id""")
def updated_prefix(t: Tables) -> DataFrame:
    found = incremental.updated_prefix(updates(t), known_updates(t))
    return found.withColumn("updated", F.unix_micros("updated"))


@query("known_by_hash", f"""
WITH {FILES}, known AS (SELECT sha1, min(file_id) AS artifact_id FROM files WHERE catalogue = 'b' GROUP BY 1)
SELECT file_id AS doc_id, sha1, artifact_id, artifact_id IS NULL AS to_index FROM files LEFT JOIN known USING (sha1)""")
def known_by_hash(t: Tables) -> DataFrame:
    whole = files(t)
    known = whole.where("catalogue = 'b'").groupBy("sha1").agg(F.min("file_id").alias("artifact_id"))
    return lookups.by_hash(whole.select(col("file_id").alias("doc_id"), "sha1"), known).withColumn("to_index", col("artifact_id").isNull())


@query("run_summary", """
WITH o AS (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'stored' WHEN 'P' THEN 'skipped'
                  ELSE CASE WHEN o_totalprice > 250000 THEN 'store_failed' ELSE 'index_failed' END END AS outcome,
                  o_orderstatus = 'F' AND o_totalprice < 100000 AS is_new FROM orders)
SELECT o_orderpriority, count(*) FILTER (outcome <> 'skipped') AS expected,
       count(*) FILTER (outcome IN ('stored', 'store_failed')) AS indexed,
       count(*) FILTER (outcome = 'stored') AS stored, count(*) FILTER (is_new) AS "new",
       count(*) FILTER (outcome IN ('index_failed', 'store_failed')) AS failed
FROM o GROUP BY ALL""")
def run_summary(t: Tables) -> DataFrame:
    return incremental.run_summary(_outcomes(t), "o_orderpriority")


def _outcomes(t: Tables) -> DataFrame:
    status = col("o_orderstatus")
    outcome = (
        F.when(status == "F", "stored").when(status == "P", "skipped")
        .when(col("o_totalprice") > 250000, "store_failed").otherwise("index_failed")
    )
    return t.orders.select(
        "o_orderpriority", outcome.alias("outcome"), col("o_orderkey").alias("candidate_id"),
        col("o_orderdate").alias("at"), ((status == "F") & (col("o_totalprice") < 100000)).alias("is_new"),
    )


@query("latest_outcomes", """
SELECT o_orderkey AS candidate_id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""")
def latest_outcomes(t: Tables) -> DataFrame:
    return incremental.latest_outcomes(_outcomes(t), "stored").select("candidate_id")


# --------------------------------------------------------------------- sinks


@query("replace_by_key", f"""
WITH {CLASS_DEFS}
SELECT artifact_id, class_name FROM class_defs WHERE artifact_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)
UNION ALL SELECT p_partkey, 'new/' || p_name FROM part WHERE p_size > 45""")
def replace_by_key(t: Tables) -> DataFrame:
    replaced = t.part.where("p_size > 40").select(col("p_partkey").alias("artifact_id"))
    new = t.part.where("p_size > 45").select(
        col("p_partkey").alias("artifact_id"), F.concat(lit("new/"), "p_name").alias("class_name")
    )
    return tables.replace_by_key(class_defs(t), new, replaced, "artifact_id")


@query("replace_in_buckets", f"""
WITH {CLASS_DEFS}
SELECT artifact_id, class_name FROM class_defs WHERE artifact_id NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')
UNION ALL SELECT p_partkey, 'new/' || p_name FROM part WHERE p_type = 'PROMO' AND p_size > 45""")
def replace_in_buckets(t: Tables) -> DataFrame:
    """The same change on a stored table: lay out, replace, read back."""
    path = new_path(t.spark, "class-defs")
    tables.write_buckets(class_defs(t), path, "artifact_id", 8)
    replaced = t.part.where("p_type = 'PROMO'").select(col("p_partkey").alias("artifact_id"))
    new = t.part.where("p_type = 'PROMO' and p_size > 45").select(
        col("p_partkey").alias("artifact_id"), F.concat(lit("new/"), "p_name").alias("class_name")
    )
    tables.replace_in_buckets(new, replaced, path, "artifact_id", 8)
    return t.spark.read.parquet(path).select("artifact_id", "class_name")


@query("replace_generations", f"""
WITH {CLASS_DEFS},
first AS (
  SELECT artifact_id, class_name FROM class_defs WHERE artifact_id NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')
  UNION ALL SELECT p_partkey, 'new/' || p_name FROM part WHERE p_type = 'PROMO' AND p_size > 45)
SELECT artifact_id, class_name FROM first WHERE artifact_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 30)
UNION ALL SELECT p_partkey, 'newer/' || p_name FROM part WHERE p_size > 30 AND p_type <> 'SMALL'""")
def replace_generations(t: Tables) -> DataFrame:
    """Two replacements on a stored table, each published as a whole, then compacted."""
    path, target = new_path(t.spark, "class-defs"), new_path(t.spark, "compacted")
    generations.create(class_defs(t), path, "artifact_id")
    for label, replaced, kept in (("new/", "p_type = 'PROMO'", "p_size > 45"), ("newer/", "p_size > 30", "p_type <> 'SMALL'")):
        parts = t.part.where(replaced)
        rows = parts.where(kept).select(col("p_partkey").alias("artifact_id"), F.concat(lit(label), "p_name").alias("class_name"))
        generations.replace(rows, parts.select(col("p_partkey").alias("artifact_id")), path, "artifact_id")
    schema = class_defs(t).schema
    generations.compact(t.spark, path, schema, "artifact_id", target)
    return generations.read(t.spark, target, schema, "artifact_id")


@query("cascade_delete", f"""
WITH {CLASS_DEFS}, gone AS (SELECT p_partkey FROM part WHERE p_type = 'PROMO')
SELECT 'class_defs' AS table_name, artifact_id, count(*) AS rows FROM class_defs WHERE artifact_id NOT IN (FROM gone) GROUP BY ALL
UNION ALL
SELECT 'method_references', l_partkey, count(*) FROM lineitem WHERE l_partkey NOT IN (FROM gone) GROUP BY ALL""")
def cascade_delete(t: Tables) -> DataFrame:
    facts = {
        "class_defs": class_defs(t),
        "method_references": t.lineitem.select(col("l_partkey").alias("artifact_id"), "l_returnflag"),
    }
    deleted = t.part.where("p_type = 'PROMO'").select(col("p_partkey").alias("artifact_id"))
    left = tables.cascade_delete(facts, deleted)
    count = lambda n, df: df.groupBy(lit(n).alias("table_name"), "artifact_id").agg(F.count(lit(1)).alias("rows"))
    return reduce(DataFrame.union, [count(n, df) for n, df in left.items()])


@query("insert_if_absent", """
WITH current AS (SELECT c_custkey AS file_id, 0::BIGINT AS latest FROM customer WHERE c_acctbal > 0),
fresh AS (SELECT o_custkey AS file_id, arg_min(epoch_us(o_orderdate), o_orderkey) AS latest FROM orders GROUP BY 1)
SELECT * FROM current UNION ALL SELECT * FROM fresh WHERE file_id NOT IN (SELECT file_id FROM current)""")
def insert_if_absent(t: Tables) -> DataFrame:
    current = t.customer.where("c_acctbal > 0").select(col("c_custkey").alias("file_id"), lit(0).cast("bigint").alias("latest"))
    fresh = t.orders.select(
        col("o_custkey").alias("file_id"), F.unix_micros(col("o_orderdate").cast("timestamp")).alias("latest"), "o_orderkey"
    )
    return tables.insert_if_absent(current, fresh, ["file_id"], col("o_orderkey"))


@query("upsert_metadata", f"""
WITH {ARTIFACTS},
fresh AS (SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS license,
                 CASE WHEN s_acctbal > 0 THEN 's:' || s_suppkey END AS coordinates FROM supplier)
SELECT a.id, a.version, CASE WHEN f.id IS NULL THEN a.name ELSE f.name END AS name,
       CASE WHEN f.id IS NULL THEN a.license ELSE f.license END AS license,
       coalesce(f.coordinates, a.coordinates) AS coordinates
FROM artifacts a LEFT JOIN fresh f USING (id)""")
def upsert_metadata(t: Tables) -> DataFrame:
    fresh = t.supplier.select(
        col("s_suppkey").alias("id"), col("s_name").alias("name"), lit(None).cast("string").alias("license"),
        F.when(col("s_acctbal") > 0, F.concat(lit("s:"), text("s_suppkey"))).alias("coordinates"),
    )
    current = artifacts(t).select("id", "version", "name", "license", "coordinates")
    return tables.upsert_metadata(current, fresh)


@query("append_artifacts", f"""
WITH {ARTIFACTS}
SELECT id, name, version, loader FROM artifacts
UNION ALL SELECT s_suppkey + 100000000, s_name, '1.0', true FROM supplier""")
def append_artifacts(t: Tables) -> DataFrame:
    new = t.supplier.select(
        (col("s_suppkey") + 100000000).alias("id"), col("s_name").alias("name"), lit("1.0").alias("version")
    )
    current = artifacts(t).select("id", "name", "version", "loader")
    return tables.append_artifacts(current, new, loader=True)


# ------------------------------------------------------------------ metadata


@query("metadata_projection", """
SELECT p_partkey AS id,
       CASE WHEN p_type = 'PROMO' THEN '2.' || p_size WHEN p_type = 'SMALL' THEN '0.0NONE'
            WHEN p_size > 25 THEN 'v' || p_size WHEN p_size > 10 THEN 'fb' || p_size ELSE '0.0NONE' END AS version,
       CASE WHEN p_type = 'LARGE' THEN lower(p_brand) ELSE p_name END AS name,
       lower(p_brand) || ', second' AS ids,
       CASE WHEN p_size % 2 = 0 THEN p_brand || ', other; me' ELSE 'me' END AS authors, p_type AS license, NULL::VARCHAR AS coordinates
FROM part""")
def metadata_projection(t: Tables) -> DataFrame:
    size, kind = text("p_size"), col("p_type")
    version = (
        F.when(kind == "PROMO", F.concat(lit(',"version":"2.'), size, lit('"'))).when(kind == "SMALL", "")
        .otherwise(',"version":"${file.jarVersion}"')
    )
    descriptor = F.concat(
        lit('{"license":"'), kind, lit('","mods":[{"modId":"'), F.lower("p_brand"), lit('"'), version,
        F.when(kind == "LARGE", "").otherwise(F.concat(lit(',"displayName":"'), "p_name", lit('"'))),
        F.when(col("p_size") % 2 == 0, F.concat(lit(',"authors":"'), "p_brand", lit(', other"'))).otherwise(""),
        lit('},{"modId":"second","authors":"me"}]}'),
    )
    manifest = F.when(col("p_size") > 25, F.concat(lit('{"":{"Implementation-Version":"v'), size, lit('"}}'))).otherwise('{"":{}}')
    rows = t.part.select(
        col("p_partkey").alias("id"), descriptor.alias("descriptor"), manifest.alias("manifest"),
        F.when(col("p_size") > 10, F.concat(lit("fb"), size)).alias("fallback_version"),
        lit(None).cast("string").alias("coordinates"), lit(None).cast("string").alias("library_name"),
    )
    return metadata.project_metadata(rows).withColumn("ids", F.array_join("ids", ", "))


@query("flat_descriptor", """
SELECT p_partkey AS id,
       '{"license":"' || CASE WHEN p_size > 25 THEN p_type || ', MIT' ELSE p_type END || '","mods":[{"authors":"' || p_brand || ', me","displayName":"'
       || p_name || '","modId":"m' || p_partkey || '","version":"1.' || p_size || '"}]}' AS descriptor FROM part""")
def flat_descriptor(t: Tables) -> DataFrame:
    content = F.concat(
        lit('{"id":"m'), text("p_partkey"), lit('","version":"1.'), text("p_size"), lit('","name":"'), "p_name",
        lit('","authors":[{"name":"'), "p_brand", lit('"},"me"],"license":'),
        F.when(col("p_size") > 25, F.concat(lit('["'), "p_type", lit('","MIT"]'))).otherwise(F.concat(lit('"'), "p_type", lit('"'))),
        lit("}"),
    )
    return t.part.select(
        col("p_partkey").alias("id"), canonical_json(metadata.from_flat_descriptor(content)).alias("descriptor")
    )


# ------------------------------------------------------------------ archives


@F.pandas_udf(T.BinaryType())
def zipped(html: pd.Series, url: pd.Series) -> pd.Series:
    """An archive per page: the page, and a listed inner archive with its address."""
    def pack(members: dict) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for path, content in members.items():
                z.writestr(zipfile.ZipInfo(path), content)
        return out.getvalue()

    listed = json.dumps({"jars": [
        {"identifier": {"group": "g", "artifact": "inner"}, "version": {"artifactVersion": "1"}, "path": "lib/inner.jar"},
        {"identifier": {"group": "g", "artifact": "lost"}, "version": {"artifactVersion": "1"}, "path": "lib/lost.jar"},
    ]})
    return pd.Series([
        pack({"page.html": h, archives.LIST_BY_COORDINATE: listed, "lib/inner.jar": pack({"url.txt": u})})
        for h, u in zip(html, url)
    ])


@query("archive_scan", """
SELECT page_id::VARCHAR AS archive, '' AS container, 0 AS depth, NULL::VARCHAR AS id, 'page.html' AS path, sha1(html) AS sha1 FROM pages
UNION ALL SELECT page_id::VARCHAR, '!lib/inner.jar', 1, 'g:inner', 'url.txt', sha1(url) FROM pages
UNION ALL SELECT page_id::VARCHAR, '', 0, NULL, 'lib/inner.jar', NULL FROM pages
UNION ALL SELECT page_id::VARCHAR, '', 0, NULL, 'META-INF/jarjar/metadata.json', NULL FROM pages""")
def archive_scan(t: Tables) -> DataFrame:
    made = t.pages.select(text("page_id").alias("path"), zipped("html", "url").alias("content"))
    text_file = F.rlike("path", lit(r"\.(html|txt)$"))
    return archives.scan_archives(made).select(
        "archive", "container", "depth", "id", "path", F.when(text_file, F.sha1("content")).alias("sha1")
    )


@F.pandas_udf(T.BinaryType())
def described(page: pd.Series, url: pd.Series, html: pd.Series) -> pd.Series:
    """An archive per page: a descriptor that names one of two extension files, a tag file, a
    contained library with the page in it, and a contained archive that is no artifact."""

    def pack(members: dict) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for path, content in members.items():
                z.writestr(zipfile.ZipInfo(path), content)
        return out.getvalue()

    listed = lambda *names: json.dumps({"jars": [
        {"identifier": {"group": "g", "artifact": n}, "version": {"artifactVersion": "1.5"}, "path": f"lib/{n}.jar"} for n in names]})

    def archive(n: int, address: str | None, content: str | None) -> bytes:
        library = pack({"META-INF/MANIFEST.MF": f"FMLModType: LIBRARY\r\nImplementation-Version: {n}\r\n", "data/page.json": content or ""})
        plain = pack({"readme.txt": "", "lib/library.jar": library, archives.LIST_BY_COORDINATE: listed("library")})
        toml = f"license = 'MIT'\n[[mods]]\nmodId = 'm{n}'\nversion = '${{file.jarVersion}}'\nenumExtensions = 'ext/{n % 2}.json'\n"
        entry = lambda name: json.dumps({"entries": [{"enum": "E", "name": name, "constructor": "()V", "parameters": [n]}]})
        return pack({
            "META-INF/mods.toml": toml if n % 5 else "[[mods", "META-INF/MANIFEST.MF": f"Implementation-Version: {n}.1\r\n",
            archives.LIST_BY_COORDINATE: listed("plain", "library", "lost"), "lib/plain.jar": plain, "lib/library.jar": library,
            "ext/0.json": entry("even"), "ext/1.json": entry("odd"), "data/n/tags/pages.json": json.dumps({"values": [(address or "").split("/")[2]]}),
        })

    return pd.Series([archive(*row) for row in zip(page, url, html)])


@query("archive_describe", """
WITH a AS (SELECT page_id::VARCHAR AS archive, page_id AS n, split_part(url, '/', 3) AS host FROM pages WHERE page_id % 5 <> 0)
SELECT 'artifact' AS kind, archive, '' AS container, 'm' || n AS name, n || '.1' AS version,
       '[{"id":"g:library","version":"1.5"}]' AS detail FROM a
UNION ALL SELECT 'artifact', archive, '!lib/library.jar', 'g:library', n::VARCHAR, NULL FROM a
UNION ALL SELECT 'extension', archive, '', CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END, NULL, '[' || n || ']' FROM a
UNION ALL SELECT 'tag', archive, '', 'n/pages', NULL, 'minecraft:' || host FROM a""")
def archive_describe(t: Tables) -> DataFrame:
    """Artifacts, extension entries and tags of archives; files no descriptor names and archives in others that are no artifact do not count."""
    made = t.pages.select(text("page_id").alias("path"), described("page_id", "url", "html").alias("content"))
    scanned = materialize(loaders.scan(made, loaders.TOML_LOADER), "scanned")
    nothing = lit(None).cast("string")
    keyed = lambda kind: loaders.files(scanned, kind).withColumnRenamed("archive", "artifact_id")
    found = loaders.artifacts(scanned, loaders.TOML_LOADER).join(
        loaders.nested_trees(scanned).withColumn("container", lit("")), ["archive", "container"], "left"
    )
    whole = found.select(lit("artifact").alias("kind"), "archive", "container", "name", "version", col("nested_tree").alias("detail"))
    extensions = datafiles.extension_entries(keyed("extension")).select(
        lit("extension").alias("kind"), col("artifact_id").alias("archive"), lit("").alias("container"), "name", nothing.alias("version"), col("parameters").alias("detail")
    )
    tags = datafiles.tag_entries(keyed("data")).select(
        lit("tag").alias("kind"), col("artifact_id").alias("archive"), lit("").alias("container"), col("tag").alias("name"), nothing.alias("version"), col("entry").alias("detail")
    )
    return whole.union(extensions).union(tags)


# The hash is a chain over four-byte words; 1540483477 is its multiplier.
MURMUR = """
WITH bare AS (SELECT doc_id, hex(encode(regexp_replace(text, '[\t\n\r ]', '', 'g'))) AS x FROM documents),
cut AS (
  SELECT doc_id, x, length(x) // 2 AS n,
         [('0x' || x[i + 6:i + 7] || x[i + 4:i + 5] || x[i + 2:i + 3] || x[i:i + 1])::UBIGINT FOR i IN range(1, length(x) - 6, 8)] AS words,
         x[(length(x) // 8) * 8 + 1:] AS t
  FROM bare),
mixed AS (
  SELECT doc_id, n, t,
         list_reduce(list_prepend(xor(1::UBIGINT, n::UBIGINT), list_transform(words, lambda w: (xor((w * 1540483477) & 4294967295, ((w * 1540483477) & 4294967295) >> 24) * 1540483477) & 4294967295)),
                     lambda h, w: xor((h * 1540483477) & 4294967295, w)) AS h
  FROM cut),
tailed AS (
  SELECT doc_id, n, CASE WHEN t = '' THEN h ELSE (xor(h, ('0x' || t[5:6] || t[3:4] || t[1:2])::UBIGINT) * 1540483477) & 4294967295 END AS h FROM mixed),
final AS (SELECT doc_id, n, (xor(h, h >> 13) * 1540483477) & 4294967295 AS h FROM tailed)
SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE xor(h, h >> 15) END::BIGINT AS fingerprint FROM final"""


@query("content_fingerprints", MURMUR)
def content_fingerprints(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", content_fingerprint(col("text").cast("binary")).alias("fingerprint"))


# ------------------------------------------------------------------ backfills


@query("backfill_metadata", """
SELECT p_partkey AS id, CASE WHEN p_size < 48 THEN p_type END AS license, CASE WHEN p_size < 48 THEN p_name END AS name,
       p_size < 48 AS valid FROM part""")
def backfill_metadata(t: Tables) -> DataFrame:
    toml = F.concat(
        lit('modLoader = "x" # comment\nlicense = "'), "p_type", lit('"\n[[mods]]\nmodId = "m'), text("p_partkey"),
        lit("\"\ndisplayName = '"), "p_name", F.when(col("p_size") < 48, "'\n").otherwise("\n"),
    )
    done = backfill.backfill_metadata(t.part.select(col("p_partkey").alias("id"), toml.alias("metadata")))
    out = col("metadata_json")
    return done.select(
        "id", json_text(out, "$.license").alias("license"), json_text(out, "$.mods[0].displayName").alias("name"),
        out.isNotNull().alias("valid"),
    )


@query("backfill_tree", """
SELECT p_partkey AS id,
  CASE WHEN p_size = 1 THEN NULL WHEN p_size < 20 THEN '[{"id":"g:' || replace(p_name, ' ', '') || '"}]'
  ELSE '[{"id":"g:a","nested":[{"id":"g:' || p_brand || '"},{"id":"g:c","nested":[{"id":"g:' || p_partkey || '"}]}]},{"id":"g:e"}]' END AS nested_tree
FROM part""")
def backfill_tree(t: Tables) -> DataFrame:
    tree = (
        F.when(col("p_size") == 1, "").when(col("p_size") < 20, F.concat(lit("g:"), "p_name"))
        .otherwise(F.concat(lit("g:a (g:"), "p_brand", lit(", g:c (g:"), text("p_partkey"), lit(")), g:e")))
    )
    return backfill.backfill_tree(t.part.select(col("p_partkey").alias("id"), tree.alias("nested_tree")))


@query("backfill_annotations", """
WITH v AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events),
j AS (SELECT event_id, '{"a":{"_$tp":"p/T","x":true},"c":"p/' || event_type || '","e":{"enum":"p/E","value":"V' || k || '"},"l":[' || k || ',"q,r"],"n":' || k || '}' AS value FROM v),
d AS (SELECT value, dense_rank() OVER (ORDER BY value) AS id FROM (SELECT DISTINCT value FROM j))
SELECT event_id, d.id AS value, j.value AS json FROM j JOIN d USING (value)""")
def backfill_annotations(t: Tables) -> DataFrame:
    """Texts become a dictionary, each is parsed once, and facts get the ids of JSON values."""
    from ..operators import dictionary

    k = json_text(col("props"), "$.k")
    stored = F.concat(
        lit("n="), k, lit(', l=["'), lit('q,r"], e=p/E:V'), k, lit(", c=p/"), "event_type", lit(".class, a=@p/T(x=true)")
    )
    stored = F.replace(stored, lit('l=["q'), F.concat(lit("l=["), k, lit(', "q')))
    events = t.events.select("event_id", stored.alias("constant"))
    constants = dictionary.build(events, ["constant"])
    facts = events.join(constants, "constant").select("event_id", col("id").alias("value"))
    converted = backfill.convert_annotations(constants)
    values = dictionary.build(converted, ["value"])
    rewritten = backfill.rewrite_values(facts, converted, values)
    return rewritten.join(values.select(col("id").alias("value"), col("value").alias("json")), "value").select(
        "event_id", "value", "json"
    )


# ------------------------------------------------------------------ streaming


@query("stream_ingest", """
SELECT o_orderkey AS artifact_id, o_orderstatus AS class_name FROM orders""")
def stream_ingest(t: Tables) -> DataFrame:
    """Landing files through a stream into a stored table, then a second run that
    finds nothing new."""
    landing = f"{t.directory}/order[s].parquet"
    path, checkpoint = new_path(t.spark, "streamed"), new_path(t.spark, "stream-state")
    schema = t.orders.schema
    shape = lambda df: df.select(col("o_orderkey").alias("artifact_id"), col("o_orderstatus").alias("class_name"))
    empty = shape(t.orders.where("false"))
    generations.create(empty, path, "artifact_id")

    def apply(batch: DataFrame, _: int) -> None:
        rows = shape(batch)
        generations.replace(rows, rows.select("artifact_id"), path, "artifact_id")

    for _ in range(2):
        ingest(t.spark, landing, schema, apply, checkpoint).awaitTermination()
    return generations.read(t.spark, path, empty.schema, "artifact_id")
