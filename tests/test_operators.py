"""Unusual semantics of single operators, on small hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from usagelens.operators import backfill, clean, closure, dictionary, flatten, incremental, listing, lookups, nested, remap, resolve
from usagelens.operators.filters import Filter
from usagelens.schemas import CLASS_RECORD
from usagelens.functions.jsonvalues import canonical_json
from usagelens.sinks import generations, tables
from usagelens.sources import archives, catalogue, datafiles, describe, landing, loaders, metadata

# ------------------------------------------------------------------------ listing

ARTIFACT = "id long, version string, name string, ids array<string>, license string, loader boolean, authors string, nested_tree string, metadata_json string, coordinates string, int_project_id int, text_project_id string"


def artifact(id, name="n", ids=("x",), loader=False, tree=None, int_id=None, text_id=None, **kw):
    base = dict(version="1", license=None, authors=None, metadata_json=None, coordinates=None) | kw
    return (id, base["version"], name, list(ids), base["license"], loader, base["authors"], tree,
            base["metadata_json"], base["coordinates"], int_id, text_id)


def test_listing_blank_name_project_key_and_empty_ids(spark, rows):
    df = spark.createDataFrame([
        artifact(1, name="", ids=[], int_id=5, text_id="t"), artifact(2, name="b", text_id="u", metadata_json='{"modLoader":"x"}'),
        artifact(3, loader=True),
    ], ARTIFACT)
    assert rows(listing.list_artifacts(df), "artifact_name", "identifiers", "language_loader", "pid") == [
        ("Unknown", "", None, "5"), ("b", "x", "x", "u"),
    ]
    differs = [Filter(listing.IDENTIFIER, "!=", "zzz")]
    assert rows(listing.list_artifacts(df, differs), "artifact_name") == [("b",)]  # null on an empty array


def test_filters_or_within_a_key_and_between_keys(spark, rows):
    df = spark.createDataFrame([
        artifact(i, ids=[x], license=y) for i, (x, y) in enumerate([("a", "p"), ("b", "p"), ("c", "q"), ("a", None)])
    ], ARTIFACT)
    keep = lambda *fs: [r[0] for r in rows(listing.select_artifacts(df, fs), "id")]
    f = Filter
    assert keep(f(listing.IDENTIFIER, "=", "a"), f(listing.IDENTIFIER, "=", "b"), f(listing.LICENSE, "=~", "p")) == [0, 1]
    assert keep(f(listing.IDENTIFIER, "??", "a"), f(listing.LICENSE, "!~", "p")) == [2]  # unknown operator accepts
    assert keep(f("no such key", "=", "a")) == [0, 1, 2, 3]
    assert keep(f(listing.LICENSE, "=", "x' or 'a'='a")) == []


def test_class_filter_collapses_equal_display_rows_only_then(spark, rows):
    df = spark.createDataFrame([artifact(1), artifact(2), artifact(3, name="m")], ARTIFACT)
    defs = spark.createDataFrame([(1, "p/A"), (1, "p/AB"), (2, "p/A"), (3, "q")], "artifact_id long, class_name string")
    assert len(rows(listing.list_artifacts(df))) == 3
    got = listing.list_artifacts(df, [Filter(listing.CLASS_NAME, "=~", "A")], class_defs=defs)
    assert rows(got, "artifact_name") == [("n",)]


def test_pack_filter_takes_the_first_and_empty_pack_keeps_nothing(spark, rows):
    df = spark.createDataFrame([artifact(1, int_id=1), artifact(2, int_id=2)], ARTIFACT)
    packs = spark.createDataFrame([("p", 1), ("q", 2)], "pack_id string, int_project_id int")
    two = [Filter(listing.IN_PACK, "=", "p"), Filter(listing.IN_PACK, "=", "q")]
    assert rows(listing.select_artifacts(df, two, packs=packs), "id") == [(1,)]
    assert rows(listing.select_artifacts(df, [Filter(listing.IN_PACK, "=", "none")], packs=packs)) == []


def test_contained_differs_means_some_id_differs(spark, rows):
    df = spark.createDataFrame([
        artifact(1, tree='[{"id":"a"}]'), artifact(2, tree='[{"id":"a","nested":[{"id":"b"}]}]'), artifact(3),
    ], ARTIFACT)
    pick = lambda op, v: rows(nested.containing(df, [Filter(listing.CONTAINED, op, v)]), "id")
    assert pick("!=", "a") == [(2,)] and pick("=", "a") == [(1,), (2,)] and pick("!~", "[ab]") == []


def test_project_id_dispatch(spark, rows):
    df = spark.createDataFrame([artifact(1, int_id=12), artifact(2, text_id="12"), artifact(3, text_id="ab")], ARTIFACT)
    defs = spark.createDataFrame([(i, f"c{i}") for i in (1, 2, 3)], "artifact_id long, class_name string")
    ask = spark.createDataFrame([("12",), ("ab",), ("99999999999",)], "pid string")
    assert rows(listing.classes_of(ask, df, defs)) == [("12", "c1"), ("ab", "c3")]


def test_duplicate_names_ordered(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "c"), (5, "a"), (6, None), (7, None)], "id long, name string")
    assert [r.id for r in lookups.duplicate_names(df).collect()] == [2, 5, 1, 3]


def test_changed_versions_compares_text(spark, rows):
    df = spark.createDataFrame([artifact(1, loader=True, coordinates="a", version="1.0"), artifact(2, coordinates="b")], ARTIFACT)
    latest = spark.createDataFrame([("a", "1.0"), ("a2", "1"), ("b", "1")], "coordinates string, latest_version string")
    assert rows(lookups.changed_versions(latest, df), "coordinates") == [("a2",), ("b",)]
    newer = spark.createDataFrame([("a", "1")], "coordinates string, latest_version string")
    assert rows(lookups.changed_versions(newer, df), "coordinates") == [("a",)]


# ------------------------------------------------------------------------ closure

EDGES = [(1, 2), (2, 3), (3, 1), (4, 5)]


@pytest.mark.parametrize("root, expected", [(1, [1, 2, 3]), (4, [5]), (9, [])])
def test_descendants_on_cycles(spark, rows, root, expected):
    edges = spark.createDataFrame(EDGES, "parent int, child int")
    got = closure.descendants(edges, spark.createDataFrame([(root,)], "root int"))
    assert rows(got, "node") == [(n,) for n in expected]


def test_descendants_of_a_long_chain(spark):
    edges = spark.range(40).selectExpr("id as parent", "id + 1 as child")
    root = spark.createDataFrame([(0,)], "root long")
    assert closure.descendants(edges, root).count() == 40


def test_closure_of_null_ends_repeats_and_nothing(spark, rows):
    edges = spark.createDataFrame([(1, 2), (1, 2), (None, 3), (2, None)], "parent int, child int")
    roots = spark.createDataFrame([(1,), (1,), (None,)], "root int")
    assert rows(closure.descendants(edges, roots), "root", "node") == [(1, 2)]
    assert closure.descendants(edges.where("false"), roots).count() == 0
    assert closure.descendants(edges, roots.where("false")).count() == 0


def test_descendants_of_a_hub_with_most_edges(spark):
    hub = spark.range(1, 20001).selectExpr("0 as parent", "id as child")
    tail = spark.range(1, 20001).selectExpr("id as parent", "id + 100000 as child")
    roots = spark.createDataFrame([(0,), (5,)], "root int")
    got = closure.descendants(hub.union(tail), roots).groupBy("root").count().collect()
    assert {r[0]: r[1] for r in got} == {0: 40000, 5: 1}


@pytest.mark.parametrize("bound", [closure.BOUND, 1, 3])
def test_closure_of_random_graphs_equals_brute_force(spark, rows, bound):
    """Small bounds deal edges to slices and frontier rows to salts."""
    import random
    rng = random.Random(3)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    below = {n: {c for p, c in pairs if p == n} for n in range(30)}
    while True:
        wider = {n: s | {x for m in s for x in below[m]} for n, s in below.items()}
        if wider == below:
            break
        below = wider
    edges = spark.createDataFrame(sorted(pairs), "parent int, child int")
    roots = spark.range(30).selectExpr("cast(id as int) as root")
    assert rows(closure.descendants(edges, roots, bound), "root", "node") == sorted(
        ((n, x) for n, s in below.items() for x in s), key=repr
    )


def test_parents_without_definition_are_no_descendants(spark, rows):
    defs = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "def_id int, class_name string")
    parents = spark.createDataFrame([(1, "Root"), (2, "A"), (3, "Root")], "def_id int, parent string")
    edges = closure.inheritance_edges(defs, parents)
    assert rows(edges) == [("A", "B"), ("Root", "A")]
    names = spark.createDataFrame([("Root",), ("Nope",)], "name string")
    classes = spark.createDataFrame([("Root", "Root"), ("A", "A")], "root string, name string")
    assert rows(closure.descendants_by_name(edges, classes, names), "name", "node") == [("Root", "A"), ("Root", "B")]


def test_overriding_members(spark, rows):
    edges = spark.createDataFrame([("A", "B"), ("B", "C")], "parent string, child string")
    members = spark.createDataFrame([
        (1, "A", "run", "()V"), (2, "A", "stop", "()V"), (3, "B", "run", "()I"), (4, "C", "run", "()V"), (5, "D", "run", "()V"),
    ], "id int, cls string, name string, descriptor string")
    root = spark.createDataFrame([("A",)], "root string")
    assert rows(closure.overriding_members(members, edges, root), "id") == [(1,), (2,), (4,)]
    assert rows(closure.overriding_members(members, edges, root, "st"), "id") == [(2,)]


# ------------------------------------------------------------------ nested archives

def test_newest_version_stays_earliest_on_a_tie_and_losers_are_visited(spark, rows):
    trees = spark.createDataFrame([
        (0, '[{"id":"a","version":"1.0","sha1":"s0","nested":[{"id":"only","version":"1"}]}]'),
        (1, '[{"id":"a","version":"1.10","sha1":"s1"},{"id":"b","version":"1","sha1":"s2"}]'),
        (2, '[{"id":"b","version":"1.0","sha1":"s3"},{"id":"a","version":"1.9","sha1":"s4"}]'),
        (3, None), (4, "[]"),
    ], "position int, nested_tree string")
    assert rows(nested.expand_nested(trees), "id", "sha1") == [("a", "s1"), ("b", "s2"), ("only", None)]


def test_flatten_then_build_gives_the_tree(spark, rows):
    tree = '[{"id":"g:a","version":"1","nested":[{"id":"g:b","version":"2"},{"id":"g:\\"c","version":"3","nested":[{"id":"d","version":"4"}]}]},{"id":"e","version":"5"}]'
    trees = spark.createDataFrame([("r", tree), ("s", '[{"id":"x","version":"1"}]'), ("t", None)], "root string, nested_tree string")
    path = F.col("path").cast("array<string>")
    name = lambda p: F.concat_ws("/", F.col("root"), p)
    edges = nested.flatten_tree(trees, ["root"]).select(
        F.when(F.col("depth") == 0, F.col("root")).otherwise(name(F.slice(path, 1, F.col("depth")))).alias("parent"),
        name(path).alias("child"), F.element_at("path", -1).alias("position"), "id", "version", "depth",
    )
    assert rows(nested.build_nested(edges, 2)) == rows(trees.where("nested_tree is not null"))


# --------------------------------------------------------------------- dictionaries

def test_ids_are_dense_stable_and_repeatable(spark, rows):
    first = dictionary.build(spark.range(1000).selectExpr("concat('v', id % 300) as v"), ["v"])
    assert rows(first, "id") == sorted([(i,) for i in range(1, 301)], key=repr)
    assert [r.v for r in first.orderBy("id").collect()] == sorted(f"v{i}" for i in range(300))
    more = spark.createDataFrame([("a",), ("v5",), ("z",), ("a",)], "v string")
    second = dictionary.extend(first, more, ["v"])
    assert rows(second.where("id > 300")) == [(301, "a"), (302, "z")]
    assert rows(dictionary.extend(second, more, ["v"])) == rows(second)
    assert second.join(first, ["id", "v"]).count() == 300


# ---------------------------------------------------------------- records and cleaning

def record(artifact, name, super_="java/lang/Object", interfaces=(), fields=(), methods=(), mrefs=(), frefs=(), position=0, annotations=()):
    member = lambda m: (m[0], m[1], m[2], [] if len(m) < 4 else m[3] if isinstance(m[3], list) else [("x/A", "{}")])
    return (artifact, position, name, super_, list(interfaces), list(annotations), [member(f) for f in fields],
            [member(m) for m in methods], list(mrefs), list(frefs))


def test_flatten_null_super_and_count_overflow(spark, rows):
    df = spark.createDataFrame([
        record(1, "A", None, ["i/I"], annotations=[("x/M", '{"b":1.0,"a":2}')]),
        record(1, "B", "A", mrefs=[("A", "m", "()V", 40000)]),
    ], CLASS_RECORD)
    facts = flatten.flatten_records(df)
    assert set(facts) == {"class_defs", "class_parents", "field_defs", "method_defs", "class_annotations",
                          "field_annotations", "method_annotations", "method_references", "field_references"}
    assert rows(facts["class_parents"], "class_name", "parent") == [("A", "i/I"), ("B", "A")]
    assert rows(facts["class_annotations"], "value") == [('{"a":2,"b":1}',)]
    assert rows(facts["method_references"], "count") == [(40000,)]
    with pytest.raises(ArithmeticException):
        flatten.flatten_records(df, strict_smallint=True)["method_references"].collect()


def test_broken_keys_reports_double_parents(spark, rows):
    df = spark.createDataFrame([record(1, "A", "P", ["P"], methods=[("m", "()V", 1), ("m", "()V", 1)])], CLASS_RECORD)
    assert rows(flatten.broken_keys(flatten.flatten_records(df)), "table", "copies") == [("class_parents", 2), ("method_defs", 2)]


def test_private_lambda_and_anonymous_rules(spark, rows):
    df = spark.createDataFrame([
        record(1, n, fields=[("pub", "I", 1), ("priv", "I", 2), ("pkg", "I", 0, "annotated")], methods=[("lambda$x$0", "()V", 10), ("m", "()V", 4)])
        for n in ("A$1", "A$B1", "A$12", "A1", "12", "A$١")
    ], CLASS_RECORD)
    assert rows(clean.drop_anonymous(df), "name") == [("12",), ("A$B1",), ("A1",)]
    one = df.where("name = 'A1'")
    assert rows(flatten.member_defs(clean.drop_private(one), "fields"), "name") == [("pkg",), ("pub",)]
    assert rows(flatten.member_defs(clean.drop_lambdas(one), "methods"), "name") == [("m",)]


def test_own_references_are_judged_on_uncleaned_records(spark, rows):
    calls = [("Raw", "pub", "()V", 1), ("Sub", "pub", "()V", 1), ("Sub", "stat", "()V", 1), ("Sub", "priv", "()V", 1),
             ("Sub", "pub", "()I", 1), ("Else", "x", "()V", 1)]
    members = [("pub", "()V", 1), ("stat", "()V", 9), ("priv", "()V", 2)]
    df = spark.createDataFrame([
        record(1, "Raw", methods=members, mrefs=calls), record(1, "Sub", "Raw", methods=members, fields=[("f", "I", 2)], frefs=[("Sub", "f", "J", 1)]),
        record(2, "Other", mrefs=[("Sub", "stat", "()V", 1)]),
    ], CLASS_RECORD)
    facts = clean.clean_artifact(df)
    assert rows(facts["method_references"], "artifact_id", "owner", "name", "descriptor") == [
        (1, "Else", "x", "()V"), (1, "Sub", "pub", "()I"), (1, "Sub", "pub", "()V"), (2, "Sub", "stat", "()V"),
    ]
    assert rows(facts["field_references"]) == []  # fields are found by name alone
    assert rows(facts["method_defs"].where("class_name = 'Sub'"), "name") == [("pub",), ("stat",)]


def test_later_record_of_a_class_decides(spark, rows):
    df = spark.createDataFrame([
        record(1, "S", "P", methods=[("m", "()V", 9)], position=0), record(1, "S", "P", methods=[("m", "()V", 1)], position=1),
        record(1, "C", "P", mrefs=[("S", "m", "()V", 1)], position=2),
    ], CLASS_RECORD)
    assert rows(clean.clean_artifact(df)["method_references"], "name") == [("m",)]
    assert rows(landing.latest_by_name(df), "name", "position") == [("C", 2), ("S", 1)]


def test_loader_rules_skip_references_and_annotations(spark):
    df = spark.createDataFrame([record(1, "A$1"), record(1, "A", methods=[("lambda$a", "()V", 1)])], CLASS_RECORD)
    facts = clean.clean_loader(df)
    assert set(facts) == {"class_defs", "class_parents", "field_defs", "method_defs"}
    assert facts["class_defs"].count() == 1 and facts["method_defs"].count() == 0


# -------------------------------------------------------------------------- remapping

def test_records_are_renamed_inside(spark):
    """Every place of a name, members and references that become one, and what stays."""
    mark = lambda kind: [(kind, "{}")]
    rec = record(
        1, "x/Own", "x/Up", interfaces=["x/Face"], annotations=mark("x/Mark"),
        fields=[("f_1", "x/A", 1, mark("[Lx/Mark;")), ("f_2", "[Lx/A;", 2, []), ("g", "I", 3, [])],
        methods=[("m_1", "(Lx/A;[Lx/Z;J)Lx/Own;", 1, []), ("m_2", "(Lx/A;[Lx/Z;J)Lx/Own;", 2, mark("x/Mark")), ("run", "()V", 4, [])],
        mrefs=[("x/A", "m_1", "(Lx/B;)V", 2), ("x/B", "m_2", "(Lx/A;)V", 5), ("w/L", "m_3", "()V", 1)], frefs=[("x/B", "f_9", "x/A", 1), ("x/A", "f_9", "x/B", 3)],
    )
    names = [("class", "x/A", "y/N$1"), ("class", "x/B", "y/N$1"), ("class", "x/Mark", "y/Mark"), ("class", "x/Up", "y/Up"), ("class", "x/Own", "y/Own"),
             ("class", "w/L", "y/L"), ("method", "m_1", "go"), ("method", "m_2", "go"), ("method", "run", "no"), ("field", "f_1", "x"), ("field", "f_2", "x"),
             ("field", "m_3", "no"), ("class", "x/Face", "y/Face")]
    mapping = spark.createDataFrame(names, "kind string, original string, mapped string")
    table = spark.createDataFrame([rec, record(1, "q/Other", methods=[("n", "()V", 1)])], CLASS_RECORD)
    got = {r["name"]: r.asDict(recursive=True) for r in remap.remap_records(table, mapping, class_prefix="x/").collect()}
    one = got["x/Own"]
    plain = lambda rows: sorted(tuple(r.values()) for r in rows)
    assert (one["super"], one["interfaces"], one["annotations"]) == ("x/Up", ["x/Face"], [{"type": "y/Mark", "members": "{}"}])
    assert plain(one["fields"]) == [("g", "I", 3, []), ("x", "[Ly/N$1;", 2, [])]
    assert plain(one["methods"]) == [("go", "(Ly/N$1;[Lx/Z;J)Ly/Own;", 2, [{"type": "y/Mark", "members": "{}"}]), ("run", "()V", 4, [])]
    assert plain(one["method_refs"]) == [("w/L", "m_3", "()V", 1), ("y/N$1", "go", "(Ly/N$1;)V", 7)]
    assert plain(one["field_refs"]) == [("y/N$1", "f_9", "y/N$1", 4)]
    assert got["q/Other"]["methods"] == [{"name": "n", "desc": "()V", "access": 1, "annotations": []}]
    whole = {r["name"]: r for r in remap.remap_records(table, mapping, class_prefix="x/", method_prefix=None, field_prefix=None, remap_parents=True).collect()}
    assert (whole["y/Own"]["super"], whole["y/Own"]["interfaces"]) == ("y/Up", ["y/Face"]) and whole["y/Own"]["fields"][0]["name"] == "f_1"
    # Without a class prefix neither classes nor descriptors change.
    members = {r["name"]: r for r in remap.remap_records(table, mapping).collect()}
    assert plain(m.asDict(recursive=True) for m in members["x/Own"]["field_refs"]) == [("x/A", "f_9", "x/B", 3), ("x/B", "f_9", "x/A", 1)]
    assert members["x/Own"]["methods"][0]["desc"] == "(Lx/A;[Lx/Z;J)Lx/Own;"
    assert remap.remap_records(table, mapping, None, None, None) is table


def test_remapping(spark, rows):
    mapping = spark.createDataFrame([("x/A", "y/A"), ("w/Z", "y/Z"), ("x/D$1", "y$1\\")], "original string, mapped string")
    df = spark.createDataFrame([("(Lx/A;I)Lx/B;",), ("(Lw/Z;)V",), ("I",), ("Lx/D$1;Lx/A;",), (None,)], "d string")
    assert rows(remap.remap_descriptors(df, "d", mapping, "x/")) == sorted(
        [("(Ly/A;I)Lx/B;",), ("(Lw/Z;)V",), ("I",), ("Ly$1\\;Ly/A;",), (None,)], key=repr)
    names = spark.createDataFrame([("x/A",), ("w/Z",), ("x/B",)], "d string")
    assert rows(remap.remap_names(names, "d", mapping, "x/")) == [("w/Z",), ("x/B",), ("y/A",)]
    assert remap.remap_names(names, "d", mapping, None) is names


def test_composed_mapping_keeps_the_last(spark, rows):
    first = spark.createDataFrame([("class", "named/A", "a", 0), ("class", "named/B", "b", 1), ("class", "named/C", "c", 2)],
                                  "kind string, original string, mapped string, position int")
    second = spark.createDataFrame([("class", "a", "i1"), ("class", "b", "i1")], "kind string, original string, mapped string")
    assert rows(remap.compose_mappings(first, second)) == [("class", "c", "named/C"), ("class", "i1", "named/B")]


# ----------------------------------------------------------------- tags and extensions

def test_tag_files(spark, rows):
    content = {
        "a": '{"values":["a","x:b","#c","#x:d",{"id":"e"},{"required":false},[1],null]}', "b": '{"replace":true,"values":["a"]}',
        "c": '{"values":[]}', "d": "{}", "e": "not json", "f": '{"values":{"a":1}}', "g": '{"values":["a",{"id":[1]}]}',
        "h": '{"values":[true, 1]}', "i": '{"replace":[],"values":["a"]}', "sub/j": '{"values":["z"]}',
    }
    files = [(1, f"data/ns/tags/{k}.json", v) for k, v in content.items()] + [(1, "data/ns/other/a.json", '{"values":["a"]}')]
    df = spark.createDataFrame(files, "artifact_id long, path string, content string")
    got = {r.tag: (r.replace, r.entries) for r in datafiles.tag_files(df).collect()}
    assert got == {
        "ns/a": (False, ["minecraft:a", "x:b", "#minecraft:c", "#x:d", "minecraft:e"]), "ns/b": (True, ["minecraft:a"]),
        "ns/h": (False, ["minecraft:true", "minecraft:1"]), "ns/sub/j": (False, ["minecraft:z"]),
    }


def test_extension_files(spark, rows):
    df = spark.createDataFrame([
        (1, '{"entries":[{"enum":"p/E","name":"N","constructor":"(I)V","parameters":[1]}, "ignored"]}'), (2, '{"entries":{}}'), (3, "x"),
    ], "artifact_id long, content string")
    assert rows(datafiles.extension_entries(df)) == [(1, "p/E", "N", "(I)V", "[1]")]


def test_pack_members(spark, rows):
    packs = spark.createDataFrame([("p", '{"files":[{"projectID":1,"fileID":10},{"projectID":2,"fileID":99}]}'), ("q", "{}")], "pack_id string, manifest string")
    files = spark.createDataFrame([(10, "x")], "file_id long, name string")
    assert rows(catalogue.pack_members(packs, files), "pack_id", "file_id") == [("p", 10)]


# ------------------------------------------------------------------------ incremental

def test_prefix_stops_at_a_current_file_and_skips_stale_ones(spark, rows):
    t = lambda s: f"2024-01-01 00:00:{s}"
    listing_rows = [  # newest first: new, unavailable, known with another date, new, known to the second, new
        ("p6", 6, t("06"), True), ("p5", 5, t("05"), False), ("p4", 4, t("04"), True), ("p3", 3, t("03"), True),
        ("p2", 2, t("02.7"), True), ("p1", 1, t("01"), True), ("p6", 60, t("03.5"), True), ("p7", None, t("07"), True),
    ]
    df = spark.createDataFrame(listing_rows, "project_id string, file_id int, updated string, available boolean").withColumn(
        "updated", F.to_timestamp("updated")).withColumn("latest_release", F.col("updated"))
    known = spark.createDataFrame([(4, t("00")), (2, t("02.1"))], "file_id int, latest_date string").withColumn("latest_date", F.to_timestamp("latest_date"))
    assert rows(incremental.updated_prefix(df, known), "project_id", "file_id") == [("p3", 3), ("p6", 6)]
    assert rows(incremental.updated_prefix(df, known.where("file_id = 4")), "file_id") == [(1,), (2,), (3,), (6,)]


def test_batch_is_empty_once_everything_is_known(spark):
    df = spark.range(50).selectExpr("id % 20 as project_id", "id as file_id", "timestamp_seconds(id) as updated", "true as available",
                                    "timestamp_seconds(id) as latest_release", "timestamp_seconds(id) as released")
    known = df.selectExpr("file_id", "latest_release as latest_date")
    indexed = df.select("project_id").distinct()
    assert incremental.incremental_batch(df, known, df, indexed, 10).count() == 0
    none = known.where("false")
    assert incremental.incremental_batch(df, none, df, indexed, 10).count() == 20


def test_page_limit_comes_before_availability(spark, rows):
    df = spark.createDataFrame([(i, i != 3) for i in range(5)], "project_id int, available boolean").selectExpr(
        "*", "timestamp_seconds(project_id) as released")
    assert rows(incremental.newest_page(df, 2), "project_id") == [(4,)]


def test_processing_order_of_a_batch(spark):
    updates = spark.createDataFrame([(1, 11, 100), (2, 22, 50)], "project_id int, file_id int, s long").selectExpr(
        "project_id", "file_id", "timestamp_seconds(s) as updated", "true as available", "timestamp_seconds(s) as latest_release")
    known = spark.createDataFrame([], "file_id int, latest_date timestamp")
    page = spark.createDataFrame([(1, 11, 9), (3, 33, 8), (4, 44, 7), (5, None, 6), (6, 66, 5)], "project_id int, file_id int, s long").selectExpr(
        "project_id", "file_id", "timestamp_seconds(s) as released", "true as available")
    indexed = spark.createDataFrame([(6,)], "project_id int")
    got = incremental.incremental_batch(updates, known, page, indexed, 50).orderBy("phase", "at").collect()
    assert [r.file_id for r in got] == [22, 11, 33, 44]


# ------------------------------------------------------------------------------ sinks

def test_replace_by_key_twice_equals_once(spark, rows):
    current = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new, keys = spark.createDataFrame([(1, "A"), (4, "D")], "k int, v string"), spark.createDataFrame([(1,), (3,), (4,), (4,)], "k int")
    once = tables.replace_by_key(current, new, keys, "k")
    assert rows(once) == [(1, "A"), (2, "b"), (4, "D")]
    assert rows(tables.replace_by_key(once, new, keys, "k")) == rows(once)


def test_bucketed_replacement_leaves_other_buckets_and_empties_some(spark, rows, tmp_path):
    import os
    path = str(tmp_path / "t")
    current = spark.range(40).selectExpr("cast(id as int) as k", "concat('v', id) as v")
    tables.write_buckets(current, path, "k", 8)
    files = lambda: {(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    keys, new = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "new")], "k int, v string")
    for _ in range(2):
        tables.replace_in_buckets(new, keys, path, "k", 8)
        assert rows(spark.read.parquet(path), "k", "v") == rows(tables.replace_by_key(current, new, keys, "k"))
    assert len({d for d, _ in before & files()}) == 7
    for wrong in (keys.where("false"), spark.createDataFrame([(2,)], "k int")):
        with pytest.raises(ValueError):
            tables.replace_in_buckets(new, wrong, path, "k", 8)
    tables.replace_in_buckets(new.where("false"), current.select("k"), path, "k", 8)
    assert spark.read.schema(current.schema).parquet(path).count() == 0


def test_generations_replace_as_a_whole(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    current = spark.range(40).selectExpr("cast(id as int) as k", "concat('v', id) as v")
    generations.create(current, path, "k")
    read = lambda: rows(generations.read(spark, path, current.schema, "k"))
    keys, new = spark.createDataFrame([(1,), (2,), (77,)], "k int"), spark.createDataFrame([(1, "new"), (77, "x")], "k int, v string")
    wanted = rows(tables.replace_by_key(current, new, keys, "k"))
    # A run that ends before it publishes changes nothing, and can be repeated.
    publish = generations.publish
    monkeypatch.setattr(generations, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        generations.replace(new, keys, path, "k")
    assert read() == rows(current)
    monkeypatch.setattr(generations, "publish", publish)
    for _ in range(2):
        generations.replace(new, keys, path, "k")
        assert read() == wanted
    with pytest.raises(ValueError):
        generations.replace(new, keys.where("k = 1"), path, "k")
    generations.replace(new, keys, path, "k")
    generations.compact(spark, path, current.schema, "k", str(tmp_path / "c"))
    assert rows(generations.read(spark, str(tmp_path / "c"), current.schema, "k")) == wanted
    # The lost run, the refused one and the repeated ones are dead; the first and the last are read from.
    assert len(generations.vacuum(spark, path, current.schema, "k")) == 4 and read() == wanted
    assert generations.vacuum(spark, path, current.schema, "k") == []
    assert sorted(p.name.split("=")[0] for p in (tmp_path / "t" / "rows").iterdir() if p.is_dir()) == ["_run", "_run"]


def test_one_spelling_for_each_json_value(spark):
    spelled = {
        "1e10": "10000000000", "10000000000": "10000000000", "1e-7": "0.0000001", "0.0000001": "0.0000001", "1.50": "1.5", "-0.0": "0", "-0e5": "0",
        "1e2147483647": "1E2147483647", "10e2147483646": "1E2147483647", "1e3000000000": "1E3000000000", "-1e99999999999": "-1E99999999999", "0e99999999999": "0",
        '{"a":"\\u0001#true","b":1.5e0}': '{"a":"\\u0001#true","b":1.5}', '{"n5":"a\\"n5","s":["s\\\\",1E0,"n1"]}': '{"n5":"a\\"n5","s":["s\\\\",1,"n1"]}',
        "1" + "0" * 37: "1" + "0" * 37, "1e37": "1" + "0" * 37, "1e38": "1E38", "1" + "0" * 38: "1E38", "1." + "0" * 60: "1", "12e-39": "12E-39", "12e-38": "0." + "0" * 36 + "12",
        "0." + "0" * 36 + "12": "0." + "0" * 36 + "12", "123456789012345678901234567890.5": "123456789012345678901234567890.5", "true": "true", '"1e5"': '"1e5"',
        "1" * 41: "1" * 41 + "E0", "1" * 40 + "2": "1" * 40 + "2E0", '{"b":1E2,"a":["x1.0", 1.0]}': '{"a":["x1.0",1],"b":100}',
        "null": "null", '{"a":1} junk': None, "1,2": None, "01": None, "1],[2": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in spelled], "t string")
    assert {r[0]: r[1] for r in df.select("t", canonical_json(F.col("t"))).collect()} == spelled


def test_insert_if_absent_keeps_old_dates(spark, rows):
    current = spark.createDataFrame([("a", 1)], "k string, d int")
    new = spark.createDataFrame([("a", 9), ("b", 5), ("b", 4)], "k string, d int")
    assert rows(tables.insert_if_absent(current, new, ["k"], F.col("d"))) == [("a", 1), ("b", 4)]
    assert rows(tables.insert_if_absent(current, new, ["k"], F.col("d"), refresh=True)) == [("a", 9), ("b", 4)]


def test_upsert_overwrites_with_null_but_keeps_coordinates(spark, rows):
    current = spark.createDataFrame([(1, "n", "l", "c", 7), (2, "m", "l", "d", 8)], "id int, name string, license string, coordinates string, extra int")
    new = spark.createDataFrame([(1, "N", None, None), (3, "x", "x", "x")], "id int, name string, license string, coordinates string")
    assert rows(tables.upsert_metadata(current, new)) == [(1, "N", None, "c", 7), (2, "m", "l", "d", 8)]


# ------------------------------------------------------------------------- resolution

def test_fingerprints_first_input_last_file(spark, rows):
    contained = spark.createDataFrame([("x", [1], 7), ("y", [0, 1], 7), ("z", [2], 8)], "id string, first_seen array<int>, fingerprint long")
    files = spark.createDataFrame([(7, 0, "f0", "p0"), (7, 1, "f1", "p1")], "fingerprint long, position int, file_id string, project_id string")
    assert rows(resolve.match_fingerprints(contained, files), "id", "file_id") == [("y", "f1")]
    assert rows(resolve.match_fingerprints(contained, files, first_only=False), "id") == [("x",), ("y",)]


CANDIDATE = "position int, project_id string, file_id string, sha1 string, nested_tree string"
LISTED = "fingerprint string, position int, file_id string, project_id string"


def test_expansion(spark, rows):
    tree = ('[{"id":"g:own","version":"1","sha1":"h2"},{"id":"g:same","version":"1","sha1":"f1"},{"id":"g:new","version":"1","sha1":"f2"},'
            '{"id":"g:new2","version":"1","sha1":"f3"},{"id":"g:none","version":"1","sha1":"zz"}]')
    candidates = spark.createDataFrame([(0, "p1", "F1", "h1", tree), (1, "p2", "F2", "h2", None)], CANDIDATE)
    files = spark.createDataFrame([("f1", 0, "X1", "p1"), ("f2", 1, "X2", "p3"), ("f3", 2, "X3", "p3")], LISTED)
    expanded, coordinates = resolve.expand_candidates(candidates, files)
    assert rows(expanded) == sorted([
        ("listed", "p1", "F1", "h1", None), ("listed", "p2", "F2", "h2", None),
        ("matched", "p3", "X2", "f2", "g:new"), ("contained", None, None, "zz", "g:none"),
    ], key=repr)
    assert rows(coordinates) == [("p1", "F1", "g:same"), ("p2", "F2", "g:own"), ("p3", "X2", "g:new2")]
    with pytest.raises(ValueError):
        resolve.expand_candidates(candidates.union(candidates), files)


def test_resolution_rules_in_order(spark, rows):
    index = spark.createDataFrame([
        artifact(1, name="one", int_id=1), artifact(2, name="two", text_id="t2"), artifact(3, name="two", text_id="t3"),
        artifact(4, name="lib", coordinates="g:lib", version="2.0"), artifact(5, name="both", int_id=5, text_id="t5"),
        artifact(6, name="lib2", coordinates="g:lib2", version="1.9"),
    ], ARTIFACT)
    candidates = spark.createDataFrame([
        ("known", "a", "1", "k", "x", None, "1", "d"), ("known2", "a", "5", "k", "x", None, "1", "d"),
        ("project", "a", "5", "s1", "x", None, "1", "d"), ("digest", "a", "77", "s2", "two", None, "1", "D3"),
        ("hash", "a", "78", "s3", "two", None, "1", "none"), ("new", "a", "79", "s4", "two", None, "1", "none"),
        ("wrong side", "b", "t9", "s5", "two", None, "1", "D3"), ("old", None, None, "s6", "x", "g:lib", "2", "d"),
        ("newer", None, None, "s7", "x", "g:lib2", "1.10", "d"), ("file", None, None, "s8", "x", "g:other", "1", "d"),
        ("nothing", None, None, "s9", "x", None, "1", "d"),
    ], "candidate_id string, catalogue string, project_id string, sha1 string, display_name string, coordinate string, version string, digest string")
    known = spark.createDataFrame([(1, "k")], "artifact_id long, sha1 string")
    digests = spark.createDataFrame([("b", "t3", "D3")], "catalogue string, project_id string, digest string")
    files = spark.createDataFrame([("a", "78", "H"), ("a", "78", "G"), ("b", "t2", "H"), ("b", "t3", "G")], "catalogue string, project_id string, sha1 string")
    got = {r.candidate_id: (r.outcome, r.artifact_id, r.merge_id) for r in resolve.resolve_entities(candidates, index, known, digests, files).collect()}
    assert got == {
        "known": ("known", 1, None), "known2": ("known", 1, 5), "project": ("project", 5, None), "digest": ("same_name", 3, None),
        "hash": ("same_name", 2, None), "new": ("new", None, None), "wrong side": ("new", None, None), "old": ("outdated", 4, None),
        "newer": ("coordinate", 6, None), "file": ("new", None, None), "nothing": ("unidentified", None, None),
    }


def test_one_name_for_most_artifacts_makes_no_pairs(spark):
    """A shared name costs one row per content, checked by the join's output."""
    n = 20000
    index = spark.range(n).selectExpr(
        "id", "'1' as version", "'Unknown' as name", "array('x') as ids", "null as license", "false as loader", "null as coordinates",
        "cast(null as int) as int_project_id", "concat('t', id) as text_project_id")
    candidates = spark.range(n).selectExpr(
        "id as candidate_id", "'a' as catalogue", "concat('c', id) as project_id", "concat('s', id) as sha1", "'Unknown' as display_name",
        "cast(null as string) as coordinate", "'1' as version", "concat('d', id % 10) as digest")
    digests = spark.range(n).selectExpr("'b' as catalogue", "concat('t', id) as project_id", "concat('d', id % 10) as digest")
    none = spark.createDataFrame([], "catalogue string, project_id string, sha1 string")
    got = resolve.same_name_matches(candidates, index, digests, none)
    assert got.count() == n and got.agg(F.max("artifact_id")).first()[0] == 9


def test_merge_keeps_the_newer_and_the_first_on_a_tie(spark, rows):
    pairs = spark.createDataFrame([(1, "1.10", 2, "1.9"), (3, "1.0", 4, "1"), (5, "1", 6, "2")], "a_id long, a_version string, b_id long, b_version string")
    merges = resolve.choose_survivor(pairs)
    assert rows(merges) == [(2, 1), (4, 3), (5, 6)]
    index = spark.createDataFrame([artifact(1, int_id=1), artifact(2, text_id="t"), artifact(9)], ARTIFACT)
    known = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "artifact_id long, sha1 string")
    kept, moved = resolve.merge_entities(index, known, merges.where("old_id = 2"))
    assert rows(kept, "id", "int_project_id", "text_project_id") == [(1, 1, "t"), (9, None, None)]
    assert rows(moved) == [(1, "a"), (1, "b"), (9, "c")]


def test_chained_and_mutual_merges_settle(spark, rows):
    merges = spark.createDataFrame([(3, 2), (2, 1), (7, 6), (6, 5), (5, 6), (9, 8), (9, 4), (4, 8)], "old_id long, new_id long")
    assert rows(resolve.settle_merges(merges)) == [(2, 1), (3, 1), (4, 8), (6, 5), (7, 5), (9, 8)]


# -------------------------------------------------------------------------- backfills

@pytest.mark.parametrize("text, expected", [
    ("g:a (g:b, g:c (g:d)), g:e", '[{"id":"g:a","nested":[{"id":"g:b"},{"id":"g:c","nested":[{"id":"g:d"}]}]},{"id":"g:e"}]'),
    ("", None), (None, None), ("a", '[{"id":"a"}]'), ("a (b", '[{"id":"a","nested":[{"id":"b"}]}]'), ("a (b))", '[{"id":"a","nested":[{"id":"b"}]}]'),
    ('a"b', '[{"id":"a\\"b"}]'), ("a (b)) , c", '[{"id":"a","nested":[{"id":"b"}]},{"id":"c"}]'),
    ("a (b) c", '[{"id":"ac","nested":[{"id":"b"}]}]'), ("a,,b", '[{"id":"a"},{"id":""},{"id":"b"}]'), ("a,", '[{"id":"a"},{"id":""}]'),
    ("(b)", '[{"id":"","nested":[{"id":"b"}]}]'), ("a (b,)", '[{"id":"a","nested":[{"id":"b"},{"id":""}]}]'),
    ("a ()", '[{"id":"a","nested":[{"id":""}]}]'),
])
def test_tree_text(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(backfill.tree_to_json(F.col("t"))).first()[0] == expected


def test_annotation_text(spark):
    cases = {
        'value="a", n=3': '{"n":3,"value":"a"}', "list=[1, 2]": '{"list":[1,2]}', "at=@p/T(x=true)": '{"at":{"_$tp":"p/T","x":true}}',
        "e=p/E:V": '{"e":{"enum":"p/E","value":"V"}}', "c=p/C.class": '{"c":"p/C"}', "": "{}", None: "{}", "n=1L": '{"n":"1L"}',
        's="a,b=[c"': '{"s":"a,b=[c"}', 'l=[@p/T(x=1,y="q"), @p/U()]': '{"l":[{"_$tp":"p/T","x":1,"y":"q"},{"_$tp":"p/U"}]}',
        "n=-1.5e3, f=false": '{"f":false,"n":-1500}', "l=[]": '{"l":[""]}',
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, constant string")
    got = {r.id: r.value for r in backfill.convert_annotations(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_toml_text(spark):
    df = spark.createDataFrame([('license="MIT"\n[[mods]]\nmodId="x" # c',), ("= bad",), (None,)], "metadata string")
    got = [r[0] for r in backfill.backfill_metadata(df).select("metadata_json").collect()]
    assert got == ['{"license": "MIT", "mods": [{"modId": "x"}]}', None, None]


# ---------------------------------------------------------------- metadata and archives

def test_metadata_fallbacks(spark):
    rows_in = [
        (1, '{"mods":[{"modId":"m","version":"${file.jarVersion}"}]}', '{"":{"Implementation-Version":"9"}}', "fb"),
        (2, '{"mods":[{"modId":"m","version":"${file.jarVersion}"}]}', '{"":{}}', "fb"),
        (3, '{"mods":[{"modId":"m","displayName":"N","authors":" "}],"license":"L"}', None, None),
        (4, None, None, None),
    ]
    df = spark.createDataFrame(rows_in, "id int, descriptor string, manifest string, fallback_version string").withColumns(
        {c: F.lit(None).cast("string") for c in ("coordinates", "library_name")})
    got = {r.id: (r.version, r.name, r.ids, r.authors, r.license) for r in metadata.project_metadata(df).collect()}
    assert got == {
        1: ("9", "m", ["m"], None, None), 2: ("fb", "m", ["m"], None, None),
        3: ("0.0NONE", "N", ["m"], None, "L"), 4: ("0.0NONE", "", [], None, None),
    }


def test_archive_scan_with_nested_and_broken_archives(spark, tmp_path):
    import io
    import json
    import zipfile

    def pack(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for path, content in members.items():
                z.writestr(path.replace("__", "/"), content)
        return out.getvalue()

    inner = pack(**{"fabric.mod.json": '{"id":"in","version":"3"}', "deep.txt": "d"})
    unlisted = pack(x="1")
    outer = pack(**{"fabric.mod.json": json.dumps({"jars": [{"file": "in.jar"}, {"file": "gone.jar"}]}), "in.jar": inner, "un.jar": unlisted, "a.txt": "A"})
    (tmp_path / "outer.jar").write_bytes(outer)
    (tmp_path / "bad.jar").write_bytes(b"no zip")
    got = archives.read_archives(spark, str(tmp_path)).collect()
    assert {(r.container, r.path, r.depth, r.id, r.version) for r in got if r.archive.endswith("outer.jar")} == {
        ("", "fabric.mod.json", 0, None, None), ("", "in.jar", 0, None, None), ("", "un.jar", 0, None, None), ("", "a.txt", 0, None, None),
        ("!in.jar", "fabric.mod.json", 1, "in", "3"), ("!in.jar", "deep.txt", 1, "in", "3"),
    }
    bad = [r for r in got if r.archive.endswith("bad.jar")]
    assert len(bad) == 1 and bad[0].error and bad[0].path is None


def test_archives_to_metadata_tags_and_tree(spark, rows, tmp_path):
    import io
    import json
    import zipfile

    def pack(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for path, content in members.items():
                z.writestr(path, content)
        return out.getvalue()

    toml = 'license="MIT"\n[[mods]]\nmodId="m"\nversion="${file.jarVersion}"\nauthors="A"\n'
    listed = lambda *names: json.dumps({"jars": [
        {"identifier": {"group": "g", "artifact": n}, "version": {"artifactVersion": f"{i}.0"}, "path": f"{n}.jar"} for i, n in enumerate(names)]})
    deep = pack({"META-INF/MANIFEST.MF": "FMLModType: GAMELIBRARY\r\nImplementation-Title: T\r\n"})
    lib = pack({"META-INF/MANIFEST.MF": "FMLModType: LIBRARY\n", "p/A.class": "", "META-INF/jarjar/metadata.json": listed("deep"), "deep.jar": deep})
    plain = pack({"x.txt": ""})
    outer = pack({"META-INF/mods.toml": toml, "META-INF/MANIFEST.MF": "Implementation-Version: 7.\r\n 1\r\n\r\nName: a/b\r\nK: v: w\r\n",
                  "META-INF/jarjar/metadata.json": listed("plain", "lib"), "lib.jar": lib, "plain.jar": plain, "data/n/tags/b/t.json": '{"values":["a"]}'})
    (tmp_path / "o.jar").write_bytes(outer)
    entries = archives.read_archives(spark, str(tmp_path))
    found = describe.describe_archives(entries)
    manifest = {r.container: r.manifest for r in found.collect()}
    assert manifest[""] == '{"":{"Implementation-Version":"7.1"},"a/b":{"K":"v: w"}}'
    meta = metadata.project_metadata(found.drop("archive", "metadata"))
    assert rows(meta, "container", "version", "name", "authors", "license") == sorted([
        ("", "7.1", "m", "A", "MIT"), ("!lib.jar", "1.0", "g:lib", None, None), ("!lib.jar!deep.jar", "0.0", "g:deep", None, None),
    ], key=repr)
    files = describe.data_files(entries).withColumn("artifact_id", F.lit(1))
    assert rows(datafiles.tag_entries(files), "tag", "entry") == [("n/b/t", "minecraft:a")]
    tree = nested.build_nested(describe.nested_edges(entries), 1).select("nested_tree").collect()[0][0]
    assert tree == '[{"id":"g:plain","version":"0.0"},{"id":"g:lib","version":"1.0","nested":[{"id":"g:deep","version":"0.0"}]}]'


def test_archives_as_each_loader_reads_them(spark, rows):
    import io
    import json
    import zipfile

    def pack(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for path, content in members.items():
                z.writestr(path, content)
        return out.getvalue()

    listed = lambda *names: json.dumps({"jars": [
        {"identifier": {"group": "g", "artifact": n}, "version": {"artifactVersion": f"{i}.0"}, "path": f"{n}.jar"} for i, n in enumerate(names)]})
    library = pack({"META-INF/MANIFEST.MF": "FMLModType: LIBRARY\r\nImplementation-Version: 9\r\n", "p/A.class": "", "META-INF/jarjar/metadata.json": listed("deep"),
                    "deep.jar": pack({"META-INF/services/x.Service": "y", "q/B.class": ""})})
    hidden = pack({"META-INF/jarjar/metadata.json": listed("lib"), "lib.jar": library, "x.txt": ""})  # no artifact, so nothing in it counts
    flat = lambda i, v, **kw: json.dumps({"id": i, "version": v, **kw})
    toml = 'license="MIT"\n[[mods]]\nmodId="m"\nversion="${file.jarVersion}"\nenumExtensions="META-INF/e.json"\n[[mods]]\nmodId="n"\nenumExtensions="META-INF/e.json"\n'
    both = pack({
        "META-INF/mods.toml": toml, "META-INF/MANIFEST.MF": "Implementation-Version: 7\n", "META-INF/jarjar/metadata.json": listed("hidden", "lib", "gone", "bad"),
        "hidden.jar": hidden, "lib.jar": library, "bad.jar": b"no archive", "META-INF/e.json": "{}", "META-INF/other.json": "{}", "data/n/a.json": "1", "data/n/b.txt": "",
        "fabric.mod.json": flat("flat", "2", name="Flat", license=["A", "B"], authors=["x", {"name": "y"}], jars=[{"file": "in.jar"}, {"file": "lib.jar"}]),
        "in.jar": pack({"fabric.mod.json": flat("in", "3", jars=[{"file": "in.jar"}])}),
    })
    data = [("both", both), ("bad", b"no archive"), ("plain", pack({"x": ""})), ("lost", pack({"META-INF/mods.toml": '[[mods]]\nmodId="l"\nenumExtensions="no.json"'})),
            ("broken", pack({"META-INF/mods.toml": "[[mods", "META-INF/services/x.Service": "", "fabric.mod.json": '{"id":"k"}'})), ("latin", pack({"META-INF/mods.toml": b"\xff"}))]
    archives_ = spark.createDataFrame(data, "path string, content binary").repartition(3)
    one = loaders.Loader("META-INF/mods.toml", ("x.Service",))
    scanned = loaders.scan(archives_, one).cache()
    assert rows(scanned, "archive", "container", "kind") == sorted([
        ("bad", "", "failed"), ("both", "", "artifact"), ("both", "", "data"), ("both", "", "extension"), ("both", "!lib.jar", "artifact"), ("both", "!lib.jar!deep.jar", "artifact"),
        ("broken", "", "artifact"), ("latin", "", "other"), ("lost", "", "artifact"), ("lost", "", "failed"), ("plain", "", "other"),
    ], key=repr)
    assert rows(loaders.artifacts(scanned, one), "archive", "container", "version", "name", "ids", "license", "coordinates") == sorted([
        ("both", "", "7", "m", ["m", "n"], "MIT", None), ("both", "!lib.jar", "9", "g:lib", [], None, "g:lib"), ("both", "!lib.jar!deep.jar", "0.0", "g:deep", [], None, "g:deep"),
        ("broken", "", "0.0NONE", "", [], None, None), ("lost", "", "0.0NONE", "l", ["l"], None, None)], key=repr)
    assert rows(loaders.nested_trees(scanned)) == [("both", '[{"id":"g:lib","version":"1.0","nested":[{"id":"g:deep","version":"0.0"}]}]')]
    assert rows(loaders.files(scanned, "extension")) == [("both", "META-INF/e.json", "{}")] and rows(loaders.files(scanned, "data")) == [("both", "data/n/a.json", "1")]
    assert [r[0] for r in rows(loaders.failures(scanned))] == ["bad", "lost"]
    stored = {r["archive"]: r for r in loaders.index_rows(scanned, one).collect()}
    assert set(stored) == {"both", "broken", "lost"} and stored["both"]["metadata"] == toml and json.loads(stored["both"]["metadata_json"])["license"] == "MIT"
    assert json.loads(stored["both"]["manifest"]) == {"": {"Implementation-Version": "7"}} and stored["lost"]["nested_tree"] is None

    scanned = loaders.scan(archives_, loaders.JSON_LOADER).cache()
    assert rows(loaders.artifacts(scanned, loaders.JSON_LOADER), "archive", "container", "version", "name", "ids", "license", "authors", "coordinates") == sorted([
        ("both", "", "2", "Flat", ["flat"], "A, B", "x, y", None), ("both", "!in.jar", "3", "in", ["in"], None, None, "in")], key=repr)
    assert rows(loaders.nested_trees(scanned)) == [("both", '[{"id":"in","version":"3"}]')]
    assert rows(scanned.where("kind = 'other'"), "archive") == [("broken",), ("latin",), ("lost",), ("plain",)]
    none = loaders.scan(archives_.limit(0), one)
    assert none.count() == loaders.index_rows(none, one).count() == 0
