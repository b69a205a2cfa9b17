"""What one task, worker or join holds stays bounded while the input grows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from usagelens.operators import clean, closure, dictionary, flatten, packed, remap, resolve
from usagelens.plans import fact_queries
from usagelens.plans.registry import Tables
from usagelens.schemas import CLASS_RECORD
from usagelens.session import condense, tune
from usagelens.sinks import generations
from usagelens.sinks.dictionaries import Dictionaries
from usagelens.sources import archives


def test_a_shared_coordinate_is_one_row_before_the_join(spark, rows, monkeypatch):
    written = {}
    write = resolve.materialize
    monkeypatch.setattr(resolve, "materialize", lambda df, label: written.setdefault(label, write(df, label)))
    candidates = spark.range(50).select(
        F.col("id").alias("candidate_id"), *[F.lit(None).cast("string").alias(c) for c in ("catalogue", "project_id")],
        F.col("id").cast("string").alias("sha1"), F.lit("n").alias("display_name"), F.lit("org:a").alias("coordinate"),
        F.when(F.col("id") < 25, "1.0").otherwise("3.0").alias("version"), F.lit("d").alias("digest"),
    )
    artifacts = spark.range(100, 200).select(
        "id", F.lit("n").alias("name"), F.concat(F.col("id") - 98, F.lit(".0")).alias("version"), F.lit("org:a").alias("coordinates"),
        F.lit(None).cast("int").alias("int_project_id"), F.lit(None).cast("string").alias("text_project_id"),
    ).union(spark.sql("SELECT 7L, 'n', '1', 'org:b', NULL, NULL"))
    none = lambda schema: spark.createDataFrame([], schema)
    found = resolve.resolve_entities(
        candidates, artifacts, none("artifact_id bigint, sha1 string"),
        none("catalogue string, project_id string, digest string"), none("catalogue string, project_id string, sha1 string"),
    )
    assert rows(found, "candidate_id", "outcome", "artifact_id") == sorted(
        [(i, "outdated" if i < 25 else "coordinate", 100) for i in range(50)], key=repr)
    assert rows(written["at-coordinate"], "coordinate", "artifact_id", "indexed") == [("org:a", 100, "2.0")]


def test_python_workers_get_batches_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"held": [int(batch["content"].map(len).sum())]})

    whole = tune(spark).range(0, 60, 1, 1).select(F.encode(F.repeat(F.lit("x"), 1 << 20), "utf-8").alias("content"))
    held = [r["held"] for r in whole.mapInPandas(sizes, "held bigint").collect()]
    assert sum(held) == 60 << 20 and max(held) <= 16 << 20


def test_override_search_writes_only_the_members_of_roots(spark, rows, monkeypatch):
    written, tables = {}, []
    write, store = closure.materialize, closure.Scratch.write
    monkeypatch.setattr(closure, "materialize", lambda df, label: written.setdefault(label, write(df, label)))
    monkeypatch.setattr(closure.Scratch, "write", lambda self, df, table, *a: tables.append(table) or store(self, df, table, *a))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "a"), (None, "z")], "parent string, child string")
    made = [(f"{c}.{n}", c, n, "()V") for c in "abcxyz" for n in ("m", "n")] + [("b.o", "b", "o", "()V"), ("c.m", "c", "m", "()V")]
    members = spark.createDataFrame(made, "id string, cls string, name string, descriptor string").distinct()
    roots = spark.createDataFrame([("a",)], "root string")
    found = closure.overriding_members(members, edges, roots, "^m", distinct=True)
    assert rows(found, "root", "id") == [("a", "a.m"), ("a", "b.m"), ("a", "c.m")]
    assert written["own"].count() == 1 and "members" not in written and "plain" not in tables
    assert rows(closure.descendants(edges, roots, distinct=True)) == rows(closure.descendants(edges.union(edges), roots))


def test_a_table_that_one_run_has_changed_is_read_without_a_join(spark, rows, tmp_path):
    path, schema = str(tmp_path / "t"), "k bigint, v string"
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], schema)
    read = lambda order=None: generations.read(spark, path, first.schema, "k", order=order)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    generations.lay_out(spark, path, first.schema, "k")
    generations.publish(spark, path, generations.new_run(), 0)
    assert rows(read()) == []
    lost = generations.new_run()
    assert generations.append(first, first.select("k"), path, "k", lost) and rows(read()) == []
    generations.replace(first, first.select("k"), path, "k")
    assert "Join" not in plan(read()) and rows(read()) == [(1, "a"), (1, "b"), (2, "c")]
    second = spark.createDataFrame([(1, "d")], schema)
    generations.replace(second, spark.createDataFrame([(1,), (2,)], "k bigint"), path, "k")
    assert rows(read()) == [(1, "d")]
    assert "Join" not in plan(read(1)) and rows(read(1)) == [(1, "a"), (1, "b"), (2, "c")] and rows(read(0)) == []


def test_renames_lie_by_the_key_of_their_record(spark, rows, monkeypatch):
    written = []
    write = remap.materialize
    monkeypatch.setattr(remap, "materialize", lambda df, label: written.append(label) or write(df, label))
    none = "CAST(array() AS array<struct<type:string,members:string>>)"
    records = spark.range(200).selectExpr(
        "id AS artifact_id", "0L AS position", "concat('c/', id) AS name", "'q' AS super", "CAST(array() AS array<string>) AS interfaces", f"{none} AS annotations",
        f"array(named_struct('name', concat('f_', id % 3), 'desc', 'I', 'access', 1, 'annotations', {none})) AS fields",
        "CAST(array() AS array<struct<name:string,desc:string,access:int,annotations:array<struct<type:string,members:string>>>>) AS methods",
        "CAST(array() AS array<struct<owner:string,name:string,desc:string,count:int>>) AS method_refs",
        "CAST(array() AS array<struct<owner:string,name:string,desc:string,count:int>>) AS field_refs",
    )
    mapping = spark.createDataFrame([("field", "f_1", "one"), ("field", "f_2", "two")], "kind string, original string, mapped string")
    found = remap.remap_records(records, mapping)
    assert written == ["mapping"]
    named = rows(found.selectExpr("artifact_id", "fields[0].name AS name"))
    assert named == sorted([(i, ["f_0", "one", "two"][i % 3]) for i in range(200)], key=repr)


def test_archives_reach_python_workers_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"held": [int(batch["content"].map(len).sum())]})

    pages = tune(spark).range(0, 64, 1, 1).select(F.encode(F.repeat(F.lit("x"), 1 << 18), "utf-8").alias("content"))
    held = [r["held"] for r in pages.mapInPandas(sizes, "held bigint").collect()]
    assert sum(held) == 16 << 20 and max(held) <= 2 << 20
    assert archives.BATCH_BYTES <= 1 << 20


def test_members_are_made_distinct_once(spark, rows, tmp_path, monkeypatch):
    given, fresh = {}, dictionary.fresh

    def seen(existing, values, keys, distinct=False):
        given[tuple(keys), distinct] = values
        return fresh(existing, values, keys, distinct)

    monkeypatch.setattr(dictionary, "fresh", seen)
    held = Dictionaries(spark, str(tmp_path / "d")).create()
    some = [("a", "m", "()V"), ("a", "m", "()V"), ("b", "m", "()V"), ("b", None, "()V")]
    held.extend({"method_references": spark.createDataFrame(some, "owner string, name string, descriptor string")})
    held.extend({"method_references": spark.createDataFrame([*some, ("c", "n", "()V")], "owner string, name string, descriptor string")})
    assert rows(held.spelled("methods")) == [(1, "a", "m", "()V"), (2, "b", "m", "()V"), (3, "c", "n", "()V")]
    members = given[("cls", "name", "descriptor"), True]
    assert members.count() == members.distinct().count() == 3


def test_cleaning_judges_members_as_rows_and_writes_no_members(spark, rows, monkeypatch):
    written = []
    write = clean.materialize
    monkeypatch.setattr(clean, "materialize", lambda df, label: written.append(label) or write(df, label))
    mark, none = ("x/Mark", "{}"), []
    member = lambda name, access, marks=none: (name, "()V", access, marks)
    made = [
        (1, 0, "A", None, ["I"], [], [member("f", 2), member("g", 2, [mark]), member("h", 1), member("n", None)], [member("lambda$0", 10), member("m", 4), member(None, 9)],
         [("A", "lambda$0", "()V", 3), ("A", "m", "()V", 2), ("B", "m", "()V", 1)], [("A", "f", "J", 1), ("A", "h", "I", 1)]),
        (1, 1, "A$1", "A", None, [], None, [], [], None),
        (1, 2, None, "A", ["J", None], [], [], [member("m", 1)], [], []),
    ]
    records = spark.createDataFrame(made, CLASS_RECORD)
    facts, loader = clean.clean_artifact(records), clean.clean_loader(records)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for table in ("class_parents", "field_defs", "method_defs", "method_references"):
        assert "lambdafunction" not in plan(facts[table]) and "lambdafunction" not in plan(loader.get(table, facts[table]))
    assert "removable" not in written
    assert rows(facts["field_defs"], "name") == [("g",), ("h",)] and rows(facts["field_annotations"], "name") == [("g",)]
    assert rows(facts["method_defs"], "position", "name") == [(0, "m"), (0, None), (2, "m")]
    assert rows(facts["method_references"], "owner", "name") == [("A", "m"), ("B", "m")] and rows(facts["field_references"], "name") == [("h",)]
    assert rows(facts["class_parents"], "position", "parent") == [(0, "I"), (2, "A"), (2, "J")]
    assert rows(loader["class_defs"], "class_name") == [("A",)] and rows(loader["method_defs"], "name") == [("m",)]
    old = flatten.flatten_records(clean.drop_lambdas(clean.drop_private(records)))
    new = flatten.flatten_records(records, keep={"fields": clean.not_private, "methods": lambda m: clean.not_private(m) & clean.not_lambda(m)})
    assert all(rows(old[t]) == rows(new[t]) for t in old)


def test_references_do_not_move_where_few_classes_are_met(spark, rows, monkeypatch):
    written, write = {}, clean.materialize

    def seen(df, label):
        written[label] = write(df, label)
        return written[label]

    monkeypatch.setattr(clean, "materialize", seen)
    member = lambda name, access, desc="()V": (name, desc, access, [])
    fields, methods = [member("f", 2), member("g", 1)], [member("m", 2), member("n", 1), member("m", 1, "()I")]
    own = lambda c: [(c, "m", "()V", 1), (c, "n", "()V", 1), (c, "m", "()I", 1), (c, None, "()V", 1), (c, "m", None, 1), (None, "m", "()V", 1)]
    made = [(1, i, f"C{i}", "S", [], [], fields, methods, own(f"C{i}"), [(f"C{i}", "f", "I", 1), (f"C{i}", "g", "J", 1)]) for i in range(40)]
    made += [
        (1, 90, "U", "S", [], [], None, [], [("C7", "m", "()V", 1), ("C7", "n", "()V", 1), ("V", "m", "()V", 1)], [("C8", "f", "J", 1)]),
        # Defined twice: the later record decides. At one position twice, or with a member twice: what any of them says is removed.
        (1, 91, "T", "S", [], [], [], [member("m", 2)], own("T"), []), (1, 92, "T", "S", [], [], [], [member("n", 2)], own("T"), []),
        (1, 93, "W", "S", [], [], [], [member("m", 2)], own("W"), []), (1, 93, "W", "S", [], [], [], [member("n", 2)], own("W"), []),
        (1, 94, "R", "S", [], [], [], [member("m", 1), member("m", 2), member("m", 1)], own("R"), []),
        (None, 95, "N", "S", [], [], [], methods, own("N"), []), (2, 96, None, "S", [], [], [], methods, own(None), []),
    ]
    records = spark.createDataFrame(made, CLASS_RECORD)
    plain = flatten.flatten_records(records)
    members = clean.removable_members(records)
    old = {t: clean.drop_own_references(plain[t], members, k) for t, k in (("method_references", "methods"), ("field_references", "fields"))}
    columns = plain["method_references"].columns
    new = clean.clean_artifact(records)
    assert all(rows(new[t], *columns) == rows(old[t], *columns) for t in old)
    assert {r["owner"] for r in written["referred"].collect()} == {"C7", "C8", "T", "W", "R"}
    monkeypatch.setattr(clean, "FEW", 0)
    new = clean.clean_artifact(records)
    assert all(rows(new[t], *columns) == rows(old[t], *columns) for t in old)
    assert len(rows(old["method_references"])) < len(rows(plain["method_references"]))


def test_records_move_as_one_value_and_stay_as_they_are(spark, rows, tmp_path):
    mark = ("x/Mark", '{"n":1.0,"a":"\u00e9\\"\U0001f600"}')
    made = [
        (1, 2**62, "A", None, [], [mark], [("f", None, 2**31 - 1, [mark]), (None, "", -1, [])], [], [("A", "m", "()V", 3)], []),
        (1, 0, "", "S\x00", ["I", None], None, None, [None, ("m", "()V", None, None)], None, [("A", None, None, None)]),
        (None, None, None, None, None, None, None, None, None, None),
    ]
    records = tune(spark).createDataFrame(made, CLASS_RECORD)
    other = records.select("artifact_id", "position", "name", F.lit(7).alias("more"))
    back = packed.join(records, other, ["artifact_id", "position", "name"], "left")
    assert back.schema.simpleString() == records.withColumn("more", F.lit(7)).schema.simpleString()
    assert rows(back.drop("more")) == rows(records) and rows(back, "more") == [(7,), (7,), (None,)]
    big = condense(records.crossJoin(spark.range(2000)).withColumn("position", F.col("id")).drop("id"), "records")
    assert all(path.endswith(".zstd.parquet") for path in big.inputFiles())
    mapping = spark.createDataFrame([("field", f"f_{i}", f"named {i}") for i in range(50)], "kind string, original string, mapped string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = remap.remap_records(big, mapping)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "to_variant_object" in plan and plan.index("to_variant_object") > plan.index("SortMergeJoin")


def test_kinds_with_few_renames_do_not_move(spark, rows, monkeypatch):
    written, write = {}, remap.materialize
    monkeypatch.setattr(remap, "materialize", lambda df, label: written.setdefault(label, write(df, label)))
    member = lambda name, desc: (name, desc, 1, [])
    made = [
        (i, 0, f"c/{i}", "q", [], [], [member(f"f_{i % 3}", f"[Lc/{i};")], [member(f"m_{i % 2}", f"(Lc/{i + 1};)V")], [(f"c/{i + 1}", f"m_{i % 2}", "()V", 2)], [])
        for i in range(30)
    ]
    records = spark.createDataFrame(made, CLASS_RECORD)
    mapping = spark.createDataFrame(
        [("class", f"c/{i}", f"d/{i}") for i in range(0, 30, 2)] + [("field", "f_1", "one"), ("method", "m_0", "zero"), ("other", "f_2", "two")],
        "kind string, original string, mapped string")
    whole = rows(remap.remap_records(records, mapping, class_prefix="c/"))
    assert list(written) == ["mapping"] and written["mapping"].count() == 17
    monkeypatch.setattr(remap, "FEW", 3)
    written.clear()
    assert rows(remap.remap_records(records, mapping, class_prefix="c/")) == whole
    assert rows(written["mapping-few"], "kind", "mapped") == [("field", "one"), ("method", "zero")]
    assert sum(r[6][0]["name"] == "one" for r in whole) == 10 and sum(r[8][0]["owner"].startswith("d/") for r in whole) == 14


def test_stored_dictionaries_parse_annotations_where_they_are_written(spark, rows, tmp_path, monkeypatch):
    made = [(k, 10 * k, k, line, q) for k, line, q in ((1, 1, 10.0), (1, 2, 30.0), (2, 3, 30.0))]
    lines = spark.createDataFrame(made, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    plans, extend = [], Dictionaries.extend

    def seen(self, facts):
        plans.extend(df._jdf.queryExecution().optimizedPlan().toString() for name, df in facts.items() if "annotations" in name)
        return extend(self, facts)

    monkeypatch.setattr(Dictionaries, "extend", seen)
    found = fact_queries.stored_dictionaries(Tables(tune(spark), str(tmp_path)))
    assert len(plans) == 6 and not any("parse_json" in plan for plan in plans)
    json = [(1, '{"a":"x","n":10}'), (2, '{"a":"x","n":30}')]
    assert rows(found.where("kind = 'json_values'"), "id", "text") == json
    assert rows(found.where("kind = 'uses of a value'"), "id", "n") == [(1, 1), (2, 2)]
