"""Whole runs on a stored index."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from usagelens.operators import flatten, listing
from usagelens.operators.filters import Filter
from usagelens.plans import index_run
from usagelens.plans.browse import Browser
from usagelens.schemas import CLASS_RECORD
from usagelens.sinks.dictionaries import KEYS, Dictionaries
from usagelens.sinks.store import Change, Store
from usagelens.sources.landing import TABLES, read
from usagelens.streaming.ingest import ingest
from tests.test_operators import record

CANDIDATE = ("candidate_id string, catalogue string, project_id string, file_id string, latest_release timestamp, sha1 string, "
             "display_name string, coordinate string, version string, digest string")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "index")).create()


class Batch:
    def __init__(self, spark, candidates, methods="m"):
        df = lambda rows, schema: spark.createDataFrame(rows, schema)
        self.candidates = df([(c[0], c[1], c[2], c[3], None, c[4], c[5], None, "1", c[6]) for c in candidates], CANDIDATE)
        hashes = [c[4] for c in candidates]
        recs = [(h, record(0, f"p/{h}", "q/Base", methods=[(methods, "()V", 1)], mrefs=[("ext/X", "call", "()V", 2), (f"p/{h}", methods, "()V", 1)])) for h in hashes]
        flat = df([r for _, r in recs], CLASS_RECORD).withColumn("sha1", F.substring("name", 3, 100))
        self.records = flat.drop("artifact_id")
        self.data = df([(h, "data/n/tags/t.json", '{"values":["a"]}') for h in hashes], "sha1 string, path string, content string")
        self.extensions = df([(h, '{"entries":[{"enum":"E","name":"N","constructor":"()V","parameters":[]}]}') for h in hashes], "sha1 string, content string")
        self.metadata = df([(c[4], "1", c[5], ["x"], None) for c in candidates], "sha1 string, version string, name string, ids array<string>, coordinates string")
        self.digests = df([("b", "tb", "D")], "catalogue string, project_id string, digest string")
        self.files = df([], "catalogue string, project_id string, sha1 string")

    def run(self, store):
        return index_run.run_batch(store, self.candidates, self.records, self.data, self.extensions, self.metadata, self.digests, self.files)


def snapshot(store, rows):
    without_date = lambda t: [c for c in store.schemas[t].names if c != "index_date"]
    return {t: rows(store.read(t), *without_date(t)) for t in store.schemas if t != "outcomes"}


def test_runs_are_repeatable_and_resolve_across_catalogues(spark, store, rows):
    first = Batch(spark, [("c1", "b", "tb", "f1", "h1", "Thing", "D"), ("c2", "a", "7", "f2", "h2", "Other", "E")])
    assert {r.outcome for r in first.run(store).collect()} == {"new"}
    once = snapshot(store, rows)
    assert len(once["class_defs"]) == 2 and len(once["tags"]) == 2 and len(once["extensions"]) == 2
    assert rows(store.read("method_references"), "owner", "count") == [("ext/X", 2), ("ext/X", 2), ("p/h1", 1), ("p/h2", 1)]
    assert {r.outcome for r in first.run(store).collect()} == {"known"}
    assert snapshot(store, rows) == once

    # The same content appears in the other catalogue, and a project gets a new file.
    second = Batch(spark, [("c3", "a", "9", "f3", "h3", "Thing", "D"), ("c4", "a", "7", "f4", "h4", "Other", "E")], methods="n")
    got = {r.candidate_id: r.outcome for r in second.run(store).collect()}
    assert got == {"c3": "same_name", "c4": "project"}
    assert rows(store.read("artifacts"), "id", "int_project_id", "text_project_id") == [(1, 9, "tb"), (2, 7, None)]
    assert {r.name for r in store.read("method_defs").collect()} == {"n"}
    assert rows(store.read("known_files")) == [(1, "h1"), (1, "h3"), (2, "h2"), (2, "h4")]
    assert rows(store.read("known_file_ids"), "catalogue", "file_id") == [("a", "f2"), ("a", "f3"), ("a", "f4"), ("b", "f1")]


STEPS = ["tags", "artifacts"]  # among the facts, which change together, and after them


@pytest.mark.parametrize("lost_at", STEPS)
def test_a_lost_run_is_not_seen_and_its_ids_are_free(spark, store, rows, monkeypatch, lost_at):
    """The driver goes between two tables, and the next run is about other files."""
    Batch(spark, [("c1", "a", "1", "f1", "h1", "A", "x")]).run(store)
    before = snapshot(store, rows)
    append = Change.append

    def stops(self, table, new, keys):
        append(self, table, new, keys)
        if table == lost_at:
            raise OSError("lost")

    monkeypatch.setattr(Change, "append", stops)
    with pytest.raises(OSError):
        Batch(spark, [("c2", "a", "2", "f2", "h2", "B", "y"), ("c3", "a", "3", "f3", "h3", "C", "z")]).run(store)
    assert snapshot(store, rows) == before
    monkeypatch.setattr(Change, "append", append)
    pinned = store.snapshot()
    Batch(spark, [("c4", "a", "4", "f4", "h4", "D", "w")]).run(store)
    assert rows(store.read("artifacts"), "id", "name") == [(1, "A"), (2, "D")]
    assert rows(store.read("class_defs")) == [(1, 0, "p/h1"), (2, 0, "p/h4")]
    assert rows(store.read("tags"), "artifact_id") == [(1,), (2,)]
    # A reader that began before sees all twelve tables as they were.
    assert snapshot(pinned, rows) == before
    after = snapshot(store, rows)
    dead = store.vacuum()
    assert dead[lost_at] and snapshot(store, rows) == after
    assert not any(store.vacuum().values())


def test_snapshots_are_not_changed(store):
    with pytest.raises(ValueError):
        store.snapshot().replace("known_files", store.read("known_files"), store.read("known_files").select("sha1"))


def test_compacted_store_reads_alike(spark, store, rows, tmp_path):
    for version in "nm":
        Batch(spark, [("c1", "a", "1", "f1", f"h{version}", "A", "x")], methods=version).run(store)
    target = store.compact(str(tmp_path / "compact"))
    assert snapshot(target, rows) == snapshot(store, rows) and len(rows(target.read("class_defs"))) == 1
    Batch(spark, [("c2", "a", "2", "f2", "h2", "B", "y")]).run(target)
    assert rows(target.read("artifacts"), "id") == [(1,), (2,)]


def test_a_batch_is_renamed(spark, store, rows):
    batch = Batch(spark, [("c1", "a", "1", "f1", "h1", "A", "x")], methods="m_7")
    mapping = spark.createDataFrame([("method", "m_7", "tick"), ("class", "ext/X", "no/X")], "kind string, original string, mapped string")
    index_run.run_batch(store, batch.candidates, batch.records, batch.data, batch.extensions, batch.metadata, batch.digests, batch.files, renames={"mapping": mapping})
    assert rows(store.read("method_defs"), "name") == [("tick",)]
    assert rows(store.read("method_references"), "owner", "name") == [("ext/X", "call"), ("p/h1", "tick")]


def test_known_hash_under_another_project_merges(spark, store, rows):
    Batch(spark, [("c1", "a", "1", "f1", "h1", "A", "x"), ("c2", "b", "t", "f2", "h2", "B", "y")]).run(store)
    got = Batch(spark, [("c3", "b", "t", "f3", "h1", "A", "x")]).run(store).collect()[0]
    assert (got.outcome, got.artifact_id, got.merge_id) == ("known", 1, 2)
    assert rows(store.read("artifacts"), "id", "int_project_id", "text_project_id") == [(1, 1, "t")]
    assert rows(store.read("known_files")) == [(1, "h1"), (1, "h2")]
    assert rows(store.read("class_defs"), "artifact_id") == [(1,)]


def test_coordinates_are_filled_only_where_missing(spark, store, rows):
    Batch(spark, [("c1", "a", "1", "f1", "h1", "A", "x"), ("c2", "a", "2", "f2", "h2", "B", "y")]).run(store)
    loose = Batch(spark, [("c3", None, None, None, "h1", "A", "x")])
    loose.candidates = loose.candidates.withColumn("coordinate", F.lit("g:a"))
    loose.run(store)
    given = spark.createDataFrame([("1", "g:other"), ("2", "g:b")], "project_id string, coordinate string")
    index_run.fill_missing_coordinates(store, "a", given)
    assert rows(store.read("artifacts"), "id", "coordinates") == [(1, "g:a"), (2, "g:b")]


def test_loader_artifacts(spark, store, rows):
    batch = Batch(spark, [("c1", "a", "1", "f1", "h1", "A", "x")])
    batch.run(store)
    named = spark.createDataFrame([("g:loader", "h1")], "coordinates string, sha1 string")
    for _ in range(2):
        index_run.run_loader(store, named, batch.records, batch.metadata)
    assert rows(store.read("artifacts"), "id", "loader", "coordinates") == [(1, False, None), (2, True, "g:loader")]
    assert rows(store.read("class_defs"), "artifact_id") == [(1,), (2,)]
    assert rows(store.read("method_references"), "artifact_id") == [(1,), (1,)]
    assert rows(store.read("known_files")) == [(1, "h1")]


def test_landing_reader_prunes_scopes(spark, tmp_path):
    path = str(tmp_path / "records")
    scoped = spark.createDataFrame([record(1, "A"), record(2, "B")], CLASS_RECORD).withColumns({
        "game_version": F.concat(F.lit("1."), F.col("artifact_id").cast("string")), "loader": F.lit("x")})
    scoped.write.partitionBy("game_version", "loader").parquet(path)
    df = read(spark, "class_records", path)
    assert set(TABLES["class_records"].names) < set(df.columns)
    one = df.where("game_version = '1.2'")
    assert one.select("name").collect()[0][0] == "B"
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(game_version" in plan


def test_stream_hands_over_new_files_only(spark, tmp_path):
    landing, state, seen = str(tmp_path / "in"), str(tmp_path / "state"), []
    put = lambda n: spark.range(n, n + 1).write.mode("append").parquet(landing)
    run = lambda: ingest(spark, landing, spark.range(0).schema, lambda df, _: seen.append(sorted(r.id for r in df.collect())), state).awaitTermination()
    put(1), run(), run(), put(2), put(3), run()
    assert [s for s in seen if s] == [[1], [2, 3]]


def test_bad_candidates_do_not_stop_the_others(spark, store, rows):
    """One file that cannot be read, one with a record without name, one that breaks a rule; then they come mended."""
    files = [(f"c{i}", "a", str(i), f"f{i}", f"h{i}", f"N{i}", f"d{i}") for i in range(1, 6)]
    Batch(spark, files[:1]).run(store)
    batch = Batch(spark, files)
    broken = F.when(F.col("sha1") == "h4", F.array(F.lit("i/I"), F.lit("i/I"))).otherwise(F.col("interfaces"))
    batch.records = batch.records.withColumns({"interfaces": broken, "name": F.when(F.col("sha1") != "h3", F.col("name"))})
    failures = spark.createDataFrame([("h2", "no archive"), ("h2", "z"), ("h1", "known files are not read")], "sha1 string, error string")
    run = lambda b, **kw: dict(
        candidates=b.candidates, records=b.records, data_files=b.data, extension_files=b.extensions, metadata=b.metadata, digests=b.digests, project_files=b.files, **kw)
    got = index_run.run_steps(store, [("one", lambda _: run(batch, failures=failures))])
    assert rows(got, "candidate_id", "outcome", "error") == sorted([
        ("c1", "known", None), ("c2", "index_failed", "no archive"), ("c3", "index_failed", "a record lacks its name or a list"),
        ("c4", "store_failed", "parent listed twice: p/h4"), ("c5", "new", None)], key=repr)
    assert rows(index_run.summary(got)) == [("one", 4, 2, 1, 1, 3)]
    stored = rows(store.read("artifacts"), "name")
    assert stored == [("N1",), ("N5",)] and rows(store.read("known_files"), "sha1") == [("h1",), ("h5",)]
    assert rows(store.read("class_defs"), "class_name") == [("p/h1",), ("p/h5",)] and rows(store.read("known_file_ids"), "file_id") == [("f1",), ("f5",)]
    # The step has outcomes, so it is left out; the next one brings the files as they should be.
    steps = [("one", lambda _: 1 / 0), ("two", lambda _: run(Batch(spark, files)))]
    done = index_run.run_steps(store, steps)
    assert rows(done.where("label = 'two'"), "candidate_id", "outcome") == [("c1", "known"), ("c2", "new"), ("c3", "new"), ("c4", "new"), ("c5", "known")]
    assert len(rows(store.read("class_defs"))) == len({r.id for r in store.read("artifacts").collect()}) == 5


def test_stored_dictionaries_keep_ids_and_lost_runs_leave_none(spark, tmp_path, rows, monkeypatch):
    held = Dictionaries(spark, str(tmp_path / "d")).create()
    of = lambda *recs: flatten.flatten_records(spark.createDataFrame(list(recs), CLASS_RECORD))
    one = record(1, "p/A", "q/Base", methods=[("m", "()V", 1)], mrefs=[("ext/X", "call", "()V", 2)])
    two = record(2, "p/B", None, methods=[("m", "()V", 1), ("a", "()I", 1)], mrefs=[("p/A", "m", "()V", 1)])
    held.extend(of(one))
    first = {name: rows(held.read(name), "id", *KEYS[name]) for name in KEYS}
    assert first["classes"] == [(1, "ext/X"), (2, "p/A"), (3, "q/Base")]
    assert first["constants"] == [(1, "()V"), (2, "call"), (3, "m")]
    assert first["methods"] == [(1, 1, 2, 1), (2, 2, 3, 1)] and first["fields"] == []

    # A run that is lost before its publication leaves nothing to be seen, and its ids stay free.
    with monkeypatch.context() as patch:
        patch.setattr(Dictionaries, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            held.extend(of(record(9, "lost/C", "lost/D")))
    assert {name: rows(held.read(name), "id", *KEYS[name]) for name in KEYS} == first
    held.extend(of(one, two))
    held.extend(of(one, two))
    assert rows(held.read("classes"), "id", "name") == [*first["classes"], (4, "p/B")]
    assert rows(held.read("constants"), "id", "constant") == [*first["constants"], (4, "()I"), (5, "a")]
    assert rows(held.spelled("methods"), "id", "owner", "name", "descriptor") == [
        (1, "ext/X", "call", "()V"), (2, "p/A", "m", "()V"), (3, "p/B", "m", "()V"), (4, "p/B", "a", "()I")]
    coded = held.encode(of(one, two, record(3, "not/Known", None)))
    assert rows(coded["class_defs"], "artifact_id", "class_name") == [(1, 2), (2, 4), (3, None)]
    assert rows(coded["method_references"], "class_name", "member", "count") == [(2, 1, 2), (4, 2, 1)]
    assert rows(coded["method_defs"], "class_name", "member") == [(2, 2), (4, 3), (4, 4)]


def test_annotation_texts_of_the_index_become_ids_of_json_values(spark, tmp_path, rows):
    held = Dictionaries(spark, str(tmp_path / "d")).create()
    held.extend_values(spark.createDataFrame([('{"k":1}',), (None,)], "value string"))
    texts = spark.createDataFrame([(7, "b=true"), (8, "k=1"), (9, "k=1.0"), (10, None)], "id long, constant string")
    facts = spark.createDataFrame([(1, 7), (2, 8), (3, 9), (4, 10)], "owner long, value long")
    got = held.convert_annotations(texts, facts)
    assert rows(held.read("json_values"), "id", "value") == [(1, '{"k":1}'), (2, '{"b":true}'), (3, "{}")]
    assert rows(got, "owner", "value") == [(1, 2), (2, 1), (3, 1), (4, 3)]


def test_whole_metadata_is_stored_and_browsed_at_one_publication(spark, store, rows):
    def batch(license, name):
        made = Batch(spark, [("c1", "a", "1", "f1", f"h{license}", name, "x"), ("c2", "b", "tb", "f2", f"i{license}", "B", "y")])
        whole = F.struct(F.lit(license).alias("license"), F.lit("N. N.").alias("authors"), F.lit('[{"id":"in","version":"1"}]').alias("nested_tree"),
                         F.lit("text").alias("metadata"), F.lit('{"modLoader":"l"}').alias("metadata_json"), F.lit('{"":{}}').alias("manifest"))
        made.metadata = made.metadata.select("*", F.inline(F.array(whole)))
        return made

    empty = Browser(store)
    batch("MIT", "A").run(store)
    before = Browser(store)
    batch("BSD", "Z").run(store)
    now = Browser(store)
    assert rows(empty.list()) == [] and rows(empty.facets()) == []
    assert rows(before.list(), "artifact_name", "license", "language_loader", "pid") == [("A", "MIT", "l", "1"), ("B", "MIT", "l", "tb")]
    assert rows(now.list(), "artifact_name", "license") == [("B", "BSD"), ("Z", "BSD")]
    stored = ["license", "authors", "nested_tree", "metadata", "metadata_json", "manifest"]
    assert rows(now.artifacts(), *stored)[0] == ("BSD", "N. N.", '[{"id":"in","version":"1"}]', "text", '{"modLoader":"l"}', '{"":{}}')
    assert rows(now.list([Filter(listing.CLASS_NAME, "=", "p/hBSD")]), "artifact_name") == [("Z",)]
    assert rows(now.list([Filter(listing.CLASS_NAME, "=", "p/hMIT")])) == []
    assert rows(now.count([Filter(listing.CONTAINED, "=", "in")])) == [(2,)]
    packs = spark.createDataFrame([("k", 1)], "pack_id string, int_project_id int")
    assert rows(now.list([Filter(listing.IN_PACK, "=", "k")], packs), "pid") == [("1",)]
    asked = spark.createDataFrame([("1",), ("tb",), ("9",), (None,)], "pid string")
    assert rows(before.classes(asked)) == [("1", "p/hMIT"), ("tb", "p/iMIT")]
    assert rows(now.classes(asked)) == [("1", "p/hBSD"), ("tb", "p/iBSD")]
    assert {r["value"] for r in now.facets().where("facet = 'License'").collect()} == {"BSD"}
    assert rows(now.containing([Filter(listing.CONTAINED, "=", "in")]), "name") == [("B",), ("Z",)]
    keys = spark.createDataFrame([("name", "Z")], "kind string, key string")
    assert rows(now.lookup(keys), "key") == [("Z",)]


def test_reads_of_a_few_keys_do_not_shuffle_the_table(spark, store, rows):
    Batch(spark, [(f"c{n}", "a", str(n), f"f{n}", f"h{n}", f"A{n}", "x") for n in range(1, 9)]).run(store)
    wanted = spark.createDataFrame([(2,), (5,), (77,)], "artifact_id bigint")
    few = store.read_keys("class_defs", wanted)
    assert rows(few, "artifact_id") == [(2,), (5,)]
    assert "Exchange hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()


def test_records_of_a_run_move_packed_and_large_tables_are_dense(spark, store, rows, monkeypatch):
    given, write = {}, index_run.condense

    def seen(df, label):
        given[label] = df
        return write(df, label)

    monkeypatch.setattr(index_run, "condense", seen)
    batch = Batch(spark, [("c1", "a", "1", "f1", "h1", "A", "x"), ("c2", "a", "2", "f2", "h2", "B", "y")])
    batch.run(store)
    assert "to_variant_object" in given["records"]._jdf.queryExecution().optimizedPlan().toString()
    assert {"records", "resolved"} <= set(given)
    facts = store.read("class_defs")
    assert rows(facts, "class_name") == [("p/h1",), ("p/h2",)]
    assert any(path.endswith(".zstd.parquet") for path in facts.inputFiles())
