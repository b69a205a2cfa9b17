"""Classifiers, duplicates, fingerprints and shards against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from usagelens.llm import chunk_dedup, quality, sharding, simhash, syncmers, toxicity
from usagelens.llm.common import crc_remainder, numbered
from usagelens.llm.components import components
from usagelens.session import materialize

TABLES = "/root/testdata/sf0.01"


def labelled(llm):
    return llm.read.parquet(f"{TABLES}/documents.parquet"), llm.read.parquet(f"{TABLES}/labels.parquet")


# ------------------------------------------------------------------ classifiers


@pytest.mark.parametrize("operator, label, folds, held", [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_held_out_accuracy(llm, operator, label, folds, held):
    docs, labels = labelled(llm)
    scored = operator.classify(docs, labels, folds=folds, held=held)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", label).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r[label] for r in out) >= 0.9 * len(out)


@pytest.mark.parametrize("operator, label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_are_not_learned(llm, operator, label):
    docs, labels = labelled(llm)
    rows = crc_remainder("_id", 5) != 0
    flipped = labels.withColumn(label, F.when(crc_remainder("doc_id", 5) == 0, 1 - F.col(label)).otherwise(F.col(label)))
    few = docs.limit(300)
    assert operator.train(few, labels, rows, sample=60) == operator.train(few, flipped, rows, sample=60)


@pytest.mark.parametrize("operator, keep", [(quality, quality.keep_good), (toxicity, toxicity.keep_clean)])
def test_classifiers_on_odd_tables(llm, odd, none, operator, keep):
    _, labels = labelled(llm)
    strange = labels.union(llm.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1), (2, 0, 0)], labels.schema))
    assert operator.classify(odd, strange).count() == odd.count()
    assert operator.classify(none, labels).count() == 0
    scores = {r["score"] for r in operator.classify(odd, labels.limit(0)).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1
    kept = keep(odd, labels.limit(0))
    assert kept.columns == odd.columns


def test_positive_unlabelled_risk_needs_no_clean_labels():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    text = lambda bad: " ".join(rng.sample(words, 40) + (rng.sample(["zork", "zorkian", "quop", "vlim"], 2) if bad else []))
    model = toxicity.fit([text(True) for _ in range(200)], [text(i % 10 == 0) for i in range(1000)], 0.1)
    scorer = toxicity.Scorer(model)
    assert np.mean([scorer.score(text(True)) >= 0.3 for _ in range(100)]) > 0.95
    assert np.mean([scorer.score(text(False)) < 0.3 for _ in range(100)]) > 0.98


def test_average_of_vectors_is_what_is_scored():
    model = np.random.default_rng(1).normal(size=quality.BUCKETS + 1).astype("<f4")
    for text in ("", "one", "one one two, three!! one", "é日本 x"):
        buckets, shares = quality.document_features(text)
        value = float((model[buckets].astype(float) * shares).sum() + model[-1])
        assert quality.Scorer(model).score_many([text])[0] == pytest.approx(1 / (1 + np.exp(-value)), abs=1e-5)


# ----------------------------------------------------------------- exact copies


def plain_groups(rows):
    key = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(key(text), []).append(doc_id)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(
        (
            (doc_id, least(groups[key(text)]), len(groups[key(text)]), doc_id == least(groups[key(text)]), hashlib.sha256(key(text).encode()).hexdigest())
            for doc_id, text in rows
        ), key=repr,
    )


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_copies(odd, none, rows, bits):
    """With three bits nearly all chunks share their hash with others and have to be told apart."""
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    found = rows(chunk_dedup.groups(odd, bits=bits, every=2), *columns)
    assert found == plain_groups([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert chunk_dedup.groups(none, bits=bits).count() == 0


def test_first_copies_stay(odd):
    kept = chunk_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1, 10: 1, 11: 1, None: 1})


def test_chunks_join_to_their_text(llm, small):
    docs, _ = small
    norm = docs.select(chunk_dedup.normalised().alias("t"))
    pieces = norm.select("t", chunk_dedup.chunks(F.col("t"), 8).alias("c"))
    assert pieces.where(~F.array_join("c", " ").isin(F.col("t"), F.concat("t", F.lit(" ")))).count() == 0
    assert pieces.agg(F.sum(F.size("c"))).first()[0] > 2 * docs.count()


# ------------------------------------------------------------------ near copies


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_copies(small):
    docs, texts = small
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    found = {r["doc_id"]: r for r in simhash.groups(docs).collect()}
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in found.items()} == plain_components(prints)


def test_links_by_segments(llm, rows):
    """Fingerprints around one centre, with differences at all places of both segments."""
    rng = random.Random(5)
    prints = {0: rng.getrandbits(64)}
    for i in range(1, 300):
        flips = rng.sample(range(64), rng.choice([1, 2, 3, 4, 5]))
        prints[i] = prints[rng.randrange(i)] ^ sum(1 << b for b in flips)
    seen = {}
    prints = {i: p for i, p in prints.items() if seen.setdefault(p, i) == i}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    classes = llm.createDataFrame([(signed(p), i) for i, p in prints.items()], "fp bigint, id bigint")
    found = {(min(a, b), max(a, b)) for a, b in rows(simhash.links(classes), "a", "b")}
    assert found == {(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 3}


def test_near_copies_of_odd_rows(odd, none):
    found = simhash.groups(odd).collect()
    assert len(found) == odd.count()
    assert all(r["component_id"] is None for r in found if r["doc_id"] is None)
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["fingerprint"] for r in found if r["doc_id"] in (1, 2, 3)} == {"0" * 16}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([None, 1, 4, 5, 6, 8, 10, 11])
    assert [r["text"] for r in kept.collect() if r["doc_id"] is None] == ["a b c d"]
    assert simhash.groups(none).count() == simhash.keep_one(none).count() == 0


def test_one_near_copy_stays_whatever_its_id(llm):
    """Near copies without any id, repeated rows, and rows with one id and different texts."""
    rng = random.Random(4)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(400))
    bits = lambda text: (plain_fingerprint(long) ^ plain_fingerprint(text)).bit_count()
    near = next(text for text in (f"{long} and {i} more" for i in range(99)) if 1 <= bits(text) <= 3)
    data = [(None, "only nulls here " * 9), (None, "only nulls here " * 9), (5, long), (5, long), (9, near), (None, near), (7, "other words"), (7, "and others")]
    kept = simhash.keep_one(llm.createDataFrame(data, "doc_id bigint, text string"))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted({data[0], data[2], data[6], data[7]}, key=repr)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(random.Random(2).choices(["a", "bb", "Ccc", "dddd\t", "é"], k=5000))
    monkeypatch.setattr(simhash, "PIECE", 50)
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_components(llm, rows):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = dict(rows(components(llm.createDataFrame(edges, "a bigint, b bigint")), "node", "component"))
    assert all(found.get(n, n) == find(n) for n in root)


# ----------------------------------------------------------------- fingerprints


def test_edited_texts(small):
    docs, texts = small
    found = {r["doc_id"]: r for r in syncmers.neighbours(docs).collect()}
    ids = sorted(texts)
    for i, n in zip(ids, ids[1:] + ids[:1]):
        text, q = texts[i], len(texts[i]) // 4
        edited = text[:len(text) - q] + texts[n][:q]
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[i]["n_chars"] == len(text)
    by_text = {}
    for i in ids:
        assert by_text.setdefault(texts[i], found[i]["fingerprint"]) == found[i]["fingerprint"]
    assert np.mean([r["near_edited"] > 0.4 for r in found.values()]) > 0.9
    assert np.mean([r["near_next"] < 0.1 for r in found.values()]) > 0.95


def test_syncmers_are_found_in_any_context(llm):
    """Anchors of a passage by plain code, and the same anchors with other text around it."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(1, 8))) for _ in range(300)]
    passage = " ".join(words[100:200])
    table = llm.createDataFrame([(1, " ".join(words)), (2, passage), (3, "x y z " + passage + " q r s")], "doc_id bigint, text string")
    found = {}
    for r in syncmers.anchors(table).collect():
        found.setdefault(r["doc_id"], {})[r["position"]] = r["hash"]
    assert {p + 100: h for p, h in found[2].items()}.items() <= found[1].items()
    assert {p + 3: h for p, h in found[2].items()}.items() <= found[3].items()
    hashes = [r[0] for r in llm.createDataFrame([(w,) for w in words[100:200]], "w string").select(F.xxhash64("w")).collect()]
    pairs = [r[0] for r in llm.createDataFrame(list(zip(range(99), hashes, hashes[1:])), "i int, a bigint, b bigint").orderBy("i").select(F.xxhash64("a", "b")).collect()]
    chosen = [i for i in range(93) if min(pairs[i:i + 7]) in (pairs[i], pairs[i + 6])]
    assert sorted(found[2]) == chosen


def test_fingerprints_of_odd_rows(odd, none, llm):
    rows = syncmers.neighbours(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["fingerprint"] == "" and r["n_chars"] == 0 for r in rows if r["doc_id"] in (1, 2))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    only = syncmers.neighbours(llm.createDataFrame([(5, "abcd efgh")], "doc_id bigint, text string")).first()
    assert only["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and only["near_next"] == 1
    assert syncmers.neighbours(none).count() == 0


# ----------------------------------------------------------------------- shards


def shards_right(rows, texts):
    assert {r["law"] for r in rows} == {"rows"}
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(8)) and max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(counts[shard]))
    held = Counter((r["size"], r["text_crc32"]) for r in rows)
    assert held == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)


def test_shards_keep_groups_together(small):
    docs, texts = small
    rows = sharding.assign(docs).collect()
    shards_right(rows, texts.values())
    spread = {}
    for r in rows:
        spread.setdefault(texts[r["doc_id"]], []).append(r["shard"])
    assert all(len(set(found)) == 1 for found in spread.values() if len(found) <= len(texts) // 8)


def test_a_group_larger_than_a_shard_fills_one(llm):
    data = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(1200)]
    rows = sharding.assign(llm.createDataFrame(data, "doc_id bigint, text string")).collect()
    shards_right(rows, [t for _, t in data])
    hot = Counter(r["shard"] for r in rows if r["doc_id"] % 3 == 0)
    assert max(hot.values()) == 150


def test_shards_of_odd_rows(odd, none):
    shards_right(sharding.assign(odd).collect(), [r["text"] for r in odd.collect()])
    assert sharding.assign(none).count() == 0


def test_numbers_are_gapless(llm, rows):
    table = materialize(llm.range(5000).selectExpr("id", "id % 3 AS g", "IF(id % 10 = 0, 0, 1) AS class_c"), "test")
    found = rows(numbered(table, ["g"], ["class_c", "id"], "n", 16), "g", "n", "class_c")
    for g in range(3):
        mine = sorted((n, c) for h, n, c in found if h == g)
        assert [n for n, _ in mine] == list(range(len(mine)))
        assert [c for _, c in mine] == sorted(c for _, c in mine)
