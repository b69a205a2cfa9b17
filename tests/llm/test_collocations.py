"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from usagelens.llm import collocations

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(data, longest=5, least=100, top=2000, percent=100):
    counts, totals = Counter(), Counter()
    for lang, text in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in counts.items() if len(key[1]) >= 2 and a >= least}
    covered = {}
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                key = lang, words[i:i + k]
                covered[key] = max(covered.get(key, 0), a)
    by_lang = defaultdict(list)
    for (lang, words), a in candidates.items():
        if 100 * covered.get((lang, words), 0) >= percent * a:
            continue
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]], k) for k in range(1, len(words))]
        score, k, l, r = min((1000 * a * totals[lang] // (l * r), k, l, r) for l, r, k in cuts)
        by_lang[lang].append((-score, -a, " ".join(words).encode(), l, r))
    return sorted(
        (lang, rank, phrase.decode(), -a, l, r, totals[lang], -score)
        for lang, found in by_lang.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1)
    )


def texts(seed, many):
    """Documents of few words, with set phrases, marks, white space of all kinds and capitals."""
    rng = random.Random(seed)
    words = ["Aa", "b", "C", "dd", "É", "e", "日本", "x y", "f"]
    phrases = ["new York city", "in order to be", "aa b C dd e", "B c"]
    made = []
    for i in range(many):
        parts = rng.choices(words + phrases * 2 + [".", ",", "\n", "!?", ";", "\t", "  ", "\x0b"], k=rng.randint(0, 60))
        made.append((rng.choice(["en", "en", "de", None, "und"]), "".join(p if rng.random() < 0.1 else p + " " for p in parts)))
    return made + [("en", None), (None, ""), ("de", " \n.,"), ("fr", "only here")]


@pytest.mark.parametrize("broadcast, least, percent", [(collocations.BROADCAST, 30, 100), (0, 30, 100), (collocations.BROADCAST, 60, 80)])
def test_equal_to_plain_counting(llm, rows, broadcast, least, percent):
    """Also where all dictionaries count as too large to broadcast."""
    data = texts(least, 700)
    table = llm.createDataFrame(data, "lang string, text string").withColumn("id", F.lit("clash")).withColumn("at", F.lit(1)).repartition(5)
    found = rows(collocations.mine(table, least=least, percent=percent, broadcast=broadcast))
    assert found == sorted(plain(data, least=least, percent=percent), key=repr)
    assert len(found) > 20 and {len(r[2].split(" ")) for r in found} == {2, 3, 4, 5}


def test_first_of_each_lang(llm, rows):
    data = texts(9, 500)
    table = llm.createDataFrame(data, "lang string, text string")
    assert rows(collocations.mine(table, least=20, top=7)) == sorted(plain(data, least=20, top=7), key=repr)


def test_products_pass_64_bits(llm):
    """The quotient of numbers like those of a very large corpus."""
    big = 10 ** 13
    level = lambda data: llm.createDataFrame(data, "id bigint, lang string, phrase string, last string, f bigint, left bigint, right bigint")
    words = level([(1, "en", "a", "a", 3 * big + 1, 0, 0), (2, "en", "b", "b", 2 * big + 7, 0, 0)])
    pairs = level([(1, "en", "a b", "b", big + 3, 1, 2)])
    totals = llm.createDataFrame([("en", 900 * big)], "lang string, n bigint")
    found = collocations.scored(collocations.uncovered([words, pairs]), [words, pairs], totals).first()
    assert found["score"] == 1000 * (big + 3) * 900 * big // ((3 * big + 1) * (2 * big + 7))


def test_odd_tables_and_long_pieces(llm, odd, none, rows):
    found = rows(collocations.mine(odd.drop("id").withColumn("doc", F.lit(0)), least=2))
    assert found == sorted(plain([(r["lang"], r["text"]) for r in odd.collect()], least=2), key=repr)
    assert collocations.mine(none).count() == 0
    one = [("en", "to be or not " * 30_000)] * 2
    assert rows(collocations.mine(llm.createDataFrame(one, "lang string, text string"))) == sorted(plain(one), key=repr)


def test_joins_of_relations_need_no_shuffle(llm, tmp_path):
    from usagelens.session import Scratch

    with Scratch(llm, "plan") as scratch, collocations._by_document(llm):
        made = llm.range(20_000).selectExpr("id % 50 AS doc", "CAST(id AS int) AS at", "id % 7 AS id").repartition(8, "doc")
        relations = collocations._Relations(scratch, 8, 1, 0)
        stored = relations._store(made, "at1", True)
        plan = relations.adjacent(stored)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert not llm.sql(f"SHOW DATABASES LIKE '{scratch.name}'").count()
