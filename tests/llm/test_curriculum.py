"""The curriculum against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.llm import curriculum


def plain_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), cap=2):
    """Target of every source by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    found, left, free = {}, share * sum(sizes.values()), set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= cap * sizes[s]}
        if not over:
            found |= {s: left * weight[s] / total for s in free}
            break
        found |= {s: Fraction(cap * sizes[s]) for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return order, found


def plain_mix(data):
    """(doc_id, size, source_size, target, taken, positions) of every row."""
    rows = [(i, s, len(re.findall("[^\x20\x09-\x0d]+", t or "")), hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()) for i, t, s in data]
    sizes = {}
    for _, s, size, _ in rows:
        sizes[s] = sizes.get(s, 0) + size
    order, aims = plain_targets(sizes)
    made = []
    for rank, source in enumerate(order):
        own = sorted((r for r in rows if r[1] == source), key=lambda r: r[3])
        target, goal = aims[source], int(aims[source] + Fraction(1, 2))
        start = 0
        for doc_id, _, size, _ in own:
            positions, taken = [], 0
            for turn in range(2):
                at = start + turn * sizes[source]
                words = max(0, min(size, goal - at))
                if words:
                    positions.append(plain_time(curriculum.SCHEDULES[rank % 3], at / float(target)))
                taken += words
            made.append((doc_id, size, sizes[source], float(target), taken, positions))
            start += size
    return made


def plain_time(knots, part):
    """By halving steps on the area under the schedule."""
    def area(x):
        total = 0.0
        for (t, w), (u, v) in zip(knots, knots[1:]):
            end = min(x, u)
            if end > t:
                total += (end - t) * (w + w + (v - w) * (end - t) / (u - t)) / 2
        return total

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if area(mid) < part * area(1.0) else (low, mid)
    return low


def check(table, data):
    mixed = curriculum.mix(table)
    rows = curriculum.by_document(curriculum.schedule(mixed)).collect()
    mine = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"], r["passes"]) for r in rows if r["doc_id"] is not None)
    theirs = plain_mix(data)
    assert mine == sorted((i, s, S, round(t, 6), n, len(p)) for i, s, S, t, n, p in theirs if i is not None)
    assert len(rows) == len(data)
    places = sorted(r["place"] for r in curriculum.schedule(mixed).collect() if r["place"] is not None)
    assert places == list(range(1, len(places) + 1)) and len(places) == sum(len(p) for *_, p in theirs)
    return rows, theirs


def documents(seed, many, hot=0):
    rng = random.Random(seed)
    sources = ["a", "b", "Z", "é", None, "🙂", "￿", "tiny"]
    rows = []
    for i in range(many):
        source = "hot" if i < hot else rng.choice(sources[:-1]) if i % 50 else "tiny"
        rows.append((i, " ".join(["w"] * (2 if source == "tiny" else rng.randint(0, 60))), source))
    return rows


@pytest.mark.parametrize("hot", [0, 600])
def test_equal_to_plain_mixing(llm, hot):
    data = documents(3, 900, hot)
    table = llm.createDataFrame(data, "doc_id bigint, text string, source string").repartition(6)
    rows, theirs = check(table, data)
    first = {i: p[0] for i, *_, p in theirs if p}
    for r in rows:
        assert (r["first_position"] is None) == (r["doc_id"] not in first)
        if r["doc_id"] in first:
            assert r["first_position"] == pytest.approx(first[r["doc_id"]], abs=1e-9)
    by_place = [r["first_position"] for r in sorted((r for r in rows if r["first_place"]), key=lambda r: r["first_place"])]
    assert by_place == sorted(by_place)
    taken = {}
    for r in rows:
        taken.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(sum(words) - target) <= 0.5 for (_, target), words in taken.items())
    assert any(target == 2 * size for size, target in taken) and any(target < 2 * size for size, target in taken)


def test_reruns_agree(llm, rows):
    data = documents(4, 300)
    schema = "doc_id bigint, text string, source string"
    one = curriculum.by_document(curriculum.schedule(curriculum.mix(llm.createDataFrame(data, schema).repartition(2))))
    two = curriculum.by_document(curriculum.schedule(curriculum.mix(llm.createDataFrame(data[::-1], schema).repartition(7))))
    assert rows(one) == rows(two)


def test_sources_grow_and_fade(llm):
    """Early and late thirds of training hold what the schedules say."""
    data = [(i, "w " * 10, "abc"[i % 3]) for i in range(3000)]
    mixed = curriculum.mix(llm.createDataFrame(data, "doc_id bigint, text string, source string"))
    rows = curriculum.schedule(mixed).where("place IS NOT NULL").collect()
    for kind, knots in enumerate(curriculum.SCHEDULES):
        mine = np.array([r["position"] for r in rows if r["source"] == "abc"[kind]])
        for x in (0.1, 1 / 3, 0.5, 0.9):
            (_, w), (_, v) = knots
            assert np.mean(mine < x) == pytest.approx((w * x + (v - w) * x * x / 2) / ((w + v) / 2), abs=0.01)


def test_schedules_of_any_shape(llm):
    knots = ((0, 0), (0.25, 2), (0.5, 2), (0.5 + 1 / 8, 0), (0.75, 0), (1, 1))
    parts = [i / 97 for i in range(98)]
    found = llm.createDataFrame([(p,) for p in parts], "p double").select("p", curriculum.inverse(knots, F.col("p")).alias("t")).collect()
    for r in found[:-1]:
        assert r["t"] == pytest.approx(plain_time(knots, r["p"]), abs=1e-6)
    assert curriculum.integral(knots) == Fraction(1, 4) + Fraction(1, 2) + Fraction(1, 8) + Fraction(1, 8)
    for wrong in (((0, 1), (0.5, 1)), ((0, 1), (0.5, 1), (0.5, 2), (1, 1)), ((0, -1), (1, 1)), ((0, 0), (1, 0))):
        with pytest.raises(ValueError):
            curriculum.integral(wrong)


def test_odd_tables(llm, odd, none):
    rows, _ = check(odd, [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()])
    assert sum(r["taken"] for r in rows) == round(1.5 * sum(r["size"] for r in rows))
    assert curriculum.schedule(curriculum.mix(none)).count() == 0
    empty = llm.createDataFrame([(1, None, "a"), (2, " ", None), (None, "", "a")], "doc_id bigint, text string, source string")
    rows, _ = check(empty, [tuple(r) for r in empty.collect()])
    assert all(r["target"] == 0 and r["taken"] == 0 and r["first_place"] is None for r in rows)


def test_all_full(llm):
    """A share that only the caps of all sources can hold."""
    sized = llm.createDataFrame([("a", 10), ("b", 1)], "source string, source_size bigint")
    assert sorted((r["source"], r["target"]) for r in curriculum.targets(sized, share=Fraction(2)).collect()) == [("a", 20.0), ("b", 2.0)]
