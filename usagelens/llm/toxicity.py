"""Toxicity: non-negative positive-unlabelled learning of a linear model on word evidence.

Learning sees confirmed toxic documents and unlabelled ones; no document counts as clean.
The risk of a scorer g, with prior p of toxic documents and sigmoid loss, is

    p * E_toxic[loss(g)] + max(0, E_unlabelled[loss(-g)] - p * E_toxic[loss(-g)])

The second term estimates the loss on clean documents; where it is negative, the step goes the other way and undoes overfitting.

Evidence are words and word starts, in lower case, that confirmed documents carry
more often than unlabelled ones by ``SURE`` standard deviations; none speaks against
toxicity, so a long text does not outweigh what it says. Their value in a document grows with the number of its distinct
words that carry them, so one rare word in a long text counts as much as in a short one.

Learning takes at most ``SAMPLE`` confirmed and twice as many unlabelled documents, in the
order of a hash of their ids; the prior is counted over all labels. Scoring reads whole
texts of all documents.

Null texts count as empty; a text without evidence has the score of the bias. Without
labels, or confirmed documents, every score is the prior. Rows with equal ids are scored
one by one; labels with null or repeated ids or null values are left out.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_remainder, whole_text

SAMPLE = 3_000
LEAST = 3
SURE = 5.0  # standard deviations
STARTS = (4, 5, 6, 7, 8)
STEPS = 1_500
RATE = 2.0
DECAY = 1e-4
SKETCH = 16
WORD = re.compile(r"[^\W\d_]+")


def evidence(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in STARTS if n < len(word)]]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def _matrix(texts: list[set[str]], places: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    rows = []
    for words in texts:
        found = Counter(places[e] for word in words for e in evidence(word) if e in places)
        rows.append((np.fromiter(found.keys(), np.int64, len(found)), np.log2(1 + np.fromiter(found.values(), np.float64, len(found)))))
    return rows


def _apart(texts: list[set[str]]) -> list[set[str]]:
    """Without documents that share half of their ``SKETCH`` least word hashes with an earlier one."""
    holders: dict[int, list[int]] = {}
    kept = []
    for words in texts:
        sketch = sorted(zlib.crc32(word.encode("utf-8", "surrogatepass")) for word in words)[:SKETCH]
        shared = Counter(i for value in sketch for i in holders.get(value, ()))
        if sketch and max(shared.values(), default=0) * 2 < len(sketch):
            for value in sketch:
                holders.setdefault(value, []).append(len(kept))
            kept.append(words)
    return kept


def _telling(positive: list[set[str]], rest: list[set[str]]) -> list[str]:
    """Evidence that toxic documents carry more often than unlabelled ones, beyond chance."""
    seen = Counter(e for words in positive for e in {e for word in words for e in evidence(word)})
    seen = {e: n for e, n in seen.items() if n >= LEAST}
    other = Counter(e for words in rest for e in {e for word in words for e in evidence(word)} if e in seen)
    names = []
    for e, n in seen.items():
        share, base = n / len(positive), other[e] / len(rest)
        spread = max((n + other[e]) / (len(positive) + len(rest)), 1e-9)
        deviation = (share - base) / np.sqrt(spread * (1 - min(spread, 0.999)) * (1 / len(positive) + 1 / len(rest)))
        if deviation >= SURE:
            names.append(e)
    return sorted(names)


def fit(toxic: list[str], unlabelled: list[str], prior: float) -> dict:
    """Weights of the evidence, and the bias."""
    # Copies of one document are no independent observations.
    positive, rest = _apart([words_of(text) for text in toxic]), _apart([words_of(text) for text in unlabelled])
    if not positive or not rest:
        return {"bias": float(np.log(prior / (1 - prior))), "weights": {}}
    names = _telling(positive, rest)
    places = {e: i for i, e in enumerate(names)}
    groups = _matrix(positive, places), _matrix(rest, places)
    weights, bias = np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    moved = np.zeros(len(names) + 1)

    def flat(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        return owner, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), len(rows)

    def gradient(rows: tuple, target: float) -> tuple[float, np.ndarray]:
        """Mean sigmoid loss for the target sign, and its gradient."""
        owner, columns, values, n = rows
        margin = target * (np.bincount(owner, weights=weights[columns] * values, minlength=n) + bias)
        loss = 1 / (1 + np.exp(np.clip(margin, -40, 40)))
        slope = -target * loss * (1 - loss) / n
        return loss.mean(), np.append(np.bincount(columns, weights=slope[owner] * values, minlength=len(names)), slope.sum())

    known, mixed = (flat(rows) for rows in groups)
    for _ in range(STEPS):
        _, up = gradient(known, 1)
        wrong, back = gradient(known, -1)
        other, down = gradient(mixed, -1)
        clean = down - prior * back
        step = prior * up + (clean if other - prior * wrong >= 0 else -clean)
        step[:-1] += DECAY * weights
        moved = 0.9 * moved - RATE * step
        weights = np.maximum(weights + moved[:-1], 0)
        bias += moved[-1]
    used = np.abs(weights) > 1e-3
    return {"bias": bias, "weights": {names[i]: float(weights[i]) for i in np.flatnonzero(used)}}


class Scorer:
    """Scores texts. Most words share no first letters with any evidence and are passed over."""

    def __init__(self, model: dict):
        self.weights, self.bias = model["weights"], model["bias"]
        self.heads = {e.rstrip("*")[:STARTS[0]] for e in self.weights}

    def score(self, text: str) -> float:
        weights, heads, head = self.weights, self.heads, STARTS[0]
        hits = [word for word in words_of(text) if word[:head] in heads]
        found = Counter(e for word in hits for e in evidence(word) if e in weights)
        value = self.bias + sum(weights[e] * float(np.log2(1 + n)) for e, n in sorted(found.items()))
        return float(1 / (1 + np.exp(-np.clip(value, -40, 40))))


def train(docs: DataFrame, labels: DataFrame, rows: Column, sample: int = SAMPLE) -> bytes:
    """Fit on documents whose ids ``rows`` (a condition on ``_id``) allows."""
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
        .where(rows).where("_toxic IN (0, 1) AND _id IS NOT NULL").dropDuplicates(["_id"])
    )
    counted = known.agg(F.sum("_toxic").alias("toxic"), F.count(F.lit(1)).alias("all")).first()
    prior = ((counted["toxic"] or 0) + 1) / (counted["all"] + 2)
    nothing = json.dumps({"bias": float(np.log(prior / (1 - prior))), "weights": {}}).encode()
    if not counted["toxic"]:
        return nothing
    order = [F.xxhash64("_id"), F.col("_id")]
    confirmed = known.where("_toxic = 1").orderBy(*order).limit(sample).select("_id", F.lit(1).alias("_group"))
    # Unlabelled: labelled or not, toxic or not; nothing is known of them here.
    anything = (
        docs.select(F.col("doc_id").alias("_id")).where(rows).where("_id IS NOT NULL")
        .orderBy(F.xxhash64("_id", F.lit(1)), "_id").limit(2 * sample).select("_id", F.lit(0).alias("_group"))
    )
    # At most three times ``sample`` ids.
    texts = docs.select(F.col("doc_id").alias("_id"), whole_text().alias("_text")).join(
        F.broadcast(confirmed.union(anything)), "_id"
    )

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_group", "_id", "_text"])
        toxic, rest = (rows["_text"][rows["_group"] == group].tolist() for group in (1, 0))
        model = json.dumps(fit(toxic, rest, prior)).encode() if toxic and rest else nothing
        return pd.DataFrame({"model": [model]})

    found = texts.groupBy().applyInPandas(learn, "model binary").collect()
    return found[0]["model"] if found else nothing


def score(model: bytes, text: str = "text") -> Column:
    """The score of a text column under a trained model."""
    scorers: list[Scorer] = []

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not scorers:
            scorers.append(Scorer(json.loads(model)))
        return pd.Series([scorers[0].score(t) for t in texts], dtype="float64")

    return scored(whole_text(text))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, crc_remainder("_id", folds) != held)
    return docs.select(
        "doc_id", (crc_remainder("doc_id", folds) == held).alias("held_out"), score(model).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """The documents whose score stays below the threshold, with their own columns."""
    model = train(docs, labels, crc_remainder("_id", folds) != held)
    return docs.where(score(model) < threshold)
