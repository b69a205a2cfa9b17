"""Quality classifier: learned vectors of hashed words and character n-grams, averaged, with a softmax.

A document is the average of the vectors of its features: every word, the character
n-grams of every word, and two marks for words that repeat (the same as the word
before; seen before in the document). A softmax over two classes reads that average.
Vectors and output weights are trained together by stochastic gradient descent in numpy.

Once trained, a feature acts on the score only through one number, its vector times the
difference of the output weights, so a model in use is one float for each hash bucket,
and a word's share of a score is remembered.

Training takes at most ``SAMPLE`` labelled documents (in the order of a hash of their
ids), the same number of both labels if there are enough, weighted back to the share of
each label. Everything else reads whole texts of all documents.

Null texts count as empty; a text without words has the score of the bias. With no
labels, or labels of one kind, the score is the share of good labels (a half if there are
none). Rows with equal ids are scored one by one; labels with null or repeated ids or
null values are left out or used as they stand.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_remainder, whole_text

SAMPLE = 6_000
BUCKETS = 1 << 17
WIDTH = 8
STEPS = 3_000
RATE = 0.4
BATCH = 16
SEED = 5
MEMORY = 500_000
SAME, AGAIN, WHOLE = 0, 1, 2  # buckets of the marks, and one that every document has


def _mixed(values: np.ndarray) -> np.ndarray:
    """Buckets of 64-bit numbers."""
    values = (values ^ values >> np.uint64(33)) * np.uint64(0x9E3779B97F4A7C15)
    return (3 + (values >> np.uint64(20)) % np.uint64(BUCKETS - 3)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its n-grams of 3 and 4 characters, its ends marked; and whose they are."""
    lengths = np.array([len(word) + 2 for word in words], np.int64)
    codes = np.frombuffer("".join([f"<{word}>" for word in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[owner]
    factor = np.uint64(0x100000001B3)
    # A word's number: a polynomial in its characters.
    powers = np.ones(int(lengths.max()), np.uint64)
    powers[1:] = factor
    powers = np.multiply.accumulate(powers)
    buckets, owners = [_mixed(np.add.reduceat(codes * powers[place], starts))], [np.arange(len(words))]
    for n in (3, 4):
        at = np.flatnonzero(place + n <= lengths[owner])
        value = np.full(len(at), n, np.uint64)
        for i in range(n):
            value = value * factor + codes[at + i]
        buckets.append(_mixed(value))
        owners.append(owner[at])
    return np.concatenate(buckets), np.concatenate(owners)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    words = text.split()
    distinct = Counter(words)
    marks = [(WHOLE, 1), (SAME, sum(map(eq, words, words[1:]))), (AGAIN, len(words) - len(distinct))]
    buckets, counts = np.array([b for b, _ in marks]), np.array([n for _, n in marks], np.float64)
    if distinct:
        found, owners = word_features(list(distinct))
        uses = np.fromiter(distinct.values(), np.float64, len(distinct))[owners]
        kinds, places = np.unique(found, return_inverse=True)
        buckets = np.concatenate([buckets, kinds])
        counts = np.concatenate([counts, np.bincount(places, weights=uses)])
    return buckets, (counts / counts.sum()).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One number for each bucket, and the bias last."""
    rng = np.random.default_rng(SEED)
    docs = [document_features(text) for text in texts]
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    output, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    step = 0
    while step < STEPS:
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            rate = RATE * BATCH * max(0.0, 1 - step / STEPS)
            step += 1
            buckets = np.concatenate([docs[i][0] for i in some])
            shares = np.concatenate([docs[i][1] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(docs[i][0]) for i in some])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            hidden = np.add.reduceat(vectors[buckets] * shares[:, None], starts, axis=0)
            logits = hidden @ output.T + bias
            shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = shifted / shifted.sum(axis=1, keepdims=True)
            error[np.arange(len(some)), labels[some]] -= 1
            error *= weights[some, None] / len(some)
            back = (error @ output)[owner] * shares[:, None]
            output -= rate * error.T @ hidden
            bias -= rate * 0.1 * error.sum(axis=0)
            np.subtract.at(vectors, buckets, rate * back)
    return np.append(vectors @ (output[1] - output[0]), bias[1] - bias[0]).astype(np.float32)


class Scorer:
    """Scores texts with a trained model; words it has met are remembered."""

    def __init__(self, model: np.ndarray):
        self.model, self.words = model.astype(np.float64), {}

    def _learn(self, new: list[str]) -> None:
        """For each word the sum over its features, and as imaginary part their number."""
        for at in range(0, len(new), 4096):
            some = new[at:at + 4096]
            buckets, owners = word_features(some)
            sums = np.bincount(owners, weights=self.model[buckets]) + 1j * np.bincount(owners)
            self.words.update(zip(some, sums.tolist()))

    def score_many(self, texts: list[str]) -> np.ndarray:
        cut = [text.split() for text in texts]
        kinds = [set(words) for words in cut]
        new = {word for word in set().union(*kinds) if word not in self.words}
        if len(self.words) + len(new) > MEMORY:
            self.words.clear()
            new = set().union(*kinds)
        self._learn(list(new))
        known, same_mark, again_mark = self.words, self.model[SAME], self.model[AGAIN]
        values = np.empty(len(texts))
        for i, (words, distinct) in enumerate(zip(cut, kinds)):
            total = sum(map(known.__getitem__, words), 0j)
            same, again = sum(map(eq, words, words[1:])), len(words) - len(distinct)
            summed = total.real + same * same_mark + again * again_mark + self.model[WHOLE]
            values[i] = summed / (total.imag + same + again + 1) + self.model[-1]
        return 1 / (1 + np.exp(-np.clip(values, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, rows: Column, sample: int = SAMPLE) -> bytes:
    """Fit on labelled documents; ``rows`` says which ids may be learned from."""
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
        .where(rows).where("_label IN (0, 1) AND _id IS NOT NULL").dropDuplicates(["_id"])
    )
    shares = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        share = (shares.get(1, 0) / total) if total else 0.5
        return np.append(np.zeros(BUCKETS), np.log((share + 1e-3) / (1 - share + 1e-3))).astype("<f4").tobytes()
    taken = known.where(F.lit(False))
    for label in (0, 1):
        part = known.where(F.col("_label") == label)
        taken = taken.union(part.orderBy(F.xxhash64("_id"), "_id").limit(sample // 2))
    # At most ``sample`` ids and labels.
    texts = docs.select(F.col("doc_id").alias("_id"), whole_text().alias("_text")).join(F.broadcast(taken), "_id")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_id", "_text"]).drop_duplicates("_id")
        label = rows["_label"].to_numpy()
        seen = np.bincount(label, minlength=2)
        weight = np.array([shares[k] / total * len(label) / max(seen[k], 1) for k in (0, 1)])
        model = fit(rows["_text"].tolist(), label, weight[label].astype(np.float32))
        return pd.DataFrame({"model": [model.astype("<f4").tobytes()]})

    found = texts.groupBy().applyInPandas(learn, "model binary").collect()
    return found[0]["model"] if found else train(docs, labels.where(F.lit(False)), rows)


def score(model: bytes, text: str = "text") -> Column:
    """The score of a text column under a trained model."""
    scorers: list[Scorer] = []

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not scorers:
            scorers.append(Scorer(np.frombuffer(model, "<f4")))
        return pd.Series(scorers[0].score_many(texts.tolist()), dtype="float64")

    return scored(whole_text(text))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, crc_remainder("_id", folds) != held)
    return docs.select(
        "doc_id", (crc_remainder("doc_id", folds) == held).alias("held_out"), score(model).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    model = train(docs, labels, crc_remainder("_id", folds) != held)
    return docs.where(score(model) >= threshold)
