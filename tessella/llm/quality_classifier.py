"""Operator 9: quality classifier with supervised subword embeddings, trained by numpy SGD.

Features of a document: each word, each character n-gram (in UTF-8 bytes) of the word in angle brackets, and each pair of
neighbouring words, hashed into buckets of learned vectors; a document is their average, a softmax layer gives its class.
Labels come from rows of the training fold alone (crc32 of the id as text, modulo 5, is not 0), at most ``max_rows`` of
them in expectation, drawn by a hash of the id; they are the only rows that reach the driver, cut to their labels and feature counts.

As the output layer is linear, a bucket's vector counts only through its logit. Scoring therefore looks up one number per bucket,
and a word's sum is remembered, so every whole text is scored in one pass over its words.

Defined results: null and blank texts have no features and score as the bias alone says; very long texts and words are read whole; ids with contradictory or null labels teach
nothing; with no labelled row, or only one class, all scores are that class's share (0.5 without labels); repeated rows are scored
each; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, StructField, StructType

from .common import WordHashes, arrow_map, batch, mix, texts_of
from .window_dedup import rolled

BUCKETS, DIMS = 1 << 17, 12
CHAR_GRAMS = (2, 3, 4)
#: Bytes up to which a word's sum is remembered; longer words are summed each time they come.
LONG = 48
#: Labelled rows to train on.
MAX_ROWS = 2500
#: Steps of the descent, however many rows there are to go through, and its first rate.
STEPS, RATE = 10_000, 0.5
FOLDS, ACCEPT = 5, 0.3
PAIR = np.uint64(0xD6E8FEB86659FD93)


def fold_of(doc_id: F.Column | str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text of nothing."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def word_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of each word and of each byte n-gram of it in angle brackets."""
    cut = [b"<%b>" % w for w in words]
    data = mix(np.frombuffer(b"".join(cut), np.uint8).astype(np.uint64))
    sizes = np.array([len(c) for c in cut], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(cut)), sizes)
    buckets, owners = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))], [np.arange(len(cut))]
    for n in CHAR_GRAMS:
        gram = rolled(data, n, PAIR)
        inside = np.flatnonzero(np.arange(len(gram)) + n <= ends[owner[: len(gram)]])
        buckets.append(gram[inside])
        owners.append(owner[inside])
    return (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(owners)


def pair_buckets(h: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words; all words that repeat at once share the one of "again"."""
    pairs = mix(h[:-1] * PAIR + h[1:]) & np.uint64(BUCKETS - 1)
    pairs[h[:-1] == h[1:]] = 0
    return pairs.astype(np.int64)


def bag(text: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their share among its features."""
    found = text.split()
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    ids, counts = np.unique(np.concatenate([word_buckets(found)[0], pair_buckets(hashes.of(found))]), return_counts=True)
    return ids, (counts / counts.sum()).astype(np.float32)


@dataclass
class Model:
    logits: np.ndarray  # by bucket
    bias: float

    def score(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sums / np.maximum(counts, 1))))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 9, steps: int = STEPS, rate: float = RATE) -> Model:
    """Averaged hashed vectors under a two-class softmax, by plain SGD with a falling rate, in whole passes over the rows."""
    ones = float(labels.mean()) if len(labels) else 0.5
    if len(labels) == 0 or ones in (0.0, 1.0):
        p = min(max(ones, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    out, bias = np.zeros((DIMS, 2), np.float32), np.log(np.array([1 - ones, ones], np.float32))
    epochs = max(1, round(steps / len(bags)))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i][0], bags[i][1].astype(np.float32)
            lr = rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[ids] if len(ids) else np.zeros(DIMS, np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            if len(ids):
                vectors[ids] -= (lr * len(ids) ** 0.5) * share[:, None] * (out @ p)
                out -= lr * np.outer(mean, p)
            bias -= 0.1 * lr * p
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", max_rows: int = MAX_ROWS, folds: int = FOLDS) -> Model:
    known = (labels.select(F.col("doc_id").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
             .filter(fold_of("doc_id", folds) != 0).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("doc_id", "label"))
    n = known.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.filter(chance < max_rows / max(n, 1))  # at most max_rows in expectation: a bounded side
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label")
    found = arrow_map(rows, _bags, StructType([rows.schema["doc_id"], StructField("label", IntegerType()), StructField("ids", BinaryType()), StructField("share", BinaryType())])).toArrow().sort_by("doc_id")
    y = found.column("label").to_numpy().astype(np.int64)
    bags = [(np.frombuffer(i, np.int32), np.frombuffer(s, np.float16)) for i, s in zip(found.column("ids").to_pylist(), found.column("share").to_pylist(), strict=True)]
    del found  # the features are held once, in the narrow types they came in
    return train(bags, y)


def _bags(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for part in rows:
        each = [bag(t, hashes) for t in texts_of(part)]
        yield batch(doc_id=part.column("doc_id"), label=part.column("label"), ids=pa.array([i.astype(np.int32).tobytes() for i, _ in each], pa.binary()), share=pa.array([s.astype(np.float16).tobytes() for _, s in each], pa.binary()))


class Scorer:
    """Scores texts; remembers the logit sum and feature count of every word, up to a bound."""

    def __init__(self, model: Model, bound: int = 400_000) -> None:
        self.model, self.bound, self.hashes = model, bound, WordHashes(bound)
        self.number: dict[bytes, int] = {}
        self.sums = self.counts = np.empty(0)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if len(self.number) > self.bound:
            self.number, self.sums, self.counts = {}, np.empty(0), np.empty(0)
        known, number, logits = len(self.number), self.number, self.model.logits
        each = [t.split() for t in texts]
        long = [[w for w in words if len(w) > LONG] for words in each]
        kept = [[w for w in words if len(w) <= LONG] if far else words for words, far in zip(each, long, strict=True)]
        ids = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in kept]
        if len(number) > known:
            buckets, owner = word_buckets(list(number)[known:])
            new = len(number) - known
            self.sums = np.concatenate([self.sums, np.bincount(owner, logits[buckets], new)])
            self.counts = np.concatenate([self.counts, np.bincount(owner, minlength=new)])
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for i, own in enumerate(ids):
            if each[i]:
                total[i] = self.sums[own].sum() + float(logits[pair_buckets(self.hashes.of(each[i]))].sum(dtype=np.float64))
                count[i] = self.counts[own].sum() + len(each[i]) - 1
            for w in long[i]:
                buckets, _ = word_buckets([w])
                total[i] += float(logits[buckets].sum(dtype=np.float64))
                count[i] += len(buckets)
        return self.model.score(total, count)


#: The last model's scorer: a worker process keeps its word sums from task to task.
_SCORER: dict[int, Scorer] = {}


def _scorer(model) -> Scorer:
    key = id(model.value)
    if key not in _SCORER:
        _SCORER.clear()
        _SCORER[key] = Scorer(model.value)
    return _SCORER[key]


def _scored(rows: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    scorer = _scorer(model)
    for part in rows:
        s = scorer(texts_of(part))
        yield batch(doc_id=part.column("doc_id"), held_out=part.column("held_out"), score=s, predicted=(s >= ACCEPT).astype(np.int32))


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows=max_rows))  # BUCKETS floats, whatever the corpus
    rows = docs.select(F.col("doc_id").alias("doc_id"), (fold_of("doc_id", FOLDS) == 0).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return arrow_map(rows, partial(_scored, model=model), StructType([rows.schema["doc_id"], StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def _accepted(rows: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    scorer = _scorer(model)
    for part in rows:
        texts = [t.encode() if t else b"" for t in part.column("text").to_pylist()]
        yield part.filter(pa.array(scorer(texts) >= ACCEPT))


def accepted_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows=max_rows))
    return arrow_map(docs, partial(_accepted, model=model), docs.schema)
