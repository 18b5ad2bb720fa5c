"""Operator 7: language identification by a convolutional network over bytes, written and trained in numpy.

Byte embeddings, filters of widths 2, 3 and 4, a rectifier, max pooling over a window of fixed length, and a softmax over
the languages seen in training. A text is cut into windows of WINDOW bytes that cover all of it (the last one ends
with the text); the windows' log-probabilities are averaged, so that every byte of a text of any length counts.

Training reads text and language only, of rows in the training fold (crc32 of the id as text, modulo 3, is not 1): at most
``per_lang`` documents of each language in expectation, drawn by a hash, a few windows of each.

At prediction a filter is linear in one-hot bytes, so embedding and filter fold into one table per offset; windows are
handled in blocks small enough for a cache.

Defined results: null texts and texts without a letter are ``und`` with score 1; with no training rows every text is ``und`` with score
0; rows with null or empty lang teach nothing; repeated rows are predicted each; ties go to the first language in order; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, StringType, StructField, StructType

from .common import arrow_map, batch, texts_of
from .quality_classifier import fold_of

WINDOW, DIMS, FILTERS, WIDTHS = 192, 8, 10, (2, 3, 4)
PER_LANG, WINDOWS_EACH = 600, 4
#: Languages the network may learn; the rarest beyond it are refused loudly rather than dropped.
MAX_LANGS = 1000
EPOCHS, BATCH, RATE = 5, 32, 0.004
BLOCK = 48
HELD_OUT, FOLDS = 1, 3
UNKNOWN = "und"


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x DIMS
    filters: list[np.ndarray]  # per width: width x DIMS x FILTERS
    shift: np.ndarray  # a bias per filter
    out: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.shift, self.out, self.bias]


def windows_of(text: bytes) -> list[bytes]:
    """Windows that cover the whole text; one shorter window for a short text."""
    if len(text) <= WINDOW:
        return [text]
    starts = [*range(0, len(text) - WINDOW, WINDOW), len(text) - WINDOW]
    return [text[s : s + WINDOW] for s in starts]


def padded(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in windows], np.int64)
    return np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(-1, WINDOW), sizes


def start(langs: list[str], seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    f = len(WIDTHS) * FILTERS
    return Network(langs, draw(256, DIMS, scale=0.5), [draw(w, DIMS, FILTERS, scale=(w * DIMS) ** -0.5) for w in WIDTHS], np.zeros(f, np.float32), draw(f, len(langs), scale=f**-0.5), np.zeros(len(langs), np.float32))


def _gradients(net: Network, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy. Only the pooled positions pass anything back."""
    n = len(x)
    e = net.embed[x]
    pooled, where = [], []
    for w, k in zip(WIDTHS, net.filters, strict=True):
        m = WINDOW - w + 1
        z = sum(e[:, j : j + m] @ k[j] for j in range(w))
        z[np.arange(m)[None, :] > np.maximum(sizes - w, 0)[:, None]] = -np.inf
        where.append(z.argmax(axis=1))
        pooled.append(np.take_along_axis(z, where[-1][:, None, :], 1)[:, 0])
    z = np.concatenate(pooled, axis=1) + net.shift
    h = np.maximum(z, 0)
    logits = h @ net.out + net.bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), y] -= 1
    p /= n
    back = (p @ net.out.T) * (z > 0)
    d_embed = np.zeros_like(net.embed)
    d_filters = []
    for i, (w, k) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        at = where[i][:, :, None] + np.arange(w)  # text, filter, offset
        rows = np.arange(n)[:, None, None]
        d_filters.append(np.einsum("nf,nfwd->wdf", g, e[rows, at]))
        np.add.at(d_embed, x[rows, at], np.einsum("nf,wdf->nfwd", g, k))
    return [d_embed, *d_filters, back.sum(axis=0), h.T @ p, p.sum(axis=0)]


def train(texts: list[bytes], langs: list[str], seed: int = 7) -> Network:
    """Adam on windows of the texts."""
    known = sorted(set(langs))
    net = start(known, seed)
    rng = np.random.default_rng(seed)
    cut, y = [], []
    for t, lang in zip(texts, langs, strict=True):
        found = windows_of(t)
        for i in rng.permutation(len(found))[:WINDOWS_EACH]:
            cut.append(found[i])
            y.append(known.index(lang))
    if not cut:
        return net
    (x, sizes), y = padded(cut), np.array(y)
    first, second, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            some = order[at : at + BATCH]
            step += 1
            for p, m, v, g in zip(net.parts(), first, second, _gradients(net, x[some], sizes[some], y[some]), strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


class Predictor:
    """Network with embedding and filters folded into a table of 256 rows per offset."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.tables = []
        for j in range(max(WIDTHS)):
            columns = [net.embed @ k[j] if j < w else np.zeros((256, FILTERS), np.float32) for w, k in zip(WIDTHS, net.filters, strict=True)]
            self.tables.append(np.ascontiguousarray(np.concatenate(columns, axis=1)))

    def log_probabilities(self, windows: list[bytes]) -> np.ndarray:
        out = np.empty((len(windows), len(self.net.langs)))
        for at in range(0, len(windows), BLOCK):
            x, sizes = padded(windows[at : at + BLOCK])
            tail = max(WIDTHS) - 1
            x = np.pad(x, ((0, 0), (0, tail)))
            z = self.tables[0][x[:, :WINDOW]]
            for j in range(1, max(WIDTHS)):
                z += self.tables[j][x[:, j : j + WINDOW]]
            for i, w in enumerate(WIDTHS):
                own = z[:, :, i * FILTERS : (i + 1) * FILTERS]
                own[:, WINDOW - w + 1 :] = -np.inf
                for r in np.flatnonzero(sizes < WINDOW):
                    own[r, max(sizes[r] - w, 0) + 1 :] = -np.inf
            h = np.maximum(z.max(axis=1) + self.net.shift, 0)
            logits = h @ self.net.out + self.net.bias
            logits -= logits.max(axis=1, keepdims=True)
            out[at : at + BLOCK] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, its probability) of each text."""
        cut = [windows_of(t) for t in texts]
        sizes = np.array([len(c) for c in cut])
        logs = self.log_probabilities([w for c in cut for w in c])
        mean = np.add.reduceat(logs, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Network:
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").cast("binary").alias("text")).filter("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL").filter(fold_of("doc_id", FOLDS) != HELD_OUT)
    counts = rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return start([], 7)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], per_lang / r["count"])])
    chance = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    # windows, not whole texts, reach the driver: the same few of each document that training would take
    drawn = arrow_map(rows.filter(chance < share[F.col("lang")]), _samples, StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("lang", StringType()), StructField("text", BinaryType())])).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(drawn.column("text").to_pylist(), drawn.column("lang").to_pylist())


def _samples(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in rows:
        ids, langs, cut = [], [], []
        for d, lang, t in zip(part.column("doc_id").to_pylist(), part.column("lang").to_pylist(), texts_of(part), strict=True):
            found = windows_of(t)
            for i in np.random.default_rng(len(t)).permutation(len(found))[:WINDOWS_EACH]:
                ids.append(d)
                langs.append(lang)
                cut.append(found[i])
        yield batch(doc_id=pa.array(ids, part.column("doc_id").type), lang=pa.array(langs, pa.string()), text=pa.array(cut, pa.binary()))


def _predicted(rows: Iterator[pa.RecordBatch], net) -> Iterator[pa.RecordBatch]:
    predictor = Predictor(net.value)
    for part in rows:
        letters = np.array(part.column("letters").to_pylist(), bool)
        texts = texts_of(part)
        lang, score = np.full(len(texts), UNKNOWN, object), np.where(letters, 0.0, 1.0)
        some = np.flatnonzero(letters)
        if len(some) and net.value.langs:
            best, p = predictor([texts[i] for i in some])
            lang[some] = [net.value.langs[b] for b in best]
            score[some] = p
        yield batch(doc_id=part.column("doc_id"), held_out=part.column("held_out"), lang_pred=pa.array(list(lang), pa.string()), score=score)


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document."""
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, per_lang))  # some thousand numbers
    rows = docs.select(F.col("doc_id").alias("doc_id"), (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col("text").cast("binary").alias("text"))
    return arrow_map(rows, partial(_predicted, net=net), StructType([rows.schema["doc_id"], StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
