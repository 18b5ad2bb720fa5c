"""Operator 6: benchmark decontamination by latent semantic retrieval.

Passages are windows of 64 normalised words, 32 apart, that cover every whole text.

1. Codes: one pass over the corpus turns each text into column numbers and writes them. Each word of the benchmark has its own
   column, all other words of the corpus share HASHED columns by hash; the later passes read codes alone.
2. Weights: document frequencies come from all documents. Words in more than MAX_SHARE of the documents carry no evidence and leave
   the vector space; the rest weigh by TF-IDF, and passage vectors have unit length.
3. The latent space is the RANK leading directions of all passages (here side by side, as overlap would count words twice), from a
   distributed randomised SVD: every task adds up A' (A R) for its passages A and a fixed random R, and the driver orthonormalises
   the total. Nothing is projected out.
4. Queries are the items and, of items longer than PIECE words, their even pieces of at most PIECE words: any PIECE words in a row lie
   in one passage whole. Queries and passages are folded into the space. A pair is a candidate if for any query its cosine there is at
   least LATENT, which words that stand in like places can bring about, or the cosine of its terms (over the benchmark's words) is at
   least COSINE, or the passage holds COVERED of the query's squared weight, whatever else it holds.
   The items are the stated query set; all passages of all documents are searched.
5. A candidate is aligned with the words around the passage: the longest common subsequence with the item, and with its answer (the
   last sentence). It is a leak if the share of the item's words in the subsequence is at least ``LCS_SHARE``, or at least
   ``PARAPHRASE_SHARE`` when the answer stands there as well. Columns of benchmark words are words, so codes serve for it.

The text is read once and its codes three times, for up to MAX_ITEMS items, which bound what is broadcast (columns times rank); each
further MAX_ITEMS items cost as much again. There is no shuffle but of the sums, whose number the cores fix and not the corpus. Words are
runs of letters and digits in lower case, so changes of case or punctuation do not matter.

Defined results: null and empty texts leak nothing; very long texts are searched whole; items without a word that counts are matched by
nothing; ids of any type are kept, and ids or rows that repeat are reported for each row; a null id is reported as null; an
empty table or benchmark gives no rows; other columns are ignored by ``leaked_pairs`` and kept by ``clean_documents``, whatever their
names. The cosine is that of the terms, of the nearest query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from .common import Scratch, arrow_map

PASSAGE, STRIDE = 64, 32
#: Items of one search, and queries that are compared at a time.
MAX_ITEMS, BLOCK_QUERIES = 10_000, 1024
RANK, OVERSAMPLE = 24, 8
MAX_SHARE = 0.1
COSINE = 0.4
#: Columns of the words that no item holds.
HASHED = 1 << 15
#: Cosine of a candidate in the latent space.
LATENT = 0.9
#: Words of a query piece, and the share of a query's squared weight that makes a candidate.
PIECE, COVERED = PASSAGE - STRIDE + 1, 0.4
LCS_SHARE, PARAPHRASE_SHARE, ANSWER_SHARE = 0.8, 0.6, 0.9
#: Passages projected at a time, pairs of them with items, and columns whose sums travel together.
CHUNK, CELLS, SPAN = 2048, 1 << 19, 256
LEAK = ["doc_id", "item_id", "cosine", "item_share", "answer_share"]
#: Partial sums of the sketch for each core.
SUMS_PER_CORE = 4


#: ASCII bytes that divide words.
BREAKS = bytes.maketrans(bytes(range(128)), bytes(c if chr(c).isalnum() else 32 for c in range(128)))


#: Other characters that do.
OTHER_BREAKS = re.compile(r"[^\w\x00-\x7f]+")


def raw_words(text: bytes) -> list[bytes]:
    lower = text.decode("utf-8", "replace").lower()
    return (lower if lower.isascii() else OTHER_BREAKS.sub(" ", lower)).encode().translate(BREAKS).split()


def words_of(text: str) -> list[str]:
    return [w.decode() for w in raw_words(text.encode())]


def answer_of(text: str) -> list[str]:
    """Words of the last sentence; of the whole item if it is one sentence."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n", text) if words_of(p)]
    return words_of(parts[-1]) if parts else []


@dataclass
class Queries:
    """At most BLOCK_QUERIES queries."""

    item_of: np.ndarray  # by query
    first: np.ndarray  # by benchmark word: its first posting
    query: np.ndarray  # by posting
    value: np.ndarray  # by posting, in the unit query
    latent: np.ndarray  # unit queries in the latent space


@dataclass
class Search:
    ids: list
    items: list[list[int]]  # columns
    answers: list[list[int]]
    own: int  # columns of benchmark words
    weight: np.ndarray | None = None  # idf by column, 0 for words that carry no evidence
    basis: np.ndarray | None = None  # columns of the latent space
    blocks: list[Queries] | None = None


class Columns(dict):
    """Column of each word: its own, or by hash; forgets the hashed ones when a vocabulary outgrows its bound."""

    def __init__(self, number: dict[bytes, int], bound: int = 500_000) -> None:
        super().__init__(number)
        self.number, self.bound = number, bound + len(number)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
            self.update(self.number)
        self[word] = value = len(self.number) + xxhash.xxh3_64_intdigest(word) % HASHED
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def passages(found: list[np.ndarray], weight: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, ...]:
    """Sparse unit TF-IDF rows of all passages that hold a weighted word: (text, start, row, column, value)."""
    text, start, row, col, n = [], [], [], [], 0
    for i, c in enumerate(found):
        at = np.flatnonzero(weight[c] > 0)
        if not len(at):
            continue
        last = max(0, -(-(len(c) - PASSAGE) // stride))
        hi = np.minimum(at // stride, last)
        lo = np.maximum(0, (at - PASSAGE) // stride + 1)
        for back in range(PASSAGE // stride):  # a word lies in as many passages as fit
            p = hi - back
            ok = p >= lo
            row.append(p[ok] + n)
            col.append(c[at[ok]])
        text.append(np.full(last + 1, i))
        start.append(np.arange(last + 1) * stride)
        n += last + 1
    if not n:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.float32),)
    key, tf = np.unique(np.concatenate(row) * len(weight) + np.concatenate(col), return_counts=True)
    row, col = np.divmod(key, len(weight))
    value = tf * weight[col]
    norm = np.bincount(row, value**2, n) ** 0.5
    used = np.flatnonzero(norm)
    renumber = np.cumsum(norm > 0) - 1
    return np.concatenate(text)[used], np.concatenate(start)[used], renumber[row], col, (value / norm[row]).astype(np.float32)


def _coded(rows: Iterator[pa.RecordBatch], number, keep: list[str], codes_name: str) -> Iterator[pa.RecordBatch]:
    """The columns to keep, and each text as column numbers."""
    known = Columns(number.value)
    for part in rows:
        codes = [known.of(raw_words(t or b"")).astype(np.int32).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(codes, pa.binary())], names=[*keep, codes_name])


def _codes_of(part: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(c, np.int32).astype(np.int64) for c in part.column(part.num_columns - 1).to_pylist()]


def _frequencies(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(size, np.int64), 0
    for part in rows:
        for codes in _codes_of(part):
            n += 1
            total[np.unique(codes)] += 1
    if n:
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], used]).astype(np.int32)), pa.array(np.concatenate([[n], total[used]]).astype(np.int64))], names=["word", "n"])


def _sketch(rows: Iterator[pa.RecordBatch], search, random) -> Iterator[pa.RecordBatch]:
    """One task's A' (A R), a row per SPAN columns of A."""
    b, r = search.value, random.value
    total = np.zeros(r.shape, np.float32)
    for part in rows:
        _, _, row, col, value = passages(_codes_of(part), b.weight, PASSAGE)
        for at in _pieces(row):
            first = row[at][0]
            y = dense(row[at] - first, col[at], value[at], r)
            order = np.argsort(col[at], kind="stable")
            c = col[at][order]
            total[c[_starts(c)]] += dense(c, row[at][order] - first, value[at][order], y)
    spans = [total[i : i + SPAN] for i in range(0, len(total), SPAN)]
    used = [i for i, x in enumerate(spans) if x.any()]
    yield pa.RecordBatch.from_arrays([pa.array(np.array(used, np.int32)), pa.array([spans[i].tobytes() for i in used], pa.binary())], names=["span", "sums"])


def _pieces(row: np.ndarray, size: int = CHUNK) -> Iterator[slice]:
    """Slices of sorted rows that hold about ``size`` rows each, none of them cut."""
    at = 0
    while at < len(row):
        end = int(np.searchsorted(row, row[at] + size))
        yield slice(at, end)
        at = end


def dense(row: np.ndarray, col: np.ndarray, value: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sparse rows times basis; every row has an entry and rows are sorted."""
    return np.add.reduceat(basis[col] * value[:, None], _starts(row), axis=0)


def _starts(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def pieces_of(words: list) -> list[list]:
    """The words in even pieces of at most PIECE."""
    n = -(-len(words) // PIECE)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


def term_likeness(row: np.ndarray, col: np.ndarray, value: np.ndarray, own: int, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Passages by queries: cosine over the benchmark's words, and the share of the query's squared weight in the passage."""
    n, m = row[-1] + 1, len(q.item_of)
    known = col < own
    row, col, value = row[known], col[known], value[known]
    norm = np.bincount(row, value**2, n) ** 0.5
    many = q.first[col + 1] - q.first[col]
    entry = np.repeat(np.arange(len(col)), many)
    at = np.arange(len(entry)) + np.repeat(q.first[col] - (np.cumsum(many) - many), many)
    key, weight = row[entry] * m + q.query[at], q.value[at]
    dots, covered = np.bincount(key, value[entry] * weight, n * m), np.bincount(key, weight**2, n * m)
    return dots.reshape(n, m) / np.maximum(norm, 1e-12)[:, None], covered.reshape(n, m)


def may_leak(item: list, own: set, around: list) -> bool:
    """Whether the distinct words in common leave room for PARAPHRASE_SHARE; no leak fails this."""
    return len(own.intersection(around)) + len(item) - len(own) >= PARAPHRASE_SHARE * len(item) - 1e-9


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel: a bit for each word of ``a``."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit) | (row - hit)
        row &= full
    return len(a) - row.bit_count()


def aligned(item: list, answer: list, around: list) -> tuple[float, float]:
    return lcs(item, around) / len(item), lcs(answer, around) / len(answer)


def is_leak(item_share: float, answer_share: float) -> bool:
    return item_share >= LCS_SHARE or (item_share >= PARAPHRASE_SHARE and answer_share >= ANSWER_SHARE)


def leaks_of(codes: list[np.ndarray], b: Search) -> list[tuple[int, int, float, float, float]]:
    """(text, item, cosine, item share, answer share) of each leak, the best passage of each pair."""
    text, start, row, col, value = passages(codes, b.weight)
    own = [set(item) for item in b.items]
    words: dict[int, set] = {}  # benchmark words of a text
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    most = max((len(q.item_of) for q in b.blocks), default=1)
    for at in _pieces(row, max(1, min(CHUNK, CELLS // most))):
        for t, i, s, cosine in _candidates(text, start, row[at], col[at], value[at], b, codes, own, words):
            if best.get((t, i), (0, 0, 0))[1:] == (1, 1):
                continue
            item = b.items[i]
            around = codes[t][max(0, s - len(item)) : s + PASSAGE + len(item)].tolist()
            if not may_leak(item, own[i], around):
                continue
            shares = aligned(item, b.answers[i], around)
            if is_leak(*shares) and shares > best.get((t, i), (0, 0, 0))[1:]:
                best[t, i] = (cosine, *shares)
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def _candidates(text: np.ndarray, start: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, b: Search, codes: list[np.ndarray], own: list[set], words: dict[int, set]) -> list[tuple]:
    """(text, item, start, cosine) of the pairs of passages and items that are near and whose text as a whole leaves room for a leak."""
    first = row[0]
    row = row - first
    folded = unit(dense(row, col, value, b.basis))
    found = []
    for q in b.blocks:
        cosines, covered = term_likeness(row, col, value, b.own, q)
        hit = (cosines >= COSINE) | (covered >= COVERED - 1e-9)
        hit |= folded @ q.latent.T >= LATENT
        at = np.flatnonzero(hit)
        p, k = np.divmod(at, hit.shape[1])
        found.append((p, q.item_of[k], cosines.ravel()[at]))
    p, item, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
    n = len(b.items)
    pair, which = np.unique(text[first + p] * n + item, return_inverse=True)
    room = np.zeros(len(pair), bool)
    for j, (t, i) in enumerate(zip(*(x.tolist() for x in np.divmod(pair, n)), strict=True)):
        if t not in words:
            words[t] = set(codes[t][codes[t] < b.own].tolist())
        room[j] = may_leak(b.items[i], own[i], words[t])
    left = np.flatnonzero(room[which])
    order = left[np.lexsort((-cosine[left], item[left], p[left]))]
    kept = order[np.flatnonzero(np.concatenate([[True], (np.diff(p[order]) != 0) | (np.diff(item[order]) != 0)]))] if len(order) else order
    return list(zip(text[first + p[kept]].tolist(), item[kept].tolist(), start[first + p[kept]].tolist(), cosine[kept].tolist(), strict=True))


def _leaks(rows: Iterator[pa.RecordBatch], search, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    b = search.value
    for part in rows:
        found = leaks_of(_codes_of(part), b)
        told = [part.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([b.ids[x[1]] for x in found], item_type)]
        yield pa.RecordBatch.from_arrays([*told, *(pa.array([x[j] for x in found], pa.float64()) for j in (2, 3, 4))], names=LEAK)


def _clean(rows: Iterator[pa.RecordBatch], search) -> Iterator[pa.RecordBatch]:
    for part in rows:
        leaked = {x[0] for x in leaks_of(_codes_of(part), search.value)}
        yield part.select(list(range(part.num_columns - 1))).filter(pa.array([i not in leaked for i in range(part.num_rows)], pa.bool_()))


def item_groups(benchmark: DataFrame, max_items: int = MAX_ITEMS) -> Iterator[list[tuple]]:
    """(id, words, words of the answer) of the items that have words. The benchmark is the query set: the driver reads it in groups."""
    held: list[tuple] = []
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        words = raw_words((r["text"] or "").encode())
        if words:
            held.append((r["item_id"], words, [w.encode() for w in answer_of(r["text"])]))
        if len(held) == max_items:
            yield held
            held = []
    if held:
        yield held


def fit(docs: DataFrame, held: list[tuple], keep: list[str], scratch: Scratch) -> tuple[Search, DataFrame]:
    """The search for one group of items, and the coded documents: the columns to keep, then the codes."""
    context = docs.sparkSession.sparkContext
    vocabulary = sorted({w for _, words, answer in held for w in (*words, *answer)})
    number = {w: i for i, w in enumerate(vocabulary)}
    b = Search([h[0] for h in held], [[number[w] for w in h[1]] for h in held], [[number[w] for w in h[2]] for h in held], len(vocabulary))
    size = b.own + HASHED
    codes = "codes"
    while codes in keep:
        codes += "_"
    schema = StructType([docs.schema[c] for c in keep] + [StructField(codes, BinaryType())])
    own = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else ["text"]))
    coding = partial(_coded, number=context.broadcast(number), keep=keep, codes_name=codes)  # words of at most MAX_ITEMS items
    coded = scratch.save(arrow_map(own, coding, schema), f"coded-{len(scratch.saved)}")
    raw = coded.select(codes)
    counts = {r["word"]: r["n"] for r in arrow_map(raw, partial(_frequencies, size=size), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = counts.pop(-1, 0)
    df = np.zeros(size)
    df[list(counts)] = list(counts.values())
    b.weight = np.where(df > MAX_SHARE * n, 0.0, np.log((n + 1) / (df + 1)) + 1e-9) if n else np.ones(size)
    # items whose words are all frequent must be found too: theirs keep a small weight
    for item in map(np.array, b.items):
        if not (b.weight[item] > 0).any():
            b.weight[item] = np.maximum(b.weight[item], np.log((n + 1) / (df[item] + 1)) + 1e-9)
    r = np.random.default_rng(6).normal(size=(size, RANK + OVERSAMPLE)).astype(np.float32)
    shared, random = context.broadcast(b), context.broadcast(r)
    # as many partial sums as cores want, however many parts the corpus has
    tasks = arrow_map(raw.coalesce(SUMS_PER_CORE * context.defaultParallelism), partial(_sketch, search=shared, random=random), "span int, sums binary")
    total = np.zeros(r.shape)
    for found in tasks.groupBy("span").applyInArrow(_added, "span int, sums binary").toLocalIterator():
        sums = np.frombuffer(found["sums"]).reshape(-1, r.shape[1])
        total[found["span"] * SPAN :][: len(sums)] = sums
    left, strength, _ = np.linalg.svd(total, full_matrices=False)
    b.basis = np.ascontiguousarray(left[:, :RANK][:, strength[:RANK] > 1e-9], np.float32)
    asked = [(i, q) for i, words in enumerate(b.items) for q in [words, *(pieces_of(words) if len(words) > PIECE else [])]]
    b.blocks = [_queries(asked[i : i + BLOCK_QUERIES], b) for i in range(0, len(asked), BLOCK_QUERIES)]
    return b, coded


def _queries(asked: list[tuple[int, list[int]]], b: Search) -> Queries:
    row, col, value = _unit_rows([q for _, q in asked], b.weight)
    order = np.argsort(col, kind="stable")
    latent = np.zeros((len(asked), b.basis.shape[1]), np.float32)
    np.add.at(latent, row, b.basis[col] * value[:, None])
    return Queries(np.array([i for i, _ in asked]), np.searchsorted(col[order], np.arange(b.own + 1)), row[order], value[order], unit(latent))


def _unit_rows(rows: list[list[int]], weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, column, value) of unit TF-IDF rows."""
    key, tf = np.unique(np.concatenate([i * len(weight) + np.array(c) for i, c in enumerate(rows)]), return_counts=True)
    row, col = np.divmod(key, len(weight))
    value = tf * weight[col]
    return row, col, value / np.maximum(np.bincount(row, value**2, len(rows)) ** 0.5, 1e-12)[row]


def _added(rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, np.float32) for x in rows.column("sums").to_pylist()], axis=0, dtype=np.float64)
    return pa.table({"span": rows.column("span")[:1].combine_chunks(), "sums": pa.array([total.tobytes()], pa.binary())})


def leaked_pairs(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """doc_id, item_id, cosine, item_share, answer_share: one row per document and benchmark item that it leaks."""
    item = benchmark.schema["item_id"].dataType
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("item_id", item), *(StructField(c, DoubleType()) for c in LEAK[2:])])
    out, scratch = docs.sparkSession.createDataFrame([], schema), Scratch(docs.sparkSession, "leaks")
    for held in item_groups(benchmark, max_items):
        search, coded = fit(docs, held, ["doc_id"], scratch)
        out = out.union(arrow_map(coded, partial(_leaks, search=docs.sparkSession.sparkContext.broadcast(search), item_type=to_arrow_type(item)), schema))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns kept."""
    out, scratch = docs, Scratch(docs.sparkSession, "leaks")
    for held in item_groups(benchmark, max_items):
        search, coded = fit(out, held, docs.columns, scratch)
        out = arrow_map(coded, partial(_clean, search=docs.sparkSession.sparkContext.broadcast(search)), docs.schema)
    return out
