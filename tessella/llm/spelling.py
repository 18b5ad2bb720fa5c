"""Spelling variants: words one letter apart, each grouped under a far more frequent neighbour.

Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z in lower case. Counting is plain Spark: each run is a row, and equal words
add up before they are shuffled. The vocabulary then lies in blocks, twice: by its words' first three letters and by their last three. Two words that differ
by one inserted, deleted or replaced letter agree in one of the two, as words have at least six letters, so they meet in a block.

Within a pair of blocks the search is bit-sliced. For every position and letter there is a bitset of the block's words with that letter there, and a query
word is read letter by letter with four sets of words, 64 words to a machine word: those equal so far, and those one replaced, one more or one fewer
letter away, whose positions are shifted by 0, +1 and -1. After the last letter, the sets cut by word length are the words at distance one.

A frequent prefix or suffix is many blocks, and blocks are bounded by letters too, so one overlong word is a block of its own. A null text has no words,
a null id counts as the empty string, repeated rows count each, an empty table gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, batch

#: Java regex of a run of letters; the letters' count, and one after the last.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
N_LETTERS = 26 + 64
MIN_LENGTH, MIN_COUNT, RATIO, KEY_LETTERS = 6, 5, 5, 3
#: Words and letters of a block, and bytes of the sets of queries that are read at a time.
BLOCK, BLOCK_LETTERS, SETS_BYTES = 2048, 1 << 15, 1 << 22
#: Letters up to which a word's places have a table; longer ones are found by bisection.
TABLE_LENGTH = 1000


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text", drop_every: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n. With ``drop_every`` a run whose crc32 of ``<id>:<run>`` it divides loses the letter at that number modulo its length."""
    runs = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"({RUN})"), 1)).alias("run"))
    if drop_every:
        h, at = F.col("h"), F.pmod(F.col("h"), F.length("run")).cast("int")
        runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
        short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        runs = runs.select(F.when(h % drop_every == 0, short).otherwise(F.col("run")).alias("run"))
    return runs.filter(F.length("run") >= min_length).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words' letters one after another, where each word starts, one more at the end)."""
    raw = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    codes = np.where(raw < 0xC0, raw - ord("a"), raw - 0xC0 + 26).astype(np.int32)
    return codes, np.concatenate([[0], np.cumsum([len(w) for w in words])])


class Slices:
    """Bitsets of a block's words by position and letter, and by length."""

    def __init__(self, words: list[str]) -> None:
        codes, starts = letters(words)
        lengths = np.diff(starts)
        self.n, self.width, self.longest = len(words), -(-len(words) // 64), int(lengths.max(initial=0))
        word = np.repeat(np.arange(len(words)), lengths)
        place = (np.arange(len(codes)) - starts[word]) * N_LETTERS + codes
        self.used, row = np.unique(place, return_inverse=True)
        # row 0 is the empty set, for what no word has; positions before the first and after the last have it throughout
        self.sets = np.zeros((len(self.used) + 1, self.width), np.uint64)
        np.bitwise_or.at(self.sets, (row + 1, word >> 6), np.uint64(1) << (word & 63).astype(np.uint64))
        self.table = None
        if self.longest <= TABLE_LENGTH:
            self.table = np.zeros((self.longest + 3) * N_LETTERS, np.int32)
            self.table[self.used + N_LETTERS] = np.arange(1, len(self.used) + 1)
        self.by_length = {int(n): self._members(np.flatnonzero(lengths == n)) for n in np.unique(lengths)}
        self.all = self._members(np.arange(self.n))

    def _members(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width, np.uint64)
        np.bitwise_or.at(out, words >> 6, np.uint64(1) << (words & 63).astype(np.uint64))
        return out

    def with_letter(self, position: int, codes: np.ndarray) -> np.ndarray:
        """Words that have each of these letters at a position from -1 on; beyond the longest word none has."""
        if not 0 <= position < self.longest:
            return np.zeros((len(codes), self.width), np.uint64)
        if self.table is not None:
            return self.sets[self.table[(position + 1) * N_LETTERS + codes]]
        place = position * N_LETTERS + codes
        at = np.minimum(np.searchsorted(self.used, place), len(self.used) - 1)
        return self.sets[np.where(self.used[at] == place, at + 1, 0)]

    def of_length(self, n: int) -> np.ndarray:
        return self.by_length.get(n, np.zeros(self.width, np.uint64))

    def one_apart(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Sets (queries x words in bits) at distance one. codes: queries of one length, a row each; own: sets of words to leave out."""
        n, m = codes.shape
        near = np.zeros((n, self.width), np.uint64)
        live = np.arange(n)
        equal, replaced, more, fewer = self.all & ~own, *(np.zeros((n, self.width), np.uint64) for _ in range(3))
        for p in range(m):
            here = self.with_letter(p, codes[live, p])
            replaced = (replaced & here) | (equal & ~here)  # a word too short for this falls out by its length
            more = (more | equal) & self.with_letter(p + 1, codes[live, p])
            fewer = (fewer & self.with_letter(p - 1, codes[live, p])) | equal
            equal = equal & here
            if p % 4 == 3:
                open_ = ((equal | replaced | more | fewer) != 0).any(axis=1)
                if not open_.all():
                    live, equal, replaced, more, fewer = (x[open_] for x in (live, equal, replaced, more, fewer))
                    if not len(live):
                        return near
        near[live] = (replaced & self.of_length(m)) | ((more | equal) & self.of_length(m + 1)) | (fewer & self.of_length(m - 1))
        return near


def bits(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of every member."""
    row, part = np.nonzero(sets)
    inside = np.unpackbits(sets[row, part].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(inside)
    return row[at], part[at] * 64 + bit


def near_pairs(queries: list[str], words: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) positions of the pairs at distance one; ``same``: both are one list of distinct words."""
    slices = Slices(words)
    codes, starts = letters(queries)
    lengths = np.diff(starts)
    found = []
    step = max(1, SETS_BYTES // (8 * slices.width))
    for m in np.unique(lengths):
        which = np.flatnonzero(lengths == m)
        for lo in range(0, len(which), step):
            some = which[lo : lo + step]
            own = np.zeros((len(some), slices.width), np.uint64)
            if same:
                own[np.arange(len(some)), some >> 6] = np.uint64(1) << (some & 63).astype(np.uint64)
            q, w = bits(slices.one_apart(codes[starts[some][:, None] + np.arange(m)], own))
            found.append((some[q], w))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks: word, how many near words the other block has, and the most frequent, least word of them."""
    for rows in batches:
        for r in range(rows.num_rows):
            get = lambda name: rows.column(name)[r].as_py()  # noqa: B023, E731
            queries, words = get("queries"), get("words")
            q, w = near_pairs(queries, words, get("a") == get("b"))
            heads = np.array([x[:KEY_LETTERS] for x in queries]), np.array([x[:KEY_LETTERS] for x in words])
            here = (heads[0][q] != heads[1][w]) == get("last")  # a bucket holds several keys, and a pair counts under one
            q, w = q[here], w[here]
            if not len(q):
                continue
            n = np.asarray(rows.column("counts")[r].values)
            rank = np.empty(len(words), np.int64)
            rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))  # code points, as Python compares
            order = np.lexsort((rank[w], -n[w], q))
            q, w = q[order], w[order]
            first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            yield batch(word=[queries[i] for i in q[first]], near=np.diff(np.concatenate([first, [len(q)]])).astype(np.int64), best=[words[i] for i in w[first]], best_n=n[w[first]].astype(np.int64))


def _blocks(words: DataFrame, scratch: Scratch, n_words: int) -> DataFrame:
    """bucket, last, block, words, counts: buckets by a hash of the first or last letters, blocks of bounded size within them."""
    n_buckets = max(1, -(-n_words // (BLOCK // 2)))
    ends = ((False, F.substring("word", 1, KEY_LETTERS)), (True, F.substring("word", -KEY_LETTERS, KEY_LETTERS)))
    placed = words.select("word", "n", F.explode(F.array(*[F.struct(F.lit(last).alias("last"), F.pmod(F.xxhash64(end), F.lit(n_buckets)).alias("bucket")) for last, end in ends])).alias("p")).select("word", "n", "p.last", "p.bucket")
    sizes = placed.groupBy("last", "bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.length("word")) / BLOCK_LETTERS)).alias("parts"))
    dealt = placed.join(sizes, ["last", "bucket"]).withColumn("part", F.pmod(F.xxhash64("word", F.lit(1)), F.col("parts")))
    held = dealt.groupBy("last", "bucket", "part").agg(F.collect_list(F.struct("word", "n")).alias("b"))
    return scratch.save(held.select("last", "bucket", "part", F.col("b.word").alias("words"), F.col("b.n").alias("counts")), "blocks")


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of each distinct word of ``words`` (word, n).

    n_near: words at distance one. form: the most frequent of them (ties: the least by code points) if at least ``ratio`` times as frequent, else null.
    root: where following forms ends; each step multiplies the count by the ratio, so doubling the steps gets there in a few joins.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.save(words.select("word", "n"), "words")
    blocks = _blocks(words, scratch, words.count())
    queries = blocks.select("last", "bucket", F.col("part").alias("a"), F.col("words").alias("queries"))
    others = blocks.select("last", "bucket", F.col("part").alias("b"), "words", "counts")
    pairs = queries.join(others, ["last", "bucket"])  # blocks, not words: a bucket of several blocks has all their pairs
    near = arrow_map(pairs, _near, "word string, near long, best string, best_n long")
    best = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min_by(F.struct("best", "best_n"), F.struct(-F.col("best_n"), F.encode("best", "UTF-8"))).alias("b"))
    told = words.join(best, "word", "left")
    frequent = F.col("b.best_n") >= ratio * F.col("n")
    told = scratch.save(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("b.best")).alias("form"), F.when(frequent, F.col("b.best_n")).alias("form_n")), "forms")
    return told.join(_roots(told, scratch), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of the words that have a form."""
    links = scratch.save(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots-0")
    step = 0
    while True:
        step += 1
        further = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = scratch.save(links.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), f"roots-{step}")
        moved = new.filter("moved").limit(1).count()
        links = new.select("word", "root")
        if not moved:
            return links
