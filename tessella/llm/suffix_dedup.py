"""Operator 2: substring dedup by bytes, with sorted runs of suffixes and a merge that keeps common prefixes.

Only suffixes at suspicious anchors (``windows.suspicious_spots``: the 400-byte strings around them could occur twice)
are sorted. Map tasks sort what they hold into runs: a suffix is the hash of its first 100 bytes, then its bytes up to
the end of the last 400-byte string that its anchor owns. Runs are cut by that hash into parts and exchanged front-coded
(length of the prefix shared with the suffix before, then the rest), compressed. Each part merges its runs with a
loser tree whose nodes keep the prefix length shared with the last winner: two heads are compared only from there on,
and often not at all. The merge so yields the order and the common prefixes of neighbours without a second pass.

A 400-byte string that starts o bytes before its anchor occurs twice if two anchors agree on o bytes to the left and
400 - o to the right. With neighbours' common prefixes of the suffixes, and of the reversed left contexts, both are
class numbers (running counts of short neighbours), so each o is one sort of pairs of integers.

Suffixes with more than HOT occurrences of one first gram do not meet in one part: their 400-byte strings are counted by a
128-bit digest in a map-side aggregate instead. Copies of a whole text are one row from the start.

Defined results: null and empty texts have 0 bytes; texts under 400 bytes keep all; very long texts are read whole; repeated rows count as copies of each
other; matches never cross documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, batch, distinct_texts, mix, shuffle_partitions, text_key, texts_of
from .windows import suspicious_spots

WINDOW, GRAM = 400, 100
#: Occurrences of a gram above which its strings are counted by digest.
HOT = 20_000
#: Anchors of a part of the merge: parts follow the data, and a worker holds one part.
PART_ANCHORS = 50_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
RUN = pa.schema([("shared", pa.int32()), ("rest", pa.binary()), ("left", pa.binary()), ("key", pa.binary()), ("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
SPANS = "key binary, low int, high int"


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


class ByteGrams:
    """Hashes of ``size`` bytes at every byte of texts laid end to end: differences of one running sum."""

    def __init__(self, size: int = GRAM) -> None:
        self.size, self.up, self.down = size, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
        n = len(data)
        if n > len(self.up):
            self.up, self.down = powers(BASE, n), powers(INVERSE, n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * self.up[:n], dtype=np.uint64)])
        m = max(0, n - self.size + 1)
        return mix((sums[self.size : self.size + m] - sums[:m]) * self.down[:m]), np.array([len(t) for t in texts], np.int64)


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are not read again."""
    n = min(len(a), len(b)) - known
    differ = int.from_bytes(a[known : known + n], "big") ^ int.from_bytes(b[known : known + n], "big")
    return known + n - (differ.bit_length() + 7) // 8


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    shared = [0, *map(shared_prefix, strings, strings[1:])][: len(strings)]
    return shared, [s[k:] for s, k in zip(strings, shared, strict=True)]


def merged(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, position in it, string, prefix shared with the string before) in sorted order, from front-coded runs.

    A loser tree. Every head knows its common prefix with the last winner: of two heads the one with the longer is the
    smaller; only equal lengths are compared, from that length on, and the loser keeps what the two share.
    """
    k = len(runs)
    heads: list[bytes | None] = [r[1][0] if r[1] else None for r in runs]
    known, place = [0] * k, [0] * k
    losers = [-1] * k

    def beats(x: int, y: int) -> bool:
        """Whether head x precedes head y (ties: the earlier run). Updates what the loser shares with the winner."""
        a, b = heads[x], heads[y]
        if b is None or a is None:
            return a is not None or (b is None and x < y)
        if known[x] != known[y]:
            return known[x] > known[y]
        both = shared_prefix(a, b, known[x])
        first = a[both:] < b[both:] or (a == b and x < y)
        known[y if first else x] = both
        return first

    def up(x: int, node: int) -> int:
        while node:
            y = losers[node]
            if y < 0:
                losers[node] = x
                return -1
            if beats(y, x):
                losers[node], x = x, y
            node //= 2
        return x

    winner = -1
    for x in range(k):
        winner = up(x, (x + k) // 2)
    while winner >= 0 and heads[winner] is not None:
        w = winner
        yield w, place[w], heads[w], known[w]
        shared, rest = runs[w]
        place[w] += 1
        if place[w] < len(rest):
            known[w] = shared[place[w]]
            heads[w] = heads[w][: known[w]] + rest[place[w]]
        else:
            heads[w] = None
        winner = up(w, (w + k) // 2) if k > 1 else w


def _runs(rows: Iterator[pa.RecordBatch], parts: int, grams: type) -> Iterator[pa.RecordBatch]:
    """One row (part, run) per part and batch of texts."""
    hashed = grams()
    for part in rows:
        texts, keys = texts_of(part), part.column("key").to_pylist()
        held: dict[int, list] = {}
        for t, key, spots in zip(texts, keys, part.column("spots").to_pylist(), strict=True):
            for s in spots:
                head = s["gram"].to_bytes(8, "big", signed=True)
                held.setdefault(s["gram"] % parts, []).append((head + t[s["at"] : s["last"] + WINDOW], t[s["first"] : s["at"]], key, s["at"], s["first"], s["last"]))
        out = []
        for run in held.values():
            run.sort(key=lambda x: x[0])
            shared, rest = front_coded([x[0] for x in run])
            columns = [shared, rest, *(list(c) for c in list(zip(*run, strict=True))[1:])]
            table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RUN, strict=True)], schema=RUN)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, RUN, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            out.append(sink.getvalue().to_pybytes())
        yield batch(part=np.array(list(held), np.int32), run=pa.array(out, pa.binary()))


def _repeats(rows: pd.DataFrame) -> pd.DataFrame:
    """Merge the runs of one part; spans of bytes that repeated strings cover."""
    tables = [pa.ipc.open_stream(r).read_all() for r in rows["run"]]
    runs = [(t.column("shared").to_pylist(), t.column("rest").to_pylist()) for t in tables]
    order, shared = [], []
    offset = np.cumsum([0, *(len(t) for t in tables)])
    for run, at, _, known in merged(runs):  # strings are rebuilt one at a time and not kept
        order.append(offset[run] + at)
        shared.append(known - 8)
    whole = pa.concat_tables(tables).select(["left", "key", "at", "first", "last"]).take(pa.array(np.array(order, np.int64)))
    at, first, last = (whole.column(c).to_numpy().astype(np.int64) for c in ("at", "first", "last"))
    low, high = repeated_windows(np.array(shared, np.int64), whole.column("left").to_pylist(), at, first, last)
    hit = np.flatnonzero(high >= 0)
    return pd.DataFrame({"key": whole.column("key").take(pa.array(hit)).to_pylist(), "low": low[hit].astype(np.int32), "high": high[hit].astype(np.int32)})


def repeated_windows(shared: np.ndarray, left: list[bytes], at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor the bytes [low, high) that its repeated windows cover; high is -1 where none is.

    shared: prefix that each suffix shares with the one before it in sorted order. One anchor's windows start within
    less than a window of each other, so what they cover is one span.
    """
    n = len(at)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
    back = [x[::-1] for x in left]
    by_left = np.array(sorted(range(n), key=back.__getitem__), np.int64)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    left_shared = np.array([0, *(shared_prefix(back[a], back[b]) for a, b in zip(by_left, by_left[1:], strict=False))], np.int64)[:n]
    for o in range(int((at - first).max(initial=-1)) + 1):
        own = np.flatnonzero((at - last <= o) & (o <= at - first))
        if len(own) < 2:
            continue
        right_class = np.cumsum(shared < WINDOW - o)[own]
        left_class = np.cumsum(left_shared < o)[rank[own]]
        pair = right_class * (n + 1) + left_class
        order = np.argsort(pair, kind="stable")
        same = np.diff(pair[order]) == 0
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = own[twice]
        low[hit] = np.minimum(low[hit], at[hit] - o)
        high[hit] = np.maximum(high[hit], at[hit] - o + WINDOW)
    return low, high


def _digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in rows:
        found, keys, at = [], [], []
        for t, key, spots in zip(texts_of(part), part.column("key").to_pylist(), part.column("spots").to_pylist(), strict=True):
            for s in spots:
                for i in range(s["first"], s["last"] + 1):
                    found.append(hashlib.blake2b(t[i : i + WINDOW], digest_size=16).digest())
                    keys.append(key)
                    at.append(i)
        yield batch(digest=pa.array(found, pa.binary()), key=pa.array(keys, pa.binary()), at=np.array(at, np.int32))


def _kept(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in rows:
        out = []
        for t, copies, found in zip(texts_of(part), part.column("copies").to_pylist(), part.column("spans").to_pylist(), strict=True):
            if copies > 1 and len(t) >= WINDOW:
                found = [{"low": 0, "high": len(t)}]
            spans: list[list[int]] = []
            for s in sorted(found or [], key=lambda s: s["low"]):
                if spans and s["low"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], s["high"])
                else:
                    spans.append([s["low"], s["high"]])
            edges = [0, *(x for s in spans for x in s), len(t)]
            kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((len(t), len(t) - len(kept), [{"low": a, "high": b} for a, b in spans], kept))
        yield batch(key=part.column("key"), n_bytes=np.array([x[0] for x in out], np.int64), n_removed=np.array([x[1] for x in out], np.int64),
                    spans=pa.array([x[2] for x in out], pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))), kept=pa.array([x[3] for x in out], pa.binary()))


def repeats_removed(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """key, n_bytes, n_removed, spans (low, high of removed bytes, high not included), kept (bytes): one row per distinct text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    texts = distinct_texts(docs, scratch)
    spots = suspicious_spots(texts, scratch, ByteGrams, WINDOW, GRAM, with_counts=True)
    raw = F.col("text").cast("binary").alias("text")
    suspects = texts.join(spots.hint("shuffle_hash"), "key")
    calm = suspects.select("key", raw, F.filter("spots", lambda s: s["n"] <= hot).alias("spots")).filter("size(spots) > 0")
    n_anchors = spots.agg(F.sum(F.size("spots"))).first()[0] or 0
    parts = max(4 * shuffle_partitions(spark), -(-n_anchors // PART_ANCHORS))
    runs = scratch.save(arrow_map(calm, partial(_runs, parts=parts, grams=ByteGrams), "part int, run binary"), "runs")
    spans = scratch.save(runs.groupBy("part").applyInPandas(_repeats, SPANS), "spans")
    scratch.drop("runs")

    busy = suspects.select("key", raw, F.filter("spots", lambda s: s["n"] > hot).alias("spots")).filter("size(spots) > 0")
    strings = scratch.save(arrow_map(busy, _digests, "digest binary, key binary, at int"), "strings")
    # saved, so that the join below has two plain shuffles, of which a hot digest's can be split
    again = scratch.save(strings.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "again")
    spans = spans.union(strings.join(again, "digest", "left_semi").select("key", F.col("at").alias("low"), (F.col("at") + WINDOW).alias("high")))

    by_text = scratch.save(spans.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "by_text")
    scratch.keep_only("texts", "by_text")
    cut = texts.join(by_text.hint("shuffle_hash"), "key", "left").select("key", "copies", raw, "spans")
    return arrow_map(cut, _kept, "key binary, n_bytes long, n_removed long, spans array<struct<low int, high int>>, kept binary")


def deduplicated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, kept (the bytes that stay), spans: one row per document."""
    done = repeats_removed(docs, hot).select("key", "kept", "spans")
    return docs.select(F.col("doc_id").alias("doc_id"), text_key("text")).join(done, "key").drop("key")


def suffix_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per document."""
    done = repeats_removed(docs, hot).select("key", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select(F.col("doc_id").alias("doc_id"), text_key("text")).join(done, "key").drop("key")
