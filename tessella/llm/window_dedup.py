"""Operator 5: substring dedup by words, with a log-structured index of window fingerprints.

A window is 35 consecutive words. Every window has an anchor, the 8-word gram in it whose hash is least: equal windows have equal anchors
at equal places, so a window can occur twice only if its anchor's gram does. ``FingerprintIndex`` keeps the anchors of all windows ever seen:

* a batch's anchors go to a log (gram, key of the text, windows owned), which is never rewritten;
* their grams, counted by a map-side aggregate, become an immutable run, bucketed and sorted, of one row per gram;
* the run is merge-joined with the runs before it, which stay where they are: grams that now occur twice are returned, also those
  whose only occurrence so far lies in an old batch. No old text is read for it;
* once more than MAX_RUNS runs have gathered, they are compacted into one and dropped.

Windows under recurring grams, wherever in the log they lie, are then resolved: their texts give a 64-bit fingerprint of the window's words
and a second hash of its bytes that verifies a match. Fingerprints are counted by an aggregate before they are joined back, so
a passage that a third of all texts hold meets in no single task. Each word that a repeated window covers is removed. Copies of a whole
text are one row from the start; a text with copies loses every window.

Defined results: null and blank texts have no words; texts under 35 words keep all (the digest is of the words joined by one
space); very long texts are read whole; repeated rows count as copies of each other; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, arrow_map, batch, distinct_texts, mix, text_key, texts_of
from .windows import ANCHORS, anchors_of

WINDOW, GRAM = 35, 8
#: Runs that are kept before they are compacted, and batches that a whole table is appended in.
MAX_RUNS, N_BATCHES = 2, 4
#: Odd multiplier of the polynomial hash.
BASE = np.uint64(0xD6E8FEB86659FD93)


class WordGrams:
    """Hashes of GRAM words at every word of texts laid end to end."""

    def __init__(self) -> None:
        self.words = WordHashes()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.words.of(t.split()) for t in texts]
        return rolled(np.concatenate([*each, np.empty(0, np.uint64)]), GRAM, BASE), np.array([len(h) for h in each], np.int64)


def rolled(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hash of each n consecutive values, by doubling: polynomial in ``base``."""
    if len(h) < n:
        return h[:0]
    out, size, done = None, 0, h.copy()
    width, factor = 1, int(base)
    left = n
    while left:  # binary digits of n, least first
        if left & 1:
            if out is None:
                out, size = done, width
            else:
                m = min(len(done) - size, len(out)) if len(done) > size else 0
                out = out[:m] * np.uint64(factor) + done[size : size + m]
                size += width
        left >>= 1
        if left:
            done = done[: len(done) - width] * np.uint64(factor) + done[width:]
            factor, width = factor * factor % (1 << 64), width * 2
    return mix(out[: len(h) - n + 1])


class FingerprintIndex:
    """A log of anchors, and sorted immutable runs of (gram, n) over it."""

    def __init__(self, scratch: Scratch, max_runs: int = MAX_RUNS, window: int = WINDOW) -> None:
        self.scratch, self.max_runs, self.window = scratch, max_runs, window
        self.logs: list[DataFrame] = []
        self.runs: list[tuple[str, DataFrame]] = []
        self.made = 0

    def _write(self, counts: DataFrame) -> None:
        name = f"run-{self.made}"
        self.made += 1
        self.runs.append((name, self.scratch.save_bucketed(counts, name, "gram", sort=True)))

    def append(self, texts: DataFrame) -> DataFrame:
        """Add a batch (key, text). Result: the grams of its anchors that now occur twice, in it or with earlier batches; they may repeat."""
        raw = texts.select("key", F.col("text").cast("binary").alias("text"))
        log = self.scratch.save(arrow_map(raw, partial(anchors_of, grams=WordGrams, window=self.window, gram_size=GRAM), ANCHORS), f"log-{len(self.logs)}")
        past = list(self.runs)
        self._write(log.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
        run = self.runs[-1][1]
        again = run.filter("n > 1").select("gram")
        for _, old in past:  # both are bucketed by the gram
            again = again.union(run.select("gram").hint("merge").join(old.select("gram"), "gram"))
        again = self.scratch.save(again, f"again-{len(self.logs)}")
        self.logs.append(log)
        if len(self.runs) > self.max_runs:
            self.compact()
        return again

    def compact(self) -> None:
        old, self.runs = self.runs, []
        merged = old[0][1]
        for _, run in old[1:]:
            merged = merged.union(run)
        self._write(merged.groupBy("gram").agg(F.sum("n").alias("n")))
        self.scratch.drop(*(name for name, _ in old))

    def spots(self, grams: DataFrame) -> DataFrame:
        """key, spots: where the texts of all batches have anchors with one of the grams, and the windows these own."""
        log = self.logs[0]
        for more in self.logs[1:]:
            log = log.union(more)
        # two plain shuffles, so that a gram in a third of all texts can be split
        return log.join(grams, "gram", "left_semi").groupBy("key").agg(F.collect_list(F.struct("at", "first", "last")).alias("spots"))


class IndexFolder:
    """Where an index lives that outlasts its application: the same calls as ``Scratch``, under a folder of its own, and a manifest.

    What a manifest does not name does not exist: an append that was cut short leaves files that the next one overwrites. Files
    that are dropped go once a manifest without them is there.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.tables, self.dropped = spark, root.rstrip("/"), {}, []
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def save_bucketed(self, df: DataFrame, name: str, key: str, *, sort: bool = False) -> DataFrame:
        """Sorted files; a later session joins them by an ordinary shuffle."""
        return self.save(df.sortWithinPartitions(key) if sort else df, name)

    def drop(self, *names: str) -> None:
        self.dropped += names

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict | None:
        """The newest whole one."""
        path, fs = self._path("manifest-*/_SUCCESS")
        found = sorted((p.getPath().getParent().getName() for p in fs.globStatus(path) or ()), key=lambda n: int(n.split("-")[1]))
        return json.loads(self.spark.read.text(f"{self.root}/{found[-1]}").first()[0]) | {"version": int(found[-1].split("-")[1])} if found else None

    def commit(self, content: dict) -> None:
        """Write a manifest, then delete what it no longer names."""
        version = (self.manifest() or {"version": -1})["version"] + 1
        self.spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest-{version}")
        for name in self.dropped:
            path, fs = self._path(name)
            fs.delete(path, True)
        self.dropped = []


class DurableIndex(FingerprintIndex):
    """A ``FingerprintIndex`` in a folder: opened, appended to and closed by one application after another.

    ``append`` gives the grams that recur, as its base does, and ``commit`` makes the batch part of the index; without it the folder stays as it was.
    Batches are told apart by the order of their commits. One application writes at a time.
    """

    COUNTS = "gram long, n long"

    @classmethod
    def open(cls, spark: SparkSession, root: str, max_runs: int = MAX_RUNS, window: int = WINDOW) -> DurableIndex:
        folder = IndexFolder(spark, root)
        index, found = cls(folder, max_runs, window), folder.manifest()
        if found:
            if found["window"] != window:
                raise ValueError(f"this index has windows of {found['window']} words")
            read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder.root}/{name}")
            index.logs = [read(name, ANCHORS) for name in found["logs"]]
            index.runs = [(name, read(name, cls.COUNTS)) for name in found["runs"]]
            index.made = found["made"]
        return index

    def commit(self) -> None:
        self.scratch.commit({"window": self.window, "made": self.made, "logs": [f"log-{i}" for i in range(len(self.logs))], "runs": [name for name, _ in self.runs]})


def _fingerprints(rows: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for part in rows:
        found, checks, owner, at = [], [], [], []
        for i, (t, spots) in enumerate(zip(texts_of(part), part.column("spots").to_pylist(), strict=True)):
            words = t.split()
            starts = np.concatenate([np.arange(s["first"], s["last"] + 1, dtype=np.int32) for s in spots])
            found.append(rolled(hashes.of(words), window, BASE)[starts])
            plain = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            lo, hi = (ends[starts] - 1 - np.fromiter((len(words[s]) for s in starts.tolist()), np.int64, len(starts))).tolist(), (ends[starts + window - 1] - 1).tolist()
            checks.append(np.fromiter((xxhash.xxh3_64_intdigest(plain[a:b], seed=5) for a, b in zip(lo, hi, strict=True)), np.uint64, len(starts)))
            owner.append(np.full(len(starts), i))
            at.append(starts)
        join = lambda xs, t: np.concatenate([*xs, np.empty(0, t)]).astype(t)
        yield batch(window=join(found, np.uint64).view(np.int64), verify=join(checks, np.uint64).view(np.int64), key=part.column("key").take(pa.array(join(owner, np.int64))), at=join(at, np.int32))


def _kept(rows: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for part in rows:
        out = []
        for t, copies, starts in zip(texts_of(part), part.column("copies").to_pylist(), part.column("starts").to_pylist(), strict=True):
            words = t.split()
            n = len(words)
            gone = np.zeros(n, bool)
            if copies > 1 and n >= window:
                gone[:] = True
            elif starts:
                edges = np.zeros(n + 1, np.int32)
                np.add.at(edges, np.array(starts), 1)
                np.add.at(edges, np.array(starts) + window, -1)
                gone = np.cumsum(edges[:n]) > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
            spans = [{"first": a, "last": b - 1} for a, b in zip(turns[::2], turns[1::2], strict=True)]
            kept = [words[i] for i in np.flatnonzero(~gone)] if spans else words
            out.append((n, n - len(kept), spans, b" ".join(kept)))
        yield batch(key=part.column("key"), n_words=np.array([x[0] for x in out], np.int64), n_removed=np.array([x[1] for x in out], np.int64),
                    spans=pa.array([x[2] for x in out], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), kept=pa.array([x[3] for x in out], pa.binary()))


def repeats_removed(docs: DataFrame, window: int = WINDOW, n_batches: int = N_BATCHES, max_runs: int = MAX_RUNS) -> DataFrame:
    """key, n_words, n_removed, spans (of removed words, both ends included), kept (bytes): one row per distinct text."""
    scratch = Scratch(docs.sparkSession, "windows")
    texts = distinct_texts(docs, scratch)
    index, again = FingerprintIndex(scratch, max_runs, window), None
    for i in range(n_batches):
        found = index.append(texts.filter(F.pmod(F.xxhash64("key"), F.lit(n_batches)) == i))
        again = found if again is None else again.union(found)
    grams = scratch.save(again.distinct(), "recurring")
    spots = scratch.save(index.spots(grams), "spots")
    scratch.keep_only("texts", "spots")
    suspects = texts.join(spots.hint("shuffle_hash"), "key").select("key", F.col("text").cast("binary").alias("text"), "spots")
    prints = scratch.save(arrow_map(suspects, partial(_fingerprints, window=window), "window long, verify long, key binary, at int"), "prints")
    twice = scratch.save(prints.groupBy("window", "verify").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window", "verify"), "twice")
    marked = scratch.save(prints.join(twice, ["window", "verify"], "left_semi").groupBy("key").agg(F.collect_list("at").alias("starts")), "marked")
    scratch.keep_only("texts", "marked")
    cut = texts.join(marked.hint("shuffle_hash"), "key", "left").select("key", "copies", F.col("text").cast("binary").alias("text"), "starts")
    return arrow_map(cut, partial(_kept, window=window), "key binary, n_words long, n_removed long, spans array<struct<first int, last int>>, kept binary")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text (the words that are kept, joined by one space), spans: one row per document."""
    done = repeats_removed(docs, window).select("key", F.col("kept").cast("string").alias("text"), "spans")
    return docs.select(F.col("doc_id").alias("doc_id"), text_key("text")).join(done, "key").drop("key")


def substring_dedup(docs: DataFrame, window: int = WINDOW, n_batches: int = N_BATCHES, max_runs: int = MAX_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per document."""
    done = repeats_removed(docs, window, n_batches, max_runs).select("key", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select(F.col("doc_id").alias("doc_id"), text_key("text")).join(done, "key").drop("key")
