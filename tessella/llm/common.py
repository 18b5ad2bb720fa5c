"""Shared pieces of the training-data operators: scratch tables, word hashing, sliding minima.

Words are maximal runs of bytes other than space and 0x09-0x0D; ``bytes.split()`` cuts exactly there.
Texts travel to Python as UTF-8 bytes, so no operator pays for decoding them.
"""

from __future__ import annotations

import gc
import re
import time
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Java regex of one run of separators.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows an Arrow batch holds at most; long texts make ten thousand rows too many for a worker.
BATCH_ROWS = 1000
#: Bytes after which a batch ends early, for the same reason.
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """A fresh folder under ``spark.checkpoint.dir``: what is saved there outlives any executor.

    Saving cuts lineage, as ``checkpoint()`` does, but keeps a columnar file that later steps prune.
    Where the setting is absent, a folder under /tmp serves local masters; on a cluster that is an error, as
    executors would not see each other's files.
    """

    #: Seconds between two requests to the driver's garbage collector.
    PAUSE = 4.0
    _asked = 0.0

    def __init__(self, spark: SparkSession, label: str) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file:///tmp/tessella-{spark.sparkContext.applicationId}"
        self.spark, self.root = spark, f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self.label, self.saved, self.tables = label, set(), {}
        # Spark 4.1 takes a union of bucketed tables for bucketed, but does not align the buckets: groups come out split
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.saved.add(name)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def save_bucketed(self, df: DataFrame, name: str, key: str, *, sort: bool = False) -> DataFrame:
        """A table bucketed by ``key``: later joins on it leave its rows where they are.

        ``df`` comes out of a shuffle by ``key``, whose partitions are the buckets, so a task writes whole buckets.
        """
        n = shuffle_partitions(self.spark)
        known = f"{self.label}_{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
        writer = df.write.option("compression", "zstd").option("path", f"{self.root}/{name}").bucketBy(n, key)
        (writer.sortBy(key) if sort else writer).format("parquet").saveAsTable(known)
        self.saved.add(name)
        self.tables[name] = known
        self.release()
        return self.spark.table(known)

    def release(self) -> None:
        """Let Spark delete the shuffle files of what is saved: its cleaner waits for the driver's garbage collection."""
        if time.monotonic() - Scratch._asked >= self.PAUSE:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            Scratch._asked = time.monotonic()

    def drop(self, *names: str) -> None:
        """Delete what is saved under these names; nothing may read it any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.saved.discard(name)

    def keep_only(self, *names: str) -> None:
        self.drop(*(self.saved - set(names)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches short enough for long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    names = df.columns
    if any("." in c for c in names):  # mapInArrow takes such a name for a field of a struct
        return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(partial(_renamed, fn=fn, names=names), schema)
    return df.mapInArrow(fn, schema)


def _renamed(rows: Iterator[pa.RecordBatch], fn: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    return fn(r.rename_columns(names) for r in rows)


def batch(**columns: pa.Array | np.ndarray | list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def texts_of(rows: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """Texts as bytes; null is the empty text."""
    return [t or b"" for t in rows.column(name).to_pylist()]


class WordHashes(dict):
    """64-bit hash by word, remembered; forgets everything when a vocabulary outgrows its bound."""

    #: Bytes of the longest word that is remembered.
    LONG = 64

    def __init__(self, bound: int = 500_000) -> None:
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONG:  # longer ones hardly recur
            if len(self) >= self.bound:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-xor-multiply), so that sums of products spread over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def odd_constants(n: int, seed: int, dtype: type = np.uint64) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, np.iinfo(dtype).max, n, dtype=dtype) | dtype(1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by block-wise prefix and suffix minima."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    if width == 1:
        return values
    pad = -len(values) % width
    blocks = np.pad(values, (0, pad), constant_values=np.iinfo(values.dtype).max).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def window_anchors(gram: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of every window, and the run of windows that each anchor owns.

    gram[i]: hash of the gram at i. A window that starts at s holds the grams s .. s+width-1; its anchor
    is the leftmost with the least hash, which the window's content alone decides. ``valid`` marks the
    window starts whose windows lie within one document.
    Returns (anchor position, first owned window, last owned window), one row per anchor and run.
    """
    code = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    at = (sliding_min(code, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    s = np.flatnonzero(valid[: len(at)])
    if not len(s):
        return s, s, s
    a = at[s]
    cut = np.flatnonzero((a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(s)]]) - 1
    return a[first], s[first], s[last]


def distinct_texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per distinct text: key (binary, MD5), text (null counts as empty), copies; bucketed by key.

    Copies meet in a map-side aggregate, so a text that a third of all rows share is no hot spot.
    """
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(text_key("text"), "text")
    once = keyed.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return scratch.save_bucketed(once, "texts", "key")


def text_key(column: str) -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")))).alias("key")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, root), root the least node.

    Least labels travel along edges and then jump over each other's roots, so a chain of n nodes needs
    about log n rounds. Each round is saved; nothing but a change count reaches the driver.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    labels = scratch.save(labels, "labels-0")
    step = 0
    while True:
        step += 1
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        low = labels.join(seen, "node").select("node", "root", F.least("root", "low").alias("low"))
        roots = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = low.join(roots, "low", "left").select("node", "root", F.least("low", F.coalesce("far", "low")).alias("next"))
        new = scratch.save(new, f"labels-{step}")
        changed = new.filter(F.col("root") != F.col("next")).limit(1).count()
        scratch.drop(f"labels-{step - 1}")
        labels = new.select("node", F.col("next").alias("root"))
        if not changed:
            return labels
