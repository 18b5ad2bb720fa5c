"""Hard negatives by an inverted multi-index: exact for every anchor, whatever the data.

Vectors are cut into two halves, each half has a codebook, and a pair of code words is a cell. For an anchor q, a half with code word c and radius r
(the greatest distance of a member to it) holds no score above <q, c> + |q| r, so the sum of two such bounds holds for a cell. A heap
visits cells by that sum (the multi-sequence walk over both sorted halves). A search for the k best scores within a window stops once no cell left can
hold a score that would enter: that certifies it. Nothing is capped: an anchor goes on until it is certified.

Spark's part: the rows of a cell lie in blocks of about ``BLOCK`` rows, anchors in blocks of about ``ANCHORS``; a round joins the blocks that anchors
visit with the anchors, a task multiplies one pair of blocks at a time, and a window keeps the best of each search. Rounds visit 8, 64, 512, ... cells;
most searches end in the first. A cell that holds a third of all rows, or one vector many times, is many blocks, dealt by a hash.

Rows with a null label, a null vector, or a null or non-finite component take no part. Components become floor(256 x), scores are integer inner products
(below 2^56), a shorter vector counts as filled with zeros. Repeated rows each count, a row is only never its own positive; equal scores
are ordered by id, a null id last. Labels are integers. An empty table, or one without anchors or pairs, gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, batch

SCALE = 256
#: Rows of a block, anchors of a block, rows that the codebooks are fitted on, and code words of a half at most.
BLOCK, ANCHORS, SAMPLE, MAX_WORDS = 1024, 256, 8192, 64
#: Cells that the first round visits; each further round goes eight times as far.
FIRST_CELLS = 8
FAR = 1 << 62
#: Stands for a null id, after all others, until the result is told.
NO_ID = (1 << 63) - 1
LLOYD_ROUNDS = 12


def clean(rows: DataFrame, id: str, label: str, vector: str, anchor: Column) -> DataFrame:
    """uid, id, label, v (array of long), anchor: the rows that take part, each with a number of its own."""
    v = F.col(vector).cast("array<double>")
    good = F.col(label).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * SCALE))
    return rows.filter(F.coalesce(good, F.lit(False))).select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))


def codebook(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k code words by Lloyd's rounds; fewer where there are fewer different rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    words = distinct[rng.permutation(len(distinct))[:k]].astype(float)
    for _ in range(LLOYD_ROUNDS):
        own = nearest_word(x, words)
        n = np.bincount(own, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, own, x)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def nearest_word(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(axis=1)[None, :] - 2 * x @ words.T).argmin(axis=1)


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _celled(batches: Iterator[pa.RecordBatch], books, width: int) -> Iterator[pa.RecordBatch]:
    """Cell of each row, and how far its halves are from the code words."""
    half = width // 2
    for rows in batches:
        if not rows.num_rows:
            continue
        x = _lists(rows.column("v")).reshape(-1, width).astype(float)
        own, apart = [], []
        for words, part in zip(books.value, (x[:, :half], x[:, half:]), strict=True):
            w = nearest_word(part, words)
            own.append(w)
            apart.append(np.sqrt(((part - words[w]) ** 2).sum(axis=1)))
        cell = (own[0] * len(books.value[1]) + own[1]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell), pa.array(apart[0]), pa.array(apart[1])], [*rows.schema.names, "cell", "r1", "r2"])


class Index:
    """What every task needs of the multi-index: code words, radii, and the blocks of each cell; at most MAX_WORDS squared cells."""

    def __init__(self, books: list[np.ndarray], cells: list[tuple[int, int, float, float]], width: int) -> None:
        self.books, self.half = books, width // 2
        shape = (len(books[0]), len(books[1]))
        self.count = np.zeros(shape, np.int64)
        self.radius = np.zeros((2, *shape))
        for cell, n, r1, r2 in cells:
            at = divmod(cell, shape[1])
            self.count[at], self.radius[0][at], self.radius[1][at] = n, r1, r2
        self.blocks = -(-self.count // BLOCK)
        self.first = self.blocks.ravel().cumsum().reshape(shape) - self.blocks
        self.half_radius = [self.radius[0].max(axis=1), self.radius[1].max(axis=0)]

    def walk(self, q: np.ndarray, need: float, most: float, done: int, limit: int) -> tuple[list[tuple[int, int]], int]:
        """(cells to visit, pops) of one anchor: the walk's places from ``done`` up to ``limit``, for scores from ``need`` to ``most``."""
        parts = (q[: self.half], q[self.half :])
        size = [float(np.sqrt((p * p).sum())) for p in parts]
        near = [w @ p for w, p in zip(self.books, parts, strict=True)]
        bound = [n + s * r for n, s, r in zip(near, size, self.half_radius, strict=True)]
        first, second = (np.argsort(-b, kind="stable") for b in bound)
        b1, b2 = bound[0][first], bound[1][second]
        slack = 1 + 1e-9 * (abs(b1).max() + abs(b2).max())  # of floating point
        heap, pops, found = [(-(b1[0] + b2[0]), 0, 0)], 0, []
        while heap and pops < limit:
            value, i, j = heapq.heappop(heap)
            if -value + slack < need:
                break  # certified: no cell left reaches what is needed
            if j + 1 < len(b2):
                heapq.heappush(heap, (-(b1[i] + b2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(b1):
                heapq.heappush(heap, (-(b1[i + 1] + b2[0]), i + 1, 0))
            pops += 1
            if pops <= done:
                continue
            a, b = int(first[i]), int(second[j])
            if not self.count[a, b]:
                continue
            middle, spread = near[0][a] + near[1][b], size[0] * self.radius[0][a, b] + size[1] * self.radius[1][a, b]
            if middle + spread + slack >= need and middle - spread - slack <= most:
                found.append((a, b))
        return found, pops


def _visits(batches: Iterator[pa.RecordBatch], index, width: int, k: int, done: int, limit: int) -> Iterator[pa.RecordBatch]:
    """For each block of anchors the row blocks that its open searches visit: (block, ablock, at, slot, lo, hi)."""
    idx = index.value
    for rows in batches:
        for r in range(rows.num_rows):
            x = rows.column("flat")[r].values.to_numpy().reshape(-1, width).astype(float)
            by_anchor: dict[int, list] = {}
            for s in rows.column("slots")[r].as_py():
                lo = s["lo"] if s["n"] is None or s["n"] < k else max(s["lo"], s["kth"])
                if lo <= s["hi"]:
                    by_anchor.setdefault(s["at"], []).append((s["slot"], lo, s["hi"]))
            visits: dict[int, list] = {}
            for at, slots in by_anchor.items():
                cells, _ = idx.walk(x[at], min(s[1] for s in slots), max(s[2] for s in slots), done, limit)
                for a, b in cells:
                    for block in range(int(idx.first[a, b]), int(idx.first[a, b] + idx.blocks[a, b])):
                        visits.setdefault(block, []).extend((at, *s) for s in slots)
            if visits:
                searches = list(visits.values())
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in searches])]).astype(np.int32))
                columns = np.array([s for some in searches for s in some], np.int64).T
                kinds = (np.int32, np.int32, np.int64, np.int64)
                lists = {n: pa.ListArray.from_arrays(offsets, pa.array(c.astype(t))) for n, c, t in zip(("at", "slot", "lo", "hi"), columns, kinds, strict=True)}
                yield batch(block=np.array(list(visits), np.int32), ablock=np.full(len(visits), rows.column("ablock")[r].as_py(), np.int32), **lists)


def _best(batches: Iterator[pa.RecordBatch], width: int, k: int, same: bool, wide: bool) -> Iterator[pa.RecordBatch]:
    """The k best rows of a block for each search that visits it, (ablock, at, slot, score, id, uid); one pair of blocks at a time."""
    kind = np.int64 if wide else np.float64  # doubles hold the products exactly unless they are wide
    for rows in batches:
        for r in range(rows.num_rows):
            get = lambda name: rows.column(name)[r].values.to_numpy()  # noqa: B023, E731
            x, q = get("flat").reshape(-1, width).astype(kind), get("aflat").reshape(-1, width).astype(kind)
            ids, uids, labels = get("ids"), get("uids"), get("labels")
            auids, alabels = get("auids"), get("alabels")
            at, slot, lo, hi = (get(n) for n in ("at", "slot", "lo", "hi"))
            used, place = np.unique(at, return_inverse=True)
            scores = q[used] @ x.T
            scores = scores.astype(np.int64)
            fits = (labels[None, :] == alabels[used][:, None]) == same
            fits &= uids[None, :] != auids[used][:, None]
            out = []
            for n in range(len(at)):
                row = scores[place[n]]
                ok = np.flatnonzero(fits[place[n]] & (row >= lo[n]) & (row <= hi[n]))
                if len(ok) > k:
                    s = row[ok]
                    ok = ok[s >= np.partition(s, len(s) - k)[len(s) - k]]
                if len(ok):
                    ok = ok[np.lexsort((uids[ok], ids[ok], -row[ok]))[:k]]
                    out.append((np.full(len(ok), at[n]), np.full(len(ok), slot[n]), row[ok], ids[ok], uids[ok]))
            if out:
                a, s, score, i, u = (np.concatenate(c) for c in zip(*out, strict=True))
                yield batch(ablock=np.full(len(a), rows.column("ablock")[r].as_py(), np.int32), at=a.astype(np.int32), slot=s.astype(np.int32), score=score, id=i, uid=u)


FOUND = "ablock int, at int, slot int, score long, id long, uid long"


class _Search:
    """Rounds of visits until every search of a phase is certified."""

    def __init__(self, scratch: Scratch, index: Index, blocks: DataFrame, anchors: DataFrame, width: int, wide: bool) -> None:
        self.scratch, self.index, self.blocks, self.anchors, self.width, self.wide = scratch, index, blocks, anchors, width, wide
        self.shared = scratch.spark.sparkContext.broadcast(index)
        self.rounds: list[int] = []

    def best(self, slots: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """(FOUND, rank): the k best rows of each search in slots (ablock, at, slot, lo, hi)."""
        order = Window.partitionBy("ablock", "at", "slot").orderBy(F.desc("score"), "id", "uid")
        found = self.scratch.spark.createDataFrame([], FOUND)
        done, limit, turn, cells = 0, FIRST_CELLS, 0, self.index.count.size
        while done < cells:
            limit = min(limit, cells)
            kth = found.groupBy("ablock", "at", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
            state = slots.join(kth, ["ablock", "at", "slot"], "left").groupBy("ablock").agg(F.collect_list(F.struct("at", "slot", "lo", "hi", "n", "kth")).alias("slots"))
            walk = partial(_visits, index=self.shared, width=self.width, k=k, done=done, limit=limit)
            visits = self.scratch.save(arrow_map(state.join(self.anchors.select("ablock", "flat"), "ablock"), walk, "block int, ablock int, at array<int>, slot array<int>, lo array<long>, hi array<long>"), f"{name}-visits-{turn}")
            self.rounds.append(visits.count())
            if self.rounds[-1]:
                mine = self.anchors.select("ablock", F.col("uids").alias("auids"), F.col("labels").alias("alabels"), F.col("flat").alias("aflat"))
                pairs = visits.join(self.blocks, "block").join(mine, "ablock")
                new = arrow_map(pairs, partial(_best, width=self.width, k=k, same=same, wide=self.wide), FOUND)
                ranked = found.unionByName(new).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                found = self.scratch.save(ranked.drop("rank"), f"{name}-found-{turn}")
            done, limit, turn = limit, limit * 8, turn + 1
        return found.withColumn("rank", F.row_number().over(order))


def _packed(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """A row a block: uids, ids, labels and the vectors one after another."""
    held = rows.groupBy(key).agg(F.collect_list(F.struct("uid", "id", "label", F.col("v").cast(f"array<{kind}>").alias("v"))).alias("b"))
    return held.select(key, F.col("b.uid").alias("uids"), F.col("b.id").alias("ids"), F.col("b.label").alias("labels"), F.flatten("b.v").alias("flat"))


def hard_negatives(rows: DataFrame, id: str, label: str, vector: str, anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, n_words: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor``: condition on the rows' own columns that makes a row an anchor. Its positives are its ``n_positives`` best rows of the same label; for each,
    the first ``n_negatives`` rows of another label whose score lies between ``low`` and ``high`` percent of the positive's.
    ``n_words``: code words of a half; by default cells hold about half a thousand rows, and a half at most MAX_WORDS words.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    own = scratch.save(clean(rows, id, label, vector, anchor), "rows")
    n, n_anchors, width, top = own.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    width, top = max(2, width + width % 2), top or 0
    kind = "smallint" if top < 1 << 15 else "int" if top < 1 << 31 else "long"
    wide = top * top * width >= 1 << 53
    filled = own.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    k = n_words or int(min(MAX_WORDS, max(1, round((n / (BLOCK / 2)) ** 0.5))))
    some = filled.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("v").toPandas()  # the codebooks' bounded sample
    x = np.array(some["v"].tolist(), float)
    books = [codebook(x[:, : width // 2], k), codebook(x[:, width // 2 :], k)]
    shape = "uid long, id long, label long, v array<long>, anchor boolean, cell int, r1 double, r2 double"
    celled = scratch.save(arrow_map(filled, partial(_celled, books=spark.sparkContext.broadcast(books), width=width), shape), "celled")
    cells = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2"))
    index = Index(books, [tuple(r) for r in cells.collect()], width)  # at most MAX_WORDS squared rows
    held, first = (F.lit([int(b) for b in x.ravel()])[F.col("cell")] for x in (index.blocks, index.first))
    blocks = scratch.save(_packed(celled.withColumn("block", (first + F.pmod(F.xxhash64("uid"), held)).cast("int")), "block", kind), "blocks")
    chosen = celled.filter("anchor").withColumn("ablock", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(-(-n_anchors // ANCHORS))).cast("int"))
    anchors = scratch.save(_packed(chosen, "ablock", kind), "anchors")
    search = _Search(scratch, index, blocks, anchors, width, wide)
    each = anchors.select("ablock", F.posexplode("ids").alias("at", "anchor_id"))
    slots = each.select("ablock", "at", F.lit(0).alias("slot"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi"))
    best = search.best(slots, n_positives, True, "positive")
    positives = scratch.save(best.select("ablock", "at", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score")
    windows = positives.select("ablock", "at", "slot", (-_hundredth(-low * p)).alias("lo"), _hundredth(high * p).alias("hi"))
    negatives = search.best(windows.filter("lo <= hi"), n_negatives, False, "negative")
    told = positives.join(negatives, ["ablock", "at", "slot"]).join(each, ["ablock", "at"])
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return told.select(known("anchor_id").alias("anchor_id"), known("positive_id").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _hundredth(x: Column) -> Column:
    """floor(x / 100) of whole numbers, without going through doubles."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))
