"""Operator 10: sharding by sampled splitters. DataFrame functions only.

Records are ordered by (text hash, id hash, row number), so equal texts lie next to each other. A size-weighted sample
of keys gives quantile boundaries for fine ranges, whose number follows the rows; ranges that still hold more than twice their share
are subdivided, all of them in one further sample each round (id hash and row number divide even one hot text). A record finds its
range by binary search in the boundaries. Running sums inside a range plus the offset of the range give every record its place in
the total order, and shards are cut there.

Laws: ``bytes`` cuts at equal shares of the summed sizes, ``rows`` at equal shares of the count. Under
``bytes`` a cut that falls into a group of equal texts moves to the group's nearer end, unless the group
is larger than ``whole_share`` of a shard; then the cut stays inside, between two rows.

Defined results: a null text has size 1 and CRC 0 and is one group with the empty text; null ids are
ordinary keys; rows that repeat are separate records; very long texts count whole; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

#: A cut may move by this share of a shard to keep a group of equal texts whole.
WHOLE_SHARE = 0.05
#: Records of a range, sampled keys for each range (both as expected), and rounds of subdivision.
RANGE_ROWS, SAMPLES_PER_RANGE, ROUNDS = 1_000_000, 24, 4

Key = tuple[int, int, int]


def shard(docs: DataFrame, n_shards: int = 8, law: str = "bytes", whole_share: float = WHOLE_SHARE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: no law here is by key)."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"law must be bytes or rows, not {law!r}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = scratch.save(docs.select(
        F.col("doc_id").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("k1"), F.xxhash64("doc_id").alias("k2"), F.monotonically_increasing_id().alias("k3")), "keyed")  # fixed once written
    weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    keyed = keyed.withColumn("weight", weight)
    total, rows = keyed.agg(F.sum("weight"), F.count(F.lit(1))).first()
    if not rows:
        return keyed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    n_ranges = min(rows, max(2 * n_shards, shuffle_partitions(spark), math.ceil(rows / RANGE_ROWS)))
    splitters = _splitters(keyed.withColumn("range", F.lit(0)), {0: total}, total / n_ranges, 0)
    for turn in range(1, ROUNDS + 1):
        ranged = _ranged(keyed, splitters)
        held = {r["range"]: (r["w"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect()}
        over = {r: w for r, (w, n) in held.items() if w > 2 * total / n_ranges and n > 1}
        more = _splitters(ranged, over, total / n_ranges, turn) if over and turn < ROUNDS else []
        if not set(more) - set(splitters):
            break
        splitters = sorted({*splitters, *more})

    before, first, base, base_row = [], [], 0, 0
    for r in range(len(splitters) + 1):
        before.append(base)
        first.append(base_row)
        base, base_row = base + held.get(r, (0, 0))[0], base_row + held.get(r, (0, 0))[1]
    offsets = spark.createDataFrame([(before, first)], "before array<long>, first array<long>")  # one row
    order = Window.partitionBy("range").orderBy("k1", "k2", "k3")
    inside = ranged.select("doc_id", "size", "text_crc32", "k1", "weight", "range", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(order).alias("number"))
    placed = inside.join(F.broadcast(offsets)).select(
        "doc_id", "size", "text_crc32", "k1", "weight", (F.col("before")[F.col("range")] + F.col("upto") - F.col("weight")).alias("begin"), (F.col("first")[F.col("range")] + F.col("number") - 1).alias("row"))
    placed = scratch.save(placed, "placed")
    scratch.keep_only("placed")
    cuts = _cuts(placed, total, n_shards, whole_share if law == "bytes" else 0.0)
    shard_of = sum((F.when(F.col("begin") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    out = placed.withColumn("shard", shard_of)
    starts = {r["shard"]: r["start"] for r in out.groupBy("shard").agg(F.min("row").alias("start")).collect()}
    start = F.lit([starts.get(s, 0) for s in range(n_shards)])[F.col("shard")]
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("row") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _splitters(ranged: DataFrame, weights: dict[int, int], share: float, turn: int) -> list[Key]:
    """Quantile boundaries that cut each of the ranges (by weight) into pieces of about ``share``.

    Keys are drawn with chance proportional to their weight (by hash, so reruns agree), in one job for all ranges: about
    SAMPLES_PER_RANGE a piece reach the driver.
    """
    pieces = {r: math.ceil(w / share) for r, w in weights.items()}
    rates = [(r, n * SAMPLES_PER_RANGE / weights[r]) for r, n in pieces.items() if n > 1]
    if not rates:
        return []
    wanted = ranged.sparkSession.createDataFrame(rates, "range int, rate double")  # a row for each overfull range
    chance = F.pmod(F.xxhash64("k1", "k2", "k3", F.lit(20 + turn)), F.lit(1 << 30)) / float(1 << 30)
    drawn = ranged.join(F.broadcast(wanted), "range").filter(chance < F.col("weight") * F.col("rate")).select("range", "k1", "k2", "k3").collect()
    found: set[Key] = set()
    for r, keys in groupby(sorted((x["range"], x["k1"], x["k2"], x["k3"]) for x in drawn), key=lambda x: x[0]):
        own = [k[1:] for k in keys]
        found |= {own[min(len(own) - 1, i * len(own) // pieces[r])] for i in range(1, pieces[r])}
    return sorted(found)


def _ranged(keyed: DataFrame, splitters: list[Key]) -> DataFrame:
    """``keyed`` with the number of splitters at or below each key, by binary search in one broadcast row."""
    columns = [list(x) for x in zip(*splitters, strict=True)] or [[], [], []]
    bounds = keyed.sparkSession.createDataFrame([tuple(columns)], "b1 array<long>, b2 array<long>, b3 array<long>")
    found = _search(len(splitters)) if splitters else F.lit(0)
    return keyed.join(F.broadcast(bounds)).select(*keyed.columns, found.alias("range"))


def _search(n: int) -> Column:
    def at_or_above(mid: Column) -> Column:
        b1, b2, b3 = (F.get(F.col(c), mid) for c in ("b1", "b2", "b3"))
        k1, k2, k3 = (F.col(c) for c in ("k1", "k2", "k3"))
        return (k1 > b1) | ((k1 == b1) & ((k2 > b2) | ((k2 == b2) & (k3 >= b3))))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).when(at_or_above(mid), F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), step, lambda s: s["lo"])


def _cuts(placed: DataFrame, total: int, n_shards: int, whole_share: float) -> list[int]:
    """Values of ``begin`` at which shards 1, 2, ... start."""
    share = total / n_shards
    wanted = [round(i * share) for i in range(1, n_shards)]
    hit = sum((F.when((F.col("begin") < w) & (F.col("begin") + F.col("weight") > w), 1).otherwise(0) for w in wanted), F.lit(0)) > 0
    rows = sorted((r["begin"], r["weight"], r["k1"], r["text_crc32"]) for r in placed.filter(hit).collect())
    groups = {}
    if rows and whole_share:
        at = {(k1, crc) for _, _, k1, crc in rows} | set()
        member = F.lit(False)
        for k1, crc in sorted(at):
            member = member | ((F.col("k1") == k1) & (F.col("text_crc32") == crc))
        groups = {(r["k1"], r["text_crc32"]): (r["lo"], r["hi"]) for r in placed.filter(member).groupBy("k1", "text_crc32").agg(F.min("begin").alias("lo"), F.max(F.col("begin") + F.col("weight")).alias("hi")).collect()}
    begins = [r[0] for r in rows]
    cuts = []
    for w in wanted:
        i = bisect_right(begins, w) - 1
        if i < 0 or not rows[i][0] < w < rows[i][0] + rows[i][1]:
            cuts.append(w)  # between two rows already
            continue
        begin, weight, k1, crc = rows[i]
        lo, hi = groups.get((k1, crc), (begin, begin + weight))
        if hi - lo > whole_share * share:
            lo, hi = begin, begin + weight
        cuts.append(lo if w - lo <= hi - w else hi)
    return cuts
