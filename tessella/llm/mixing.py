"""Operator 3: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets. Sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share all words; a target stops
   at ``max_repeats`` times its source's size and the excess is shared again by weight until none is above.
   That is water-filling: target = min(cap, level * weight), found exactly by sorting cap / weight.
2. Blocks. A source's documents lie in blocks of about BLOCK_DOCS by a seeded hash, at any size of the source, and the blocks
   are permuted by another.
3. Quotas. A source with target t and size s is passed over floor(t / s) times in full, so each of these passes has a quota of
   all its blocks. The remaining t mod s words are a last pass, whose quota is as many permuted blocks as hold them.
4. The splitting tree. A node with output shards [lo, hi) holds the quotas still to be dealt, by source and pass; its left half
   gets a multivariate-hypergeometric draw of them, and so on down to single shards: exact, disjoint, and every shard has the mix of the
   whole in expectation.
5. Leaves. A shard's quota of a pass is a range of that pass's block order; the leaf draws the blocks in it. A document takes its words
   once for each leaf that draws its block. Only the last block of a last pass is drawn in part: its documents in
   hashed order, the last of them by a prefix, so that a source's words hit its target.
6. Local shuffle. Each copy has a seeded ``order`` that places it within its shard; ``mixed_documents`` writes them so.

The driver sees one row per source and the tree's integer quotas, never documents or blocks. The running sums over a source's
blocks go by segments of SEGMENT blocks, so a source with a third of all rows is no single task.

Defined results: null text has size 0 (target shares are not changed by it, taken 0); a null source is one source; if all
sizes are 0 every target is 0; repeated rows are separate documents (where a cut falls on such rows they share what is left
equally); very long texts are counted whole; an empty table gives no rows; other columns are ignored by ``mix`` and kept by
``mixed_documents``, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
N_SHARDS = 8
#: Documents that a block holds on average, and blocks in a segment of a source's block order.
BLOCK_DOCS, SEGMENT = 32, 512
#: Rows (about 100 bytes each) of blocks or sources that are broadcast to the documents; beyond it the join is shuffled.
BROADCAST_ROWS = 100_000
#: Sources whose sums the driver holds; more are refused.
MAX_SOURCES = 200_000


def targets(sizes: list[int], weights: list[float], max_repeats: int = MAX_REPEATS) -> list[float]:
    """Water-filling: shares of sum(sizes) by weight, none above max_repeats * size."""
    total, caps = float(sum(sizes)), [max_repeats * s for s in sizes]
    out, left_words, left_weight = [0.0] * len(sizes), total, float(sum(weights))
    for i in sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i]):
        level = left_words / left_weight if left_weight > 0 else 0.0
        out[i] = min(float(caps[i]), level * weights[i])
        left_words, left_weight = left_words - out[i], left_weight - weights[i]
    return out


def splitting_tree(quotas: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """quotas[k] blocks of kind k, dealt to shards: result[shard, k], columns add up to quotas.

    Each node draws its left half's blocks without replacement from its own: one multivariate-hypergeometric draw.
    """
    out = np.zeros((n_shards, len(quotas)), np.int64)

    def deal(lo: int, hi: int, held: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = held
            return
        mid = (lo + hi) // 2
        take = int(held.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(held, take, method="marginals")
        deal(lo, mid, left)
        deal(mid, hi, held - left)

    deal(0, n_shards, quotas.astype(np.int64))
    return out


def mix(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, passes (whole copies), part (words of a further prefix),
    shards and orders (arrays: the output shard and the shuffled place in it of each whole copy, then of the part)."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(sized_documents(docs, seed), "sized")
    drawn = drawn_documents(sized, sized, scratch, n_shards, seed, weights, max_repeats)
    words = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    whole = F.size(F.filter("copies", lambda c: c["whole"]))
    part = F.aggregate(F.filter("copies", lambda c: ~c["whole"]), F.lit(0).cast("long"), lambda s, c: s + c["words"])
    return drawn.select("doc_id", "size", "source_size", "target", words.alias("taken"), "source", whole.alias("passes"), part.alias("part"),
                        F.col("copies.shard").alias("shards"), F.col("copies.order").alias("orders"))


def mixed_documents(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix as rows of ``docs``: each as often as it is drawn, in shuffled order by shard within each partition.

    A part counts as a copy if it is at least half of the text. The texts are shuffled once, by block.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(sized_documents(docs, seed), "sized")
    carried = sized_documents(docs, seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    drawn = drawn_documents(sized, carried, scratch, n_shards, seed, weights, max_repeats, by_block=True)
    taken = F.filter("copies", lambda c: c["whole"] | ((c["words"] > 0) & (2 * c["words"] >= F.col("size"))))
    copies = drawn.select("row", F.explode(taken).alias("copy"))
    return copies.sortWithinPartitions("copy.shard", "copy.order").select("row.*")


def sized_documents(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != "")).cast("long")
    return docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), words.alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("place"), *more)


def drawn_documents(sized: DataFrame, rows: DataFrame, scratch: Scratch, n_shards: int, seed: int, weights: tuple[float, ...], max_repeats: int, *, by_block: bool = False) -> DataFrame:
    """``rows`` (those of ``sized``, maybe with more columns) with source_size, target and copies: an array of (shard, words, whole, order).

    by_block: lay the rows out by block, in one shuffle.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    found = sums.orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    goal = targets([r["words"] for r in found], [weights[i % len(weights)] for i in range(len(found))], max_repeats)
    plan = []
    for i, (r, t) in enumerate(zip(found, goal, strict=True)):
        whole = min(max_repeats, int((t + 1e-6) // r["words"])) if r["words"] else 0
        rest = max(0, round(t - whole * r["words"])) if whole < max_repeats else 0
        plan.append((i, r["source"], r["words"], float(t), whole, rest, max(1, r["docs"] // BLOCK_DOCS)))
    sources = spark.createDataFrame(plan, "source_no int, known string, source_size long, target double, whole int, rest long, n_blocks long")
    if len(plan) <= BROADCAST_ROWS:
        sources = F.broadcast(sources)

    def in_blocks(some: DataFrame) -> DataFrame:
        joined = some.join(sources, F.col("source").eqNullSafe(F.col("known"))).drop("known")
        return joined.withColumn("block", F.pmod(F.xxhash64("place", F.lit(1)), F.col("n_blocks")))

    there = scratch.save(in_blocks(sized), "in_blocks")
    blocks = _in_order(there, scratch, seed)
    counts = blocks.groupBy("source_no").agg(F.count(F.lit(1)).alias("all"), F.sum((F.col("before") < F.col("rest")).cast("long")).alias("some"), F.first("whole").alias("whole")).orderBy("source_no").collect()
    kinds = [(r["source_no"], r["all"]) for r in counts for _ in range(r["whole"])] + [(r["source_no"], r["some"]) for r in counts]
    dealt = np.cumsum(splitting_tree(np.array([q for _, q in kinds], np.int64), n_shards, seed), axis=0) if kinds else np.zeros((n_shards, 0), np.int64)
    ends: dict[int, list] = {}
    for k, (no, _) in enumerate(kinds):  # whole passes first, the last pass last
        ends.setdefault(no, []).append([int(x) for x in dealt[:, k]])
    ranges = spark.createDataFrame([(r["source_no"], r["all"], ends[r["source_no"]]) for r in counts], "source_no int, all long, ends array<array<long>>")

    # the leaf whose range holds the block's turn; a whole pass goes through the same circle of blocks from a place of its own
    leaf = lambda e, turn: F.size(F.filter(e, lambda x: x <= turn))
    turn_in = lambda k: F.when(k < F.col("whole"), F.pmod(F.col("turn") + F.floor((k + 1) * F.col("all") / (max_repeats + 1)), F.col("all"))).otherwise(F.col("turn"))
    leaves = F.transform("ends", lambda e, k: leaf(e, turn_in(k)))
    last = F.least(F.col("block_words"), F.greatest(F.lit(0), F.col("rest") - F.col("before")))
    blocks = blocks.join(ranges, "source_no").select("source_no", "block", leaves.alias("leaves"), last.alias("last"), (last < F.col("block_words")).alias("cut"))
    blocks = scratch.save(blocks, "blocks")
    cuts = _cuts(there, blocks.filter("cut AND last > 0"), len(plan))
    blocks = blocks.join(cuts, ["source_no", "block"], "left")
    if sum(r["all"] for r in counts) <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)

    placed = there if rows is sized else in_blocks(rows)
    if by_block:
        placed = placed.repartition("source_no", "block")
    full = placed.join(blocks, ["source_no", "block"])
    part = F.when(~F.col("cut") | (F.col("place") < F.col("cut_place")), F.col("size")).when(F.col("place") == F.col("cut_place"), F.col("cut_words")).otherwise(F.lit(0).cast("long"))
    each = F.transform("leaves", lambda shard, k: F.struct(
        shard.alias("shard"), F.when(k < F.col("whole"), F.col("size")).otherwise(part).alias("words"), (k < F.col("whole")).alias("whole"), F.xxhash64("place", shard, k, F.lit(seed)).alias("order")))
    copies = F.filter(each, lambda c: (c["shard"] < n_shards) & (c["whole"] | (c["words"] > 0)))
    return full.select(*rows.columns, "source_size", "target", copies.alias("copies"))


def _in_order(placed: DataFrame, scratch: Scratch, seed: int) -> DataFrame:
    """Blocks with their words, turn in the source's permuted order and the words before them."""
    blocks = placed.groupBy("source_no", "block").agg(F.sum("size").alias("block_words"), *[F.first(c).alias(c) for c in ("rest", "whole", "n_blocks")])
    perm = F.xxhash64("source_no", "block", F.lit(seed))
    segments = F.ceil(F.col("n_blocks") / SEGMENT)
    segment = F.least(segments - 1, F.floor((perm / float(1 << 64) + 0.5) * segments))  # rises with perm
    blocks = scratch.save(blocks.select("source_no", "block", "block_words", "rest", "whole", perm.alias("perm"), segment.alias("segment")), "unordered")
    by_segment = blocks.groupBy("source_no", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("block_words").alias("w"))
    ahead = Window.partitionBy("source_no").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = by_segment.select("source_no", "segment", F.coalesce(F.sum("n").over(ahead), zero).alias("turns"), F.coalesce(F.sum("w").over(ahead), zero).alias("words"))
    inside = Window.partitionBy("source_no", "segment").orderBy("perm", "block")
    numbered = blocks.select("source_no", "block", "block_words", "rest", "whole", "segment", (F.row_number().over(inside) - 1).alias("own_turn"),
                             (F.sum("block_words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_words")).alias("own_words"))
    out = numbered.join(starts, ["source_no", "segment"]).select("source_no", "block", "block_words", "rest", "whole", (F.col("turns") + F.col("own_turn")).alias("turn"), (F.col("words") + F.col("own_words")).alias("before"))
    return scratch.save(out, "ordered")


def _cuts(placed: DataFrame, cut_blocks: DataFrame, n_sources: int) -> DataFrame:
    """source_no, block, cut_place, cut_words: up to where a block's documents are taken. At most one block of each source."""
    wanted = cut_blocks.select("source_no", "block", "last")
    if n_sources <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    groups = placed.join(wanted, ["source_no", "block"]).groupBy("source_no", "block", "place").agg(F.first("last").alias("last"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("source_no", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # the documents of one block
    so_far = groups.withColumn("end", F.sum(F.col("size") * F.col("n")).over(upto)).filter("end > last")
    first = so_far.groupBy("source_no", "block").agg(F.min(F.struct("place", "end", "last", "size", "n")).alias("g"))
    return first.select("source_no", "block", F.col("g.place").alias("cut_place"), F.floor((F.col("g.last") - (F.col("g.end") - F.col("g.size") * F.col("g.n"))) / F.col("g.n")).cast("long").alias("cut_words"))
