"""Neighbour-based collaborative filtering: a rating is estimated from the raters of the same item who rated other things alike.

Two users are compared over the items both rated: similarity is 1 / (1 + mean squared difference). An estimate for (user, item) is the mean of the k most similar raters'
ratings of the item, weighted by similarity; without any it is the mean of all ratings. Users lie in blocks of neighbouring ids. An item's raters and askers meet once in each block
that has some of them, as lists: what is moved is a list for each block and item, not a row for each pair of users. A task pairs the users of its block as columns of numbers, PAIRS at a time:
common items are added up only for pairs that something asks for, and only pairs that have both leave the task. Items with more than HOT raters and askers are no lists: their pairs are rows, and only asked pairs are compared over them.

Several ratings of one item by one user count as their mean; rows with a null user, item or rating take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable

#: Ratings and asked pairs of a block of users; raters and askers of an item beyond which it is no list; pairs that lists of a block may make, and pairs looked at together.
BLOCK_ROWS, HOT, BLOCK_PAIRS, PAIRS = 100_000, 1000, 4_000_000, 1_000_000


def _paired(batches: Iterator[pa.RecordBatch], min_support: int) -> Iterator[pa.RecordBatch]:
    """(u, item, v, rv, similarity) of the blocks in a partition; all pairs of a user of theirs as the lesser one are in it."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    lists = pa.Table.from_batches(held).combine_chunks()
    item, own, others = (lists.column(c).combine_chunks() for c in ("item", "own", "others"))
    sizes = [np.diff(side.offsets.to_numpy()) for side in (own, others)]
    own, others = own.flatten(), others.flatten()
    names, code = np.unique(np.concatenate([side.field("user").to_numpy(zero_copy_only=False) for side in (own, others)]), return_inverse=True)
    a, b = code[: len(own)], code[len(own) :]
    (ra, asks_a), (rb, asks_b) = ((side.field("rating").to_numpy(zero_copy_only=False), side.field("rating").is_null().to_numpy(zero_copy_only=False)) for side in (own, others))
    at = np.repeat(np.arange(len(item)), sizes[0])  # the list of an entry
    order = np.argsort(a, kind="stable")
    a, ra, asks_a, at = a[order], ra[order], asks_a[order], at[order]
    met, first = sizes[1][at].astype(np.int64), (sizes[1].cumsum() - sizes[1])[at]
    before = np.concatenate([[0], met.cumsum()])
    users = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))  # where each user begins
    start = 0
    while start < len(users) - 1:
        end = max(start + 1, int(np.searchsorted(before[users], before[users[start]] + PAIRS, side="right")) - 1)
        lo, hi = users[start], users[end]
        start = end
        i = np.repeat(np.arange(lo, hi), met[lo:hi])
        j = np.arange(len(i)) + np.repeat(first[lo:hi] - (before[lo:hi] - before[lo]), met[lo:hi])
        kept = b[j] > a[i]
        i, j = i[kept], j[kept]
        pair = a[i] * len(names) + b[j]
        asking = np.flatnonzero(asks_a[i] != asks_b[j])
        asked = np.unique(pair[asking])
        both = np.flatnonzero(~(asks_a[i] | asks_b[j]))
        if not len(asked) or not len(both):
            continue
        place = np.minimum(np.searchsorted(asked, pair[both]), len(asked) - 1)
        wanted = asked[place] == pair[both]
        both, place = both[wanted], place[wanted]
        support = np.bincount(place, minlength=len(asked))
        squares = np.bincount(place, weights=(ra[i[both]] - rb[j[both]]) ** 2, minlength=len(asked))
        place = np.searchsorted(asked, pair[asking])
        found = support[place] >= max(min_support, 1)
        i, j, place = i[asking[found]], j[asking[found]], place[found]
        if len(i):
            forth = asks_a[i]
            u, v = (pa.array(names[np.where(side, a[i], b[j])], own.field("user").type) for side in (forth, ~forth))
            yield pa.RecordBatch.from_arrays([u, item.take(pa.array(at[i])), v, pa.array(np.where(forth, rb[j], ra[i])), pa.array(1 / (1 + squares[place] / support[place]))], ["u", "item", "v", "rv", "similarity"])


def compared(ratings: DataFrame, asked: DataFrame, min_support: int = 1, block_rows: int = BLOCK_ROWS, hot: int = HOT) -> DataFrame:
    """(u, item, v, rv, similarity) for every asked (user, item) and each other rater v of the item with at least ``min_support`` items in common with u.

    ratings: (user, item, rating), one a user and item, without nulls; asked: (user, item), distinct.
    """
    both = ratings.select("user", "item", "rating").unionByName(asked.dropna().withColumn("rating", F.lit(None).cast("double")))  # who asks has no rating
    counts = stable(both.groupBy("item").count())
    n, n_pairs = counts.agg(F.sum("count"), F.sum(F.when(F.col("count") <= hot, F.col("count") * F.col("count")))).first()
    n_blocks = int(max(ratings.sparkSession.sparkContext.defaultParallelism, (n or 0) // block_rows, (n_pairs or 0) // BLOCK_PAIRS))
    # equal users share a range, so a user has one block
    entries = stable(both.repartitionByRange(n_blocks, "user").withColumn("block", F.spark_partition_id()))
    many = counts.filter(F.col("count") > hot).select("item")
    cold = entries.join(many, "item", "left_anti")
    held = cold.groupBy("item").agg(F.collect_list(F.struct("user", "rating", "block")).alias("all"))  # at most HOT
    met = held.select("item", "all", F.explode(F.array_distinct(F.transform("all", lambda e: e["block"]))).alias("block"))
    own = F.filter("all", lambda e: e["block"] == F.col("block"))
    bare = lambda es: F.transform(es, lambda e: F.struct(e["user"].alias("user"), e["rating"].alias("rating")))
    lists = met.withColumn("own", own).withColumn("least", F.array_min(F.transform("own", lambda e: e["user"])))
    lists = lists.select("block", "item", bare("own").alias("own"), bare(F.filter("all", lambda e: e["user"] > F.col("least"))).alias("others"))
    if not many.isEmpty():
        lists = lists.unionByName(_hot_pairs(entries, many))
    # more parts than blocks, so that few parts get several: a part's lists are held in memory
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    return lists.repartition(4 * n_blocks, "block").select("item", "own", "others").mapInArrow(partial(_paired, min_support=min_support), f"u {kinds['user']}, item {kinds['item']}, v {kinds['user']}, rv double, similarity double")


def _hot_pairs(entries: DataFrame, many: DataFrame) -> DataFrame:
    """Lists of one entry each for the items in ``many``: what is asked of them, and common ratings of them for all pairs that anything asks for."""
    side = lambda df, s: df.select("item", *[F.col(c).alias(f"{c}_{s}") for c in ("user", "rating", "block")])
    raters, askers = entries.filter("rating IS NOT NULL"), entries.filter("rating IS NULL")
    asks = side(askers, "u").join(side(raters, "v"), "item").filter("user_u <> user_v")
    wanted = asks.select(F.least("user_u", "user_v").alias("user_u"), F.greatest("user_u", "user_v").alias("user_v")).distinct()
    shared = raters.join(many, "item", "left_semi")
    common = wanted.join(side(shared, "u"), "user_u").join(side(shared, "v"), ["user_v", "item"])
    rows = asks.join(many, "item", "left_semi").unionByName(common)
    entry = lambda s: F.struct(F.col(f"user_{s}").alias("user"), F.col(f"rating_{s}").alias("rating"))
    first = F.col("user_u") < F.col("user_v")
    return rows.select(F.when(first, F.col("block_u")).otherwise(F.col("block_v")).alias("block"), "item", F.array(F.when(first, entry("u")).otherwise(entry("v"))).alias("own"), F.array(F.when(first, entry("v")).otherwise(entry("u"))).alias("others"))


def neighbour_estimates(train: DataFrame, wanted: DataFrame, k: int = 10, min_support: int = 1, scale: tuple[float, float] | None = None) -> DataFrame:
    """``wanted`` with estimate and n_neighbours (0: the mean of all ratings). Both have user and item, train rating; further columns of ``wanted`` stay.

    Ties in similarity go to the lesser user. ``scale``: bounds that an estimate is cut to.
    """
    rated = train.filter(F.col("user").isNotNull() & F.col("item").isNotNull() & F.col("rating").isNotNull())
    ratings = stable(rated.groupBy("user", "item").agg(F.avg(F.col("rating").cast("double")).alias("rating")))
    asked = wanted.select("user", "item").distinct()
    order = Window.partitionBy("u", "item").orderBy(F.desc("similarity"), "v")
    best = compared(ratings, asked, min_support).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = best.groupBy(F.col("u").alias("__user"), F.col("item").alias("__item")).agg((F.sum(F.col("similarity") * F.col("rv")) / F.sum("similarity")).alias("estimate"), F.count(F.lit(1)).alias("n_neighbours"))
    middle = rated.agg(F.avg(F.col("rating").cast("double")).alias("middle"))
    out = wanted.join(found, (F.col("user") == F.col("__user")) & (F.col("item") == F.col("__item")), "left").crossJoin(F.broadcast(middle))  # one row
    value = F.coalesce("estimate", "middle")
    if scale:
        value = F.greatest(F.lit(float(scale[0])), F.least(F.lit(float(scale[1])), value))
    return out.select(*wanted.columns, value.alias("estimate"), F.coalesce("n_neighbours", F.lit(0)).cast("long").alias("n_neighbours"))
