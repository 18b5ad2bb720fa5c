"""Neighbour-based estimates against brute force: no common items, repeated ratings, unknown users and items, nulls."""

import random
from collections import defaultdict

import pytest

from tessella.operators import collaborative as cf


def brute(train, wanted, k, support, scale):
    sums = defaultdict(list)
    for u, i, r in train:
        if None not in (u, i, r):
            sums[u, i].append(r)
    rating = {key: sum(v) / len(v) for key, v in sums.items()}
    every = [r for v in sums.values() for r in v]
    by_user = defaultdict(dict)
    for (u, i), r in rating.items():
        by_user[u][i] = r
    out = []
    for u, i in wanted:
        near = []
        for v in by_user:
            both = by_user[u].keys() & by_user[v].keys() if u in by_user else ()
            if v != u and i in by_user[v] and len(both) >= support:
                near.append((-1 / (1 + sum((by_user[u][j] - by_user[v][j]) ** 2 for j in both) / len(both)), v))
        near = sorted(near)[:k]
        e = sum(-s * by_user[v][i] for s, v in near) / sum(-s for s, _ in near) if near else sum(every) / len(every)
        out.append((u, i, round(min(max(e, scale[0]), scale[1]), 9), len(near)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("support", [1, 3])
def test_estimates_against_brute_force(spark, support):
    rng = random.Random(support)
    train = [(rng.randint(1, 25), rng.randint(1, 12), float(rng.randint(1, 5))) for _ in range(220)]
    train += [(u, 99, 4.0) for u in range(1, 26)] + [(None, 1, 3.0), (1, None, 3.0), (1, 1, None), (50, 77, 2.0)]  # an item that all rate, rows with nulls, a user without common items
    wanted = [(rng.randint(1, 27), rng.randint(1, 13)) for _ in range(60)] + [(50, 99), (1000, 1), (3, 99)]
    got = cf.neighbour_estimates(spark.createDataFrame(train, "user int, item int, rating double").repartition(3), spark.createDataFrame([(u, i, n) for n, (u, i) in enumerate(wanted)], "user int, item int, line int"), 4, support, (1.5, 4.5))
    assert got.columns == ["user", "item", "line", "estimate", "n_neighbours"]
    assert sorted(((r["user"], r["item"], round(r["estimate"], 9), r["n_neighbours"]) for r in got.collect()), key=repr) == brute(train, wanted, 4, support, (1.5, 4.5))


def test_nothing_to_estimate(spark):
    train = spark.createDataFrame([(1, 1, 2.0)], "user int, item int, rating double")
    assert cf.neighbour_estimates(train, train.drop("rating").limit(0)).count() == 0
    only = cf.neighbour_estimates(train.limit(0), spark.createDataFrame([(1, 1)], "user int, item int")).first()
    assert only["estimate"] is None and only["n_neighbours"] == 0


@pytest.mark.parametrize("hot", [0, 8, 1000])
def test_frequent_items_are_compared_as_rows_with_the_same_result(spark, hot):
    rng = random.Random(7)
    train = [(u, i, float(rng.randint(1, 5))) for u, i in {(rng.randint(1, 30), rng.choice([1, 1, 1, 2, 3, 4, 5, 6])) for _ in range(200)}]
    asked = list({(rng.randint(1, 33), rng.randint(1, 7)) for _ in range(60)})
    got = cf.compared(spark.createDataFrame(train, "user int, item int, rating double"), spark.createDataFrame(asked, "user int, item int"), 2, block_rows=20, hot=hot)
    by_user = defaultdict(dict)
    for u, i, r in train:
        by_user[u][i] = r
    want = []
    for u, i in asked:
        for v in by_user:
            both = by_user[u].keys() & by_user[v].keys() if u in by_user else ()
            if v != u and i in by_user[v] and len(both) >= 2:
                want.append((u, i, v, by_user[v][i], round(1 / (1 + sum((by_user[u][j] - by_user[v][j]) ** 2 for j in both) / len(both)), 9)))
    assert sorted((r["u"], r["item"], r["v"], r["rv"], round(r["similarity"], 9)) for r in got.collect()) == sorted(want)


def test_pairs_of_users_are_not_moved_one_by_one(spark):
    """600 users of 30 items each, 12,000 asked estimates over 300 items: 720,000 asked pairs and raters, 20 million common ratings. What is moved are lists."""
    rng = random.Random(1)
    rows = [(u, i) for u in range(600) for i in rng.sample(range(300), 50)]
    train = spark.createDataFrame([(u, i, float(rng.randint(1, 5))) for u, i in rows[::5] + rows[1::5] + rows[2::5]], "user int, item int, rating double")
    asked = spark.createDataFrame(rows[3::5] + rows[4::5], "user int, item int")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert cf.neighbour_estimates(train, asked, 3).filter("n_neighbours = 3").count() > 11_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = {i for j in set(tracker.getJobIdsForGroup(None)) - before for i in tracker.getJobInfo(j).stageIds}
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    listed = store.stageList(None, False, False, none, None)
    moved = sum(listed.apply(i).shuffleWriteRecords() for i in range(listed.size()) if listed.apply(i).stageId() in stages)
    assert moved < 1_500_000, moved


def test_pairs_are_made_in_bounded_steps_and_only_asked_ones_leave_a_task(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    every = {item: [(u, float(rng.randint(1, 5)) if rng.random() < 0.8 else None) for u in sorted(rng.sample(range(40), 12))] for item in range(25)}
    lists = lambda rows: [[{"user": u, "rating": r} for u, r in entries] for entries in rows]
    kind = pa.list_(pa.struct([("user", pa.int32()), ("rating", pa.float64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(list(every), pa.int64()), pa.array(lists(every.values()), kind), pa.array(lists(every.values()), kind)], ["item", "own", "others"])
    whole = pa.Table.from_batches(list(cf._paired(iter([batch]), 2)))
    sizes, plain = [], np.repeat
    monkeypatch.setattr(cf, "PAIRS", 300)
    monkeypatch.setattr(np, "repeat", lambda a, n: sizes.append(int(np.sum(n))) or plain(a, n))
    steps = pa.Table.from_batches(list(cf._paired(iter([batch.slice(0, 9), batch.slice(9)]), 2)))
    monkeypatch.undo()
    told = lambda t: sorted(map(tuple, t.to_pandas().itertuples(index=False)))
    assert told(steps) == told(whole) and len(sizes) > 8 and max(sizes[1:]) <= 300
    rated = {u: {i: r for i, entries in every.items() for v, r in entries if v == u and r is not None} for u in range(40)}
    asks = [(u, i, v) for i, entries in every.items() for u, r in entries if r is None for v, s in entries if s is not None and len(rated[u].keys() & rated[v].keys()) >= 2]
    assert sorted((u, i, v) for u, i, v, _, _ in told(whole)) == sorted(asks)
    plan = cf.compared(spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0)], "user int, item int, rating double"), spark.createDataFrame([(1, 2)], "user int, item int"))._jdf.queryExecution().toString()
    assert "MapInArrow partial" in plan and "collect_list(ask" not in plan
