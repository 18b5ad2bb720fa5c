import random
from collections import Counter
from itertools import combinations

from tessella.llm import minhash
from tessella.llm.minhash import near_duplicates


def sets_of(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows, n):
    sets = {d: sets_of(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(sorted(sets), 2):
        a, b = sets[x], sets[y]
        if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
            u, v = sorted((find(x), find(y)))
            root[v] = u
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_whole_table_against_brute_force(spark, sf_mid):
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, words=2).collect()}
    assert got == brute(rows, 2)


def test_edges_chain_and_hot_group(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two")]
    rows += [(100 + i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)]
    rows += [(200 + i, " ".join(base)) for i in range(30)] + [(300 + i, " ".join(base[4 * i :] + [f"y{j}" for j in range(4 * i)])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "'x' AS key", "0 AS band").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, words=2).collect()}
    assert got == brute(rows, 2)


def got_of(df, words=2):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, words=words).collect()}


def test_buckets_of_many_components(spark):
    rng = random.Random(4)
    passage, rows = [f"p{i}" for i in range(60)], []
    for i in range(40):
        own = [f"o{i}.{j}" for j in range(20)]
        for k in range(3):
            text = passage + [w if rng.random() > 0.06 * k else f"e{rng.random()}" for w in own]
            rows.append((1000 - 3 * i - k, " ".join(text)))
    assert got_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 2)


def test_a_large_near_copy_group_and_a_passage_in_a_thousand_documents(spark):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(70)]
    near = lambda p: " ".join(w if rng.random() > p else rng.choice(base + [f"v{rng.randrange(40)}"]) for w in base)
    rows = [(i, near(rng.choice((0.02, 0.06, 0.09)))) for i in range(500)]
    passage = " ".join(f"p{i}" for i in range(50))
    rows += [(1000 + i, passage + " " + " ".join(f"o{i % 400}.{j}" if j != i % 7 or i < 400 else "z" for j in range(12))) for i in range(1000)]
    expected = brute(rows, 2)
    sizes = Counter(c for _, c, _ in expected.values())
    assert max(sizes.values()) > 100 and len(sizes) > 200  # the graph is neither whole nor empty
    assert got_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == expected


def test_very_long_texts(spark):
    long = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[5000:])), (3, " ".join(long[20_000:])), (4, "x" * 1_000_000), (5, "X" * 1_000_000)]
    assert got_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 2)


def test_empty_table_repeated_rows_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "z")]
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("5", "5", True), ("5", "5", True), ("None", "5", False), ("None", "None", True)]


def test_estimate_is_collision_corrected(spark):
    import numpy as np

    from pyspark.sql import functions as F

    a = minhash.odd_constants(minhash.HASHES, 101, np.uint32)
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    y = np.concatenate([x[:1500], np.unique(rng.integers(0, 2**63, 1500, dtype=np.uint64))])
    pack = lambda s: [int(v) for v in ((minhash.minima(s, a).astype(np.uint64) & np.uint64(15)).reshape(-1, 16) << (np.arange(16) * 4).astype(np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)]
    df = spark.createDataFrame([(pack(x), pack(y))], "x array<long>, y array<long>")
    got = df.select(minhash.estimated_similarity(F.col("x"), F.col("y"))).first()[0]
    assert abs(got - 1 / 3) < 0.12
