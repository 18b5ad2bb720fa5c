import hashlib
from collections import Counter

import numpy as np

from tessella.llm.common import Scratch
from tessella.llm.common import text_key
from tessella.llm.window_dedup import BASE, DurableIndex, FingerprintIndex, deduplicated, rolled, substring_dedup


def brute(rows, w=35):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(x[i : i + w]) for _, x in words for i in range(len(x) - w + 1))
    out = []
    for d, x in words:
        gone = set()
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i : i + w])] > 1:
                gone.update(range(i, i + w))
        out.append((d, len(x), len(gone), hashlib.sha256(b" ".join(v for i, v in enumerate(x) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def run(df, **k):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(df, **k).collect()), key=str)


def test_whole_table_against_brute_force(spark, sf_mid):
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    assert run(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edges(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "x " * 34), (4, "x " * 35), (5, "x " * 36), (6, p), (7, "a b " + p + " c"), (8, "q " + p[:150]), (9, p + " " + p), (None, p), (6, p), (10, "é " + p.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS copies", "'x' AS key", "0 AS window")
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []


def test_rolled_is_a_polynomial():
    h = np.random.default_rng(1).integers(0, 2**63, 90, dtype=np.uint64)
    for n in (1, 2, 3, 8, 35, 90):
        a, b = rolled(np.concatenate([h, h[5:]]), n, BASE), rolled(h, n, BASE)
        assert len(b) == 91 - n and (a[: len(b)] == b).all() and (n > 80 or (a[90 : 90 + len(b) - 5] == b[5:]).all())
        assert len(np.unique(b)) == len(b)


def test_batches_and_compaction_do_not_change_the_result(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    for n, most in ((1, 1), (3, 1), (5, 2)):
        assert run(docs, n_batches=n, max_runs=most) == expected


def test_a_batch_finds_what_an_old_one_held_once(spark):
    """The old batch's windows occurred once when it came; the index alone knows them."""
    p, q, r = (" ".join(f"{c}{i}" for i in range(50)) for c in "pqr")
    scratch = Scratch(spark, "test-index")
    index = FingerprintIndex(scratch, max_runs=2)
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string").select(text_key("text"), "text")
    found = [index.append(frame(batch)) for batch in ([p, q], [r], ["a " + q], ["b " + p, "c " + p])]
    n = [f.distinct().count() for f in found]
    assert n[0] == n[1] == 0 and n[2] > 0 and n[3] > 0
    assert len(index.runs) == 2 and len(scratch.tables) == 2  # compacted once, the old runs dropped
    keys = {row["key"] for row in index.spots(found[2].union(found[3]).distinct()).collect()}
    assert keys == {row["key"] for row in frame([p, q, "a " + q, "b " + p, "c " + p]).collect()}


def test_an_index_is_reopened_by_a_later_session(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    p, q, r = (" ".join(f"{c}{i}" for i in range(50)) for c in "pqr")
    frame = lambda s, texts: s.createDataFrame([(t,) for t in texts], "text string").select(text_key("text"), "text")
    first = DurableIndex.open(spark, root)
    assert first.append(frame(spark, [p, q])).count() == 0
    first.commit()
    lost = DurableIndex.open(spark.newSession(), root)  # a batch that is never committed
    assert lost.append(frame(spark, ["z " + p])).count() > 0
    later = spark.newSession()
    second = DurableIndex.open(later, root)
    assert len(second.logs) == 1
    assert second.append(frame(later, [r])).count() == 0  # overwrites what the lost batch left
    second.commit()
    third = DurableIndex.open(spark.newSession(), root)
    found = third.append(frame(third.scratch.spark, ["a " + q, "b c"]))
    assert found.count() > 0 and len(third.runs) == 1  # compacted
    third.commit()
    names = {x.name for x in (tmp_path / "index").iterdir()}
    assert {"run-0", "run-1", "run-2"} & names == set() and {"log-0", "log-1", "log-2", "run-3"} <= names
    again = DurableIndex.open(spark.newSession(), root)
    keys = {row["key"] for row in again.spots(again.scratch.spark.read.schema("gram long").parquet(f"{root}/again-2").distinct()).collect()}
    assert keys == {row["key"] for row in frame(spark, [q, "a " + q]).collect()}
    try:
        DurableIndex.open(spark, root, window=20)
        raise AssertionError
    except ValueError as e:
        assert "35 words" in str(e)


def test_texts_and_spans(spark):
    p = " ".join(f"p{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"a b {p} c"), (2, f"x {p}"), (3, "é  z"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], [tuple(s) for s in r["spans"]]) for r in deduplicated(df).collect()}
    assert got == {1: ("a b c", [(2, 41)]), 2: ("x", [(1, 40)]), 3: ("é z", []), 4: ("", [])}


def test_very_long_and_hot_texts(spark):
    p = " ".join(f"p{i}" for i in range(45))
    rows = [(i, f"u{i} v{i} {p} w{i}") for i in range(300)] + [(900, " ".join(f"l{i}" for i in range(50_000)) + " " + p), (901, "y" * 500_000)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == brute(rows)
