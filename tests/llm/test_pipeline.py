from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import minhash
from tessella.llm.common import Scratch

from .test_op1 import brute


def test_stages_keep_columns_and_take_effect(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    scratch, seen = Scratch(spark, "test-pipeline"), [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(scratch.save(stage(spark, seen[-1], sf_small), f"s{i}"))
        if i < 4:
            assert seen[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in seen]
    assert ids[1] < ids[0] and ids[2] < ids[1] and ids[3] <= ids[2] and ids[4] <= ids[3] and ids[5] == ids[4]
    rows = [(r["doc_id"], r["text"]) for r in seen[1].collect()]
    assert ids[2] == {d for d, (_, _, kept) in brute(rows, 5).items() if kept}
    assert len(corpus_pipeline.STAGES) == 5 and seen[5].select("shard").distinct().count() == 8


def test_one_of_each_with_repeated_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, ""), (None, None)]
    got = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 AS n", "'k' AS key", "1 AS `__key`", "2 AS kept_id"))
    assert sorted((str(r["doc_id"]) for r in got.collect())) == ["1", "3", "None"] and got.columns == ["doc_id", "text", "n", "key", "__key", "kept_id"]


def test_empty_input(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_small)
    assert docs.count() == 0


def test_odd_rows_go_through_every_stage(spark, sf_small):
    """Nulls in any column, empty and very long texts, repeated rows, equal ids with other texts, extra columns with clashing names."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    good = docs.filter("length(text) > 400").orderBy("doc_id").limit(6)
    odd = spark.createDataFrame([(None, None, None, None, None), (900, "", "en", None, 0), (901, None, None, "s", None), (902, "word " * 60_000, "en", "s", None), (903, "z" * 300_000, None, "t", 1)], docs.schema)
    rows = good.unionByName(odd).unionByName(good.limit(2)).unionByName(good.limit(1).withColumn("text", F.lit("other words " * 50)))
    clash = ["codes", "key", "node", "n", "part", "block", "shard", "size", "label", "row", "place", "__key", "item_id"]
    rows = rows.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, rows, sf_small)
        assert i == 4 or got.columns == rows.columns
        found = got.collect()
        assert all(r["doc_id"] is not None or r["doc_id"] is None for r in found) and (i != 4 or len(found) == rows.count())
        if i == 0:
            assert {r["doc_id"] for r in good.collect()} <= {r["doc_id"] for r in found}
        if i == 1:
            assert len(found) == len({(r["doc_id"], r["text"]) for r in found})
    assert len(found) == 14
