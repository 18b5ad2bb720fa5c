import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import language_id as li
from tessella.llm import quality_classifier as qc


@pytest.fixture(scope="module")
def mid(spark, sf_mid):
    return spark.read.parquet(f"{sf_mid}/documents.parquet"), spark.read.parquet(f"{sf_mid}/labels.parquet")


def test_language_held_out_accuracy(mid):
    docs, _ = mid
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = li.identify(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and 0.2 < len(held) / len(rows) < 0.45
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, mid):
    docs, _ = mid
    german = docs.filter("lang = 'de' AND n_chars > 1000").orderBy("doc_id").first()["text"]
    odd = [(-1, None, "en"), (-2, "", None), (-3, "12 + 3", "de"), (-4, "é", None), (None, "the and of that", "en"), (-5, (german + " ") * 200, None)]
    both = spark.createDataFrame(odd, "doc_id long, text string, lang string").unionByName(docs.select("doc_id", "text", "lang").limit(300)).withColumn("held_out", F.lit(1))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.identify(both).collect()}
    assert got[-1][0] == got[-2][0] == got[-3][0] == "und" and got[-4][0] != "und" and got[-5][0] == "de"
    assert li.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in li.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_network_gradients_match_differences():
    net = li.start(["a", "b"], 1)
    y = np.array([0, 1, 1])
    parts = net.parts()
    for p in parts:
        p[:] = p.astype(np.float64)

    def loss():
        logs = li.Predictor(net).log_probabilities([b"hello world", (b"abc" * 70)[: li.WINDOW], b"z"])
        return -logs[np.arange(3), y].mean()

    x, sizes = li.padded([b"hello world", (b"abc" * 70)[: li.WINDOW], b"z"])
    grads = li._gradients(net, x, sizes, y)
    for p, g in zip(net.parts(), grads):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[i]
        p[i] = old + 1e-2
        up = loss()
        p[i] = old - 1e-2
        down = loss()
        p[i] = old
        assert abs((up - down) / 2e-2 - g[i]) < 0.1 * abs(g[i]) + 2e-3


def test_quality_held_out(spark, mid):
    docs, labels = mid
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = qc.score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(truth[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for y, s in held if y == 1], [s for y, s in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_quality_edges(spark, mid):
    docs, labels = mid
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "x" * 100000), (None, "a b"), (-5, "a"), (-5, "a")], "doc_id long, text string").selectExpr("doc_id", "text", "1 AS score", "'z' AS label")
    none = labels.selectExpr("doc_id", "cast(null as int) quality")
    assert {r["score"] for r in qc.score_quality(odd, none).collect()} == {0.5}
    assert qc.score_quality(odd, labels).count() == 7 and qc.score_quality(odd.limit(0), labels).count() == 0
    kept = qc.accepted_documents(docs, labels)
    assert kept.schema == docs.schema and 0.7 < kept.count() / docs.count() < 1


def test_quality_learns_from_few_labels(spark, sf_small):
    docs, labels = spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(truth[r["doc_id"]], r["predicted"]) for r in qc.score_quality(docs, labels).collect() if r["doc_id"] in truth]
    bad = [p for y, p in rows if y == 0]
    assert bad and sum(p == 0 for p in bad) >= 0.6 * len(bad) and np.mean([p == 1 for y, p in rows if y == 1]) > 0.95


def test_quality_reads_long_words_whole_and_survives_odd_labels(spark):
    head = "abc" * 20
    rows = [(i, (head + ("xyz" if i % 2 else "uvw") * 300)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in qc.score_quality(docs, labels).collect()}
    assert np.mean([got[i] == i % 2 for i in range(200)]) > 0.95
    one = qc.score_quality(docs, labels.filter("quality = 1")).collect()
    assert {r["predicted"] for r in one} == {1}


def test_scorer_and_bags_agree():
    from tessella.llm.common import WordHashes

    model = qc.Model(np.random.default_rng(0).normal(size=qc.BUCKETS).astype(np.float32), 0.1)
    texts = [b"a b b b", b"x" * 1000 + b" y", b"", "ünï çödé".encode() * 50, b"one"]
    for t, s in zip(texts, qc.Scorer(model)(texts)):
        ids, share = qc.bag(t, WordHashes())
        assert abs(s - 1 / (1 + np.exp(-(0.1 + float(model.logits[ids] @ share.astype(np.float64)))))) < 1e-4


def test_text_ids_and_null_ids(spark):
    rows = [(f"d{i}" if i else None, ("the quick brown fox jumps over it " if i % 2 else "der schnelle braune fuchs springt hoch ") * 3, "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(1, 60)], "doc_id string, quality int")
    for found in (li.identify(docs), qc.score_quality(docs, labels)):
        assert dict(found.dtypes)["doc_id"] == "string" and sorted(str(r["doc_id"]) for r in found.collect()) == sorted(str(r[0]) for r in rows)
