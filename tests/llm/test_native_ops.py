import os
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import host_rules, license_scan, mixing, queries, sharding


def plain(v):
    return round(float(v), 5) if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(name, spark, sf_small):
    con = duckdb.connect()
    for f in os.listdir(sf_small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_small}/{f}'")
    df = queries.queries()[name](spark, sf_small)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t", "a"), (4, "one", "b"), (5, "é x " * 30000, "b"), (6, "same text here", "c"), (6, "same text here", "c"), (None, "same text here", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("doc_id", "text", "source", "1 AS size", "2 AS host", "'x' AS shard", "3 AS range", "4 AS block")


def test_shards_are_even_gapless_and_keep_groups(spark, sf_mid):
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = sharding.shard(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    by, held = defaultdict(list), Counter()
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == crc32(text[r["doc_id"]]) and r["law"] == "bytes" and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
    assert set(by) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    fair, largest = sum(held.values()) / 8, max(r["size"] for r in rows)
    assert all(abs(h - fair) <= max(largest, sharding.WHOLE_SHARE * fair) for h in held.values())
    copies = defaultdict(set)
    for r in rows:
        copies[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for t, s in copies.items() if len(t) * 3 < sharding.WHOLE_SHARE * fair)
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}


def test_shards_divide_a_hot_text(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "hot " * 50).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    held = {r["shard"]: r["n"] for r in sharding.shard(rows).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert len(held) == 8 and max(held.values()) - min(held.values()) <= 402
    counts = [r["count"] for r in sharding.shard(rows, law="rows").groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 1


def test_shards_against_one_sorted_list(spark, sf_mid, monkeypatch):
    """The places of a plain sort by the same keys, cut at the same words; many ranges, all overfull ones subdivided."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 7)
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 3)
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    keys = {r["doc_id"]: r for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("k1"), F.xxhash64("doc_id").alias("k2")).collect()}
    rows = sharding.shard(docs, law="rows").collect()
    order = sorted(rows, key=lambda r: (keys[r["doc_id"]]["k1"], keys[r["doc_id"]]["k2"]))
    n = len(order)
    cuts = [round(i * n / 8) for i in range(9)]
    for s in range(8):
        assert [(r["shard"], r["slot"]) for r in order[cuts[s] : cuts[s + 1]]] == [(s, i) for i in range(cuts[s + 1] - cuts[s])]


def test_shards_divide_rows_that_are_alike(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    rows = sharding.shard(spark.createDataFrame([(5, "same")] * 900, "doc_id long, text string").repartition(3)).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == 900 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s])) for s in sizes)


def test_shards_edges(spark):
    df = odd_rows(spark)
    rows = sharding.shard(df).collect()
    assert len(rows) == 8 and {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert sharding.shard(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="law"):
        sharding.shard(df, law="other")


def test_mix_hits_targets(spark, sf_mid, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    rows = mixing.mix(docs).collect()
    words, taken, target = Counter(), Counter(), {}
    text = {r["doc_id"]: (r["text"] or "").encode().split() for r in docs.collect()}
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]]) and 0 <= r["taken"] <= 3 * r["size"] and len(r["shards"]) == r["passes"] + (r["part"] > 0)
        words[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    names = sorted(words)
    expected = mixing.targets([words[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, t in zip(names, expected):
        assert abs(target[s] - t) < 1e-6 * t and abs(taken[s] - t) <= 1
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    shards = Counter(s for r in rows for s in r["shards"])
    assert set(shards) == set(range(8)) and max(shards.values()) < 1.5 * min(shards.values())
    repeated = [r for r in rows if len(r["shards"]) > 1]
    assert repeated and sum(len(set(r["shards"])) > 1 for r in repeated) > 0.7 * len(repeated)
    orders = [o for r in rows for o in r["orders"]]
    assert len(set(orders)) > 0.99 * len(orders)
    copies = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert all(copies[r["doc_id"]] == r["passes"] + (r["part"] > 0 and 2 * r["part"] >= r["size"]) for r in rows)


def test_mix_draw_against_a_plain_walk(spark, sf_mid):
    """Blocks of each source in permuted order: whole passes take all words, the last pass walks until the rest is used up."""
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    twice = docs.unionByName(docs.filter("doc_id % 7 = 0"))
    sized = mixing.sized_documents(twice, 17).withColumn("signed", F.col("place")).collect()
    sources = sorted({r["source"] for r in sized})
    words = [sum(r["size"] for r in sized if r["source"] == s) for s in sources]
    goals, expected = mixing.targets(words, [(5, 2, 1)[i % 3] for i in range(len(sources))]), Counter()
    for no, (source, w, t) in enumerate(zip(sources, words, goals)):
        own = [r for r in sized if r["source"] == source]
        whole = min(3, int((t + 1e-6) // w))
        left = round(t - whole * w) if whole < 3 else 0
        n = max(1, len(own) // mixing.BLOCK_DOCS)
        at = spark.createDataFrame([(r["place"], no, n) for r in own], "place long, source_no int, n long").withColumn("block", F.expr("pmod(xxhash64(place, 1), n)"))
        at = at.withColumn("perm", F.xxhash64("source_no", "block", F.lit(17))).collect()
        for r in own:
            expected[r["doc_id"]] += whole * r["size"]
        places = {r["place"]: (r["perm"], r["block"]) for r in at}
        for r in sorted(own, key=lambda r: (*places[r["place"]], r["place"])):
            expected[r["doc_id"]] += min(r["size"], left)
            left -= min(r["size"], left)
    got = Counter()
    for r in mixing.mix(twice).collect():
        got[r["doc_id"]] += r["taken"]
    off = {d: (got[d], expected[d]) for d in expected if abs(got[d] - expected[d]) > 1}  # a cut between equal rows leaves up to a word
    assert not off and abs(sum(got.values()) - sum(expected.values())) <= len(sources)


def test_mix_segments_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SEGMENT", 2)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    rows = [(i, "w " * (i % 9), "a" if i % 3 else None) for i in range(300)] + [(7, "a b c d", "b")] * 40
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert len(got) == 340 and all(abs(taken[s] - target[s]) <= 40 for s in target) and abs(taken["a"] - target["a"]) <= 1


def test_water_filling_against_rounds():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        sizes, weights = rng.integers(0, 100, n).tolist(), [(5, 2, 1)[i % 3] for i in range(n)]
        got = mixing.targets(sizes, weights)
        want, free, left = [0.0] * n, set(range(n)), float(sum(sizes))
        while free and left > 1e-9:  # share, stop at the cap, share the excess again
            w = sum(weights[i] for i in free)
            over = 0.0
            for i in list(free):
                want[i] += left * weights[i] / w
                if want[i] >= 3 * sizes[i]:
                    over += want[i] - 3 * sizes[i]
                    want[i] = 3.0 * sizes[i]
                    free.discard(i)
            left = over
        assert np.allclose(got, want, atol=1e-6), (sizes, got, want)


def test_splitting_tree_is_exact_and_even():
    quotas = np.array([1000, 7, 0, 333])
    dealt = mixing.splitting_tree(quotas, 8, 3)
    assert (dealt.sum(axis=0) == quotas).all() and (dealt >= 0).all() and np.ptp(dealt.sum(axis=1)) <= 2
    many = np.mean([mixing.splitting_tree(quotas, 8, s)[0] for s in range(300)], axis=0)
    assert np.allclose(many, quotas / 8, rtol=0.05, atol=0.2)


def test_mix_edges(spark):
    df = odd_rows(spark)
    rows = mixing.mix(df).collect()
    assert len(rows) == 8 and {r["taken"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0
    assert mixing.mixed_documents(df).columns == df.columns
    zero = mixing.mix(df.filter("doc_id < 4")).collect()
    assert {r["target"] for r in zero} == {0.0}


def test_rules_edges_and_bad_hosts(spark):
    df = odd_rows(spark)
    rows = {(r["doc_id"], r["host"]): r for r in host_rules.quality_rules(df).collect()}
    assert rows[1, "a"]["n_words"] == 0 and rows[1, "a"]["base_failed"] and not rows[1, "a"]["kept"]
    assert rows[5, "b"]["n_words"] == rows[5, "b"]["n_repeat_words"] == 60000
    assert host_rules.quality_rules(df.limit(0)).count() == 0
    good, bad = " ".join(f"w{i}" for i in range(40)), "too short"
    mixed = spark.createDataFrame([(i, bad if i % 10 else good, "spam") for i in range(100)] + [(200 + i, good, "fine") for i in range(50)], "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in host_rules.quality_rules(mixed).collect() if r["kept"]}
    assert kept == set(range(200, 250))


def test_repeat_words_against_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abc"), int(rng.integers(0, 40)))) for _ in range(80)]
    got = host_rules.features(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")).select("doc_id", "n_repeat_words").collect()
    for r in got:
        w = texts[r["doc_id"]].split()
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        assert r["n_repeat_words"] == len({i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)})


def test_licences(spark):
    mit = license_scan.TEMPLATES["MIT-text"]
    rows = [(1, f"x\n{mit.upper()}\ny"), (2, mit[:200]), (3, mit.replace("sublicense", "lend", 1)), (4, None), (5, ""), (6, "word " * 50000), (7, "Licensed  under CC-BY NC 4.0!\nReleased under the MIT License.")]
    got = {r["doc_id"]: (r["license"], r["n_matches"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1))).collect()}
    assert got[1] == ("MIT-text", 2) and got[2][0] is None and got[3][0] == "MIT-text" and got[4] == got[5] == got[6] == (None, 0) and got[7][1] == 2
    names = license_scan.marker_words(license_scan.TEMPLATES, license_scan.THRESHOLD)
    for text in license_scan.TEMPLATES.values():  # every near variant keeps a marker
        grams = license_scan.bigrams(text)
        free = {g for g in grams if not set(g.split()) & set(names)}
        assert len(free) < license_scan.THRESHOLD / (2 - license_scan.THRESHOLD) * len(grams)


def test_licences_within_other_text(spark):
    t, words = license_scan.TEMPLATES, license_scan.normalised_words
    wrapped = lambda name: "\n".join(" ".join(w) for w in [t[name].split()[i : i + 9] for i in range(0, len(t[name].split()), 9)])
    rows = [(1, f"import x\n{wrapped('Apache-2.0-header')}\nx.run()\n" + "more words here " * 200),
            (2, "intro " * 40 + "This page is released under the MIT License, as ever. " + "outro " * 40),
            (3, "lead in\n" + wrapped("MIT-full") + "\ncode " * 300), (4, wrapped("BSD-3-Clause-full")), (5, "a\n" + wrapped("Zlib").replace("acknowledgment", "thanks") + "\nb"),
            (6, "the software under the license " * 20000), (7, None), (8, ""), (9, "License"), (9, "License")]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license"] for i in range(1, 10)] == ["Apache-2.0-header", "MIT", "MIT-full", "BSD-3-Clause-full", "Zlib", None, None, None, None]
    assert got[1]["dice"] == got[2]["dice"] == got[3]["dice"] == 1.0 and 0.9 < got[5]["dice"] < 1.0
    assert got[1]["n_licenses"] == 2  # the short notice lies within the header
    assert got[2]["n_matches"] == 0 and got[2]["n_licenses"] == 1
    assert got[6]["n_licenses"] == got[7]["n_licenses"] == 0
    for name, text in t.items():  # so many bigrams that no match can do without all of them
        chosen = {g for g, _ in license_scan.anchor_bigrams(text, license_scan.THRESHOLD)}
        assert len(license_scan.bigrams(text) - chosen) < license_scan.THRESHOLD / (2 - license_scan.THRESHOLD) * len(license_scan.bigrams(text)), name
        assert all(words(text)[p : p + 2] == g.split() for g, p in license_scan.anchor_bigrams(text, license_scan.THRESHOLD))


def test_licence_headers_many_times_over_are_tried_once(spark):
    """An ordinary source dump: the time follows the text, not its square, and every copy of a window counts as one."""
    import time

    head = license_scan.TEMPLATES["Apache-2.0-header"]
    took = []
    for n in (400, 400, 3200):  # the first compiles
        df = spark.createDataFrame([(1, (head + " int x = y;\n") * n)], "doc_id long, text string")
        began = time.monotonic()
        row = license_scan.license_scan(df).first()
        took.append(time.monotonic() - began)
        assert row["license"] == "Apache-2.0-header" and row["dice"] == 1.0
    assert took[2] < 8 * took[1] + 5
