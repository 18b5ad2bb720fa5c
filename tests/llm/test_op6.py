import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import decontamination as dc


def test_every_verbatim_item_is_found_and_nothing_else(spark, sf_mid):
    docs, items = spark.read.parquet(f"{sf_mid}/documents.parquet"), spark.read.parquet(f"{sf_mid}/benchmark.parquet")
    known = [(r["item_id"], f" {' '.join(dc.words_of(r['text']))} ") for r in items.collect()]
    expected, texts = set(), {}
    for r in docs.select("doc_id", "text").collect():
        words = " " + " ".join(dc.words_of(r["text"] or "")) + " "
        texts[r["doc_id"]] = words
        expected |= {(r["doc_id"], i) for i, w in known if w in words}
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaked_pairs(docs, items).collect()}
    assert expected and expected <= got
    share = {(d, i): dc.lcs(w.split(), texts[d].split()) / len(w.split()) for d, i in got - expected for k, w in known if k == i}
    assert all(s >= dc.PARAPHRASE_SHARE for s in share.values())


def test_recall_against_all_passages(spark, sf_mid):
    """Every passage of every document aligned with every item by the same rule."""
    docs, items = spark.read.parquet(f"{sf_mid}/documents.parquet"), spark.read.parquet(f"{sf_mid}/benchmark.parquet")
    known = [(r["item_id"], dc.words_of(r["text"]), dc.answer_of(r["text"])) for r in items.collect()]
    leaks = set()
    for r in docs.select("doc_id", "text").collect():
        words = dc.words_of(r["text"] or "")
        for i, item, answer in known:
            own = set(item)
            for s in range(0, max(1, len(words) - dc.PASSAGE + dc.STRIDE), dc.STRIDE):
                around = words[max(0, s - len(item)) : s + dc.PASSAGE + len(item)]
                if around and dc.may_leak(item, own, around) and dc.is_leak(*dc.aligned(item, answer, around)):
                    leaks.add((r["doc_id"], i))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaked_pairs(docs, items).collect()}
    assert leaks and len(got & leaks) >= 0.9 * len(leaks) and got <= leaks


def test_text_ids_repeated_rows_and_very_long_texts(spark):
    item = [f"q{i}" for i in range(30)]
    rows = [("a", " ".join(item)), ("a", " ".join(item)), ("b", " ".join(["x y z"] * 40_000 + item + ["u"] * 1000)), ("c", "x " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 AS codes", "current_timestamp() AS `at.time`", "array(1) AS word")
    bench = spark.createDataFrame([("i", " ".join(item)), ("j", " ".join(item))], "item_id string, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.leaked_pairs(docs, bench).collect()) == sorted((d, i) for d in "aab" for i in "ij")
    kept = dc.clean_documents(docs, bench)
    assert kept.schema == docs.schema and [r["doc_id"] for r in kept.collect()] == ["c"]


def test_paraphrases_positions_and_edges(spark):
    rng = random.Random(1)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lm", "rt", "n", "st", "x")]
    filler = lambda n: [rng.choice(vocabulary) + rng.choice("ab") for _ in range(n)]
    items = [[rng.choice(vocabulary) + rng.choice("cd") + str(i % 7) for i in range(n)] for n in (15, 30, 59)]
    rows, expected = [(1, None), (2, ""), (3, "...")], set()
    for k, item in enumerate(items):
        for at in (0, 7, 31, 50, 63, 200):
            d = 100 * (k + 1) + at
            rows.append((d, " ".join([*filler(at), *item, *filler(90)]).upper()))
            expected.add((d, k))
        changed = [w if i % 6 else "zz" for i, w in enumerate(item)]
        rows.append((1000 + k, " ".join([*filler(40), *changed, *filler(10)]) + "!"))
        expected.add((1000 + k, k))
    rows += [(2000 + i, " ".join(filler(300))) for i in range(60)] + [(None, " ".join(items[0]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS item_id", "'x' AS word").repartition(3)
    bench = spark.createDataFrame([*enumerate(" ".join(i) + "." for i in items), (9, None), (10, "")], "item_id long, text string")
    for block in (2, 10_000):
        got = {(r["doc_id"], r["item_id"]) for r in dc.leaked_pairs(docs, bench, max_items=block).collect()}
        assert got == expected | {(None, 0)}
        assert dc.clean_documents(docs, bench, max_items=block).count() == 63
    assert dc.leaked_pairs(docs.limit(0), bench).count() == 0 and dc.leaked_pairs(docs, bench.limit(0)).count() == 0


def test_a_paraphrase_is_found_through_the_latent_space(spark):
    rng = random.Random(4)
    topics = [([f"t{t}w{i}" for i in range(90)], [f"t{t}rare{i}" for i in range(40)]) for t in range(16)]
    rows = []
    for t, (common, rare) in enumerate(topics):  # a rare word stands among its topic's words, in two documents
        for d in range(40):
            rows.append((1000 * t + d, " ".join(rng.sample(common, 50) + [w for i, w in enumerate(rare) if i % 20 == d % 20 and d < 20])))
    common, rare = topics[3]
    item = [w for i in range(16) for w in (common[i], rare[i])] + common[16:24]
    other = rare[20:40]
    changed = [w if w in common else common[40 + i] for i, w in enumerate(item)]
    rows.append((99999, " ".join([*other, *changed, *common[80:84]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item[:-4]) + ". " + " ".join(item[-4:]) + "."), (1, " ".join(other + topics[5][1]))], "item_id long, text string")
    got = [r for r in dc.leaked_pairs(docs, bench).collect() if r["doc_id"] == 99999]
    assert [r["item_id"] for r in got] == [0] and got[0]["cosine"] < dc.COSINE and got[0]["item_share"] == 0.6
    assert all(r["doc_id"] != 99999 for r in dc.clean_documents(docs, bench).collect())


def test_long_items_and_unicode_breaks_against_brute_force(spark):
    rng = random.Random(5)
    words = lambda n, k: [f"k{k}x{rng.randrange(10**6)}" for _ in range(n)]
    items = {0: words(500, 0), 1: words(900, 1), 2: words(5, 2), 3: words(30, 3), 4: ["春眠不觉晓", "处处闻啼鸟", "夜来风雨声"]}
    rows = [(1, " ".join([*words(77, 9), *items[0], *words(50, 9)])), (2, " ".join(items[1])), (3, " ".join(items[1][:760])),
            (4, " ".join([*items[3], *items[2] * 1, *items[0][:40]])), (5, "“" + "”—‘".join(items[3]) + "’"),
            (6, "唐诗：“" + "，".join(items[4]) + "。”完"), (7, " ".join(items[0][:250])), (8, " ".join(words(900, 9)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    expected = {(d, k) for d, t in rows for k, v in items.items() if dc.lcs(v, re.findall(r"[^\W_]+", t.lower())) >= dc.LCS_SHARE * len(v)}
    assert {(1, 0), (2, 1), (3, 1), (4, 2), (4, 3), (5, 3), (6, 4)} == expected
    assert {(r["doc_id"], r["item_id"]) for r in dc.leaked_pairs(docs, bench).collect()} == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.lists(st.sampled_from("abcd"), max_size=14))
def test_bit_parallel_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert dc.lcs(a, b) == table[-1][-1]
