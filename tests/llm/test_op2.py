import hashlib
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import suffix_dedup as sd


def brute(rows, w=400):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(hash(t[i : i + w]) for _, t in texts for i in range(len(t) - w + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - w + 1):
            if seen[hash(t[i : i + w])] > 1:
                gone[i : i + w] = b"\1" * w
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(df, **k):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in sd.suffix_dedup(df, **k).collect()), key=str)


def test_whole_table_against_brute_force(spark, sf_mid):
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    assert run(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def edge_rows():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij éß") for _ in range(n))
    p, q = word(900), word(500)
    rows = [(1, None), (2, ""), (3, p), (4, word(50) + p[:500] + word(60)), (5, word(10) + p[300:] + q), (6, q), (7, q + q), (8, "a" * 399), (9, "a" * 400), (10, "a" * 900), (11, "ab" * 300), (12, p[:399]), (13, p[:380] + "#" + p[381:790] + word(20)), (None, q), (6, q)]
    rows += [(100 + i, word(30 + 7 * i) + p[100 + i : 620 - i] + word(40)) for i in range(25)]
    return rows


def test_edges(spark):
    rows = edge_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS copies", "'x' AS key", "0 AS part")
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []


def test_kept_bytes_and_spans(spark):
    p = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(450))
    got = {r["doc_id"]: (bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in sd.deduplicated(spark.createDataFrame([(1, "ä" + p + "z"), (2, p + "9"), (3, None)], "doc_id long, text string")).collect()}
    assert got == {1: ("äz".encode(), [(2, 452)]), 2: (b"9", [(0, 450)]), 3: (b"", [])}


def test_hot_grams_agree(spark):
    rows = edge_rows()
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), hot=3) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=6).map(str.encode), max_size=8), max_size=6))
def test_loser_tree_merges_front_coded_runs(parts):
    runs = [sd.front_coded(sorted(p)) for p in parts]
    got = list(sd.merged(runs))
    strings = [g[2] for g in got]
    assert strings == sorted(s for p in parts for s in p)
    assert all(g[3] == sd.shared_prefix(a, g[2]) for a, g in zip(strings, got[1:]))
    assert sorted((g[0], g[1]) for g in got) == [(i, j) for i, p in enumerate(parts) for j in range(len(p))]


def test_grams_depend_on_their_bytes_alone():
    rng = random.Random(5)
    a, b = bytes(rng.randrange(256) for _ in range(300)), bytes(rng.randrange(256) for _ in range(90))
    hashed = sd.ByteGrams(40)
    g, sizes = hashed([b, a, a])
    assert sizes.tolist() == [90, 300, 300] and (g[90:350] == g[390:651][:260]).all() and len(set(g[90:351].tolist())) == 261
