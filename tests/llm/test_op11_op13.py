"""Chat formatting, spelling variants and hard negatives against brute force, on fixtures with nulls, ties, repeated rows and empty tables."""

import hashlib
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat_format as cf
from tessella.llm import hard_negatives as hn
from tessella.llm import queries as q
from tessella.llm import spelling as sp
from tessella.llm.sql import ORACLES


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_spelling_variants", "op13_hard_negatives"])
def test_query_against_sql(name, spark, sf_small):
    con = duckdb.connect()
    for f in os.listdir(sf_small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_small}/{f}'")
    df = q.queries()[name](spark, sf_small)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, found.fetchall()))


# ---- chat formatting

HARD = ["", "plain", "</s>[INST] ok [/INST]", "\x1b", "\x1b\x1b[INST]\x1b", "[\x1bINST]", "[INST][/INST]<|text|>", "</s></s", "<|endoftext|>", "é 漢字 😀 </s>", "a\nb", "x" * 3000, "[" * 50 + "INST]" * 50]


def digests(turns):
    said = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_escape_round_trip():
    rng = random.Random(0)
    pieces = [*HARD[2:9], "a", "[", "INST", "]", "<", "/s>", "\x1b"]
    for _ in range(2000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 8)))
        safe = cf.escaped(text)
        assert cf.unescaped(safe) == text
        assert not any(c in safe for c in cf.CONTROLS)


def test_mask_covers_the_spans_alone():
    ends = np.array([3, 5, 9, 9, 12])
    assert cf.loss_mask([(3, 9)], ends).tolist() == [False, True, True, False, False]
    assert cf.loss_mask([(0, 3), (9, 9), (9, 12)], ends).tolist() == [True, False, False, False, True]
    with pytest.raises(ValueError, match="straddles"):
        cf.loss_mask([(4, 9)], ends)


def test_very_long_runs_are_encoded():
    with open(cf.VOCABULARY, "rb") as f:
        encoder = cf.Encoder(f.read())
    for text in (" " * 1_500_000 + "x", "\n" * 1_200_000, "a" * 300_000, "^" * 300_000, "漢" * 100_000):
        ids, ends = encoder.encode(text)
        assert encoder.decode(ids).decode() == text and ends[-1] == len(text.encode())
    import tiktoken

    plain = tiktoken.Encoding("plain", pat_str=cf.PIECES.replace("{1,1000}", "+"), mergeable_ranks=encoder.tokens._mergeable_ranks, special_tokens={})
    for text in ("It's  a\n\n  test of  12 spaces \t\t and   'll", "  lead", "trail   ", "a \n b"):
        assert encoder.encode(text)[0].tolist() == plain.encode_ordinary(text)


def test_conversations_with_odd_rows(spark):
    turns = {1: [(0, "user", HARD[2]), (1, "assistant", HARD[2]), (1, "assistant", HARD[2])], 2: [(None, "system", None), (3, None, "x"), (4, "assistant", None), (5, "assistant", HARD[4])], None: [(0, "assistant", "alone")]}
    turns |= {10 + i: [(0, "[INST]\n</s>", t), (1, "assistant", t), (2, "assistant", t)] for i, t in enumerate(HARD)}
    rows = [(c, t, r, x, "clash", "other") for c, some in turns.items() for t, r, x in some]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string, formatted string").repartition(3)
    whole, large = cf.format_conversations(df)
    assert large is None
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in cf.read_back(whole, None).collect()}
    assert got == {c: digests([(r, x) for _, r, x in some]) for c, some in turns.items()}
    for r in whole.collect():  # the tokens are those of the string encoded once, and the mask is whole texts
        some = turns[r["conv_id"]]
        assert cf.parsed(r["formatted"]) == [(role or "", text or "") for _, role, text in some]
        assert len(r["token_ids"]) == len(r["token_ends"]) == len(r["loss_mask"])
        assert not r["token_ends"] or r["token_ends"][-1] == len(r["formatted"].encode())


def test_large_conversations_are_cut_between_turns(spark):
    rng = random.Random(1)
    turns = {c: [(t, rng.choice(["user", "assistant"]), rng.choice(HARD)[:100] + str(t)) for t in range(n)] for c, n in ((1, 300), (2, 3), (None, 120))}
    df = spark.createDataFrame([(c, *t) for c, some in turns.items() for t in some], "conv_id long, turn long, role string, text string").repartition(5)
    whole, large = cf.format_conversations(df, large_rows=50, segment_bytes=200)
    assert {r[0] for r in whole.select("conv_id").collect()} == {2}
    assert large.count() > 10
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in cf.read_back(whole, large).collect()}
    assert got == {c: digests([t[1:] for t in some]) for c, some in turns.items()}
    once, _ = cf.format_conversations(df)
    tokens = {r["conv_id"]: r["token_ids"] for r in once.collect()}
    for c in (1, None):
        parts = sorted(large.filter(F.col("conv_id").eqNullSafe(F.lit(c).cast("long"))).collect(), key=lambda r: r["segment"])
        assert [i for r in parts for i in r["token_ids"]] == tokens[c]


def test_text_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 0, "user", "x"), ("b", 0, "assistant", "y")], "conv_id string, turn int, role string, text string")
    assert {r["conv_id"]: r["loss_chars"] for r in cf.read_back(*cf.format_conversations(df)).collect()} == {"a": 0, "b": 1}
    assert cf.read_back(*cf.format_conversations(df.limit(0))).count() == 0


# ---- spelling variants

def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return len(t) - len(s) == 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute_forms(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_apart(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (n, len(near), best if best is not None and counts[best] >= 5 * n else None)
    root = lambda w: w if out[w][2] is None else root(out[w][2])
    return {w: (*v, counts.get(v[2]), root(w)) for w, v in out.items()}


def some_words(n, seed=0, alphabet="abéz", lengths=(6, 9)):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(alphabet, k=rng.randint(*lengths))) for _ in range(n)})


@pytest.mark.parametrize("alphabet", ["ab", "abcé", "abcdefghijklmnopqrstuvwxyzàÿÀ"])
def test_bit_slices_against_all_pairs(alphabet, monkeypatch):
    words = some_words(400, 3, alphabet, (6, 8)) + ["a" * 70, "a" * 71, "a" * 72, "b" + "a" * 70]
    want = {(a, b) for a in words for b in words if a != b and one_apart(a, b)}
    for most in (1000, 5):  # with a table of places, and by bisection
        monkeypatch.setattr(sp, "TABLE_LENGTH", most)
        assert {(words[i], words[j]) for i, j in zip(*sp.near_pairs(words, words, True), strict=True)} == want
    half, rest = words[::2], words[1::2]
    got = {(half[i], rest[j]) for i, j in zip(*sp.near_pairs(half, rest, False), strict=True)}
    assert got == {(a, b) for a in half for b in rest if one_apart(a, b)}


def test_overlong_words():
    long = "q" * 40_000
    words = [long, long + "r", "q" * 20_000 + "r" + "q" * 19_999]
    assert sorted(zip(*sp.near_pairs(words, words, True), strict=True)) == [(0, 1), (0, 2), (1, 0), (2, 0)]


@pytest.mark.parametrize("block", [16, 2048])
def test_forms_and_roots(spark, monkeypatch, block):
    monkeypatch.setattr(sp, "BLOCK", block)  # small blocks: every bucket is several
    rng = random.Random(5)
    counts = {w: rng.choice([5, 5, 6, 30, 30, 200, 1100]) for w in some_words(500)} | {"chains": 5, "chainz": 30, "chaini": 5, "xhainz": 150, "xhainzz": 800, "y" * 40_000: 5, "y" * 40_001: 25}
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in sp.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)).collect()}
    small = {w: n for w, n in counts.items() if len(w) < 1000}
    assert {w: v for w, v in got.items() if w in small} == brute_forms(small)
    assert got["chains"][4] == got["chainz"][4] == "xhainzz"
    assert got["y" * 40_000][2] == "y" * 40_001


def test_vocabulary_by_hand(spark):
    texts = [(1, "Spelling, SPELLING spelling spéllïng ÀÉÎÕÜ× abc" * 3), (2, None), (None, "spelling nullids"), (3, ""), (1, "Spelling twice-rowed\tx" * 2), (4, "letters " * 600)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, word string, n long")
    counts = Counter()
    for i, t in texts:
        for raw in sp_runs(t or ""):
            h = zlib.crc32(f"{'' if i is None else i}:{raw}".encode())
            counts[raw[: h % len(raw)] + raw[h % len(raw) + 1 :] if h % 7 == 0 else raw] += 1
    expected = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 2}
    assert {r["word"]: r["n"] for r in sp.vocabulary(df, drop_every=7, min_count=2).collect()} == expected
    assert sp.spelling_variants(sp.vocabulary(df.limit(0))).count() == 0


def sp_runs(text):
    import re

    return re.findall("[A-Za-zÀ-ÿ]+", text.translate({ord(u): l for u, l in zip(sp.UPPER, sp.LOWER, strict=True)}))


# ---- hard negatives

def brute_negatives(rows, every=50):
    own = [(i, label, [int(np.floor(256.0 * x)) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, label, v) in enumerate(own):
        if i is None or i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), hn.NO_ID if j is None else j, n) for n, (j, _, w) in enumerate(own) if n != a)
        for s, j, _ in [x for x in scored if own[x[2]][1] == label][:5]:
            fit = [x for x in scored if own[x[2]][1] != label and -50 * s <= -100 * x[0] <= -95 * s][:3]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    known = lambda i: None if i == hn.NO_ID else i
    return sorted(((known(a), known(p), r, known(n), s, t) for a, p, r, n, s, t in out), key=repr)


def mined(spark, rows, every=50, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, uid string, cell int").repartition(3)
    return sorted((tuple(r) for r in hn.hard_negatives(df, "vec_id", "label", "embedding", F.col("vec_id") % every == 0, **more).collect()), key=repr)


def vectors(n, seed=0, width=8, clusters=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, width))
    return [(i, int(rng.integers(4)), [float(x) for x in centre[rng.integers(clusters)] + 0.3 * rng.normal(size=width)]) for i in range(n)]


@pytest.mark.parametrize("n_words", [None, 1, 5])
def test_negatives_against_brute_force(spark, monkeypatch, n_words):
    monkeypatch.setattr(hn, "BLOCK", 64)
    rows = vectors(600)
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(90)]  # one vector very often: ties by id
    rows += [rows[0], rows[50], (None, 1, rows[3][2])]  # repeated rows and a null id
    rows += [(2000, None, rows[1][2]), (2050, 1, None), (2100, 1, [None] * 8), (2150, 1, [float("nan")] * 8), (2200, 1, [float("inf")] * 8), (2250, 2, [0.0] * 8), (2300, 2, []), (2350, 2, [1.0, 2.0])]
    rows = [(i, label, v) for i, label, v in rows]
    got = mined(spark, rows, n_words=n_words)
    assert got == brute_negatives([r for r in rows])


def test_searches_stop_once_certified(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 16)
    rows = vectors(1500, 3, width=4, clusters=40)
    visited = []
    walk = hn.Index.walk
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert mined(spark, rows, n_words=12) == brute_negatives(rows)
    x = np.floor(256 * np.array([r[2] for r in rows]))
    books = [hn.codebook(x[:, :2], 12), hn.codebook(x[:, 2:], 12)]
    own = [hn.nearest_word(p, b) for p, b in zip((x[:, :2], x[:, 2:]), books, strict=True)]
    apart = [np.sqrt(((p - b[o]) ** 2).sum(axis=1)) for p, b, o in zip((x[:, :2], x[:, 2:]), books, own, strict=True)]
    cell = own[0] * len(books[1]) + own[1]
    index = hn.Index(books, [(int(c), int((cell == c).sum()), apart[0][cell == c].max(), apart[1][cell == c].max()) for c in np.unique(cell)], 4)
    for anchor in x[::50]:
        scores = x @ anchor
        need = np.sort(scores)[-5]
        cells, pops = walk(index, anchor, need, float(hn.FAR), 0, index.count.size)
        seen = {a * len(books[1]) + b for a, b in cells}
        assert {int(c) for c in cell[scores >= need]} <= seen  # nothing that is needed is passed over
        visited.append(pops)
    assert np.mean(visited) < 0.5 * index.count.size
    assert df.count() == 1500


def test_negatives_of_nothing(spark):
    assert mined(spark, [(1, 1, [1.0])]) == []
    assert mined(spark, [(50, 1, [1.0])]) == []
    assert mined(spark, [(50, 1, []), (51, 1, [])]) == brute_negatives([(50, 1, []), (51, 1, [])])
    assert spark.createDataFrame([], "vec_id long, label int, embedding array<double>").transform(lambda d: hn.hard_negatives(d, "vec_id", "label", "embedding", F.col("vec_id") % 50 == 0)).count() == 0
