"""Operator 8: quality rules with verdicts by host. DataFrame functions only; no Python touches a row.

Every document gets counts of its whole text and the base verdict. Failures are summed per host (the
``source`` column), the hosts' rates are shrunk towards an empirical beta prior whose moments come from all
hosts, and a host whose shrunk rate exceeds ``host_limit`` loses all of its documents. Counts and host sums
are partial aggregates, so a host with a third of all rows is no hot spot; the join back is left to AQE,
which broadcasts the verdicts only when their measured size allows it and splits a skewed host otherwise.

Defined results: null text counts as empty (no words, so it fails); null source is a host of its own;
repeated rows are separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch

#: Words of a window whose repetition counts.
WINDOW = 5
HOST_LIMIT = 0.5
#: Least and largest weight of the beta prior, in documents.
PRIOR_WEIGHT = (1.0, 10_000.0)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``: a lambda variable is never computed anew."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words covered by windows of five that the text holds twice or more."""
    def by_grams(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = let(pairs, lambda s: F.transform(
            F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k + 1 < F.size(s)) & (F.get(s, k + 1)["h"] == x["h"]))),
            lambda x: x["i"]))
        covered = let(F.sort_array(at), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(p, k - 1)))),
            F.lit(0), lambda a, b: a + b))
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), covered).otherwise(F.lit(0))

    # each word is hashed once; a window's hash is that of its words' hashes
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = let(hashes, lambda h: F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    return let(grams, by_grams)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    is_word = lambda w: w != ""
    lines = lambda t: F.filter(F.split(t, "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\f\r", "")) > 0)
    counts = let(F.filter(F.split(text, SPACE), is_word), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeat_words(ws).cast("long").alias("n_repeat_words")))
    out = docs.select(
        F.col("doc_id").alias("doc_id"), F.col("source").alias("host"), counts.alias("c"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines(text), lambda xs: F.size(xs) - F.size(F.array_distinct(xs))).cast("long").alias("n_dup_lines"))
    failed = (F.col("c.n_words") < 10) | (100 * F.col("c.n_repeat_words") > 20 * F.col("c.n_words"))
    return out.select("doc_id", "host", F.col("c.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("c.n_repeat_words").alias("n_repeat_words"), failed.alias("base_failed"))


def host_verdicts(feats: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """host, host_rate (shrunk), host_kept; the prior comes from the mean and variance of all hosts' rates."""
    hosts = feats.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    weight = F.least(F.lit(PRIOR_WEIGHT[1]), F.greatest(F.lit(PRIOR_WEIGHT[0]), F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(PRIOR_WEIGHT[1]))))
    # the prior is one row by construction
    shrunk = hosts.join(F.broadcast(prior.select("m", weight.alias("weight")))).withColumn("host_rate", (F.col("failed") + F.col("m") * F.col("weight")) / (F.col("n") + F.col("weight")))
    return shrunk.select("host", "host_rate", (F.col("host_rate") <= host_limit).alias("host_kept"))


def quality_rules(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "rules")
    feats = scratch.save(features(docs), "features")
    hosts = scratch.save(host_verdicts(feats, host_limit), "hosts")
    joined = feats.join(hosts.withColumnRenamed("host", "known"), F.col("host").eqNullSafe(F.col("known")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"), F.col("host").alias("host"), F.round("host_rate", 6).alias("host_rate"))
