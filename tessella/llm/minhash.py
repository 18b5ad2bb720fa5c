"""Operator 1: near-duplicate groups by b-bit MinHash.

1. Copies of a text become one row (map-side aggregate), so groups of copies cost one signature.
2. Each text's word shingles get BANDS * ROWS minima under as many multiplicative hashes. A band is a hash of
   ROWS full minima; the signature keeps only the low B_BITS of every minimum, packed into longs.
3. Texts that share a band are candidates. A bucket is never expanded into all of its pairs: each member is compared with one
   hub, the member that meets most others in all its buckets, and links form components.
4. Buckets that still hold several components are settled by differences from their hub. If x and y lack r and add a
   shingles against hub h, then J(x, y) >= t needs so many differences in common: at least (u_x + u_y - (1 - t) |h|) / (1 + t),
   u = r + t a. That is never less than one where x or y is not linked to the hub, and it grows with the distance. So
   an exact prefix filter runs over the differences, rarest first, by classes of u: texts that share little more
   than what the hub has in common with everyone make no pairs, whether they are thousands of near copies or hold one long passage.
5. A candidate pair is dropped if the sizes rule the threshold out, or if its similarity, estimated from the signatures by
   bit counts and corrected for chance collisions of b-bit values, lies more than five standard errors below. The rest is
   confirmed on full shingle sets (64-bit shingle hashes; two shingles of one pair of texts fall together with a
   chance below 1e-10).

With 40 bands of 6 rows a pair at similarity 0.8 is a candidate with chance 1 - (1 - 0.8^6)^40 > 0.99999.

Defined results: null, empty and blank texts have no shingles, link with nothing and are their own component; texts
shorter than a shingle are one shingle, the whole sequence; very long texts are shingled whole; rows that repeat an id with equal text share their component; rows
with a null id count as members but never name a component, unless no other member exists; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, arrow_map, batch, components, distinct_texts, mix, odd_constants, text_key, texts_of

BANDS, ROWS, B_BITS = 40, 6, 4
HASHES = BANDS * ROWS
PER_LONG = 64 // B_BITS
#: Similarity in hundredths.
THRESHOLD = 80
#: Classes of distance from the hub within the distance that links to it: finer ones make shorter prefixes, but more of them.
CLASSES = 8
#: Standard errors below the threshold at which an estimate rules a pair out.
MARGIN = 5.0
#: Shingles hashed at a time: the block of HASHES times as many values stays in cache.
CHUNK = 2048


def shingle_set(text: bytes, n: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; one for the whole sequence if it is shorter."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = words.of(found)
    return np.unique(mix(_chain(h, min(n, len(h)))))


def _chain(h: np.ndarray, n: int) -> np.ndarray:
    out = mix(h[: len(h) - n + 1] + np.uint64(n))
    for i in range(1, n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i])
    return out


def minima(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(multipliers), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), CHUNK):
        np.minimum(low, (multipliers[:, None] * x[None, at : at + CHUNK]).min(axis=1), out=low)
    return low


def _signatures(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    words, a = WordHashes(), odd_constants(HASHES, 101, np.uint32)
    c = odd_constants(HASHES, 102).reshape(BANDS, ROWS)
    tag = odd_constants(BANDS, 103)
    shifts = (np.arange(PER_LONG) * B_BITS).astype(np.uint64)
    for part in rows:
        keys, texts = part.column("key"), texts_of(part)
        sizes, low = np.zeros(len(texts), np.int64), np.zeros((len(texts), HASHES), np.uint32)
        for i, t in enumerate(texts):
            s = shingle_set(t, n, words)
            sizes[i] = len(s)
            if len(s):
                low[i] = minima(s, a)
        m = low.astype(np.uint64)
        bands = mix((m.reshape(-1, BANDS, ROWS) * c).sum(axis=2, dtype=np.uint64) + tag)
        bits = m & np.uint64((1 << B_BITS) - 1)
        packed = (bits.reshape(len(texts), -1, PER_LONG) << shifts).sum(axis=2, dtype=np.uint64)
        lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.view(np.int64).ravel()))
        yield batch(key=keys, n=sizes, bands=lists(bands), signature=lists(packed))


def _sets(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for part in rows:
        yield batch(node=part.column("node"), members=pa.array([shingle_set(t, n, words).tobytes() for t in texts_of(part)], pa.binary()))


def _differences(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each set lacks of its hub's and adds to it, as hashes of signed shingles."""
    for part in rows:
        lacks, adds, sizes, hubs, tokens = [], [], [], [], []
        for x, h in zip(part.column("set_a").to_pylist(), part.column("set_b").to_pylist(), strict=True):
            x, h = np.frombuffer(x, np.uint64), np.frombuffer(h, np.uint64)
            gone, new = np.setdiff1d(h, x, assume_unique=True), np.setdiff1d(x, h, assume_unique=True)
            lacks.append(len(gone))
            adds.append(len(new))
            sizes.append(len(x))
            hubs.append(len(h))
            tokens.append(np.concatenate([new, mix(gone + np.uint64(1))]))
        ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
        yield batch(hub=part.column("hub"), node=part.column("node"), root=part.column("root"), n=np.array(sizes, np.int64), h=np.array(hubs, np.int64), lacks=np.array(lacks, np.int64),
                    adds=np.array(adds, np.int64), tokens=pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*tokens, np.empty(0, np.uint64)]).view(np.int64))))


def _confirmed(rows: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for part in rows:
        ok = []
        for x, y in zip(part.column("set_a").to_pylist(), part.column("set_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= threshold * (len(x) + len(y) - both))
        yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def estimated_similarity(x: Column, y: Column) -> Column:
    """Share of equal b-bit values, less what chance makes equal."""
    ones = int(sum(1 << i for i in range(0, 64, B_BITS)))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones

    def unequal(p: Column, q: Column) -> Column:
        diff = p.bitwiseXOR(q)
        folded = diff
        for i in range(1, B_BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(diff, i))
        return F.bit_count(folded.bitwiseAND(F.lit(ones)))

    share = 1 - F.aggregate(F.zip_with(x, y, unequal), F.lit(0), lambda s, v: s + v) / HASHES
    chance = 2.0**-B_BITS
    return (share - chance) / (1 - chance)


def _links(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, scratch: Scratch, threshold: int, name: str) -> DataFrame:
    """The pairs (a, b) that the signatures do not rule out and the full sets confirm."""
    t = threshold / 100
    error = (t * (1 - t) / HASHES) ** 0.5
    side = lambda s: signatures.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("signature").alias(f"sig_{s}"))
    likely = (pairs.join(side("a"), "a").join(side("b"), "b")
              .filter(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
              .filter(estimated_similarity(F.col("sig_a"), F.col("sig_b")) >= t - MARGIN * error).select("a", "b"))
    likely = scratch.save(likely, f"likely-{name}")
    both = likely.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b")
    return scratch.save(arrow_map(both.select("a", "b", "set_a", "set_b"), partial(_confirmed, threshold=threshold), "a long, b long"), f"links-{name}")


def _side(sets: DataFrame, s: str, name: str | None = None) -> DataFrame:
    return sets.select(F.col("node").alias(name or s), F.col("members").alias(f"set_{s}"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    return _judged(docs, words, threshold).drop("key")


def one_of_each(docs: DataFrame, words: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns; of rows that repeat id and text, one."""
    kept = _judged(docs, words, threshold).filter("kept").select("doc_id", "key").distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text_key("text"))
    same = (keyed["key"] == kept["key"]) & keyed["id"].eqNullSafe(kept["doc_id"])
    out = keyed.join(kept, same, "left_semi")
    if not keyed.groupBy("id", "key").count().filter("count > 1").limit(1).isEmpty():
        out = out.dropDuplicates(["id", "key"])
    return out.select("row.*")


def _judged(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = distinct_texts(docs, scratch)
    signed = arrow_map(texts.select("key", F.col("text").cast("binary").alias("text")), partial(_signatures, n=words), "key binary, n long, bands array<long>, signature array<long>")
    signatures = scratch.save(signed.withColumn("node", F.monotonically_increasing_id()), "signatures")  # the ids are fixed once written

    spread = signatures.filter("n > 0").select("node", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    buckets = scratch.save(spread.join(shared, "band"), "buckets")
    met = buckets.groupBy("node").agg(F.sum("members").alias("met"))
    hubs = buckets.join(met, "node").groupBy("band").agg(F.max(F.struct("met", "node"))["node"].alias("hub"))
    placed = scratch.save(buckets.join(hubs, "band").filter("node <> hub").select("band", "node", "hub"), "placed")
    stars = scratch.save(placed.select("node", "hub").distinct(), "stars")
    need = stars.select("node").union(stars.select("hub")).distinct().join(signatures.select("node", "key"), "node")
    raw = texts.join(need.hint("shuffle_hash"), "key").select("node", F.col("text").cast("binary").alias("text"))
    sets = scratch.save(arrow_map(raw, partial(_sets, n=words), "node long, members binary"), "sets")

    pairs = stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    own = Scratch(docs.sparkSession, "minhash-stars")
    roots = components(_links(pairs, signatures, sets, scratch, threshold, "stars"), own)
    rest = _settled(placed, roots, signatures, sets, scratch, threshold)
    over = lambda s: F.coalesce(F.col(s), F.col("node"))
    if rest is not None:  # links between components, as links between their roots
        far = Scratch(docs.sparkSession, "minhash-rest")
        rooted = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
        between = rest.join(rooted("a"), "a", "left").join(rooted("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        later = components(between, far).select(F.col("node").alias("was"), F.col("root").alias("now"))
        roots = signatures.select("node").join(roots, "node", "left").select("node", over("root").alias("was")).join(later, "was", "left").select("node", F.coalesce("now", "was").alias("root"))

    named = docs.select(F.col("doc_id").alias("doc_id"), text_key("text"))
    least = named.groupBy("key").agg(F.min("doc_id").alias("least"))
    known = signatures.select("key", "node", "n").join(least, "key").join(roots, "node", "left").withColumn("root", over("root"))
    known = scratch.save(known.select("key", "n", "root", "least"), "known")
    scratch.keep_only("known")
    own.keep_only()
    ids = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "n", "component_id")
    out = named.join(ids, "key").select("key", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _settled(placed: DataFrame, roots: DataFrame, signatures: DataFrame, sets: DataFrame, scratch: Scratch, threshold: int) -> DataFrame | None:
    """Links between the components that buckets still hold; None if each bucket holds one only."""
    named = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    hubs = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    named = named.join(hubs, "hub", "left").withColumn("hub_root", F.coalesce("hub_root", "hub"))
    mixed = named.filter("root <> hub_root").select("band").distinct()  # a bucket without such a member is one component
    members = scratch.save(named.join(mixed, "band", "left_semi").select("hub", "node", "root").distinct(), "members")
    if members.isEmpty():
        return None
    both = members.join(_side(sets, "a", "node"), "node").join(_side(sets, "b", "hub"), "hub")
    found = arrow_map(both.select("hub", "node", "root", "set_a", "set_b"), _differences, "hub long, node long, root long, n long, h long, lacks long, adds long, tokens array<long>")
    pairs = scratch.save(_difference_pairs(scratch.save(found, "differences"), scratch, threshold), "pairs-rest")
    return _links(pairs, signatures, sets, scratch, threshold, "rest")


def _difference_pairs(found: DataFrame, scratch: Scratch, threshold: int) -> DataFrame:
    """(a, b) of different components under one hub whose differences from it may have enough in common for a link.

    Scaled by 100: u = 100 lacks + t adds, a link needs (100 + t) common >= u_a + u_b - (100 - t) h. Differences of one component
    alone come first in the order, then the rarer ones. The prefix of a text depends on how far its partner is from the hub: there is one for
    each class of u that a partner can have (linked sets differ by at most (100 - t) / t of either), and a pair meets in the classes of both.
    """
    t = threshold
    spread = found.select("hub", "node", "root", F.explode("tokens").alias("at"))
    often = spread.groupBy("hub", "at").agg(F.count(F.lit(1)).alias("often"), (F.min("root") < F.max("root")).alias("common")).filter("common").select("hub", "at", "often")
    common = spread.join(often, ["hub", "at"]).groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("often", "at"))).alias("list"))
    u, base = 100 * F.col("lacks") + t * F.col("adds"), (100 - t) * F.col("h")
    listed = found.select("hub", "node", "root", "n", (F.col("lacks") + F.col("adds")).alias("d"), u.alias("u"), base.alias("base"), F.greatest(F.lit(1), F.floor(base / CLASSES)).cast("long").alias("step"))
    listed = scratch.save(listed.join(common, ["hub", "node"]).withColumn("own", F.floor(F.col("u") / F.col("step"))), "listed")
    reach = F.ceil(F.lit((100 - t) * 100 / t) * F.col("n")) + 1
    classes = F.sequence(F.greatest(F.lit(0), F.floor((F.col("u") - reach) / F.col("step"))), F.floor((F.col("u") + reach) / F.col("step")))
    by_class = listed.select("*", F.explode(classes).alias("other"))
    # two that are linked to the hub need no test
    by_class = by_class.filter((F.col("u") > F.col("base")) | ((F.col("other") + 1) * F.col("step") > F.col("base")))
    need = F.greatest(F.lit(1), F.ceil((F.col("u") + F.col("other") * F.col("step") - F.col("base")) / (100 + t)))
    alone = F.col("d") - F.size("list")
    length = F.least(F.size("list"), F.col("d") - need + 1 - alone).cast("int")
    prefixes = by_class.filter(length > 0).select("hub", "node", "root", "n", "d", "u", "base", "own", "other", alone.alias("alone"), F.posexplode(F.slice("list", F.lit(1), length)).alias("i", "x"))
    places = prefixes.select("hub", "own", "other", F.col("x.at").alias("at"), "node", "root", "n", "u", "base", (F.col("d") - F.col("alone") - F.col("i")).alias("left"))
    places = scratch.save(places, "places")
    a = places.select("hub", "at", "own", "other", "base", *[F.col(c).alias(f"{c}_a") for c in ("root", "n", "u", "left")], F.col("node").alias("a"))
    b = places.select("hub", "at", F.col("own").alias("other"), F.col("other").alias("own"), *[F.col(c).alias(f"{c}_b") for c in ("root", "n", "u", "left")], F.col("node").alias("b"))
    enough = (100 + t) * F.least("left_a", "left_b") >= F.col("u_a") + F.col("u_b") - F.col("base")
    near = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & (100 * F.least("n_a", "n_b") >= t * F.greatest("n_a", "n_b")) & enough
    return a.join(b, ["hub", "at", "own", "other"]).filter(near).select("a", "b").distinct()
