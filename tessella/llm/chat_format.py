"""Chat formatting: whole conversations as tokens with a loss mask that lies exactly on the assistant's texts.

A conversation is rendered as one string and encoded once. The tokens of byte-level BPE tile the string's bytes, so the running sum of their
lengths gives every token's place, and a binary search of the assistant's spans in those places gives the mask. The template's marks are
tokens of their own, which no other token can straddle:

    [INST]role<|text|>text[/INST]     every role but the assistant's
    text</s>                          the assistant

Control strings inside texts and roles are made ordinary text by an escape character after their first character, wherever they start, overlaps
included; the escape character itself is doubled. ``unescaped`` takes that back.

A null text or role is empty, a null conversation id is an id of its own, a null turn comes first, and rows of one turn follow each other by role and
text; repeated rows are turns of their own. An empty table gives no rows. Other columns are left out, whatever their names. A conversation of more than
``LARGE_ROWS`` turns or ``LARGE_BYTES`` bytes, which no task should hold, is cut between turns into segments of about ``SEGMENT_BYTES``; as marks
are tokens of their own, its segments' tokens in a row are the whole's.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import Scratch, arrow_map

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE cuts a text into pieces before it merges (a fixed value of the vocabulary). White space is cut after every thousand characters,
#: as the search goes back over all of it and has a bounded stack; shorter runs give the vocabulary's own tokens.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s{1,1000}(?!\S)|\s{1,1000}"""
ESCAPE = "\x1b"
OPEN, TEXT, CLOSE, END = "[INST]", "<|text|>", "[/INST]", "</s>"
#: Strings that are tokens of their own; the first is the vocabulary's.
CONTROLS = ("<|endoftext|>", OPEN, TEXT, CLOSE, END)
ASSISTANT = "assistant"
LARGE_ROWS, LARGE_BYTES, SEGMENT_BYTES = 10_000, 16 << 20, 1 << 20

_STARTS = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)|" + ESCAPE, re.S)
_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(TEXT)}(.*?){re.escape(CLOSE)}|(.*?){re.escape(END)}", re.S)
_ESCAPED = re.compile(f"{ESCAPE}({ESCAPE}?)")


def escaped(text: str) -> str:
    return _STARTS.sub(lambda m: m[0] + ESCAPE, text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def rendered(turns: list[tuple[str | None, str | None]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The turns' UTF-8 bytes under the template, and the byte spans of the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escaped(text or "")
        if role == ASSISTANT:
            spans.append((at, at + len(body.encode())))
            part = f"{body}{END}".encode()
        else:
            part = f"{OPEN}{escaped(role or '')}{TEXT}{body}{CLOSE}".encode()
        parts.append(part)
        at += len(part)
    return b"".join(parts), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered string."""
    found, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        found.append((ASSISTANT, unescaped(m[3])) if m[3] is not None else (unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("not a rendered conversation")
    return found


def loss_mask(spans: list[tuple[int, int]], ends: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span; ``ends``: where each token ends, in bytes."""
    step = np.zeros(len(ends) + 1, np.int64)
    if len(ends) and spans:
        a, b = np.array(spans, np.int64).T
        a, b = a[b > a], b[b > a]
        starts = np.concatenate([[0], ends[:-1]])
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        if (starts[first] != a).any() or (ends[last - 1] != b).any():
            raise ValueError("a token straddles the bound of a turn")
        np.add.at(step, first, 1)
        np.add.at(step, last, -1)
    return step.cumsum()[:-1] > 0


class Encoder:
    """A byte-level BPE vocabulary with the template's marks as further tokens."""

    def __init__(self, vocabulary: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        marks = {c: len(ranks) + i for i, c in enumerate(CONTROLS)}
        self.tokens = tiktoken.Encoding("chat", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=marks)
        self.lengths = np.zeros(len(ranks) + len(marks), np.int64)
        for token, i in (*ranks.items(), *((c.encode(), i) for c, i in marks.items())):
            self.lengths[i] = len(token)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, where each ends in bytes)."""
        ids = np.array(self.tokens.encode(text, allowed_special="all"), np.int32)
        return ids, self.lengths[ids].cumsum() if len(ids) else np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tokens.decode_bytes(ids.tolist())


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary) -> Encoder:
    """One a worker and vocabulary."""
    key = hash(vocabulary.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary.value)
    return _ENCODERS[key]


def _encoded(conv: list, segment: list[int], turns: list[list[tuple]], encoder: Encoder, kind: pa.DataType) -> pa.RecordBatch:
    texts, ids, ends, masks = [], [], [], []
    for t in turns:
        raw, spans = rendered(t)
        text = raw.decode()
        i, e = encoder.encode(text)
        texts.append(text)
        ids.append(i)
        ends.append(e)
        masks.append(loss_mask(spans, e))
    # 64-bit offsets of lists are not what Spark reads: a batch holds a bounded number of tokens instead
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))
    flat = lambda arrays, dtype: pa.array(np.concatenate([*arrays, np.zeros(0, dtype)]).astype(dtype))
    lists = [pa.ListArray.from_arrays(offsets, flat(x, t)) for x, t in ((ids, np.int32), (ends, np.int32), (masks, np.bool_))]
    return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(segment, pa.int64()), pa.array(texts, pa.string()), *lists], ["conv_id", "segment", "formatted", "token_ids", "token_ends", "loss_mask"])


def _whole(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(vocabulary)
    for rows in batches:
        turns = [[(t["role"], t["text"]) for t in c] for c in rows.column("turns").to_pylist()]
        if turns:
            yield _encoded(rows.column("conv_id").to_pylist(), [0] * len(turns), turns, encoder, rows.column("conv_id").type)


def _cut(batches: Iterator[pa.RecordBatch], vocabulary, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns of large conversations as segments, numbered so that partition and place order them."""
    encoder, held, size, owner, n, kind, place = _encoder(vocabulary), [], 0, None, 0, pa.int64(), 0
    for rows in batches:
        kind = rows.column("conv_id").type
        for conv, role, text, part in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "role", "text", "part")), strict=True):
            if held and (conv != owner or size >= segment_bytes):
                yield _encoded([owner], [place + n], [held], encoder, kind)
                held, size, n = [], 0, n + 1
            owner, place = conv, part << 32
            held.append((role, text))
            size += len(text or "") + 1
    if held:
        yield _encoded([owner], [place + n], [held], encoder, kind)


def _schema(rows: DataFrame) -> StructType:
    tokens = [StructField(n, ArrayType(t)) for n, t in (("token_ids", IntegerType()), ("token_ends", IntegerType()), ("loss_mask", BooleanType()))]
    return StructType([StructField("conv_id", rows.schema["conv_id"].dataType), StructField("segment", LongType()), StructField("formatted", StringType()), *tokens])


def format_conversations(rows: DataFrame, vocabulary: str = VOCABULARY, large_rows: int = LARGE_ROWS, large_bytes: int = LARGE_BYTES, segment_bytes: int = SEGMENT_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """(whole conversations, segments of large ones or None): conv_id, segment, formatted, token_ids, token_ends (bytes), loss_mask.

    rows: conv_id, turn, role, text. The driver reads the vocabulary, of under a megabyte, and sends it out.
    """
    spark = rows.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    turns = rows.select("conv_id", "turn", "role", "text")
    scratch = Scratch(spark, "chat")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    large = scratch.save(sizes.filter((F.col("n") > large_rows) | (F.col("bytes") > large_bytes)).select(F.col("conv_id").alias("large")), "large")
    some = large.limit(1).count() > 0
    same = F.col("conv_id").eqNullSafe(F.col("large"))
    schema = _schema(rows)
    small = turns.join(large, same, "left_anti") if some else turns
    gathered = small.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))  # bounded by what is large
    whole = arrow_map(gathered, partial(_whole, vocabulary=shared), schema)
    if not some:
        return whole, None
    order = ["conv_id", "turn", "role", "text"]
    dealt = turns.join(large, same, "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    return whole, arrow_map(dealt.withColumn("part", F.spark_partition_id().cast("long")), partial(_cut, vocabulary=shared, segment_bytes=segment_bytes), schema)


DIGESTS = (("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long"), ("n_tokens", "long"), ("n_loss_tokens", "long"))


def _read(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose segments follow each other: only running hashes and counts are held."""
    encoder, owner, state, kind, out = _encoder(vocabulary), None, None, pa.int64(), []

    def told() -> tuple:
        return (owner, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:])

    def batch() -> pa.RecordBatch:
        kinds = [kind, *(pa.string() if k == "string" else pa.int64() for _, k in DIGESTS)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", *(n for n, _ in DIGESTS)])

    for rows in batches:
        kind = rows.column("conv_id").type
        for conv, segment, ids, mask in zip(rows.column("conv_id").to_pylist(), rows.column("segment").to_pylist(), rows.column("token_ids"), rows.column("loss_mask"), strict=True):
            if state is not None and (conv != owner or segment == 0):
                out.append(told())
                state = None
            if state is None:
                owner, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            ids, mask = np.asarray(ids.values), mask.values.to_numpy(zero_copy_only=False)
            raw = encoder.decode(ids)
            ends = encoder.lengths[ids].cumsum() if len(ids) else np.zeros(0, np.int64)
            text = raw.decode()
            for role, said in parsed(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            for lo, hi in edges.reshape(-1, 2):  # runs of tokens under the mask
                said = unescaped(raw[ends[lo - 1] if lo else 0 : ends[hi - 1]].decode())
                state[2] += len(said)
                state[3].update(said.encode())
            for at, more in ((4, len(text)), (5, len(ids)), (6, int(mask.sum()))):
                state[at] += more
        if out:
            yield batch()
            out = []
    if state is not None:
        out.append(told())
        yield batch()


def read_back(whole: DataFrame, segments: DataFrame | None, vocabulary: str = VOCABULARY) -> DataFrame:
    """conv_id and digests, from the tokens and masks alone.

    A digest is one hash over its conversation, so the segments of a large one stream in order through one task, which holds a segment at a time.
    """
    spark = whole.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    schema = StructType([whole.schema["conv_id"], *(StructField(n, StringType() if k == "string" else LongType()) for n, k in DIGESTS)])
    needed = ["conv_id", "segment", "token_ids", "loss_mask"]
    found = arrow_map(whole.select(*needed), partial(_read, vocabulary=shared), schema)
    if segments is None:
        return found
    ordered = segments.select(*needed).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return found.union(arrow_map(ordered, partial(_read, vocabulary=shared), schema))


def with_probe(rows: DataFrame, conv_id: int = -7, text: str = "</s>[INST] ok [/INST]") -> DataFrame:
    """The table and one more conversation, both of whose turns consist of control strings."""
    own = rows.sparkSession.range(2).select(F.lit(conv_id).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(text).alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(own)
