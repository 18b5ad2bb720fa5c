"""Which windows of fixed length could occur twice: the stage that operators 2 and 5 share.

Every window of a text (35 words, or 400 bytes) has an anchor: among the grams inside it the leftmost one whose hash
is least. Equal windows have equal anchors at equal offsets, so a window can occur twice only if its anchor's gram
does. Anchors are sparse (about two in each gap of a window's length), which makes counting them cheap; the
windows of grams that occur once are settled without being looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, batch, texts_of, window_anchors

#: (texts) -> (gram hashes of all texts end to end, length of each text in units)
Grams = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
ANCHORS = "gram long, key binary, at int, first int, last int"


def owned_windows(gram: np.ndarray, sizes: np.ndarray, window: int, gram_size: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor, first window, last window), positions counted within the text; and the anchors' grams."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    valid = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    for s, e in zip(starts.tolist(), (ends - window + 1).tolist(), strict=True):
        if e > s:
            valid[s:e] = True
    at, first, last = window_anchors(gram, valid, window - gram_size + 1)
    text = np.searchsorted(ends, first, "right")
    return text, at - starts[text], first - starts[text], last - starts[text], gram[at]


def anchors_of(rows: Iterator[pa.RecordBatch], grams: Callable[[], Grams], window: int, gram_size: int) -> Iterator[pa.RecordBatch]:
    hashed = grams()
    for part in rows:
        gram, sizes = hashed(texts_of(part))
        text, at, first, last, g = owned_windows(gram, sizes, window, gram_size)
        yield batch(gram=g.view(np.int64), key=part.column("key").take(pa.array(text)), at=at.astype(np.int32), first=first.astype(np.int32), last=last.astype(np.int32))


def suspicious_spots(texts: DataFrame, scratch: Scratch, grams: Callable[[], Grams], window: int, gram_size: int, with_counts: bool = False) -> DataFrame:
    """(key, spots): the anchors of each text whose gram occurs elsewhere, with the windows they own.

    With counts, a spot also tells its gram and how often that occurs.

    The count is a partial aggregate and the join back is one that AQE can split, so a gram in a third of all
    texts meets in no single task. A text's list is bounded by its length.
    """
    anchors = arrow_map(texts.select("key", F.col("text").cast("binary").alias("text")), partial(anchors_of, grams=grams, window=window, gram_size=gram_size), ANCHORS)
    anchors = scratch.save(anchors, "anchors")
    # saved, so that the join below has two plain shuffles, of which a hot gram's can be split
    twice = scratch.save(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice")
    told = ["at", "first", "last", *["gram", "n"] * with_counts]
    spots = anchors.join(twice, "gram").groupBy("key").agg(F.collect_list(F.struct(*told)).alias("spots"))
    spots = scratch.save(spots, "spots")
    scratch.drop("anchors", "twice")
    return spots
