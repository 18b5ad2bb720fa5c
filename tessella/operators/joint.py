"""Maps and one network trained together: the integration that looks at the labels.

The loss is weight_pred times the cross entropy of a relu network on the mapped training rows, plus weight_reg times the disagreement
of the anchors' images, sum over ordered pairs of |S_i G_i - S_j G_j|^2, plus weight_cross times the squared B-products of different columns.
The columns keep B-norm one, or norm one if ``orthonormal``. Adam starts from the generalised eigenvectors and moves in coordinates in which
that norm is the plain one, so one rate suits images of any scale; its rates halve by steps. The network sees mapped rows at the scale at which
the mapped anchors have mean square one.

The anchors' part is small algebra on the driver, which sees images in coordinates of what they span together, never the anchors' rows. The rows' part is one Spark job a round: tasks get the parameters by broadcast, and send
back one sum of gradients for the network each and one for each institution among their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as la
from ..session import stable
from .federated import HIDDEN, forward, start, unpack
from .integrate import MAX_SIDE, Method, Solution, coordinates_of, images_of
from .reduce import matrix

#: Tasks of a round: each sends one gradient of the network to the driver.
MAX_TASKS = 64
#: Rows of an institution beyond which it is spread over tasks; rows that go through the network at once.
LARGE, AT_ONCE = 5000, 8192
#: Rounds at most; rounds from one look at the loss to the next, after which it may stop.
ROUNDS, LOOK = 1000, 100


def anchor_matrices(images: dict[int, np.ndarray], ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray, dict[int, slice]]:
    """(A, B, rows of each institution): v'Av is the disagreement of a stacked column v, v'Bv its size."""
    order, at, cuts = sorted(images), 0, {}
    for i in order:
        cuts[i], at = slice(at, at + images[i].shape[1]), at + images[i].shape[1]
    side = np.hstack([images[i] for i in order])
    b = ridge * np.eye(at)
    for i in order:
        b[cuts[i], cuts[i]] += images[i].T @ images[i]
    return 2 * len(order) * b - 2 * side.T @ side, b, cuts


class Blocks:
    """A block-diagonal matrix by its blocks: memory and products in proportion to their number."""

    def __init__(self, blocks: list[np.ndarray]) -> None:
        self.blocks = blocks
        self.stack = np.stack(blocks) if len({b.shape for b in blocks}) == 1 else None
        self.ends = np.cumsum([len(b) for b in blocks])[:-1]

    def _each(self, f, v: np.ndarray) -> np.ndarray:
        if self.stack is not None:
            return f(self.stack, v.reshape(*self.stack.shape[:2], -1)).reshape(v.shape)
        return np.vstack([f(b, part) for b, part in zip(self.blocks, np.split(v, self.ends), strict=True)])

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return self._each(np.matmul, v)

    def solve(self, v: np.ndarray) -> np.ndarray:
        return self._each(np.linalg.solve, v)

    @property
    def T(self) -> Blocks:  # noqa: N802
        return Blocks([b.T for b in self.blocks])

    def cholesky(self) -> Blocks:
        return Blocks([np.linalg.cholesky(b) for b in self.blocks])


class Disagreement:
    """2 m B - 2 W'W by B and W: what ``anchor_matrices`` calls A, never formed."""

    def __init__(self, side: np.ndarray, b: Blocks) -> None:
        self.side, self.b = side, b

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return 2 * len(self.b.blocks) * (self.b @ v) - 2 * self.side.T @ (self.side @ v)


def anchor_blocks(images: dict[int, np.ndarray], ridge: float = 1e-6) -> tuple[Disagreement, Blocks, dict[int, slice]]:
    """The same as ``anchor_matrices``, for any number of institutions: what is held grows with the images, not with their number squared."""
    order = sorted(images)
    ends = np.cumsum([0, *(images[i].shape[1] for i in order)])
    b = Blocks([images[i].T @ images[i] + ridge * np.eye(images[i].shape[1]) for i in order])
    return Disagreement(np.hstack([images[i] for i in order]), b), b, {i: slice(int(lo), int(hi)) for i, lo, hi in zip(order, ends, ends[1:], strict=False)}


def leading(a: Disagreement, low: Blocks, p: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The p least eigenvalues of A against B = low low' and their stacked vectors, from a matrix as large as there are anchors; None where that has no rank p."""
    c = low.solve(a.side.T)
    w, v = np.linalg.eigh(c.T @ c)
    w, v = w[::-1][:p], v[:, ::-1][:, :p]
    if len(w) < p or w[-1] <= w[0] * 1e-12:
        return None
    return 2 * len(a.b.blocks) - 2 * w, la.sign_fixed(low.T.solve(c @ v / np.sqrt(w)))


def anchor_loss(v: np.ndarray, a: np.ndarray | Disagreement, b: np.ndarray | Blocks, weight_reg: float, weight_cross: float) -> tuple[float, np.ndarray]:
    """Value and gradient of the anchors' part."""
    av, bv = a @ v, b @ v
    cross = v.T @ bv
    np.fill_diagonal(cross, 0.0)
    value = weight_reg * float((v * av).sum()) + weight_cross * float((cross**2).sum())
    return value, 2 * weight_reg * av + 4 * weight_cross * bv @ cross


def anchors_start(images: dict[int, np.ndarray], a: Disagreement, low: Blocks, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, stacked maps) to start from; what the anchors' rank does not tell is solved whole, within the bounds of ``images_of``."""
    found = leading(a, low, p)
    if found is None:
        whole([images[i] for i in sorted(images)])
        values, first = la.block_eigen([images[i] for i in sorted(images)], p)
        found = values, np.vstack(first)
    return found


def whole(images: list[np.ndarray]) -> None:
    """An error where a matrix of all columns would be too large."""
    if sum(s.shape[1] for s in images) > 4 * MAX_SIDE:
        raise ValueError(f"at most {4 * MAX_SIDE} columns in all")


def spread(train: DataFrame) -> DataFrame:
    """Training rows by institution; one of more than LARGE rows is spread over further tasks, and only such a one sends more than one sum a round."""
    sizes = train.groupBy("institution").count().filter(F.col("count") > LARGE)
    parts = train.join(F.broadcast(sizes), "institution", "left").withColumn("parts", F.least(F.lit(16), F.ceil(F.coalesce("count", F.lit(1)) / LARGE)))  # large ones are few
    tasks = min(MAX_TASKS, max(1, train.sparkSession.sparkContext.defaultParallelism))
    return stable(parts.repartition(tasks, "institution", F.pmod(F.xxhash64("features"), F.col("parts"))).drop("count", "parts"))


def network_gradients(flat: np.ndarray, z: np.ndarray, y: np.ndarray, shape: tuple[int, int, int]) -> tuple[float, np.ndarray, np.ndarray]:
    """(cross entropy, its gradient for the network, for each mapped row), summed over the rows."""
    h, p = forward(flat, z, shape)
    w1, _, w2, _ = unpack(flat, *shape)
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    d = p
    d[np.arange(len(y)), y] -= 1
    back = (d @ w2.T) * (h > 0)
    return float(loss), np.concatenate([(z.T @ back).ravel(), back.sum(axis=0), (h.T @ d).ravel(), d.sum(axis=0)]), back @ w1.T


def row_gradients(flat: np.ndarray, g: np.ndarray, x: np.ndarray, y: np.ndarray, shape: tuple[int, int, int]) -> tuple[float, np.ndarray, np.ndarray]:
    """(cross entropy, its gradient for the network, for the map), summed over the rows."""
    loss, net, dz = network_gradients(flat, x @ g, y, shape)
    return loss, net, x.T @ dz


PACKS = "institution int, targets binary, features binary"


def _packs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = [(i, rows["target"].to_numpy(np.int64)[lo : lo + LARGE].tobytes(), matrix(rows["features"])[lo : lo + LARGE].tobytes()) for i, rows in f.groupby("institution") for lo in range(0, len(rows), LARGE)]
        yield pd.DataFrame(out, columns=["institution", "targets", "features"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Packs of about AT_ONCE rows."""
    chunk, n = [], 0
    for batch in batches:
        for i, y, x in zip(*(batch.column(c).to_pylist() for c in ("institution", "targets", "features")), strict=True):
            y = np.frombuffer(y, np.int64)
            chunk.append((i, y, np.frombuffer(x).reshape(len(y), -1)))
            n += len(y)
            if n >= AT_ONCE:
                yield chunk
                chunk, n = [], 0
    if chunk:
        yield chunk


def _task(batches: Iterator[pa.RecordBatch], shared, shape: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    flat, cuts, v = shared.value
    loss, n, net, own = 0.0, 0, np.zeros_like(flat), {}
    for chunk in _chunks(batches):
        y = np.concatenate([rows for _, rows, _ in chunk])
        more, dn, dz = network_gradients(flat, np.vstack([x @ v[cuts[i]] for i, _, x in chunk]), y, shape)
        loss, n, net, at = loss + more, n + len(y), net + dn, 0
        for i, rows, x in chunk:
            dg = (x.T @ dz[at : at + len(rows)]).ravel()
            own[i] = own[i] + dg if i in own else dg
            at += len(rows)
    if n:
        sums = [net, *own.values()]
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sums)], dtype=np.int32), np.concatenate(sums))
        rest = [0] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *own], pa.int32()), pa.array([n, *rest], pa.int64()), pa.array([loss, *rest], pa.float64()), lists], ["institution", "n", "loss", "gradient"])


class _Adam:
    def __init__(self, like: np.ndarray, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros_like(like), np.zeros_like(like), 0, rate

    def step(self, x: np.ndarray, gradient: np.ndarray, factor: float) -> np.ndarray:
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * gradient, 0.999 * self.v + 0.001 * gradient**2
        return x - factor * self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def joint_maps(reduced: DataFrame, p: int, n_classes: int, weight_pred: float = 1.0, weight_reg: float = 1.0, weight_cross: float = 0.0, hidden: int = HIDDEN, rounds: int = ROUNDS, rate: float = 1e-3, rate_maps: float = 1e-3, halve_every: int = 500, tolerance: float = 1e-6, orthonormal: bool = False, seed: int = 0) -> tuple[Solution, list[float]]:
    """(maps, loss of each round). ``reduced`` is the long table of images; rows without a label take no part.

    It stops early once the loss has changed by less than ``tolerance`` of itself since the look LOOK rounds before. With ``weight_pred`` zero no row is read.
    """
    if orthonormal:  # solved whole, within the bounds of ``images_of``
        images, _ = images_of(reduced)
        n_anchors = len(next(iter(images.values())))
    else:
        images, n_anchors = coordinates_of(reduced)
    a, b, cuts = anchor_blocks(images)
    low = (Blocks([np.eye(len(x)) for x in b.blocks]) if orthonormal else b).cholesky()
    unit = lambda u: u / np.sqrt(np.maximum((u * u).sum(axis=0), 1e-300))
    if orthonormal:
        values, first = la.block_eigen([images[i] for i in sorted(images)], p, orthonormal=True)
        first = np.vstack(first)
    else:
        values, first = anchors_start(images, a, low, p)
    u = unit(low.T @ first)
    scale = float(np.sqrt(n_anchors * len(images)))
    shape = (p, hidden, n_classes)
    flat = start(*shape, seed)
    context = reduced.sparkSession.sparkContext
    rows = None
    if weight_pred:
        train = reduced.filter((F.col("part") == "train") & F.col("target").isNotNull()).select("institution", "target", "features")
        rows = stable(spread(train).mapInPandas(_packs, PACKS))
    backward = low.T
    adam_u, adam_net, losses = _Adam(u, rate_maps), _Adam(flat, rate), []
    for turn in range(rounds):
        v = backward.solve(u)
        loss, dv = anchor_loss(v, a, b, weight_reg, weight_cross)
        net = np.zeros_like(flat)
        if rows is not None:
            shared = context.broadcast((flat, cuts, scale * v))
            found = rows.mapInArrow(partial(_task, shared=shared, shape=shape), "institution int, n long, loss double, gradient array<double>").toPandas()  # sums: a row a task, and one for each of its institutions
            shared.unpersist()
            n = max(int(found["n"].sum()), 1)
            loss += weight_pred * float(found["loss"].sum()) / n
            for i, gradient in zip(found["institution"], found["gradient"], strict=True):
                if i < 0:
                    net += weight_pred / n * np.asarray(gradient)
                else:
                    dv[cuts[i]] += scale * weight_pred / n * np.asarray(gradient).reshape(-1, p)
        losses.append(loss)
        if turn and turn % LOOK == 0 and abs(losses[-1 - LOOK] - loss) <= tolerance * max(abs(losses[-1 - LOOK]), 1e-12):
            break
        factor = 0.5 ** (turn // halve_every)
        u, flat = unit(adam_u.step(u, low.solve(dv), factor)), adam_net.step(flat, net, factor)
    v = backward.solve(u)
    maps = Solution(Method("GEP"), linear={i: v[cut] for i, cut in cuts.items()}, values=values)
    return maps, losses
