"""Multinomial logistic regressions over one table, many at a time (M2, M3).

A fit of MLlib reads all rows once a step, so that eighteen fits of fifty steps read them many hundred times, and each keeps
a copy of them in memory. Here the term counts are laid out once, small (some six bytes a word of a text), and one pass
gives loss and gradient of every fit that waits for them: the passes are as many as the steps of the longest fit.

What is fitted is MLlib's ``LogisticRegression`` (multinomial, L2, intercepts, standardised and centred features, weighted
rows): the same loss, the same start, and the steps of the L-BFGS that it calls (Breeze: ten pairs of memory, strong Wolfe line
search, the same ends), so that every step gives its coefficients up to rounding (tested). Steps do not depend on how many may
follow: a fit's state after 20 steps is the fit with ``maxIter`` 20, and one run serves all ``maxIter`` of a grid.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A block holds rows of one fold, up to either number; row numbers take two bytes.
BLOCK_ROWS = 1 << 14
BLOCK_ENTRIES = 1 << 21
CHUNK = 128        # entries of a key summed in one line of a layout of many entries, a quarter else
MANY_ENTRIES = 1 << 19
STRIPE = 4096      # lines summed at a time: they stay in the processor's cache
MANY_PARTS = 32    # partial sums that the driver adds itself; more are added in the tasks first
MEMORY, C1, C2, SEARCHES = 10, 1e-4, 0.9, 10


# ---------------------------------------------------------------- rows in blocks
@dataclass
class Layout:
    """A sparse matrix as lists of ``other`` by slot: slot s of line l is the s-th entry of a chunk of one key's entries.

    Lines are ordered by length, so that a slot takes the first ``widths[s]`` of them; ``factors`` is None if all are 1.
    """
    widths: np.ndarray
    other: np.ndarray
    factors: np.ndarray | None
    by_key: np.ndarray   # lines in the order of their keys
    first: np.ndarray    # where a key's lines begin in it
    keys: np.ndarray
    size: int

    def sums(self, dense: np.ndarray) -> np.ndarray:
        """For every key the sum of the rows of ``dense`` that its entries name, times their factors."""
        dense, out = np.ascontiguousarray(dense), np.zeros((self.size, dense.shape[1]))
        if not len(self.keys):
            return out
        lines, some, at = np.zeros((len(self.by_key), dense.shape[1])), np.empty((STRIPE, dense.shape[1])), 0
        for width in self.widths.tolist():
            for a in range(0, width, STRIPE):
                z = min(width, a + STRIPE)
                rows = np.take(dense, self.other[at + a:at + z], axis=0, out=some[:z - a], mode="clip")
                if self.factors is not None:
                    rows *= self.factors[at + a:at + z, None].astype(float)
                lines[a:z] += rows
            at += width
        out[self.keys] = np.add.reduceat(lines[self.by_key], self.first, axis=0)
        return out


def layout(counts: np.ndarray, other: np.ndarray, factors: np.ndarray | None) -> Layout:
    """``counts`` entries of every key; ``other`` and ``factors`` in the order of the keys."""
    chunk = CHUNK if len(other) > MANY_ENTRIES else CHUNK // 4
    chunks = -(-counts // chunk)
    owner = np.repeat(np.arange(len(counts)), chunks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begins = (np.cumsum(counts) - counts)[owner] + nth * chunk
    lengths = np.minimum(counts[owner] - nth * chunk, chunk)
    order = np.argsort(-lengths, kind="stable")
    begins, owner, lengths = begins[order], owner[order], lengths[order]
    widths = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, chunk + 1))
    widths = widths[widths > 0]
    from_ = np.concatenate([begins[:w] + s for s, w in enumerate(widths)]) if len(widths) else np.zeros(0, np.int64)
    by_key = np.argsort(owner, kind="stable")
    keys, first = np.unique(owner[by_key], return_index=True)
    return Layout(widths, other[from_], None if factors is None else factors[from_], by_key, first, keys, len(counts))


@dataclass
class Block:
    """Rows of one fold: each count is 1 and, where it is another number, what it has more, by row and by feature."""
    fold: int
    labels: np.ndarray
    weights: np.ndarray
    by_row: list[Layout]
    by_feature: list[Layout]

    def margins(self, dense: np.ndarray) -> np.ndarray:
        return sum(x.sums(dense) for x in self.by_row)

    def by_features(self, dense: np.ndarray) -> np.ndarray:
        return sum(x.sums(dense) for x in self.by_feature)


    def seen(self) -> Seen:
        """A count c is 1 and c - 1 more; its square 1 and (c - 1)(c + 1) more."""
        every, more = self.by_feature[0], [replace(x, factors=(f := x.factors.astype(float)) * (f + 2)) for x in self.by_feature[1:]]
        weights = self.weights[:, None]
        squares = sum((x.sums(weights) for x in more), every.sums(weights))
        return Seen(len(self.labels), float(self.weights.sum()), float((self.weights ** 2).sum()), np.bincount(self.labels, self.weights),
                    np.hstack([every.sums(np.ones_like(weights)), self.by_features(weights), squares]).T)


def block(fold: int, rows: list[tuple], features: int) -> Block:
    """A block of pieces (entries of each row, features, counts, labels, weights)."""
    sizes, index, value, labels, weights = (np.concatenate(x) for x in zip(*rows, strict=True))
    row = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    if not value.all():
        row, index, value = row[value != 0], index[value != 0], value[value != 0]
    by_row, by_feature = [], []
    for own in (slice(None), value != 1):
        r, f, more = row[own], index[own], value[own] - 1
        if by_row and not len(more):
            break
        more = next((x for x in map(more.astype, (np.uint8, np.float32)) if (x == more).all()), more) if by_row else more
        order = np.argsort(f, kind="stable")
        factors = (more, more[order]) if by_row else (None, None)
        by_row.append(layout(np.bincount(r, minlength=len(sizes)), f, factors[0]))
        by_feature.append(layout(np.bincount(f, minlength=features), r[order], factors[1]))
    return Block(fold, labels, weights, by_row, by_feature)


def blocks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[pa.RecordBatch]:
    """Pickled blocks of the rows (vector, sentiment, classWeight, fold) of a task, each of one fold."""
    waiting: dict[int, list] = {}
    small = np.min_scalar_type(features - 1)

    def ready(fold: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(block(fold, waiting.pop(fold), features), 5)], pa.binary())})

    for batch in batches:
        kind, _, index, value = batch.column(0).flatten()
        if batch.column(0).null_count or kind.null_count or np.any(kind.to_numpy() != 0):
            raise ValueError("term counts must be sparse vectors")
        begins = index.offsets.to_numpy().astype(np.int64)
        index, value = index.values.to_numpy().astype(small), value.values.to_numpy()
        labels, weights, folds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        for fold in np.unique(folds).tolist():
            of = np.flatnonzero(folds == fold)
            ends = np.cumsum(begins[of + 1] - begins[of])
            while len(of):
                held = waiting.setdefault(fold, [])
                room, space = BLOCK_ROWS - sum(len(x[0]) for x in held), BLOCK_ENTRIES - sum(len(x[1]) for x in held)
                n = max(1, min(room, int(np.searchsorted(ends, space, side="right"))))
                some, of = of[:n], of[n:]
                sizes = begins[some + 1] - begins[some]
                entries = np.repeat(begins[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                held.append((sizes, index[entries], value[entries], labels[some], weights[some]))
                ends = ends[n:] - ends[n - 1]
                if len(of) or n == room:
                    yield ready(fold)
    for fold in list(waiting):
        yield ready(fold)


# ---------------------------------------------------------------- what a fit needs
@dataclass
class Seen:
    """Sums over the rows of a fold (or several): rows, weights, their squares, weights by label; by feature the rows that have it,
    weighted counts and weighted squares of counts."""
    rows: int
    weights: float
    squares: float
    labels: np.ndarray
    features: np.ndarray

    def __add__(self, more: Seen) -> Seen:
        labels = np.zeros(max(len(self.labels), len(more.labels)))
        labels[:len(self.labels)] += self.labels
        labels[:len(more.labels)] += more.labels
        return Seen(self.rows + more.rows, self.weights + more.weights, self.squares + more.squares, labels,
                    self.features + more.features)


@dataclass
class Task:
    """A fit: trained on all rows but those of ``leave_out``; ``scale`` takes counts to standardised features."""
    leave_out: int | None
    reg: float
    scale: np.ndarray
    inverse_std: np.ndarray
    centre: np.ndarray
    weights: float
    classes: int
    start: np.ndarray

    @property
    def constant(self) -> bool:
        return not len(self.start)

    def differences(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients on counts and offsets of each class but the first, less those of the first: they give the probabilities."""
        own = x.reshape(self.classes, -1)
        more = own[1:] - own[0]
        return (more[:, :-1] * self.scale).T, more[:, -1] - more[:, :-1] @ self.centre

    def objective(self, x: np.ndarray, loss: float, gradient: np.ndarray, residuals: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and gradient at ``x`` from the sums over rows."""
        own, out = x.reshape(self.classes, -1), np.zeros((self.classes, len(self.scale) + 1))
        out[1:, :-1] = gradient.T * self.scale - np.outer(residuals, self.centre)
        out[1:, -1] = residuals
        out[0] = -out[1:].sum(axis=0)
        out /= self.weights
        out[:, :-1] += self.reg * own[:, :-1]
        return loss / self.weights + 0.5 * self.reg * float((own[:, :-1] ** 2).sum()), out.ravel()

    def solution(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients on TF-IDF features and intercepts, centred as MLlib's."""
        if self.constant:  # MLlib's answer to a single label: always the last class
            intercepts = np.zeros(self.classes)
            intercepts[-1] = np.inf
            return np.zeros((self.classes, len(self.scale))), intercepts
        own = x.reshape(self.classes, -1)
        intercepts = own[:, -1] - own[:, :-1] @ self.centre
        coefficients = own[:, :-1] * self.inverse_std
        if not self.reg:
            coefficients -= coefficients.mean(axis=0)
        return coefficients, intercepts - intercepts.mean()


def idf(seen: Seen, least: int) -> np.ndarray:
    """``IDF``'s weights for the rows seen: log((rows + 1) / (rows with the feature + 1)), 0 below ``least`` rows."""
    having = seen.features[0]
    return np.where(having >= least, np.log((seen.rows + 1.0) / (having + 1.0)), 0.0)


def task(seen: Seen, idf: np.ndarray, reg: float, leave_out: int | None) -> Task:
    if not seen.rows:
        raise ValueError(f"no rows to train on without fold {leave_out}")
    _, first, second = seen.features
    mean = idf * first / seen.weights
    spread = seen.weights - seen.squares / seen.weights
    variance = np.maximum(idf * idf * (second - first * first / seen.weights) / spread, 0) if spread > 0 else np.zeros(len(idf))
    std = np.sqrt(variance)
    inverse = np.divide(1.0, std, out=np.zeros(len(std)), where=std != 0)
    classes = len(seen.labels)
    start = np.zeros((classes, len(idf) + 1))
    start[:, -1] = np.log1p(seen.labels)
    start[:, -1] -= start[:, -1].mean()
    alone = np.count_nonzero(seen.labels) == 1
    return Task(leave_out, reg, idf * inverse, inverse, mean * inverse, seen.weights, classes, np.zeros(0) if alone else start.ravel())


# ---------------------------------------------------------------- passes over the blocks
def sums_of(part: Iterator, asked: dict, features: int) -> Iterator[dict]:
    """Per fit: loss, gradient on counts and sum of the residuals, over the part's blocks that it is trained on."""
    wanted, total = {}, {}
    losses = {k: 0.0 for k in asked}
    residuals = {k: np.zeros(len(offsets)) for k, (_, _, offsets) in asked.items()}
    for b in part:
        if b.fold not in wanted:
            names = [k for k, (out, _, _) in asked.items() if out != b.fold]
            wanted[b.fold] = names, np.ascontiguousarray(np.hstack([asked[k][1] for k in names])) if names else None
        names, dense = wanted[b.fold]
        if not names:
            continue
        margins, at = b.margins(dense), 0
        each = np.arange(len(b.labels))
        for k in names:
            offsets = asked[k][2]
            z = np.zeros((len(offsets) + 1, len(each)))
            z[1:] = margins[:, at:at + len(offsets)].T + offsets[:, None]
            top = z.max(axis=0)
            e = np.exp(z - top)
            total_e = e.sum(axis=0)
            losses[k] += float(b.weights @ (np.log(total_e) + top - z[b.labels, each]))
            e /= total_e
            e[b.labels, each] -= 1
            e *= b.weights
            residuals[k] += e[1:].sum(axis=1)
            margins[:, at:at + len(offsets)] = e[1:].T
            at += len(offsets)
        got = b.by_features(margins)
        total[b.fold] = total[b.fold] + got if b.fold in total else got
    gradients = {k: np.zeros((features, len(offsets))) for k, (_, _, offsets) in asked.items()}
    for fold, got in total.items():
        at = 0
        for k in wanted[fold][0]:
            n = gradients[k].shape[1]
            gradients[k] += got[:, at:at + n]
            at += n
    yield {k: (losses[k], gradients[k], residuals[k]) for k in asked}


def added(a: dict, b: dict) -> dict:
    return {k: tuple(x + y for x, y in zip(a[k], b[k], strict=True)) if isinstance(a[k], tuple) else a[k] + b[k]
            for k in a} if a.keys() == b.keys() else a | b | {k: a[k] + b[k] for k in a.keys() & b.keys()}


def seen_in(part: Iterator) -> Iterator[dict[int, Seen]]:
    out: dict[int, Seen] = {}
    for b in part:
        own = b.seen()
        out[b.fold] = out[b.fold] + own if b.fold in out else own
    yield out


class Rows:
    """Term counts with ``fold``, ``sentiment`` and ``classWeight``, kept in blocks while the ``with`` lasts."""

    def __init__(self, counts: DataFrame, parts: int):
        rows = counts.select(F.unwrap_udt("rawFeatures").alias("counts"), F.col("sentiment").cast("int"), F.col("classWeight").cast("double"),
                             "fold").coalesce(parts)
        size = rows.select("counts.size").first()
        if size is None:
            raise ValueError("no rows to train on")
        self.features = features = size[0]
        self.context = counts.sparkSession.sparkContext
        made = rows.mapInArrow(lambda batches: blocks(batches, features), "block binary")
        self.blocks = made.rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
        self.seen: dict[int, Seen] = self._total(self.blocks.mapPartitions(seen_in))

    def __enter__(self) -> Rows:
        return self

    def __exit__(self, *_) -> None:
        self.blocks.unpersist()

    @staticmethod
    def _total(parts) -> dict:
        if parts.getNumPartitions() > MANY_PARTS:
            return parts.treeReduce(added)
        total: dict = {}
        for part in parts.collect():
            total = added(total, part) if total else part
        return total

    def seen_without(self, fold: int | None) -> Seen:
        own = [s for f, s in sorted(self.seen.items()) if f != fold]
        if not own:
            raise ValueError(f"no rows to train on without fold {fold}")
        total = own[0]
        for s in own[1:]:
            total = total + s
        return total

    def fit(self, tasks: dict, ends: list[int], tol: float) -> dict[tuple, np.ndarray]:
        """(task, end) -> its point after ``end`` steps, for every task and end (or after its last, if it ended before)."""
        points: dict[tuple, np.ndarray] = {}

        def record(name) -> Callable:
            def reached(step: int, x: np.ndarray) -> None:
                points.update({(name, end): x for end in ends if step <= end})
            return reached

        runs = {k: minimise(t.start, max(ends), tol, record(k)) for k, t in tasks.items() if not t.constant}
        points |= {(k, end): t.start for k, t in tasks.items() if t.constant for end in ends}
        asked = {k: next(run) for k, run in runs.items()}
        features = self.features
        while asked:
            at = self.context.broadcast({k: (tasks[k].leave_out, *tasks[k].differences(x)) for k, x in asked.items()})
            got = self._total(self.blocks.mapPartitions(lambda part, at=at: sums_of(part, at.value, features)))
            at.destroy()
            following = {}
            for k, x in asked.items():
                try:
                    following[k] = runs[k].send(tasks[k].objective(x, *got[k]))
                except StopIteration:
                    pass
            asked = following
        return points

    def predictions(self, models: dict, names: list) -> DataFrame:
        """``fold``, ``sentiment`` and one prediction a name, of every row by the model (fold, name): (task, point)."""
        tables = self.context.broadcast({k: (t.classes - 1, None) if t.constant else t.differences(x) for k, (t, x) in models.items()})

        def predicted(part: Iterator) -> Iterator[tuple]:
            for b in part:
                columns = []
                for name in names:
                    dense, offsets = tables.value[b.fold, name]
                    if offsets is None:
                        columns.append([float(dense)] * len(b.labels))
                    else:
                        margins = b.margins(dense) + offsets
                        columns.append(np.argmax(np.c_[np.zeros(len(margins)), margins], axis=1).astype(float).tolist())
                yield from zip([b.fold] * len(b.labels), b.labels.tolist(), *columns, strict=True)

        schema = "fold int, sentiment int, " + ", ".join(f"p{i} double" for i in range(len(names)))
        return self.blocks.mapPartitions(predicted).toDF(schema)


# ---------------------------------------------------------------- L-BFGS, step by step as Breeze's
class Failure(ArithmeticError):
    """A step that cannot be taken: the memory is dropped once, then the fit ends."""


def minimise(x: np.ndarray, most: int, tol: float, reached: Callable):
    """Yields the points at which it needs (value, gradient), which are sent to it; tells ``reached`` of every step's point."""
    value, gradient = yield x
    steps, changes, latest = [], [], [np.inf]
    first, step, failed = value, 0, False
    reached(0, x)
    while (step < most and not (len(latest) > 1 and abs(value - max(latest)) <= tol * first)
           and np.linalg.norm(gradient) > max(tol * value, 1e-8)):
        try:
            way = direction(gradient, steps, changes)
            t, new_value, _, new_gradient, new = yield from search(x, value, gradient, way, 1.0 if step else 1.0 / np.linalg.norm(way))
            if t * np.linalg.norm(gradient) < 1e-10:
                raise Failure("step too small")
        except Failure:
            if failed:
                return
            failed, steps, changes = True, [], []
            continue
        steps, changes = [new - x, *steps][:MEMORY], [new_gradient - gradient, *changes][:MEMORY]
        x, value, gradient, step, failed = new, new_value, new_gradient, step + 1, False
        latest = [*latest, value][-20:]
        reached(step, x)


def direction(gradient: np.ndarray, steps: list, changes: list) -> np.ndarray:
    way, shares = gradient.copy(), []
    scale = 1.0
    if steps:
        sy = steps[0] @ changes[0]
        if sy < 0 or np.isnan(sy):
            raise Failure("curvature")
        with np.errstate(all="ignore"):
            scale = sy / (changes[0] @ changes[0])
    with np.errstate(all="ignore"):
        for s, y in zip(steps, changes, strict=True):
            rho = s @ y
            share = (s @ way) / rho
            if np.isnan(share):
                raise Failure("memory")
            shares.append((share, rho))
            way -= share * y
        way *= scale
        for s, y, (share, rho) in zip(steps[::-1], changes[::-1], shares[::-1], strict=True):
            way += (share - (y @ way) / rho) * s
    return -way


def search(x: np.ndarray, value: float, gradient: np.ndarray, way: np.ndarray, t: float):
    """Strong Wolfe line search; gives (t, value, slope, gradient, point)."""
    slope = gradient @ way
    if slope > 0:
        raise Failure("not a descent")

    def at(t):
        new = x + way * t
        v, g = yield new
        return t, v, g @ way, g, new

    def zoom(low, high):
        for _ in range(SEARCHES):
            c = yield from at(between(high, low) if low[0] > high[0] else between(low, high))
            if c[1] > value + C1 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= C2 * abs(slope):
                    return c
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise Failure("zoom")

    low = (0.0, value, slope)
    for i in range(SEARCHES):
        c = yield from at(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + C1 * t * slope or (c[1] >= low[1] and i):
            return (yield from zoom(low, c))
        if abs(c[2]) <= C2 * abs(slope):
            return c
        if c[2] >= 0:
            return (yield from zoom(c, low))
        low = c
        t *= 1.5
    raise Failure("line search")


def between(left: tuple, right: tuple) -> float:
    """The minimum of the cubic through two points, kept off their ends."""
    (lt, lv, ls), (rt, rv, rs) = left[:3], right[:3]
    with np.errstate(all="ignore"):
        d1 = ls + rs - 3 * (lv - rv) / (lt - rt)
        d2 = np.sqrt(np.float64(d1 * d1 - ls * rs))
        t = rt - (rt - lt) * (rs + d2 - d1) / (rs - ls + 2 * d2)
    lowest, highest = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return float(lowest if t < lowest else highest if t > highest else t)
