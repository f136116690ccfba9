"""Toxicity by a subsequence string kernel SVM on Nystroem landmarks.

The kernel counts common letter triples of two strings as subsequences,
each weighed by LAMBDA to the power of the span it covers in either string, and
is normalised: ``k(s, t) = K(s, t) / sqrt(K(s, s) K(t, t))``. Gaps cost
but do not break a match, so ``id.i-ot`` and ``i d i o t`` stay close to ``idiot``.

Units are words with the symbols inside them, and runs of single letters set
apart, by however many symbols or spaces; what the inserted characters part is a unit of
its own too. Whatever stands between two letters costs one place of the span, so
``i--d--i--o--t`` is as close as ``i-d-i-o-t``. Long units are read through
overlapping windows, counted in letters. Nystroem landmarks are
units of the training sentences; a linear SVM on their map is the decision.
Sentences carry their document's label, so training alternates: fit, then take
each toxic sentence bag's strongest unit as its witness and the strongest
units of clean sentences as hard negatives.

Scoring uses that a linear decision over landmark kernels is a weight per
letter triple: f(s) = sum over triples of s of LAMBDA^span * W[triple] / sqrt(K(s, s)).
The landmarks are folded into W once, so a whole text costs a few table
look-ups per letter and no landmark is dropped.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import fold_of, require

LAMBDA = 0.7
UNIT_MAX = 14         # letters a window of a unit has at most, gaps and begin and end marks not counted
UNIT_STEP = 4         # so any 11 letters in a row lie whole in a window
SHORT_MAX = 9         # a second reading of long units with gaps: there a short insult has no marks and much beside it
SHORT_STEP = 2
LANDMARKS = 400
HARD = 500            # strongest clean units added as negatives after each round
TRAIN_DOCS = 1000     # labelled documents of each class: the bound of the training sample
ROUNDS = 6
ALPHABET = 60         # letters with a code of their own; rarer ones share one without weight
_CHUNK = 2_000_000    # code points at a time
_BLOCK = 50_000       # distinct windows decided at a time
BEGIN, END, OTHER = 1, 2, 3


@dataclass
class Model:
    """``codes``: letter -> code; ``weights``: W by triple of codes; ``link``: logistic weights of a document."""
    codes: dict[str, int]
    weights: np.ndarray
    bias: float
    link: np.ndarray

    @property
    def size(self) -> int:
        return len(self.codes) + 4


# ------------------------------------------------------------------ units

def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _lower_points(text: str) -> np.ndarray:
    return _points(text.lower())


_POINTS = 0x110000
_KINDS = np.full(_POINTS, -1, dtype=np.int8)   # filled as characters are met


def _kinds(points: np.ndarray) -> np.ndarray:
    """0 white space, 1 symbol, 2 letter or digit."""
    kinds = _KINDS[points]
    if (kinds < 0).any():
        for p in np.unique(points[kinds < 0]).tolist():
            c = chr(p)
            _KINDS[p] = 2 if c.isalnum() else 0 if c.isspace() else 1
        kinds = _KINDS[points]
    return kinds


def _ranges(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(~joined)
    return starts, np.append(starts[1:], len(joined))


def units(points: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(at, gap, starts, ends): the places of the letters, whether anything stands before a letter, units as ranges of letters.

    Words are joined over inner symbols, and single letters over symbols and spaces; where more
    than one character stands between, the parts are units beside the whole. No unit crosses ``cuts``.
    """
    kind = _kinds(points) if len(points) else np.empty(0, dtype=np.int8)
    at = np.flatnonzero(kind == 2)
    if not len(at):
        return at, at.astype(bool), at, at
    far = np.diff(at, prepend=at[0] - 1)
    gap = far > 1
    spaced = np.diff(np.cumsum(kind == 0)[at], prepend=-1) > 0
    head = gap.copy()
    head[0] = True
    single = head & np.append(head[1:], True)
    joined = ~gap | ~spaced | (single & np.append(False, single[:-1]))
    if cuts is not None:
        joined &= np.diff(np.searchsorted(cuts, at, side="right"), prepend=-1) == 0
    joined[0] = False
    starts, ends = _ranges(joined)
    near, stops = _ranges(joined & (far <= 2))
    whole = np.searchsorted(starts, near, side="right") - 1
    parts = (starts[whole] != near) | (ends[whole] != stops)
    starts, ends = np.append(starts, near[parts]), np.append(ends, stops[parts])
    order = np.lexsort((-ends, starts))
    return at, gap, starts[order], ends[order]


def unit_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the units of a text in code points."""
    at, _, starts, ends = units(points)
    return (at[starts], at[ends - 1] + 1) if len(at) else (at, at)


def _cut(starts: np.ndarray, ends: np.ndarray, longest: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = ends - starts
    n = np.where(size > longest, -(-(size - longest) // step) + 1, 1)
    owner = np.repeat(np.arange(len(starts)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    first = starts[owner] + k * step
    return first, np.minimum(first + longest, ends[owner]), owner


def windows(starts: np.ndarray, ends: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units cut into windows of letters, long ones with gaps also into short windows; the third result is the unit's number."""
    first, last, owner = _cut(starts, ends, UNIT_MAX, UNIT_STEP)
    gaps = np.append(0, np.cumsum(gap))
    twice = np.flatnonzero((ends - starts > UNIT_MAX) & (gaps[ends] > gaps[np.minimum(starts + 1, ends)]))
    short = _cut(starts[twice], ends[twice], SHORT_MAX, SHORT_STEP)
    return np.append(first, short[0]), np.append(last, short[1]), np.append(owner, twice[short[2]])


def encode(points: np.ndarray, codes: dict[str, int]) -> np.ndarray:
    """Codes of letters: OTHER for unlisted ones."""
    table = np.full(_POINTS, OTHER, dtype=np.int32)
    for letter, code in codes.items():
        table[ord(letter)] = code
    return table[points]


def matrix(codes: np.ndarray, first: np.ndarray, size: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Windows of one size as rows, with marks where they begin or end their unit (else a gap code)."""
    out = np.zeros((len(first), size + 2), dtype=codes.dtype)
    out[:, 1:-1] = codes[first[:, None] + np.arange(size)]
    out[begins, 0] = BEGIN
    out[ends, -1] = END
    return out


def places(gap: np.ndarray, first: np.ndarray, size: int) -> np.ndarray | None:
    """The place of each letter and mark of such rows, with one more place for a gap; None if no row has one."""
    inner = gap[first[:, None] + np.arange(1, size)]
    if not inner.any():
        return None
    steps = np.ones((len(first), size + 2), dtype=np.int32)
    steps[:, 2:-1] += inner
    return np.cumsum(steps, axis=1, dtype=np.int32)


def by_shape(gap: np.ndarray, first: np.ndarray, size: np.ndarray):
    """(letters, which windows) for windows of one size, those with a gap apart from those without."""
    total = np.append(0, np.cumsum(gap))
    gapped = total[first + size] > total[first + 1]
    for s in np.unique(size):
        for has in (False, True):
            at = np.flatnonzero((size == s) & (gapped == has))
            if len(at):
                yield int(s), at


# ----------------------------------------------------------------- kernel

def _triples(size: int) -> list[tuple[int, int, int]]:
    return list(combinations(range(size), 3))


def numerators(rows: np.ndarray, weights: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """sum over the letter triples of each row of LAMBDA^span * W; ``place`` if the letters do not follow each other."""
    total = np.zeros(len(rows), dtype=np.float32)
    side = weights.shape[0]
    flat = weights.ravel()
    size = rows.shape[1]
    pair = {(i, j): (rows[:, i] * side + rows[:, j]) * side for i, j in combinations(range(size - 1), 2)}
    if place is None:
        span = {(i, k): np.float32(LAMBDA ** (k - i + 1)) for i, k in combinations(range(size), 2)}
    else:
        power = (LAMBDA ** np.arange(place.max() + 2)).astype(np.float32)
        span = {(i, k): power[place[:, k] - place[:, i] + 1] for i, k in combinations(range(size), 2)}
    for i, j, k in _triples(size):
        total += span[i, k] * flat[pair[i, j] + rows[:, k]]
    return total


def self_kernel(rows: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """K(s, s) of each row by the subsequence recursion; gap codes match nothing, ``place`` as above."""
    n, size = rows.shape
    lam = LAMBDA
    # What a letter costs a triple that is open before it, with the gap in front.
    cost = np.full((size, n), lam, dtype=np.float32) if place is None else (
        (lam ** np.diff(place, axis=1, prepend=place[:, :1] - 1)).T.astype(np.float32))
    prime = np.ones((size + 1, size + 1, n), dtype=np.float32)
    for order in (1, 2):
        new = np.zeros((size + 1, size + 1, n), dtype=np.float32)
        for i in range(1, size + 1):
            run = np.zeros(n, dtype=np.float32)
            for j in range(1, size + 1):
                same = (rows[:, i - 1] == rows[:, j - 1]) & (rows[:, i - 1] != 0)
                both = lam * lam if order == 1 else cost[i - 1] * cost[j - 1]
                run = cost[j - 1] * run + both * same * prime[i - 1, j - 1]
                new[i, j] = cost[i - 1] * new[i - 1, j] + run
        prime = new
    total = np.zeros(n, dtype=np.float32)
    for i in range(1, size + 1):
        for j in range(1, size + 1):
            same = (rows[:, i - 1] == rows[:, j - 1]) & (rows[:, i - 1] != 0)
            total += cost[i - 1] * cost[j - 1] * same * prime[i - 1, j - 1]
    return total


def features(unit: tuple[int, ...]) -> dict[int, float]:
    """The unit's normalised feature map: {triple key: value}; a unit without a triple has none."""
    out: dict[int, float] = defaultdict(float)
    for i, j, k in _triples(len(unit)):
        a, b, c = unit[i], unit[j], unit[k]
        if a and b and c:
            out[(a << 20) | (b << 10) | c] += LAMBDA ** (k - i + 1)
    norm = sum(v * v for v in out.values()) ** 0.5
    return {key: v / norm for key, v in out.items()} if norm else {}


def kernel(a: list[dict[int, float]], b: list[dict[int, float]]) -> np.ndarray:
    """Normalised subsequence kernel between two lists of feature maps."""
    keys = {k: i for i, k in enumerate(sorted({k for f in b for k in f}))}
    right = np.zeros((len(keys), len(b)))
    for col, f in enumerate(b):
        for k, v in f.items():
            right[keys[k], col] = v
    out = np.zeros((len(a), len(b)))
    for row, f in enumerate(a):
        at = [keys[k] for k in f if k in keys]
        if at:
            out[row] = np.array([f[k] for k in f if k in keys]) @ right[at]
    return out


# --------------------------------------------------------------- training

def linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge, L2) by Newton steps on the examples inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])

    def loss(v):
        return 0.5 * ridge @ (v * v) + cost @ np.maximum(0, 1 - y * (x @ v)) ** 2

    now = loss(w)
    for _ in range(steps):
        inside = y * (x @ w) < 1
        part, c = x[inside], cost[inside]
        grad = ridge * w + 2 * part.T @ (c * (part @ w - y[inside]))
        move = np.linalg.solve(2 * (part * c[:, None]).T @ part + np.diag(ridge), grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
        before, now = now, loss(w)
        if before - now < 1e-6 * before:
            break
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last entry is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + reg * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(reg + 1e-9)
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


@dataclass
class Catalogue:
    """Distinct unit windows of the training texts, and where each occurs."""
    rows: list[tuple[int, np.ndarray, np.ndarray | None]]   # by shape: (first unit number, matrix, places)
    n: int
    unit: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray

    def codes_of(self, unit: int) -> tuple[int, ...]:
        """The unit's codes, with 0 for a gap."""
        for first, rows, place in self.rows:
            if first <= unit < first + len(rows):
                row = rows[unit - first]
                if place is None:
                    return tuple(row.tolist())
                out = np.zeros(place[unit - first, -1], dtype=np.int32)
                out[place[unit - first] - 1] = row
                return tuple(out.tolist())
        raise KeyError(unit)

    def decisions(self, weights: np.ndarray, bias: float) -> np.ndarray:
        out = np.full(self.n, bias)
        for first, rows, place in self.rows:
            for k in range(0, len(rows), 50_000):
                part, at = rows[k:k + 50_000], None if place is None else place[k:k + 50_000]
                top = numerators(part, weights, at)
                norm = np.sqrt(np.maximum(self_kernel(part, at), 1e-12))
                out[first + k:first + k + len(part)] += np.where(norm > 1e-5, top / norm, 0)
        return out


def catalogue(texts: list[str], codes: dict[str, int]) -> Catalogue:
    """Units of the texts; sentences end at . ! ? and at line ends."""
    joined = "\n\n".join(texts)
    cuts = np.cumsum([0] + [len(t.lower()) + 2 for t in texts])
    points = _lower_points(joined)
    letters, gap, starts, ends = units(points, cuts)
    coded = encode(points[letters], codes)
    first, last, owner = windows(starts, ends, gap)
    stop = np.cumsum(np.isin(points, np.array([ord(c) for c in ".!?\n"], dtype=np.uint32)))
    begins, finishes, size = first == starts[owner], last == ends[owner], last - first
    unit, rows, n = np.zeros(len(first), dtype=np.int64), [], 0
    for s, at in by_shape(gap, first, size):
        plain, place = matrix(coded, first[at], s, begins[at], finishes[at]), places(gap, first[at], s)
        both = plain if place is None else np.hstack([plain, place])
        found, which = np.unique(both, axis=0, return_inverse=True)
        rows.append((n, found[:, :s + 2], None if place is None else found[:, s + 2:]))
        unit[at] = n + which.ravel()
        n += len(found)
    where = letters[first]
    return Catalogue(rows, n, unit, stop[where], np.searchsorted(cuts, where, side="right") - 1)


def _spread(unit: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """In how many documents each unit occurs."""
    pairs = np.unique(doc.astype(np.int64) * n + unit)
    return np.bincount(pairs % n, minlength=n)


def train(sample: list[tuple[str, int]], prior: float, landmarks: int = LANDMARKS, rounds: int = ROUNDS,
          seed: int = 11) -> Model | None:
    """Fit on (text, toxic) pairs; ``prior`` is the toxic share of all labelled documents. None for a single class."""
    if len({y for _, y in sample}) < 2:
        return None
    rng = np.random.default_rng(seed)
    texts, toxic = [t for t, _ in sample], np.array([y for _, y in sample])
    letters = Counter(c for t in texts for c in t.lower() if c.isalnum())
    codes = {c: i + 4 for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET])}
    fit = rng.permutation(len(sample)) % 3 > 0  # the rest calibrates
    seen = catalogue(texts, codes)
    if not seen.n:
        return None
    in_bad, in_good = fit[seen.doc] & (toxic[seen.doc] == 1), fit[seen.doc] & (toxic[seen.doc] == 0)
    bad = _spread(seen.unit[in_bad], seen.doc[in_bad], seen.n)
    good = _spread(seen.unit[in_good], seen.doc[in_good], seen.n)
    odds = np.log(((bad + 0.1) / max(1, (fit & (toxic == 1)).sum())) / ((good + 0.1) / max(1, (fit & (toxic == 0)).sum())))
    # The bags: windows of toxic documents by sentence.
    order = np.flatnonzero(in_bad)[np.lexsort((seen.sentence[in_bad], seen.doc[in_bad]))]
    heads = np.flatnonzero(np.concatenate(([True], np.diff(seen.sentence[order]) != 0))) if len(order) else []
    value = np.where((bad >= 3) & (odds > 2), odds * np.sqrt(bad), -1.0)  # names the witnesses of the first round
    # Units of clean documents; those met only in toxic ones are never negatives.
    clean = np.flatnonzero(good > 0)
    negatives = dict.fromkeys(clean[np.argsort(-good[clean], kind="stable")[:500]].tolist())
    negatives |= dict.fromkeys(rng.choice(clean, min(len(clean), 2000), replace=False).tolist()) if len(clean) else {}
    maps: dict[int, dict[int, float]] = {}

    def mapped(u: int) -> dict[int, float]:
        if u not in maps:
            maps[u] = features(seen.codes_of(u))
        return maps[u]

    hard: list[int] = []
    weights, bias = None, 0.0
    for step in range(rounds):
        if not len(order):
            break
        strongest = np.maximum.reduceat(value[seen.unit[order]], heads)
        floor = np.full(len(sample), -np.inf)
        np.maximum.at(floor, seen.doc[order][heads], strongest)
        per_window = np.repeat(strongest, np.diff(np.concatenate((heads, [len(order)]))))
        mine = value[seen.unit[order]]
        chosen = (mine == per_window) & (mine > 0) & (mine >= 0.5 * floor[seen.doc[order]])
        witness = Counter(seen.unit[order][chosen].tolist())
        plus = [u for u, _ in sorted(witness.items(), key=lambda x: (-x[1], x[0]))
                if odds[u] > 1 and (bad[u] >= 2 or step) and mapped(u)][:2500]
        minus = [u for u in (*negatives, *hard) if u not in witness or odds[u] <= 1]
        minus = [u for u in dict.fromkeys(minus) if mapped(u)]
        if not plus or not minus:
            break
        half = landmarks // 2
        near = hard[-half:] or [minus[i] for i in rng.choice(len(minus), min(half, len(minus)), replace=False)]
        marks = [mapped(u) for u in dict.fromkeys(plus[:half] + near)]
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        kept = values > 1e-6 * values.max()
        whiten = vectors[:, kept] / np.sqrt(values[kept])
        x = kernel([mapped(u) for u in plus + minus], marks) @ whiten
        y = np.array([1.0] * len(plus) + [-1.0] * len(minus))
        cost = np.array([3.0 * min(10, witness[u]) for u in plus] + [30.0] * len(minus))
        w, bias = linear_svm(x, y, cost)
        side = len(codes) + 4
        weights = np.zeros((side, side, side), dtype=np.float32)
        for a, f in zip(whiten @ w, marks):
            for key, v in f.items():
                weights[key >> 20, key >> 10 & 1023, key & 1023] += a * v
        decided = seen.decisions(weights, bias)
        value = np.where(odds > 0, decided, -1.0)
        ranked = clean[np.argsort(-decided[clean], kind="stable")][:2 * HARD].tolist()
        known = set(hard)
        hard += [u for u in ranked if odds[u] <= 1 and u not in known][:HARD]
    if weights is None:
        return None
    model = Model(codes, weights, bias, np.zeros(3))
    held = ~fit if (toxic[~fit] == 1).any() and (toxic[~fit] == 0).any() else np.ones(len(sample), dtype=bool)
    y = toxic[held].astype(float)
    share = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    model.link = _logistic(evidence(model, [t for t, h in zip(texts, held) if h]), y, share)
    return model


# ---------------------------------------------------------------- scoring

def evidence(model: Model, texts: list[str]) -> np.ndarray:
    """Per text: the strongest unit's decision, and log(1 + number of units past the margin's middle)."""
    out = np.zeros((len(texts), 2))
    out[:, 0] = -1.0
    group: list[int] = []
    size = 0

    def flush():
        joined = "\n \n".join(texts[i] for i in group)
        cuts = np.cumsum([0] + [len(texts[i].lower()) + 3 for i in group])
        best, many = _decide(model, joined, cuts, len(group))
        out[group, 0] = best
        out[group, 1] = np.log1p(many)

    for i, text in enumerate(texts):
        if len(text) > _CHUNK:
            best, many = -1.0, 0.0
            for piece in slices(text.lower(), _CHUNK):
                b, m = _decide(model, piece, np.array([0, len(piece) + 1]), 1)
                best, many = max(best, b[0]), many + m[0]
            out[i] = best, np.log1p(many)
            continue
        group.append(i)
        size += len(text)
        if size >= _CHUNK:
            flush()
            group, size = [], 0
    if group:
        flush()
    return out


def slices(lowered: str, size: int):
    """A long text in parts of about ``size`` code points that end between units: a unit is always read whole."""
    at, room = 0, size
    while at < len(lowered):
        piece = lowered[at:at + room]
        if at + room < len(lowered):
            letters, _, starts, ends = units(_points(piece))
            # The last letter at which no earlier unit goes on; what follows it may go on past the end.
            free = np.flatnonzero(starts[1:] >= np.maximum.accumulate(ends)[:-1]) if len(starts) else []
            cut = int(letters[starts[free[-1] + 1]]) if len(free) else 0 if len(starts) else len(piece)
            if not cut:
                room *= 2
                continue
            piece = piece[:cut]
        yield piece
        at, room = at + len(piece), size


def distinct_rows(rows: np.ndarray, inner: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(a row number of each distinct row, the distinct row that each row is) by codes and gaps.

    Codes of six bits and gap bits fill two words, which are told apart exactly; their mix only orders them.
    """
    high, low = np.zeros(len(rows), dtype=np.uint64), np.zeros(len(rows), dtype=np.uint64)
    for j in range(rows.shape[1]):
        word = high if j < 10 else low
        np.left_shift(word, np.uint64(6), out=word)
        word |= rows[:, j].astype(np.uint64)
    for j in range(0 if inner is None else inner.shape[1]):
        np.left_shift(low, np.uint64(1), out=low)
        low |= inner[:, j].astype(np.uint64)
    mixed = high * np.uint64(0x9E3779B97F4A7C15) ^ (low * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
    if (high != high[first[which]]).any() or (low != low[first[which]]).any():
        _, first, which = np.unique(np.stack([high, low], axis=1), axis=0, return_index=True, return_inverse=True)
    return first, which.ravel()


def _decide(model: Model, text: str, cuts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    points = _lower_points(text)
    letters, gap, starts, ends = units(points, cuts)
    best, many = np.full(n, -1.0), np.zeros(n)
    if not len(starts):
        return best, many
    codes = encode(points[letters], model.codes).astype(np.int8)
    first, last, unit = windows(starts, ends, gap)
    owner = np.searchsorted(cuts, letters[first], side="right") - 1
    begins, finishes = first == starts[unit], last == ends[unit]
    for s, at in by_shape(gap, first, last - first):
        # Windows repeat: each distinct one is decided once.
        rows = matrix(codes, first[at], s, begins[at], finishes[at])
        inner = gap[first[at][:, None] + np.arange(1, s)] if s > 1 else None
        some, which = distinct_rows(rows, inner if inner is not None and inner.any() else None)
        decided = np.full(len(some), -np.inf, dtype=np.float64)
        for k in range(0, len(some), _BLOCK):
            part = some[k:k + _BLOCK]
            chosen, place = rows[part].astype(np.int32), places(gap, first[at[part]], s)
            top = numerators(chosen, model.weights, place)
            # Only units with weight towards toxic can pass: the others stay at the floor of -1.
            near = np.flatnonzero(top > 0)
            if len(near):
                norm = self_kernel(chosen[near], None if place is None else place[near])
                decided[k + near] = top[near] / np.sqrt(np.maximum(norm, 1e-12)) + model.bias
        f = decided[which]
        strong = np.flatnonzero(f > -np.inf)
        np.maximum.at(best, owner[at[strong]], f[strong])
        np.add.at(many, owner[at[strong]], f[strong] > 0)
    return best, many


def score(model: Model | None, texts: list[str]) -> np.ndarray:
    """Toxicity of whole texts, 0 to 1; 0 without a model."""
    if model is None:
        return np.zeros(len(texts))
    x = np.hstack([evidence(model, texts), np.ones((len(texts), 1))])
    return 1 / (1 + np.exp(-np.clip(x @ model.link, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                    per_class: int = TRAIN_DOCS) -> tuple[list[tuple[str, int]], float]:
    """At most ``per_class`` labelled documents of each class by hash order of the id, whole, and the toxic share of all.

    Labels of an id that repeats count as toxic if any of them is.
    """
    one = labels.select(F.col(id_col).alias("id"), "toxic").filter("toxic is not null and id is not null").groupBy("id").agg(
        F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in one.filter(F.col("toxic").isin(0, 1)).groupBy("toxic")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col("id"), F.lit("toxicity"))
    drawn = [r for y in (0, 1) for r in one.filter(F.col("toxic") == y).orderBy(order, "id").limit(per_class).collect()]
    if not drawn:
        return [], 0.0
    # At most 2 * per_class ids.
    picked = F.broadcast(docs.sparkSession.createDataFrame([(r["id"], r["toxic"]) for r in drawn],
                                                           f"id {docs.schema[id_col].dataType.simpleString()}, toxic int"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    rows = texts.join(picked, "id").select("id", "text", "toxic").dropDuplicates(["id"]).limit(2 * per_class).collect()
    rows.sort(key=lambda r: r["id"])
    return [(r["text"], r["toxic"]) for r in rows], counts.get(1, 0) / max(1, sum(counts.values()))


def score_column(model: Model | None, text: str | Column) -> Column:
    blob = pickle.dumps(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score(pickle.loads(blob), list(texts)))
    return scored(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    folds: int = 5, held: int = 0) -> DataFrame:
    """Per row: (``id_col``, held_out, score, predicted).

    Learns from ``labels`` (``id_col``, toxic) whose fold is not ``held``; the score
    sees the text alone. NULL and empty texts get the score of a text without
    evidence; with labels of one class only, every score is 0. Repeated rows are
    scored each, a NULL id is in fold 0. An empty table gives no rows.
    """
    require(docs, id_col, text_col)
    require(labels, id_col, "toxic")
    sample, prior = training_sample(docs, labels.filter(fold_of(id_col, folds) != held), id_col, text_col)
    model = train(sample, prior)
    scored = docs.select(F.col(id_col), (fold_of(id_col, folds) == held).alias("held_out"),
                         score_column(model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
