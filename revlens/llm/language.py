"""Language identification with a byte convolutional network in numpy.

A text's UTF-8 bytes (A-Z lower-cased) are cut into fixed-length windows that
overlap by the widest filter less one, so that every byte n-gram lies in
one. Byte embeddings go through filters of several widths, a ReLU, a max over
the window, and a softmax over the learned languages. The network is trained
on the driver from a bounded sample of windows of labelled texts; tasks apply it
to all windows of all texts and average a text's windows by their length.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import fold_of, require

WINDOW = 256
EMBED = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
TRAIN_DOCS = 400      # documents per language: the bound of the training sample
EPOCHS = 12
UNKNOWN = "und"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LETTER = re.compile(r"[^\W\d_]")
_BATCH = 64
_CHUNK = 512  # windows at a time


@dataclass
class Network:
    """Parameters; ``filters`` holds one (width * EMBED, FILTERS) matrix per width."""
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def stacked(self) -> tuple[np.ndarray, np.ndarray]:
        """All filters as one matrix over the widest receptive field (zero beyond a filter's width)."""
        widest = max(WIDTHS)
        big = np.zeros((widest * EMBED, FILTERS * len(WIDTHS)), dtype=np.float32)
        for k, (w, m) in enumerate(zip(WIDTHS, self.filters)):
            big[:w * EMBED, k * FILTERS:(k + 1) * FILTERS] = m
        return big, np.concatenate(self.bias).astype(np.float32)

    def pooled(self, windows: np.ndarray, where: bool = False):
        """Max-pooled activations of uint8 windows (n, WINDOW); with ``where`` also the positions."""
        widest = max(WIDTHS)
        n = len(windows)
        padded = np.zeros((n, WINDOW + widest - 1), dtype=np.uint8)
        padded[:, :WINDOW] = windows
        x = self.embedding[padded]
        field = np.concatenate([x[:, j:j + WINDOW] for j in range(widest)], axis=2)
        big, bias = self.stacked()
        z = (field.reshape(n * WINDOW, -1) @ big).reshape(n, WINDOW, -1)
        top = z.max(axis=1) + bias
        if where:
            return np.maximum(top, 0), top > 0, z.argmax(axis=1), padded
        return np.maximum(top, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(windows), _CHUNK):
            out.append(_softmax(self.pooled(windows[k:k + _CHUNK]) @ self.dense + self.offset))
        return np.concatenate(out) if out else np.empty((0, len(self.languages)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """uint8 windows (n, WINDOW), zero-padded, and how many bytes each adds."""
    step = WINDOW - (max(WIDTHS) - 1)
    n = max(1, -(-max(0, len(data) - (WINDOW - step)) // step))
    flat = np.zeros((n - 1) * step + WINDOW, dtype=np.uint8)
    flat[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::step]
    size = np.full(n, step, dtype=np.float64)
    size[-1] = max(1, len(data) - (n - 1) * step)
    return view, size


def train(samples: list[tuple[bytes, str]], seed: int = 7, epochs: int = EPOCHS) -> Network | None:
    """Fit the network on (window bytes, language) pairs with Adam on the cross entropy; None without samples."""
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    n_out = FILTERS * len(WIDTHS)
    net = Network(languages, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
                  [rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
                  [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
                  rng.normal(0, n_out ** -0.5, (n_out, len(languages))).astype(np.float32),
                  np.zeros(len(languages), dtype=np.float32))
    net.embedding[0] = 0
    x = np.zeros((len(samples), WINDOW), dtype=np.uint8)
    for row, (data, _) in zip(x, samples):
        row[:min(len(data), WINDOW)] = np.frombuffer(data[:WINDOW], dtype=np.uint8)
    y = np.array([languages.index(lang) for _, lang in samples])
    params = [net.embedding, *net.filters, *net.bias, net.dense, net.offset]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for k in range(0, len(x), _BATCH):
            rows = order[k:k + _BATCH]
            for p, g, m, v in zip(params, _gradients(net, x[rows], y[rows]), first, second):
                if p is net.embedding:
                    step += 1
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)
            net.embedding[0] = 0
    return net


def _gradients(net: Network, windows: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy; the max routes each filter's to its position in the window."""
    act, alive, where, padded = net.pooled(windows, where=True)
    p = _softmax(act @ net.dense + net.offset)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    d_act = (p @ net.dense.T) * alive
    d_embed = np.zeros_like(net.embedding)
    d_filters, d_bias = [], []
    rows = np.arange(len(y))[:, None]
    for k, (w, m) in enumerate(zip(WIDTHS, net.filters)):
        part = slice(k * FILTERS, (k + 1) * FILTERS)
        delta, at = d_act[:, part], where[:, part]
        grad = np.zeros_like(m)
        for j in range(w):
            codes = padded[rows, at + j]                      # (batch, FILTERS)
            grad[j * EMBED:(j + 1) * EMBED] = np.einsum("bfe,bf->ef", net.embedding[codes], delta)
            back = delta[:, :, None] * m[j * EMBED:(j + 1) * EMBED].T[None]
            np.add.at(d_embed, codes.ravel(), back.reshape(-1, EMBED))
        d_filters.append(grad)
        d_bias.append(delta.sum(axis=0))
    return [d_embed, *d_filters, *d_bias, act.T @ p, p.sum(axis=0)]


def predict(net: Network | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, score) of whole texts: ``und`` with score 0 for NULL, no letter, or nothing learned."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if net is None:
        return langs, scores
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        p = net.probabilities(np.concatenate([v for _, v, _ in held]))
        at = 0
        sums: dict[int, np.ndarray] = {}
        weights: dict[int, float] = {}
        for row, view, weight in held:
            part = p[at:at + len(view)]
            at += len(view)
            sums[row] = sums.get(row, 0) + weight @ part
            weights[row] = weights.get(row, 0) + weight.sum()
        return sums, weights

    total: dict[int, np.ndarray] = {}
    mass: dict[int, float] = {}

    def take():
        sums, weights = flush()
        for row in sums:
            total[row] = total.get(row, 0) + sums[row]
            mass[row] = mass.get(row, 0) + weights[row]
        held.clear()

    for row, text in enumerate(texts):
        if not text or not _LETTER.search(text):
            continue
        view, weight = windows_of(text.encode("utf-8").translate(_LOWER))
        for k in range(0, len(view), _CHUNK):
            held.append((row, view[k:k + _CHUNK], weight[k:k + _CHUNK]))
            size += len(held[-1][1])
            if size >= _CHUNK:
                take()
                size = 0
    if held:
        take()
    for row, sums in total.items():
        mean = sums / mass[row]
        best = int(mean.argmax())
        langs[row], scores[row] = net.languages[best], min(1.0, float(mean[best]))
    return langs, scores


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    per_language: int = TRAIN_DOCS) -> list[tuple[bytes, str]]:
    """At most two windows of each of about ``per_language`` labelled documents of every language.

    Documents are drawn by a hash of the id below a threshold set from the
    language's count, windows by a hash of the id; the number of rows that reach
    the driver is bounded by ``per_language`` and the number of languages, not by the corpus.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = (docs.filter(F.col(lang_col).isNotNull()).groupBy(lang_col).agg(F.count(F.lit(1)).alias("n"))
              .collect())
    if not counts:
        return []
    # One row a language.
    shares = F.broadcast(docs.sparkSession.createDataFrame(
        [(r[lang_col], min(1.0, 1.3 * per_language / r["n"])) for r in counts], "lang string, share double"))
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    n_chars = F.length(text_col)
    spots = [F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.greatest(n_chars - WINDOW // 2, F.lit(1))) for k in (1, 2)]
    pieces = F.array(*[F.substr(F.col(text_col), (s + 1).cast("int"), F.lit(WINDOW)) for s in spots])
    drawn = (known.select(F.col(lang_col).alias("lang"), pieces.alias("pieces"), unit.alias("u"))
             .join(shares, "lang").filter(F.col("u") < F.col("share")).select("lang", "pieces", "u")
             .orderBy("u").limit(2 * per_language * len(counts)).collect())
    return [(p.encode("utf-8").translate(_LOWER)[:WINDOW], r["lang"]) for r in drawn for p in dict.fromkeys(r["pieces"])]


def predict_column(net: Network | None, text: str | Column) -> Column:
    """struct(lang_pred, score) of a text column."""
    blob = pickle.dumps(net)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        langs, scores = predict(pickle.loads(blob), list(texts))
        return pd.DataFrame({"lang_pred": langs, "score": scores})
    return predicted(F.col(text) if isinstance(text, str) else text)


def identify(docs: DataFrame, train_on: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """Per row: (``id_col``, held_out, lang_pred, score).

    Learns from rows of ``train_on`` (default ``docs``) with a language whose
    fold is not ``held``. NULL texts and texts without a letter are ``und`` with
    score 0, as is every text when there is nothing to learn from; repeated
    rows are judged each; a NULL id is in fold 0. No other column is read. An empty
    table gives no rows.
    """
    require(docs, id_col, text_col)
    source = docs if train_on is None else train_on
    require(source, id_col, text_col, lang_col)
    net = train(training_sample(source.filter(fold_of(id_col, folds) != held), id_col, text_col, lang_col))
    return (docs.select(F.col(id_col), (fold_of(id_col, folds) == held).alias("held_out"),
                        predict_column(net, text_col).alias("p"))
            .select(id_col, "held_out", "p.lang_pred", "p.score"))
