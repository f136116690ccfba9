"""Quality classifier by co-training on two views of a document.

The content view sees the text alone: shares of byte classes, word lengths,
repeated words and lines, capitals. The metadata view sees the page around it:
language, source, length class, and the host, suffix and path form of the pages that
show the document. Each view has a logistic classifier. Over rounds, each
moves its most confident unlabelled documents, with the label it gives
them, into the other's training set. Both are then calibrated on
labelled documents kept apart, and the calibrated log odds are combined by a
last logistic fit, which scores every document.

The classifiers are fitted on a bounded, hash-drawn sample of labelled documents; what they
exchange is the most confident of all unlabelled documents, ranked in tasks every round.
Whole texts give the features, in tasks, once for every document.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import fold_of, materialize, require, text_of

LABELLED = 4000       # labelled documents of the sample
ROUNDS = 5
MOVED = 150           # documents a view passes on per round and class
CONFIDENT = 0.9
META_SLOTS = 128      # hashed one-hot places of the metadata view
FOLDS, HELD = 5, 0
_CLASS = np.zeros(256, dtype=np.int64)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = (0 if _c in (32, 9, 11, 12, 13) else 1 if _c == 10 else 2 if "a" <= _ch <= "z" else
                  3 if "A" <= _ch <= "Z" else 4 if "0" <= _ch <= "9" else 5 if _c >= 128 else
                  6 if _ch in ".,;:'\"-()" else 7 if _ch in "!?" else 8 if _ch in "|<>{}[]=/\\_~^`" else 9)
N_CLASS = 10
CONTENT = N_CLASS + 9
_CHUNK = 1 << 20


def content_features(texts: list[str]) -> np.ndarray:
    """(n, CONTENT) features of whole texts; an empty text has its own last feature and zeros else."""
    out = np.zeros((len(texts), CONTENT))
    for row, text in enumerate(texts):
        data = text.encode("utf-8")
        if not data.strip():
            out[row, -1] = 1.0
            continue
        counts = np.zeros(N_CLASS)
        for k in range(0, len(data), _CHUNK):
            counts += np.bincount(_CLASS[np.frombuffer(data[k:k + _CHUNK], dtype=np.uint8)], minlength=N_CLASS)
        words = data.split()
        lines = data.split(b"\n")
        n = len(words)
        # Distinct words follow a power of the length; the ratio is taken on a scale that does not.
        distinct = np.log(len(set(words)) + 1) / np.log(n + 1.5)
        body = [line for line in lines if line]
        letters = counts[2] + counts[3] + 1
        out[row, :N_CLASS] = np.sqrt(counts / len(data))
        out[row, N_CLASS:] = (distinct, len(set(body)) / max(1, len(body)), counts[3] / letters,
                              np.log1p(len(data) / n), np.log1p(len(data) / len(lines)) / 5, np.log1p(n) / 10,
                              _share_ending(words, b".!?"), _share_ending(words, b"*%$#&|"), 0.0)
    return out


def _share_ending(words: list[bytes], marks: bytes) -> float:
    return sum(w[-1] in marks for w in words) / len(words)


def _slot(kind: str, value) -> int:
    return zlib.crc32(f"{kind}={value}".encode("utf-8")) % META_SLOTS


def meta_features(rows: list[dict]) -> np.ndarray:
    """(n, META_SLOTS) hashed one-hots of language, source, length class and page attributes."""
    out = np.zeros((len(rows), META_SLOTS))
    for k, r in enumerate(rows):
        n = r["n_chars"]
        out[k, _slot("lang", r["lang"])] = 1
        out[k, _slot("source", r["source"])] = 1
        out[k, _slot("length", None if n is None else int(np.log2(max(0, n) + 1)))] = 1
        out[k, _slot("pages", int(min(3, r["n_pages"] or 0)))] = 1
        for kind in ("domain", "suffix", "form"):
            if r[kind] is not None:
                out[k, _slot(kind, r[kind])] = 1
    return out


@dataclass
class Views:
    """Standardised logistic weights per view, Platt weights per view, and the combiner's weights."""
    content: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    meta: np.ndarray
    platt: list[np.ndarray]
    combine: np.ndarray


def _ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0,
                 steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept (not shrunk)."""
    x = _ones(x)
    weight = np.ones(len(y)) if weight is None else weight
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(reg), x.T @ (weight * (p - y)) + reg * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _standard(content: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((content - center) / scale, -8, 8)


class ArrayPool:
    """Unlabelled documents at hand: ``strongest`` gives those that a view is most confident about."""

    def __init__(self, ids: list, content: np.ndarray, meta: np.ndarray):
        self.ids, self.content, self.meta = ids, content, meta

    def strongest(self, weights, center, scale, moved: int, taken: set) -> list[tuple]:
        """(view, label, id, content, metadata) of at most ``moved`` confident documents for each view and label, none of ``taken``."""
        out = []
        free = [k for k, i in enumerate(self.ids) if i not in taken]
        if not free:
            return out
        for view, x in enumerate((_standard(self.content[free], center, scale), self.meta[free])):
            p = _squash(_ones(x) @ weights[view])
            for y, sure in ((1, p), (0, 1 - p)):
                for k in np.argsort(-sure, kind="stable")[:moved].tolist():
                    if sure[k] >= CONFIDENT:
                        out.append((view, y, self.ids[free[k]], self.content[free[k]], self.meta[free[k]]))
        return out


class TablePool:
    """All unlabelled documents of a table (id, content, ``META``; one row an id): scored and ranked in tasks.

    A task keeps its own best of each view and label before the shuffle; at most 4 * ``moved`` rows come to the driver.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def strongest(self, weights, center, scale, moved: int, taken: set) -> list[tuple]:
        blob = pickle.dumps((weights, center, scale))

        @F.pandas_udf("content double, meta double")
        def sure(content: pd.Series, meta: pd.DataFrame) -> pd.DataFrame:
            w, middle, width = pickle.loads(blob)
            if not len(content):
                return pd.DataFrame({"content": [], "meta": []})
            x = _standard(np.stack(content.to_list()), middle, width)
            return pd.DataFrame({"content": _squash(_ones(x) @ w[0]), "meta": _squash(_ones(meta_features(records(meta))) @ w[1])})

        free = self.rows
        if taken:  # at most 4 * moved a round
            kind = free.schema["id"].dataType.simpleString()
            free = free.join(F.broadcast(free.sparkSession.createDataFrame([(i,) for i in taken], f"id {kind}")), "id", "left_anti")
        both = F.array(*[F.struct(F.lit(view).alias("view"), F.lit(y).alias("y"), p.alias("p"))
                         for view, name in enumerate(("content", "meta"))
                         for y, p in ((1, F.col(f"s.{name}")), (0, 1 - F.col(f"s.{name}")))])
        best = Window.partitionBy("e.view", "e.y").orderBy(F.desc("e.p"), "id")
        found = (free.withColumn("s", sure("content", F.struct(*META))).withColumn("e", F.explode(both))
                 .filter(F.col("e.p") >= CONFIDENT).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= moved)
                 .select("e.view", "e.y", "rank", "id", "content", *META).collect())
        found.sort(key=lambda r: (r["view"], -r["y"], r["rank"]))
        return [(r["view"], r["y"], r["id"], np.array(r["content"]), m)
                for r, m in zip(found, meta_features([r.asDict() for r in found]))]


def records(meta: pd.DataFrame) -> list[dict]:
    return meta.astype("object").where(meta.notna(), None).to_dict("records")


def co_train(content: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, moved: int = MOVED,
             seed: int = 5, pool: ArrayPool | TablePool | None = None) -> Views | None:
    """Fit on rows with ``label`` 1 or 0; -1 marks an unlabelled row of the pool if no other ``pool`` is given.

    None unless both classes are labelled.
    """
    known = np.flatnonzero(label >= 0)
    if len(set(label[known].tolist())) < 2:
        return None
    if pool is None:
        rest = np.flatnonzero(label < 0)
        pool = ArrayPool(rest.tolist(), content[rest], meta[rest])
    rng = np.random.default_rng(seed)
    known = rng.permutation(known)
    fit, apart = known[: max(2, 2 * len(known) // 3)], known[max(2, 2 * len(known) // 3):]
    if len(set(label[fit].tolist())) < 2 or len(set(label[apart].tolist())) < 2:
        fit = apart = known
    center, scale = content[fit].mean(axis=0), content[fit].std(axis=0) + 1e-6
    views = (lambda c, m: _standard(c, center, scale), lambda c, m: m)
    at = np.sort(fit)
    x, y = [[view(content[at], meta[at])] for view in views], [label[at].astype(float).tolist() for _ in views]
    w: list[np.ndarray] = []

    def refit():
        w[:] = [fit_logistic(np.vstack(x[k]), np.array(y[k])) for k in (0, 1)]

    refit()
    taken: set = set()
    for _ in range(rounds):
        picked = pool.strongest(w, center, scale, moved, taken)
        if not picked:
            break
        for view, is_good, i, c, m in picked:
            # What one view is sure of teaches the other.
            x[1 - view].append(views[1 - view](c, m)[None, :])
            y[1 - view].append(float(is_good))
            taken.add(i)
        refit()
    margins = [_ones(view(content[apart], meta[apart])) @ wk for view, wk in zip(views, w)]
    truth = label[apart].astype(float)
    platt = [fit_logistic(m[:, None], truth, ridge=1e-2) for m in margins]
    calibrated = np.stack([np.clip(m, -30, 30) * a + b for m, (a, b) in zip(margins, platt)], axis=1)
    return Views(w[0], center, scale, w[1], platt, fit_logistic(calibrated, truth, ridge=1e-1))


def _calibrated(z: np.ndarray, platt: np.ndarray) -> np.ndarray:
    return np.clip(z, -30, 30) * platt[0] + platt[1]


def content_odds(views: Views, content: np.ndarray) -> np.ndarray:
    return _calibrated(_ones(_standard(content, views.center, views.scale)) @ views.content, views.platt[0])


def meta_odds(views: Views, rows: list[dict]) -> np.ndarray:
    return _calibrated(_ones(meta_features(rows)) @ views.meta, views.platt[1])


def combined(views: Views, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
    return _squash(_ones(np.stack([content, meta], axis=1)) @ views.combine)


def page_metadata(pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, domain, suffix, form): per document number in a page's path; the smallest name of each kind.

    Urls without :// or without a number belong to no document. Aggregated before any join.
    """
    rest = F.when(F.col("url").contains("://"), F.substr("url", F.length(F.substring_index("url", "://", 1)) + 4))
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    number = F.regexp_extract(path, r"([0-9]{1,18})", 1)
    return (pages.select(F.when(number != "", number.cast("long")).alias("doc_id"),
                         F.substring_index(host, ".", -2).alias("domain"),
                         F.substring_index(host, ".", -1).alias("suffix"),
                         F.regexp_replace(path, r"[0-9]+|/[a-z]{2}/", "#").alias("form"))
            .filter("doc_id is not null").groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("n_pages"), F.min("domain").alias("domain"), F.min("suffix").alias("suffix"),
                 F.min("form").alias("form")))


META = ["lang", "source", "n_chars", "n_pages", "domain", "suffix", "form"]


def with_metadata(docs: DataFrame, pages: DataFrame | None, id_col: str) -> DataFrame:
    """``docs`` (id, ..) with the metadata columns; ids are joined, texts are not moved by it."""
    if pages is None:
        return docs.withColumns({"n_pages": F.lit(0), **{c: F.lit(None).cast("string") for c in ("domain", "suffix", "form")}})
    meta = page_metadata(pages).withColumnRenamed("doc_id", "page_doc")
    return docs.join(meta, docs[id_col] == meta["page_doc"], "left").drop("page_doc")


def with_content(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang, source, n_chars, content, ``keep``) of every row, written: whole texts are read once."""
    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series(list(content_features(list(texts))))

    return materialize(docs.select(F.col(id_col).alias("id"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"),
                                   features(text_of(text_col)).alias("content"), *keep), "quality-content")


def train_views(seen: DataFrame, labels: DataFrame, pages: DataFrame | None, id_col: str, labelled: int = LABELLED) -> Views | None:
    """Co-train on at most ``labelled`` labelled documents and all unlabelled ones of ``with_content``.

    Label rows of one id: the lowest quality counts. Rows of one id are one document, the least by its features.
    """
    known = (labels.filter(F.col(id_col).isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col(id_col).alias("id"))
             .agg(F.min("quality").alias("quality")))
    usable = known.filter(fold_of("id", FOLDS) != HELD)
    some = usable.orderBy(F.xxhash64("id", F.lit("labelled")), "id").limit(labelled).collect()
    marks = {r["id"]: r["quality"] for r in some}
    if len(set(marks.values())) < 2:
        return None
    kind = seen.schema["id"].dataType.simpleString()
    wanted = F.broadcast(seen.sparkSession.createDataFrame(list(marks.items()), f"id {kind}, quality int"))  # at most ``labelled`` ids
    one = F.min(F.struct("content", "lang", "source", "n_chars")).alias("d")
    drawn = seen.join(wanted, "id").groupBy("id", "quality").agg(one).select("id", "quality", "d.*")
    rows = [r.asDict() for r in with_metadata(drawn, pages, "id").limit(labelled).collect()]
    rows.sort(key=lambda r: r["id"])
    if not rows:
        return None
    rest = seen.filter("id is not null").join(known.select("id"), "id", "left_anti").groupBy("id").agg(one).select("id", "d.*")
    pool = TablePool(materialize(with_metadata(rest, pages, "id").select("id", "content", *META), "quality-pool"))
    return co_train(np.array([r["content"] for r in rows]), meta_features(rows), np.array([r["quality"] for r in rows]), pool=pool)


def score_documents(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, train_on: DataFrame | None = None,
                    id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: (``id_col``, held_out, content_score, meta_score, score, predicted, ``keep``); 1 is good quality.

    Learns from labelled rows of ``train_on`` (default ``docs``) whose crc32 fold is not ``HELD``.
    NULL and empty texts are scored as empty; NULL metadata is a value of its own; repeated
    rows are scored each. With labels of one class or none, every score is 0.5 and
    every document is kept (predicted 1). An empty table gives no rows.
    """
    columns = (id_col, text_col, "lang", "source", "n_chars")
    require(docs, *columns)
    seen = with_content(docs, id_col, text_col, keep)
    views = train_views(seen if train_on is None else with_content(train_on, id_col, text_col), labels, pages, id_col)
    blob = pickle.dumps(views)

    @F.pandas_udf("content double, meta double, score double")
    def combine(content: pd.Series, meta: pd.DataFrame) -> pd.DataFrame:
        v = pickle.loads(blob)
        if v is None or not len(content):
            return pd.DataFrame({"content": np.zeros(len(content)), "meta": np.zeros(len(content)), "score": np.full(len(content), 0.5)})
        odds, other = content_odds(v, np.stack(content.to_list())), meta_odds(v, records(meta))
        return pd.DataFrame({"content": odds, "meta": other, "score": combined(v, odds, other)})

    scored = with_metadata(seen, pages, "id").withColumn("s", combine("content", F.struct(*META)))
    logistic = lambda c: 1 / (1 + F.exp(-F.col(c)))
    return scored.select(F.col("id").alias(id_col), (fold_of("id", FOLDS) == HELD).alias("held_out"),
                         logistic("s.content").alias("content_score"), logistic("s.meta").alias("meta_score"),
                         F.col("s.score").alias("score"), (F.col("s.score") >= 0.5).cast("int").alias("predicted"),
                         *keep)
