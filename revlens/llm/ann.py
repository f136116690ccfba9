"""Nearest neighbours by largest inner product over a permutation index.

A bounded sample of vectors are the pivots. Every distinct vector is represented
by the ordered list of its nearest pivots. Index blocks hold, per pivot, an
inverted file: which vectors list the pivot, and at which place. A query
reads the files of its own pivots, sums the footrule distance of the two
lists, keeps the closest share of each block and reranks it by the exact inner
product; the blocks' best are merged.

Inner products are turned into distances by one more coordinate (sqrt(M^2 - |x|^2) for
rows, 0 for queries, M the largest norm), so that pivot order follows the
measure for vectors of any length. Equal vectors are one entry that carries its smallest ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import materialize, require

PIVOTS = 1024
LISTED = 64           # nearest pivots a vector lists
K = 20
BLOCK = 4096          # distinct vectors an index block holds, about
QUERY_BLOCK = 1024
RERANK = 0.25         # share of a block that is reranked exactly


def usable(vector: str | Column) -> Column:
    """Not NULL or empty, all components present and finite, not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest * longest - (x * x).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]])


def nearest_pivots(points: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """(n, listed) pivot numbers in order of distance, ties to the smaller number; all points have one norm."""
    listed = min(listed, len(pivots))
    out = np.empty((len(points), listed), dtype=np.int16)
    for k in range(0, len(points), 2048):
        near = -(points[k:k + 2048] @ pivots.T)
        if listed < len(pivots):
            part = np.sort(np.argpartition(near, listed - 1, axis=1)[:, :listed], axis=1)
        else:
            part = np.broadcast_to(np.arange(len(pivots)), near.shape)
        order = np.argsort(np.take_along_axis(near, part, axis=1), axis=1, kind="stable")
        out[k:k + 2048] = np.take_along_axis(part, order, axis=1)
    return out


def inverted_files(lists: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each pivot's file, row numbers, places) of a block's pivot lists."""
    n, listed = lists.shape
    flat = lists.ravel()
    order = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[order], np.arange(pivots + 1))
    return starts, order // listed, (order % listed).astype(np.int32)


def closest_by_footrule(query: np.ndarray, files, n: int, listed: int, keep: int) -> np.ndarray:
    """Rows with the ``keep`` smallest footrule distances (a pivot that is not listed stands at place ``listed``)."""
    if keep >= n:
        return np.arange(n)
    starts, rows, places = files
    # Distance is the one without any shared pivot less what each shared pivot saves.
    saved = np.zeros(n, dtype=np.int32)
    for place, pivot in enumerate(query.tolist()):
        part = slice(starts[pivot], starts[pivot + 1])
        at = places[part]
        saved[rows[part]] += (listed - place) + (listed - at) - np.abs(at - place)
    return np.argpartition(-saved, keep - 1)[:keep]


def search_block(queries: np.ndarray, q_lists: np.ndarray, vectors: np.ndarray, lists: np.ndarray, pivots: int,
                 first_ids: np.ndarray, k: int, share: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query (row numbers, scores) of its ``k`` best candidates of a block by (score, smallest id)."""
    n, listed = lists.shape
    files = inverted_files(lists, pivots)
    keep = max(k, int(np.ceil(share * n)))
    out = []
    for q, own in zip(queries, q_lists):
        at = closest_by_footrule(own, files, n, listed, keep)
        scores = vectors[at] @ q
        best = np.lexsort((first_ids[at], -scores))[:k]
        out.append((at[best], scores[best]))
    return out


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
           pivots: int = PIVOTS, listed: int = LISTED, block: int = BLOCK, query_block: int = QUERY_BLOCK,
           share: float = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which ``is_query`` holds.

    Every usable row is indexed; candidates are all rows but those with the query's own
    id. Nearest is the largest inner product in double precision, ties to the smaller
    id. Vectors that are NULL, empty, zero, or hold NULL or non-finite components take
    no part, nor do those of another length than most (ties: the longer), nor rows with a
    NULL id; repeated (id, vector) rows count once. Fewer candidates give fewer rows.
    """
    require(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    rows = (vectors.filter(F.col(id_col).isNotNull() & usable(vector_col))
            .select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                    F.coalesce(is_query, F.lit(False)).alias("asked")))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    rows = materialize(rows.filter(F.size("v") == size["d"]).groupBy("id", "v").agg(F.max("asked").alias("asked"))
                       .withColumn("key", F.sha2(F.array_join("v", ","), 256)), "ann-rows")
    # A result of k needs at most the k + 1 smallest ids of equal vectors (one may be the query's own).
    first = Window.partitionBy("key").orderBy("id")
    entries = (rows.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1).groupBy("key")
               .agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")))
    entries = materialize(entries, "ann-entries")
    stats = entries.agg(F.count(F.lit(1)).alias("n"),
                        F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).first()
    drawn = entries.orderBy(F.xxhash64("key"), "key").limit(pivots).select("v").collect()
    points = augmented(np.array([r["v"] for r in drawn]), stats["longest"])
    n_pivots, d, longest = len(points), size["d"], stats["longest"]
    blocks = max(1, -(-stats["n"] // block))

    @F.pandas_udf("binary")
    def listing(vs: pd.Series) -> pd.Series:
        x = np.stack(vs.to_list()) if len(vs) else np.empty((0, d))
        return pd.Series([a.tobytes() for a in nearest_pivots(augmented(x, longest), points, listed)])

    @F.pandas_udf("binary")
    def query_listing(vs: pd.Series) -> pd.Series:
        x = np.stack(vs.to_list()) if len(vs) else np.empty((0, d))
        scaled = x * (longest / np.sqrt((x * x).sum(axis=1)))[:, None]
        return pd.Series([a.tobytes() for a in nearest_pivots(np.hstack([scaled, np.zeros((len(x), 1))]), points, listed)])

    asked = materialize(rows.filter("asked").select(F.col("id").alias("query_id"), "key"), "ann-asked")
    distinct = asked.select("key").distinct()
    number = asked.agg(F.count_distinct("key")).first()[0]
    q_blocks = max(1, -(-number // query_block))
    index = materialize(entries.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
                        .withColumn("pivots", listing("v")), "ann-index")
    queries = materialize(entries.join(distinct, "key").select("key", "v")
                          .withColumn("q_block", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(q_blocks)))
                          .withColumn("pivots", query_listing("v")), "ann-queries")
    # Query blocks against index blocks: each pair is one group of bounded size.
    left = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "q_block", F.col("block").cast("long").alias("block"), "key", "v", "pivots")
    right = index.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).select(
        F.col("q_block").cast("long").alias("q_block"), "block", "v", "pivots", "ids")

    def pair(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = {"key": [], "ids": [], "score": []}
        if len(q) and len(x):
            lists = lambda c: np.stack([np.frombuffer(b, dtype=np.int16) for b in c])
            x = x.reset_index(drop=True)
            ids = x["ids"].to_list()
            found = search_block(np.stack(q["v"].to_list()), lists(q["pivots"]), np.stack(x["v"].to_list()),
                                 lists(x["pivots"]), n_pivots, np.array([i[0] for i in ids]), k + 1, share)
            for key, (at, scores) in zip(q["key"], found):
                out["key"] += [key] * len(at)
                out["ids"] += [ids[i] for i in at.tolist()]
                out["score"] += scores.tolist()
        return pd.DataFrame(out)

    found = (left.groupBy("q_block", "block").cogroup(right.groupBy("q_block", "block"))
             .applyInPandas(pair, "key string, ids array<long>, score double"))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    near = (found.withColumn("vec_id", F.explode("ids")).withColumn("at", F.row_number().over(best))
            .filter(F.col("at") <= k + 1).select("key", "vec_id", "score"))
    near = materialize(near.groupBy("key").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))).alias("near")), "ann-near")
    own = F.filter("near", lambda e: e["i"] != F.col("query_id"))
    return (asked.join(near, "key").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("p", "e"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.i").alias("vec_id"),
                    (-F.col("e.s")).alias("score")))
