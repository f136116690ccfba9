"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import checkpoint_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of repeating
    Python work), gives the planner real sizes for its broadcast decision and
    puts a plain scan under later joins, so that AQE can split a hot key.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str | Column) -> Column:
    """The text, with NULL read as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (NULL id: 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(folds)), F.lit(0))


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``: they come back by ``select("row.*")``, whatever an operator names its own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of an undirected edge list (columns ``a``, ``b``).

    Randomised contraction: each round every node joins its neighbour with
    the smallest per-round hash (itself included), edges are rewritten to the
    chosen nodes and loops dropped. The node count falls by a constant factor
    each round in expectation, for long chains as well as for stars. ``root`` is
    some node of the component, the same for all of its nodes. State between
    rounds lives in written tables; only an edge count reaches the driver.
    NULL ends and loops are ignored; an empty edge list gives no rows.
    """
    cur = (edges.filter("a is not null and b is not null and a <> b")
           .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    cur = materialize(cur, "cc-edges")
    ends = cur.select(F.col("a").alias("node")).union(cur.select(F.col("b").alias("node"))).distinct()
    roots = ends.select("node", F.col("node").alias("root"))
    left = cur.count()
    for step in range(max_rounds):
        if not left:
            return roots
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("v"))
        pick = materialize(both.groupBy("a").agg(F.min(order("b")).alias("m"))
                           .select("a", F.least(order("a"), F.col("m"))["v"].alias("to")), "cc-pick")
        roots = materialize(
            roots.join(pick.withColumnRenamed("a", "root"), "root", "left")
            .select("node", F.coalesce("to", "root").alias("root")), "cc-roots")
        cur = (cur.join(pick.select("a", F.col("to").alias("ta")), "a")
               .join(pick.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
               .filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        cur = materialize(cur, "cc-edges")
        left = cur.count()
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")
