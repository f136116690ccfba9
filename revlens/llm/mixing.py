"""Mixing sources to target weights: hierarchical budgets and token-prefix selection.

The levels (domain, language, source) form a tree. A token budget at the root is
shared top-down by the children's weights. A child that cannot hold its
share (tokens times ``max_epochs``) takes what it can; the rest goes to its
siblings, and only what a whole subtree cannot hold is left to the siblings of
its ancestors. Sharing is exact water filling: a child's budget is the smaller
of its capacity and level * weight.

Each leaf reads whole epochs of its documents and then the token prefix of one
more, in the order of a seeded hash of that epoch. The prefix is found without
sorting a leaf: tokens are counted per (leaf, hash bucket), buckets before the
boundary are taken whole, and only the boundary bucket is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import materialize, require, text_of, whole_row

SEED = 42
BUCKET_DIGITS = 4     # hex digits of the order hash that name a bucket: 65536 a leaf
LEVELS = ("domain", "lang", "source")
MISSING = "(none)"


def word_tokens(text: str | Column) -> Column:
    """Number of words: runs without ASCII white space (NULL text: 0)."""
    return F.regexp_count(text_of(text), F.lit(r"[^\x09-\x0D\x20]+")).cast("long")


def domain_of(source: str | Column) -> Column:
    """The source's family: its name without its number, and the number modulo 3."""
    s = F.coalesce(F.col(source) if isinstance(source, str) else source, F.lit(""))
    number = F.regexp_extract(s, r"([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit(MISSING)).otherwise(
        F.concat(F.lit("family"), (number.cast("long") % 3).cast("string")))


def water_level(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` with ``budget``: the parent's ``total`` shared by ``weight`` under each ``cap``.

    Children fill up in the order of cap / weight; before the k-th, the level
    would be (total - caps already full) / (weights still open). The first
    child whose cap stands above that level ends the search: the children
    before it are full, the rest get level * weight. With too much budget for
    all, everyone is full.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy(*parent)
    at = (children.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
          .withColumn("open", F.sum("weight").over(rest))
          .withColumn("mark", (F.col("total") - F.col("full")) / F.col("open")))
    level = F.min(F.when(F.col("mark") <= F.col("cap") / F.col("weight"), F.struct("full", "mark"))).over(everyone)
    return (at.withColumn("level", level["mark"])
            .withColumn("budget", F.when(F.col("level").isNull(), F.col("cap"))
                        .otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))))
            .drop("full", "open", "mark", "level"))


def leaf_budgets(leaves: DataFrame, levels: tuple[str, ...], weights: dict[str, dict[str, float]], budget: Column,
                 max_epochs: int) -> DataFrame:
    """(levels, tokens, budget long) from leaves (levels, tokens); ``budget`` is an expression over ``all_tokens``.

    ``weights`` maps a level to {name: weight}; unnamed children weigh 1. A weight of
    0 gives a child nothing; leaves without a token hold nothing.
    """
    def weight(level: str) -> Column:
        out = F.lit(1.0)
        for name, w in sorted(weights.get(level, {}).items()):
            out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
        return out

    used = leaves.filter("tokens > 0")
    for level in levels:
        used = used.filter(weight(level) > 0)
    held = used.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    total = used.agg(F.sum("tokens").alias("all_tokens")).select(budget.cast("double").alias("total")).scalar()
    for depth, level in enumerate(levels):
        path, parent = list(levels[:depth + 1]), list(levels[:depth])
        nodes = held.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", weight(level))
        if depth == 0:
            nodes = nodes.withColumn("total", total).withColumn("root", F.lit(0))
            parent = ["root"]
        else:
            nodes = nodes.join(above, list(levels[:depth]))  # noqa: F821
        nodes = water_level(nodes, parent, level)
        above = nodes.select(*path, F.col("budget").alias("total"))  # noqa: F841
    return used.join(above, list(levels)).select(*levels, "tokens", F.floor("total").cast("long").alias("budget"))


def order_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _bucket(hashed: Column) -> Column:
    return F.substring(hashed, 1, BUCKET_DIGITS)


def plan_epochs(docs: DataFrame, id_col: str, levels: tuple[str, ...], weights: dict[str, dict[str, float]],
                budget_share: float, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(leaves, edge documents) from ``docs`` (``id_col``, levels, tokens).

    Leaves hold the number of whole epochs, and for the next one the bucket at
    the boundary; edge documents are those of boundary buckets inside the prefix.
    Rows that repeat an id within a leaf are one unit: taken together or not at all.
    """
    units = materialize(docs.groupBy(*levels, id_col).agg(F.sum("tokens").alias("tokens")), "mix-units")
    leaves = units.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    budgets = (leaf_budgets(leaves, levels, weights, F.col("all_tokens") * F.lit(budget_share), max_epochs)
               .withColumn("epochs", F.least(F.lit(max_epochs), F.floor(F.col("budget") / F.col("tokens"))).cast("int"))
               .withColumn("rest", F.when(F.col("epochs") < max_epochs, F.col("budget") - F.col("epochs") * F.col("tokens"))
                           .otherwise(F.lit(0))))
    budgets = materialize(budgets.withColumnRenamed("tokens", "leaf_tokens"), "mix-budgets")
    hashed = (units.join(budgets, list(levels))
              .withColumn("hash", order_hash(seed, F.col("epochs"), F.col(id_col))).withColumn("bucket", _bucket("hash")))
    sums = hashed.groupBy(*levels, "bucket", "rest").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (sums.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0)))
            .filter((F.col("base") <= F.col("rest")) & (F.col("base") + F.col("sum") > F.col("rest")))
            .groupBy(*levels).agg(F.min("bucket").alias("edge"), F.min("base").alias("base")))
    leaves = materialize(budgets.join(edge, list(levels), "left"), "mix-leaves")
    inside = Window.partitionBy(*levels).orderBy("hash", id_col)
    last = (hashed.select(*levels, id_col, "tokens", "hash", "bucket")
            .join(leaves.select(*levels, "edge", "base", "rest").filter("edge is not null"), list(levels))
            .filter(F.col("bucket") == F.col("edge"))
            .withColumn("upto", F.col("base") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .filter("upto <= rest").select(*levels, id_col))
    return leaves, materialize(last, "mix-edge")


OUTPUT = ("mix_domain", "mix_epoch", "mix_tokens")


def mix(docs: DataFrame, weights: dict[str, dict[str, float]] | None = None, budget_share: float = 1.0,
        max_epochs: int = 2, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Selected rows of ``docs`` (columns ``keep``, default all) with ``mix_domain``, ``mix_epoch``, ``mix_tokens``
    (an input column of one of these names gives way; ``mix_rows`` keeps it).

    The root's budget is ``budget_share`` of all words. A row stands once for
    each epoch that takes it (``mix_epoch`` 0, 1, ...). NULL language or source
    are one named group of their level; NULL ids of a leaf are one unit; rows without a word
    hold no budget and are taken with their leaf's whole epochs and prefix like others.
    Repeated rows are kept. An empty table gives no rows. The text itself is
    not shuffled: leaves are joined by size, and only rows of a leaf's boundary bucket look
    up whether they are inside the prefix.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OUTPUT]
    rows = mix_rows(docs, weights, budget_share, max_epochs, seed, id_col, text_col, source_col, lang_col, keep)
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *OUTPUT)


def mix_rows(docs: DataFrame, weights: dict[str, dict[str, float]] | None = None, budget_share: float = 1.0,
             max_epochs: int = 2, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``mix`` with the input columns unchanged in one struct ``row``, beside the three of its own."""
    require(docs, id_col, text_col, source_col, lang_col)
    keep = docs.columns if keep is None else keep
    levels = tuple(f"mix_{x}" for x in LEVELS)
    marked = docs.select((whole_row(docs.select(*[F.col(f"`{c}`") for c in keep])) if keep else F.struct(F.lit(0).alias("none")).alias("row")),
                         F.col(id_col).alias("mix_id"),
                         domain_of(source_col).alias("mix_domain"),
                         F.coalesce(F.col(lang_col), F.lit(MISSING)).alias("mix_lang"),
                         F.coalesce(F.col(source_col), F.lit(MISSING)).alias("mix_source"),
                         word_tokens(text_col).alias("mix_tokens"))
    narrow = marked.select("mix_id", *levels, F.col("mix_tokens").alias("tokens"))
    named = {f"mix_{k}": v for k, v in (weights or {}).items()}
    leaves, last = plan_epochs(narrow, "mix_id", levels, named, budget_share, max_epochs, seed)
    plan = leaves.select(*levels, F.col("epochs").alias("mix_epochs"), F.col("edge").alias("mix_edge"),
                         F.col("rest").alias("mix_rest"))
    rows = (marked.join(plan, list(levels))
            .withColumn("mix_bucket", _bucket(order_hash(seed, F.col("mix_epochs"), F.col("mix_id")))))
    # Without a boundary bucket the rest covers no document, or (rest 0 of an empty epoch) none is wanted.
    partly = F.coalesce(F.col("mix_bucket") == F.col("mix_edge"), F.lit(False))
    whole = F.coalesce(F.col("mix_bucket") < F.col("mix_edge"), F.lit(False)) & (F.col("mix_rest") > 0)
    sure = rows.filter(~partly).withColumn("mix_more", whole.cast("int"))
    found = last.select(*levels, F.col("mix_id").alias("edge_id"), F.lit(1).alias("found"))
    same = [rows[c] == found[c] for c in levels] + [rows["mix_id"].eqNullSafe(found["edge_id"])]
    checked = rows.filter(partly)
    same = same[0] & same[1] & same[2] & same[3]
    unsure = (checked.join(found, same, "left").drop(*[found[c] for c in levels], "edge_id")
              .withColumn("mix_more", F.coalesce("found", F.lit(0))).drop("found"))
    taken = sure.unionByName(unsure).withColumn("mix_n", F.col("mix_epochs") + F.col("mix_more")).filter("mix_n > 0")
    return (taken.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1)))
            .select("row", *OUTPUT))
