"""SimHash near-duplicate groups over pigeonhole blocks.

A 64-bit fingerprint per text; two fingerprints link when they differ in at
most ``max_distance`` (0 to 2) bits. With ``max_distance + 2`` blocks a close
pair agrees on at least two whole blocks, so every pair of blocks is a join
key (six keys of 32 bits for distance 2): equal keys are candidates, the
Hamming distance verifies them.

Exact copies share a fingerprint and are one node. A key that more than
``max_bucket`` distinct fingerprints share is not joined pairwise; its
fingerprints are linked exactly through shared neighbours instead: two
fingerprints differ in at most two bits exactly when some 64-bit value differs
from each in at most one bit, so grouping the 65 such values of each
fingerprint gives groups of at most 65 members, all mutually close.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import connected_components, materialize, require

BITS = 64
SEED = 42
MAX_BUCKET = 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CHUNK = 1 << 16


def simhash(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles (repeats count).

    A-Z lower-cased; words are runs without ASCII white space; shingles are
    ``width`` words joined by one space, or the whole shorter sequence. No word
    (or NULL): 0. A bit is set when set in over half of the shingles' XXH64.
    """
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    if len(words) > width:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    set_bits = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), _CHUNK):
        pairs = zip(starts[k:k + _CHUNK].tolist(), ends[k:k + _CHUNK].tolist())
        h = np.array([digest(joined[i:j], SEED) for i, j in pairs], dtype=">u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(starts)).tobytes(), "big")


def simhash_column(text: str | Column, width: int = 3) -> Column:
    """The fingerprint as a signed 64-bit column."""
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        values = np.array([simhash(t, width) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))
    return fingerprint(F.col(text) if isinstance(text, str) else text)


def hex_of(fingerprint: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def block_keys(max_distance: int) -> list[int]:
    """Signed 64-bit masks; fingerprints within the distance agree under one of them."""
    n = max_distance + 2
    cuts = [round(BITS * k / n) for k in range(n + 1)]
    blocks = [((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in range(n)]
    masks = [sum(kept) for kept in combinations(blocks, n - max_distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fingerprints: DataFrame, max_distance: int = 2, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column ``fp``) within the distance.

    Every close pair of an ordinary key is an edge. Inside an oversize key the
    edges are stars over the exact neighbour groups: they connect the same
    fingerprints without listing all pairs. No fingerprint is dropped.
    """
    if not 0 <= max_distance <= 2:
        raise ValueError("max_distance must be 0, 1 or 2")
    nodes = fingerprints.select("fp").filter("fp is not null").distinct()
    if max_distance == 0:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("a <> b")
    masks = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(m).alias("m"))
                      for i, m in enumerate(block_keys(max_distance))])
    keyed = (nodes.withColumn("x", F.explode(masks))
             .select(F.col("x.c").alias("c"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp"))
    sizes = keyed.groupBy("c", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = materialize(keyed.join(sizes, ["c", "key"]), "simhash-keys")
    usual = shared.filter(F.col("size") <= max_bucket)
    other = usual.select("c", "key", F.col("fp").alias("b"))
    pairs = (usual.select("c", "key", F.col("fp").alias("a")).join(other, ["c", "key"])
             .filter(F.col("a") < F.col("b"))
             .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance).select("a", "b"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) if k < 63 else -(1 << 63)) for k in range(BITS)])
    crowded = shared.filter(F.col("size") > max_bucket).select("fp").distinct()
    near = crowded.withColumn("flip", F.explode(flips)).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    if max_distance == 2:
        group = (near.groupBy("z").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
                 .filter(F.size("all") > 1))
        stars = group.select("a", F.explode("all").alias("b")).filter("a <> b")
    else:
        stars = near.join(crowded.select(F.col("fp").alias("z")), "z").select(
            F.col("fp").alias("a"), F.col("z").alias("b")).filter("a < b")
    return pairs.union(stars)


def fingerprint_groups(marked: DataFrame, max_distance: int = 2, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of ``marked`` (id, fp).

    ``root`` is some fingerprint of the component, the same for all of its own, and never
    NULL; ``component_id`` is the smallest id of the component, NULL if none of its rows has an id.
    """
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    roots = connected_components(links(nodes, max_distance, max_bucket))
    linked = materialize(nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "first"),
                         "simhash-linked")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(smallest, "root").select(F.col("fp").alias("node"), "root", "component_id")
    return materialize(
        nodes.join(named, nodes["fp"] == named["node"], "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id")),
        "simhash-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    max_distance: int = 2, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per input row: (``id_col``, fp, component_id).

    ``component_id`` is the smallest id reachable over links, the row's own
    included. NULL texts count as empty (fingerprint 0, linked like any
    other); repeated rows each give a row; a NULL id never names a component
    (NULL only if its whole component has no id). Other columns are not read.
    An empty table gives no rows.
    """
    require(docs, id_col, text_col)
    marked = materialize(docs.select(F.col(id_col).alias("id"), simhash_column(text_col, width).alias("fp")),
                         "simhash-docs")
    classes = fingerprint_groups(marked, max_distance, max_bucket).select("fp", "component_id")
    # Plain scans on both sides: a fingerprint held by a third of all rows is split by AQE.
    return marked.join(classes, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")
