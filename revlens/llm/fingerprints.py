"""One-permutation MinHash fingerprints with optimal densification and packed low bits.

Every shingle of a text is hashed once. The hash's top bits name one of
``bins`` bins, each bin keeps its smallest hash. An empty bin copies the bin that a
fixed universal hash sequence of (bin, attempt) reaches first (optimal
densification), so that two texts fill it from the same place. Only the
``bits`` low-order bits of each bin are stored; the likeness of two
fingerprints corrects the share of equal bins for chance matches, 2^-bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import require, shuffle_width, text_of

WIDTH = 5
BINS = 256
BITS = 8
MAX_BLOCKS = 20_000
_CHUNK_BYTES = 1 << 20
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_SHINGLE_BASE = 0xDA942042E4DD58B5
_EMPTY = np.iinfo(np.uint64).max
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_ODD))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, 2 * _CHUNK_BYTES)
        _tables["up"] = _powers(_WORD_BASE, size)
        _tables["down"] = _powers(pow(_WORD_BASE, -1, 1 << 64), size)
    return _tables["up"], _tables["down"]


def shingle_hashes(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every word shingle of the texts, vectorised over bytes.

    A-Z lower-cased, words without ASCII white space, ``width`` words a
    shingle or the whole shorter sequence; no word: no shingle. A word's hash is
    mix(sum byte_hash * base^position + length); a shingle's is the mix of its
    word hashes weighed by powers of a second base, plus its word count.
    """
    data = np.frombuffer(b" ".join(texts).translate(_LOWER) + b" ", dtype=np.uint8)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    space = _SPACE[data]
    ends = np.flatnonzero(space & ~np.concatenate(([True], space[:-1])))
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    up, down = _power_tables(len(data) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * up[:len(data)], dtype=np.uint64)))
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    owner = np.searchsorted(begin, starts, side="right") - 1
    counts = np.bincount(owner, minlength=len(texts))
    last = np.cumsum(counts)
    weights = _powers(_SHINGLE_BASE, width)
    padded = np.concatenate((words, np.zeros(width, dtype=np.uint64)))
    left = last[owner] - np.arange(len(words))  # words from here to the end of the text
    # A shingle starts where `width` words are left, or at the first word of a shorter text.
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    at = np.flatnonzero((left >= width) | (first & (left < width)))
    size = np.minimum(left[at], width)
    total = size.astype(np.uint64) * _U(_ODD)
    for k in range(width):
        total += np.where(k < size, padded[at + k] * weights[k], _U(0))
    return mix(total), owner[at]


def _probes(bins: int, attempt: int) -> np.ndarray:
    """The bin that each empty bin looks at in this attempt, the same for all texts."""
    own = np.arange(bins, dtype=np.uint64) * _U(_SHINGLE_BASE) + _U((attempt + 1) * _ODD & 0xFFFFFFFFFFFFFFFF)
    return (mix(own) % _U(bins)).astype(np.int64)


def densify(values: np.ndarray) -> np.ndarray:
    """Fill each empty bin (all ones) of rows that have any full one; rows without stay empty."""
    bins = values.shape[1]
    full = values != _U(_EMPTY)
    out = values.copy()
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        source = _probes(bins, attempt)[col]
        hit = full[row, source]
        out[row[hit], col[hit]] = values[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
        attempt += 1
    return out


def fingerprints(texts: list[str], width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    """Packed fingerprints, ``bins * bits / 8`` bytes each; a text without a word has the empty one."""
    if bins & (bins - 1) or not 1 <= bits <= 16 or bins * bits % 8:
        raise ValueError("bins must be a power of two, bits 1 to 16, and bins * bits whole bytes")
    raw = [t.encode("utf-8") for t in texts]
    out: list[bytes] = []
    group: list[bytes] = []
    size = 0
    for k, text in enumerate(raw):
        group.append(text)
        size += len(text) + 1
        if size >= _CHUNK_BYTES or k == len(raw) - 1:
            hashes, owner = shingle_hashes(group, width)
            values = np.full(len(group) * bins, _EMPTY, dtype=np.uint64)
            np.minimum.at(values, owner * bins + (hashes >> _U(65 - bins.bit_length())).astype(np.int64), hashes)
            values = values.reshape(len(group), bins)
            some = np.bincount(owner, minlength=len(group)) > 0
            low = densify(values) & _U((1 << bits) - 1)
            if bits == 8:
                packed = low.astype(np.uint8)
            else:
                each = (low[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & _U(1)
                packed = np.packbits(each.astype(np.uint8).reshape(len(group), -1), axis=1)
            out += [packed[i].tobytes() if some[i] else b"" for i in range(len(group))]
            group, size = [], 0
    return out


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """Bias-corrected resemblance of two packed fingerprints, 0 to 1 (two empty ones: 1)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if bits == 8:
        same = np.frombuffer(a, dtype=np.uint8) == np.frombuffer(b, dtype=np.uint8)
    else:
        x = np.unpackbits(np.frombuffer(a, dtype=np.uint8)) == np.unpackbits(np.frombuffer(b, dtype=np.uint8))
        same = x.reshape(bins, bits).all(axis=1)
    chance = 2.0 ** -bits
    return float(max(0.0, (same.mean() - chance) / (1 - chance)))


@dataclass(frozen=True)
class Pairing:
    """Settings of one run, sent to the tasks."""
    width: int
    bins: int
    bits: int


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of the following text (or all it has)."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(rows: list[tuple], cfg: Pairing) -> pd.DataFrame:
    """rows: (id, text, following text) of consecutive documents."""
    edited = [edited_text(t, n) for _, t, n in rows]
    # Following texts are the next row's own texts, but for the last one.
    prints = fingerprints([t for _, t, _ in rows] + [rows[-1][2]] + edited, cfg.width, cfg.bins, cfg.bits)
    n = len(rows)
    own, changed = prints[:n + 1], prints[n + 1:]
    return pd.DataFrame({
        "id": [r[0] for r in rows],
        "n_chars": [len(r[1]) for r in rows],
        "edited_sha256": [hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited],
        "fingerprint": [p.hex() for p in own[:n]],
        "edited_fingerprint": [p.hex() for p in changed],
        "near_edited": [likeness(own[i], changed[i], cfg.bins, cfg.bits) for i in range(n)],
        "near_next": [likeness(own[i], own[i + 1], cfg.bins, cfg.bits) for i in range(n)],
    })


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, the hex of its packed fingerprint (other columns kept)."""
    @F.pandas_udf("string")
    def hexed(texts: pd.Series) -> pd.Series:
        return pd.Series([p.hex() for p in fingerprints(list(texts))])
    require(docs, id_col, text_col)
    return docs.withColumn("fingerprint", hexed(text_of(text_col)))


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                        bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and its likeness to the edited and the next one.

    The next row is the one that follows by (id, hash of the text); after the
    last comes the first, a single row follows itself. NULL ids sort first,
    NULL texts are empty, repeated rows follow one another. Ids are cut into blocks
    at approximate quantiles; a text moves once, to its block, and the rows of a
    block's first id are also sent to the block before it, so that no task needs
    another's rows. Tasks stream through their sorted rows.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    parts = shuffle_width(spark)
    blocks = min(MAX_BLOCKS, 4 * parts)
    at = [k / blocks for k in range(blocks)]
    edge = docs.agg(F.percentile_approx(F.col(id_col), at, 10 * blocks).alias("cuts"), F.min(id_col).alias("low"),
                    F.max(F.col(id_col).isNull()).alias("gap")).first()
    cuts = np.array(sorted({edge["low"], *(edge["cuts"] or [])} - {None}), dtype=np.int64)
    gap = bool(edge["gap"])

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, null: pd.Series) -> pd.Series:
        """2 * block of a row's own place, and 2 * block + 1 where it stands after the block's last row."""
        last = max(0, len(cuts) - 1)
        out = []
        own = np.searchsorted(cuts, ids.to_numpy(dtype=np.int64), side="right") - 1
        for value, none, block in zip(ids, null, own):
            block = 0 if none else int(block)
            row = [2 * block]
            if none or (not gap and block == 0 and value == cuts[0]):
                row.append(2 * last + 1)  # the first document follows the last
            elif block and value == cuts[block]:
                row.append(2 * (block - 1) + 1)
            out.append(row)
        return pd.Series(out)

    spread = (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
              .withColumn("null", F.col("id").isNull())
              .withColumn("place", F.explode(places(F.coalesce(F.col("id").cast("long"), F.lit(0)), F.col("null"))))
              .withColumn("block", F.floor(F.col("place") / 2)).withColumn("halo", F.col("place") % 2)
              .drop("place", "null"))
    dealt = (spread.repartition(parts, "block")
             .sortWithinPartitions("block", "halo", F.col("id").asc_nulls_first(), F.xxhash64("text"))
             .select("block", "halo", "id", "text"))
    cfg = Pairing(width, bins, bits)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple] = []
        size = 0
        previous = None
        for batch in batches:
            ids = batch["id"].astype("object").where(batch["id"].notna(), None)
            for block, halo, doc, text in zip(batch["block"], batch["halo"], ids, batch["text"]):
                if previous is not None and previous[0] == block and not previous[1]:
                    waiting.append((previous[2], previous[3], text))
                    size += len(previous[3])
                elif waiting:
                    yield _compare(waiting, cfg)
                    waiting, size = [], 0
                if size >= _CHUNK_BYTES // 2:
                    yield _compare(waiting, cfg)
                    waiting, size = [], 0
                previous = (block, halo, doc, text)
        if waiting:
            yield _compare(waiting, cfg)

    kind = docs.schema[id_col].dataType.simpleString()
    out = dealt.mapInPandas(stream, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                    "edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
