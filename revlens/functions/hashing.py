"""Deterministic per-row pseudo-random numbers.

``unit_hash(key, seed, purpose)`` maps a key to [0, 1): the first 52 bits of
md5("purpose:seed:key"). It depends on nothing but its arguments, so sampling and
splitting give the same rows on any cluster size and after a lost
executor is recomputed. Draws for different purposes (or seeds) are
independent: which split a row is in says nothing about its fold, or about whether it
survives undersampling. Built-in functions only; plain SQL reproduces it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13
UNIT = float(16 ** HEX_DIGITS)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unit_hash(key, seed: int = 42, purpose: str = "split") -> Column:
    """A number in [0, 1) per key; NULL keys share the draw of the empty key."""
    text = F.concat(F.lit(f"{purpose}:{seed}:"), F.coalesce(_c(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("long").cast("double") / F.lit(UNIT)


def unit_hash_sql(key: str, seed: int = 42, purpose: str = "split") -> str:
    """The same function as SQL text (used by the oracle queries)."""
    text = f"'{purpose}:{seed}:' || coalesce(cast({key} as varchar), '')"
    return f"(cast(cast('0x' || substr(md5({text}), 1, {HEX_DIGITS}) as bigint) as double) / {UNIT})"
