"""Label codes and names.

Fixed values that must equal the reference: code 0 = negative,
1 = neutral, 2 = positive; a review Score below 3 is negative, 3 is
neutral, above 3 positive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names in code order.
LABELS = ["negative", "neutral", "positive"]
NEGATIVE, NEUTRAL, POSITIVE = 0, 1, 2


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def score_to_label(score="Score") -> Column:
    """1..5 star score -> 0/1/2. NULL stays NULL."""
    s = _c(score)
    return (F.when(s < 3, F.lit(NEGATIVE))
            .when(s == 3, F.lit(NEUTRAL))
            .when(s > 3, F.lit(POSITIVE))
            .cast("int"))


def label_name(code="prediction") -> Column:
    """P5: numeric code -> name; NULL or unknown codes give NULL (trap T2)."""
    c = _c(code)
    return (F.when(c == 0, F.lit("negative"))
            .when(c == 1, F.lit("neutral"))
            .when(c == 2, F.lit("positive")))


def label_code(name="sentiment_label") -> Column:
    """Name -> code; unknown names give NULL."""
    n = _c(name)
    return (F.when(n == "negative", F.lit(0))
            .when(n == "neutral", F.lit(1))
            .when(n == "positive", F.lit(2)))


def label_or_neutral(name="sentiment_label") -> Column:
    """Trend grouping key: a missing or empty label counts as neutral (T4: added, not overwritten)."""
    return F.coalesce(F.nullif(_c(name), F.lit("")), F.lit("neutral"))


def known_label(name="sentiment_label") -> Column:
    return _c(name).isin(*LABELS)
