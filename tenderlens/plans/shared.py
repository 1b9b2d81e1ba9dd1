"""SQL and rounding that several plan modules share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
QCBS = """
sc AS (SELECT bid_id, sum(score / max_score * 100 * weight) / sum(weight) AS technical, min((score / max_score * 100 >= threshold)::INT) = 1 AS qualified FROM bid_scores JOIN criteria USING (criteria_id) GROUP BY 1),
comp AS (SELECT *, min(total_amount) OVER (PARTITION BY tender_id) / total_amount * 100 AS financial FROM bids JOIN sc USING (bid_id)),
qcbs AS (SELECT *, technical * 0.7 + financial * 0.3 AS composite FROM comp),
ranked AS (SELECT *, CASE WHEN qualified THEN row_number() OVER (PARTITION BY tender_id, qualified ORDER BY round(composite, 9) DESC, bid_id) END AS rank FROM qcbs)
"""


def exact(c: Column | str, n: int = 6) -> Column:
    """Rounded as a decimal of nine places, so that halves round up whatever the noise of binary fractions."""
    value = F.col(c) if isinstance(c, str) else c
    return F.round(value.cast("decimal(38,9)"), n).cast("double")
