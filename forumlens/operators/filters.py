"""Predicates as Columns, so that Catalyst can push them down to the scan."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from forumlens.functions.text import col


def exact(**terms: str | None) -> Column:
    """All of the given terms; None and empty ones filter nothing."""
    return reduce(and_, [F.col(k) == v for k, v in terms.items() if v], F.lit(True))


def date_range(ts: str, start: date | None = None, end: date | None = None) -> Column:
    """Inclusive on both ends, the last day whole."""
    out = F.lit(True)
    if start:
        out = out & (F.col(ts) >= F.lit(start))
    if end:
        out = out & (F.col(ts) < F.date_add(F.lit(end), 1))
    return out


def null_tolerant_range(period: str, start: Column | None = None, end: Column | None = None) -> Column:
    """Rows without a period pass."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(period) >= start)
    if end is not None:
        out = out & (F.col(period) <= end)
    return F.col(period).isNull() | out


def region_or_national(region: str, wanted: str | None, national: str = "AU") -> Column:
    return F.lit(True) if not wanted else F.col(region).isin(wanted, national)


def contains_ci(c: str | Column, part: str) -> Column:
    return F.contains(F.lower(col(c)), F.lit(part.lower()))


def any_reason(reasons: dict[str, Column]) -> tuple[Column, Column]:
    """(whether any holds, the names of those that hold, comma-joined)."""
    named = F.concat_ws(", ", *[F.when(F.coalesce(c, F.lit(False)), name) for name, c in reasons.items()])
    return reduce(or_, [F.coalesce(c, F.lit(False)) for c in reasons.values()]), named


def clamp_arg(value, low: int, high: int, default: int) -> int:
    """An argument as a whole number in the range; the default if it is none."""
    try:
        return max(low, min(high, int(value)))
    except (TypeError, ValueError):
        return default
