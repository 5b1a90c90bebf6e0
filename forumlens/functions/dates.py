"""Dates as they come from feeds and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forumlens.functions.text import col

#: Compact stamps of news feeds.
COMPACT = (("^[0-9]{14}$", "yyyyMMddHHmmss"), ("^[0-9]{8}T[0-9]{6}Z$", "yyyyMMdd'T'HHmmss'Z'"), ("^[0-9]{8}$", "yyyyMMdd"))
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def compact_timestamp(c: Column | str) -> Column:
    """A compact stamp as a timestamp without zone (feeds write UTC); null for other text."""
    s = F.trim(col(c))
    return F.coalesce(*[F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(form))).cast("timestamp_ntz") for shape, form in COMPACT])


def normalise_date(c: Column | str) -> Column:
    """ISO text: compact stamps are rewritten, ISO dates pass as they are, everything else is null."""
    s = F.trim(col(c))
    iso = F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), s)
    return F.coalesce(F.date_format(compact_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss'Z'"), iso)


def stamp_or_text(c: Column | str) -> Column:
    """A 14-digit stamp as ISO text; what is no stamp comes back as it is."""
    return F.coalesce(F.date_format(F.when(col(c).rlike(COMPACT[0][0]), F.try_to_timestamp(col(c), F.lit(COMPACT[0][1]))), "yyyy-MM-dd'T'HH:mm:ss'Z'"), col(c))


def infer_period(c: Column | str) -> Column:
    """YYYY-MM or YYYY from a file name, by the first shape that is there; else 'unknown'.

    Shapes, in order: 2024-03 or 2024_03; march 2024, march-2024, mar24; 'year 2024'; a year on its own.
    """
    s = F.lower(F.coalesce(col(c), F.lit("")))
    found = lambda shape, n=1: F.nullif(F.regexp_extract(s, shape, n), F.lit(""))
    digits = r"(?:^|[^0-9])((?:19|20)[0-9]{2})[-_](0[1-9]|1[0-2])(?:[^0-9]|$)"
    month = rf"({'|'.join(MONTHS)})[a-z]*[ _-]?((?:19|20)?[0-9]{{2}})(?:[^0-9]|$)"
    name, year = found(month, 1), found(month, 2)
    number = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("string"), 2, "0")
    whole = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.coalesce(
        F.when(found(digits).isNotNull(), F.concat_ws("-", found(digits, 1), found(digits, 2))),
        F.when(name.isNotNull(), F.concat_ws("-", whole, number)),
        found(r"year[ _-]?((?:19|20)[0-9]{2})"),
        found(r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)"),
        F.lit("unknown"),
    )


def within_days(c: Column | str, c_last: Column, days: int) -> Column:
    """From the start of the day `days` before `c_last` on."""
    return col(c) >= F.date_trunc("day", c_last) - F.make_interval(days=F.lit(days))


def hour_slot(ts: Column | str, n: int) -> Column:
    """Which of `n` turns an hour has: the last 32 bits of the MD5 of its digits, modulo n."""
    hour = F.date_format(ts, "yyyyMMddHH")
    return (F.conv(F.substring(F.md5(hour), 25, 8), 16, 10).cast("bigint") % n).cast("int")
