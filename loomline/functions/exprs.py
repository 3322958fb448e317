"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp, with or without a zone."""
    return F.unix_micros(col(c).cast("timestamp"))


def hours_between(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / 3.6e9


def minutes_between(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / 6e7


def iso_utc(c: str | Column) -> Column:
    """ISO 8601 with +00:00; microseconds only where there are any."""
    whole = F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(micros(c), F.lit(1_000_000))
    return F.concat(whole, F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))), F.lit("+00:00"))


def evidence_id(*parts: str | Column) -> Column:
    """First 24 hex digits of the SHA-256 of the parts joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 24)


def sorted_list(order: list[str], value: str) -> Column:
    """The values of a group as an array, ordered by other columns."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"])


def is_in(c: str, values: tuple[str, ...]) -> Column:
    return F.col(c).isin(*values)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def sum_if(condition: Column, value: str | Column) -> Column:
    return F.sum(F.when(condition, col(value)))


def suppressed(n: str | Column, k: int) -> Column:
    return F.coalesce(col(n), F.lit(0)) < k


def floored(n: str | Column, metric: str | Column, k: int) -> Column:
    """The metric if at least k people stand behind it, else null."""
    return F.when(F.coalesce(col(n), F.lit(0)) >= k, col(metric))
