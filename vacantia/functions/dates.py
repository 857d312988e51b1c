"""Posting dates: ISO text, epoch milliseconds and relative phrases. All times are UTC."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.pay import number_from_text
from vacantia.functions.text import trim_ws

_COMMON = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?([+-]\d{2}:\d{2})?)?$"
_ISO = (
    r"^(\d{4})-?(\d{2})-?(\d{2})"
    r"(?:[^\d](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
    r"(?:([+-]\d{2}):?(\d{2})(?::?\d{2}(?:\.\d+)?)?)?)?$"
)


def parse_epoch_ms(c: Column, text: bool = False) -> Column:
    ms = number_from_text(c) if text else c.cast("double")
    return F.when(ms > 0, F.timestamp_micros(F.bround(ms * 1000, 0).cast("bigint")))


def parse_iso(c: Column) -> Column:
    """ISO-8601 text to a timestamp; naive input is UTC, anything unreadable is NULL."""
    text = F.replace(trim_ws(c), F.lit("Z"), F.lit("+00:00"))

    def part(group: int, default: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, _ISO, group), F.lit("")), F.lit(default))

    rebuilt = F.concat(
        part(1, ""), F.lit("-"), part(2, ""), F.lit("-"), part(3, ""), F.lit(" "),
        part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), F.lit("."),
        F.substring(part(7, "0"), 1, 6), part(8, "+00"), F.lit(":"), part(9, "00"),
    )
    # The usual forms cast as they are; only the compact and abbreviated ones are rebuilt.
    return F.when(text.rlike(_COMMON), text.try_cast("timestamp")).when(text.rlike(_ISO), rebuilt.try_cast("timestamp"))


def parse_relative_posted(c: Column, now: Column) -> Column:
    """'Posted 5 Days Ago' and its kin, relative to ``now``."""
    text = F.lower(c)
    # The phrases boards write.
    days = F.regexp_extract(text, r"(\d+)\+?\s*day", 1).try_cast("int")
    months = F.regexp_extract(text, r"(\d+)\+?\s*month", 1).try_cast("int")

    def back(n: Column) -> Column:
        return now - F.make_dt_interval(days=n)

    return (
        F.when(text.contains("today"), now)
        .when(text.contains("yesterday"), back(F.lit(1)))
        .when(days.isNotNull(), back(days))
        .when(months.isNotNull(), back(months * 30))
    )
