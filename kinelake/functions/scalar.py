"""Scalar functions over microsecond times, labels and small arrays; all are column expressions but the parsers of user strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000

#: Units of duration strings, in seconds.
UNITS = {"s": 1, "sec": 1, "second": 1, "min": 60, "t": 60, "minute": 60, "h": 3600, "hr": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800}
#: Strftime directives and their Java patterns.
DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%z": "xx", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%%": "%"}


def div(column: str | Column, by: int) -> Column:
    """Whole division towards minus infinity."""
    c = F.col(column) if isinstance(column, str) else column
    return ((c - F.pmod(c, F.lit(by))) / by).cast("long")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp; a naive one counts as UTC where the session's zone is UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def weekday(us: str = "us") -> Column:
    """Monday 0 to Sunday 6."""
    return F.pmod(div(us, DAY) + 3, F.lit(7)).cast("int")


def hour(us: str = "us") -> Column:
    return div(F.pmod(F.col(us), F.lit(DAY)), HOUR).cast("int")


def minute(us: str = "us") -> Column:
    return div(F.pmod(F.col(us), F.lit(HOUR)), MINUTE).cast("int")


def day_text(us: str | Column) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), div(us, DAY).cast("int")), "yyyy-MM-dd")


def seconds(duration: str | float) -> float:
    """Seconds of a duration string such as '12H' or '30min', or of a number of seconds."""
    if isinstance(duration, int | float):
        return float(duration)
    found = re.findall(r"(\d+(?:\.\d+)?)\s*([A-Za-z]+)", duration)
    if not found or re.sub(r"(\d+(?:\.\d+)?)\s*([A-Za-z]+)|\s", "", duration):
        raise ValueError(f"not a duration: {duration!r}")
    total = 0.0
    for number, unit in found:
        unit = unit.lower()
        if (size := UNITS.get(unit) or UNITS.get(unit.removesuffix("s"))) is None:
            raise ValueError(f"unknown unit: {unit!r}")
        total += float(number) * size
    return total


def java_pattern(strftime: str) -> str:
    """The Java date pattern of a strftime format."""
    out, at = [], 0
    for m in re.finditer(r"%.", strftime):
        literal = strftime[at : m.start()]
        out.append(re.sub(r"[A-Za-z]+", lambda x: f"'{x[0]}'", literal))
        if m[0] not in DIRECTIVES:
            raise ValueError(f"unknown directive: {m[0]}")
        out.append(DIRECTIVES[m[0]])
        at = m.end()
    return "".join(out) + re.sub(r"[A-Za-z]+", lambda x: f"'{x[0]}'", strftime[at:])


def zoned_local(text: Column) -> Column:
    """Local wall clock (timestamp_ntz) of '2014-05-07 13:29:50.439+0100 [Europe/London]'; null where it doesn't parse."""
    instant = F.try_to_timestamp(F.regexp_extract(text, r"^(.*?)\s*\[", 1), F.lit("yyyy-MM-dd HH:mm:ss.SSSxx"))
    zone = F.regexp_extract(text, r"\[(.*?)\]", 1)
    return F.when(zone != "", F.from_utc_timestamp(F.to_utc_timestamp(instant, F.current_timezone()), zone).cast("timestamp_ntz"))


def capitalised(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def truth(text: Column) -> Column:
    """Whether a text says yes."""
    return F.lower(F.trim(text)).isin("yes", "true", "t", "y", "1")


def version_tag(text: Column) -> Column:
    """'v1-2-3' of '1.2.3' or '1.2.3+4'; another format is an error."""
    form = r"^(\d+)\.(\d+)\.(\d+)(\+\d+)?"
    return F.when(text.isNull(), None).when(F.regexp_like(text, F.lit(form)), F.concat(F.lit("v"), F.regexp_extract(text, form, 1), F.lit("-"), F.regexp_extract(text, form, 2), F.lit("-"), F.regexp_extract(text, form, 3))).otherwise(F.raise_error(F.concat(F.lit("not a version: "), text)))


def get_or(entries: Column, key: str | Column, default: float = 0.0) -> Column:
    """A map's value of a key, or the default."""
    return F.coalesce(F.try_element_at(entries, F.lit(key)), F.lit(default))


def usable(label: Column) -> Column:
    """A label, null where it is missing, blank or the text nan."""
    return F.when(~F.lower(F.trim(label)).isin("", "nan"), label)


def missing(column: str | Column) -> Column:
    """NaN as null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c)


def enmo(x: Column, y: Column, z: Column) -> Column:
    """Euclidean norm minus one, not below zero, in mg."""
    return F.greatest(F.sqrt(x * x + y * y + z * z) - 1, F.lit(0.0)) * 1000


def code_of(labels: list[str], label: Column) -> Column:
    """Place of a label in the sorted label list; an unknown label is an error."""
    place = F.array_position(F.array(*map(F.lit, sorted(labels))), label) - 1
    return F.when(label.isNull(), None).when(place >= 0, place).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)))
