"""Dates, numbers, maps and JSON as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of dates that are tried, in this order.
DATE_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd")


def parsed_date(text: Column) -> Column:
    """A time from ISO text, Japanese units or the forms above, in the session's zone; null for any other text.

    What stands in brackets is left out.
    """
    plain = F.trim(F.regexp_replace(text, r"[(（][^)）]*[)）]", ""))
    plain = F.regexp_replace(F.regexp_replace(plain, "年|月", "/"), "日", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "時", ":"), "分", ":"), "秒|:$", ""))
    plain = F.regexp_replace(plain, " +", " ")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(text))
    return F.coalesce(iso, *(F.try_to_timestamp(plain, F.lit(f)) for f in DATE_FORMS))


def next_time(now: Column, times: list[str]) -> Column:
    """The first of the daily times ``HHMM`` after ``now``, else the first tomorrow; times that are none do not count."""
    valid = sorted(int(t[:2]) * 60 + int(t[2:]) for t in times if len(t) == 4 and t.isdigit() and int(t[:2]) < 24 and int(t[2:]) < 60)
    if not valid:
        return F.lit(None).cast("timestamp_ntz")
    minute = F.hour(now) * 60 + F.minute(now)
    after = reduce(lambda rest, m: F.when(minute < m, m).otherwise(rest), reversed(valid), F.lit(valid[0] + 1440))
    return F.date_trunc("day", now).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), after)


def typed(text: Column) -> dict[str, Column]:
    """``boolean``, ``integer``, ``float`` and ``text`` of a setting's text; the first that fits is set, all others are null."""
    boolean = F.when(text == "true", True).when(text == "false", False)
    integer = F.when(text.rlike(r"^[-+]?\d+$"), text.try_cast("bigint"))
    real = F.when(text.rlike(r"^[-+]?\d+\.\d+$"), text.try_cast("double"))
    plain = F.when(boolean.isNull() & integer.isNull() & real.isNull() & ~text.isin("nil", "null"), F.regexp_replace(text, r"""^(["'])(.*)\1$""", "$2"))
    return {"boolean": boolean, "integer": integer, "float": real, "text": plain}


def sort_key(text: Column) -> Column:
    """The number that the text is, else one from the first eight bytes of its SHA-256 digest."""
    return F.coalesce(F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double")), F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("double"))


def backoff(base: Column, attempt: Column, limited: Column, jitter: Column) -> Column:
    """Milliseconds to wait: the base (10 s at least where the rate is limited), doubled up to five times, and some more; a minute at most."""
    first = F.when(limited, F.greatest(base, F.lit(10_000))).otherwise(base)
    return F.least(first * F.pow(F.lit(2), F.least(attempt - 1, F.lit(5))).cast("bigint") + F.least(jitter, F.lit(749)), F.lit(60_000)).cast("bigint")


def json_at(text: Column, path: str) -> Column:
    """The value at a dotted path with ``[i]``, as text; null where there is none."""
    return F.get_json_object(text, "$." + path)


def prefixed(settings: Column, prefix: str) -> Column:
    """Of a map the entries ``prefix.name``, by name; hyphens in names are underscores."""
    mine = F.map_filter(settings, lambda k, _: k.startswith(prefix + "."))
    return F.transform_keys(mine, lambda k, _: F.replace(F.substr(k, F.lit(len(prefix) + 2)), F.lit("-"), F.lit("_")))


def setting_line(line: Column) -> tuple[Column, Column]:
    """Name and value of ``name = value``; both null for blank lines, sections and comments."""
    pair = F.split(line, "=", 2)
    holds = ~line.rlike(r"^\s*(;|\[|$)") & (F.size(pair) == 2)
    return F.when(holds, F.trim(pair[0])), F.when(holds, F.trim(pair[1]))


def progress_fields(snapshot: Column) -> list[Column]:
    """Columns of ``total:done:skipped:failed:running:text``; the text may hold colons."""
    parts = F.split(snapshot, ":", 6)
    numbers = [parts[k].try_cast("bigint").alias(n) for k, n in enumerate(("total", "done", "skipped", "failed"))]
    return [*numbers, (parts[4] == "1").alias("running"), parts[5].alias("current")]
