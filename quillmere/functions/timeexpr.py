"""Relative dates in Chinese and English requests, resolved against a given moment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: days of the week by their character.
WEEKDAYS = {"一": 0, "二": 1, "三": 2, "四": 3, "五": 4, "六": 5, "日": 6, "天": 6}


def week_start(day: Column) -> Column:
    return F.date_sub(day, F.weekday(day))


def month_edges(day: Column) -> Column:
    """First and last minute of a date's month."""
    first = F.trunc(day, "month")
    return F.struct(F.concat(F.date_format(first, "yyyy-MM-dd"), F.lit("T00:00")).alias("first"), F.concat(F.date_format(F.last_day(day), "yyyy-MM-dd"), F.lit("T23:59")).alias("last"))


def weekday_in_weeks(day: Column, weeks: int, weekday: int) -> Column:
    """The weekday (0 is Monday) so many weeks from the week of a date."""
    return F.date_add(week_start(day), 7 * weeks + weekday)


def relative_date(phrase: Column, day: Column) -> Column:
    """The date that the first date expression of a phrase means on a given day, or null."""
    of_week = F.regexp_extract(phrase, "([上下])周([一二三四五六日天])", 2)
    offset = F.create_map(*(x for k, v in WEEKDAYS.items() for x in (F.lit(k), F.lit(v))))[of_week]
    full = r"([0-9]{4}) 年 ([0-9]{1,2}) 月 ([0-9]{1,2}) 日"
    short = r"([0-9]{1,2}) 月 ([0-9]{1,2}) 日"

    def part(pattern: str, i: int) -> Column:
        return F.expr("int(null)") if i == 0 else F.regexp_extract(phrase, pattern, i).try_cast("int")

    month = part(short, 1)
    year = F.year(day) - F.when(month > F.month(day) + 6, 1).otherwise(0)

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")

    return (
        F.when(F.contains(phrase, F.lit("大后天")), F.date_add(day, 3))
        .when(F.contains(phrase, F.lit("后天")), F.date_add(day, 2))
        .when(F.contains(phrase, F.lit("明天")), F.date_add(day, 1))
        .when(F.contains(phrase, F.lit("今天")), day)
        .when(phrase.rlike("下周[一二三四五六日天]"), F.date_add(week_start(day), F.lit(7) + offset))
        .when(phrase.rlike("上周[一二三四五六日天]"), F.date_add(week_start(day), F.lit(-7) + offset))
        .when(F.contains(phrase, F.lit("本周")), day)
        .when(phrase.rlike(full), made(part(full, 1), part(full, 2), part(full, 3)))
        .when(phrase.rlike(short), made(year, part(short, 1), part(short, 2)))
    )


def resolved(now: Column, abs: Column | None = None, year: Column | None = None, month: Column | None = None, day: Column | None = None, edge: Column | None = None, weekday: Column | None = None, weeks: Column | None = None, days: Column | None = None, clock: Column | None = None) -> Column:
    """The minute (``yyyy-MM-ddTHH:mm``) that a time slot means at a moment; the forms are tried in this order.

    ``abs`` as it is; ``month`` with ``edge``: its first minute (start) or its last (end); ``month`` with ``day``; ``weekday`` (0 is Monday)
    so many ``weeks`` from this one; so many ``days`` from today.  Years are this one unless given, clocks midnight.
    What no calendar has (30 February, another edge) is null.
    """
    today = F.to_date(now)
    at = clock if clock is not None else F.lit("00:00")
    of_year = year if year is not None else F.year(today)

    def date_of(m: Column, d: Column) -> Column:
        return F.try_to_date(F.format_string("%04d-%02d-%02d", of_year.cast("int"), m.cast("int"), d.cast("int")), "yyyy-MM-dd")

    def written(d: Column, c: Column) -> Column:
        return F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T"), c)

    forms = []
    if abs is not None:
        forms.append(abs)
    if month is not None and edge is not None:
        first = date_of(month, F.lit(1))
        forms.append(F.when(edge == "start", written(first, F.lit("00:00"))).when(edge == "end", written(F.last_day(first), F.lit("23:59"))))
    elif month is not None and day is not None:
        forms.append(written(date_of(month, day), at))
    if weekday is not None:
        forms.append(written(F.date_add(week_start(today), (7 * (weeks if weeks is not None else F.lit(0)) + weekday).cast("int")), at))
    if days is not None:
        forms.append(written(F.date_add(today, days.cast("int")), at))
    return F.coalesce(*forms) if forms else F.lit(None).cast("string")


def time_codes(phrase: Column, now: Column, start: Column, end: Column) -> Column:
    """What a gold interval contradicts in the phrase that it stands for, resolved anew at the moment ``now``.

    PHRASE_UNREADABLE: the phrase names a date that can't be read.  TIME_RESOLVE_MISMATCH, WEEKDAY_MISMATCH, CLOCK_MISMATCH: the
    start is another date, another weekday, or no clock time that the phrase names.  PAST_START, REVERSED_RANGE.
    RANGE_SPANS_DAYS: the phrase means one date, the interval has two.  WINDOW_PHRASE: a morning or afternoon that the interval
    leaves.  MONTH_RANGE_MISMATCH: a whole month whose edges it doesn't have.  A missing phrase or end breaks no rule.
    """
    day, from_day, to_day = F.to_date(now), F.to_date(start), F.to_date(end)
    meant = relative_date(phrase, day)
    named = phrase.rlike("今天|明天|后天|[上下]周[一二三四五六日天]|[0-9]{1,2} 月 [0-9]{1,2} 日")
    of_week = F.create_map(*(x for k, v in WEEKDAYS.items() for x in (F.lit(k), F.lit(v))))[F.regexp_extract(phrase, "[上下]周([一二三四五六日天])", 1)]
    clocks = F.transform(F.regexp_extract_all(phrase, F.lit("([0-9]{1,2}:[0-9]{2})"), F.lit(1)), lambda c: F.lpad(c, 5, "0"))
    minute = lambda t: F.date_format(t, "HH:mm")
    whole = phrase.rlike("本月|这个月") & ~named
    edges = month_edges(day)
    written = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm")
    rules = [
        (named & meant.isNull(), "PHRASE_UNREADABLE"),
        (from_day != meant, "TIME_RESOLVE_MISMATCH"),
        (of_week != F.weekday(from_day), "WEEKDAY_MISMATCH"),
        ((F.size(clocks) > 0) & ~F.array_contains(clocks, minute(start)), "CLOCK_MISMATCH"),
        (start < now, "PAST_START"),
        (end <= start, "REVERSED_RANGE"),
        (meant.isNotNull() & (to_day != from_day), "RANGE_SPANS_DAYS"),
        (F.contains(phrase, F.lit("上午")) & ((minute(start) >= "12:00") | (minute(end) > "12:00")), "WINDOW_PHRASE"),
        (F.contains(phrase, F.lit("下午")) & ((minute(start) < "12:00") | (minute(end) < "12:00")), "WINDOW_PHRASE"),
        (whole & ((written(start) != edges["first"]) | (written(end) != edges["last"])), "MONTH_RANGE_MISMATCH"),
    ]
    return F.array_distinct(F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), code) for bad, code in rules))))
