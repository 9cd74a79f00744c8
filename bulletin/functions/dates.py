"""Lenient dates, relative labels and day-window tests."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let
from .text import _c

# The accepted formats in order of trial (a weekday before them is cut off first), and
# Devanagari digits.  Short month names come last.
FORMATS = [
    "MMMM d, yyyy, h:mm a", "MMMM d, yyyy", "d MMMM yyyy", "d MMMM, yyyy", "yyyy-M-d H:mm:ss", "yyyy-M-d H:mm", "d-M-yyyy", "d/M/yyyy",
    "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "MMM d, yyyy", "d MMM yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX",
]
DEVANAGARI_DIGITS = "०१२३४५६७८९"


def parsed(c: str | Column) -> Column:
    """The first format that fits, after Devanagari digits and white space are made plain; else null."""
    t = F.trim(F.regexp_replace(F.translate(_c(c), DEVANAGARI_DIGITS, "0123456789"), r"\s+", " "))
    t = F.regexp_replace(t, r"^[A-Za-z]+, (?=[A-Za-z]+ \d)", "")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in FORMATS)).cast("timestamp_ntz")


def plausible(c: Column, as_of: str) -> Column:
    """From 1990 to a year after ``as_of``; else null (another calendar may be meant)."""
    return F.when((F.year(c) >= 1990) & (F.year(c) <= F.year(F.lit(as_of).cast("timestamp_ntz")) + 1), c)


def ago(c: str | Column, as_of: str) -> Column:
    """How long before ``as_of``: just now, minutes, hours, days; the date beyond a week."""
    now = F.lit(as_of).cast("timestamp_ntz")
    s = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(_c(c).cast("timestamp"))
    n = lambda k: F.floor(s / k).cast("string")
    return (
        F.when(s < 60, "just now")
        .when(s < 3600, F.concat(n(60), F.lit("m ago")))
        .when(s < 86400, F.concat(n(3600), F.lit("h ago")))
        .when(s < 7 * 86400, F.concat(n(86400), F.lit("d ago")))
        .otherwise(F.date_format(_c(c), "yyyy-MM-dd"))
    )


def in_window(day: Column, start: str | None, end: str | None) -> Column:
    """Whether a day lies in a closed window; a missing day does not."""
    test = F.lit(True)
    if start:
        test = test & (day >= F.lit(start).cast("date"))
    if end:
        test = test & (day <= F.lit(end).cast("date"))
    return F.coalesce(test & day.isNotNull(), F.lit(False))


# Names of months, the shapes of dates in a question (looked up later, so words that
# only look like a month do no harm), days of grace.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
MONTH_FIRST = r"([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(\d{4}))?"
DAY_FIRST = r"(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]{3,9})\.?(?:,?\s+(\d{4}))?"
ISO_DAY = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
DATE_TOKEN = "(?:" + "|".join(re.sub(r"\((?!\?)", "(?:", x) for x in (ISO_DAY, MONTH_FIRST, DAY_FIRST)) + ")"
#: What happened on a day may be announced so many days later, and earlier news of it reach so far back.
REPORTING_LAG = 3
LOOKBACK = 30


def _day(year: Column, month: Column, day: Column) -> Column:
    """The day, null if there is none of that name (30 February)."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def named_day(token: Column, now: Column) -> Column:
    """The day that a date in a question names; without a year the last one not over three days ahead."""
    group = lambda rx, k: F.regexp_extract(token, f"^{rx}$", k)
    iso, front = token.rlike(f"^{ISO_DAY}$"), token.rlike(f"^{MONTH_FIRST}$")
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    parts = F.when(front, F.struct(group(MONTH_FIRST, 1).alias("month"), group(MONTH_FIRST, 2).alias("day"), group(MONTH_FIRST, 3).alias("year"))).otherwise(
        F.struct(group(DAY_FIRST, 2).alias("month"), group(DAY_FIRST, 1).alias("day"), group(DAY_FIRST, 3).alias("year"))
    )

    def read(p: Column) -> Column:
        month = F.try_element_at(months, p["month"])
        this = _day(F.year(now), month, p["day"])
        ahead = this > F.to_date(now + F.expr(f"INTERVAL {REPORTING_LAG} DAYS"))
        return F.when(month.isNull(), F.lit(None).cast("date")).when(p["year"] != "", _day(p["year"], month, p["day"])).when(ahead, _day(F.year(now) - 1, month, p["day"])).otherwise(this)

    return F.when(iso, _day(group(ISO_DAY, 1), group(ISO_DAY, 2), group(ISO_DAY, 3))).otherwise(let(parts, read))


def question_window(question: str | Column, now: str | Column) -> Column:
    """(as_of, date_from, date_to): the day a question is about and the days it asks for, both ends included; nulls where it names none.

    In order of trial: between two days, since, before; yesterday and today; the last n days,
    week or month; a bare date.  A single day looks 30 days back and three ahead.  A date that
    does not exist is passed over.  Recency without a date gives no window.
    """
    q, today = F.lower(_c(question)), F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    token = lambda rx, k=1: F.regexp_extract(q, rx, k)
    none, day = F.lit(None).cast("date"), F.to_date(today)
    window = lambda a, b, c: F.struct(a.alias("as_of"), b.alias("date_from"), c.alias("date_to"))
    about = lambda d: window(d, F.date_sub(d, LOOKBACK), F.date_add(d, REPORTING_LAG))
    pair = rf"between\s+({DATE_TOKEN})\s+and\s+({DATE_TOKEN})"
    days = F.regexp_extract(q, r"\b(?:last|past|previous)\s+(\d{1,2})\s+days?\b", 1)
    said = F.array(token(pair), token(pair, 2), token(rf"(?:since|after|from)\s+({DATE_TOKEN})"), token(rf"(?:before|until|till|up to)\s+({DATE_TOKEN})"))
    read = F.transform(F.concat(said, F.regexp_extract_all(q, F.lit(DATE_TOKEN), 0)), lambda t: named_day(t, today))
    bare = lambda days: F.get(F.filter(days, lambda d, i: (i > 3) & d.isNotNull()), F.lit(0))
    named = lambda days: F.struct(days[0].alias("a"), days[1].alias("b"), days[2].alias("since"), days[3].alias("before"), bare(days).alias("bare"))
    return let(
        let(read, named),
        lambda v: F.when(v["a"].isNotNull() & v["b"].isNotNull(), window(none, F.least(v["a"], v["b"]), F.greatest(v["a"], v["b"])))
        .when(v["since"].isNotNull(), window(none, v["since"], none))
        .when(v["before"].isNotNull(), window(none, none, v["before"]))
        .when(q.rlike(r"\byesterday\b"), about(F.date_sub(day, 1)))
        .when(q.rlike(r"\btoday\b"), about(day))
        .when(days != "", window(none, F.date_sub(day, F.try_to_number(days, F.lit("99")).cast("int")), none))
        .when(q.rlike(r"\b(?:last|past|previous)\s+week\b"), window(none, F.date_sub(day, 7), none))
        .when(q.rlike(r"\b(?:last|past|previous)\s+month\b"), window(none, F.date_sub(day, 30), none))
        .when(v["bare"].isNotNull(), about(v["bare"]))
        .otherwise(window(none, none, none)),
    )
