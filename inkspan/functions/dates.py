"""Date expressions. Parsing is row by row: what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms in which sources write dates.
_FORMATS = ("MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy/MM/dd", "d MMMM yyyy", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_utc(x: Column | str) -> Column:
    """A timestamp from ISO, feed, US and long forms; a leading weekday is passed over."""
    text = F.regexp_replace(F.trim(_col(x)), r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in _FORMATS])


def coerce_date(x: Column | str) -> Column:
    """As to_utc, but plain numbers are epochs: milliseconds above 1e10, seconds above 1e7, else nothing."""
    text = F.trim(_col(x).cast("string"))
    n = text.try_cast("double")
    return F.when(n > 1e10, F.timestamp_millis(n.cast("long"))).when(n > 1e7, F.timestamp_seconds(n.cast("long"))).when(n.isNull(), to_utc(text))


def us_date(x: Column | str) -> Column:
    """MM/dd/yyyy text from the four forms in which listings give dates, else null."""
    text = F.trim(_col(x))
    forms = ("MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd")
    return F.date_format(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms]), "MM/dd/yyyy")


# Dates as they stand in running text.
_LONG_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_SHORT_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
# A date's tokens in order: a year first; a month's name first; a day before it; a month (or a day) and two more figures.
_DATE_TOKENS = (
    r"(?i)(?<![\p{L}\d])(?:"
    r"\d{4}([-/.])\d{1,2}\1\d{1,2}(?=$|\D)"
    r"|(?:19|20)\d{6}(?=$|\D)"
    rf"|(?:{_MONTHS})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?\s*,?\s+\d{{4}}(?=$|\D)"
    rf"|\d{{1,2}}(?:st|nd|rd|th)?(?:\s+of)?[\s-]+(?:the\s+)?(?:{_MONTHS})\.?,?[\s-]+\d{{4}}(?=$|\D)"
    r"|\d{1,2}([-/.])\d{1,2}\2(?:\d{4}|\d{2})(?=$|\D))"
)


def _date_of(token: Column) -> Column:
    """The date that a token spells, or null. Of two figures the first is the month, unless it can't be; years of two
    figures are of this century."""
    figures = F.regexp_extract_all(token, F.lit(r"\d+"), F.lit(0))
    at = lambda i: F.try_element_at(figures, F.lit(i))
    letters = F.lower(F.regexp_extract(F.regexp_replace(token, r"(?i)\d(st|nd|rd|th)|\b(of|the)\b", "0"), r"\p{L}{3}", 0))
    named = F.floor((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), letters) + 2) / 3)
    compact = F.length(at(1)) == 8
    first, second = at(1).try_cast("int"), at(2).try_cast("int")
    turned = first > 12
    parts = (
        F.when(letters != "", F.struct(at(2).alias("y"), named.cast("string").alias("m"), at(1).alias("d")))
        .when(compact, F.struct(F.substring(at(1), 1, 4).alias("y"), F.substring(at(1), 5, 2).alias("m"), F.substring(at(1), 7, 2).alias("d")))
        .when(F.length(at(1)) == 4, F.struct(at(1).alias("y"), at(2).alias("m"), at(3).alias("d")))
        .otherwise(F.struct(
            F.when(F.length(at(3)) == 2, F.concat(F.lit("20"), at(3))).otherwise(at(3)).alias("y"),
            F.when(turned, at(2)).otherwise(at(1)).alias("m"), F.when(turned, at(1)).otherwise(at(2)).alias("d")))
    )
    padded = F.concat_ws("-", parts["y"], F.lpad(parts["m"], 2, "0"), F.lpad(parts["d"], 2, "0"))
    return F.to_date(F.try_to_timestamp(padded, F.lit("yyyy-MM-dd")))


def dates_in(x: Column | str) -> Column:
    """All dates that a text spells, in their order of place: with the year first, by a month's name before or after
    the day (with st, of, commas, dots and hyphens), and in figures. Weekdays and times beside them don't matter; what
    is no day of the calendar is passed over. A null text has none."""
    tokens = F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(_DATE_TOKENS), F.lit(0))
    return F.filter(F.transform(tokens, _date_of), lambda d: d >= F.lit("0001-01-01").cast("date"))


def fuzzy_date(x: Column | str) -> Column:
    """yyyy-MM-dd of the first date anywhere in a text, else ''."""
    return F.coalesce(F.date_format(F.get(dates_in(x), F.lit(0)), "yyyy-MM-dd"), F.lit(""))


def year_in(x: Column | str) -> Column:
    return F.regexp_extract(_col(x), r"(20\d{2})", 1).try_cast("int")


def leading_year(x: Column | str) -> Column:
    return F.regexp_extract(_col(x), r"(\d{4})", 1).try_cast("int")


def capture_date(x: Column | str) -> Column:
    """The day of an archive's yyyyMMddHHmmss stamp."""
    return F.to_date(F.try_to_timestamp(F.substring(_col(x), 1, 8), F.lit("yyyyMMdd")))


def report_date(published: Column | str, label: Column | str) -> Column:
    """A blank date of 'Annual Report Y' is the April 1 after."""
    blank = F.nullif(F.trim(_col(published)), F.lit(""))
    year = F.regexp_extract(_col(label), r"(?i)annual report\s*(\d{4})", 1).try_cast("int")
    return F.coalesce(blank, F.concat(F.lit("April 1, "), (year + 1).cast("string")))


def page_date(x: Column | str) -> Column:
    """The first date that a page's text spells out, else the first in figures; as text, '' if none."""
    x = _col(x)
    long = F.regexp_extract(x, rf"((?:{_LONG_MONTHS})\s+\d{{1,2}},\s+\d{{4}})", 1)
    return F.coalesce(F.nullif(long, F.lit("")), F.regexp_extract(x, r"(\d{2}/\d{2}/\d{4})", 1))


def quarter_label(d: Column | str) -> Column:
    """yyyyQn; null stays null."""
    d = _col(d)
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def period_end(d: Column | str, interval: str) -> Column:
    """The last day of d's week (Sunday), month, quarter or year."""
    d = F.to_date(_col(d))
    return {
        "W": F.date_add(F.to_date(F.date_trunc("week", d)), 6),
        "M": F.last_day(d),
        "Q": F.last_day(F.add_months(F.trunc(d, "quarter"), 2)),
        "Y": F.make_date(F.year(d), F.lit(12), F.lit(31)),
    }[interval]


def period_label(end: Column | str, interval: str) -> Column:
    end = _col(end)
    return {"W": F.date_format(end, "dd MMM yy"), "M": F.date_format(end, "MMM yy"), "Q": F.concat(F.lit("Q"), F.quarter(end).cast("string"), F.lit(" "), F.year(end).cast("string")), "Y": F.year(end).cast("string")}[interval]
