"""Dates of partial precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The month that stands for a season.
SEASONS = {"봄": 3, "여름": 6, "가을": 9, "겨울": 12}


def lenient_date(c: Column) -> Column:
    """ISO dates and date-times, with dots or slashes for hyphens; null if there is no such date."""
    text = F.trim(c)
    plain = F.translate(F.regexp_extract(text, r"^\d{4}[-./]\d{1,2}[-./]\d{1,2}", 0), "./", "--")
    rest = F.regexp_replace(text, r"^\d{4}[-./]\d{1,2}[-./]\d{1,2}", "")
    fits = (plain != "") & ((rest == "") | rest.rlike(r"^[T ]\d{2}:\d{2}"))
    return F.when(fits, F.try_to_date(plain, "yyyy-M-d"))


def effective_year(date: Column, stated_year: Column) -> Column:
    valid = F.when(stated_year.between(1, 9999), stated_year)
    return F.coalesce(F.year(date), valid)


def effective_day(date: Column, stated_year: Column) -> Column:
    """Days since 1970, the first of January for a bare year, -1 for neither."""
    valid = F.when(stated_year.between(1, 9999), stated_year)
    return F.coalesce(F.unix_date(date), F.unix_date(F.make_date(valid, F.lit(1), F.lit(1))), F.lit(-1))


def in_range(date: Column, stated_year: Column, start: str | None, end: str | None) -> Column:
    """An exact date must lie in the range; a bare year must touch its years; neither fails."""
    exact, year = F.lit(True), F.lit(True)
    if start:
        exact, year = exact & (date >= F.lit(start).cast("date")), year & (stated_year >= int(start[:4]))
    if end:
        exact, year = exact & (date <= F.lit(end).cast("date")), year & (stated_year <= int(end[:4]))
    return F.coalesce(F.when(date.isNotNull(), exact).otherwise(year), F.lit(False))


def parse_partial(c: Column) -> Column:
    """Struct (published_at, precision, issue_label): day, season, month, year or unknown, finest first; a
    season needs its label and counts as its first month."""

    def found(pattern: str, group: int) -> Column:
        value = F.regexp_extract(c, pattern, group)
        return F.when(value != "", value)

    def day(y: Column, m: Column, d: Column) -> Column:
        # The last day that a month has bounds the day, so an impossible date stays null.
        month = F.when(m.between(1, 12), m)
        first = F.make_date(y, month, F.lit(1))
        return F.when(d.between(1, 31) & (d <= F.dayofmonth(F.last_day(first))), F.date_add(first, d - 1))

    number = lambda pattern, group: found(pattern, group).cast("int")
    korean_day = r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"
    plain_day = r"(\d{4})[-./]\s*(\d{1,2})[-./]\s*(\d{1,2})"
    korean_month = r"(\d{4})\s*년\s*(\d{1,2})\s*월"
    plain_month = r"(?:^|\D)(\d{4})[-./]\s*(\d{1,2})(?:\D|$)"
    season = r"(\d{4})\s*년\s*(봄|여름|가을|겨울)\s*(\([^)]*\))?"
    year = r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)"
    days = F.coalesce(*[day(number(p, 1), number(p, 2), number(p, 3)) for p in (korean_day, plain_day)])
    label = found(season, 2)
    season_month = F.create_map(*[F.lit(x) for pair in SEASONS.items() for x in pair])[label]
    seasons = F.make_date(number(season, 1), season_month, F.lit(1))
    months = F.coalesce(
        *[
            F.make_date(number(p, 1), F.when(number(p, 2).between(1, 12), number(p, 2)), F.lit(1))
            for p in (korean_month, plain_month)
        ]
    )
    years = F.make_date(number(year, 1), F.lit(1), F.lit(1))
    one = lambda at, precision, issue=None: F.struct(
        at.alias("published_at"),
        F.lit(precision).alias("precision"),
        (issue if issue is not None else F.lit(None).cast("string")).alias("issue_label"),
    )
    return (
        F.when(days.isNotNull(), one(days, "day"))
        .when(seasons.isNotNull(), one(seasons, "season", F.trim(found(season, 0))))
        .when(months.isNotNull(), one(months, "month"))
        .when(years.isNotNull(), one(years, "year"))
        .otherwise(one(F.lit(None).cast("date"), "unknown"))
    )
