"""Dates in free text, by a small grammar over columns.

Times and names of weekdays are taken out first. Then, in this order, the first that is there decides:

1. a month's name, with the year of four digits, of two behind an apostrophe or behind the day, and the day if there is one;
2. year, month and day, or eight digits;
3. three numbers, of which the last is the year: month first, unless the first can only be a day;
4. year and month, or month and year;
5. a year of four digits: alone, after circa or a copyright sign, the first of a range, and so on.

A part that isn't there is 1. A text without a year, or whose parts are no date, is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months, by their first three letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH = r"(?<![a-z])(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])"
WEEKDAY = r"(?<![a-z])(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?(?![a-z])"
TIME = r"t?(?<!\d)\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:[ap]\.?m\.?)?\s*(?:z(?![a-z])|utc|gmt)?(?:\s*[+-]\d{2}:?\d{2})?"
#: Years of two digits lie in the hundred years before this one.
PIVOT = 2050


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once: the plan doesn't grow with the places where it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    out = F.regexp_extract(text, pattern, group)
    return F.when(out != "", out)


def _number(text: Column) -> Column:
    return text.try_cast("int")


def _year(digits: Column, pivot: int) -> Column:
    """Of four digits as they are, of two in the hundred years before the pivot."""
    short = _number(digits)
    century = pivot - pivot % 100
    return F.when(F.length(digits) == 4, short).when(short < pivot % 100, short + century).otherwise(short + century - 100)


def _date(year: Column, month: Column, day: Column) -> Column:
    def build(p: Column) -> Column:
        text = F.concat_ws("-", F.lpad(p["y"].cast("string"), 4, "0"), F.lpad(p["m"].cast("string"), 2, "0"), F.lpad(p["d"].cast("string"), 2, "0"))
        return F.when((p["y"] > 0) & p["m"].between(1, 12) & p["d"].between(1, 31), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))

    return _let(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), build)


def _named(low: Column, pivot: int) -> Column:
    """The date of a text with a month's name."""
    rest = F.regexp_replace(F.regexp_replace(low, r"['’]\d{2}(?!\d)", " "), r"(?<!\d)\d{3,}(?!\d)", " ")
    parts = F.struct(
        F.array_position(F.lit(MONTHS), F.substring(_found(low, MONTH), 1, 3)).cast("int").alias("month"),
        _found(low, r"(?<!\d)(\d{4})(?!\d)").alias("four"),
        _found(low, r"['’](\d{2})(?!\d)").alias("marked"),
        F.regexp_extract_all(rest, F.lit(r"(?<!\d)(\d{1,2})(?!\d)"), F.lit(1)).alias("short"),
    )

    def build(p: Column) -> Column:
        first, second = F.get(p["short"], F.lit(0)), F.get(p["short"], F.lit(1))
        bare = p["four"].isNull() & p["marked"].isNull()
        alone = bare & second.isNull() & ~_number(first).between(1, 31)  # Jan 99
        year = F.coalesce(_number(p["four"]), _year(p["marked"], pivot), _year(F.when(alone, first).when(bare, second), pivot))
        return _date(year, p["month"], F.coalesce(F.when(~alone | first.isNull(), _number(first)), F.lit(1)))

    return _let(parts, build)


def _numbers(low: Column, pattern: str, *groups: int) -> list[Column]:
    return [_number(_found(low, pattern, g)) for g in groups]


def fuzzy_date(text: Column, pivot: int = PIVOT) -> Column:
    """Years of two digits lie in the hundred years before the pivot."""
    dash = r"\s?[-/. ]\s?"
    ymd, three = rf"(?<!\d)(\d{{4}}){dash}(\d{{1,2}}){dash}(\d{{1,2}})(?!\d)", rf"(?<!\d)(\d{{1,2}}){dash}(\d{{1,2}}){dash}(\d{{4}}|\d{{2}})(?!\d)"
    packed, ym, my, y = r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)", r"(?<!\d)(\d{4})[-/.](\d{1,2})(?!\d)", r"(?<!\d)(\d{1,2})[-/.](\d{4})(?!\d)", r"(?<!\d)(\d{4})(?!\d)"
    one = F.lit(1)

    def read(low: Column) -> Column:
        def by_three(p: Column) -> Column:
            return _date(_year(p["c"], pivot), F.when(p["a"] > 12, p["b"]).otherwise(p["a"]), F.when(p["a"] > 12, p["a"]).otherwise(p["b"]))

        a, b = _numbers(low, three, 1, 2)
        return (
            F.when(low.rlike(MONTH), _named(low, pivot))
            .when(low.rlike(ymd), _date(*_numbers(low, ymd, 1, 2, 3)))
            .when(low.rlike(packed), _date(*_numbers(low, packed, 1, 2, 3)))
            .when(low.rlike(three), _let(F.struct(a.alias("a"), b.alias("b"), _found(low, three, 3).alias("c")), by_three))
            .when(low.rlike(ym), _date(*_numbers(low, ym, 1, 2), one))
            .when(low.rlike(my), _date(*_numbers(low, my, 2, 1), one))
            .otherwise(_date(*_numbers(low, y, 1), one, one))
        )

    return _let(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), TIME, " "), WEEKDAY, " "), read)
