"""Date phrases to inclusive ranges, as column expressions over a table of rules."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docforge.functions.extract import MONTHS

#: Fixed values of the grammar.
COUNTS = {"a": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "couple of": 2, "few": 3}
_NUM = r"(\d+|a|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|couple of|few)"
_MONTH = "(" + "|".join([*MONTHS, *(m[:3] for m in MONTHS if m != "may")]) + ")"
_YEAR = r"(?: (\d{4}))?"


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(v) for pair in values.items() for v in pair))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _groups(text: Column, pattern: str) -> Column:
    """What each group of a pattern holds, null for none."""
    return F.array(*(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) for k in range(1, re.compile(pattern).groups + 1)))


class _Match:
    """The groups of one rule's pattern in a phrase, read as days."""

    def __init__(self, groups: Column, today: Column):
        self.groups, self.today = groups, today

    def group(self, k: int) -> Column:
        return F.get(self.groups, F.lit(k - 1))

    def count(self, k: int) -> Column:
        return F.coalesce(F.try_element_at(_map(COUNTS), self.group(k)), self.group(k).try_cast("int"))

    def month(self, name: int, year: int) -> tuple[Column, Column]:
        """First and last day; without a year the latest such month that has begun."""
        m = F.try_element_at(_map({x: i for i, n in enumerate(MONTHS, 1) for x in (n, n[:3])}), self.group(name))
        y = F.coalesce(self.group(year).try_cast("int"), F.year(self.today) - (m > F.month(self.today)).cast("int"))
        first = F.make_date(y, m, F.lit(1))
        return first, F.last_day(first)

    def day(self, k: int) -> Column:
        return day_in(self.group(k), self.today)


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


#: Forms of one day: 2026-6-14, 6/14 or 6/14/26, June 14th or June 14th, 2026.
_ISO, _SLASH, _NAMED = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?$", rf"^{_MONTH}\.? (\d{{1,2}})(?:st|nd|rd|th)?(?:,? (\d{{4}}))?$"


def day_in(text: Column, today: Column) -> Column:
    """One day written as 2026-6-14, 6/14, 6/14/26 or June 14th, 2026; null if it is none or does not exist."""

    def slash(g: Column) -> Column:
        short = F.get(g, F.lit(2)).try_cast("int")
        return _date(F.coalesce(F.when(short < 100, short + 2000).otherwise(short), F.year(today)), F.get(g, F.lit(0)), F.get(g, F.lit(1)))

    def named(g: Column) -> Column:
        m = F.try_element_at(_map({x: i for i, n in enumerate(MONTHS, 1) for x in (n, n[:3])}), F.get(g, F.lit(0)))
        return _date(F.coalesce(F.get(g, F.lit(2)).try_cast("int"), F.year(today) - (m > F.month(today)).cast("int")), m, F.get(g, F.lit(1)))

    def read(t: Column) -> Column:
        iso = lambda g: _date(*(F.get(g, F.lit(k)) for k in range(3)))
        by = lambda pattern, use: _bound(_groups(t, pattern), use)
        return F.when(t.rlike(_ISO), by(_ISO, iso)).when(t.rlike(_SLASH), by(_SLASH, slash)).when(t.rlike(_NAMED), by(_NAMED, named))

    return _bound(F.lower(F.regexp_replace(F.trim(text), r"^[.,\s]+|[.,\s]+$", "")), read)


def _back(m: _Match) -> tuple[Column, Column]:
    unit = F.try_element_at(_map({"day": 1, "week": 7, "month": 30}), m.group(2))
    return F.date_add(m.today, 1 - m.count(1) * unit), m.today


def _part(m: _Match) -> tuple[Column, Column]:
    first, last = m.month(3, 4)
    unit, which = m.group(2), m.group(1)
    amount = F.coalesce(F.try_element_at(_map(COUNTS), F.regexp_extract(unit, "^([a-z]+) weeks", 1)), F.regexp_extract(unit, r"^(\d+)", 1).try_cast("int"), F.lit(1))
    days = amount * F.when(unit.contains("week"), 7).otherwise(1)
    half = unit == "half"
    lo = F.when(half & (which != "first"), F.date_add(first, 15)).when(which == "first", first).when(which == "second", F.date_add(first, days)).otherwise(F.greatest(first, F.date_add(last, 1 - days)))
    hi = F.when(half & (which == "first"), F.date_add(first, 14)).when(half | (which == "last"), last).otherwise(F.least(last, F.date_add(lo, days - 1)))
    return lo, hi


def _edge(m: _Match) -> tuple[Column, Column]:
    first, last = m.month(2, 3)
    at_end = m.group(1) == "end"
    return F.when(at_end, F.date_add(last, -6)).otherwise(first), F.when(at_end, last).otherwise(F.date_add(first, 6))


def _monday(today: Column) -> Column:
    return F.trunc(today, "week")


#: Pattern of a whole phrase, and its first and last day.
RULES: tuple[tuple[str, Callable[[_Match], tuple[Column, Column]]], ...] = (
    ("today", lambda m: (m.today, m.today)),
    ("yesterday", lambda m: (F.date_add(m.today, -1), F.date_add(m.today, -1))),
    ("this week", lambda m: (_monday(m.today), m.today)),
    ("last week", lambda m: (F.date_add(_monday(m.today), -7), F.date_add(_monday(m.today), -1))),
    ("this month", lambda m: (F.trunc(m.today, "month"), m.today)),
    ("last month", lambda m: (F.add_months(F.trunc(m.today, "month"), -1), F.date_add(F.trunc(m.today, "month"), -1))),
    (rf"(?:last|past|previous) {_NUM} (day|week|month)s?", _back),
    (rf"(first|second|last) (half|week|two weeks|three weeks|\d+ weeks?|\d+ days) of {_MONTH}{_YEAR}", _part),
    ("week of (.+)", lambda m: (m.day(1), F.date_add(m.day(1), 6))),
    ("(?:between|from) (.+?) (?:and|to|through|until|-) (.+)", lambda m: (F.when(m.day(2).isNotNull(), F.least(m.day(1), m.day(2))), F.greatest(m.day(1), m.day(2)))),
    (rf"{_MONTH}\.?{_YEAR}", lambda m: m.month(1, 2)),
    (rf"(end|start|beginning) of {_MONTH}{_YEAR}", _edge),
    ("(.+)", lambda m: (m.day(1), m.day(1))),
)


def phrase_range(phrase: Column, today: Column) -> Column:
    """struct(lo, hi) of the first rule that reads the whole phrase as dates; null if none does.

    The phrase is made plain once, and only a rule whose pattern it fits takes its
    groups, each once.
    """
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(phrase, r"\s+", " "))), r"[?.!]+$", ""), r"^(?:(?:in|on|during|for|over|of|the) ){1,2}", "")

    def reader(days: Callable[[_Match], tuple[Column, Column]]) -> Callable[[Column], Column]:
        def read(groups: Column) -> Column:
            lo, hi = days(_Match(groups, today))
            return _bound(F.struct(lo.alias("lo"), hi.alias("hi")), lambda r: F.when(r["lo"].isNotNull() & r["hi"].isNotNull(), r))

        return read

    def by_rules(t: Column) -> Column:
        whole = [(f"^(?:{pattern})$", days) for pattern, days in RULES]
        return F.coalesce(*(F.when(t.rlike(p), _bound(_groups(t, p), reader(days))) for p, days in whole))

    return _bound(text, by_rules)


def resolve_phrase(phrase: str, today: dt.date) -> tuple[dt.date, dt.date] | None:
    """The range of one phrase, for a plan."""
    spark = SparkSession.active()
    got = spark.range(1).select(phrase_range(F.lit(phrase), F.lit(today)).alias("r")).first()["r"]
    return (got["lo"], got["hi"]) if got else None
