"""Time expressions: a table of rules, first match wins.

resolve() reads one expression; resolve_column() is its Arrow-batched form, and
repeated expressions of a batch are resolved once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Calendar words.
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
ABBREVIATIONS = {"mon": 0, "tue": 1, "tues": 1, "wed": 2, "thu": 3, "thurs": 3, "fri": 4, "sat": 5, "sun": 6}
MONTHS = "january february march april may june july august september october november december".split()
NUMBERS = "one two three four five six seven eight nine ten".split()
ZH_WEEKDAYS = {"一": 0, "二": 1, "三": 2, "四": 3, "五": 4, "六": 5, "日": 6, "天": 6}
ZH_NUMBERS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
ZH_DAYS = {"前天": -2, "昨天": -1, "今天": 0, "明天": 1, "后天": 2}

Resolved = tuple[datetime, str]
QUANTITY = rf"(\d+|a few|a couple of|{'|'.join(NUMBERS)})"


def days(base: datetime, n: float) -> datetime:
    return base + timedelta(days=n)


def shift_month(d: datetime, delta: int) -> datetime:
    """Clamped to the month's length; sub-second time is dropped."""
    y, m = divmod(d.year * 12 + d.month - 1 + delta, 12)
    last = (datetime(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return d.replace(year=y, month=m + 1, day=min(d.day, last), microsecond=0)


def shift_year(d: datetime, delta: int) -> datetime:
    """29 February overflows to 1 March."""
    first = d.replace(year=d.year + delta, day=1, microsecond=0)
    return first + timedelta(days=d.day - 1)


def calendar(year: int, month: int, day: int) -> datetime:
    """Fields beyond their range carry over."""
    y, m = divmod(year * 12 + month - 1, 12)
    return datetime(y, m + 1, 1) + timedelta(days=day - 1)


def expand_weekdays(e: str) -> str:
    return re.sub(rf"\b({'|'.join(sorted(ABBREVIATIONS, key=len, reverse=True))})\b", lambda m: WEEKDAYS[ABBREVIATIONS[m.group(1)]], e)


def _named(day: str, month: str, year: str) -> datetime | None:
    return calendar(int(year), MONTHS.index(month) + 1, int(day)) if month in MONTHS else None


def _back(now: datetime, weekday: int) -> datetime:
    return days(now, -((now.weekday() - weekday) % 7 or 7))


def _ahead(now: datetime, weekday: int) -> datetime:
    return days(now, (weekday - now.weekday()) % 7 or 7)


def _count(q: str) -> int:
    return {"a few": 3, "a couple of": 2}.get(q) or (NUMBERS.index(q) + 1 if q in NUMBERS else int(q))


def _zh_weekday(m: re.Match, b: datetime) -> Resolved:
    wd = ZH_WEEKDAYS[m[2]]
    if m[1] == "下":
        return days(b, (wd - b.weekday()) % 7 + 7), "day"
    if m[1] == "上":
        return days(b, wd - b.weekday() - 7), "day"
    return _back(b, wd), "day"


def _zh_ago(m: re.Match, b: datetime) -> Resolved:
    n = ZH_NUMBERS.get(m[1]) or int(m[1])
    if m[2] in ("天", "日"):
        return days(b, -n), "day"
    if m[2] in ("周", "星期"):
        return days(b, -7 * n), "day"
    return (shift_month(b, -n), "month") if "月" in m[2] else (shift_year(b, -n), "year")


def _before(m: re.Match, b: datetime) -> Resolved | None:
    target = _named(m[2], m[3], m[4])
    if target is None or m[1] != "week" and m[1] not in WEEKDAYS:
        return None
    return (days(target, -7) if m[1] == "week" else _back(target, WEEKDAYS.index(m[1]))), "day"


def _weekends_before(m: re.Match, b: datetime) -> Resolved | None:
    target = _named(m[2], m[3], m[4])
    return target and (days(target, -7 * int(m[1])), "day")


def _week_of(m: re.Match, b: datetime) -> Resolved | None:
    target = _named(m[1], m[2], m[3])
    return target and (days(target, -target.weekday()), "day")


def _ago(m: re.Match, b: datetime) -> Resolved:
    n = _count(m[1])
    if m[2].startswith("day"):
        return days(b, -n), "day"
    if m[2].startswith("weekend"):
        return days(_back(b, 5), -7 * n), "day"
    return (days(b, -7 * n), "day") if m[2].startswith("week") else (shift_month(b, -n), "month")


def _month_year(m: re.Match, b: datetime) -> Resolved | None:
    first = _named("1", m[1], m[2])
    return first and (first, "month")


# Whole expressions, Chinese first.
EXACT: dict[str, Callable[[datetime], Resolved]] = {
    **{k: (lambda b, n=n: (days(b, n), "day")) for k, n in ZH_DAYS.items()},
    "上周": lambda b: (days(b, -7), "day"),
    "下周": lambda b: (days(b, 7), "day"),
    **dict.fromkeys(("这周", "本周", "this week"), lambda b: (b, "week")),
    **dict.fromkeys(("上个月", "上月", "last month"), lambda b: (shift_month(b, -1), "month")),
    **dict.fromkeys(("下个月", "下月", "next month"), lambda b: (shift_month(b, 1), "month")),
    **dict.fromkeys(("这个月", "本月", "this month"), lambda b: (b, "month")),
    **dict.fromkeys(("去年", "last year"), lambda b: (shift_year(b, -1), "year")),
    **dict.fromkeys(("明年", "next year"), lambda b: (shift_year(b, 1), "year")),
    **dict.fromkeys(("今年", "this year"), lambda b: (b, "year")),
    **dict.fromkeys(("yesterday", "last night", "last evening", "yesterday evening", "yesterday night"), lambda b: (days(b, -1), "day")),
    **dict.fromkeys(("today", "now"), lambda b: (b, "day")),
    **dict.fromkeys(("tomorrow", "tomorrow night", "tomorrow evening"), lambda b: (days(b, 1), "day")),
    "last week": lambda b: (days(b, -7), "day"),
    "next week": lambda b: (days(b, 7), "day"),
    "last weekend": lambda b: (_back(b, 5), "day"),
    "next weekend": lambda b: (_ahead(b, 5), "day"),
}
# Patterns tried before the exact words, and after; a rule may decline.
ZH_RULES = [
    (re.compile(r"^(上|这|本|下)?(?:周|星期)([一二三四五六日天])(?:凌晨|早上|上午|中午|下午|晚上|今晚)?(?:\d{1,2}点(?::?\d{1,2}分?)?|半)?$"), _zh_weekday),
    (re.compile(rf"^(\d+|[{''.join(ZH_NUMBERS)}])个?(天|日|周|星期|个月|月|年)前$"), _zh_ago),
]
DATE_RULES = [
    (re.compile(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"), lambda m, b: (calendar(int(m[1]), int(m[2]), int(m[3])), "day")),
    (re.compile(r"the\s+(\w+)\s+before\s+(\d{1,2})\s+([a-z]+)\s*,?\s+(\d{4})"), _before),
    (re.compile(r"(\d+)\s+weekends?\s+before\s+(\d{1,2})\s+([a-z]+)\s*,?\s+(\d{4})"), _weekends_before),
    (re.compile(r"the\s+week\s+of\s+(\d{1,2})\s+([a-z]+)\s*,?\s+(\d{4})"), _week_of),
]
LATE_RULES = [
    (re.compile(rf"{QUANTITY}\s*(day|days|week|weeks|weekend|weekends|month|months)\s+ago"), _ago),
    (re.compile(rf"(last|next)?\s*({'|'.join(WEEKDAYS)})"), lambda m, b: ((_ahead if m[1] == "next" else _back)(b, WEEKDAYS.index(m[2])), "day")),
    (re.compile(r"([a-z]+)\s+(\d{4})"), _month_year),
]


def _first(rules: list, e: str, base: datetime) -> Resolved | None:
    for pattern, rule in rules:
        m = pattern.search(e)
        if m and (found := rule(m, base)):
            return found
    return None


def resolve(expr: str | None, base: datetime) -> Resolved:
    """(time, precision); what can't be resolved is (base, unknown)."""
    e = (expr or "").strip().lower()
    if e in ("", "unknown", "n/a", "-", "_"):
        return base, "unknown"
    if not e.isascii() and e in EXACT:
        return EXACT[e](base)
    found = _first(ZH_RULES, e, base)
    if found:
        return found
    e = expand_weekdays(e)
    found = _first(DATE_RULES, e, base)
    if found:
        return found
    if e in EXACT:
        return EXACT[e](base)
    return _first(LATE_RULES, e, base) or (base, "unknown")


RESOLVED = T.StructType([T.StructField("time", T.TimestampType()), T.StructField("precision", T.StringType())])


@F.pandas_udf(RESOLVED)
def resolve_column(expr: pd.Series, base: pd.Series) -> pd.DataFrame:
    seen: dict = {}
    out = []
    for e, b in zip(expr, base, strict=True):
        if pd.isna(b):
            out.append((None, "unknown"))
            continue
        key = (e, b)
        if key not in seen:
            seen[key] = resolve(e, pd.Timestamp(b).to_pydatetime())
        out.append(seen[key])
    return pd.DataFrame({"time": pd.to_datetime([t for t, _ in out]), "precision": [p for _, p in out]})


# Forms of time expressions found in running text, in turn.
EXTRACT = (
    r"the\s+(?:week|[a-z]+day)\s+before\s+\d{1,2}\s+[a-z]+\s*,?\s*\d{4}",
    r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    r"\d{1,2}\s+[a-z]+\s+\d{4}",
    rf"(?:last|next|this)\s+(?:week|month|year|{'|'.join(WEEKDAYS)})",
    r"\b(?:yesterday|today|tomorrow)\b",
    r"(?:last|tomorrow|yesterday)\s+(?:night|evening)",
    rf"(?:\d+|a few|a couple of|{'|'.join(NUMBERS)})\s*(?:day|days|week|weeks|month|months)\s+ago",
    r"[a-z]+\s+\d{4}",
)


def extract_time(c: Column) -> Column:
    """The first known form in a text, or null."""
    low = F.lower(c)
    for short in sorted(ABBREVIATIONS, key=len, reverse=True):
        low = F.regexp_replace(low, rf"\b{short}\b", WEEKDAYS[ABBREVIATIONS[short]])
    return F.coalesce(*[F.nullif(F.regexp_extract(low, p, 0), F.lit("")) for p in EXTRACT])


def event_time(expr: Column, base: Column, fact: Column) -> Column:
    """Struct of time and precision; an empty expression is looked for in the fact."""
    found = F.coalesce(F.nullif(expr, F.lit("")), extract_time(fact), F.lit(""))
    got = resolve_column(found, base)
    return F.struct(F.when(got["precision"] != "unknown", got["time"]).alias("time"), got["precision"].alias("precision"))


def month_shift(ts: Column, delta: Column) -> Column:
    """shift_month as a Column: add_months clamps alike."""
    return F.make_timestamp(years=F.year(F.add_months(ts, delta)), months=F.month(F.add_months(ts, delta)), days=F.dayofmonth(F.add_months(ts, delta)), hours=F.hour(ts), mins=F.minute(ts), secs=F.second(ts).cast("decimal(16,6)"))


def year_shift(d: Column, delta: int) -> Column:
    """shift_year of a date as a Column."""
    return F.date_add(F.make_date(F.year(d) + delta, F.month(d), F.lit(1)), F.dayofmonth(d) - 1)
