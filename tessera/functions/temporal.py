"""Temporal operators: read from a query on the driver, applied as Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeexpr import MONTHS, shift_month

# Months of the seasons; winter reaches into the next year.
SEASONS = {"spring": (3, 5), "summer": (6, 8), "fall": (9, 11), "autumn": (9, 11), "winter": (12, 2)}
# Fixed value: how many of which unit back.
ORDINAL = re.compile(r"\b(last|previous|recent(?:ly)?|past|this)\s*(\d+)?\s*(time|times|day|days|week|weeks|month|months|year|years)?\b")
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
VAGUE_DAYS = 180


@dataclass(frozen=True)
class TemporalOp:
    """DENSE, LAST_K, WITHIN_WINDOW, RANGE, IN_YEAR, IN_MONTH or IN_SEASON."""

    mode: str
    anchor: datetime
    k: int = 0
    window: timedelta | None = None
    start: datetime | None = None
    end: datetime | None = None
    year: int = 0
    months: tuple[int, int] = (0, 0)

    @property
    def filters(self) -> bool:
        return self.mode not in ("DENSE", "LAST_K")

    def holds(self, t: Column) -> Column:
        if self.mode == "RANGE":
            return (t >= F.lit(self.start)) & (t < F.lit(self.end))
        if self.mode == "WITHIN_WINDOW":
            return t.between(F.lit(self.anchor - self.window), F.lit(self.anchor))
        if self.mode == "IN_YEAR":
            return F.year(t) == self.year
        if self.mode == "IN_MONTH":
            return (F.year(t) == self.year) & (F.month(t) == self.months[0])
        if self.mode == "IN_SEASON":
            first, last = self.months
            if first <= last:
                return (F.year(t) == self.year) & F.month(t).between(first, last)
            return ((F.year(t) == self.year) & (F.month(t) >= first)) | ((F.year(t) == self.year + 1) & (F.month(t) <= last))
        return F.lit(True)

    def match(self, event_time: Column, mention_time: Column) -> Column:
        """'event', 'mention' or null: which anchor meets the operator, the event's first."""
        if not self.filters:
            return F.when(event_time.isNotNull(), "event").otherwise("mention")
        return F.when(self.holds(event_time), "event").when(self.holds(mention_time), "mention")

    def bonus(self, event_time: Column, mention_time: Column) -> Column:
        """Recency bonus; distances in days are absolute."""
        at = F.unix_micros(F.lit(self.anchor).cast("timestamp"))
        dm = F.abs(F.unix_micros(mention_time.cast("timestamp")) - at) / F.lit(86_400_000_000.0)
        de = F.abs(F.unix_micros(event_time.cast("timestamp")) - at) / F.lit(86_400_000_000.0)
        if self.mode == "DENSE":
            return 0.3 / (1 + dm / 30)
        if self.mode == "LAST_K":
            return 0.25 / (1 + F.coalesce(de, dm) / 14)
        if self.mode == "IN_YEAR":
            return F.lit(0.0)
        rates = (0.2, 14, 0.1, 14) if self.mode == "WITHIN_WINDOW" else (0.15, 30, 0.08, 30)
        return F.greatest(F.coalesce(rates[0] / (1 + de / rates[1]), F.lit(0.0)), rates[2] / (1 + dm / rates[3]))


def week_start(d: datetime) -> datetime:
    return datetime(d.year, d.month, d.day) - timedelta(days=d.weekday())


def resolve_query(query: str, anchor: datetime) -> TemporalOp:
    """First rule that fits; DENSE without temporal intent."""
    q = query.lower()
    week, month, now = week_start(anchor), datetime(anchor.year, anchor.month, 1), anchor + timedelta(milliseconds=1)

    def within(n: float) -> TemporalOp:
        return TemporalOp("WITHIN_WINDOW", anchor, window=timedelta(days=n))

    def span(start: datetime, end: datetime) -> TemporalOp:
        return TemporalOp("RANGE", anchor, start=start, end=end)

    def in_year(y: int) -> TemporalOp:
        return TemporalOp("IN_YEAR", anchor, year=y)

    last_week, last_month = span(week - timedelta(days=7), week), span(shift_month(month, -1), month)
    # Chinese words for spans, in turn.
    chinese = (
        (("去年",), in_year(anchor.year - 1)),
        (("今年",), in_year(anchor.year)),
        (("上周", "上星期"), last_week),
        (("这周", "本周", "这星期", "本星期"), span(week, now)),
        (("上个月", "上月"), last_month),
        (("这个月", "本月"), span(month, now)),
        (("最新", "最近一次", "上次"), TemporalOp("LAST_K", anchor, k=1)),
        (("最近", "近期"), within(VAGUE_DAYS)),
        (("昨天",), within(1)),
    )
    for words, op in chinese:
        if any(w in q for w in words):
            return op
    if m := re.search(r"\b(last|this|next)\s+year\b", q):
        return in_year(anchor.year + {"last": -1, "this": 0, "next": 1}[m[1]])
    if m := re.search(r"\b(?:in|during)\s+(\d{4})\b", q):
        return in_year(int(m[1]))
    for words, op in (("last week", last_week), ("this week", span(week, now)), ("last month", last_month), ("this month", span(month, now))):
        if re.search(rf"\b{words}\b", q):
            return op
    if (m := ORDINAL.search(q)) and (m[3] or m[1] not in ("this", "past")):
        n, unit = int(m[2] or 1), (m[3] or "").rstrip("s")
        if unit in UNIT_DAYS:
            return within(n * UNIT_DAYS[unit])
        return TemporalOp("LAST_K", anchor, k=max(1, n)) if m[1] in ("last", "previous") else within(VAGUE_DAYS)
    if (m := re.search(r"\bin\s+([a-z]+)\s*(\d{4})?\b", q)) and m[1] in MONTHS:
        at = MONTHS.index(m[1]) + 1
        return TemporalOp("IN_MONTH", anchor, year=int(m[2] or anchor.year), months=(at, at))
    if (m := re.search(r"(?:during|in)\s+the\s+([a-z]+)", q)) and m[1] in SEASONS:
        return TemporalOp("IN_SEASON", anchor, year=anchor.year, months=SEASONS[m[1]])
    return within(1) if "yesterday" in q else TemporalOp("DENSE", anchor)
