from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from tessera.functions.temporal import resolve_query
from tessera.functions.timeexpr import resolve, shift_month, shift_year

BASE = D(2026, 9, 1, 12)


@pytest.mark.parametrize(
    "expr,time,precision",
    [
        ("2023-05-17", D(2023, 5, 17), "day"),
        ("last night", D(2026, 8, 31, 12), "day"),
        ("tomorrow", D(2026, 9, 2, 12), "day"),
        ("last week", D(2026, 8, 25, 12), "day"),
        ("last month", D(2026, 8, 1, 12), "month"),
        ("two days ago", D(2026, 8, 30, 12), "day"),
        ("3 weeks ago", D(2026, 8, 11, 12), "day"),
        ("last Saturday", D(2026, 8, 29, 12), "day"),
        ("next Fri", D(2026, 9, 4, 12), "day"),
        ("June 2023", D(2023, 6, 1), "month"),
        ("the week before 9 June 2023", D(2023, 6, 2), "day"),
        ("two weekends before 17 July 2023", D(2023, 7, 1), "month"),
        ("", BASE, "unknown"),
        ("_", BASE, "unknown"),
        ("whenever", BASE, "unknown"),
        ("前天", D(2026, 8, 30, 12), "day"),
        ("上周五", D(2026, 8, 28, 12), "day"),
        ("下周三下午3点", D(2026, 9, 9, 12), "day"),
        ("星期三", D(2026, 8, 26, 12), "day"),
        ("两周前", D(2026, 8, 18, 12), "day"),
    ],
)
def test_resolve(expr, time, precision):
    assert resolve(expr, BASE) == (time, precision)


def test_shifts():
    assert shift_month(D(2024, 3, 31, 5), -1) == D(2024, 2, 29, 5)
    assert shift_month(D(2024, 12, 31), 2) == D(2025, 2, 28)
    assert shift_year(D(2024, 2, 29), 1) == D(2025, 3, 1)


@pytest.mark.parametrize(
    "query,mode",
    [
        ("what happened last year?", "IN_YEAR"),
        ("in June 2026?", "IN_MONTH"),
        ("during the summer", "IN_SEASON"),
        ("recently", "WITHIN_WINDOW"),
        ("the last time we spoke", "LAST_K"),
        ("how do I fix this error?", "DENSE"),
        ("last week", "RANGE"),
        ("最近一次", "LAST_K"),
        ("昨天", "WITHIN_WINDOW"),
    ],
)
def test_operator(query, mode):
    assert resolve_query(query, BASE).mode == mode


def test_match_and_bonus(spark):
    rows = [(1, D(2026, 6, 5), D(2026, 9, 1)), (2, D(2026, 3, 1), D(2026, 6, 9)), (3, None, D(2026, 6, 9)), (4, D(2026, 5, 1), D(2026, 7, 1)), (5, D(2026, 6, 1), D(2026, 6, 2))]
    df = spark.createDataFrame(rows, "id int, e timestamp, m timestamp")
    op = resolve_query("in June 2026", BASE)
    got = {r["id"]: r["a"] for r in df.select("id", op.match(F.col("e"), F.col("m")).alias("a")).collect()}
    assert got == {1: "event", 2: "mention", 3: "mention", 4: None, 5: "event"}
    winter = resolve_query("in the winter", BASE)
    months = spark.createDataFrame([(D(2026, 12, 1),), (D(2027, 1, 5),), (D(2026, 1, 5),), (D(2026, 5, 5),)], "t timestamp")
    assert [r[0] for r in months.select(winter.match(F.col("t"), F.col("t"))).collect()] == ["event", "event", None, None]
    assert all(0 <= r[0] <= 0.3 for r in df.select(resolve_query("x", BASE).bonus(F.col("e"), F.col("m"))).collect())
