"""Trial periods, date parsing and windows around a visit."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Periods:
    """First day of each period; a period ends where the next one starts."""

    baseline: date
    mid: date
    follow_up: date
    after: date


def classify_period(month: str, periods: Periods) -> Column:
    """before / baseline / mid / follow-up / after; a null month gives ``'0'``."""
    return F.expr(
        f"""CASE WHEN {month} >= DATE'{periods.after}' THEN 'after'
                 WHEN {month} >= DATE'{periods.follow_up}' THEN 'follow-up'
                 WHEN {month} >= DATE'{periods.mid}' THEN 'mid'
                 WHEN {month} >= DATE'{periods.baseline}' THEN 'baseline'
                 WHEN {month} < DATE'{periods.baseline}' THEN 'before'
                 ELSE '0' END"""
    )


def month_range(month: str, first: date, last: date) -> Column:
    """Months from ``first`` to ``last``, both included."""
    return F.expr(f"{month} BETWEEN DATE'{first}' AND DATE'{last}'")


def parse_iso_date(text: Column | str) -> Column:
    return F.try_to_date(text, "yyyy-MM-dd")


def parse_compact_date(text: Column | str) -> Column:
    return F.try_to_date(text, "yyyyMMdd")


def parse_visit_date(text: Column | str, month_first_if_ambiguous: bool = False) -> Column:
    """Day-first dates (``15/11/2018``); empty or bad text gives null.

    ``month_first_if_ambiguous`` reads ``01/11/2018`` as 11 January, as element-wise
    date guessing does, and falls back to day-first where the month is above 12.
    """
    day_first = F.try_to_date(text, "dd/MM/yyyy")
    if not month_first_if_ambiguous:
        return day_first
    return F.coalesce(F.try_to_date(text, "MM/dd/yyyy"), day_first)


def date_text(moment: Column | str) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def days_between(start: Column | str, end: Column | str) -> Column:
    """Whole days from ``start`` to ``end``; negative if ``end`` comes first."""
    return F.datediff(end, start)


@dataclass(frozen=True)
class Window:
    """Inclusive day ranges before and after an event; None leaves an end open."""

    before: tuple[int | None, int | None]
    after: tuple[int | None, int | None]


# 28 days either side without the day itself for page views;
# any time before, and the day itself to day 84, for alerts.
PAGE_VIEW_WINDOW = Window(before=(-28, -1), after=(1, 28))
ALERT_WINDOW = Window(before=(None, -1), after=(0, 84))


def _inside(days: str, bounds: tuple[int | None, int | None]) -> str:
    low, high = bounds
    tests = [f"{days} IS NOT NULL"]
    if low is not None:
        tests.append(f"{days} >= {low}")
    if high is not None:
        tests.append(f"{days} <= {high}")
    return " AND ".join(tests)


def event_window(days: str, window: Window) -> Column:
    """``before``, ``after`` or ``none`` by the number of days since the visit."""
    return F.expr(
        f"""CASE WHEN {_inside(days, window.after)} THEN 'after'
                 WHEN {_inside(days, window.before)} THEN 'before'
                 ELSE 'none' END"""
    )
