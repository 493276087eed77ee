"""Calendar expressions over one timestamp or date column."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, functions as F

from ..schema import PEAK_HOURS

# Fixed values: (month, day, first year) of the US federal holidays on a fixed date.
FIXED_HOLIDAYS = ((1, 1, 1), (6, 19, 2021), (7, 4, 1), (11, 11, 1), (12, 25, 1))
# Fixed values: (month, weekday with Monday = 0, first day, last day) of the others.
FLOATING_HOLIDAYS = (
    (1, 0, 15, 21),
    (2, 0, 15, 21),
    (5, 0, 25, 31),
    (9, 0, 1, 7),
    (10, 0, 8, 14),
    (11, 3, 22, 28),
)


def hour_start(ts: Column | str) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def minute_start(ts: Column | str) -> Column:
    return F.date_trunc("minute", ts).cast("timestamp_ntz")


def flag(cond: Column) -> Column:
    return cond.cast("int")


def is_peak(hour: Column) -> Column:
    return hour.isin(*PEAK_HOURS)


def calendar_parts(ts: Column | str) -> dict[str, Column]:
    return {
        "hour": F.hour(ts),
        "day": F.dayofmonth(ts),
        "weekday": F.weekday(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "year": F.year(ts),
        "day_of_year": F.dayofyear(ts),
        "week_of_year": F.weekofyear(ts),
    }


def cyclic_pair(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def day_part_flags(ts: Column | str) -> dict[str, Column]:
    h = F.hour(ts)
    return {
        "is_weekend": flag(F.weekday(ts) >= 5),
        "is_peak_hour": flag(is_peak(h)),
        "is_morning": flag(h.between(6, 9)),
        "is_afternoon": flag(h.between(12, 16)),
        "is_evening": flag(h.between(17, 20)),
        "is_night": flag((h >= 21) | (h <= 5)),
    }


def is_derived(name: str) -> bool:
    """Whether a column of that name is a part or flag of a time, or the label of a place's cluster, and so no measurement."""
    return name in {*calendar_parts("_"), *day_part_flags("_"), "is_holiday"} or re.fullmatch(r"cluster_\d+", name) is not None


def seconds_since_midnight(ts: Column | str) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def seconds_since_monday(ts: Column | str) -> Column:
    return F.weekday(ts) * 86400 + seconds_since_midnight(ts)


def time_period(hour: Column) -> Column:
    return (
        F.when(hour.between(6, 11), "morning")
        .when(hour.between(12, 17), "afternoon")
        .when(hour.between(18, 21), "evening")
        .otherwise("night")
    )


def peak_label(hour: Column) -> Column:
    return (
        F.when(hour.between(7, 9), "morning_peak")
        .when(hour.between(17, 19), "evening_peak")
        .when(hour.between(2, 5), "late_night")
        .otherwise("other")
    )


def _month_day(day: Column) -> Column:
    """704 for July 4."""
    return F.month(day) * 100 + F.dayofmonth(day)


def _fixed_holiday(day: Column) -> Column:
    days: dict[int, list[int]] = {}
    for month, dom, since in FIXED_HOLIDAYS:
        days.setdefault(since, []).append(month * 100 + dom)
    hit = F.lit(False)
    for since, found in days.items():
        hit = hit | (_month_day(day).isin(*found) & (F.year(day) >= since))
    return hit


def is_us_holiday(day: Column) -> Column:
    """US federal holiday test, with observed days of weekend holidays.

    A pure expression: no holiday table is built or joined.  A fixed holiday
    that falls on Saturday is also observed on the Friday before, one on Sunday
    on the Monday after.  Days are looked up in lists, which keeps the generated
    code short.
    """
    wd = F.weekday(day)
    hit = _fixed_holiday(day)
    days: dict[int, list[int]] = {}
    for month, weekday, first, last in FLOATING_HOLIDAYS:
        days.setdefault(weekday, []).extend(range(month * 100 + first, month * 100 + last + 1))
    for weekday, found in days.items():
        hit = hit | ((wd == weekday) & _month_day(day).isin(*found))
    # the day that is observed on this one: tomorrow on a Friday, yesterday on a Monday
    return hit | (wd.isin(0, 4) & _fixed_holiday(F.date_add(day, F.when(wd == 4, 1).otherwise(-1))))
