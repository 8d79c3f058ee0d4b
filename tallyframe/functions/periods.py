"""Fiscal periods as column expressions: headers such as 1Q15, FY15 and 6M15, durations and fiscal quarter ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: order of the period types within a year
TYPE_ORDER = {"Q1": 0, "Q2": 1, "Q3": 2, "Q4": 3, "FY": 4, "6M": 5, "9M": 6}
UNREADABLE = 9999


def period_type(label: Column) -> Column:
    """Q1 to Q4, FY, 6M or 9M; null if the label is no period. Two-digit years are 20yy."""
    s = F.upper(F.trim(label))
    return (
        F.when(s.rlike(r"^[1-4]Q[0-9]{2}$"), F.concat(F.lit("Q"), F.substring(s, 1, 1)))
        .when(s.rlike(r"^FY[0-9]{2}$"), F.lit("FY"))
        .when(s.rlike(r"^[69]M[0-9]{2}$"), F.substring(s, 1, 2))
    )


def fiscal_year(label: Column) -> Column:
    return F.when(period_type(label).isNotNull(), 2000 + F.right(F.trim(label), F.lit(2)).try_cast("int"))


def type_order(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_ORDER.items() for x in kv]), kind)


def sort_key(label: Column) -> Column:
    """year * 100 + type; unreadable labels come last."""
    return F.coalesce(fiscal_year(label) * 100 + type_order(period_type(label)), F.lit(UNREADABLE * 100 + 99))


def canonical(kind: Column, year: Column) -> Column:
    yy = F.lpad(F.pmod(year, F.lit(100)).cast("string"), 2, "0")
    return F.when(kind.startswith("Q"), F.concat(F.substring(kind, 2, 1), F.lit("Q"), yy)).otherwise(F.concat(kind, yy))


def duration_days(start: Column, end: Column) -> Column:
    """Days of a period, both ends counted."""
    return F.datediff(end, start) + 1


def minus_months(day: Column, n: int) -> Column:
    """n months before; the last day of a month stays a last day."""
    back = F.add_months(day, -n)
    return F.when(day == F.last_day(day), F.last_day(back)).otherwise(back)


def fiscal_label(start: Column, end: Column, fye_month: int, fye_day: int) -> Column:
    """FYyy, nQyy, 6Myy or 9Myy from a period's dates and the month and day on which fiscal years end.

    start null: an instant, a year end or else a quarter end. Null where nothing fits. Years are named by the
    calendar year of their end."""
    days = duration_days(start, end)
    near = lambda a, b, tolerance: F.abs(F.datediff(a, b)) <= tolerance
    year_end = lambda y: F.last_day(F.make_date(y, F.lit(fye_month), F.lit(1))) if fye_day >= 28 else F.make_date(y, F.lit(fye_month), F.lit(fye_day))
    this = year_end(F.year(end))
    ends = F.when(end <= F.date_add(this, 4), this).otherwise(year_end(F.year(end) + 1))
    yy = F.lpad(F.pmod(F.year(ends), F.lit(100)).cast("string"), 2, "0")
    quarter_ends = {4: ends, 3: minus_months(ends, 3), 2: minus_months(ends, 6), 1: minus_months(ends, 9)}

    def quarter(tolerance: int) -> Column:
        out = F.lit(None).cast("string")
        for n in (1, 2, 3, 4):
            out = F.when(near(end, quarter_ends[n], tolerance), F.concat(F.lit(f"{n}Q"), yy)).otherwise(out)
        return out

    return (
        F.when(start.isNull() & near(end, ends, 2), F.concat(F.lit("FY"), yy))
        .when(start.isNull(), quarter(4))
        .when(days.between(340, 400) & near(end, ends, 2), F.concat(F.lit("FY"), yy))
        .when(days.between(70, 105) & quarter(4).isNotNull(), quarter(4))
        .when(days.between(150, 215) & near(end, quarter_ends[2], 4), F.concat(F.lit("6M"), yy))
        .when(days.between(235, 325) & near(end, quarter_ends[3], 4), F.concat(F.lit("9M"), yy))
        .when(days.between(28, 125), quarter(4))
    )


def ny_date_key(ts: Column) -> Column:
    """The calendar day in New York, yyyy-MM-dd."""
    return F.date_format(F.from_utc_timestamp(ts, "America/New_York"), "yyyy-MM-dd")


def age_points(ts: Column, as_of: Column, steps: list[tuple[float, float]]) -> Column:
    """Points by age in days: those of the first step (days, points) that the age is under, else 0. as_of is an input,
    never the clock, so results can be had again."""
    days = (as_of.cast("timestamp").cast("double") - ts.cast("timestamp").cast("double")) / 86400
    out = F.lit(0.0)
    for limit, points in sorted(steps, reverse=True):
        out = F.when(days < limit, F.lit(float(points))).otherwise(out)
    return F.when(ts.isNull(), F.lit(0.0)).otherwise(out)


def within_rolling_hours(day: Column, window_end: Column, hours: int) -> Column:
    """Whether noon (UTC) of a day lies within so many hours up to window_end."""
    noon = F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 12:00:00")))
    return noon.between(window_end - F.make_dt_interval(F.lit(0), F.lit(hours)), window_end)
