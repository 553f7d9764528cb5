"""Period keys: quarters ``2026Q2``, months ``202607``, 14-digit receipts whose first 8 digits are a date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Report code -> quarter.
REPORT_QUARTER = {"11013": 1, "11012": 2, "11014": 3, "11011": 4}
#: Quarter -> years after the business year, month and day on which its report is due.
DUE = {1: (0, 5, 15), 2: (0, 8, 14), 3: (0, 11, 14), 4: (1, 3, 31)}
#: Days after the due date from which a report counts as available.
DUE_SLACK = 3


def quarter_key(year: Column, report_code: Column) -> Column:
    """The quarter of a business year's report; null for an unknown code."""
    codes = F.create_map(*[F.lit(x) for pair in REPORT_QUARTER.items() for x in pair])
    return F.concat(year.cast("string"), F.lit("Q"), F.try_element_at(codes, report_code).cast("string"))


def report_code(period: Column) -> Column:
    """The report code of a quarter."""
    codes = F.create_map(*[F.lit(x) for c, q in REPORT_QUARTER.items() for x in (q, c)])
    return F.try_element_at(codes, F.substring(period, 6, 1).cast("int"))


def quarter_ordinal(period: Column) -> Column:
    """Quarters as consecutive integers."""
    return F.substring(period, 1, 4).cast("int") * 4 + F.substring(period, 6, 1).cast("int") - 1


def quarter_of_ordinal(n: Column) -> Column:
    """The inverse of ``quarter_ordinal``."""
    return F.concat(F.floor(n / 4).cast("string"), F.lit("Q"), (F.pmod(n, F.lit(4)) + 1).cast("string"))


def shift_quarter(period: Column, n: int) -> Column:
    """The quarter ``n`` later."""
    return quarter_of_ordinal(quarter_ordinal(period) + n)


def month_ordinal(period: Column) -> Column:
    """Months as consecutive integers."""
    return F.substring(period, 1, 4).cast("int") * 12 + F.substring(period, 5, 2).cast("int") - 1


def month_of_ordinal(n: Column) -> Column:
    """The inverse of ``month_ordinal``."""
    return F.concat(F.floor(n / 12).cast("string"), F.lpad((F.pmod(n, F.lit(12)) + 1).cast("string"), 2, "0"))


def shift_month(period: Column, n: int) -> Column:
    """The month ``n`` later."""
    return month_of_ordinal(month_ordinal(period) + n)


def available_on(period: Column) -> Column:
    """The day from which a quarter's report is taken to be public."""
    year, quarter = F.substring(period, 1, 4).cast("int"), F.substring(period, 6, 1).cast("int")
    due = F.lit(None).cast("date")
    for q, (years, month, day) in DUE.items():
        due = F.when(quarter == q, F.make_date(year + years, F.lit(month), F.lit(day))).otherwise(due)
    return F.date_add(due, DUE_SLACK)


def receipt_date(receipt: Column) -> Column:
    """The date in a 14-digit receipt number; null for anything else."""
    return F.when(receipt.rlike(r"^\d{14}$"), F.try_to_timestamp(F.substring(receipt, 1, 8), F.lit("yyyyMMdd")).cast("date"))


def known_on(as_of: Column, receipts: Column) -> Column:
    """The latest date among an array of receipts and the as-of key, which may be a receipt itself."""
    return F.array_max(F.transform(F.array_append(receipts, as_of), receipt_date))


def trade_window(today: date, months: int, refresh: int = 3, lag: int = 2) -> dict[str, int]:
    """Collection window as YYYYMM: from, to, refresh from, complete to. At least 13 months are kept."""

    def back(n: int) -> int:
        k = today.year * 12 + today.month - 1 - n
        return k // 12 * 100 + k % 12 + 1

    return {"from": back(max(months, 13)), "to": back(1), "refresh_from": back(refresh), "complete_to": back(lag)}


def iterated_grid(start: date, end: date, months: int) -> list[date]:
    """Dates ``months`` apart, each counted from the one before it: a day that was cut stays cut."""
    import calendar

    out, at = [], start
    while at <= end:
        out.append(at)
        k = at.year * 12 + at.month - 1 + months
        y, m = k // 12, k % 12 + 1
        at = date(y, m, min(at.day, calendar.monthrange(y, m)[1]))
    return out
