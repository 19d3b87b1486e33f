"""Quarter and month arithmetic on columns. A quarter is carried both as the sortable label `YYYY-Qn` and as the
integer index year*4 + quarter - 1, so that shifts are plain integer additions."""
from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F


def quarter_index(d: Column) -> Column:
    return F.year(d) * 4 + F.quarter(d) - 1


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def label_of_index(q: Column) -> Column:
    return F.concat(F.floor(q / 4).cast("string"), F.lit("-Q"), (F.pmod(q, F.lit(4)) + 1).cast("string"))


def index_of_label(label: Column) -> Column:
    return F.substring(label, 1, 4).cast("int") * 4 + F.substring(label, 7, 1).cast("int") - 1


def shift_quarter(label: Column, n: int | Column) -> Column:
    return label_of_index(index_of_label(label) + n)


def quarter_start(label: Column) -> Column:
    return F.make_date(F.substring(label, 1, 4).cast("int"), F.substring(label, 7, 1).cast("int") * 3 - 2, F.lit(1))


def quarter_end(label: Column) -> Column:
    return F.last_day(F.add_months(quarter_start(label), 2))


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM")


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def month_in_quarter(d: Column) -> Column:
    return F.pmod(F.month(d) - 1, F.lit(3)) + 1


def qidx(label: str) -> int:
    """Driver-side twin of index_of_label, for parameters."""
    return int(label[:4]) * 4 + int(label[6]) - 1


def qlabel(index: int) -> str:
    return f"{index // 4}-Q{index % 4 + 1}"


def qend(label: str) -> date:
    i = qidx(label) + 1
    return date.fromordinal(date(i // 4, i % 4 * 3 + 1, 1).toordinal() - 1)


def qstart(label: str) -> date:
    i = qidx(label)
    return date(i // 4, i % 4 * 3 + 1, 1)
