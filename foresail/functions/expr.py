"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, functions as F

from foresail.schema import ALL


def money(c: Column) -> Column:
    """Currency as exact decimal, so that the order of addition cannot change a sum."""
    return c.cast("decimal(18,2)")


def money_sum(c: Column) -> Column:
    return F.coalesce(F.sum(money(c)), F.lit(0)).cast("double")


def as_date(d: str | date | Column) -> Column:
    if isinstance(d, Column):
        return d
    return F.lit(str(d)).cast("date") if isinstance(d, str) else F.lit(d)


def month_of(c: Column) -> Column:
    return F.trunc(c, "month")


def months_after(c: Column, n: int | Column) -> Column:
    return F.add_months(c, n)


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b where b > 0, else a default."""
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def count_of(cond: Column) -> Column:
    return F.count_if(cond)


def clip(c: Column, low=None, high=None) -> Column:
    """Bound a column; nulls stay null (greatest/least alone would ignore them)."""
    out = c
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def series_labels(keys: Sequence[str]) -> Column:
    """Array of the series a row belongs to: ALL and, if every key is known, its own segment.

    One label stands for one segment: with several keys, ``|`` and backslash in a value are escaped by
    a backslash; with one key, values that read like ALL or like a prefixed value get the key before them."""
    if not keys:
        return F.array(F.lit(ALL))
    if len(keys) == 1:
        k = F.col(keys[0])
        own = F.when((k == ALL) | F.startswith(k.cast("string"), F.lit(f"{keys[0]}=")), F.concat(F.lit(f"{keys[0]}="), k)).otherwise(k)
    else:
        plain = lambda k: F.replace(F.replace(F.col(k).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        own = F.concat_ws("|", *[F.concat(F.lit(f"{k}="), plain(k)) for k in keys])
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return F.array_compact(F.array(F.lit(ALL), F.when(known, own)))


def label_of(stage: Column) -> Column:
    """snake_case -> Title Case."""
    return F.initcap(F.replace(stage, F.lit("_"), F.lit(" ")))
