"""Scalar arithmetic with the null rules the analytics rely on: a comparison or ratio on missing input stays missing,
division by zero is missing, and clipping keeps missing values missing."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den, missing when den is 0 or missing."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def ratio_pos(num: Column, den: Column) -> Column:
    """num / den, missing unless den > 0."""
    return num.cast("double") / F.when(den > 0, den.cast("double"))


def clip_upper(x: Column, cap: float) -> Column:
    return F.when(x.isNotNull(), F.least(x, F.lit(float(cap))))


def clip(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def capped_ratio(num: Column, den: Column, cap: float = 5.0) -> Column:
    return clip_upper(ratio_pos(num, den), cap)


def sym_growth(new: Column, old: Column) -> Column:
    """(new - old) / (new + old): within [-1, 1], missing when the sum is not positive."""
    total = (new + old).cast("double")
    return F.when(total > 0, (new - old).cast("double") / F.when(total > 0, total))


def sym_to_change(s: Column) -> Column:
    """Symmetric growth back to an ordinary relative change; missing at or above 1."""
    return F.when(s < 1, (1 + s) / F.nullif(1 - s, F.lit(0.0)) - 1)


def scale_odds(p: Column, factor: Column | float) -> Column:
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return p * f / (1 - p + p * f)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def xlogx(p: Column, eps: float = 1e-12) -> Column:
    return p * F.log(F.least(F.greatest(p, F.lit(eps)), F.lit(1.0)))


def mean_skip_null(cols: list[Column]) -> Column:
    """Row mean over the non-missing inputs; missing when all are missing."""
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    s = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    return s / F.nullif(n, F.lit(0))


def sum_min1(cols: list[Column]) -> Column:
    """Row sum over the non-missing inputs; missing when all are missing."""
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    s = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    return F.when(n > 0, s)


def count_present(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])


def row_slope(oldest_first: list[Column]) -> Column:
    """Least-squares slope over equally spaced values; missing when any value is missing."""
    n = len(oldest_first)
    xs = [i - (n - 1) / 2 for i in range(n)]
    sxx = sum(x * x for x in xs)
    return reduce(lambda a, b: a + b, [c.cast("double") * F.lit(x) for c, x in zip(oldest_first, xs)]) / F.lit(sxx)


def row_norm_slope(oldest_first: list[Column]) -> Column:
    n = len(oldest_first)
    mean = reduce(lambda a, b: a + b, [c.cast("double") for c in oldest_first]) / F.lit(float(n))
    return row_slope(oldest_first) / F.when(mean > 0, mean)


def row_cv(cols: list[Column], min_obs: int, mean: Column | None = None) -> Column:
    """Population standard deviation / mean over the non-missing inputs. `mean` may name a column that holds their mean;
    without it the mean is worked out again for every input."""
    mean = mean_skip_null(cols) if mean is None else mean
    n = count_present(cols)
    ss = reduce(lambda a, b: a + b,
                [F.coalesce((c.cast("double") - mean) * (c.cast("double") - mean), F.lit(0.0)) for c in cols])
    return F.when(n >= min_obs, F.sqrt(ss / F.nullif(n, F.lit(0))) / F.when(mean > 0, mean))


def trailing_streak(newest_first: list[Column]) -> Column:
    """How many of the flags hold in a row, starting from the newest; a missing flag counts as false."""
    out = F.lit(len(newest_first))
    for i in range(len(newest_first) - 1, -1, -1):
        out = F.when(~F.coalesce(newest_first[i], F.lit(False)), F.lit(i)).otherwise(out)
    return out


def money_text(v: Column) -> Column:
    """$950, $12K or $3.4M; '-' when missing."""
    a = F.abs(v)
    return (F.when(v.isNull(), F.lit("-"))
            .when(a < 1e3, F.concat(F.lit("$"), F.format_number(F.bround(v, 0), 0)))
            .when(a < 1e6, F.concat(F.lit("$"), F.format_number(F.bround(v / 1e3, 0), 0), F.lit("K")))
            .otherwise(F.concat(F.lit("$"), F.format_number(F.bround(v / 1e6, 1), 1), F.lit("M"))))


def percent_text(v: Column, digits: int = 0, signed: bool = False) -> Column:
    scaled = F.bround(v * 100, digits)
    text = F.format_string(f"%.{digits}f%%", scaled)
    if signed:
        text = F.when(scaled >= 0, F.concat(F.lit("+"), text)).otherwise(text)
    return F.when(v.isNull(), F.lit("-")).otherwise(text)


def json_safe(x: Column) -> Column:
    """NaN and infinities become missing."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
