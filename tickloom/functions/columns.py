"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Plan-time check; costs no job."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def ratio(a: Column, b: Column, otherwise=None) -> Column:
    """a / b, or ``otherwise`` (null by default) where b is 0 or null."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(otherwise).cast("double"))


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE 754 has it: infinite or NaN where b is 0, null where either is null."""
    over = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b != 0, a / F.when(b != 0, b)).when(b == 0, over.otherwise(a))


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b) of prices of 0 or more: -infinity for a = 0, infinity for b = 0, NaN for both."""
    q = quotient(a, b)
    return F.when(q == 0, float("-inf")).otherwise(F.log(q))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def pick(rules: list[tuple[Column, object]], default) -> Column:
    """First matching rule wins."""
    out = None
    for cond, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def add(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def minutes_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def order_key(ts: str, seq: str) -> Column:
    """(time, sequence) as one fixed-width number, so that min_by/max_by stay in hash aggregation."""
    return F.unix_micros(F.col(ts)).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col(seq)


def safe_tanh(x: Column, scale: Column, eps: float = 1e-15) -> Column:
    """tanh(x/scale), 0 where the scale is degenerate, null where x is null."""
    return F.when(x.isNull(), F.lit(None).cast("double")).when(
        scale >= F.lit(eps), F.tanh(x / F.when(scale >= F.lit(eps), scale))
    ).otherwise(F.lit(0.0))


def corr_over(x: Column, y: Column, w: WindowSpec) -> tuple[Column, Column, Column]:
    """Population covariance and standard deviations over a frame (never raises on constants)."""
    return F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w), F.stddev_pop(y).over(w)


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)
