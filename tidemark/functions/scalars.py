"""Scalar column functions. All of them stay in the JVM and never raise on bad values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Two-sided normal quantiles for 90 % and 80 %.
Z90, Z80 = 1.6448536269514722, 1.2815515655446004


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def number(x: Column | str, fallback: float | None = 0.0) -> Column:
    """A finite double, or the fallback: unparsable, NaN and infinite values count as missing."""
    value = _col(x).try_cast("double")
    return F.coalesce(F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value), F.lit(fallback).cast("double"))


def first_nonzero(*columns: Column | str) -> Column:
    """The first value that is neither missing nor 0: what an alias chain with `or` gives."""
    return F.coalesce(*(F.nullif(_col(c), F.lit(0.0)) for c in columns))


def clamp(x: Column | str, low: Column | float, high: Column | float) -> Column:
    """Null stays null; greatest/least alone would skip it."""
    x = _col(x)
    return F.when(x.isNotNull(), F.greatest(_col(low), F.least(_col(high), x)))


def pct_from(start: Column | str, end: Column | str) -> Column:
    """Per cent from start to end; 0 unless start is above 0."""
    start, end = _col(start), _col(end)
    return F.when(start > 0, (F.try_divide(end, start) - 1) * 100).otherwise(F.lit(0.0))


def pct_change(current: Column | str, previous: Column | str) -> Column:
    """Per cent by which current differs from previous; 0 if previous is 0 or missing."""
    current, previous = _col(current), _col(previous)
    return F.coalesce(F.try_divide(current - previous, previous) * 100, F.lit(0.0))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -24.0, 24.0)))


def logit(p: Column | str) -> Column:
    p = clamp(p, 0.001, 0.999)
    return F.ln(p / (1 - p))


def half_life_decay(age: Column | str, half_life: Column | float) -> Column:
    return F.exp(F.lit(-0.6931471805599453) * F.greatest(_col(age), F.lit(0.0)) / _col(half_life))


def wilson(p: Column, n: Column, z: float = Z90) -> tuple[Column, Column]:
    """Lower and upper Wilson bounds for a rate p over n (effective) samples."""
    zz = z * z
    scale = 1 + zz / n
    centre = (p + zz / (2 * n)) / scale
    margin = F.lit(z) * F.sqrt(F.greatest(F.lit(0.0), (p * (1 - p) + zz / (4 * n)) / n)) / scale
    small = n <= 1e-9
    return (F.when(small, p).otherwise(clamp(centre - margin, 0.0, 1.0)), F.when(small, p).otherwise(clamp(centre + margin, 0.0, 1.0)))


def erfc(x: Column | str) -> Column:
    """Complementary error function for x >= 0 by a rational approximation (error below 1.2e-7)."""
    #: Fixed coefficients of the approximation, highest power first.
    powers = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    x = _col(x)
    t = 1 / (1 + 0.5 * x)
    return t * F.exp(-x * x + reduce(lambda acc, c: acc * t + c, powers[1:], F.lit(powers[0])))


def correlation_p_value(r: Column | str, n: Column | str) -> Column:
    """Two-sided p value of a correlation, normal approximation; 1 below four samples."""
    r, n = clamp(r, -0.999999, 0.999999), _col(n)
    t = F.abs(r) * F.sqrt(F.greatest(F.lit(1.0), (n - 2) / F.greatest(F.lit(1e-12), 1 - r * r)))
    return F.when(n < 4, F.lit(1.0)).otherwise(clamp(erfc(t / 2**0.5), 0.0, 1.0))


def iso_timestamp(text: Column | str) -> Column:
    """A timestamp; a bare day counts as its last second; unparsable text is null."""
    text = F.trim(_col(text))
    return F.when(F.length(text) == 10, F.try_to_timestamp(F.concat(text, F.lit(" 23:59:59")), F.lit("yyyy-MM-dd HH:mm:ss"))).otherwise(text.try_cast("timestamp"))


#: Market: time zone, close (minutes after midnight), cost in basis points. Fixed values.
MARKETS = {"US": ("America/New_York", 16 * 60, 12.0), "ASX": ("Australia/Sydney", 16 * 60 + 10, 18.0), "CN": ("Asia/Shanghai", 15 * 60, 20.0)}


def market_close(day: Column | str, market: Column | str) -> Column:
    """UTC time of the market's close on a day, daylight saving included. Sessions are in UTC."""
    day, market = _col(day), _col(market)
    out = F.lit(None).cast("timestamp")
    for name, (zone, minutes, _) in MARKETS.items():
        local = F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + minutes * 60)
        out = F.when(market == name, F.to_utc_timestamp(local, zone)).otherwise(out)
    return out


def cost_pct(market: Column | str) -> Column:
    """Round-trip cost of a market in per cent."""
    out = F.lit(None).cast("double")
    for name, (_, _, bps) in MARKETS.items():
        out = F.when(_col(market) == name, F.lit(bps / 100)).otherwise(out)
    return out


def iso_week(day: Column | str) -> Column:
    """'2024-W05'."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), _col(day)).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(_col(day)).cast("string"), 2, "0"))


def horizon_bucket(horizon: Column | str) -> Column:
    h = _col(horizon)
    return F.when(h <= 7, "short").when(h <= 25, "mid").otherwise("long")


def order_stat(values: Column, index: Column) -> Column:
    """The value at a 0-based index of an array in order; the index is held inside."""
    ordered = F.array_sort(values)
    return F.when(F.size(ordered) > 0, F.element_at(ordered, F.greatest(F.lit(1), F.least(F.size(ordered), index.cast("int") + 1))))


#: SQL functions of the same meaning: name -> (parameters, result, body).
SQL_FUNCTIONS = {
    "tm_number": ("x STRING, fallback DOUBLE", "DOUBLE", "coalesce(CASE WHEN isnan(try_cast(x AS DOUBLE)) OR abs(try_cast(x AS DOUBLE)) = double('inf') THEN NULL ELSE try_cast(x AS DOUBLE) END, fallback)"),
    "tm_clamp": ("x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN x IS NOT NULL THEN greatest(low, least(high, x)) END"),
    "tm_pct_from": ("start_ DOUBLE, end_ DOUBLE", "DOUBLE", "CASE WHEN start_ > 0 THEN (try_divide(end_, start_) - 1) * 100 ELSE 0D END"),
    "tm_pct_change": ("current_ DOUBLE, previous_ DOUBLE", "DOUBLE", "coalesce(try_divide(current_ - previous_, previous_) * 100, 0D)"),
    "tm_sigmoid": ("x DOUBLE", "DOUBLE", "1 / (1 + exp(-greatest(-24D, least(24D, x))))"),
    "tm_half_life_decay": ("age DOUBLE, half_life DOUBLE", "DOUBLE", "exp(-ln(2D) * greatest(age, 0D) / half_life)"),
    "tm_iso_week": ("day DATE", "STRING", "concat(cast(extract(YEAROFWEEK FROM day) AS STRING), '-W', lpad(cast(weekofyear(day) AS STRING), 2, '0'))"),
}


def register_all(spark: SparkSession) -> list[str]:
    """Makes the functions callable from spark.sql(); they are SQL functions, so Catalyst inlines them."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(SQL_FUNCTIONS)
