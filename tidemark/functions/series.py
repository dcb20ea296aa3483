"""Functions over ordered series: frames, ranks, moments and recurrences as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def order_key(*columns: tuple[str | Column, int]) -> Column:
    """One exact number that orders rows like their columns, given with the digits that each needs (38 in all).

    min_by and max_by over a number aggregate by hash; over a struct they sort all rows.
    """
    out, left = None, sum(digits for _, digits in columns)
    for column, digits in columns:
        left -= digits
        c = (F.col(column) if isinstance(column, str) else column).cast(f"decimal({digits},0)")
        part = c * F.lit(str(10**left)).cast(f"decimal({left + 1},0)") if left else c
        out = part if out is None else out + part
    return out.cast("decimal(38,0)")


def moment_key(ts: str = "ts", number: str = "trade_id") -> Column:
    """Orders events by time, then by a number."""
    return order_key((F.unix_micros(F.col(ts).cast("timestamp")), 17), (number, 19))


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The last n rows, this one included; fewer at the start."""
    return w.rowsBetween(-(n - 1), 0)


def before(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before this one."""
    return w.rowsBetween(-n, -1)


def ahead(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows after this one."""
    return w.rowsBetween(1, n)


def average_rank(value: str | Column, by: list[str]) -> Column:
    """Rank from 1 in which ties share their mean."""
    value = F.col(value) if isinstance(value, str) else value
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / 2.0


def pearson(x: Column, y: Column, least: int = 3) -> Column:
    """Correlation as an aggregate; 0 for fewer than `least` pairs or a constant side.

    Spark's corr() raises in ANSI mode on constants, so the moments are written out.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count(a)
    # var_pop and covar_pop are numerically stable, unlike sums of products
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when((n >= least) & (spread > 1e-12), F.covar_pop(a, b) / spread).otherwise(F.lit(0.0))


EMA_BLOCK, EMA_BACK = 128, 6


def ema(df: DataFrame, value: str, span: int, by: list[str], order: list[str], out: str) -> DataFrame:
    """Exponential average seeded with the first value, alpha = 2 / (span + 1), without a fold.

    The recurrence y = a x + q y' is cut into blocks of 128 rows. In a block it is a running sum
    of x q^-i, which can't overflow; the values at the ends of the last blocks, weighted by powers
    of q, carry over what came before. Six blocks back weigh below 1e-12 for spans up to 50.
    """
    if span > 50:
        raise ValueError("span over 50 needs more blocks")
    a = 2.0 / (span + 1)
    q = 1 - a
    w = ordered(by, order)
    df = df.withColumn("pos_", F.row_number().over(w) - 1).withColumns({"block_": F.floor(F.col("pos_") / EMA_BLOCK), "i_": F.pmod("pos_", F.lit(EMA_BLOCK))})
    x = F.when(F.col("pos_") == 0, F.col(value) / a).otherwise(F.col(value))
    inside = Window.partitionBy(*by, "block_").orderBy("pos_").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("local_", a * F.pow(F.lit(q), F.col("i_")) * F.sum(x * F.pow(F.lit(q), -F.col("i_"))).over(inside))
    carry = F.lit(0.0)
    for j in range(1, EMA_BACK + 1):
        back = Window.partitionBy(*by).orderBy("block_").rangeBetween(-j, -j)
        end = F.max(F.when(F.col("i_") == EMA_BLOCK - 1, F.col("local_"))).over(back)
        carry = carry + F.coalesce(end, F.lit(0.0)) * q ** (EMA_BLOCK * (j - 1))
    return df.withColumn(out, F.col("local_") + F.pow(F.lit(q), F.col("i_") + 1) * carry).drop("pos_", "block_", "i_", "local_")
