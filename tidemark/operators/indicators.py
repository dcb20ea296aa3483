"""Technical indicators as window expressions over bars ordered within a symbol.

Every function adds columns and reads only this row and earlier ones, so that cutting off the
future changes nothing. Windows share one specification: one shuffle and one sort serve all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, pct_change, pct_from
from tidemark.functions.series import before, ema, ordered, trailing

BY, ORDER = ["symbol"], ["day"]


def _w(by: list[str] = BY, order: list[str] = ORDER):
    return ordered(by, order)


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def moving_averages(df: DataFrame, spans: tuple[int, ...] = (5, 20, 50), column: str = "close") -> DataFrame:
    return df.withColumns({f"sma{n}": F.avg(column).over(trailing(_w(), n)) for n in spans})


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """ema_fast, ema_slow, macd, macd_signal, macd_hist."""
    df = ema(ema(df, "close", fast, BY, ORDER, "ema_fast"), "close", slow, BY, ORDER, "ema_slow")
    df = df.withColumn("macd", F.col("ema_fast") - F.col("ema_slow"))
    return ema(df, "macd", signal, BY, ORDER, "macd_signal").withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """rsi: 50 when flat, 100 without losses. rsi_pct: over per-cent returns, 100 whenever there are no losses."""
    df = df.withColumn("d_", F.col("close") - F.lag("close").over(_w())).withColumn("r_", F.coalesce(pct_from(F.lag("close").over(_w()), F.col("close")), F.lit(0.0)))
    t = trailing(_w(), n)
    up, down = F.avg(F.when(F.col("d_").isNotNull(), F.greatest(F.lit(0.0), F.col("d_")))).over(t), F.avg(F.when(F.col("d_").isNotNull(), F.greatest(F.lit(0.0), -F.col("d_")))).over(t)
    gain_pct, loss_pct = F.avg(F.greatest(F.lit(0.0), F.col("r_"))).over(t), F.avg(F.greatest(F.lit(0.0), -F.col("r_"))).over(t)
    df = df.withColumns({"up_": F.coalesce(up, F.lit(0.0)), "down_": F.coalesce(down, F.lit(0.0)), "gp_": gain_pct, "lp_": loss_pct})
    plain = F.when(F.col("down_") <= 1e-9, F.when(F.col("up_") > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + F.col("up_") / F.nullif("down_", F.lit(0.0))))
    pct = F.when(F.col("lp_") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gp_") / F.nullif("lp_", F.lit(0.0))))
    return df.withColumns({"rsi": plain, "rsi_pct": pct}).drop("d_", "r_", "up_", "down_", "gp_", "lp_")


def true_range(df: DataFrame, n: int = 14) -> DataFrame:
    """atr (first row: high - low) and atr_pct (per cent of the close before; rows without one are left out)."""
    prev = F.lag("close").over(_w())
    df = df.withColumn("p_", prev)
    p = F.col("p_")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p))
    df = df.withColumns({"tr_": tr, "trp_": F.when(p > 0, tr / F.nullif(p, F.lit(0.0)) * 100)})
    return df.withColumns({"atr": F.avg("tr_").over(trailing(_w(), n)), "atr_pct": F.coalesce(F.avg("trp_").over(trailing(_w(), n)), F.lit(0.0))}).drop("p_", "tr_", "trp_")


def vwap(df: DataFrame, n: int = 20) -> DataFrame:
    """vwap over all rows so far and vwap_n over the last n; the typical price, or the mean, without volume."""
    total = _w().rowsBetween(Window.unboundedPreceding, 0)
    tp = typical()
    df = df.withColumns({"tp_": tp, "tv_": tp * F.col("volume")})
    return df.withColumns({
        "vwap": F.coalesce(F.try_divide(F.sum("tv_").over(total), F.sum("volume").over(total)), F.col("tp_")),
        f"vwap{n}": F.coalesce(F.try_divide(F.sum("tv_").over(trailing(_w(), n)), F.sum("volume").over(trailing(_w(), n))), F.avg("tp_").over(trailing(_w(), n))),
    }).drop("tp_", "tv_")


def momentum(df: DataFrame, lags: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    return df.withColumns({f"change{n}": pct_change(F.col("close"), F.lag("close", n).over(_w())) for n in lags})


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0, recent: int = 80) -> DataFrame:
    """middle, upper, lower, percent_b, bandwidth_pct, bandwidth_rank_pct, squeeze_score, state."""
    t = trailing(_w(), n)
    df = df.withColumns({"middle": F.avg("close").over(t), "sd_": F.stddev_pop("close").over(t)})
    df = df.withColumns({"upper": F.col("middle") + width * F.col("sd_"), "lower": F.col("middle") - width * F.col("sd_")})
    spread = F.col("upper") - F.col("lower")
    df = df.withColumns({"percent_b": F.when(spread > 0, F.try_divide(F.col("close") - F.col("lower"), spread)).otherwise(F.lit(0.5)), "bandwidth_pct": F.coalesce(F.try_divide(spread, F.col("middle")) * 100, F.lit(0.0))})
    # the windowed array is `recent` numbers wide and lives for one row
    widths = F.collect_list("bandwidth_pct").over(trailing(_w(), recent))
    df = df.withColumn("rank_", widths).withColumn("bandwidth_rank_pct", F.size(F.filter("rank_", lambda x: x <= F.col("bandwidth_pct"))) * 100.0 / F.size("rank_"))
    squeeze = clamp(100 - F.col("bandwidth_rank_pct"), 0.0, 100.0)
    state = F.when(F.col("squeeze_score") >= 75, "squeeze").when(F.col("bandwidth_rank_pct") >= 75, "expansion").otherwise("normal")
    return df.withColumn("squeeze_score", squeeze).withColumn("state", state).drop("sd_", "rank_")


def signed_flow(df: DataFrame) -> DataFrame:
    """imbalance: 0.55 body + 0.45 close location (range at least 0.01 % of the close); flow: weights the other way round."""
    spread = F.greatest(F.col("high") - F.col("low"), F.col("close") * 0.0001)
    tight = F.greatest(F.lit(1e-9), F.col("high") - F.col("low"))
    body, place = clamp((F.col("close") - F.col("open")) / spread, -1.0, 1.0), clamp((F.col("close") - F.col("low")) / spread * 2 - 1, -1.0, 1.0)
    flow = ((F.col("close") - F.col("low")) / tight - 0.5) * 2 * 0.55 + (F.col("close") - F.col("open")) / tight * 0.45
    return df.withColumns({"imbalance": clamp(body * 0.55 + place * 0.45, -1.0, 1.0), "flow": clamp(flow, -1.0, 1.0)})


def volume_ratio(df: DataFrame, n: int = 20) -> DataFrame:
    mean = F.avg("volume").over(trailing(_w(), n))
    return df.withColumn("volume_ratio", F.coalesce(F.try_divide(F.col("volume"), mean), F.lit(0.0))).withColumn("return_pct", F.coalesce(pct_from(F.lag("close").over(_w()), F.col("close")), F.lit(0.0)))


def order_flow(df: DataFrame, n: int = 20) -> DataFrame:
    """pressure, absorption, effort_vs_result over the last n rows, and amihud (illiquidity)."""
    df = volume_ratio(signed_flow(df))
    quiet = (F.col("volume_ratio") >= 1.6) & (F.abs("return_pct") <= 0.45)
    notional = typical() * F.col("volume")
    df = df.withColumns({"ab_": F.when(quiet, F.col("volume_ratio") * (1 - F.abs("return_pct") / 0.45)), "ef_": F.col("volume_ratio") / (F.abs("return_pct") + 0.25), "il_": F.when(notional > 0, F.try_divide(F.abs(F.col("return_pct") / 100), notional))})
    t = trailing(_w(), n)
    return df.withColumns({"pressure": F.avg("imbalance").over(t), "absorption": F.coalesce(F.avg("ab_").over(t), F.lit(0.0)), "effort_vs_result": F.avg("ef_").over(t), "amihud": F.coalesce(F.avg("il_").over(t), F.lit(0.0))}).drop("ab_", "ef_", "il_")


def range_position(df: DataFrame, n: int = 20) -> DataFrame:
    """Place of the close between the extremes of the last n bars (range_pos) and of n + 1 closes (close_pos)."""
    hi, lo = F.max("high").over(trailing(_w(), n)), F.min("low").over(trailing(_w(), n))
    ch, cl = F.max("close").over(trailing(_w(), n + 1)), F.min("close").over(trailing(_w(), n + 1))
    return df.withColumns({"range_pos": (F.col("close") - lo) / F.greatest(F.lit(1e-9), hi - lo), "close_pos": (F.col("close") - cl) / F.greatest(F.lit(1e-9), ch - cl)})


def volume_skew(df: DataFrame, n: int = 20) -> DataFrame:
    """Volume-weighted skewness of the typical price, from weighted moments of its distance to the newest one."""
    df = df.withColumn("tp_", typical())
    t = trailing(_w(), n)
    # centred on each window's own mean, so that third moments don't cancel
    df = df.withColumn("win_", F.collect_list(F.struct(F.col("tp_").alias("p"), F.col("volume").alias("v"))).over(t))
    total = F.aggregate("win_", F.lit(0.0), lambda a, x: a + x["v"])
    mean = F.aggregate("win_", F.lit(0.0), lambda a, x: a + x["p"] * x["v"]) / F.nullif("tot_", F.lit(0.0))
    df = df.withColumn("tot_", total).withColumn("mean_", mean)
    moment = lambda k: F.aggregate("win_", F.lit(0.0), lambda a, x: a + F.pow(x["p"] - F.col("mean_"), F.lit(float(k))) * x["v"]) / F.nullif("tot_", F.lit(0.0))
    df = df.withColumns({"m2_": moment(2), "m3_": moment(3)})
    sd = F.when(F.col("m2_") > 1e-12, F.sqrt("m2_")).otherwise(F.lit(1.0))
    return df.withColumn("volume_skew", F.coalesce(F.col("m3_") / F.pow(sd, F.lit(3.0)), F.lit(0.0))).drop("tp_", "win_", "tot_", "mean_", "m2_", "m3_")


def zscore(df: DataFrame, column: str, out: str, n: int = 60) -> DataFrame:
    t = trailing(_w(), n)
    sd = F.stddev_pop(column).over(t)
    return df.withColumn(out, clamp((F.col(column) - F.avg(column).over(t)) / F.when(sd > 0, sd).otherwise(F.lit(1.0)), -6.0, 6.0))


def rank_pct(df: DataFrame, column: str, out: str, n: int = 60) -> DataFrame:
    """Share of the last n values that are not above this one; 0.5 for a single one."""
    df = df.withColumn("win_", F.collect_list(column).over(trailing(_w(), n)))
    share = F.size(F.filter("win_", lambda x: x <= F.col(column))).cast("double") / F.size("win_")
    return df.withColumn(out, F.when(F.size("win_") <= 1, F.lit(0.5)).otherwise(share)).drop("win_")


def alpha_frame(df: DataFrame) -> DataFrame:
    """The base columns of formulaic alphas."""
    w = _w()
    df = range_position(vwap(true_range(macd(volume_ratio(df)))))
    c, o = F.col("close"), F.col("open")
    spread = F.greatest(F.col("high") - F.col("low"), c * 0.0001)
    back = lambda n: F.coalesce(F.lag("close", n).over(w), F.first("close").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = {
        "momentum_5": pct_from(back(5), c), "momentum_20": pct_from(back(20), c), "trend_gap_20": pct_from(F.avg("close").over(trailing(w, 20)), c),
        "trend_gap_60": pct_from(F.avg("close").over(trailing(w, 60)), c), "vwap_gap": pct_from(F.col("vwap"), c), "volume_ratio_20": F.col("volume_ratio"),
        "volatility_10": F.stddev_pop("return_pct").over(trailing(w, 10)), "range_position_20": F.col("range_pos"),
        "macd_hist_pct": F.col("macd_hist") / F.greatest(c, F.lit(1e-9)) * 100, "atr_pct_14": F.col("atr") / F.greatest(c, F.lit(1e-9)) * 100,
        "candle_body_pressure": (c - o) / spread, "close_location": ((c - F.col("low")) / spread - 0.5) * 2,
        "overnight_gap": F.coalesce(pct_from(F.lag("close").over(w), o), F.lit(0.0)), "intraday_return": pct_from(o, c), "volume_price_impulse": F.col("return_pct") * F.col("volume_ratio"),
    }
    return df.withColumns(out).withColumn("returns", F.col("return_pct"))


def prior_extremes(df: DataFrame, n: int = 10) -> DataFrame:
    return df.withColumns({"prior_high": F.max("high").over(before(_w(), n)), "prior_low": F.min("low").over(before(_w(), n))})


def scores(df: DataFrame) -> DataFrame:
    """trend_score, momentum_score, risk_score, factor_quality, regime: the assembled snapshot of every bar."""
    w = _w()
    df = vwap(rsi(macd(momentum(moving_averages(signed_flow(df))))))
    weigh = lambda n: F.coalesce(F.try_divide(F.sum(F.col("flow") * F.col("volume")).over(trailing(w, n)), F.sum("volume").over(trailing(w, n))), F.avg("flow").over(trailing(w, n)))
    r = F.when(F.lag("close").over(w).isNotNull(), F.col("change1"))
    df = df.withColumn("r_", r).withColumns({
        "volatility": F.coalesce(F.sqrt(F.avg(F.col("r_") * F.col("r_")).over(trailing(w, 20))), F.lit(0.0)), "buy_pressure5": weigh(5), "buy_pressure20": weigh(20),
        "volume_ratio": F.col("volume") / F.greatest(F.lit(1.0), F.avg("volume").over(trailing(w, 20))),
    }).drop("r_")
    trend = clamp(50 + F.when(F.col("close") > F.col("sma20"), 12.0).otherwise(-9.0) + F.when(F.col("sma20") > F.col("sma50"), 11.0).otherwise(-10.0) + clamp(F.col("change20") * 0.62, -9.0, 9.0), 0.0, 100.0)
    pace = clamp(50 + F.col("macd_hist") / F.col("close") * 9200 + (F.col("rsi") - 50) * 0.55 + clamp(F.col("change5"), -6.0, 6.0) * 0.35 + clamp(F.col("change20") * 0.12, -3.0, 3.0), 0.0, 100.0)
    df = df.withColumns({"trend_score": trend, "momentum_score": pace, "risk_score": clamp(82 - F.col("volatility") * 8, 0.0, 100.0), "profile_distance": pct_change(F.col("close"), F.col("vwap20"))})
    factor = clamp((F.col("trend_score") - 50) * 0.18 + (F.col("momentum_score") - 50) * 0.16 + (F.col("risk_score") - 50) * 0.1 + F.col("buy_pressure5") * 8 + clamp(F.col("profile_distance"), -5.0, 5.0) * 0.45, -25.0, 25.0)
    regime = (
        F.when((F.col("risk_score") < 48) | (F.abs("change5") >= 8) | (F.col("volume_ratio") >= 3.2), "volatile")
        .when((F.col("rsi") >= 72) | ((F.col("change5") >= 6) & (F.col("trend_score") >= 60)), "overextended")
        .when((F.col("trend_score") >= 62) & (F.col("momentum_score") >= 56) & (F.col("change20") >= 2), "uptrend")
        .when((F.col("trend_score") <= 42) & (F.col("change20") <= -2), "downtrend")
        .when((F.col("volume_ratio") >= 1.35) & (F.col("change5") >= 0) & (F.col("momentum_score") >= 52), "volume_breakout")
        .otherwise("range")
    )
    return df.withColumns({"factor_quality": factor, "regime": regime})
