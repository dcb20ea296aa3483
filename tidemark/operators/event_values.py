"""Values of point-in-time events: sixteen features from titles, sources and numbers, and ten of macro releases."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp

#: Terms by which titles are told apart (fixed values); a title has one where it stands anywhere in it.
TERMS = {
    "macro": (
        "rate hike", "inflation", "war", "tariff", "sanction", "central bank", "geopolitical", "recession", "利率", "通胀", "战争", "制裁", "衰退",
    ),
    "positive": (
        "guidance raised", "guidance upgrade", "upgraded", "record revenue", "record profit", "profit rises", "earnings beat", "strong growth", "contract awarded", "contract win",
        "approved", "approval granted", "grant awarded", "buy-back", "buyback", "dividend increase", "high-grade", "commences production", "production commenced", "successful",
        "milestone achieved", "上调指引", "业绩增长", "中标", "获批", "回购", "增派股息",
    ),
    "negative": (
        "guidance lowered", "guidance downgrade", "downgraded", "profit warning", "earnings miss", "impairment", "default", "insolvency", "administration", "delay", "cancelled", "canceled",
        "investigation", "litigation", "class action", "trading suspension", "trading halt", "production halt", "weak trading", "revenue decline", "loss widens", "breach",
        "下调指引", "业绩预警", "亏损扩大", "调查", "诉讼", "停牌", "违约",
    ),
    "dilution": (
        "placement", "entitlement offer", "rights issue", "capital raising", "capital raise", "issue of shares", "application for quotation of securities", "unquoted securities",
        "convertible note", "share purchase plan", "securities issued", "配股", "增发", "可转债",
    ),
    "regulatory": (
        "regulatory", "asic", "accc", "court", "legal proceedings", "investigation", "litigation", "class action", "compliance breach", "show cause", "penalty", "fine", "监管", "调查", "诉讼", "处罚",
    ),
    "earnings": (
        "earnings", "results", "statutory accounts", "annual report", "half year report", "quarterly activities", "cash flow report", "trading update", "guidance", "revenue", "profit",
        "业绩", "财报", "年报", "季报", "营收", "利润", "指引",
    ),
    "payout": (
        "buy-back", "buyback", "dividend", "distribution", "special dividend", "capital return", "回购", "股息", "分红",
    ),
    "operations": (
        "contract", "order", "project", "production", "drilling", "resource", "reserve", "study", "approval", "licence", "license", "customer", "patent", "trial", "development", "acquisition",
        "divestment", "disposal", "合作", "项目", "订单", "产量", "资源量", "获批", "收购", "出售",
    ),
    "administrative": (
        "director's interest", "directors interest", "substantial holding", "substantial holder", "unquoted securities", "application for quotation", "cessation of securities", "securities on issue",
        "notice of meeting", "proxy form", "change of address", "notification regarding", "appendix 3", "董事权益", "股东大会通知",
    ),
}
#: Words that stand for a sentiment (fixed values).
BULLISH, BEARISH = ("positive", "bullish", "利好", "看多"), ("negative", "bearish", "利空", "看空")
EVENT = (
    "event_sentiment", "event_relevance", "event_novelty", "announcement_score", "fundamental_quality", "macro_risk", "source_quality", "freshness_score", "positive_catalyst", "negative_catalyst",
    "dilution_risk", "regulatory_risk", "earnings_event", "capital_allocation", "operational_momentum", "event_intensity",
)
MACRO = (
    "macro_rates_impulse", "macro_inflation_impulse", "macro_labor_impulse", "macro_growth_impulse", "macro_volatility_impulse", "macro_credit_impulse", "macro_yield_curve_impulse", "macro_fx_impulse",
    "macro_commodity_impulse", "macro_data_coverage",
)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All terms of all lists in one automaton, each with the bits of its lists."""
    bits: dict[str, int] = {}
    for i, terms in enumerate(TERMS.values()):
        for t in terms:
            bits[t] = bits.get(t, 0) | 1 << i
    out = ahocorasick.Automaton()
    for t, b in bits.items():
        out.add_word(t, b)
    out.make_automaton()
    return out


def lists_in(title: str | None) -> int:
    """A bit for each list of TERMS that has a term in the (lower-cased) title."""
    found = 0
    for _, bits in automaton().iter(title or ""):
        found |= bits
    return found


def normalised(raw: Column, fallback: Column | float) -> Column:
    """A number held in [-1, 1]; beyond 1 it counts as per cent; the fallback where it is none."""
    v = raw.try_cast("double")
    v = F.when(~F.isnan(v), v)
    return F.coalesce(clamp(F.when(F.abs(v) > 1, v / 100).otherwise(v), -1.0, 1.0), fallback if isinstance(fallback, Column) else F.lit(float(fallback)))


def sentiment(raw: Column) -> Column:
    word = F.lower(F.trim(raw.cast("string")))
    return F.when(word.isin(*BULLISH), 1.0).when(word.isin(*BEARISH), -1.0).otherwise(normalised(raw, 0.0))


def event_values(df: DataFrame, dataset: str, title: str, source: str, given: dict[str, str] | None = None) -> DataFrame:
    """df with the columns EVENT and MACRO.

    All terms are looked for in one pass over each title. `given` names columns that hold what a record says itself: sentiment (a number or a
    word), truth, relevance, novelty, profit_margin, growth, macro values by their names, and values that take a feature's place, as
    "override:<feature>". Null titles have no terms; null datasets are none of the known ones; macro values are null for other datasets.
    """
    given = given or {}

    @F.pandas_udf("int")
    def found(titles: pd.Series) -> pd.Series:
        return titles.map(lists_in).astype("int32")

    raw = lambda n: F.col(given[n]) if n in given else F.lit(None).cast("string")
    d = df.withColumn("bits_", found(F.lower(F.coalesce(F.col(title), F.lit("")))))
    has = {n: F.col("bits_").bitwiseAND(F.lit(1 << i)) != 0 for i, n in enumerate(TERMS)}
    kind, text = F.coalesce(F.col(dataset), F.lit("")), F.lower(F.coalesce(F.col(source), F.lit("")))
    official = kind.isin("news", "financial_disclosures") & (F.contains(text, F.lit("asx")) | F.contains(text, F.lit("exchange-announcement")))
    admin, macro, books = has["administrative"], kind == "macro", kind.isin("fundamentals", "financial_disclosures")
    when = lambda *pairs, other=0.0: _cases(pairs, other)
    inferred = when((has["positive"] & ~has["negative"], 1.0), (has["negative"] & ~has["positive"], -1.0))
    told = sentiment(raw("sentiment"))
    n = sum((has[k].cast("int") for k in ("earnings", "operations", "dilution", "regulatory")), F.lit(0))
    relevance = when((official, 1.0), (kind == "news", 0.35), other=0.75)
    values = {
        "event_sentiment": F.when(F.abs(told) > 1e-12, told).otherwise(inferred),
        "event_relevance": normalised(raw("relevance"), F.when(admin, F.least(relevance, F.lit(0.30))).otherwise(relevance)),
        "event_novelty": normalised(raw("novelty"), when((official & ~admin, 0.80), (admin, 0.15), other=0.35)),
        "announcement_score": when(((official & ~admin) | has["earnings"] | has["operations"], 1.0), (admin, 0.15)),
        "fundamental_quality": F.when(books, clamp(normalised(raw("profit_margin"), 0.0) * 0.55 + normalised(raw("growth"), 0.0) * 0.45, -1.0, 1.0)).otherwise(0.0),
        "macro_risk": when((has["macro"], -1.0)),
        "source_quality": normalised(raw("truth"), when((official | books | macro, 1.0), (kind == "news", 0.55), other=0.45)),
        "freshness_score": F.lit(1.0),
        "positive_catalyst": when((has["positive"], 1.0)), "negative_catalyst": when((has["negative"], 1.0)), "dilution_risk": when((has["dilution"], 1.0)), "regulatory_risk": when((has["regulatory"], 1.0)), "earnings_event": when((has["earnings"], 1.0)),
        "capital_allocation": when((has["payout"] & ~has["dilution"], 1.0), (has["dilution"] & ~has["payout"], -1.0)),
        "operational_momentum": F.when(has["operations"], inferred).otherwise(0.0),
        "event_intensity": F.when(macro, 0.35).when(official, F.when(admin, 0.20).otherwise(F.least(F.lit(1.0), 0.45 + 0.15 * n))).when(F.coalesce(F.col(title), F.lit("")) != "", 0.30 + 0.15 * n).otherwise(0.0),
        **{m: F.when(macro, normalised(raw(m), 0.0)) for m in MACRO},
    }
    own = {n: normalised(raw(f"override:{n}"), c) if f"override:{n}" in given else c for n, c in values.items()}
    return d.withColumns(own).drop("bits_")


def _cases(pairs: tuple[tuple[Column, float], ...], other: float) -> Column:
    out = F.lit(float(other))
    for condition, value in reversed(pairs):
        out = F.when(condition, float(value)).otherwise(out)
    return out
