"""Queries on the training panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dataset as op
from tidemark.operators import event_values as events_op
from tidemark.functions.scalars import cost_pct
from tidemark.plans.indicator_queries import ATR_SQL
from tidemark.plans.registry import BARS_SQL, query, r, r6
from tidemark.sources import tables
from tidemark.streaming import paper

HORIZONS = [3, 10, 20]
W = "PARTITION BY symbol ORDER BY day"


def _dataset(spark, sf_dir):
    return op.market_dataset(tables.bars(spark, sf_dir), HORIZONS, 8.0, 5.0, cost_pct("market"))


_RANK = lambda c: f"CASE WHEN count(*) OVER g > 1 THEN (row_number() OVER (PARTITION BY market, day, hz ORDER BY {c}, symbol) - 1)::DOUBLE / (count(*) OVER g - 1) ELSE 0.5 END"


@query(f"""WITH {BARS_SQL}, {ATR_SQL}, hz AS (SELECT unnest([3, 10, 20]) AS hz),
bar AS (SELECT *, lead(open) OVER ({W}) AS entry, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY symbol) AS n, (close / lag(close, 5) OVER ({W}) - 1) * 100 AS m5 FROM atr),
md AS (SELECT symbol, quantile_cont(volume, 0.5) AS md FROM bars WHERE volume > 0 GROUP BY symbol),
sg AS (SELECT bar.*, hz, least(greatest(8 * 1.8, 1.5), greatest(greatest(0.6, 8 * 0.55), greatest(8 * 0.55, greatest(0.15, atr_pct) * (2.35 * sqrt(hz::DOUBLE / 15))))) AS t, least(greatest(5 * 1.6, 1.0), greatest(greatest(0.5, 5 * 0.55), greatest(5 * 0.55, greatest(0.15, atr_pct) * (1.65 * sqrt(hz::DOUBLE / 15))))) AS s
  FROM bar, hz WHERE rn > 55 AND n >= 70 AND rn + hz <= n AND entry > 0),
f AS (SELECT a.symbol, a.day, a.hz, a.t, a.s, b.rn - a.rn AS bar, (b.high - a.entry) / a.entry * 100 AS u, (b.low - a.entry) / a.entry * 100 AS d, (b.close - a.entry) / a.entry * 100 AS c FROM sg a JOIN bar b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + a.hz),
o AS (SELECT symbol, day, hz, t, s, greatest(0, max(u)) AS up, least(0, min(d)) AS dn, last(c ORDER BY bar) AS rt, first(CASE WHEN u >= t AND d <= -s THEN 'ambiguous' WHEN u >= t THEN 'target' ELSE 'stop' END ORDER BY bar) FILTER (WHERE u >= t OR d <= -s) AS event FROM f GROUP BY ALL),
x AS (SELECT o.*, sg.market, m5, rn, n, sg.volume, rt - CASE sg.market WHEN 'US' THEN 0.12::DOUBLE WHEN 'ASX' THEN 0.18::DOUBLE ELSE 0.2::DOUBLE END AS net, coalesce(up >= o.t AND (NOT dn <= -o.s OR event = 'target'), false) AS tw, coalesce(dn <= -o.s AND (NOT up >= o.t OR event = 'stop'), false) AS sw FROM o JOIN sg ON sg.symbol = o.symbol AND sg.day = o.day AND sg.hz = o.hz),
k AS (SELECT *, {_RANK('net')} AS rr, {_RANK('m5')} * 2 - 1 AS r5, avg(CAST(m5 > 0 AS INT)) OVER g AS br FROM x WINDOW g AS (PARTITION BY market, day, hz))
SELECT market, symbol, day, hz AS horizon, CASE WHEN event = 'ambiguous' THEN 3 WHEN sw THEN 0 WHEN tw THEN 2 ELSE 1 END AS barrier_class, CAST(net > 0 AS INT) AS direction,
{r(target_pct='t', stop_pct='s', forward_return='net', max_upside='up', max_drawdown='dn', return_rank='rr', relevance='3 * CASE WHEN tw THEN 3 WHEN sw THEN 0 WHEN net > 0 THEN 2 ELSE 1 END + 2 * rr', rank_change5='r5', breadth='br')} FROM k""")
def market_dataset_labels(spark, sf_dir):
    """Barriers, outcomes, ranks and relevance of the panel at three horizons."""
    return _dataset(spark, sf_dir).select(*op.KEY, "barrier_class", "direction", *map(r6, ("target_pct", "stop_pct", "forward_return", "max_upside", "max_drawdown", "return_rank", "relevance", "rank_change5", "breadth")))


@query()
def market_dataset(spark, sf_dir):
    """The whole panel with its weights; a test compares the balance with a direct computation."""
    return _dataset(spark, sf_dir)


@query()
def market_dataset_version(spark, sf_dir):
    """Rows and version of each market's panel; a test checks that order and partitions don't matter and values do."""
    return op.version(_dataset(spark, sf_dir))


#: One term of each list, so that every document's title names some of them.
NAMED = [terms[0] for terms in events_op.TERMS.values()] + ["buyback", "unquoted securities", "guidance raised; class action", "plain"]
DATASETS = ["news", "social", "fundamentals", "financial_disclosures", "macro"]
SOURCES = ["ASX-feed", "wire", "exchange-announcement"]
RECORD = {
    "sentiment": "CASE WHEN doc_id % 7 = 0 THEN 'Bullish' WHEN doc_id % 7 = 1 THEN '-0.4' WHEN doc_id % 7 = 2 THEN '45' WHEN doc_id % 7 = 3 THEN 'none' END", "relevance": "CASE WHEN doc_id % 4 = 0 THEN n_chars % 120 END", "truth": "CASE WHEN doc_id % 6 = 0 THEN 0.9 END",
    "profit_margin": "doc_id % 50", "growth": "CASE WHEN doc_id % 2 = 0 THEN doc_id % 30 - 15 END", "override:event_novelty": "CASE WHEN doc_id % 11 = 0 THEN 66 END", "macro_rates_impulse": "doc_id % 9 - 4", "macro_fx_impulse": "doc_id % 300",
}


def _pick(values: list[str], by: str, list_: str, get: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"{get}({list_}({quoted}), CAST({by} % {len(values)} AS INT) + 1)"


def _event_sql() -> str:
    number = lambda c, other: f"CASE WHEN try_cast({c} AS DOUBLE) IS NULL THEN {other} ELSE greatest(-1, least(1, CASE WHEN abs(try_cast({c} AS DOUBLE)) > 1 THEN try_cast({c} AS DOUBLE) / 100 ELSE try_cast({c} AS DOUBLE) END)) END"
    flags = ", ".join("len([x FOR x IN [" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + f"] IF contains(title, x)]) > 0 AS \"{n}\"" for n, terms in events_op.TERMS.items())
    raw = ", ".join(f'{e} AS "{n}"' for n, e in RECORD.items())
    n = "(CAST(earnings AS INT) + CAST(operations AS INT) + CAST(dilution AS INT) + CAST(regulatory AS INT))"
    rel = "CASE WHEN official THEN 1.0 WHEN kind = 'news' THEN 0.35 ELSE 0.75 END"
    macro = {m: f"CASE WHEN kind = 'macro' THEN {number(m, 0.0) if m in RECORD else '0.0'} ELSE -9 END" for m in events_op.MACRO}
    values = {
        "event_sentiment": "CASE WHEN abs(told) > 1e-12 THEN told ELSE inferred END", "event_relevance": number("relevance", f"CASE WHEN administrative THEN least({rel}, 0.3) ELSE {rel} END"),
        "event_novelty": number('"override:event_novelty"', "CASE WHEN official AND NOT administrative THEN 0.8 WHEN administrative THEN 0.15 ELSE 0.35 END"), "announcement_score": "CASE WHEN (official AND NOT administrative) OR earnings OR operations THEN 1.0 WHEN administrative THEN 0.15 ELSE 0 END",
        "fundamental_quality": f"CASE WHEN kind IN ('fundamentals', 'financial_disclosures') THEN greatest(-1, least(1, {number('profit_margin', 0.0)} * 0.55 + {number('growth', 0.0)} * 0.45)) ELSE 0 END", "macro_risk": "CASE WHEN macro THEN -1 ELSE 0 END",
        "source_quality": number("truth", "CASE WHEN official OR kind IN ('fundamentals', 'financial_disclosures', 'macro') THEN 1.0 WHEN kind = 'news' THEN 0.55 ELSE 0.45 END"), "freshness_score": "1.0",
        **{k: f"CAST({c} AS INT)" for k, c in (("positive_catalyst", "positive"), ("negative_catalyst", "negative"), ("dilution_risk", "dilution"), ("regulatory_risk", "regulatory"), ("earnings_event", "earnings"))},
        "capital_allocation": "CASE WHEN payout AND NOT dilution THEN 1 WHEN dilution AND NOT payout THEN -1 ELSE 0 END", "operational_momentum": "CASE WHEN operations THEN inferred ELSE 0 END",
        "event_intensity": f"CASE WHEN kind = 'macro' THEN 0.35 WHEN official THEN CASE WHEN administrative THEN 0.2 ELSE least(1.0, 0.45 + 0.15 * {n}) END WHEN title <> '' THEN 0.3 + 0.15 * {n} ELSE 0 END", **macro,
    }
    return f"""WITH d AS (SELECT doc_id, {_pick(DATASETS, 'doc_id', 'list_value', 'list_extract')} AS kind, lower({_pick(SOURCES, 'doc_id', 'list_value', 'list_extract')}) AS src, lower(coalesce(text, '') || ' ' || {_pick(NAMED, 'doc_id', 'list_value', 'list_extract')}) AS title, {raw} FROM documents),
e AS (SELECT *, kind IN ('news', 'financial_disclosures') AND (contains(src, 'asx') OR contains(src, 'exchange-announcement')) AS official, {flags} FROM d),
f AS (SELECT *, CASE WHEN positive AND NOT negative THEN 1.0 WHEN negative AND NOT positive THEN -1.0 ELSE 0.0 END AS inferred, CASE WHEN lower(sentiment) = 'bullish' THEN 1.0 ELSE {number('sentiment', 0.0)} END AS told FROM e)
SELECT doc_id, {r(**values)} FROM f"""


@query(_event_sql())
def event_values(spark, sf_dir):
    """Sixteen event and ten macro values of every document taken as an event."""
    title = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.expr(_pick(NAMED, "doc_id", "array", "element_at").replace("''", "\\'")))
    d = tables.table(spark, sf_dir, "documents").selectExpr("*", *(f"{e} AS `{n}`" for n, e in RECORD.items()), f"{_pick(DATASETS, 'doc_id', 'array', 'element_at')} AS kind", f"{_pick(SOURCES, 'doc_id', 'array', 'element_at')} AS src").withColumn("title", title)
    out = events_op.event_values(d, "kind", "title", "src", {n: n for n in RECORD})
    return out.select("doc_id", *(r6(F.coalesce(F.col(c), F.lit(-9.0)), c) for c in (*events_op.EVENT, *events_op.MACRO)))


@query()
def paper_trades(spark, sf_dir):
    """Trades of five agents over all bars, with money, limits and streaks as state; tests compare with a stream and by hand."""
    agent = F.explode(F.array(*(F.struct(F.lit(f"agent-{i}").alias("agent"), F.lit(i).alias("style")) for i in range(5))))
    d = tables.bars(spark, sf_dir).withColumn("a", agent).select("*", "a.*")
    score = F.pmod(F.floor(F.col("volume") * 7) + F.col("style") * 13, F.lit(100)).cast("double")
    return paper.trades(d.select(
        "agent", F.col("day").cast("timestamp").alias("ts"), F.concat_ws("|", "agent", F.col("day").cast("string"), "symbol").alias("event_id"), "symbol", "sector", F.col("close").alias("price"), score.alias("score"),
        (F.lit(60.0) + F.col("style")).alias("threshold"), (F.pmod("trade_count", F.lit(7)) > 0).alias("allowed"), F.lit(4.0).alias("stop"), F.lit(6.0).alias("take"), (F.lit(30.0) + F.col("style")).alias("exit_score"), F.lit(15.0).alias("hold_days"), cost_pct("market").alias("cost_pct")))
