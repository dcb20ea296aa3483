"""Queries on paper agents, policies, providers and universe samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import agents as op
from tidemark.plans.registry import query, r, r6
from tidemark.sources import tables

#: Customers as agents, their orders as positions.
AGENTS = ["c_custkey AS agent", "c_nationkey AS generation", "100000.0 AS initial_capital", "c_acctbal * 15 + 90000 AS equity", "c_acctbal * 4 AS cash", "c_custkey % 9 AS closed_trades", "c_custkey % 5 AS wins", "c_custkey % 4 AS losses", "c_custkey % 7 AS positions"]
POSITIONS = ["o_custkey AS agent", "concat('S', CAST(o_orderkey AS STRING)) AS symbol", "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('T', CAST(o_orderkey % 4 AS STRING)) END AS sector", "1.0 * (o_orderkey % 10) AS qty", "o_totalprice / 100 AS price"]


def _agents(spark, sf_dir):
    return tables.table(spark, sf_dir, "customer").selectExpr(*AGENTS)


def _positions(spark, sf_dir):
    return tables.table(spark, sf_dir, "orders").selectExpr(*POSITIONS)


A = f"a AS (SELECT {', '.join(AGENTS)} FROM customer), p AS (SELECT {', '.join(POSITIONS)} FROM orders)"


@query(f"""WITH {A} SELECT generation, count(*) AS agents, sum(closed_trades)::BIGINT AS closed_trades, sum(wins)::BIGINT AS wins, sum(positions)::BIGINT AS positions, {r(equity='sum(equity)', return_pct='(sum(equity) / sum(initial_capital) - 1) * 100', win_rate_pct='coalesce(sum(wins) * 100.0::DOUBLE / nullif(sum(closed_trades), 0), 0)')} FROM a GROUP BY generation""")
def generation_summary(spark, sf_dir):
    return op.generation_summary(_agents(spark, sf_dir), ["generation"]).select("generation", "agents", "closed_trades", "wins", "positions", r6("equity"), r6("return_pct"), r6("win_rate_pct"))


@query(f"""WITH {A}, v AS (SELECT agent, coalesce(nullif(sector, ''), 'Unknown') AS sector, qty * price AS v FROM p), s AS (SELECT agent, sector, sum(v) AS v FROM v GROUP BY ALL), e AS (SELECT agent, greatest(1, equity) AS e, cash FROM a),
h AS (SELECT v.agent, count(*) AS n, max(v) AS top, count_if(v / e > 0.12 + 1e-9) AS ov FROM v JOIN e ON v.agent = e.agent GROUP BY v.agent), t AS (SELECT s.agent, max(v) AS top, count_if(v / e > 0.25 + 1e-9) AS ov FROM s JOIN e ON s.agent = e.agent GROUP BY s.agent),
c AS (SELECT e.agent, coalesce(h.n, 0) AS n, cash / e AS cp, coalesce(h.top, 0) / e AS lp, coalesce(t.top, 0) / e AS sp, coalesce(h.ov, 0) AS ho, coalesce(t.ov, 0) AS so FROM e LEFT JOIN h ON h.agent = e.agent LEFT JOIN t ON t.agent = e.agent)
SELECT agent, n AS positions, ho::INT AS over_positions, so::INT AS over_sectors, {r(cash_pct='cp', largest_pct='lp', sector_pct='sp')}, ((n > 6)::INT + ho + so + (cp + 1e-9 < 0.25)::INT)::INT AS violations, (n > 6)::INT + ho + so + (cp + 1e-9 < 0.25)::INT > 0 AS frozen FROM c""")
def constraint_audit(spark, sf_dir):
    out = op.constraint_audit(_agents(spark, sf_dir), _positions(spark, sf_dir))
    return out.select("agent", "positions", "over_positions", "over_sectors", r6("cash_pct"), r6("largest_pct"), r6("sector_pct"), "violations", "frozen")


STEPS = ["o_custkey AS agent", "o_orderkey AS step", "50000 + o_totalprice / 10 AS equity", "o_totalprice / 20 AS turnover", "o_totalprice / 15 AS largest", "o_orderkey % 3 AS degraded", "o_orderkey % 4 AS valid"]


@query(f"""WITH s AS (SELECT {', '.join(STEPS)} FROM orders), w AS (SELECT *, coalesce(lag(equity) OVER o, equity) AS b, max(equity) OVER (PARTITION BY agent ORDER BY step ROWS UNBOUNDED PRECEDING) AS top, lag(agent) OVER o IS NULL AS fresh FROM s WINDOW o AS (PARTITION BY agent ORDER BY step)),
x AS (SELECT *, coalesce(lag(top) OVER (PARTITION BY agent ORDER BY step), b) AS was FROM w), y AS (SELECT *, (equity - b) / b * 100 AS rr, greatest(0, greatest(0, (top - equity) / top * 100) - greatest(0, (was - b) / was * 100)) * 0.55 AS dp, turnover / equity * 8 AS tp, greatest(0, largest / equity * 100 - 12) * 0.1 AS cp, degraded / greatest(1, valid)::DOUBLE * 0.12 AS gp FROM x)
SELECT agent, step, {r(raw_return='rr', drawdown_penalty='dp', concentration_penalty='cp', reward='rr - dp - tp - cp - gp')} FROM y""")
def agent_rewards(spark, sf_dir):
    out = op.rewards(tables.table(spark, sf_dir, "orders").selectExpr(*STEPS), ["agent"], "step")
    return out.select("agent", "step", *map(r6, ("raw_return", "drawdown_penalty", "concentration_penalty", "reward")))


POLICIES = ["p_brand AS regime", "concat('style-', CAST(p_partkey AS STRING)) AS style", "p_size / CAST(3 AS DOUBLE) AS alpha", "CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 20 / CAST(2 AS DOUBLE) END AS beta", "p_retailprice AS objective", "p_size % 3 = 0 AS eligible"]


@query(f"""WITH p AS (SELECT {', '.join(POLICIES)} FROM part), m AS (SELECT *, greatest(1, alpha) / (greatest(1, alpha) + greatest(1, coalesce(beta, 1))) AS po FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY eligible DESC, round(po, 9) DESC, objective DESC, style) AS rank FROM m)
SELECT regime, style, rank, rank = 1 AND eligible AS selected, {r(posterior='po', behaviour_probability='CASE WHEN eligible THEN po / sum(po) FILTER (WHERE eligible) OVER (PARTITION BY regime) ELSE 0 END')} FROM k""")
def policy_ranking(spark, sf_dir):
    out = op.policy_ranking(tables.table(spark, sf_dir, "part").selectExpr(*POLICIES), ["regime"])
    return out.select("regime", "style", "rank", "selected", r6("posterior"), r6("behaviour_probability"))


ITEMS = ["o_orderkey", "element_at(array('momentum', 'reversion', 'breakout', 'other'), CAST(o_orderkey % 4 AS INT) + 1) AS style", "concat('r', CAST(o_custkey % 5 AS STRING)) AS regime", "o_orderkey % 3 > 0 AS policy_eligible", "o_orderkey % 5 > 0 AS model_eligible", "CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice % 100 / 100 END AS threshold", "o_totalprice % 31 - 15 AS bias"]


@query(f"""WITH i AS (SELECT {', '.join(ITEMS)} FROM orders), s(regime, st) AS (VALUES ('r0', 'momentum'), ('r1', 'breakout'), ('r2', NULL)),
j AS (SELECT i.*, CASE WHEN s.regime IS NOT NULL THEN s.st ELSE 'reversion' END AS ch FROM (SELECT {', '.join(ITEMS).replace('element_at(array(', 'list_extract(list_value(')} FROM orders) i LEFT JOIN s ON s.regime = i.regime)
SELECT o_orderkey, CASE WHEN NOT policy_eligible THEN 'policy' WHEN ch <> style THEN 'other_style' WHEN NOT model_eligible THEN 'model' ELSE 'passed' END AS reason, policy_eligible AND coalesce(ch = style, true) AND model_eligible AS allowed,
{r(threshold="CASE WHEN policy_eligible AND coalesce(threshold, 0) > 0 THEN greatest(50, least(78, threshold * 100)) ELSE greatest(49, least(68, CASE style WHEN 'momentum' THEN 58 WHEN 'reversion' THEN 56 WHEN 'breakout' THEN 60 ELSE 58 END - bias * 0.35)) END")} FROM j""".replace(f"i AS (SELECT {', '.join(ITEMS)} FROM orders), ", ""))
def trade_gate(spark, sf_dir):
    i = tables.table(spark, sf_dir, "orders").selectExpr(*ITEMS)
    selectors = spark.createDataFrame([("r0", "momentum"), ("r1", "breakout"), ("r2", None), ("all", "reversion")], "regime string, selected_style string")
    return op.trade_gate(i, selectors).select("o_orderkey", "reason", "allowed", r6(op.entry_threshold("style", "policy_eligible", "threshold", "bias"), "threshold"))


@query("""WITH c AS (SELECT s_suppkey AS place, CASE s_nationkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'asx' ELSE 'CN' END || CAST(s_suppkey % 11 AS VARCHAR) AS market, CASE s_suppkey % 6 WHEN 0 THEN 'Yahoo-' WHEN 1 THEN 'eodhd-' WHEN 2 THEN 'ibkr-' WHEN 3 THEN 'gdelt-' WHEN 4 THEN 'tiingo-' ELSE 'other-' END || CAST(s_suppkey AS VARCHAR) AS name, s_suppkey % 4 > 0 AS ok FROM supplier),
t AS (SELECT *, CASE place % 6 WHEN 0 THEN 'free' WHEN 3 THEN 'free' WHEN 1 THEN 'limited' WHEN 4 THEN 'limited' WHEN 2 THEN 'licensed' ELSE 'unknown' END AS tier FROM c), g AS (SELECT market, coalesce(min_by(name, place) FILTER (WHERE ok AND tier = 'limited'), min_by(name, place) FILTER (WHERE ok AND tier = 'free'), min_by(name, place) FILTER (WHERE ok AND tier = 'licensed'), min_by(name, place)) AS primary FROM t GROUP BY market)
SELECT g.market, g.primary, coalesce(min_by(t.name, t.place) FILTER (WHERE t.ok AND t.tier = 'free' AND t.name <> g.primary), min_by(t.name, t.place) FILTER (WHERE t.name <> g.primary), '-') AS support, CASE WHEN upper(g.market) = 'US' THEN 4 WHEN upper(g.market) = 'ASX' THEN 2 ELSE 1 END AS limited_cap FROM g JOIN t ON t.market = g.market GROUP BY ALL""".replace("AS primary", 'AS "primary"').replace("g.primary", 'g."primary"'))
def provider_plan(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.element_at(F.array(*map(F.lit, ("Yahoo-", "eodhd-", "ibkr-", "gdelt-", "tiingo-", "other-"))), (k % 6 + 1).cast("int"))
    n = F.col("s_nationkey") % 3
    c = tables.table(spark, sf_dir, "supplier").select(k.alias("place"), F.concat(F.when(n == 0, "US").when(n == 1, "asx").otherwise("CN"), (k % 11).cast("string")).alias("market"), F.concat(name, k.cast("string")).alias("name"), (k % 4 > 0).alias("configured"))
    return op.provider_plan(c).withColumn("support", F.coalesce("support", F.lit("-")))


@query("""WITH d AS (SELECT DISTINCT p_brand AS market, p_partkey AS symbol FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY symbol) - 1 AS pl, count(*) OVER (PARTITION BY market) AS n FROM d)
SELECT market, symbol FROM k WHERE n <= 26 OR pl IN (SELECT ((2 * i + 1) * n) // 52 FROM range(26) t(i))""")
def stratified_symbols(spark, sf_dir):
    d = tables.table(spark, sf_dir, "part").select(F.col("p_brand").alias("market"), F.col("p_partkey").alias("symbol"))
    return op.stratified_symbols(d, ["market"], "symbol", 26)
