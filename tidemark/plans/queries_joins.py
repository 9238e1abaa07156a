"""Registered flow, holding, consensus and portfolio queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..operators import aggregates as agg
from ..operators import exposure as ops
from ..operators import news as news_ops
from ..operators.features import estimate_revisions, latest_per_symbol
from ..sources import sample
from .domain_sql import day, r6
from .queries_scoring import _RR
from .registry import query

_LEVELS = ", levels AS (SELECT * FROM watchlist)"


def flow_day(spark: SparkSession, d: str) -> Column:
    """Last month with orders, the latest day that both flows and holdings have."""
    orders = sample.table(spark, d, "orders")
    return orders.agg(F.max(F.last_day(F.col("o_orderdate").cast("date")))).scalar()


@query("stock_flows", tables=("fund_flows", "holdings"), sql="""
SELECT h.symbol, round_even(sum(net_flow * portfolio_weight), 2) AS estimated_flow,
       string_agg(DISTINCT h.fund_code, ',' ORDER BY h.fund_code) AS funds
FROM holdings h JOIN fund_flows f ON h.fund_code = f.fund_code AND h.as_of = f.as_of
WHERE f.as_of = (SELECT max(as_of) FROM fund_flows) GROUP BY h.symbol""")
def stock_flows(spark: SparkSession, d: str) -> DataFrame:
    return ops.stock_flows(sample.fund_flows(spark, d), sample.holdings(spark, d), flow_day(spark, d))


@query("sector_flows_est", tables=("fund_flows", "holdings"), sql="""
SELECT h.sector, round_even(sum(net_flow * portfolio_weight), 2) AS estimated_flow,
       string_agg(DISTINCT h.fund_code, ',' ORDER BY h.fund_code) AS funds
FROM holdings h JOIN fund_flows f ON h.fund_code = f.fund_code AND h.as_of = f.as_of
WHERE f.as_of = (SELECT max(as_of) FROM fund_flows) AND h.sector <> '' GROUP BY h.sector""")
def sector_flows_est(spark: SparkSession, d: str) -> DataFrame:
    return ops.sector_flows_est(sample.fund_flows(spark, d), sample.holdings(spark, d), flow_day(spark, d))


@query("stock_flows_asof", tables=("fund_flows", "holdings"), sql=f"""
, shifted AS (SELECT fund_code, as_of - 10 AS flow_date, net_flow FROM fund_flows),
   snaps AS (SELECT DISTINCT fund_code, as_of AS snapshot FROM holdings),
   m AS (SELECT s.*, p.snapshot FROM shifted s ASOF JOIN snaps p ON s.fund_code = p.fund_code AND s.flow_date >= p.snapshot)
SELECT {day('flow_date')} AS flow_date, symbol, round_even(sum(net_flow * portfolio_weight), 2) AS estimated_flow,
       max(date_diff('day', snapshot, flow_date)) AS max_age_days, count(*) AS positions
FROM m JOIN holdings h ON h.fund_code = m.fund_code AND h.as_of = m.snapshot GROUP BY ALL""")
def stock_flows_asof(spark: SparkSession, d: str) -> DataFrame:
    flows = sample.fund_flows(spark, d).withColumn("as_of", F.date_sub("as_of", 10))
    return ops.stock_flows_asof(flows, sample.holdings(spark, d))


_SIDES = """
, latest AS (SELECT max(as_of) AS cur FROM holdings), prior AS (SELECT max(as_of) AS prev FROM holdings, latest WHERE as_of < cur),
   ch AS (SELECT manager, symbol, coalesce(sum(portfolio_weight) FILTER (as_of = prev), 0) AS previous_weight,
                 coalesce(sum(portfolio_weight) FILTER (as_of = cur), 0) AS current_weight
          FROM holdings, latest, prior WHERE as_of IN (cur, prev) GROUP BY manager, symbol),
   changes AS (SELECT *, current_weight - previous_weight AS change,
                 CASE WHEN previous_weight = 0 AND current_weight > 0 THEN 'NEW' WHEN current_weight = 0 AND previous_weight > 0 THEN 'EXIT'
                      WHEN current_weight - previous_weight > 0.005 THEN 'INCREASE'
                      WHEN current_weight - previous_weight < -0.005 THEN 'DECREASE' ELSE 'STABLE' END AS status FROM ch)
"""


def _last_two(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holdings of the last snapshot and of the one before it."""
    months = held.select("as_of").distinct().orderBy(F.col("as_of").desc()).limit(2)
    last = months.agg(F.max("as_of")).scalar()
    previous = months.agg(F.min("as_of")).scalar()
    return held.filter(F.col("as_of") == previous), held.filter(F.col("as_of") == last)


@query("position_changes", tables=("holdings",), sql=_SIDES + f"""
SELECT manager, symbol, {r6('previous_weight')} AS previous_weight, {r6('current_weight')} AS current_weight,
       {r6('change')} AS change, status FROM changes""")
def position_changes(spark: SparkSession, d: str) -> DataFrame:
    return ops.position_changes(*_last_two(sample.stored_holdings(spark, d)))


@query("attach_watchlist", tables=("bars", "watchlist"), sql=_LEVELS + _RR + f"""
, latest AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1)
SELECT l.symbol, {day('timestamp')} AS timestamp, {r6('close')} AS close, technical_watch_score, {r6('up')} AS target_upside_pct,
       {r6('down')} AS stop_downside_pct, risk_reward FROM latest l LEFT JOIN rr ON rr.symbol = l.symbol""")
def attach_watchlist(spark: SparkSession, d: str) -> DataFrame:
    bars = sample.bars(spark, d)
    base = latest_per_symbol(bars).select("symbol", "timestamp", "close", F.lit(0.0).alias("risk_reward"))
    return ops.attach_watchlist(base, sample.watchlist(bars))


_LAYERS_SQL = """
, flow_l AS (SELECT symbol, least(100.0, greatest(0.0, 50 + 50 * tanh(sum(net_flow * portfolio_weight) / 100000000.0::DOUBLE))) AS smart_money_score
             FROM holdings h JOIN fund_flows f ON h.fund_code = f.fund_code AND h.as_of = f.as_of GROUP BY symbol),
   res_l AS (SELECT symbol, round_even(least(100.0, greatest(0.0, 50 + coalesce(sum(sentiment * coalesce(reliability, 0)) / nullif(sum(coalesce(reliability, 0)), 0), 0) * 50)), 2) AS research_score
             FROM news GROUP BY symbol),
   rev0 AS (SELECT *, estimate / lag(estimate) OVER (PARTITION BY symbol, period ORDER BY observed_at) - 1 AS rev FROM estimates),
   fund_l AS (SELECT symbol, round_even(least(100.0, greatest(0.0, 50 +
                coalesce(max_by(rev, row(period, observed_at)) FILTER (rev IS NOT NULL), 0.0) * 500)), 2) AS fundamental_score
              FROM rev0 GROUP BY symbol)
"""
LAYER_TABLES = ("holdings", "fund_flows", "news", "estimates")


def layers(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Score layers per symbol from flows, research documents and estimate revisions."""
    flows = sample.fund_flows(spark, d).select("as_of", "fund_code", "net_flow")
    allocated = sample.holdings(spark, d).join(flows, ["as_of", "fund_code"])
    total = F.sum(F.col("net_flow") * F.col("portfolio_weight"))
    money = allocated.groupBy("symbol").agg(
        clip(F.lit(50.0) + F.lit(50.0) * F.tanh(total / news_ops.FUND_FLOW_SCALE), 0.0, 100.0).alias("s"))
    docs = sample.news(spark, d).select(
        "symbol", "sentiment", F.col("reliability").alias("confidence"), F.col("published_at").alias("observed_at"))
    return {
        "smart_money_score": money,
        "research_score": agg.research_score(docs),
        "fundamental_score": estimate_revisions(sample.estimates(spark, d)),
    }


@query("attach_layers", tables=("bars", *LAYER_TABLES), sql=_LAYERS_SQL + f"""
SELECT b.symbol, {day('timestamp')} AS timestamp, {r6('close')} AS close, {r6('smart_money_score')} AS smart_money_score,
       research_score, fundamental_score
FROM bars b LEFT JOIN flow_l USING (symbol) LEFT JOIN res_l USING (symbol) LEFT JOIN fund_l USING (symbol)""")
def attach_layers(spark: SparkSession, d: str) -> DataFrame:
    # The base symbols are lower case on purpose: the join ignores case.
    bars = sample.bars(spark, d).withColumn("symbol", F.lower("symbol"))
    out = ops.attach_layers(bars, layers(spark, d)).withColumn("symbol", F.initcap("symbol"))
    return out.select("symbol", "timestamp", "close", "smart_money_score", "research_score", "fundamental_score")


@query("mark_to_market", tables=("ticks", "positions"), per_column={"invested": 4, "equity": 4}, sql="""
, p AS (SELECT symbol, 1000 / entry_price AS quantity, 1001.0::DOUBLE AS entry_cost FROM positions),
   c AS (SELECT symbol, max_by(price, ts) AS close FROM ticks GROUP BY symbol),
   t AS (SELECT greatest(0.0, 1000000 - sum(entry_cost)) AS cash, sum(quantity * close * 0.999::DOUBLE) AS invested
         FROM p LEFT JOIN c USING (symbol))
SELECT round_even(cash, 6) AS cash, round_even(invested, 4) AS invested, round_even(cash + invested, 4) AS equity FROM t""")
def mark_to_market(spark: SparkSession, d: str) -> DataFrame:
    bars = sample.ticks(spark, d).select("symbol", F.col("ts").alias("timestamp"), F.col("price").alias("close"))
    held = sample.positions(spark, d).select(
        "symbol", (F.lit(1000.0) / F.col("entry_price")).alias("quantity"), F.lit(1001.0).alias("entry_cost"))
    return ops.mark_to_market(bars, held, 1_000_000.0)


@query("flow_summary", tables=("fund_flows",), sql=f"""
, t AS (SELECT * FROM fund_flows WHERE as_of = (SELECT max(as_of) FROM fund_flows))
SELECT {day('max(as_of)')} AS as_of, round_even(coalesce(sum(net_flow) FILTER (net_flow > 0), 0), 2) AS total_inflow,
       round_even(abs(coalesce(sum(net_flow) FILTER (net_flow < 0), 0)), 2) AS total_outflow, round_even(sum(net_flow), 2) AS net_flow,
       coalesce(string_agg(fund_code, ',' ORDER BY net_flow DESC) FILTER (net_flow > 0), '') AS inflow_funds,
       coalesce(string_agg(fund_code, ',' ORDER BY net_flow) FILTER (net_flow < 0), '') AS outflow_funds
FROM t""")
def flow_summary(spark: SparkSession, d: str) -> DataFrame:
    return agg.flow_summary(sample.fund_flows(spark, d))


@query("sector_flows_tagged", tables=("fund_flows",), sql=f"""
SELECT {day('as_of')} AS as_of, sector, round_even(sum(net_flow), 2) AS estimated_flow,
       string_agg(DISTINCT fund_code, ',' ORDER BY fund_code) AS funds
FROM fund_flows WHERE as_of = (SELECT max(as_of) FROM fund_flows) GROUP BY as_of, sector""")
def sector_flows_tagged(spark: SparkSession, d: str) -> DataFrame:
    return agg.sector_flows_tagged(sample.fund_flows(spark, d))


@query("broker_consensus", tables=("broker_views",), sql="""
, w AS (SELECT symbol, broker, max_by(CASE upper(trim(action)) WHEN 'BUY' THEN 1.0 WHEN 'SELL' THEN -1.0 ELSE 0.0 END,
                                      row(observed_at, seq)) AS w
        FROM broker_views WHERE upper(trim(action)) IN ('BUY', 'SELL', 'HOLD') GROUP BY symbol, broker)
SELECT symbol, round_even(CAST(50 + 50 * avg(w) AS DOUBLE), 2) AS broker_consensus FROM w GROUP BY symbol""")
def broker_consensus(spark: SparkSession, d: str) -> DataFrame:
    return agg.broker_consensus(sample.broker_views(spark, d), ["observed_at", "seq"])


@query("consensus_recency", tables=("holdings",), sql=_SIDES + """
, u AS (SELECT count(DISTINCT r_name)::DOUBLE AS n FROM region), ref AS (SELECT max(as_of) AS d FROM holdings),
   aged AS (SELECT h.*, pow(0.5::DOUBLE, date_diff('day', as_of, d) / 45.0::DOUBLE) AS rec FROM holdings h, ref),
   m AS (SELECT symbol, manager, max(rec) AS rec, sum(portfolio_weight * rec) AS w, count(*) AS n, sum(fund_aum * portfolio_weight * rec) AS v
         FROM aged GROUP BY symbol, manager),
   f AS (SELECT symbol, count(DISTINCT fund_code) AS fund_count FROM holdings GROUP BY symbol),
   s AS (SELECT m.symbol, count(*) AS manager_count, sum(rec) AS rec, sum(w) AS w, sum(m.n) AS rows, sum(v) AS v,
                count(*) FILTER (status = 'NEW') AS nw, count(*) FILTER (status = 'INCREASE') AS inc, count(*) FILTER (status = 'DECREASE') AS dec,
                string_agg(m.manager, ',' ORDER BY m.manager) AS managers
         FROM m LEFT JOIN changes c ON c.manager = m.manager AND c.symbol = m.symbol GROUP BY m.symbol)
SELECT s.symbol, manager_count, fund_count, round_even(w, 6) AS total_weight, round_even(w / rows, 6) AS average_weight,
       round_even(v, 2) AS estimated_value, nw AS new_manager_count, inc AS increasing_manager_count, dec AS decreasing_manager_count,
       round_even(least(100.0, greatest(0.0, 0.40::DOUBLE * least(100.0, 100.0 * manager_count / n) + 0.20::DOUBLE * least(100.0, 100.0 * (w / rows) / 0.25::DOUBLE)
         + 0.15::DOUBLE * least(100.0, 100.0 * (nw + inc) / n) + 0.15::DOUBLE * least(100.0, 100.0 * rec / n)
         + 0.10::DOUBLE * least(100.0, 100.0 * nw / n))), 2) AS score, managers
FROM s JOIN f USING (symbol), u""")
def consensus_recency(spark: SparkSession, d: str) -> DataFrame:
    held = sample.stored_holdings(spark, d)
    changes = ops.position_changes(*_last_two(held))
    managers = sample.table(spark, d, "region").select("r_name")
    return agg.consensus_recency(held, changes, managers)


_POS = """
, pos AS (SELECT symbol, manager, as_of, portfolio_weight AS weight,
                 portfolio_weight - coalesce(lag(portfolio_weight) OVER (PARTITION BY fund_code, symbol ORDER BY as_of), 0) AS change FROM holdings)
"""


@query("consensus_breadth", tables=("holdings",), sql=_POS + f"""
, g AS (SELECT symbol, count(DISTINCT manager) AS manager_count, count(*) AS fund_count, avg(weight) AS mean_weight, max(weight) AS max_weight,
               avg(change) AS mean_change, count(*) FILTER (change > 0) AS positive_managers, count(*) FILTER (change < -0.005) AS exits
        FROM pos GROUP BY symbol)
SELECT symbol, manager_count, fund_count, {r6('mean_weight')} AS mean_weight, {r6('max_weight')} AS max_weight, {r6('mean_change')} AS mean_change,
       positive_managers, exits, round_even(least(100.0, greatest(0.0,
         0.30::DOUBLE * least(100.0, manager_count / 10.0::DOUBLE * 100) + 0.25::DOUBLE * least(100.0, mean_weight / 0.10::DOUBLE * 100)
         + 0.25::DOUBLE * least(100.0, greatest(0.0, 50 + mean_change / 0.02::DOUBLE * 50)) + 0.20::DOUBLE * least(100.0, positive_managers / manager_count * 100)
         - 0.20::DOUBLE * least(100.0, exits / manager_count * 100))), 2) AS consensus_score
FROM g""")
def consensus_breadth(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("fund_code", "symbol").orderBy("as_of")  # one row per month
    weight = F.col("portfolio_weight")
    positions = sample.holdings(spark, d).select(
        "symbol", "manager", "as_of", weight.alias("weight"),
        (weight - F.coalesce(F.lag(weight).over(w), F.lit(0.0))).alias("change"))
    return agg.consensus_breadth(positions)


@query("research_score", tables=("news",), sql="""
SELECT symbol, round_even(least(100.0, greatest(0.0, 50 + coalesce(sum(sentiment * coalesce(reliability, 0)) / nullif(sum(coalesce(reliability, 0)), 0), 0) * 50)), 2) AS research_score
FROM news GROUP BY symbol""")
def research_score(spark: SparkSession, d: str) -> DataFrame:
    return layers(spark, d)["research_score"]


@query("portfolio_risk", tables=("portfolios",), sql=f"""
, r AS (SELECT *, weight / sum(weight) OVER (PARTITION BY portfolio) AS w, row_number() OVER (PARTITION BY portfolio ORDER BY weight DESC, symbol) AS n FROM portfolios)
SELECT portfolio, count(*) AS positions, {r6('max(w)')} AS top1_weight, {r6('sum(w) FILTER (n <= 5)')} AS top5_weight,
       {r6('sum(w * w)')} AS herfindahl, {r6('1 / sum(w * w)')} AS effective_positions
FROM r GROUP BY portfolio""")
def portfolio_risk(spark: SparkSession, d: str) -> DataFrame:
    return agg.portfolio_risk(sample.portfolios(spark, d))
