"""SQL definitions of the derived market tables, used as CTEs by the SQL side of each query."""

from __future__ import annotations

_KEY = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_WS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)"

TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "trades": (f"""
        SELECT p_brand AS symbol, l_suppkey, CAST(l_shipdate AS DATE) AS timestamp, p_retailprice AS open,
               p_retailprice*(1+l_tax) AS high, p_retailprice*(1-l_discount) AS low,
               p_retailprice*(1+l_tax-l_discount) AS close, l_quantity AS volume, l_returnflag, {_KEY} AS seq
        FROM lineitem JOIN part ON l_partkey = p_partkey""", ()),
    "bars": ("""
        SELECT symbol, timestamp, min_by(open, seq) AS open, max(high) AS high, min(low) AS low,
               max_by(close, seq) AS close, sum(volume) AS volume
        FROM trades GROUP BY symbol, timestamp""", ("trades",)),
    "fund_flows": ("""
        SELECT last_day(CAST(o_orderdate AS DATE)) AS as_of, n_name AS fund_code, r_name AS sector,
               sum(CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN -o_totalprice ELSE 0.0 END) AS net_flow
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey
        GROUP BY ALL""", ()),
    "holdings": ("""
        SELECT as_of, manager, fund_code, symbol, v / sum(v) OVER f AS portfolio_weight,
               CASE WHEN fund_code NOT LIKE '%3' THEN sum(v) OVER f END AS fund_aum,
               CASE WHEN right(symbol, 1) IN ('0', '5') THEN '' ELSE 'SECTOR' || right(symbol, 1) END AS sector
        FROM (SELECT last_day(CAST(l_shipdate AS DATE)) AS as_of, r_name AS manager, n_name AS fund_code,
                     p_brand AS symbol, sum(l_extendedprice) AS v
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
                   JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
              GROUP BY ALL)
        WINDOW f AS (PARTITION BY as_of, fund_code)""", ()),
    "news": ("""
        SELECT d.doc_id AS news_id, source, timestamp '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS published_at,
               text AS title, '' AS url, 'Brand#' || CAST(d.doc_id % 25 + 1 AS VARCHAR) AS symbol,
               CAST((n_chars % 201) - 100 AS DOUBLE) / 100 AS sentiment,
               CAST(CASE quality WHEN 1 THEN 0.9 WHEN 0 THEN 0.4 END AS DOUBLE) AS reliability
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""", ()),
    "source_profiles": ("""
        SELECT source, avg(quality) AS reliability FROM documents d JOIN labels l ON d.doc_id = l.doc_id
        GROUP BY source HAVING max(toxic) = 0""", ()),
    "broker_views": (f"""
        SELECT n_name AS broker, p_brand AS symbol,
               CASE WHEN l_returnflag = 'A' THEN ' buy ' WHEN l_returnflag = 'R' THEN 'SELL'
                    WHEN l_linenumber = 7 THEN 'no view' ELSE 'hold' END AS action,
               l_shipdate AS observed_at, {_KEY} AS seq
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
             JOIN part ON l_partkey = p_partkey""", ()),
    "estimates": ("""
        SELECT p_brand AS symbol, CAST(year(l_shipdate) AS VARCHAR) AS period,
               last_day(CAST(l_shipdate AS DATE)) AS observed_at, avg(l_extendedprice) AS estimate
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""", ()),
    "watchlist": ("""
        SELECT symbol, close AS last_price, close*0.98::DOUBLE AS entry_low, close*1.01::DOUBLE AS entry_high,
               close * (CASE WHEN n % 3 = 0 THEN 1.03::DOUBLE ELSE 1.10::DOUBLE END) AS target,
               close*0.95::DOUBLE AS stop
        FROM (SELECT symbol, max_by(close, timestamp) AS close, CAST(substr(symbol, 7) AS INT) AS n
              FROM bars GROUP BY symbol) WHERE n % 5 <> 0""", ("bars",)),
    "portfolios": ("""
        SELECT fund_code || '@' || strftime(as_of, '%Y-%m-%d') AS portfolio, symbol, portfolio_weight AS weight
        FROM holdings""", ("holdings",)),
    "ticks": ("""
        SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, ts, event_id, 100.0::DOUBLE + value AS price,
               1.0::DOUBLE AS qty FROM events""", ()),
    "positions": ("""
        SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, min_by(100.0::DOUBLE + value, event_id) AS entry_price,
               CAST(50 + user_id % 50 AS DOUBLE) AS entry_score FROM events GROUP BY user_id""", ()),
    "cash_moves": ("""
        SELECT CAST(user_id AS VARCHAR) AS account, ts AS timestamp, event_id AS seq,
               value * CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1
                            ELSE 0 END AS DOUBLE) AS move FROM events""", ()),
    "equity_snapshots": ("""
        SELECT account, timestamp, seq,
               1000000.0::DOUBLE + sum(move) OVER (PARTITION BY account ORDER BY timestamp, seq
                                                   ROWS UNBOUNDED PRECEDING) AS equity
        FROM cash_moves""", ("cash_moves",)),
    "order_requests": ("""
        SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 11 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS quantity, o_totalprice AS price,
               500000.0::DOUBLE + 50.0::DOUBLE*c_acctbal AS equity,
               (500000.0::DOUBLE + 50.0::DOUBLE*c_acctbal) * (1.0::DOUBLE + (o_custkey % 5)*0.01::DOUBLE) AS day_start_equity,
               o_custkey % 7 AS open_positions, o_orderkey % 4 = 0 AS already_held
        FROM orders JOIN customer ON o_custkey = c_custkey""", ()),
    "featured": ("""
        SELECT *, least(100.0, greatest(0.0, 50
                 + least(0.10, greatest(-0.05, coalesce(ret_1, 0.0)))*250
                 + least(0.30, greatest(-0.15, coalesce(ret_5, 0.0)))*100
                 + (least(5.0, greatest(0.0, coalesce(volume_ratio, 1.0))) - 1)*8
                 + least(0.10, greatest(-0.10, coalesce(breakout, 0.0)))*150)) AS score
        FROM (SELECT *, close / lag(close) OVER s - 1 AS ret_1, close / lag(close, 5) OVER s - 1 AS ret_5,
                     volume / nullif(vol_mean_20, 0) AS volume_ratio, close / high_20_prev - 1 AS breakout
              FROM (SELECT *,
                       CASE WHEN count(volume) OVER c >= 5 THEN avg(volume) OVER c END AS vol_mean_20,
                       CASE WHEN count(high) OVER p >= 5 THEN max(high) OVER p END AS high_20_prev
                    FROM bars
                    WINDOW c AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
                           p AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
              WINDOW s AS (PARTITION BY symbol ORDER BY timestamp))""", ("bars",)),
    "predictions": ("""
        SELECT symbol, timestamp, score / 100 AS score, future_return, future_return >= 0.0025 AS actual
        FROM (SELECT symbol, timestamp, score,
                     0.05::DOUBLE * (lead(close) OVER (PARTITION BY symbol ORDER BY timestamp) / close - 1) AS future_return
              FROM featured)
        WHERE future_return IS NOT NULL""", ("featured",)),
    "limit_up_rows": ("""
        SELECT symbol, timestamp, ret1, ret5, volume_ratio, close_location, range_pct, breakout_20, volatility_20, gap,
               CAST(next_high >= close * 1.10::DOUBLE AS DOUBLE) AS target
        FROM (SELECT *, volume / nullif(CASE WHEN count(volume) OVER p >= 5 THEN avg(volume) OVER p END, 0) AS volume_ratio,
                     (close - low) / nullif(high - low, 0) AS close_location, (high - low) / nullif(close, 0) AS range_pct,
                     close / (CASE WHEN count(high) OVER p >= 5 THEN max(high) OVER p END) - 1 AS breakout_20,
                     CASE WHEN count(ret1) OVER c >= 10 THEN stddev_samp(ret1) OVER c END AS volatility_20
              FROM (SELECT *, close / lag(close) OVER s - 1 AS ret1, close / lag(close, 5) OVER s - 1 AS ret5,
                           open / lag(close) OVER s - 1 AS gap, lead(high) OVER s AS next_high
                    FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY timestamp))
              WINDOW c AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
                     p AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
        WHERE next_high IS NOT NULL AND ret1 IS NOT NULL AND ret5 IS NOT NULL AND volume_ratio IS NOT NULL
              AND close_location IS NOT NULL AND range_pct IS NOT NULL AND breakout_20 IS NOT NULL
              AND volatility_20 IS NOT NULL AND gap IS NOT NULL""", ("bars",)),
}


def strip_sql(expr: str) -> str:
    return f"trim({expr}, {_WS})"


def fold_sql(expr: str) -> str:
    return f"replace(replace(lower({expr}), 'ß', 'ss'), 'ς', 'σ')"


def r6(expr: str, digits: int = 6) -> str:
    return f"round_even(CAST({expr} AS DOUBLE), {digits})"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def moment(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def _closure(names: tuple[str, ...], seen: dict[str, None]) -> dict[str, None]:
    for name in names:
        _closure(TABLES[name][1], seen)
        seen.setdefault(name)
    return seen


def with_tables(body: str, names: tuple[str, ...], recursive: bool = False) -> str:
    """Prefix `body` with the CTEs it needs, dependencies first. `body` may itself start with more CTEs: `, x AS (...)`."""
    body = body.strip()
    needed = _closure(names, {})
    head = "WITH RECURSIVE " if recursive else "WITH "
    ctes = [f"{name} AS ({TABLES[name][0].strip()})" for name in needed]
    if body.startswith(","):
        body = body[1:].strip() if not ctes else body
    elif ctes:
        return head + ",\n".join(ctes) + "\n" + body
    else:
        return body
    return head + ",\n".join(ctes) + body
