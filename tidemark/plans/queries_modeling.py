"""Registered model, validation and sweep queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.chunked import over_chunks
from ..functions.lineage import written
from ..operators import modeling as ops
from ..operators.features import MODEL_FEATURES, limit_up_dataset, ranker_columns
from ..sources import sample
from .domain_sql import day, r6
from .registry import query

_ORDERED = """
, o AS (SELECT *, row_number() OVER (ORDER BY timestamp, symbol) - 1 AS pos, count(*) OVER () AS n_rows FROM limit_up_rows)
"""


_SEGMENT = " + ".join(f"CAST(pos >= floor(n_rows / 6.0::DOUBLE * {i}.0::DOUBLE) AS INT)" for i in range(1, 6))
_WEIGHTS = ", ".join(f"w{j}" for j in range(len(MODEL_FEATURES) + 1))
_LOGIT = " + ".join(["w0", *[f"w{j} * z{j}" for j in range(1, len(MODEL_FEATURES) + 1)]])
_CHANCE = f"1 / (1 + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, {_LOGIT}))))"
_SCALED = ", ".join(f"({c} - m[{j}]) / s[{j}] AS z{j}" for j, c in enumerate(MODEL_FEATURES, 1))


def _descent_sql(segment: str, folds: str, both: bool) -> str:
    """400 plain gradient steps for every fold, trained on the segments below it: fold, moments and weights in `fit`."""
    return _ORDERED + f"""
, seg AS MATERIALIZED (SELECT *, {segment} AS segment FROM o),
   mom AS MATERIALIZED (
     SELECT fold, count(*) AS n, [{', '.join(f'avg({c})' for c in MODEL_FEATURES)}] AS m,
            [{', '.join(f'CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END' for c in MODEL_FEATURES)}] AS s
     FROM (SELECT unnest({folds}) AS fold) JOIN seg ON segment < fold GROUP BY fold {'HAVING min(target) < max(target)' if both else ''}),
   train AS MATERIALIZED (SELECT fold, n, target AS y, {_SCALED} FROM mom JOIN seg ON segment < fold),
   gd AS (
     SELECT 0 AS k, fold, {', '.join(f'0.0::DOUBLE AS w{j}' for j in range(len(MODEL_FEATURES) + 1))} FROM mom
     UNION ALL
     SELECT k + 1, fold, w0 - 0.05::DOUBLE * sum(e) / n,
            {', '.join(f'w{j} - 0.05::DOUBLE * (sum(e * z{j}) / n + 0.01::DOUBLE * w{j})' for j in range(1, len(MODEL_FEATURES) + 1))}
     FROM (SELECT gd.*, train.* EXCLUDE (fold), {_CHANCE} - y AS e FROM gd JOIN train ON train.fold = gd.fold WHERE k < 400)
     GROUP BY k, fold, n, {_WEIGHTS}),
   fit AS (SELECT gd.*, m, s FROM gd JOIN mom ON mom.fold = gd.fold WHERE k = 400)
"""


def _dataset(spark: SparkSession, d: str) -> DataFrame:
    """Training rows as a written table: every fit and fold reads them again."""
    rows = limit_up_dataset(sample.stored_bars(spark, d))
    return written(rows.select("symbol", "timestamp", *MODEL_FEATURES, "target"))


@query("standardize", tables=("limit_up_rows",), sql=f"""
SELECT symbol, {day('timestamp')} AS timestamp, {', '.join(
    r6(f'({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END)') + f' AS {c}_z'
    for c in MODEL_FEATURES)} FROM limit_up_rows""")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    return ops.standardize(_dataset(spark, d)).select("symbol", "timestamp", *[f"{c}_z" for c in MODEL_FEATURES])


@query("logistic_fit_predict", tables=("limit_up_rows",), recursive=True, sql=_descent_sql("0", "[1]", False) + f"""
SELECT symbol, {day('timestamp')} AS timestamp, target, {r6(_CHANCE)} AS probability
FROM (SELECT symbol, timestamp, target, fit.* EXCLUDE (fold), {_SCALED} FROM seg, fit)""")
def logistic_fit_predict(spark: SparkSession, d: str) -> DataFrame:
    rows = _dataset(spark, d)
    return ops.descent_fit(rows).predict(rows).select("symbol", "timestamp", "target", "probability")


@query("chrono_split", tables=("limit_up_rows",), sql=_ORDERED + f"""
SELECT symbol, {day('timestamp')} AS timestamp, pos, pos >= greatest(1, least(n_rows - 1, CAST(floor(n_rows * 0.8::DOUBLE) AS BIGINT))) AS is_test FROM o""")
def chrono_split(spark: SparkSession, d: str) -> DataFrame:
    return ops.chrono_split(_dataset(spark, d), 0.2).select("symbol", "timestamp", "pos", "is_test")


_METRICS = f"""count(*) AS test_rows, {r6('coalesce(count(*) FILTER (p >= 0.5 AND target = 1) / nullif(count(*) FILTER (p >= 0.5), 0), 0)')} AS test_precision,
       {r6('coalesce(count(*) FILTER (p >= 0.5 AND target = 1) / nullif(count(*) FILTER (target = 1), 0), 0)')} AS test_recall"""
_SCORED = f"SELECT fold, segment, target, n, {_CHANCE} AS p FROM (SELECT seg.*, fit.*, mom.n, {_SCALED.replace('m[', 'fit.m[').replace('s[', 'fit.s[')} FROM seg JOIN fit ON fit.fold = segment JOIN mom ON mom.fold = fit.fold)"


@query("chrono_train_test", tables=("limit_up_rows",), recursive=True, sql=_descent_sql(
    "CAST(pos >= greatest(1, least(n_rows - 1, CAST(floor(n_rows * 0.8::DOUBLE) AS BIGINT))) AS INT)", "[1]", False) + f"""
SELECT {_METRICS}, n AS train_rows FROM ({_SCORED}) GROUP BY n""")
def chrono_train_test(spark: SparkSession, d: str) -> DataFrame:
    return ops.chrono_train_test(_dataset(spark, d))[1]


@query("expanding_folds", tables=("limit_up_rows",), sql=_ORDERED + f"""
SELECT symbol, {day('timestamp')} AS timestamp, CAST({_SEGMENT} AS BIGINT) AS segment FROM o""")
def expanding_folds(spark: SparkSession, d: str) -> DataFrame:
    return ops.expanding_folds(_dataset(spark, d), 5).select("symbol", "timestamp", "segment")


@query("walk_forward_expanding", tables=("limit_up_rows",), recursive=True, sql=_descent_sql(_SEGMENT, "range(1, 6)", True) + f"""
SELECT CAST(fold AS BIGINT) AS fold, {_METRICS} FROM ({_SCORED}) GROUP BY fold""")
def walk_forward_expanding(spark: SparkSession, d: str) -> DataFrame:
    return ops.walk_forward_expanding(_dataset(spark, d), 5)


_FOLDS = _ORDERED + """
, folds AS (SELECT unnest(range(0, CAST(ceil((max(n_rows) - 252) / 21.0) AS BIGINT))) AS fold FROM o),
   member AS (SELECT fold, 'train' AS role, o.* FROM folds JOIN o ON pos >= fold * 21 AND pos < fold * 21 + 252
              UNION ALL SELECT fold, 'test', o.* FROM folds JOIN o ON pos >= fold * 21 + 252 AND pos < fold * 21 + 273)
"""


@query("walk_forward_rolling", tables=("limit_up_rows",), sql=_FOLDS + f"""
SELECT fold, role, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos, {day('min(timestamp)')} AS first_day,
       {day('max(timestamp)')} AS last_day, {r6('avg(target)')} AS positives FROM member GROUP BY fold, role""")
def walk_forward_rolling(spark: SparkSession, d: str) -> DataFrame:
    return ops.rolling_folds(_dataset(spark, d)).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.min("timestamp").alias("first_day"), F.max("timestamp").alias("last_day"), F.avg("target").alias("positives"))


def _above_train_mean(train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
    called = test["gap"] >= train["gap"].mean()
    return pd.DataFrame({"fold": test["fold"], "symbol": test["symbol"], "pos": test["pos"],
                         "prediction": called, "actual": test["target"] == 1.0})


@query("walk_forward_benchmark", tables=("limit_up_rows",), sql=_FOLDS + """
, base AS (SELECT fold, avg(gap) AS mean_gap FROM member WHERE role = 'train' GROUP BY fold)
SELECT m.fold, symbol, pos, gap >= mean_gap AS prediction, target = 1 AS actual
FROM member m JOIN base b ON m.fold = b.fold WHERE role = 'test'""")
def walk_forward_benchmark(spark: SparkSession, d: str) -> DataFrame:
    rows = _dataset(spark, d).select("symbol", "timestamp", "gap", "target")
    schema = "fold bigint, symbol string, pos bigint, prediction boolean, actual boolean"
    return ops.walk_forward_benchmark(rows, _above_train_mean, schema)


_AXES_SQL = """
, m AS (SELECT model, row_number() OVER (ORDER BY model) AS i1 FROM (SELECT DISTINCT p_type AS model FROM part)),
   f AS (SELECT feature_set, row_number() OVER (ORDER BY feature_set) AS i2 FROM (SELECT DISTINCT c_mktsegment AS feature_set FROM customer)),
   h AS (SELECT horizon, row_number() OVER (ORDER BY horizon) AS i3 FROM (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS horizon FROM lineitem)),
   t AS (SELECT threshold, row_number() OVER (ORDER BY threshold) AS i4 FROM (SELECT DISTINCT l_discount AS threshold FROM lineitem)),
   c AS (SELECT cost_bps, row_number() OVER (ORDER BY cost_bps) AS i5 FROM (SELECT DISTINCT l_tax * 100 AS cost_bps FROM lineitem)),
   s AS (SELECT seed, row_number() OVER (ORDER BY seed) AS i6 FROM (SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS seed FROM region)),
   g AS (SELECT row_number() OVER (ORDER BY i1, i2, i3, i4, i5, i6) - 1 AS run, model, feature_set, horizon, threshold, cost_bps, seed
         FROM m, f, h, t, c, s)
"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """The axes are distinct values of small domains (types, segments, line numbers, rates)."""
    values = lambda name, c: sample.table(spark, d, name).agg(F.array_sort(F.collect_set(c))).scalar()
    return ops.parameter_grid(spark, {
        "model": values("part", "p_type"), "feature_set": values("customer", "c_mktsegment"),
        "horizon": values("lineitem", "l_linenumber"), "threshold": values("lineitem", "l_discount"),
        "cost_bps": values("lineitem", F.col("l_tax") * 100), "seed": values("region", "r_regionkey")})


@query("parameter_grid", sql=_AXES_SQL + f"""
SELECT run, model, feature_set, horizon, {r6('threshold')} AS threshold, {r6('cost_bps')} AS cost_bps, seed FROM g""")
def parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


_LEVELS = [0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.80]


@query("sweep", tables=("featured",), digits=9, sql=f"""
, ahead AS (SELECT symbol, timestamp, score / 100 AS score, unnest([1, 2, 3]) AS horizon,
                   unnest([lead(close, 1) OVER w / close - 1, lead(close, 2) OVER w / close - 1, lead(close, 3) OVER w / close - 1]) AS future_return
            FROM featured WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
   p AS (SELECT symbol, timestamp, horizon, score, 0.05::DOUBLE * future_return AS future_return FROM ahead WHERE future_return IS NOT NULL),
   ev AS (SELECT horizon, count(*) FILTER (future_return >= 0.0025) AS events FROM p GROUP BY horizon),
   th AS (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in _LEVELS)}]) AS threshold),
   cell AS (SELECT p.horizon, threshold, count(*) AS signals, count(*) FILTER (future_return >= 0.0025) AS hits, sum(future_return) AS total
            FROM p JOIN th ON score >= threshold GROUP BY p.horizon, threshold),
   top AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY horizon, timestamp ORDER BY score DESC, symbol) <= 5),
   daily AS (SELECT horizon, threshold, timestamp, count(*) FILTER (score >= threshold) AS selected,
                    count(*) FILTER (score >= threshold AND future_return >= 0.0025) AS hits,
                    coalesce(avg(future_return) FILTER (score >= threshold), 0) AS ret FROM top, th GROUP BY ALL),
   grown AS (SELECT *, product(1 + ret) OVER (PARTITION BY horizon, threshold ORDER BY timestamp) AS equity FROM daily),
   fallen AS (SELECT *, equity / max(equity) OVER (PARTITION BY horizon, threshold ORDER BY timestamp) - 1 AS drawdown FROM grown),
   days AS (SELECT horizon, threshold, count(*) FILTER (selected > 0) / count(*) AS daily_hit_day_rate, sum(selected) / count(*) AS average_daily_hits,
                   coalesce(sum(hits) / nullif(sum(selected), 0), 0) AS top_k_precision, max_by(equity, timestamp) - 1 AS net_pnl, min(drawdown) AS max_drawdown
            FROM fallen GROUP BY horizon, threshold),
   grid AS (SELECT model, feature_set, h.horizon, threshold, cost_bps, seed FROM
              (SELECT unnest(['logit', 'rules']) AS model), (SELECT unnest(['base', 'full']) AS feature_set),
              (SELECT unnest([1, 2, 3]) AS horizon) h, th, (SELECT unnest([10.0::DOUBLE, 15.0::DOUBLE]) AS cost_bps), (SELECT unnest([1, 2]) AS seed)),
   runs AS (SELECT *, row_number() OVER (ORDER BY model, feature_set, horizon, threshold, cost_bps, seed) - 1 AS run FROM grid)
SELECT run, model, feature_set, CAST(r.horizon AS BIGINT) AS horizon, r.threshold, cost_bps, CAST(seed AS BIGINT) AS seed,
       coalesce(signals, 0) AS signals, coalesce(hits, 0) AS hits, {r6('coalesce(hits / signals, 0)', 9)} AS precision,
       {r6('coalesce(hits / events, 0)', 9)} AS recall, {r6('CASE WHEN signals > 0 THEN total / signals - cost_bps / 10000 ELSE 0 END', 9)} AS net_return,
       {', '.join(r6(f'coalesce({c}, 0)', 9) + f' AS {c}' for c in ops.DAY_METRICS)}
FROM runs r LEFT JOIN cell c ON c.horizon = r.horizon AND c.threshold = r.threshold LEFT JOIN ev ON ev.horizon = r.horizon
     LEFT JOIN days d ON d.horizon = r.horizon AND d.threshold = r.threshold""")
def sweep(spark: SparkSession, d: str) -> DataFrame:
    def ahead(df: DataFrame, w: WindowSpec) -> DataFrame:
        moves = F.array(*[
            F.struct(F.lit(h).alias("horizon"), (F.lit(0.05) * (F.lead("close", h).over(w) / F.col("close") - 1)).alias("future_return"))
            for h in (1, 2, 3)])
        return ranker_columns(df, w).withColumn("moves", moves)

    rows = over_chunks(sample.stored_bars(spark, d), ["symbol"], ["timestamp"], F.year("timestamp"), ahead,
                       before=20, after=3, needs=["close", "high", "volume"])
    predictions = rows.select("symbol", "timestamp", (F.col("score") / 100).alias("score"), F.inline("moves")).filter("future_return is not null")
    grid = ops.parameter_grid(spark, {
        "model": ["logit", "rules"], "feature_set": ["base", "full"], "horizon": [1, 2, 3], "threshold": _LEVELS,
        "cost_bps": [10.0, 15.0], "seed": [1, 2]})
    return ops.sweep(grid, written(predictions), event_threshold=0.0025)


def _toy_evaluator(config: dict) -> dict:
    return {"value": config["horizon"] * config["threshold"] - config["cost_bps"] / 100.0}


@query("run_evaluator", sql=_AXES_SQL + f"SELECT run, {r6('horizon * threshold - cost_bps / 100.0::DOUBLE')} AS value FROM g")
def run_evaluator(spark: SparkSession, d: str) -> DataFrame:
    return ops.run_evaluator(_grid(spark, d), _toy_evaluator, "run bigint, value double")
