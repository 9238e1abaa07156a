"""Standardization, the limit-up classifier, chronological validation, parameter grids and sweeps.

Positions in time order come from counted ranges (see functions.chunked.ordinal).
Fitting is distributed gradient work (Spark ML, or partition sums in operators.descent); only the handful of fitted parameters
live on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chunked import ordinal
from ..functions.lineage import written
from ..functions.numeric import clip, rounded
from .descent import Fit, fit_folds
from .evaluation import ratio
from .features import MODEL_FEATURES

GRID_AXES = ("model", "feature_set", "horizon", "threshold", "cost_bps", "seed")


def _moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in features],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in features],
    )


def standardize(df: DataFrame, features: Sequence[str] = MODEL_FEATURES, suffix: str = "_z") -> DataFrame:
    """z-scores with the population deviation; a constant feature is only centred."""
    moments = _moments(df, features).select(F.struct("*")).scalar()
    spread = lambda c: moments.getField(f"std_{c}")
    return df.withColumns(
        {
            f"{c}{suffix}": (F.col(c) - moments.getField(f"mean_{c}"))
            / F.when(spread(c) == 0, F.lit(1.0)).otherwise(spread(c))
            for c in features
        }
    )


@dataclass(frozen=True)
class LogisticModel:
    """Fitted parameters; scoring is a plain column expression."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def probability(self) -> Column:
        logit = F.lit(self.intercept)
        for name, mean, std, weight in zip(self.features, self.means, self.deviations, self.coefficients):
            logit = logit + F.lit(weight) * ((F.col(name) - F.lit(mean)) / F.lit(std))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(logit, -30.0, 30.0)))

    def predict(self, df: DataFrame, name: str = "probability") -> DataFrame:
        return df.withColumn(name, self.probability())


def logistic_fit(
    train: DataFrame, features: Sequence[str] = MODEL_FEATURES, label: str = "target", l2: float = 0.01,
    max_iter: int = 100,
) -> LogisticModel:
    """L2-regularized logistic regression on standardized features, run to convergence."""
    data = train.select(*features, F.col(label).cast("double").alias("label")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        moments = _moments(data, features).first()
        if moments is None or moments[f"mean_{features[0]}"] is None:
            raise ValueError("cannot fit on an empty dataset")
        means = tuple(float(moments[f"mean_{c}"]) for c in features)
        deviations = tuple(float(moments[f"std_{c}"]) or 1.0 for c in features)
        scaled = data.select(
            *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) for c, m, s in zip(features, means, deviations)], "label"
        )
        assembled = VectorAssembler(inputCols=list(features), outputCol="x").transform(scaled)
        fitted = LogisticRegression(
            featuresCol="x", labelCol="label", regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=max_iter
        ).fit(assembled.select("x", "label"))
    finally:
        data.unpersist()
    return LogisticModel(
        tuple(features), means, deviations, tuple(float(v) for v in fitted.coefficients), float(fitted.intercept)
    )


def _fitted(features: Sequence[str], fit: Fit) -> LogisticModel:
    values = lambda a: tuple(float(v) for v in a)
    return LogisticModel(tuple(features), values(fit.moments.mean), values(fit.moments.scale()), values(fit.weights[1:]), float(fit.weights[0]))


def descent_fit(
    train: DataFrame, features: Sequence[str] = MODEL_FEATURES, label: str = "target", l2: float = 0.01,
    learning_rate: float = 0.05, epochs: int = 400,
) -> LogisticModel:
    """The fit after exactly `epochs` full-batch gradient steps from zero, stopped there whether or not it has converged."""
    data = train.select(*features, label, F.lit(0).alias("_segment"))
    fits = fit_folds(data, features, label, "_segment", [1], "descent", learning_rate, epochs, l2, both_labels=False)
    if not fits:
        raise ValueError("cannot fit on an empty dataset")
    return _fitted(features, fits[1])


def in_time_order(df: DataFrame) -> DataFrame:
    """Add `pos` and `n_rows` in (timestamp, symbol) order; missing times and symbols come last."""
    return ordinal(df, ["timestamp", "symbol"])


def chrono_split(df: DataFrame, test_fraction: float = 0.2) -> DataFrame:
    """Mark the last `test_fraction` of rows in time order as `is_test`."""
    n = F.col("n_rows")
    cut = F.greatest(F.lit(1), F.least(n - 1, F.floor(n * F.lit(1 - test_fraction))))
    return in_time_order(df).withColumn("is_test", F.col("pos") >= cut)


def precision_recall(scored: DataFrame, keys: list[str] | None = None, cutoff: float = 0.5) -> DataFrame:
    hit, called = F.col("target") == 1.0, F.col("probability") >= cutoff
    grouped = scored.groupBy(*keys) if keys else scored.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("test_rows"),
        rounded(ratio(F.count_if(hit & called), F.count_if(called)), 6).alias("test_precision"),
        rounded(ratio(F.count_if(hit & called), F.count_if(hit)), 6).alias("test_recall"),
    )


def chrono_train_test(
    df: DataFrame, test_fraction: float = 0.2, fit: Callable[[DataFrame], LogisticModel] = descent_fit
) -> tuple[LogisticModel, DataFrame]:
    """Fit on the earlier rows, measure on the later ones: (model, one-row metrics with train_rows). Needs two rows."""
    split = written(chrono_split(df, test_fraction))
    if len(split.take(2)) < 2:
        raise ValueError("a chronological split needs at least two rows")
    model = fit(split.filter(~F.col("is_test")))
    scored = model.predict(split.filter("is_test"))
    metrics = precision_recall(scored).withColumn("train_rows", split.filter(~F.col("is_test")).agg(F.count(F.lit(1))).scalar())
    return model, metrics


def expanding_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """Add `segment` 0..folds: fold i trains on segments below i and tests on segment i (i >= 1)."""
    n, pos = F.col("n_rows"), F.col("pos")
    step = n / F.lit(float(folds + 1))
    segment = F.lit(0)
    for i in range(1, folds + 1):
        segment = segment + (pos >= F.floor(step * F.lit(float(i)))).cast("int")
    return in_time_order(df).withColumn("segment", segment)


def walk_forward_expanding(
    df: DataFrame, folds: int = 5, features: Sequence[str] = MODEL_FEATURES, solver: str = "descent"
) -> DataFrame:
    """Out-of-sample precision per expanding fold; folds whose training rows hold one class only are skipped.

    All folds are fitted together: a step of the `solver` ("descent", 400 steps, or "newton", to the optimum) is one scan for all of
    them, and each fold's moments are those of its segments joined. Scoring is one scan too: a row is scored by its segment's model.
    """
    segmented = written(expanding_folds(df, folds).select("target", *features, "segment"))
    sizes = {r.segment: r.n for r in segmented.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}  # folds + 1 rows
    if sum(sizes.values()) < max(20, folds * 4):
        raise ValueError("insufficient observations for walk-forward validation")
    fits = fit_folds(segmented, features, "target", "segment", [f for f in range(1, folds + 1) if f in sizes], solver)
    if not fits:
        return df.sparkSession.createDataFrame([], "fold int, test_rows bigint, test_precision double, test_recall double")
    fold = F.col("segment")
    probability = F.coalesce(*[F.when(fold == k, _fitted(features, fit).probability()) for k, fit in fits.items()])
    scored = segmented.filter(fold.isin(list(fits))).select(fold.alias("fold"), "target", probability.alias("probability"))
    return precision_recall(scored, ["fold"])


def rolling_folds(df: DataFrame, train_rows: int = 252, test_rows: int = 21) -> DataFrame:
    """One row per (fold, role, input row) of rolling windows over the time order.

    Fold j trains on positions [j*test, j*test+train) and tests on the `test_rows` after that; the last test
    window may be short. Fold numbers follow from a row's position, so no row is compared with any other.
    """
    if train_rows < 1 or test_rows < 1:
        raise ValueError("train_rows and test_rows must be positive")
    pos, n = F.col("pos"), F.col("n_rows")
    last = F.ceil((n - train_rows) / F.lit(float(test_rows))) - 1
    first_train = F.greatest(F.lit(0), F.floor((pos - train_rows) / F.lit(float(test_rows))) + 1)
    final_train = F.least(last, F.floor(pos / F.lit(float(test_rows))))
    train = F.when(first_train <= final_train, F.sequence(first_train, final_train)).otherwise(
        F.array().cast("array<bigint>")
    )
    test = F.when(pos >= train_rows, F.array(F.floor((pos - train_rows) / F.lit(float(test_rows))))).otherwise(
        F.array().cast("array<bigint>")
    )
    entry = lambda role: lambda fold: F.struct(fold.alias("fold"), F.lit(role).alias("role"))
    places = F.concat(F.transform(train, entry("train")), F.transform(test, entry("test")))
    return in_time_order(df).select("*", F.inline(places))


def walk_forward_benchmark(
    df: DataFrame,
    predictor: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str | T.StructType,
    train_rows: int = 252,
    test_rows: int = 21,
    group_folds: int = 100,
) -> DataFrame:
    """Run a user predictor(train, test) on every rolling fold.

    A task holds `group_folds` consecutive folds and walks them, so a row is sent to the one or two groups that read it
    and not to each of its folds.
    """
    if train_rows < 1 or test_rows < 1 or group_folds < 1:
        raise ValueError("train_rows, test_rows and group_folds must be positive")
    span = group_folds * test_rows  # first rows of successive groups are so far apart
    names = [f.name for f in (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).fields]

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        start, total, group = int(rows["pos"].iloc[0]), int(rows["n_rows"].iloc[0]), int(rows["_group"].iloc[0])
        rows = rows.drop(columns="_group")
        parts = []
        for fold in range(group * group_folds, (group + 1) * group_folds):
            first = fold * test_rows - start
            if fold * test_rows + train_rows >= total:
                break
            train = rows.iloc[first : first + train_rows].assign(fold=fold, role="train")
            test = rows.iloc[first + train_rows : first + train_rows + test_rows].assign(fold=fold, role="test")
            predicted = predictor(train, test)
            if not isinstance(predicted, pd.DataFrame):
                raise TypeError("predictor must return a DataFrame")
            parts.append(predicted)
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)

    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - (span + train_rows - 1)) / F.lit(float(span)))).cast("bigint")
    last = F.floor(F.col("pos") / F.lit(float(span))).cast("bigint")
    placed = in_time_order(df).withColumn("_group", F.explode(F.sequence(first, last)))
    return placed.groupBy("_group").applyInPandas(walk, schema)


def parameter_grid(
    spark: SparkSession, axes: Mapping[str, Sequence | Column], max_runs: int | None = None
) -> DataFrame:
    """All configurations of the Cartesian product in lexicographic order, or the first `max_runs` of them.

    Each run number is decoded digit by digit (the last axis turns fastest), so the product is never formed.
    An axis is a list, or an array column such as a scalar subquery, whose values should be few; the number of runs
    is read back (one row) before the grid is laid out.
    """
    if max_runs is not None and max_runs < 1:
        raise ValueError("max_runs must be positive")
    arrays = {
        name: values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])
        for name, values in axes.items()
    }
    run = F.col("id")
    columns, stride = {}, F.lit(1).cast("bigint")
    for name in reversed(list(arrays)):
        size = F.size(arrays[name]).cast("bigint")
        digit = F.floor(run / stride).cast("bigint") % size
        columns[name] = F.element_at(arrays[name], (digit + 1).cast("int"))
        stride = stride * size
    total = spark.range(1).select(stride).first()[0]
    return spark.range(total if max_runs is None else min(total, max_runs)).select(
        F.col("id").alias("run"), *[columns[name].alias(name) for name in arrays])


def _levels(grid: DataFrame) -> Column:
    """The distinct thresholds of a grid in order: the values of one axis."""
    return grid.agg(F.array_sort(F.collect_set("threshold"))).scalar()


def _levelled(grid: DataFrame, predictions: DataFrame, event_threshold: float) -> DataFrame:
    """Predictions with `event` and the number of the highest threshold they clear as `level` (0: none)."""
    # Binary search: the number of thresholds cleared grows by halving steps, the largest first.
    halving = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    clears = lambda n: (n <= F.size("levels")) & F.coalesce(F.get("levels", n - 1) <= F.col("score"), F.lit(False))
    cleared = F.aggregate(halving, F.lit(0), lambda n, step: F.when(clears(n + step), n + step).otherwise(n))
    event = F.coalesce(F.col("future_return") >= event_threshold, F.lit(False))
    kept = [c for c in ("timestamp", "symbol") if c in predictions.columns]
    return predictions.select("horizon", "score", *kept, _levels(grid).alias("levels"), event.alias("event"), "future_return") \
        .withColumn("level", cleared).drop("levels")


def threshold_curves(grid: DataFrame, predictions: DataFrame, event_threshold: float, top_k: int = 5) -> DataFrame:
    """Day metrics of every (horizon, threshold): share of days with a signal, signals a day among the top k, their precision,
    compounded return and deepest drawdown.

    `predictions` has horizon, timestamp, symbol, score, future_return. A day is reduced to its `top_k` rows, each with the highest
    threshold it clears; the first of them is the day's maximum and tells up to which threshold the day has a signal. Days, not
    predictions, then meet the thresholds, and a curve is as long as the calendar. A day without a signal returns 0.
    """
    if top_k < 1:
        raise ValueError("top_k must be positive")
    best = Window.partitionBy("horizon", "timestamp").orderBy(F.col("score").desc(), "symbol")
    days = (
        _levelled(grid, predictions, event_threshold)
        .withColumn("_n", F.row_number().over(best))
        .filter(F.col("_n") <= top_k)  # becomes a window group limit: pruned before the shuffle
        .groupBy("horizon", "timestamp")
        .agg(F.collect_list(F.struct("level", "event", "future_return")).alias("_best"))
    )
    chosen = F.filter("_best", lambda r: r["level"] >= F.col("_pos") + 1)
    known = F.filter(chosen, lambda r: r["future_return"].isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda x, r: x + r["future_return"])
    daily = days.select("horizon", "timestamp", "_best", F.posexplode(_levels(grid)).alias("_pos", "threshold")).select(
        "horizon", "threshold", "timestamp",
        F.size(chosen).alias("selected"),
        F.size(F.filter(chosen, lambda r: r["event"])).alias("hits"),
        F.when(F.size(known) > 0, total / F.size(known)).otherwise(F.lit(0.0)).alias("ret"),
    )
    so_far = Window.partitionBy("horizon", "threshold").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("_equity", F.product(1.0 + F.col("ret")).over(so_far)).withColumn("_peak", F.max("_equity").over(so_far))
    return curve.groupBy("horizon", "threshold").agg(
        ratio(F.count_if(F.col("selected") > 0), F.count(F.lit(1))).alias("daily_hit_day_rate"),
        ratio(F.sum("selected"), F.count(F.lit(1))).alias("average_daily_hits"),
        ratio(F.sum("hits"), F.sum("selected")).alias("top_k_precision"),
        (F.max_by("_equity", "timestamp") - 1.0).alias("net_pnl"),
        F.min(F.col("_equity") / F.col("_peak") - 1.0).alias("max_drawdown"),
    )


DAY_METRICS = ("daily_hit_day_rate", "average_daily_hits", "top_k_precision", "net_pnl", "max_drawdown")


def sweep(grid: DataFrame, predictions: DataFrame, event_threshold: float, top_k: int = 5) -> DataFrame:
    """Signals, hits, precision, recall and net mean return of every configuration.

    Only (horizon, threshold) change which predictions are selected. Each prediction is put once into the
    highest threshold it clears; counts are cumulated from the top; costs and the other axes are applied to the
    resulting few rows. `predictions` has horizon, score, future_return; where it also has timestamp and symbol, the day
    metrics of `threshold_curves` follow (0 for a horizon without predictions).
    """
    cells = (
        _levelled(grid, predictions, event_threshold)
        .groupBy("horizon", "level")
        .agg(
            F.count(F.lit(1)).alias("signals"),
            F.count_if("event").alias("hits"),
            F.sum("future_return").alias("total_return"),
        )
    )
    events = cells.groupBy("horizon").agg(F.sum("hits").alias("events"))
    points = (
        grid.select("horizon", "threshold")
        .distinct()
        .withColumn("level", F.array_position(_levels(grid), F.col("threshold")).cast("int"))
    )
    from_top = Window.partitionBy("horizon").orderBy(F.col("level").desc())
    # A cell may sit at a level this horizon's grid does not use; the union keeps it in the running sums.
    filled = points.unionByName(
        cells.select("horizon", "level"), allowMissingColumns=True
    ).groupBy("horizon", "level").agg(F.max("threshold").alias("threshold"))
    cumulative = filled.join(cells, ["horizon", "level"], "left").select(
        "horizon",
        "threshold",
        *[F.coalesce(F.sum(c).over(from_top), F.lit(0)).alias(c) for c in ("signals", "hits", "total_return")],
    )
    curve = cumulative.filter(F.col("threshold").isNotNull()).join(events, "horizon", "left")
    by_day: tuple[str, ...] = ()
    if {"timestamp", "symbol"} <= set(predictions.columns):
        by_day = DAY_METRICS
        curve = curve.join(threshold_curves(grid, predictions, event_threshold, top_k), ["horizon", "threshold"], "left")
    gross = ratio(F.col("total_return"), F.col("signals"))
    return grid.join(curve, ["horizon", "threshold"], "left").select(
        "run", *GRID_AXES,
        F.coalesce("signals", F.lit(0)).alias("signals"),
        F.coalesce("hits", F.lit(0)).alias("hits"),
        ratio(F.col("hits"), F.col("signals")).alias("precision"),
        ratio(F.col("hits"), F.col("events")).alias("recall"),
        F.when(F.col("signals") > 0, gross - F.col("cost_bps") / 10_000.0).otherwise(F.lit(0.0)).alias("net_return"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in by_day],
    )


def run_evaluator(
    grid: DataFrame, evaluator: Callable[[dict], dict], schema: str | T.StructType, partitions: int | None = None
) -> DataFrame:
    """Apply a user evaluator to every configuration, spread over the cluster; `run` keeps the order."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records = batch.to_dict("records")
            yield pd.DataFrame([{"run": config["run"], **evaluator(config)} for config in records])

    spread = grid.repartition(partitions, "run") if partitions else grid
    return spread.mapInPandas(each, schema)
