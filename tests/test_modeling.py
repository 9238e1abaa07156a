import datetime as dt
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.lineage import written
from tidemark.operators import modeling as ops

FEATURES = ("a", "b")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(2)
    out = []
    for i in range(400):
        a, b = rng.normal(), rng.normal()
        y = float(rng.random() < 1 / (1 + np.exp(-(1.5 * a - b))))
        out.append((f"S{i % 4}", dt.date(2022, 1, 1) + dt.timedelta(days=i // 4), float(a), float(b), y))
    return written(spark.createDataFrame(out, "symbol string, timestamp date, a double, b double, target double"))


def test_standardize_population_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = ops.standardize(df, FEATURES).orderBy("a").collect()
    assert [(r.a_z, r.b_z) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]


def test_fit_reaches_the_penalized_optimum(labelled):
    model = ops.logistic_fit(labelled, FEATURES)
    pdf = labelled.toPandas()
    x = pdf[list(FEATURES)].to_numpy()
    z = np.c_[np.ones(len(x)), (x - x.mean(0)) / x.std(0)]
    w = np.array([model.intercept, *model.coefficients])
    p = 1 / (1 + np.exp(-z @ w))
    gradient = z.T @ (p - pdf.target) / len(pdf) + 0.01 * np.r_[0, w[1:]]
    assert np.abs(gradient).max() < 1e-4
    scored = model.predict(labelled).toPandas()
    assert np.allclose(scored.probability, p)


def test_empty_fit_raises(labelled):
    with pytest.raises(ValueError):
        ops.logistic_fit(labelled.limit(0), FEATURES)


def test_chrono_split_positions(labelled):
    got = ops.chrono_split(labelled, 0.2).toPandas().sort_values(["timestamp", "symbol"]).reset_index(drop=True)
    assert (got.pos == got.index).all() and got.is_test.sum() == 80 and not got.is_test[:320].any()


def test_expanding_segments(labelled):
    got = ops.expanding_folds(labelled, 5).toPandas()
    edges = np.linspace(0, 400, 7, dtype=int)
    assert (got.segment == np.searchsorted(edges, got.pos, side="right") - 1).all()


def descended(x, y, epochs=400, rate=0.05, l2=0.01):
    """Plain gradient descent on standardized rows, stopped after `epochs` steps: (means, deviations, weights)."""
    mean, std = x.mean(0), np.where(x.std(0) == 0, 1.0, x.std(0))
    z, w = np.c_[np.ones(len(x)), (x - mean) / std], np.zeros(x.shape[1] + 1)
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - rate * (z.T @ (p - y) / len(y) + l2 * np.r_[0.0, w[1:]])
    return mean, std, w


def test_descent_stops_where_plain_steps_do(labelled):
    pdf = labelled.toPandas()
    mean, std, w = descended(pdf[list(FEATURES)].to_numpy(), pdf.target.to_numpy())
    model = ops.descent_fit(labelled.repartition(3), FEATURES)
    assert np.allclose([model.intercept, *model.coefficients], w, atol=1e-12) and np.allclose(model.means, mean) and np.allclose(model.deviations, std)
    optimum = ops.logistic_fit(labelled, FEATURES)
    assert abs(optimum.coefficients[0] - w[1]) > 1e-3  # 400 steps do not converge


def test_descent_takes_few_scans(labelled, monkeypatch):
    from tidemark.operators import descent

    scans, totals = [], descent._totals
    monkeypatch.setattr(descent, "_totals", lambda *a: scans.append(1) or totals(*a))
    for steps in (0, 1, 2, 5, 400):
        scans.clear()
        pdf = labelled.toPandas()
        _, _, w = descended(pdf[list(FEATURES)].to_numpy(), pdf.target.to_numpy(), steps)
        model = ops.descent_fit(labelled, FEATURES, epochs=steps)
        assert np.allclose([model.intercept, *model.coefficients], w, atol=1e-12) and len(scans) <= 10


def test_descent_of_constant_features_and_one_label(labelled):
    flat = labelled.withColumn("b", F.lit(7.0)).withColumn("target", F.lit(1.0))
    pdf = flat.toPandas()
    _, _, w = descended(pdf[list(FEATURES)].to_numpy(), pdf.target.to_numpy(), 50)
    model = ops.descent_fit(flat, FEATURES, epochs=50)
    assert np.allclose([model.intercept, *model.coefficients], w, atol=1e-12)
    with pytest.raises(ValueError, match="empty"):
        ops.descent_fit(labelled.limit(0), FEATURES)


def test_chrono_train_test_equals_plain_fit(labelled):
    model, metrics = ops.chrono_train_test(labelled, 0.2, lambda train: ops.descent_fit(train, FEATURES))
    pdf = labelled.toPandas().sort_values(["timestamp", "symbol"], ignore_index=True)
    x, y = pdf[list(FEATURES)].to_numpy(), pdf.target.to_numpy()
    mean, std, w = descended(x[:320], y[:320])
    called = (np.c_[np.ones(80), (x[320:] - mean) / std] @ w) >= 0
    got = metrics.first()
    assert got.train_rows == 320 and got.test_rows == 80
    assert got.test_precision == round(y[320:][called].mean(), 6) and got.test_recall == round(called[y[320:] == 1].mean(), 6)


@pytest.mark.parametrize("solver", ["descent", "newton"])
def test_walk_forward_expanding(labelled, solver):
    got = ops.walk_forward_expanding(labelled, 3, FEATURES, solver).toPandas().sort_values("fold", ignore_index=True)
    pdf = labelled.toPandas().sort_values(["timestamp", "symbol"], ignore_index=True)
    x, y = pdf[list(FEATURES)].to_numpy(), pdf.target.to_numpy()
    edges = np.linspace(0, 400, 5, dtype=int)
    for fold, (a, b) in enumerate(zip(edges[1:-1], edges[2:])):
        mean, std, w = descended(x[:a], y[:a], 400 if solver == "descent" else 40_000)
        called = (np.c_[np.ones(b - a), (x[a:b] - mean) / std] @ w) >= 0
        assert tuple(got.iloc[fold]) == (fold + 1, b - a, round(y[a:b][called].mean(), 6), round(called[y[a:b] == 1].mean(), 6))
    with pytest.raises(ValueError):
        ops.walk_forward_expanding(labelled.limit(10), 2, FEATURES)
    one_class = labelled.withColumn("target", F.lit(1.0))
    assert ops.walk_forward_expanding(one_class, 2, FEATURES).count() == 0


def test_newton_folds_reach_the_optimum_in_few_scans(labelled, monkeypatch):
    from tidemark.operators import descent

    scans, totals = [], descent._totals
    monkeypatch.setattr(descent, "_totals", lambda *a: scans.append(1) or totals(*a))
    segmented = written(ops.expanding_folds(labelled, 4).select("a", "b", "target", "segment"))
    fits = descent.fit_folds(segmented, FEATURES, "target", "segment", [1, 2, 3, 4], "newton")
    assert len(scans) < 12 and len(fits) == 4
    pdf = segmented.toPandas()
    for fold, fit in fits.items():
        part = pdf[pdf.segment < fold]
        z = np.c_[np.ones(len(part)), (part[list(FEATURES)].to_numpy() - fit.moments.mean) / fit.moments.scale()]
        gradient = z.T @ (1 / (1 + np.exp(-z @ fit.weights)) - part.target.to_numpy()) / len(part) + 0.01 * np.r_[0, fit.weights[1:]]
        assert np.abs(gradient).max() < 1e-9


def test_rolling_folds_match_slices(labelled):
    got = ops.rolling_folds(labelled, 100, 30).toPandas()
    i, fold = 100, 0
    while i < 400:
        for role, want in (("train", range(i - 100, i)), ("test", range(i, min(400, i + 30)))):
            assert sorted(got[(got.fold == fold) & (got.role == role)].pos) == list(want)
        i, fold = i + 30, fold + 1
    assert got.fold.max() == fold - 1
    with pytest.raises(ValueError):
        ops.rolling_folds(labelled, 0, 1)


def test_benchmark_sees_only_the_past(labelled):
    def predictor(train, test):
        assert train.pos.max() < test.pos.min()
        return pd.DataFrame({"fold": test.fold, "n_train": len(train), "pos": test.pos})

    got = ops.walk_forward_benchmark(labelled, predictor, "fold bigint, n_train bigint, pos bigint", 100, 30).toPandas()
    assert sorted(got.pos) == list(range(100, 400)) and (got.n_train == 100).all()


AXES = {"model": ["m1", "m2"], "feature_set": ["f1", "f2"], "horizon": [1, 2], "threshold": [0.5, 0.6], "cost_bps": [10.0, 20.0], "seed": [1, 2]}


def test_grid_is_the_capped_product(spark):
    got = [tuple(r)[1:] for r in ops.parameter_grid(spark, AXES, 10).orderBy("run").collect()]
    assert got == list(product(*AXES.values()))[:10]
    assert ops.parameter_grid(spark, AXES).count() == 64
    with pytest.raises(ValueError):
        ops.parameter_grid(spark, AXES, 0)


def test_sweep_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(int(h), float(rng.random()), float(rng.normal(0, 0.1))) for h in (1, 2) for _ in range(200)]
    grid = ops.parameter_grid(spark, {**AXES, "threshold": [0.2, 0.5, 1.5]})
    got = ops.sweep(grid, spark.createDataFrame(rows, "horizon int, score double, future_return double"), 0.1).collect()
    assert len(got) == 96
    for r in got:
        chosen = [x for h, s, x in rows if h == r.horizon and s >= r.threshold]
        hits, events = sum(x >= 0.1 for x in chosen), sum(x >= 0.1 for h, _, x in rows if h == r.horizon)
        assert (r.signals, r.hits) == (len(chosen), hits)
        assert r.recall == pytest.approx(hits / events) and r.precision == pytest.approx(hits / len(chosen) if chosen else 0)
        assert r.net_return == pytest.approx(np.mean(chosen) - r.cost_bps / 1e4 if chosen else 0.0)


def test_sweep_day_metrics_match_days_taken_one_by_one(spark):
    rng = np.random.default_rng(9)
    day0 = dt.date(2024, 1, 1)
    rows = [(int(h), day0 + dt.timedelta(days=int(d)), f"S{i}", None if rng.random() < 0.05 else round(float(rng.random()), 1), None if rng.random() < 0.05 else float(rng.normal(0, 0.1)))
            for h in (1, 2) for d in range(25) for i in range(rng.integers(1, 9))]
    grid = ops.parameter_grid(spark, {**AXES, "horizon": [1, 2, 3], "threshold": [0.2, 0.5, 0.9, 1.5]})
    got = ops.sweep(grid, spark.createDataFrame(rows, "horizon int, timestamp date, symbol string, score double, future_return double"), 0.1, top_k=3).collect()
    assert len(got) == 192
    for r in got:
        days = sorted({d for h, d, *_ in rows if h == r.horizon})
        equity, peak, worst, signals, hits, active = 1.0, None, 0.0, 0, 0, 0
        for day in days:
            best = sorted((x for x in rows if x[:2] == (r.horizon, day) and x[3] is not None), key=lambda x: (-x[3], x[2]))[:3]
            best = [x[4] for x in best if x[3] >= r.threshold]
            known = [x for x in best if x is not None]
            equity *= 1 + (sum(known) / len(known) if known else 0.0)
            peak = equity if peak is None else max(peak, equity)
            worst = min(worst, equity / peak - 1)
            signals, hits, active = signals + len(best), hits + sum(x >= 0.1 for x in known), active + bool(best)
        want = (active / len(days), signals / len(days), hits / signals if signals else 0, equity - 1, worst) if days else (0,) * 5
        assert [r[c] for c in ops.DAY_METRICS] == pytest.approx(want)


def test_evaluator_keeps_run_numbers(spark):
    grid = ops.parameter_grid(spark, AXES)
    got = ops.run_evaluator(grid, lambda c: {"value": c["horizon"] * c["threshold"]}, "run bigint, value double", partitions=3)
    want = {r.run: r.horizon * r.threshold for r in grid.collect()}
    assert {r.run: r.value for r in got.collect()} == want
