"""Composite scores, daily rankings and the report tables built from them."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, clip_or, number, rounded
from ..schemas import WATCH_LEVELS, require
from .exposure import LAYER_COLUMNS, attach_layers
from .features import feature_snapshot, latest_ranker_features
from .scoring import add_risk_reward, flow_score_100, snapshot_score

# Report texts and line formats.
NO_SIGNAL_LINE = "🔴 BUGÜN KALİTELİ TAVAN SİNYALİ YOK."
CANDIDATE_FORMAT = "%d. %s | skor=%.2f | veri-kapsamı=%.0f%%"
UNIVERSE_FORMAT = "Evren: %d | OHLCV satırı: %d"
SOURCES_FORMAT = "Kaynaklar: HISTORICAL + KAP:%d + NEWS:%d + FUND:%d"
BOARD_TITLE = "BIST PERFORMANS LİDERLERİ"
EMPTY_BOARD_LINE = "• Yeterli geçmiş veri yok."
THIN_FORMAT = "%d. %s | skor=%s"
NO_CANDIDATE_LINES = ("🔴 BUGÜN KALİTELİ TAVAN SİNYALİ YOK", "Veri kaynağından aday üretilemedi.")
BOARD_FORMAT = "%2d. %-8s %%%7.2f %s%02d"
SIGNAL, NO_SIGNAL = "SIGNAL", "NO_QUALITY_SIGNAL"


# Share of each layer in the blended score.
LAYER_WEIGHTS = {"market": 0.50, "smart_money": 0.20, "consensus": 0.10, "research": 0.10, "fundamentals": 0.10}


_SOURCES = {
    "market": "score", "smart_money": "smart_money_score", "consensus": "consensus_score",
    "research": "research_score", "fundamentals": "fundamental_score",
}


def composite_score(df: DataFrame, weights: Mapping[str, float] = LAYER_WEIGHTS, missing_is_null: bool = False) -> DataFrame:
    """Blend the market score with optional layers; absent layers count as a neutral 50.

    `weights` gives each layer its share; shares are not negative and add up to one.

    Coverage is the share of layers that differ from 50, so a genuine 50 counts as missing. With
    `missing_is_null` it counts the layers that were really there.
    """
    require(df, ("symbol", "score"), "frame")
    if set(weights) != set(_SOURCES) or any(w < 0 for w in weights.values()) or not math.isclose(sum(weights.values()), 1.0, abs_tol=1e-8):
        raise ValueError(f"weights must share one among {', '.join(_SOURCES)}")
    total, covered = F.lit(0.0), F.lit(0)
    layers: dict[str, Column] = {}
    for layer, weight in weights.items():
        source = _SOURCES[layer]
        given = number(source) if source in df.columns else F.lit(None).cast("double")
        layers[f"{layer}_layer"] = clip_or(given, 50.0, 0.0, 100.0)
        present = given.isNotNull() if missing_is_null else layers[f"{layer}_layer"] != 50.0
        total = total + F.lit(weight) * layers[f"{layer}_layer"]
        covered = covered + present.cast("int")
    return df.withColumns(
        {
            **layers,
            "institutional_score": rounded(total, 2),
            "institutional_data_coverage": rounded(covered / F.lit(float(len(layers))), 2),
        }
    )


def rank_latest(
    bars: DataFrame,
    layers: dict[str, DataFrame] | None = None,
    watch: DataFrame | None = None,
    *,
    min_score: float = 65.0,
    top_k: int = 20,
    weights: Mapping[str, float] = LAYER_WEIGHTS,
    watch_share: float = 0.10,
) -> DataFrame:
    """Top symbols by the latest bar's score, blended with layers and gated by watchlist reward/risk.

    Bars are cut to the last 21 per symbol before any feature is computed, and layers join after that, to
    one row per symbol. Layer and watch columns may also come on the bars themselves. `watch_share` is the part of the
    watch score in the score of a symbol that passes the gate.
    """
    if not 0 <= watch_share <= 1:
        raise ValueError("watch_share lies between 0 and 1")
    latest = latest_ranker_features(bars)
    if layers:
        latest = attach_layers(latest, layers)
    if set(LAYER_COLUMNS) & set(latest.columns):
        ranked = composite_score(latest, weights)
    else:
        ranked = latest.withColumn("institutional_score", F.col("score")).withColumn(
            "institutional_data_coverage", F.lit(0.0)
        )
    if watch is None and set(WATCH_LEVELS) <= set(latest.columns):
        watch = latest.select("symbol", *WATCH_LEVELS)
        ranked = ranked.drop(*WATCH_LEVELS)
    if watch is not None:
        ranked = _technical_gate(ranked, watch, watch_share)
    return (
        ranked.filter(F.col("institutional_score") >= min_score)
        .orderBy(F.col("institutional_score").desc(), "symbol")
        .limit(top_k)
    )


def _technical_gate(ranked: DataFrame, watch: DataFrame, weight: float) -> DataFrame:
    """Drop symbols whose complete levels offer less than 1:1; blend the watch score into the others."""
    judged = add_risk_reward(watch.select("symbol", *WATCH_LEVELS).na.drop(subset=list(WATCH_LEVELS)))
    judged = judged.select(
        "symbol", "technical_watch_score", "target_upside_pct", "stop_downside_pct", "risk_reward",
        F.coalesce(F.col("risk_reward") >= 1.0, F.lit(False)).alias("technical_risk_gate"),
    )
    blended = rounded(
        F.lit(1 - weight) * F.col("institutional_score") + F.lit(weight) * F.col("technical_watch_score"), 2
    )
    gate = F.col("technical_risk_gate")
    return (
        ranked.join(judged, "symbol", "left")
        .filter(gate.isNull() | gate)
        .withColumn("institutional_score", F.when(gate, blended).otherwise(F.col("institutional_score")))
    )


def rank_candidates(
    bars: DataFrame,
    flows: DataFrame | None = None,
    min_score: float = 70.0,
    top_k: int = 20,
    flow_weight: float = 0.20,
    flow_scale: float = 100_000_000.0,
) -> DataFrame:
    """Rank feature snapshots, blending the estimated stock flow (symbol, flow) where there is one."""
    if not 0 <= flow_weight <= 1:
        raise ValueError("flow_weight must be between 0 and 1")
    if flow_scale <= 0:
        raise ValueError("flow_scale must be positive")
    return rank_snapshots(feature_snapshot(bars), flows, min_score, top_k, flow_weight, flow_scale)


def rank_snapshots(
    snapshots: DataFrame, flows: DataFrame | None, min_score: float, top_k: int, flow_weight: float, flow_scale: float
) -> DataFrame:
    base = snapshots.withColumn("base_score", snapshot_score())
    base = base.join(flows.select("symbol", "flow"), "symbol", "left") if flows is not None else base.withColumn(
        "flow", F.lit(None).cast("double")
    )
    flow = F.col("flow")
    blended = rounded(
        F.col("base_score") * F.lit(1 - flow_weight) + flow_score_100(flow, flow_scale) * F.lit(flow_weight), 2
    )
    score = rounded(clip(F.when(flow.isNotNull(), blended).otherwise(F.col("base_score")), 0.0, 100.0), 2)
    reasons = F.array(
        F.when(F.col("volume_ratio") >= 2, F.lit("volume anomaly")),
        F.when(F.col("breakout_20") >= 0.98, F.lit("near 20-bar high")),
        F.when(F.col("return_5") > 0.03, F.lit("positive 5-bar momentum")),
        F.when(flow >= flow_scale, F.lit("smart money accumulation")).when(
            flow <= -flow_scale, F.lit("smart money distribution")
        ),
    )
    return (
        base.select("symbol", score.alias("score"), F.array_compact(reasons).alias("reasons"))
        .withColumn("confidence", clip(F.lit(0.35) + F.col("score") / 150.0, 0.01, 0.99))
        .filter(F.col("score") >= min_score)
        .orderBy(F.col("score").desc(), "symbol")
        .limit(top_k)
    )


def ranking_status(ranked: DataFrame) -> DataFrame:
    """One row: how many candidates there are, and an explicit status when there is none."""
    n = F.count(F.lit(1))
    return ranked.agg(n.alias("candidates"), F.when(n > 0, SIGNAL).otherwise(NO_SIGNAL).alias("status"))


def daily_signal(ranked: DataFrame, strong: float = 85.0) -> DataFrame:
    """Label ranked rows by their market score."""
    return ranked.withColumn("signal", F.when(F.col("score") >= strong, "STRONG").otherwise("WATCH"))


def morning_report(
    ranked: DataFrame,
    bars: DataFrame,
    universe: DataFrame,
    title: str,
    top_k: int = 20,
    sources: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Report lines (line, text): title, universe size, then the ranked symbols or the no-signal line, then the sources.

    `sources` are the disclosure, news and fund rows whose numbers the last line gives; without them it is left out.
    The at most `top_k` ranked rows are folded into one array, so the ranking itself is evaluated once.
    """
    entry = F.struct((-F.col("institutional_score")).alias("k"), "symbol", "institutional_score", "institutional_data_coverage")
    best = ranked.orderBy(F.col("institutional_score").desc(), "symbol").limit(top_k)
    folded = best.agg(F.sort_array(F.collect_list(entry)).alias("rows"))

    def candidate(r: Column, i: Column) -> Column:
        share = r["institutional_data_coverage"] * 100.0
        text = F.format_string(CANDIDATE_FORMAT, i + 1, r["symbol"], r["institutional_score"], share)
        return F.struct((i + 3).alias("line"), text.alias("text"))

    nothing = F.array(F.struct(F.lit(3).alias("line"), F.lit(NO_SIGNAL_LINE).alias("text")))
    lines = F.when(F.size("rows") > 0, F.transform("rows", candidate)).otherwise(nothing)
    if sources:
        counts = [source.agg(F.count(F.lit(1))).scalar() for source in sources]
        last = F.struct((F.greatest(F.size("rows"), F.lit(1)) + 3).alias("line"), F.format_string(SOURCES_FORMAT, *counts).alias("text"))
        lines = F.concat(lines, F.array(last))
    symbols = universe.agg(F.countDistinct("symbol")).scalar()
    sizes = bars.agg(F.count(F.lit(1)).alias("n")).withColumn("symbols", symbols)
    head = F.array(
        F.struct(F.lit(1).alias("line"), F.lit(title).alias("text")),
        F.struct(F.lit(2).alias("line"), F.format_string(UNIVERSE_FORMAT, "symbols", "n").alias("text")),
    )
    return sizes.select(F.inline(head)).unionByName(folded.select(F.inline(lines)))


def _with_head(lines: DataFrame, head: list[str], nothing: list[str]) -> DataFrame:
    """Lines numbered from 1 behind the `head`, or the lines of `nothing` when there is none."""
    some = lines.limit(1).agg(F.count(F.lit(1))).scalar() > 0
    texts = lambda found: F.array(*[F.struct(F.lit(i).alias("line"), F.lit(t).alias("text")) for i, t in enumerate(found)])
    heads = F.when(some, texts(head)).otherwise(texts(nothing))
    first = lines.sparkSession.range(1).select(F.inline(heads))
    return first.unionByName(lines.select(F.col("line").cast("int"), "text"))


def thin_report(records: DataFrame, order: str, title: str, top_k: int = 20) -> DataFrame:
    """Lines (line, text) of the first records by `order`, with a question mark for what is missing; a notice without any."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?")) if c in records.columns else F.lit("?")
    first = records.orderBy(order).limit(top_k).select(shown("symbol").alias("symbol"), shown("score").alias("score"), F.row_number().over(Window.orderBy(order)).alias("line"))
    return _with_head(first.select("line", F.format_string(THIN_FORMAT, "line", "symbol", "score").alias("text")), [title], list(NO_CANDIDATE_LINES))


def board_lines(board: DataFrame, title: str | None = None) -> DataFrame:
    """Leaderboard lines with an arrow for the rank change; with a `title` as line 0, and a notice for an empty board."""
    arrow = F.when(F.col("rank_change") > 0, "↑").when(F.col("rank_change") < 0, "↓").otherwise("→")
    text = F.format_string(
        BOARD_FORMAT, F.col("rank"), F.col("symbol"), F.col("period_return_pct"), arrow, F.abs("rank_change")
    )
    lines = board.select(F.col("rank").alias("line"), text.alias("text"))
    return lines if title is None else _with_head(lines, [title], [title, EMPTY_BOARD_LINE])


def paper_selection(
    ranked: DataFrame,
    top_k: int = 5,
    initial_equity: float = 5_000_000.0,
    max_position_pct: float = 0.10,
    max_open_positions: int = 5,
    max_order_notional: float = 100_000.0,
    commission: float = 0.001,
    slippage: float = 0.001,
) -> DataFrame:
    """Entry price, quantity and cost of the top ranked symbols under the position limits."""
    notional = min(initial_equity * max_position_pct, max_order_notional)
    chosen = ranked.orderBy(F.col("institutional_score").desc(), "symbol").limit(min(max(1, top_k), max_open_positions))
    price = F.col("close") * F.lit(1 + slippage)
    return chosen.select(
        "symbol",
        price.alias("entry_price"),
        F.try_divide(F.lit(notional), price).alias("quantity"),
        F.lit(notional * (1 + commission)).alias("entry_cost"),
    ).filter(F.col("quantity") > 0)
