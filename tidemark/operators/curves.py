"""Performance of equity curves ``(scenario, date, value)``: one row per
scenario and calendar day, so windows per scenario are calendar-bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Settings
from tidemark.functions.columns import growth, ratio
from tidemark.operators.asof import align_to_calendar
from tidemark.operators.trades import closed_metrics

KEY = "scenario"


def _w() -> Window:
    return Window.partitionBy(KEY).orderBy("date")


def with_returns(curve: DataFrame) -> DataFrame:
    return curve.withColumn("ret", growth("value", F.lag("value").over(_w())))


def with_drawdown(curve: DataFrame) -> DataFrame:
    peak = F.max("value").over(_w().rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("peak", peak).withColumn("drawdown", ratio(F.col("value") - F.col("peak"), "peak"))


def rolling_alpha(pairs: DataFrame, rows: int = 252) -> DataFrame:
    """Trailing sum of (model - benchmark) daily returns in percent, once full."""
    frame = _w().rowsBetween(-(rows - 1), 0)
    r = (pairs.withColumn("_d", growth("model", F.lag("model").over(_w()))
                          - growth("bench", F.lag("bench").over(_w()))))
    full = F.count("_d").over(frame) == rows
    return r.withColumn("rolling_alpha", F.when(full, F.sum("_d").over(frame) * 100)).drop("_d")


def annualised(first: Column, last: Column, days: Column) -> Column:
    return F.when((days > 0) & (first != 0), F.pow(ratio(last, first), ratio(F.lit(365.25), days)) - 1)


def curve_metrics(curve: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Annual return, Sharpe ratio and maximum drawdown per scenario."""
    daily = (1 + cfg.risk_free) ** (1 / 252) - 1
    rows = with_returns(with_drawdown(curve)).withColumn("excess", F.col("ret") - daily)
    a = rows.groupBy(KEY).agg(
        F.min_by("value", "date").alias("v0"), F.max_by("value", "date").alias("v1"),
        F.datediff(F.max("date"), F.min("date")).alias("days"),
        F.count("ret").alias("n"), F.avg("excess").alias("mean"), F.stddev_samp("excess").alias("sd"),
        F.min("drawdown").alias("max_drawdown"))
    sharpe = F.when((F.col("n") >= 20) & (F.col("sd") > 0), F.col("mean") / F.col("sd") * F.sqrt(F.lit(252.0)))
    return a.select(KEY, annualised(F.col("v0"), F.col("v1"), F.col("days")).alias("ann_return"),
                    sharpe.alias("sharpe"), "max_drawdown", F.col("n").alias("n_returns"))


def yearly_returns(curve: DataFrame) -> DataFrame:
    """Change of each year's last value; the first year has none."""
    y = curve.groupBy(KEY, F.year("date").cast("bigint").alias("year")).agg(F.max_by("value", "date").alias("last"))
    w = Window.partitionBy(KEY).orderBy("year")
    return (y.withColumn("ret", growth("last", F.lag("last").over(w)))
            .where(F.col("ret").isNotNull()).select(KEY, "year", "ret"))


def year_table(curve: DataFrame, model: str, bench: str) -> DataFrame:
    y = yearly_returns(curve)
    m = y.where(F.col(KEY) == model).select("year", F.col("ret").alias("model"))
    b = y.where(F.col(KEY) == bench).select("year", F.col("ret").alias("bench"))
    return (m.join(b, "year", "full_outer")
            .withColumn("difference", F.col("model") - F.col("bench")))


def year_matrix(curve: DataFrame, scenarios: list[str]) -> DataFrame:
    """Years by scenario."""
    return yearly_returns(curve).groupBy("year").pivot(KEY, scenarios).agg(F.first("ret"))


def metric_matrix(metrics: DataFrame, names: list[str], scenarios: list[str]) -> DataFrame:
    """Metrics by scenario."""
    long = metrics.unpivot([KEY], names, "metric", "v")
    return long.groupBy("metric").pivot(KEY, scenarios).agg(F.first("v"))


def buy_and_hold(series: DataFrame, capital: float) -> DataFrame:
    """``(date, close)`` normalised to ``capital`` on its first day."""
    first = F.first("close", ignorenulls=True).over(
        _w().rowsBetween(Window.unboundedPreceding, 0))
    return (series.withColumn(KEY, F.lit("benchmark"))
            .select(KEY, "date", (ratio("close", first) * capital).alias("value")))


def regime_flags(features: DataFrame) -> DataFrame:
    """Days below the long EMA and the crossings."""
    b = features.withColumn(KEY, F.lit("benchmark")).withColumn("bear", F.col("close") < F.col("ema_200"))
    before = F.lag("bear").over(_w())
    return b.select("date", "bear", F.when(F.col("bear") & ~before, "DOWN")
                    .when(~F.col("bear") & before, "UP").alias("crossing"))


def align(model: DataFrame, bench: DataFrame) -> DataFrame:
    """``(scenario, date, model, bench)`` on the benchmark's days; the model's value is
    carried forward over days it lacks, and NULL before its first one."""
    on_days = align_to_calendar(model.select(KEY, "date", "value"), bench.select("date"), KEY, "value")
    return bench.select("date", F.col("value").alias("bench")).join(on_days.withColumnRenamed("value", "model"), "date", "left")


def metric_row(model: DataFrame, bench: DataFrame, trades: DataFrame, mode: str, cfg: Settings = DEFAULT) -> DataFrame:
    """A run's published row: returns, alpha, Sharpe ratios and drawdowns of the
    aligned curves next to its trade counts."""
    both = align(model, bench).where(F.col("model").isNotNull()).select("date", "model", "bench").unpivot("date", ["model", "bench"], KEY, "value")
    m = curve_metrics(both, cfg)
    value = lambda who, what: F.max(F.when(F.col(KEY) == who, F.col(what)))
    row = m.agg(value("model", "ann_return").alias("ann_return_model"), value("bench", "ann_return").alias("ann_return_bench"),
                value("model", "sharpe").alias("sharpe_model"), value("bench", "sharpe").alias("sharpe_bench"),
                value("model", "max_drawdown").alias("max_dd_model"), value("bench", "max_drawdown").alias("max_dd_bench"))
    row = row.withColumn("alpha", F.col("ann_return_model") - F.col("ann_return_bench")).withColumn("mode", F.lit(mode))
    return row.join(closed_metrics(trades.withColumn("mode", F.lit(mode)), ["mode"]), "mode", "left")
