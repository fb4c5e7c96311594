"""Trade-log analytics. Trades: ``ticker, tier, entry_date, entry_price,
exit_date, exit_price, return_dec, return_pct, pnl_dollars, hold_days,
exit_reason``. Grouped figures combine map-side; anything that depends on the
order of trades goes through ordered chunks (``compound``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Settings
from tidemark.functions.columns import spread
from tidemark.operators.compound import (
    chunk_summaries, combine_chunks, compound_curve, merged_moments, moments, pooled)
from tidemark.operators.ranks import percentiles

# Trades of one entry day have no order of their own; md5 of the ticker fixes
# one, and its first digit splits a busy day into sixteen chunks.
CHUNK = ["entry_date", "_h"]
ORDER = ["_md5", "ticker", "exit_date"]


def ordered(trades: DataFrame) -> DataFrame:
    return (trades.withColumn("_md5", F.md5(F.col("ticker").cast("string")))
            .withColumn("_h", spread("ticker", 1)))


def rescaled(trades: DataFrame, col: str = "return_pct") -> DataFrame:
    """Adds ``return_dec``/``return_pct``: a log whose mean absolute return
    exceeds 1 is taken to be in percent."""
    percent = trades.agg(F.coalesce(F.avg(F.abs(F.col(col))) > 1, F.lit(False))).scalar()
    t = trades.withColumn("_percent", percent)
    dec = F.when(F.col("_percent"), F.col(col) / 100).otherwise(F.col(col))
    return t.withColumn("return_dec", dec).withColumn("return_pct", F.col("return_dec") * 100).drop("_percent")


def win(r: Column) -> Column:
    return F.avg((r > 0).cast("double"))


def closed_metrics(trades: DataFrame, by: list[str]) -> DataFrame:
    """Win rate and count leave out trades closed by the end of data; the
    average hold covers all."""
    closed = (F.col("exit_reason") != "backtest_end") & F.col("return_dec").isNotNull()
    return trades.groupBy(*by).agg(
        F.avg(F.when(closed, (F.col("return_dec") > 0).cast("double"))).alias("win_rate"),
        F.count(F.lit(1)).alias("total_trades"), F.count_if(closed).alias("closed_trades"),
        F.avg("hold_days").alias("avg_hold_days"))


def trade_stats(trades: DataFrame) -> DataFrame:
    """Per tier and overall (``tier`` NULL); trades without a tier count as ``unknown``."""
    r = F.col("return_pct")
    return trades.withColumn("tier", F.coalesce("tier", F.lit("unknown"))).rollup("tier").agg(
        F.count(F.lit(1)).alias("n"), win(r).alias("win_rate"), F.avg(r).alias("mean"),
        F.max(r).alias("best"), F.min(r).alias("worst"), F.avg("hold_days").alias("avg_hold"))


def exit_profile(trades: DataFrame) -> DataFrame:
    return trades.groupBy("exit_reason").agg(
        F.count(F.lit(1)).alias("n"), win(F.col("return_dec")).alias("win_rate"),
        F.sum("pnl_dollars").alias("pnl"))


def trade_curve(trades: DataFrame, by: list[str] | None = None, cfg: Settings = DEFAULT) -> DataFrame:
    """Equity after each trade, compounded in entry order."""
    t = ordered(trades.where(F.col("return_dec").isNotNull()))
    return compound_curve(t, by or [], CHUNK, ORDER, F.col("return_dec"), cfg.position_size,
                          cfg.capital).drop("_h", "_md5")


def exit_dated_curve(trades: DataFrame, by: list[str], cfg: Settings = DEFAULT) -> DataFrame:
    """The entry-ordered equity restamped with exit dates: one point per trade
    in order of (exit date, entry order), and the drawdown along that order.

    The running peak is put together from three levels (trade within a chunk
    of one exit day, chunk within the day, days), so a day on which a large
    part of the log closes is not one task; days per group are calendar-sized.
    """
    curve = ordered(trade_curve(trades, by, cfg)).withColumnRenamed("exit_date", "date")
    day, chunk = [*by, "date"], [*by, "date", "entry_date", "_h"]
    upto = Window.partitionBy(*chunk).orderBy("_md5", "ticker", "tier").rowsBetween(Window.unboundedPreceding, 0)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    chunks = curve.groupBy(*chunk).agg(F.max("equity").alias("_hi"))
    chunks = chunks.withColumn("_in_day", F.max("_hi").over(earlier(Window.partitionBy(*day).orderBy("entry_date", "_h"))))
    days = chunks.groupBy(*day).agg(F.max("_hi").alias("_day_hi"))
    days = days.withColumn("_days", F.max("_day_hi").over(earlier(Window.partitionBy(*by).orderBy("date"))))
    peaks = chunks.join(days, day).select(*chunk, "_in_day", "_days")
    peak = F.greatest(F.lit(cfg.capital), F.max("equity").over(upto), "_in_day", "_days")
    return curve.join(peaks, chunk).select(*by, "date", "entry_date", "ticker", "equity", ((F.col("equity") - peak) / peak).alias("drawdown"))


def period_metrics(trades: DataFrame, periods: DataFrame, bench: DataFrame,
                   cfg: Settings = DEFAULT) -> DataFrame:
    """All figures of trades entered in each period, one pass for all periods.

    ``periods`` (period, kind, fold, start_year, end_year; end exclusive) is
    spread to one row per covered year, so trades meet them by an equi-join on
    the entry year. ``bench`` (year, ret_pct) holds the benchmark's years.
    """
    ids = ["period", "kind", "fold"]
    years = periods.withColumn("year", F.explode(F.sequence("start_year", F.col("end_year") - 1)))
    t = ordered(trades.where(F.col("return_dec").isNotNull())).withColumn("year", F.year("entry_date").cast("bigint"))
    dec, pct, size = F.col("return_dec"), F.col("return_pct"), cfg.position_size
    # Chunks (day x salt) lie within one year, so they are summed up once and
    # only their summaries are repeated for every period that covers them.
    chunks = chunk_summaries(
        t, ["year"], CHUNK, ORDER, 1 + size * dec, *moments(dec * size, "r"),
        F.count_if(F.col("tier") == "qvm").alias("qvm"), F.count_if(F.col("tier") == "crash").alias("crash"),
        F.count_if(pct > 0).alias("won_n"), F.sum(pct).alias("pct_sum"), F.max(pct).alias("best"), F.min(pct).alias("worst"),
        F.sum("hold_days").alias("hold_sum"), F.count("hold_days").alias("hold_n"),
        F.sum(F.when(pct > 0, pct)).alias("won"), F.sum(F.when(pct <= 0, pct)).alias("lost"))
    base = combine_chunks(
        chunks.join(years, "year"), [*ids, "start_year", "end_year"], CHUNK, *merged_moments("r"),
        F.sum("qvm").alias("n_qvm"), F.sum("crash").alias("n_crash"), F.sum("won_n").alias("_won_n"),
        F.sum("pct_sum").alias("_pct"), F.max("best").alias("best_trade"), F.min("worst").alias("worst_trade"),
        (F.sum("hold_sum") / F.sum("hold_n")).alias("avg_hold"),
        F.coalesce(F.sum("won"), F.lit(0.0)).alias("_won"), F.sum("lost").alias("_lost"))
    mean, sd = pooled("r")
    base = (base.withColumn("_mean", mean).withColumn("_sd", sd).withColumn("n_trades", F.col("r_n"))
            .withColumn("win_rate", F.col("_won_n") / F.col("r_n") * 100)
            .withColumn("avg_return", F.col("_pct") / F.col("r_n")))
    median = percentiles(t.select("year", "return_pct").join(years, "year"), ids, "return_pct", {"median_return": 0.5})
    market = (years.join(bench, "year")
              .groupBy(*ids).agg(F.product(1 + F.col("ret_pct") / 100).alias("_b"), F.count(F.lit(1)).alias("_bn"))
              .select(*ids, (F.pow("_b", 1 / F.col("_bn")) - 1).alias("_bench")))
    span = F.greatest(F.lit(0.5), F.datediff(
        F.make_date(F.col("end_year").cast("int"), F.lit(1), F.lit(1)),
        F.make_date(F.col("start_year").cast("int"), F.lit(1), F.lit(1))) / 365.25)
    cagr = F.pow("growth", 1 / F.col("_years")) - 1
    bench_cagr = F.coalesce("_bench", F.lit(0.0))
    lost = F.abs(F.col("_lost"))
    factor = (F.when(lost.isNull(), F.col("_won")).when(lost > 0, F.col("_won") / lost)
              .otherwise(F.lit(float("inf"))))
    sharpe = F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * F.sqrt(F.col("n_trades") / F.col("_years")))
    return (base.join(median, ids).join(market, ids, "left").withColumn("_years", span)
            .select(*ids, "start_year", "end_year", "n_trades", "n_qvm", "n_crash", "win_rate", "avg_return",
                    "median_return", "best_trade", "worst_trade", "avg_hold", (cagr * 100).alias("cagr"),
                    (bench_cagr * 100).alias("bench_cagr"), ((cagr - bench_cagr) * 100).alias("alpha"),
                    (F.col("max_drawdown") * 100).alias("max_drawdown"),
                    F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"), factor.alias("profit_factor")))
