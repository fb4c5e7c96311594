"""Price features of a daily panel ``(ticker, date, open, high, low, close, volume)``.

All features are window columns over one hash partitioning by ticker, so a
whole feature set costs a single shuffle. The panel has one row per ticker and
day (sources aggregate to that grain), which bounds each
window partition by the number of calendar days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Settings
from tidemark.functions.columns import ratio

KEY, TS = "ticker", "date"


def by_ticker() -> Window:
    return Window.partitionBy(KEY).orderBy(TS)


def trailing(rows: int) -> Window:
    return by_ticker().rowsBetween(-(rows - 1), 0)


def rolling(value: Column, rows: int, min_rows: int, fn, window: Window | None = None) -> Column:
    """``fn`` over the last ``rows`` rows, NULL until ``min_rows`` are known."""
    w = trailing(rows) if window is None else window.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(w) >= min_rows, fn(value).over(w))


def lagged(value: Column | str, n: int) -> Column:
    return F.lag(value, n).over(by_ticker())


def run_length(df: DataFrame, cond: Column, out: str) -> DataFrame:
    """Length of the run of TRUE that ends at each row of a ticker, else 0."""
    breaks = F.sum(F.when(cond, 0).otherwise(1)).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy(KEY, "_run").orderBy(TS).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_hit", cond).withColumn("_run", breaks)
    return d.withColumn(out, F.when(F.col("_hit"), F.count_if("_hit").over(inside)).otherwise(0)).drop("_hit", "_run")


def history_gate(bars: DataFrame, min_rows: int) -> DataFrame:
    """Drops rows without close, then tickers with too few closes."""
    known = bars.where(F.col("close").isNotNull())
    n = F.count("close").over(Window.partitionBy(KEY))
    return known.withColumn("_n", n).where(F.col("_n") >= min_rows).drop("_n")


def coverage_gate(bars: DataFrame, start: str, end: str, min_rows: int = 50, slack: int = 10) -> DataFrame:
    """Tickers with their coverage and whether the span is complete."""
    return (bars.groupBy(KEY).agg(F.min(TS).alias("first"), F.max(TS).alias("last"),
                                  F.count(F.lit(1)).alias("n"))
            .withColumn("covered", (F.col("n") > min_rows)
                        & (F.col("first") <= F.date_add(F.lit(start).cast("date"), slack))
                        & (F.col("last") >= F.date_sub(F.lit(end).cast("date"), slack))))


def _next_level(w: float, name: str):
    """Fold step over year summaries: decay the level by the year's length and
    add the year's own closing contribution."""
    def step(level: Column, past: Column) -> Column:
        return level * F.pow(F.lit(w), past["len"]) + past[name] * F.pow(F.lit(w), past["len"] - 1)
    return step


def with_ema(df: DataFrame, value: str, spans: dict[str, int], adjust: bool = False,
             key: list[str] | None = None, ts: str = TS) -> DataFrame:
    """Exponential moving averages without a UDF and without overflow.

    Inside one calendar year the recursion has the closed form
    ``w^n * sum(a * x * w^-n)``; across years the level at year end is carried
    by a fold over the year summaries. ``adjust=False`` seeds with the first
    value, ``adjust=True`` divides by the sum of the weights.
    """
    key = [KEY] if key is None else key
    ordered = Window.partitionBy(*key).orderBy(ts)
    in_year = Window.partitionBy(*key, "_year").orderBy(ts)
    year = Window.partitionBy(*key, "_year")
    earlier = Window.partitionBy(*key).orderBy("_year").rangeBetween(Window.unboundedPreceding, -1)
    base = (df.withColumn("_pos", F.row_number().over(ordered))
            .withColumn("_year", F.year(ts))
            .withColumn("_i", F.row_number().over(in_year) - 1)
            .withColumn("_len", F.count(F.lit(1)).over(year)))
    for name, span in spans.items():
        a = 2.0 / (span + 1)
        weight = F.lit(1.0) if adjust else F.when(F.col("_pos") == 1, 1.0).otherwise(F.lit(a))
        base = base.withColumn(f"_t_{name}", weight * F.col(value) * F.pow(F.lit(1 - a), -F.col("_i")))
    inner = [F.sum(f"_t_{n}").over(in_year.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_s_{n}")
             for n in spans]
    whole = [F.sum(f"_t_{n}").over(year).alias(f"_e_{n}") for n in spans]
    base = base.select(*base.columns, *inner, *whole)
    closing = F.when(F.col("_i") == F.col("_len") - 1,
                     F.struct(F.col("_len").alias("len"), *[F.col(f"_e_{n}").alias(n) for n in spans]))
    base = base.withColumn("_past", F.collect_list(closing).over(earlier))
    out = []
    for name, span in spans.items():
        w = 1 - 2.0 / (span + 1)

        carry = F.aggregate("_past", F.lit(0.0), _next_level(w, name))
        level = F.pow(F.lit(w), F.col("_i")) * F.col(f"_s_{name}") + F.pow(F.lit(w), F.col("_i") + 1) * carry
        if adjust:
            level = level * (1 - w) / (1 - F.pow(F.lit(w), F.col("_pos")))
        out.append(level.alias(name))
    return base.select(*df.columns, *out)


def with_rolling_moments(df: DataFrame, value: str, rows: int, min_rows: int, prefix: str) -> DataFrame:
    """Trailing max, mean and sample deviation in linear time.

    Spark re-aggregates a sliding frame for every row, 252 updates per row for
    a year. Here rows are cut into blocks of ``rows``: a trailing frame is the
    tail of one block plus the head of the next, and heads and tails are
    growing frames that Spark updates once per row. Means and variances of the
    two parts merge exactly, without the cancellation of prefix sums. Columns:
    ``<prefix>_max``, ``_mean``, ``_sd``, NULL until ``min_rows`` rows.
    """
    head = Window.partitionBy(KEY, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    tail = Window.partitionBy(KEY, "_block").orderBy(F.col("_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)

    def parts(w: Window) -> Column:
        v = F.col(value)
        return F.struct(F.count(v).over(w).alias("n"), F.max(v).over(w).alias("max"), F.min(v).over(w).alias("min"),
                        F.avg(v).over(w).alias("mean"), F.var_pop(v).over(w).alias("var"))

    d = (df.withColumn("_pos", F.row_number().over(by_ticker()) - 1)
         .withColumn("_block", F.floor(F.col("_pos") / rows)))
    d = d.withColumn("_head", parts(head)).withColumn("_tail", parts(tail))
    d = d.withColumn("_old", F.lag("_tail", rows - 1).over(by_ticker()))
    h, o = F.col("_head"), F.col("_old")
    # A full block is its own frame; the first block has nothing before it.
    split = o.isNotNull() & (h["n"] < rows)
    n = h["n"] + o["n"]
    gap = h["mean"] - o["mean"]
    mean = F.when(split, (h["n"] * h["mean"] + o["n"] * o["mean"]) / n).otherwise(h["mean"])
    squares = F.when(split, h["n"] * h["var"] + o["n"] * o["var"] + gap * gap * h["n"] * o["n"] / n) \
        .otherwise(h["n"] * h["var"])
    total = F.when(split, n).otherwise(h["n"])
    high = F.when(split, F.greatest(h["max"], o["max"])).otherwise(h["max"])
    low = F.when(split, F.least(h["min"], o["min"])).otherwise(h["min"])
    sd = F.when(total > 1, F.when(high == low, 0.0).otherwise(F.sqrt(squares / (total - 1))))
    ready = total >= min_rows
    return d.select(*df.columns, F.when(ready, high).alias(f"{prefix}_max"), F.when(ready, mean).alias(f"{prefix}_mean"),
                    F.when(ready, sd).alias(f"{prefix}_sd"))


def with_trend(bars: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Rolling high, z-score and momentum columns."""
    close = F.col("close")
    d = with_rolling_moments(bars, "close", cfg.year_rows, cfg.warmup_rows, "_y")
    return d.select(
        *bars.columns,
        F.col("_y_max").alias("high_52w"), F.col("_y_mean").alias("mean_52w"), F.col("_y_sd").alias("sd_52w"),
        ratio(close - F.col("_y_mean"), F.col("_y_sd")).alias("zscore"),
        (ratio(lagged(close, cfg.month_rows), lagged(close, cfg.year_rows)) - 1).alias("ret_12_1"),
        (ratio(close, lagged(close, cfg.half_year_rows)) - 1).alias("ret_6m"))


def price_features(bars: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The full feature set of every ticker with enough history."""
    gated = history_gate(bars, cfg.min_history).select(KEY, TS, "close")
    return with_trend(with_ema(gated, "close", {"ema_50": 50, "ema_200": 200}), cfg)


FEATURES = ["ema_50", "ema_200", "high_52w", "zscore", "ret_12_1", "ret_6m", "close"]


def benchmark_features(benchmark: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Trend distance and drawdown of one benchmark series ``(date, close)``.

    One row per calendar day, so the unpartitioned order is bounded by the
    calendar; ``series`` keeps the window keyed all the same.
    """
    b = benchmark.where(F.col("close").isNotNull()).select(F.lit("benchmark").alias("series"), TS, "close")
    e = with_ema(b, "close", {"ema_200": 200}, key=["series"])
    w = Window.partitionBy("series").orderBy(TS)
    high = rolling(F.col("close"), cfg.year_rows, cfg.warmup_rows, F.max, w)
    return (e.withColumn("high_rolling", high)
            .select(TS, "close", "ema_200", "high_rolling",
                    ratio(F.col("ema_200") - F.col("close"), "ema_200").alias("below_trend"),
                    ratio(F.col("high_rolling") - F.col("close"), "high_rolling").alias("drawdown")))


def with_atr(bars: DataFrame, period: int = 22, out: str = "atr") -> DataFrame:
    """Average true range; NULL until ``period + 1`` bars exist."""
    prev = lagged("close", 1)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    b = bars.withColumn("_tr", tr).withColumn("_bar", F.row_number().over(by_ticker()))
    mean = F.avg("_tr").over(trailing(period))
    return b.withColumn(out, F.when(F.col("_bar") > period, mean)).drop("_tr", "_bar")


def live_snapshot(bars: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """Latest row per ticker against its last year: distance to the high and to
    the bias-corrected EMA, half-year momentum counted from the 126th row back."""
    known = bars.where(F.col("close").isNotNull()).select(KEY, TS, "close")
    last = F.max(TS).over(Window.partitionBy(KEY))
    year = known.withColumn("_last", last).where(F.col(TS) > F.date_sub("_last", 365)).drop("_last")
    e = with_ema(year, "close", {"ema50": 50}, adjust=True)
    back = Window.partitionBy(KEY).orderBy(F.col(TS).desc())
    rows = (e.withColumn("_rn", F.row_number().over(back))
            .groupBy(KEY).agg(
                F.max(TS).alias(TS),
                F.max_by("close", TS).alias("price"),
                F.max("close").alias("high_52w"),
                F.max_by("ema50", TS).alias("ema50"),
                F.max(F.when(F.col("_rn") == 126, F.col("close"))).alias("_then")))
    price = F.col("price")
    out = rows.select(
        KEY, TS, price, "high_52w", "ema50",
        (ratio(price - F.col("high_52w"), "high_52w") * 100).alias("off_high"),
        (ratio(price - F.col("ema50"), "ema50") * 100).alias("vs_ema50"),
        ((ratio(price, "_then") - 1) * 100).alias("mom_6m"))
    return out if info is None else out.join(info, KEY, "left")


def sector_momentum(features: DataFrame, universe: DataFrame) -> DataFrame:
    """Momentum percentile of each ticker inside its sector, per date."""
    from tidemark.operators.ranks import pct_rank_avg
    placed = features.select(KEY, TS, "ret_12_1").join(universe.select(KEY, "sector"), KEY)
    return pct_rank_avg(placed.where(F.col("ret_12_1").isNotNull()), [TS, "sector"], "ret_12_1", "momentum_rank")
