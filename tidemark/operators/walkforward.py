"""Walk-forward evaluation: yearly, rolling train/test and half-against-half
periods are all rows of one period table, evaluated in a single job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Settings
from tidemark.operators.trades import period_metrics, win


def active_years(trades: DataFrame, minimum: int = 3) -> DataFrame:
    return (trades.groupBy(F.year("entry_date").cast("bigint").alias("year"))
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum))


def period_table(years: DataFrame, train: int = 2, test: int = 1) -> DataFrame:
    """``(period, kind, fold, start_year, end_year)`` from the active years:
    one summary row (a few dozen years at most) is expanded by ``explode``."""
    s = years.agg(F.array_sort(F.collect_list("year")).alias("ys"))
    ys = F.col("ys")
    first, last, n = F.array_min(ys), F.array_max(ys), F.size(ys)
    mid = F.floor(n / 2).cast("int")

    def row(kind: str, fold, start, end):
        return F.struct(F.lit(kind).alias("kind"), fold.cast("bigint").alias("fold"),
                        start.cast("bigint").alias("start_year"), end.cast("bigint").alias("end_year"))

    yearly = F.transform(ys, lambda y, i: row("year", i + 1, y, y + 1))
    starts = F.filter(F.sequence(first, last), lambda y: y + train + test <= last + 1)
    trained = F.transform(starts, lambda y, i: row("train", i + 1, y, y + train))
    tested = F.transform(starts, lambda y, i: row("test", i + 1, y + train, y + train + test))
    halves = F.when(n >= 4, F.array(
        row("half", F.lit(1), first, F.get(ys, mid - 1) + 1),
        row("half", F.lit(2), F.get(ys, mid), last + 1)))
    rows = s.select(F.explode(F.concat(yearly, trained, tested, F.coalesce(halves, F.array()))).alias("p")).select("p.*")
    return rows.select(F.concat_ws("-", "kind", "start_year", F.col("end_year") - 1).alias("period"), "*")


def completed(trades: DataFrame) -> DataFrame:
    return trades.where(F.col("exit_reason") != "backtest_end")


def walk_forward(trades: DataFrame, bench: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    t = completed(trades)
    return period_metrics(t, period_table(active_years(t)), bench, cfg)


def folds(results: DataFrame) -> DataFrame:
    """Train against test per fold, with the differences."""
    keep = ["n_trades", "win_rate", "avg_return", "sharpe", "max_drawdown", "profit_factor"]
    side = {k: results.where(F.col("kind") == k).select("fold", *[F.col(c).alias(f"{k}_{c}") for c in keep])
            for k in ("train", "test")}
    j = side["train"].join(side["test"], "fold")
    return j.select("*", *[(F.col(f"test_{c}") - F.col(f"train_{c}")).alias(f"diff_{c}")
                           for c in ("win_rate", "avg_return", "sharpe")])


def consistency(results: DataFrame) -> DataFrame:
    y = results.where(F.col("kind") == "year")
    return y.agg(
        F.count(F.lit(1)).alias("years"),
        F.stddev_pop("cagr").alias("cagr_sd"), F.min("cagr").alias("cagr_min"), F.max("cagr").alias("cagr_max"),
        F.stddev_pop("win_rate").alias("win_sd"), F.min("win_rate").alias("win_min"),
        F.max("win_rate").alias("win_max"), F.min("sharpe").alias("sharpe_min"),
        F.max("sharpe").alias("sharpe_max"), F.avg("sharpe").alias("sharpe_mean"),
        F.count_if(F.col("cagr") > 0).alias("positive_years"), F.count_if(F.col("alpha") > 0).alias("positive_alpha"))


def assessment(summary: DataFrame) -> DataFrame:
    """Shares 0.6 and 0.4, deviations 20 and 15, Sharpe 0.3."""
    def label(ok, good="Good", bad="Concern"):
        return F.when(ok, good).otherwise(bad)
    n = F.col("years")
    return summary.select(
        "years", label(F.col("positive_years") > n * 0.6).alias("return_label"),
        label(F.col("positive_alpha") > n * 0.4).alias("alpha_label"),
        label(F.col("cagr_sd") < 20, bad="High variance").alias("cagr_label"),
        label(F.col("win_sd") < 15, bad="High variance").alias("win_label"),
        label(F.col("sharpe_mean") > 0.3, bad="Weak").alias("sharpe_label"))


def stability(results: DataFrame) -> DataFrame:
    """Degradation points of the second half against the first, and a verdict."""
    cols = ["win_rate", "sharpe", "avg_return", "profit_factor"]
    h = results.where(F.col("kind") == "half").groupBy("kind").agg(
        *[F.max(F.when(F.col("fold") == i, F.col(c))).alias(f"{c}_{i}") for i in (1, 2) for c in cols])

    def drop(c: str, small: float, large: float):
        d = F.col(f"{c}_2") - F.col(f"{c}_1")
        return F.when(d < -large, 2).when(d < -small, 1).otherwise(0)

    # Drops that count, and their points.
    p1, p2 = F.col("profit_factor_1"), F.col("profit_factor_2")
    factor = F.when((p2 < 1) & (p1 > 1), 3).when(p2 < p1 * 0.5, 2).otherwise(0)
    points = (drop("win_rate", 5, 10) + drop("sharpe", 0.2, 0.5) + drop("avg_return", 2, 5) + factor).cast("bigint")
    return h.select(*[f"{c}_{i}" for i in (1, 2) for c in cols], points.alias("points"),
                    F.when(points >= 4, "HIGH").when(points >= 2, "MODERATE").otherwise("LOW").alias("verdict"))


def tier_years(trades: DataFrame, minimum: int = 5) -> DataFrame:
    """Per tier and active year: trades, win rate, mean return, and the tier's
    mean and deviation of win rates over its years."""
    t = completed(trades)
    big = t.groupBy("tier").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum).select("tier")
    r = F.col("return_pct")
    y = (t.withColumn("year", F.year("entry_date").cast("bigint"))
         .groupBy("tier", "year").agg(F.count(F.lit(1)).alias("n"), (win(r) * 100).alias("win_rate"),
                                      F.avg(r).alias("avg_return")))
    y = y.join(big, "tier", "left_semi").join(active_years(t).select("year"), "year", "left_semi")
    w = Window.partitionBy("tier")
    return y.select("tier", "year", "n", "win_rate", "avg_return", F.avg("win_rate").over(w).alias("tier_win_mean"),
                    F.stddev_pop("win_rate").over(w).alias("tier_win_sd"))
