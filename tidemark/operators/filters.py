"""The twelve filters as nullable boolean columns, their sub-checks in long
form, and the roll-ups. NULL means "not enough data"; gates need strict TRUE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Settings
from tidemark.functions.columns import all_true, ratio, strictly, votes
from tidemark.operators.asof import Stream, asof_backward

QUALITY = ["f1_rev_growth", "f2_gross_margin", "f3_roic", "f4_de_ratio", "f5_fcf", "f6_peg_ps", "f7_fcf_yield"]
TIMING = ["f8_fear_regime", "f9_price_disloc", "f10_momentum", "f11_ps_quartile", "f12_above_ema50"]
GROUPS = [f"F{i}" for i in range(1, 13)]


def with_quality_filters(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Adds the seven statement filters and ``quality_pass``."""
    c = F.col
    g1, g2 = c("g1"), c("g2")
    growing = strictly(g1 > cfg.min_growth) & (g2.isNull() | (g2 > cfg.min_growth))
    margin = (c("gm0") > cfg.min_margin) & (c("gm1").isNull() | (c("gm0") >= c("gm1") - cfg.margin_slack))
    by_sales = F.when(c("ps").isNotNull(),
                      (c("ps") < cfg.max_ps) & strictly(g1 > cfg.min_growth_unprofitable))
    out = df.select(
        *df.columns,
        F.when(c("growth_known"), growing).alias(QUALITY[0]),
        margin.alias(QUALITY[1]),
        (c("roic") > cfg.min_roic).alias(QUALITY[2]),
        (c("de_ratio") < cfg.max_leverage).alias(QUALITY[3]),
        F.when(c("fcf") > 0, True).otherwise(c("runway") >= cfg.min_runway_months).alias(QUALITY[4]),
        F.when(c("profitable") & c("peg").isNotNull(), c("peg") < cfg.max_peg).otherwise(by_sales).alias(QUALITY[5]),
        (c("fcf_yield") > cfg.min_fcf_yield).alias(QUALITY[6]))
    return out.withColumn("quality_pass", all_true([c(f) for f in QUALITY]))


def market_state(days: DataFrame, benchmark: DataFrame, vix: DataFrame, side: DataFrame | None = None,
                 today: str | None = None, cfg: Settings = DEFAULT) -> DataFrame:
    """Fear conditions per day. ``benchmark`` holds benchmark features, of
    which only complete rows count; ``side`` may hold (date, sentiment,
    regime). Sentiment votes only within three days of ``today``; an absent
    side input never blocks. One row per calendar day on every input."""
    one = F.lit("market")
    probe = days.select(one.alias("market"), "date")
    seen = asof_backward(probe, "market", "date", [
        Stream(vix.withColumn("market", one), "date", ["vix"]),
        Stream(benchmark.withColumn("market", one), "date",
               ["below_trend", "drawdown"], row=True, name="bench",
               complete=["close", "ema_200", "high_rolling", "below_trend", "drawdown"])])
    seen = seen.select("date", "vix", "bench.below_trend", "bench.drawdown")
    if side is not None:
        seen = seen.join(side.select("date", "sentiment", "regime"), "date", "left")
    else:
        seen = seen.select("*", F.lit(None).cast("double").alias("sentiment"),
                           F.lit(None).cast("string").alias("regime"))
    if today is not None:
        live = F.abs(F.datediff(F.col("date"), F.lit(today).cast("date"))) <= 3
        seen = seen.withColumn("sentiment", F.when(live, F.col("sentiment")))
    else:
        seen = seen.withColumn("sentiment", F.lit(None).cast("double"))
    c = F.col
    checks = [c("vix") > cfg.vix_fear, c("below_trend") > cfg.below_trend,
              c("drawdown") > cfg.market_drawdown, c("sentiment") < cfg.sentiment_fear]
    allowed = F.coalesce(F.upper(c("regime")), F.lit("GREEN")) != "RED"
    return seen.select(*seen.columns, votes(checks).alias("fear_count"),
                       ((votes(checks) >= cfg.fear_votes) & allowed).alias("f8_fear_regime"))


def dislocated(cfg: Settings = DEFAULT) -> Column:
    c = F.col
    low = c("zscore") < cfg.zscore_floor
    off = F.when(c("high_52w") > 0, (c("high_52w") - c("close_row")) / c("high_52w")) > cfg.off_high
    return strictly(low) | strictly(off)


def with_timing_filters(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Adds the entry filters. Expects the whole-row price columns
    (``close_row``, ``high_52w``, ``zscore``, ``ema_50``), ``momentum_rank``,
    ``ps``, ``ps_threshold`` and the market's ``f8_fear_regime``."""
    c = F.col
    out = df.select(
        *[x for x in df.columns if x != "f8_fear_regime"],
        strictly("f8_fear_regime").alias(TIMING[0]),
        dislocated(cfg).alias(TIMING[1]),
        F.coalesce(c("momentum_rank") > cfg.momentum_floor, F.lit(True)).alias(TIMING[2]),
        strictly(c("ps") <= c("ps_threshold")).alias(TIMING[3]),
        strictly(c("close_row") >= c("ema_50") * cfg.ema_tolerance).alias(TIMING[4]))
    return out.withColumn("entry_pass", all_true([c(f) for f in TIMING]))


def check_list(cfg: Settings = DEFAULT) -> list[tuple[str, str, Column, Column, float]]:
    """The 18 sub-checks: (id, group, passed, value, threshold)."""
    c = F.col
    off = F.when(c("high_52w") > 0, (c("high_52w") - c("close_row")) / c("high_52w"))
    gap = ratio(c("close_row") - c("ema_50"), "ema_50")
    runway = F.when(c("fcf") > 0, True).otherwise(c("runway") >= cfg.min_runway_months)
    rank = F.coalesce(c("momentum_rank") > cfg.momentum_floor, F.lit(True))
    stable = c("gm0") >= c("gm1") - cfg.margin_slack
    near = c("close_row") >= c("ema_50") * cfg.ema_tolerance
    rows = [
        ("F1a", "F1", c("g1") > cfg.min_growth, c("g1"), cfg.min_growth),
        ("F1b", "F1", c("g2") > cfg.min_growth, c("g2"), cfg.min_growth),
        ("F2a", "F2", c("gm0") > cfg.min_margin, c("gm0"), cfg.min_margin),
        ("F2b", "F2", stable, c("gm0") - c("gm1"), -cfg.margin_slack),
        ("F3", "F3", c("f3_roic"), c("roic"), cfg.min_roic),
        ("F4", "F4", c("f4_de_ratio"), c("de_ratio"), cfg.max_leverage),
        ("F5", "F5", runway, c("fcf"), 0.0),
        ("F6", "F6", c("f6_peg_ps"), F.coalesce(c("peg"), c("ps")), cfg.max_peg),
        ("F7", "F7", c("f7_fcf_yield"), c("fcf_yield"), cfg.min_fcf_yield),
        ("F8a", "F8", c("vix") > cfg.vix_fear, c("vix"), cfg.vix_fear),
        ("F8b", "F8", c("below_trend") > cfg.below_trend, c("below_trend"), cfg.below_trend),
        ("F8c", "F8", c("drawdown") > cfg.market_drawdown, c("drawdown"), cfg.market_drawdown),
        ("F8d", "F8", c("sentiment") < cfg.sentiment_fear, c("sentiment"), cfg.sentiment_fear),
        ("F9a", "F9", c("zscore") < cfg.zscore_floor, c("zscore"), cfg.zscore_floor),
        ("F9b", "F9", off > cfg.off_high, off, cfg.off_high),
        ("F10", "F10", rank, c("momentum_rank"), cfg.momentum_floor),
        ("F11", "F11", c("ps") <= c("ps_threshold"), c("ps"), cfg.ps_quantile),
        ("F12", "F12", near, gap, cfg.ema_tolerance - 1),
    ]
    return rows


def sub_checks(df: DataFrame, keys: list[str], cfg: Settings = DEFAULT) -> DataFrame:
    """Long form: one row per key and sub-check."""
    items = F.array(*[
        F.struct(F.lit(i).alias("check_id"), F.lit(g).alias("grp"), p.alias("passed"),
                 v.cast("double").alias("value"), F.lit(float(t)).alias("threshold"))
        for i, g, p, v, t in check_list(cfg)])
    return df.select(*keys, F.explode(items).alias("c")).select(*keys, "c.*")


def group_verdict(group: Column, yes: Column, no: Column, unknown: Column) -> Column:
    """Group result from the counts of TRUE, FALSE and NULL sub-checks."""
    null = F.lit(None).cast("boolean")
    total = yes + no + unknown
    two = F.when(yes >= 2, True).when(unknown == total, null).otherwise(False)
    anyone = F.when(yes >= 1, True).when(unknown == total, null).otherwise(False)
    lenient = F.when(no >= 1, False).when(yes >= 1, True).otherwise(null)
    strict = F.when(yes == total, True).when(no >= 1, False).otherwise(null)
    return (F.when(group == "F8", two).when(group == "F9", anyone)
            .when(group.isin("F1", "F2"), lenient).otherwise(strict))


def rollup_checks(long: DataFrame, keys: list[str]) -> DataFrame:
    """Sub-checks to groups. The counts combine before the shuffle."""
    p = F.col("passed")
    counts = long.groupBy(*keys, "grp").agg(
        F.count_if(p).alias("yes"), F.count_if(~p).alias("no"), F.count_if(p.isNull()).alias("unknown"))
    return counts.withColumn("group_pass", group_verdict(F.col("grp"), F.col("yes"), F.col("no"), F.col("unknown")))


def with_group_flags(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The same roll-up inside the row, as columns F1..F12 (no shuffle)."""
    checks = check_list(cfg)
    flags = []
    for g in GROUPS:
        members = [p for _, grp, p, _, _ in checks if grp == g]
        yes = votes(members)
        no = votes([~m for m in members])
        flags.append(group_verdict(F.lit(g), yes, no, F.lit(len(members)) - yes - no).alias(g))
    return df.select(*df.columns, votes([p for _, _, p, _, _ in checks]).alias("checks_passed"), *flags)


def conviction(n_pass: Column) -> Column:
    return (F.when(n_pass == 12, "HIGH CONVICTION").when(n_pass >= 9, "MEDIUM").otherwise("DO NOT ENTER"))


def next_action(n_pass: Column, failing: Column) -> Column:
    """Label from the number of passing groups and the failing ones."""
    def only(g: str) -> Column:
        return failing == F.array(F.lit(g))
    return (F.when(n_pass == 12, "SIGNAL ACTIVE")
            .when((n_pass == 11) & only("F8"), "WATCHLIST PRIORITY")
            .when((n_pass == 11) & only("F12"), "STABILIZATION WATCH")
            .when(n_pass >= 9, "WATCH LIST").otherwise("NO ACTION"))


def with_verdict(df: DataFrame) -> DataFrame:
    """``groups_passed``, ``failing``, conviction and action from F1..F12."""
    n = votes([F.col(g) for g in GROUPS])
    failing = F.array_compact(F.array(*[F.when(~F.col(g), F.lit(g)) for g in GROUPS]))
    out = df.select(*df.columns, n.alias("groups_passed"), failing.alias("failing"))
    return out.select(*out.columns, conviction(F.col("groups_passed")).alias("conviction"),
                      next_action(F.col("groups_passed"), F.col("failing")).alias("action"))


def trigger_levels(cfg: Settings = DEFAULT) -> list[Column]:
    """Levels that would turn a failing F8, F9 or F12; NULL while passing."""
    c = F.col
    fails8, fails9, fails12 = ~c("F8"), ~c("F9"), ~c("F12")
    return [
        F.when(fails8 & c("vix").isNotNull(), F.lit(cfg.vix_fear)).alias("trigger_vix"),
        F.when(fails8, F.lit(cfg.sentiment_fear)).alias("trigger_sentiment"),
        F.when(fails9, c("high_52w") * (1 - cfg.off_high)).alias("trigger_high"),
        F.when(fails9 & (c("sd_52w") > 0), c("mean_52w") + cfg.zscore_floor * c("sd_52w")).alias("trigger_zscore"),
        F.when(fails12, c("ema_50") * cfg.ema_tolerance).alias("trigger_ema"),
    ]


def signal_conviction(vix: Column, off_high: Column) -> Column:
    v, o = F.coalesce(vix, F.lit(0.0)), F.coalesce(off_high, F.lit(0.0))
    # Levels of fear and distance from the high.
    return (F.when((v >= 35) & (o >= 0.30), "EXTREME")
            .when((v >= 25) & (o >= 0.20), "HIGH").otherwise("MODERATE"))


def fear_history(market: DataFrame) -> DataFrame:
    return market.where(F.col("fear_count") >= 1).select("date", "fear_count", "vix")


def fear_status(count: Column) -> Column:
    return F.when(count >= 2, "ACTIVE").when(count == 1, "CAUTION").otherwise("CALM")


def sentiment_band(score: Column) -> Column:
    """Band edges 25, 35, 55, 75."""
    return (F.when(score < 25, "EXTREME FEAR").when(score < 35, "FEAR").when(score < 55, "NEUTRAL")
            .when(score < 75, "GREED").when(score.isNotNull(), "EXTREME GREED"))


def score_label(score: Column) -> Column:
    return (F.when(score.isNull(), "Scan needed").when(score >= 12, "Signal")
            .when(score >= 11, "Near Signal").when(score >= 9, "Watch").otherwise("Wait"))


def quick_screen(snapshot: DataFrame, fear_count: Column) -> DataFrame:
    """Price-only screen; its distance to the EMA is two-sided, unlike F12."""
    f8, f9 = fear_count >= 2, F.col("off_high") < -20
    f12 = F.abs(F.col("vs_ema50")) < 10
    n = votes([f8, f9, f12])
    return snapshot.select(
        *snapshot.columns, strictly(f8).alias("quick_f8"), strictly(f9).alias("quick_f9"),
        strictly(f12).alias("quick_f12"), n.alias("quick_pass"),
        F.when(n == 3, "CRASH-TIER CANDIDATE").when(n >= 1, "WATCHLIST").otherwise("NO ACTION").alias("advice"))
