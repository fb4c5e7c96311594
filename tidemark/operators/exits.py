"""Exit rules for tables of entries, as first-breach searches.

Stops depend on (ticker, entry day) only, so they are computed on distinct
pairs: entries and bars are then both bounded by the calendar for any ticker,
and the windows reuse the join's partitioning by ticker.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Settings
from tidemark.functions.columns import growth
from tidemark.operators.asof import Stream, asof_backward, asof_forward, bars_since_entry
from tidemark.operators.breach import stop_days
from tidemark.operators.prices import with_atr


def thesis_break(cfg: Settings = DEFAULT) -> Column:
    """Reason text for broken fundamentals, NULL while intact."""
    falling, gm, de = F.col("falling"), F.col("gm0"), F.col("de_ratio")
    return (F.when(falling >= cfg.exit_negative_periods,
                   F.concat(F.lit("neg_revenue_"), falling.cast("string"), F.lit("q")))
            .when(gm < cfg.exit_margin, F.lit(f"gm_below_{cfg.exit_margin:.0%}"))
            .when(de > cfg.exit_leverage, F.concat(F.lit("de_ratio_"), F.format_string("%.1f", de))))


def since_entry(entries: DataFrame, bars: DataFrame) -> DataFrame:
    """All bars from each distinct (ticker, entry_date) on, with the running peak
    close. Rules that need the first breach alone use ``stop_exits``."""
    pairs = entries.select("ticker", "entry_date").distinct()
    rows = bars_since_entry(pairs, bars.where(F.col("close").isNotNull()), "ticker", "entry_date", F.col("date"), ["close", "atr"])
    w = (Window.partitionBy("ticker", "entry_date").orderBy("date")
         .rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("peak", F.max("close").over(w))


def stop_exits(entries: DataFrame, bars: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """First day each stop is hit: fixed trailing and volatility based, up to
    ``until`` where entries have that column and it is not NULL."""
    pairs = entries.select("ticker", "entry_date", *[c for c in entries.columns if c == "until"]).distinct()
    return stop_days(pairs, with_atr(bars, cfg.atr_period), cfg)


def first_bar_after(probe: DataFrame, bars: DataFrame, ts: str, out: str) -> DataFrame:
    days = bars.where(F.col("close").isNotNull()).select("ticker", "date", F.col("date").alias(out))
    return asof_forward(probe, days, "ticker", ts, out, strict=False)


def hold_due(pairs: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Maximum holding period reached."""
    return pairs.select("ticker", "entry_date", F.lit("hold").alias("kind"),
                        F.date_add("entry_date", cfg.max_hold_days).alias("due"), F.lit("max_hold_3yr").alias("why"))


def thesis_due(pairs: DataFrame, states: DataFrame) -> DataFrame:
    """Day from which the thesis is broken.

    ``states`` (ticker, published, reason) holds the verdict in force from each
    publication day. A break already in force at entry is due the next day,
    later ones on publication.
    """
    flagged = states.withColumn("verdict", F.coalesce("reason", F.lit("")))
    now = asof_backward(pairs.select("ticker", "entry_date"), "ticker", "entry_date",
                        [Stream(flagged, "published", ["verdict"])])
    broken = (states.where(F.col("reason").isNotNull())
              .withColumn("next_break", F.struct("published", "reason")))
    nxt = asof_forward(now, broken, "ticker", "entry_date", "next_break", series_ts="published")
    at_entry = F.coalesce(F.col("verdict"), F.lit("")) != ""
    due = F.when(at_entry, F.date_add("entry_date", 1)).otherwise(F.col("next_break.published"))
    why = F.when(at_entry, F.col("verdict")).otherwise(F.col("next_break.reason"))
    return nxt.select("ticker", "entry_date", F.lit("thesis").alias("kind"), due.alias("due"), why.alias("why")).where(
        F.col("due").isNotNull())


def rebalance_due(pairs: DataFrame, rebalances: DataFrame, targets: DataFrame) -> DataFrame:
    """First rebalance after entry whose target list lacks the ticker.

    Rebalance dates are one per quarter: the list, and the dates on which a
    ticker was a target, travel as arrays, so pairs are not multiplied.
    """
    dates = rebalances.agg(F.array_sort(F.collect_list("effective"))).scalar()
    kept = targets.groupBy("ticker").agg(F.collect_set("effective").alias("_kept"))
    held = pairs.select("ticker", "entry_date").join(kept, "ticker", "left").withColumn("_dates", dates)
    gone = F.filter("_dates", lambda d: (d > F.col("entry_date")) & ~F.coalesce(
        F.array_contains("_kept", d), F.lit(False)))
    return held.select("ticker", "entry_date", F.lit("rebalance").alias("kind"), F.get(gone, 0).alias("due"),
                       F.lit("qvm_rebalance").alias("why")).where(F.col("due").isNotNull())


def due_exits(dues: list[DataFrame], bars: DataFrame) -> DataFrame:
    """First bar at or after each due day, all kinds in one as-of pass; one row
    per (ticker, entry_date) with ``<kind>_date`` and ``<kind>_why``."""
    stacked = reduce(DataFrame.unionByName, dues)
    hit = first_bar_after(stacked, bars, "due", "on_bar")
    kinds = ("hold", "thesis", "rebalance")
    return hit.groupBy("ticker", "entry_date").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("on_bar"))).alias(f"{k}_date") for k in kinds],
        *[F.max(F.when(F.col("kind") == k, F.col("why"))).alias(f"{k}_why") for k in kinds])


def hold_exits(entries: DataFrame, bars: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """First bar at or after the maximum holding period."""
    pairs = entries.select("ticker", "entry_date").distinct()
    return due_exits([hold_due(pairs, cfg)], bars).select("ticker", "entry_date", "hold_date")


def resolve_exits(entries: DataFrame, bars: DataFrame, states: DataFrame | None = None,
                  rebalances: DataFrame | None = None, targets: DataFrame | None = None,
                  cfg: Settings = DEFAULT, method: str = "atr") -> DataFrame:
    """Earliest exit per entry (ticker, tier, entry_date, entry_price).

    Stops and rebalancing act on tier ``qvm``, maximum hold and broken theses
    on tier ``crash``; what is still open closes on the ticker's last bar.
    Precedence on the same day: stop, rebalance, hold, thesis, end of data.
    ``entries`` feeds several branches: pass a staged table.
    """
    keys = ["ticker", "entry_date"]
    pairs = entries.select(*keys).distinct()
    dues = [hold_due(pairs, cfg)]
    if states is not None:
        dues.append(thesis_due(pairs, states))
    if targets is not None:
        dues.append(rebalance_due(pairs, rebalances, targets))
    end = bars.where(F.col("close").isNotNull()).groupBy("ticker").agg(F.max("date").alias("_end"))
    due = due_exits(dues, bars)
    # A position that leaves at a rebalance needs no bar after it.
    held = (entries.where("tier = 'qvm'").select(*keys).distinct().join(due, keys, "left")
            .select(*keys, F.col("rebalance_date").alias("until")))
    out = (entries.join(stop_exits(held, bars, cfg), keys, "left").join(due, keys, "left")
           .join(end, "ticker"))
    stop, stop_name = ("atr_date", "atr_trailing_stop") if method == "atr" else ("trailing_date", "trailing_stop")
    qvm, crash = F.col("tier") == "qvm", F.col("tier") == "crash"
    rules = [(qvm, stop, F.lit(stop_name)), (qvm, "rebalance_date", F.col("rebalance_why")),
             (crash, "hold_date", F.col("hold_why")), (crash, "thesis_date", F.col("thesis_why")),
             (F.lit(True), "_end", F.lit("backtest_end"))]
    options = [F.when(when & F.col(d).isNotNull(), F.struct(F.col(d).alias("d"), F.lit(rank).alias("p"), why.alias("r")))
               for rank, (when, d, why) in enumerate(rules)]
    first = F.array_min(F.array_compact(F.array(*options)))
    closed = out.withColumn("_x", first).select(
        *entries.columns, F.col("_x.d").alias("exit_date"), F.col("_x.r").alias("exit_reason"))
    last = bars.select("ticker", F.col("date").alias("exit_date"), F.col("close").alias("exit_price"))
    return closed.join(last, ["ticker", "exit_date"], "left")


def trade_table(exits: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Return, dollars and days held of resolved entries."""
    r = growth("exit_price", "entry_price")
    return exits.select(
        "ticker", "tier", "entry_date", "entry_price", "exit_date", "exit_price",
        r.alias("return_dec"), (r * 100).alias("return_pct"), (r * capital).alias("pnl_dollars"),
        F.datediff("exit_date", "entry_date").cast("bigint").alias("hold_days"), "exit_reason")


def static_stop(entry: Column, pct: Column) -> Column:
    return entry * (1 - pct / 100)
