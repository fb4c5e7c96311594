"""User-level pipelines over the panel frames, for all tickers and dates at
once. Nothing is collected on the way; what several branches share (features,
statement periods, momentum ranks) is staged as a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Settings
from tidemark.functions.columns import growth
from tidemark.operators import exits, filters, metrics, prices, ranking, statements
from tidemark.operators.asof import Stream, asof_backward, asof_forward
from tidemark.sources.sinks import stage, store


@dataclass
class Inputs:
    """Frames a screen needs. ``side`` may hold (date, sentiment, regime)."""
    bars: DataFrame
    fundamentals: DataFrame
    universe: DataFrame
    company: DataFrame
    benchmark: DataFrame
    vix: DataFrame
    side: DataFrame | None = None
    today: str | None = None
    cfg: Settings = DEFAULT
    stage: Callable[[DataFrame, str], DataFrame] = stage

    def by_ticker(self, df: DataFrame, name: str, order: str = "date", placed: bool = False) -> DataFrame:
        """Stages a table that plans read by ticker, in buckets of it."""
        return store(df, name, "ticker", order, placed) if self.stage is stage else self.stage(df, name)

    @cached_property
    def features(self) -> DataFrame:
        return self.by_ticker(prices.price_features(self.bars, self.cfg), "features", placed=True)

    @cached_property
    def periods(self) -> DataFrame:
        return self.by_ticker(statements.period_table(self.fundamentals), "periods", "period_end")

    @cached_property
    def states(self) -> Stream:
        frame = self.by_ticker(statements.statement_states(self.periods, self.cfg), "states", "published")
        return Stream(frame, "published", statements.STATE_COLS)

    @cached_property
    def ps_points(self) -> DataFrame:
        return self.stage(statements.ps_points(self.periods, self.features, self.company, self.cfg), "ps-points")

    @cached_property
    def ps_histories(self) -> DataFrame:
        return self.by_ticker(statements.ps_histories(self.ps_points, self.cfg), "ps-histories", "published")

    @cached_property
    def days(self) -> DataFrame:
        return self.benchmark.where(F.col("close").isNotNull()).select("date").distinct()

    @cached_property
    def market(self) -> DataFrame:
        bench = prices.benchmark_features(self.benchmark, self.cfg)
        return self.stage(filters.market_state(self.days, bench, self.vix, self.side, self.today, self.cfg), "market")

    @cached_property
    def momentum(self) -> DataFrame:
        return self.by_ticker(prices.sector_momentum(self.features, self.universe), "momentum")

    def variant(self, **changes) -> "Inputs":
        return replace(self, cfg=replace(self.cfg, **changes))


def trading_days(days: DataFrame, start: str, end: str) -> DataFrame:
    return days.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def quarter_grid(days: DataFrame) -> DataFrame:
    """Quarter ends with evaluation and effective trading days.

    Evaluation is the last trading day up to the quarter end (the first day if
    there is none), effective the first one after it (the last day if none).
    Quarters that share an effective day keep the latest. The calendar is one
    row per day, so its single window partition is small by nature.
    """
    one = F.lit("calendar")
    d = days.select(one.alias("cal"), "date")
    span = d.groupBy("cal").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    quarters = (span.withColumn("q", F.explode(F.sequence(
                    F.date_trunc("quarter", F.add_months("first", -4)).cast("date"), F.col("last"),
                    F.expr("interval 3 months"))))
                .withColumn("quarter_end", F.last_day(F.add_months("q", 2)))
                .where((F.col("quarter_end") <= F.col("last")) & (F.col("quarter_end") >= F.add_months("first", -4)))
                .select("cal", "quarter_end", "first", "last"))
    back = asof_backward(quarters, "cal", "quarter_end", [Stream(d.withColumn("on", F.col("date")), "date", ["on"])])
    both = asof_forward(back, d.withColumn("nxt", F.col("date")), "cal", "quarter_end", "nxt")
    grid = both.select("quarter_end", F.coalesce("on", "first").alias("eval_date"),
                       F.coalesce("nxt", "last").alias("effective"))
    return grid.groupBy("effective").agg(F.max("quarter_end").alias("quarter_end"),
                                         F.max_by("eval_date", "quarter_end").alias("eval_date"))


def eligible(inp: Inputs) -> DataFrame:
    """Tickers with price features and fundamentals."""
    priced = inp.features.select("ticker").distinct()
    return inp.fundamentals.select("ticker").distinct().join(priced, "ticker", "left_semi")


def ticker_dates(tickers: DataFrame, dates: DataFrame, date: str) -> DataFrame:
    """Every ticker on every listed date. The list (quarter dates, one row per
    quarter) travels as one array value and is exploded in place."""
    listed = dates.agg(F.collect_list(F.struct(*dates.columns))).scalar()
    return tickers.withColumn("_d", F.explode(listed)).select(*tickers.columns, "_d.*")


def fundamentals_asof(grid: DataFrame, inp: Inputs, as_of: str = "as_of") -> DataFrame:
    """Metrics, market data and quality filters for each (ticker, as_of).

    Statement states, closes and half-year returns arrive by one as-of pass
    over the stacked streams, hence one shuffle by ticker.
    """
    f = inp.features
    seen = asof_backward(grid, "ticker", as_of, [
        inp.states, Stream(f, "date", ["close", "ret_6m"]), statements.ps_stream(inp.ps_histories)])
    seen = statements.with_ps_hist(seen, as_of, inp.cfg)
    seen = seen.join(statements.shares_used(inp.company), "ticker", "left")
    out = metrics.with_ps_stats(metrics.with_metrics(seen, inp.cfg), inp.cfg)
    return filters.with_quality_filters(out, inp.cfg)


def quarterly_panel(inp: Inputs) -> DataFrame:
    """All eligible tickers at every quarter's evaluation date."""
    grid = ticker_dates(eligible(inp), quarter_grid(inp.days), "eval_date").withColumnRenamed("eval_date", "as_of")
    return fundamentals_asof(grid, inp)


def watchlists(panel: DataFrame) -> DataFrame:
    return panel.where("quality_pass")


def watchlist_sizes(panel: DataFrame) -> DataFrame:
    return panel.groupBy("effective").agg(F.count(F.lit(1)).alias("evaluated"),
                                          F.count_if("quality_pass").alias("watchlist"))


def ranked_watchlist(inp: Inputs, panel: DataFrame, n: int | None = None) -> DataFrame:
    """Composite scores of the watchlist per quarter, best ``n`` first."""
    scores = ranking.qvm_scores(watchlists(panel), "effective", inp.cfg)
    order = [F.col("score").desc(), F.col("ticker")]
    return ranking.top_n(scores, ["effective"], order, n or inp.cfg.top_n)


def targets_capped(inp: Inputs, panel: DataFrame) -> DataFrame:
    """Target list per quarter under the sector cap."""
    scores = ranking.qvm_scores(watchlists(panel), "effective", inp.cfg)
    placed = scores.join(inp.universe.select("ticker", "sector"), "ticker", "left").withColumn(
        "sector", F.coalesce("sector", F.lit("Unknown")))
    return ranking.top_n_capped(placed, ["effective"], "sector", [F.col("score").desc(), F.col("ticker")],
                                inp.cfg.top_n, inp.cfg.sector_cap)


def in_force(quarters: DataFrame) -> DataFrame:
    """``(effective, until)``: each list rules until the next one."""
    w = Window.orderBy("effective")  # one row per quarter
    return quarters.select("effective", F.lead("effective").over(w).alias("until"))


def daily_timing(inp: Inputs, probe: DataFrame, as_of: str = "date", until: Column | None = None) -> DataFrame:
    """Entry filters for each (ticker, day) of ``probe``. Where the caller knows
    the last probed day, ``until`` lets the scans skip everything later.

    Whole-row price features, per-column close, sector momentum, statement
    states and P/S history are as-of looked up in one stacked pass; the market
    state joins by date (one row per calendar day).
    """
    def known(df: DataFrame, ts: str) -> DataFrame:
        return df if until is None else df.where(F.col(ts) <= until)

    f = known(inp.features, "date").withColumn("close_row", F.col("close"))
    row_cols = ["close_row", "high_52w", "zscore", "ema_50", "ret_12_1", "mean_52w", "sd_52w"]
    seen = asof_backward(probe, "ticker", as_of, [
        Stream(f, "date", row_cols, row=True, name="px", complete=prices.FEATURES),
        Stream(f, "date", ["close", "ret_6m"]),
        Stream(known(inp.momentum, "date"), "date", ["momentum_rank"]),
        replace(inp.states, frame=known(inp.states.frame, "published")),
        statements.ps_stream(known(inp.ps_histories, "published"))])
    return finish_timing(inp, seen.select("*", "px.*").drop("px"), as_of)


def finish_timing(inp: Inputs, seen: DataFrame, as_of: str) -> DataFrame:
    """Metrics and entry filters of rows that carry everything of their ticker."""
    seen = statements.with_ps_hist(seen, as_of, inp.cfg)
    seen = seen.join(statements.shares_used(inp.company), "ticker", "left")
    full = metrics.with_ps_stats(metrics.with_metrics(seen, inp.cfg), inp.cfg)
    state = inp.market.withColumnRenamed("date", as_of)
    return filters.with_timing_filters(full.join(state, as_of, "left"), inp.cfg)


def entry_signals(inp: Inputs, lists: DataFrame, quarters: DataFrame) -> DataFrame:
    """Every day x name of the watchlist in force that passes F8-F12.

    Which list rules on a day is a calendar question, so days are labelled
    first (one row per day) and members are then an equi-join on (ticker,
    effective) instead of an interval join.
    """
    cal = F.lit("calendar")
    ruling = asof_backward(inp.days.select(cal.alias("cal"), "date"), "cal", "date", [
        Stream(quarters.select(cal.alias("cal"), F.col("effective").alias("at"), "effective"), "at", ["effective"])])
    days = inp.bars.where(F.col("close").isNotNull()).select("ticker", "date").join(
        ruling.select("date", "effective"), "date")
    probe = days.join(lists.select("ticker", "effective"), ["ticker", "effective"], "left_semi").select(
        "ticker", "date", "effective")
    return daily_timing(inp, probe).where("entry_pass")


def funnel(panel: DataFrame, signals: DataFrame) -> DataFrame:
    """Evaluated, watchlist size and entries per quarter, plus the total row."""
    entries = signals.groupBy("effective").agg(F.count(F.lit(1)).alias("entries"))
    rows = watchlist_sizes(panel).join(entries, "effective", "left")
    return rows.rollup("effective").agg(
        F.sum("evaluated").alias("evaluated"), F.sum("watchlist").alias("watchlist"),
        F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"))


def all_filters(inp: Inputs, probe: DataFrame, as_of: str = "date", until: Column | None = None) -> DataFrame:
    """The twelve filters for each (ticker, day) of ``probe``."""
    return with_all_filters(inp, daily_timing(inp, probe, as_of, until))


def with_all_filters(inp: Inputs, timed: DataFrame) -> DataFrame:
    both = filters.with_quality_filters(timed, inp.cfg)
    return both.withColumn("all_pass", F.col("quality_pass") & F.col("entry_pass"))


def latest_days(inp: Inputs) -> DataFrame:
    """The last day of each eligible ticker."""
    last = inp.bars.where(F.col("close").isNotNull()).groupBy("ticker").agg(F.max("date").alias("date"))
    return last.join(eligible(inp), "ticker", "left_semi")


def on_date(inp: Inputs, date: Column) -> DataFrame:
    return eligible(inp).withColumn("date", date)


def signal_records(scan: DataFrame) -> DataFrame:
    """Scan rows to signal records with conviction and the filter map."""
    names = filters.QUALITY + filters.TIMING
    off = F.when(F.col("high_52w") > 0, (F.col("high_52w") - F.col("close_row")) / F.col("high_52w"))
    n = sum((F.coalesce(F.col(f), F.lit(False)).cast("bigint") for f in names), F.lit(0).cast("bigint"))
    return scan.select(
        "ticker", F.col("date").alias("scan_date"), F.col("close_row").alias("price"),
        off.alias("pct_off_52w_high"), F.col("zscore").alias("price_zscore"), "ps", "roic", "gm0", "vix",
        filters.signal_conviction(F.col("vix"), off).alias("conviction"), n.alias("n_passed"),
        F.create_map(*[x for f in names for x in (F.lit(f), F.col(f))]).alias("filters"), "all_pass")


def live_scan(inp: Inputs, date: Column, only_passing: bool = True) -> DataFrame:
    records = signal_records(all_filters(inp, on_date(inp, date), until=date))
    return records.where("all_pass") if only_passing else records


def research_report(inp: Inputs, probe: DataFrame, purchases: DataFrame | None = None) -> DataFrame:
    """One row per ticker: groups, verdict, triggers and key values."""
    rows = filters.with_verdict(filters.with_group_flags(all_filters(inp, probe), inp.cfg))
    out = rows.select("ticker", "date", *filters.GROUPS, "checks_passed", "groups_passed", "failing",
                      F.col("conviction"), "action", *filters.trigger_levels(inp.cfg),
                      "close_row", "ps", "ps_rank", "roic", "gm0")
    if purchases is not None:
        from tidemark.operators.snapshots import insider_summary
        s = insider_summary(purchases).withColumnsRenamed({"n": "insider_buys", "total": "insider_value"})
        out = out.join(s, "ticker", "left")
    return out


def thesis_states(inp: Inputs) -> DataFrame:
    """The thesis verdict in force from each publication day."""
    stream = inp.states
    probe = stream.frame.select("ticker", "published").distinct()
    seen = asof_backward(probe, "ticker", "published", [stream])
    bare = seen.select("*", F.lit(None).cast("double").alias("close"), F.lit(None).cast("double").alias("shares_used"))
    return metrics.with_metrics(bare, inp.cfg).select("ticker", "published", exits.thesis_break(inp.cfg).alias("reason"))


def entries_at(lists: DataFrame, bars: DataFrame, tier: Column) -> DataFrame:
    """Entries on the first bar at or after each list's effective day."""
    first = exits.first_bar_after(lists.select("ticker", "effective", tier.alias("tier")), bars, "effective", "entry_date")
    price = bars.select("ticker", F.col("date").alias("entry_date"), F.col("close").alias("entry_price"))
    return (first.where(F.col("entry_date").isNotNull()).join(price, ["ticker", "entry_date"])
            .select("ticker", "tier", "entry_date", "entry_price").distinct())


def basket_returns(inp: Inputs, targets: DataFrame, quarters: DataFrame) -> DataFrame:
    """Equal-weight holding return per period between effective days, against
    the benchmark's, and both compounded over the (quarterly) periods."""
    spans = in_force(quarters).where(F.col("until").isNotNull())
    held = targets.select("ticker", "effective").join(spans, "effective")
    closes = Stream(inp.bars.where(F.col("close").isNotNull()), "date", ["close"])
    start = asof_backward(held, "ticker", "effective", [closes]).withColumnRenamed("close", "p0")
    both = asof_backward(start, "ticker", "until", [closes]).withColumnRenamed("close", "p1")
    per = both.groupBy("effective", "until").agg(
        F.avg(growth("p1", "p0")).alias("basket_ret"), F.count(F.lit(1)).alias("names"))
    b = inp.benchmark.select("date", "close")
    market = (spans.join(b.select(F.col("date").alias("effective"), F.col("close").alias("b0")), "effective")
              .join(b.select(F.col("date").alias("until"), F.col("close").alias("b1")), "until")
              .select("effective", growth("b1", "b0").alias("bench_ret")))
    w = Window.orderBy("effective").rowsBetween(Window.unboundedPreceding, 0)  # one row per quarter
    return (per.join(market, "effective")
            .withColumn("basket_growth", F.product(1 + F.col("basket_ret")).over(w))
            .withColumn("bench_growth", F.product(1 + F.col("bench_ret")).over(w)))


def board(snapshot: DataFrame, scores: DataFrame, fear_count: Column) -> DataFrame:
    """Latest snapshot with scores, quick flags and labels, in board order."""
    rows = filters.quick_screen(snapshot.join(scores.select("ticker", "score"), "ticker", "left"), fear_count)
    return rows.withColumn("label", filters.score_label(F.col("score"))).orderBy(*ranking.board_order())


def with_scenarios(df: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Every row once per scenario; the grid is a literal array, not a join."""
    grid = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in scenarios])
    return df.withColumn("_s", F.explode(grid)).select(*df.columns, "_s.*")


def scenario_targets(inp: Inputs, panel: DataFrame, variants: list[str]) -> DataFrame:
    """Target lists of each scoring variant from one shared quarterly panel."""
    out = None
    for v in variants:
        part = ranked_watchlist(inp.variant(qvm_variant=v), panel).withColumn("scenario", F.lit(v))
        out = part if out is None else out.unionByName(part)
    return out
