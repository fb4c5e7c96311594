"""Performance, trade-log, walk-forward, bootstrap and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from tidemark.operators import bootstrap, curves, ranking, snapshots, trades, walkforward
from tidemark.operators.compound import compound_stats
from tidemark.operators.ranks import histogram
from tidemark.plans import pipelines as plans
from tidemark.sources import sinks
from tidemark.sources.sinks import stage
from tidemark.streaming import scan, streams


# ---- equity curves --------------------------------------------------------

def both_curves(w):
    """Benchmark buy-and-hold and an equal-weight basket of the panel."""
    basket = w.bars.groupBy("date").agg(F.avg("close").alias("close"))
    return curves.buy_and_hold(w.inputs.benchmark, 1e6).unionByName(
        curves.buy_and_hold(basket, 1e6).withColumn("scenario", F.lit("basket")))


query("q11_buy_and_hold", "scenario date value:2", "SELECT * FROM curve WHERE scenario = 'benchmark'")(
    lambda w: curves.buy_and_hold(w.inputs.benchmark, 1e6))

query("p10_daily_return", "scenario date ret:8", """SELECT *, value / lag(value) OVER (PARTITION BY scenario ORDER BY date) - 1 AS ret FROM curve""")(
    lambda w: curves.with_returns(both_curves(w)))

def model_and_bench(w):
    c = both_curves(w)
    return curves.align(c.where("scenario = 'basket'"), c.where("scenario = 'benchmark'"))


ALIGNED = """SELECT b.date, m.value AS model, b.value AS bench FROM (SELECT * FROM curve WHERE scenario = 'benchmark') b
  ASOF LEFT JOIN (SELECT v.* FROM curve v SEMI JOIN bench USING (date) WHERE scenario = 'basket') m ON b.date >= m.date"""
ALPHA = f"""SELECT date, CASE WHEN count(d) OVER f = 252 THEN sum(d) OVER f * 100 END AS rolling_alpha FROM (
  SELECT date, (model / lag(model) OVER (ORDER BY date) - 1) - (bench / lag(bench) OVER (ORDER BY date) - 1) AS d FROM ({ALIGNED}))
  WINDOW f AS (ORDER BY date ROWS 251 PRECEDING)"""
query("p11_rolling_alpha", "date rolling_alpha:4", ALPHA)(lambda w: curves.rolling_alpha(model_and_bench(w)))
query("j11_aligned_curves", "date model:2 bench:2", ALIGNED)(model_and_bench)

DRAW = """SELECT *, max(value) OVER t AS peak, (value - max(value) OVER t) / max(value) OVER t AS drawdown FROM curve
  WINDOW t AS (PARTITION BY scenario ORDER BY date)"""
query("p12_drawdown", "scenario date peak:2 drawdown:6", DRAW)(lambda w: curves.with_drawdown(both_curves(w)))
query("w5_running_max", "scenario date peak:2", DRAW)(lambda w: curves.with_drawdown(both_curves(w)))

METRICS = f"""SELECT scenario, pow(arg_max(value, date) / arg_min(value, date), 365.25::DOUBLE / (max(date) - min(date))) - 1 AS ann_return,
  avg(e) / stddev_samp(e) * sqrt(252) AS sharpe, min(drawdown) AS max_drawdown, count(e) AS n_returns FROM (
  SELECT *, value / lag(value) OVER (PARTITION BY scenario ORDER BY date) - 1 - (pow(1.03::DOUBLE, 1 / 252.0::DOUBLE) - 1) AS e FROM ({DRAW})) GROUP BY 1"""
query("a1_annual_return", "scenario ann_return:6", METRICS)(lambda w: curves.curve_metrics(both_curves(w)))
query("a2_sharpe", "scenario sharpe:6 n_returns!", METRICS)(lambda w: curves.curve_metrics(both_curves(w)))
query("a3_max_drawdown", "scenario max_drawdown:6", METRICS)(lambda w: curves.curve_metrics(both_curves(w)))

YEARLY = """SELECT scenario, year, last / lag(last) OVER (PARTITION BY scenario ORDER BY year) - 1 AS ret FROM (
  SELECT scenario, year(date) AS year, arg_max(value, date) AS last FROM curve GROUP BY 1, 2)"""
query("a4_yearly_returns", "scenario year! ret:6", f"SELECT * FROM ({YEARLY}) WHERE ret IS NOT NULL")(
    lambda w: curves.yearly_returns(both_curves(w)))
YEARS = f"""SELECT year, max(ret) FILTER (WHERE scenario = 'basket') AS model, max(ret) FILTER (WHERE scenario = 'benchmark') AS bench,
  max(ret) FILTER (WHERE scenario = 'basket') - max(ret) FILTER (WHERE scenario = 'benchmark') AS difference
  FROM ({YEARLY}) WHERE ret IS NOT NULL GROUP BY 1"""
query("a6_year_table", "year! model:6 bench:6 difference:6", YEARS)(lambda w: curves.year_table(both_curves(w), "basket", "benchmark"))
query("j12_year_matrix", "year! model:6 bench:6", YEARS)(
    lambda w: curves.year_matrix(both_curves(w), ["basket", "benchmark"]).withColumnsRenamed({"basket": "model", "benchmark": "bench"}))
query("a7_comparison_matrix", "metric basket:6 benchmark:6", f"""SELECT metric, max(v) FILTER (WHERE scenario = 'basket') AS basket,
  max(v) FILTER (WHERE scenario = 'benchmark') AS benchmark FROM (SELECT scenario, u.metric, u.v FROM ({METRICS}), LATERAL (VALUES
  ('ann_return', ann_return), ('sharpe', sharpe), ('max_drawdown', max_drawdown)) AS u(metric, v)) GROUP BY 1""")(
    lambda w: curves.metric_matrix(curves.curve_metrics(both_curves(w)), ["ann_return", "sharpe", "max_drawdown"], ["basket", "benchmark"]))
query("q21_regime_flags", "date bear crossing", """SELECT date, bear, CASE WHEN bear AND NOT lag(bear) OVER (ORDER BY date) THEN 'DOWN'
  WHEN NOT bear AND lag(bear) OVER (ORDER BY date) THEN 'UP' END AS crossing FROM (SELECT date, close < ema_200 AS bear FROM benchf)""")(
    lambda w: curves.regime_flags(plans.prices.benchmark_features(w.inputs.benchmark)))


# ---- trade log ------------------------------------------------------------

query("a5_closed_metrics", "tier win_rate:6 total_trades! closed_trades! avg_hold_days:4", """SELECT tier,
  avg(CAST(return_dec > 0 AS DOUBLE)) FILTER (WHERE exit_reason <> 'backtest_end') AS win_rate, count(*) AS total_trades,
  count(*) FILTER (WHERE exit_reason <> 'backtest_end') AS closed_trades, avg(hold_days) AS avg_hold_days FROM trades GROUP BY 1""")(
    lambda w: trades.closed_metrics(w.trades, ["tier"]))
METRIC_ROW = f"""WITH al AS (SELECT * FROM ({ALIGNED}) WHERE model IS NOT NULL),
  c AS (SELECT 'model' AS scenario, date, model AS value FROM al UNION ALL SELECT 'bench', date, bench FROM al),
  dd AS (SELECT *, (value - max(value) OVER t) / max(value) OVER t AS drawdown, value / lag(value) OVER t - 1 - (pow(1.03::DOUBLE, 1 / 252.0::DOUBLE) - 1) AS e
    FROM c WINDOW t AS (PARTITION BY scenario ORDER BY date)),
  m AS (SELECT scenario, pow(arg_max(value, date) / arg_min(value, date), 365.25::DOUBLE / (max(date) - min(date))) - 1 AS r,
    avg(e) / stddev_samp(e) * sqrt(252) AS s, min(drawdown) AS d FROM dd GROUP BY 1),
  t AS (SELECT avg(CAST(exit_price / entry_price - 1 > 0 AS DOUBLE)) FILTER (WHERE exit_reason <> 'backtest_end') AS win_rate, count(*) AS total_trades,
    count(*) FILTER (WHERE exit_reason <> 'backtest_end') AS closed_trades, avg(exit_date - entry_date) AS avg_hold_days FROM resolved)
  SELECT 'combined' AS mode, a.r AS ann_return_model, b.r AS ann_return_bench, a.r - b.r AS alpha, a.s AS sharpe_model, b.s AS sharpe_bench,
    a.d AS max_dd_model, b.d AS max_dd_bench, t.* FROM m a, m b, t WHERE a.scenario = 'model' AND b.scenario = 'bench'"""
ROW_SHAPE = ("mode ann_return_model:6 ann_return_bench:6 alpha:6 sharpe_model:6 sharpe_bench:6 max_dd_model:6 max_dd_bench:6 "
             "win_rate:6 total_trades! closed_trades! avg_hold_days:4")


def metric_row(w):
    c = both_curves(w)
    return curves.metric_row(c.where("scenario = 'basket'"), c.where("scenario = 'benchmark'"), w.resolved_trades, "combined")


query("a5_metric_row", ROW_SHAPE, METRIC_ROW)(metric_row)


@query("s11_metrics_write", ROW_SHAPE, METRIC_ROW)
def _(w):
    path = sinks.new_path(w.spark, "metrics")
    sinks.write_metrics(metric_row(w), path, "parquet")
    return w.spark.read.parquet(path)


query("a9_trade_stats", "tier n! win_rate:6 mean:8 best:6 worst:6 avg_hold:4", """SELECT tier, count(*) AS n, avg(CAST(return_pct > 0 AS DOUBLE)) AS win_rate,
  avg(return_pct) AS mean, max(return_pct) AS best, min(return_pct) AS worst, avg(hold_days) AS avg_hold FROM trades GROUP BY ROLLUP (tier)""")(
    lambda w: trades.trade_stats(w.trades))
query("a21_exit_profile", "exit_reason n! win_rate:6 pnl:2", """SELECT exit_reason, count(*) AS n, avg(CAST(return_dec > 0 AS DOUBLE)) AS win_rate,
  sum(pnl_dollars) AS pnl FROM trades GROUP BY 1""")(lambda w: trades.exit_profile(w.trades))

EQUITY = """SELECT *, 1000000 * product(1 + 0.1::DOUBLE * return_dec) OVER (ORDER BY entry_date, h, ticker ROWS UNBOUNDED PRECEDING) AS equity,
  row_number() OVER (ORDER BY entry_date, h, ticker) AS pos FROM done"""
query("w4_compounding", "ticker! entry_date equity:0 drawdown:5", f"""SELECT *, equity / greatest(1000000.0::DOUBLE, max(equity) OVER (ORDER BY pos)) - 1 AS drawdown FROM ({EQUITY})""")(
    lambda w: trades.trade_curve(w.trades))
query("q16_trade_equity", "date entry_date ticker! equity:0 drawdown:5", f"""SELECT *, exit_date AS date,
  equity / greatest(1000000.0::DOUBLE, max(equity) OVER (ORDER BY exit_date, pos ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM ({EQUITY})""")(
    lambda w: trades.exit_dated_curve(w.trades, []))


def bench_years(w):
    return w.inputs.benchmark.groupBy(F.year("date").cast("bigint").alias("year")).agg(
        (F.max_by("close", "date") / F.min_by("close", "date") * 100 - 100).alias("ret_pct"))


def wf(w):
    return walkforward.walk_forward(w.trades, bench_years(w))


WF_SHAPE = ("period kind fold! start_year! end_year! n_trades! n_qvm! n_crash! win_rate:4 avg_return:6 median_return:6 best_trade:4 worst_trade:4 "
            "avg_hold:4 cagr:4 bench_cagr:4 alpha:4 max_drawdown:4 sharpe:4 profit_factor:6")
query("a10_period_metrics", WF_SHAPE, "SELECT * FROM wf")(wf)
query("a11_active_years", "year! n!", "SELECT * FROM active")(lambda w: walkforward.active_years(walkforward.completed(w.trades)))
CONSIST = """SELECT count(*) AS years, stddev_pop(cagr) AS cagr_sd, min(cagr) AS cagr_min, max(cagr) AS cagr_max, stddev_pop(win_rate) AS win_sd,
  min(sharpe) AS sharpe_min, avg(sharpe) AS sharpe_mean, max(sharpe) AS sharpe_max, count(*) FILTER (WHERE cagr > 0) AS positive_years,
  count(*) FILTER (WHERE alpha > 0) AS positive_alpha FROM wf WHERE kind = 'year'"""
query("a12_consistency", "years! cagr_sd:4 cagr_min:4 cagr_max:4 win_sd:4 sharpe_min:4 sharpe_max:4 positive_years! positive_alpha!", CONSIST)(
    lambda w: walkforward.consistency(w.walk))
query("a13_tier_years", "tier year! n! win_rate:4 avg_return:6 tier_win_mean:4 tier_win_sd:4", """SELECT *, avg(win_rate) OVER (PARTITION BY tier) AS tier_win_mean,
  stddev_pop(win_rate) OVER (PARTITION BY tier) AS tier_win_sd FROM (SELECT tier, year(entry_date) AS year, count(*) AS n,
  avg(CAST(return_pct > 0 AS DOUBLE)) * 100 AS win_rate, avg(return_pct) AS avg_return FROM done GROUP BY 1, 2)""")(
    lambda w: walkforward.tier_years(w.trades))
query("q12_folds", "fold! train_n_trades! test_n_trades! train_win_rate:4 test_win_rate:4 diff_win_rate:4 diff_sharpe:4 train_max_drawdown:4", """SELECT a.fold,
  a.n_trades AS train_n_trades, b.n_trades AS test_n_trades, a.win_rate AS train_win_rate, b.win_rate AS test_win_rate, b.win_rate - a.win_rate AS diff_win_rate,
  b.sharpe - a.sharpe AS diff_sharpe, a.max_drawdown AS train_max_drawdown FROM (SELECT * FROM wf WHERE kind = 'train') a
  JOIN (SELECT * FROM wf WHERE kind = 'test') b USING (fold)""")(lambda w: walkforward.folds(w.walk))
query("q13_stability", "win_rate_1:4 win_rate_2:4 sharpe_1:4 sharpe_2:4 points! verdict", """SELECT *, CASE WHEN points >= 4 THEN 'HIGH' WHEN points >= 2 THEN 'MODERATE' ELSE 'LOW' END AS verdict FROM (
  SELECT a.win_rate AS win_rate_1, b.win_rate AS win_rate_2, a.sharpe AS sharpe_1, b.sharpe AS sharpe_2,
  CASE WHEN b.win_rate - a.win_rate < -10 THEN 2 WHEN b.win_rate - a.win_rate < -5 THEN 1 ELSE 0 END
  + CASE WHEN b.sharpe - a.sharpe < -0.5 THEN 2 WHEN b.sharpe - a.sharpe < -0.2 THEN 1 ELSE 0 END
  + CASE WHEN b.avg_return - a.avg_return < -5 THEN 2 WHEN b.avg_return - a.avg_return < -2 THEN 1 ELSE 0 END
  + CASE WHEN b.profit_factor < 1 AND a.profit_factor > 1 THEN 3 WHEN b.profit_factor < a.profit_factor * 0.5 THEN 2 ELSE 0 END AS points
  FROM (SELECT * FROM wf WHERE kind = 'half' AND fold = 1) a, (SELECT * FROM wf WHERE kind = 'half' AND fold = 2) b)""")(
    lambda w: walkforward.stability(w.walk))
query("q14_assessment", "years! return_label alpha_label cagr_label win_label sharpe_label", f"""SELECT years,
  CASE WHEN positive_years > years * 0.6 THEN 'Good' ELSE 'Concern' END AS return_label, CASE WHEN positive_alpha > years * 0.4 THEN 'Good' ELSE 'Concern' END AS alpha_label,
  CASE WHEN cagr_sd < 20 THEN 'Good' ELSE 'High variance' END AS cagr_label, CASE WHEN win_sd < 15 THEN 'Good' ELSE 'High variance' END AS win_label,
  CASE WHEN sharpe_mean > 0.3 THEN 'Good' ELSE 'Weak' END AS sharpe_label FROM ({CONSIST})""")(
    lambda w: walkforward.assessment(walkforward.consistency(w.walk)))


# ---- bootstrap ------------------------------------------------------------

def returns(w):
    known = w.resolved_trades.where(F.col("return_dec").isNotNull())
    return bootstrap.numbered(known, ["entry_date", "ticker", "tier"]).select("idx", "return_dec")


def sims(w):
    return bootstrap.simulate(stage(returns(w), "returns"), 1000)


query("q15_bootstrap", "sim! final_value:0 cagr:6 max_drawdown:6 sharpe:5 win_rate:6", "SELECT * FROM simstats")(sims)
query("q15_bootstrap_full", "sim! final_value:0 cagr:6 max_drawdown:6 sharpe:5 win_rate:6", "SELECT * FROM simstats_full")(
    lambda w: bootstrap.simulate(stage(returns(w), "returns")))


@query("s12_sim_stats_write", "sim! final_value:0 max_drawdown:6", "SELECT * FROM simstats")
def _(w):
    path = sinks.new_path(w.spark, "sim-stats")
    sinks.write_sim_stats(w.sim_stats, path)
    return w.spark.read.parquet(path)


LONG = """SELECT sim, u.metric, u.v FROM simstats, LATERAL (VALUES ('final_value', final_value), ('cagr', cagr), ('max_drawdown', max_drawdown), ('sharpe', sharpe)) AS u(metric, v)"""
query("a14_percentiles", "metric p5:4 p25:4 p50:4 p75:4 p95:4 mean:4", f"""SELECT metric, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50,
  quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95, avg(v) AS mean FROM ({LONG}) GROUP BY 1""")(lambda w: bootstrap.outcome_percentiles(w.sim_stats))
query("a15_probabilities", "p_profit:6 p_beat_benchmark:6 p_over_10:6 p_over_5:6 p_loss:6 p_deep_drawdown:6", """SELECT avg(CAST(final_value > 1000000 AS DOUBLE)) AS p_profit,
  avg(CAST(cagr > 0.13 AS DOUBLE)) AS p_beat_benchmark, avg(CAST(cagr > 0.10 AS DOUBLE)) AS p_over_10, avg(CAST(cagr > 0.05 AS DOUBLE)) AS p_over_5,
  avg(CAST(final_value < 1000000 AS DOUBLE)) AS p_loss, avg(CAST(max_drawdown < -0.30 AS DOUBLE)) AS p_deep_drawdown FROM simstats""")(
    lambda w: bootstrap.outcome_probabilities(w.sim_stats))
query("w12_representative_paths", "point target:0 sim! final_value:0", """SELECT point, target, arg_min(sim, {'g': round(abs(final_value - target) / abs(target), 9), 's': sim}) AS sim,
  arg_min(final_value, {'g': round(abs(final_value - target) / abs(target), 9), 's': sim}) AS final_value FROM simstats, (SELECT 'p5' AS point, quantile_cont(final_value, 0.05) AS target FROM simstats
    UNION ALL SELECT 'p25', quantile_cont(final_value, 0.25) FROM simstats UNION ALL SELECT 'p50', quantile_cont(final_value, 0.5) FROM simstats
    UNION ALL SELECT 'p75', quantile_cont(final_value, 0.75) FROM simstats UNION ALL SELECT 'p95', quantile_cont(final_value, 0.95) FROM simstats) GROUP BY 1, 2""")(
    lambda w: bootstrap.representative_paths(w.sim_stats))
query("w13_sample_paths", "sim!", "SELECT sim FROM simstats ORDER BY md5(sim || '-42'), sim LIMIT 3")(lambda w: ranking.sample_keys(w.sim_stats, "sim", 3))
PATH = """SELECT c.{0}, s.sim, s.draw, s.e * 1000000.0::DOUBLE AS equity, s.e / greatest(max(s.e) OVER (PARTITION BY c.{0}, s.sim ORDER BY s.draw), 1) - 1 AS drawdown
  FROM ({1}) c JOIN (SELECT *, product(1 + 0.1::DOUBLE * return_dec) OVER (PARTITION BY sim ORDER BY draw ROWS UNBOUNDED PRECEDING) AS e FROM sims) s ON s.sim = c.sim"""
POINTS = """SELECT point, arg_min(sim, {'g': round(abs(final_value - target) / abs(target), 9), 's': sim}) AS sim FROM simstats, (SELECT 'p5' AS point, quantile_cont(final_value, 0.05) AS target FROM simstats
    UNION ALL SELECT 'p25', quantile_cont(final_value, 0.25) FROM simstats UNION ALL SELECT 'p50', quantile_cont(final_value, 0.5) FROM simstats
    UNION ALL SELECT 'p75', quantile_cont(final_value, 0.75) FROM simstats UNION ALL SELECT 'p95', quantile_cont(final_value, 0.95) FROM simstats) GROUP BY 1"""
query("w12_drawn_paths", "point sim! draw! equity:2 drawdown:6", PATH.format("point", POINTS))(
    lambda w: bootstrap.drawn_paths(stage(returns(w), "returns"), stage(bootstrap.representative_paths(w.sim_stats).select("point", "sim"), "chosen")))
query("w13_drawn_paths", "kind sim! draw! equity:2 drawdown:6", PATH.format("kind", "SELECT 'sample' AS kind, sim FROM simstats ORDER BY md5(sim || '-42'), sim LIMIT 3"))(
    lambda w: bootstrap.drawn_paths(stage(returns(w), "returns"), stage(ranking.sample_keys(w.sim_stats, "sim", 3).select(F.lit("sample").alias("kind"), "sim"), "chosen")))
query("a16_histogram", "tier bin! n!", """SELECT tier, CAST(least(floor((return_pct - lo) / (hi - lo) * 80), 79) AS BIGINT) AS bin, count(*) AS n
  FROM done JOIN (SELECT tier, min(return_pct) AS lo, max(return_pct) AS hi FROM done GROUP BY 1) USING (tier) GROUP BY 1, 2""")(
    lambda w: histogram(w.trades.where(F.col("return_pct").isNotNull()), ["tier"], "return_pct", 80))
query("a16_outcome_histograms", "metric bin! n!", f"""SELECT metric, CAST(least(floor((v - lo) / (hi - lo) * 80), 79) AS BIGINT) AS bin, count(*) AS n
  FROM ({LONG}) JOIN (SELECT metric, min(v) AS lo, max(v) AS hi FROM ({LONG}) GROUP BY 1) USING (metric) GROUP BY 1, 2""")(
    lambda w: bootstrap.outcome_histograms(w.sim_stats))
query("w4_growth_by_tier", "tier growth:6 max_drawdown:6", """SELECT tier, arg_max(e, n) AS growth, least(min(e / greatest(peak, 1)) - 1, 0) AS max_drawdown FROM (
  SELECT *, max(e) OVER (PARTITION BY tier ORDER BY n) AS peak FROM (SELECT tier, row_number() OVER o AS n, product(1 + 0.1::DOUBLE * return_dec) OVER o AS e FROM done
  WINDOW o AS (PARTITION BY tier ORDER BY entry_date, h, ticker ROWS UNBOUNDED PRECEDING))) GROUP BY 1""")(
    lambda w: compound_stats(trades.ordered(w.trades.where(F.col("return_dec").isNotNull())), ["tier"], trades.CHUNK, trades.ORDER, F.col("return_dec"), 0.1))


# ---- streams --------------------------------------------------------------

ALERTS = """WITH days AS (SELECT date, lead(date) OVER (ORDER BY date) AS due FROM (SELECT DISTINCT date FROM scores)),
  s AS (SELECT ticker, date, due, max(score) AS score, CASE WHEN max(score) >= 11 THEN max(score) ELSE 0 END AS lvl FROM scores JOIN days USING (date) GROUP BY 1, 2, 3)
  SELECT coalesce(n.ticker, p.ticker) AS ticker, coalesce(n.date, p.due) AS date,
    CASE WHEN n.lvl > 0 AND coalesce(p.lvl, 0) = 0 THEN 'NEW' WHEN n.lvl > 0 AND n.lvl <> p.lvl THEN 'CHANGED' WHEN coalesce(n.lvl, 0) = 0 AND p.lvl > 0 THEN 'REMOVED' END AS change,
    n.score, coalesce(p.lvl, 0) AS prev_score
  FROM s n FULL JOIN (SELECT * FROM s WHERE due IS NOT NULL) p ON n.ticker = p.ticker AND n.date = p.due WHERE change IS NOT NULL"""


@query("st1_stream_alerts", "ticker! date change score! prev_score!", ALERTS)
def _(w):
    # Three deliveries of whole scan days, oldest first, however many days there are; each is drained as
    # one batch by a run of its own that goes on from the state of the one before.
    src, root = sinks.new_path(w.spark, "score-days"), sinks.new_path(w.spark, "alerts")
    s = w.panel.scores()
    low, high = s.agg(F.min("date"), F.max("date")).first()
    third = F.floor(F.datediff("date", F.lit(low)) * 3 / (F.datediff(F.lit(high), F.lit(low)) + 1))
    for k in range(3):
        s.where(third == k).write.mode("append").parquet(src)
        out = streams.stream_alerts(w.spark.readStream.schema(s.schema).parquet(src), root=root)
    return out


@query("q17_change_feed", "ticker! date change score! prev_score!", ALERTS)
def _(w):
    # Every scan day of the data, appended to the history in two deliveries.
    path, s = sinks.new_path(w.spark, "scans"), w.panel.scores().withColumnRenamed("date", "scan_date")
    low, high = s.agg(F.min("scan_date"), F.max("scan_date")).first()
    late = F.datediff("scan_date", F.lit(low)) * 2 > F.datediff(F.lit(high), F.lit(low))
    for some in (s.where(~late), s.where(late)):
        snapshots.write_scans(some, path, 8)
    return snapshots.change_feed(w.spark, path)


@query("st2_stream_scan", "ticker! date ps:6 ps_threshold:6 zscore:6 high_52w:6 ema_50:6 momentum_rank:6 quality_pass entry_pass all_pass",
       """SELECT *, as_of AS date, quality_pass AND entry_pass AS all_pass FROM daily""")
def _(w):
    # History up to the last six days is the first delivery; the days follow in three more of two days each.
    inp, src, root = w.inputs, sinks.new_path(w.spark, "events"), sinks.new_path(w.spark, "scan")
    days = sorted(r.date for r in inp.days.orderBy(F.desc("date")).limit(6).collect())
    events = stage(scan.scan_events(inp.bars, inp.states.frame, inp.periods, inp.company), "events")
    ends = [days[0], *days[2::2], None]
    for k, end in enumerate(ends):
        new = F.lit(True) if end is None else F.col("date") < F.lit(end)
        new = new if k == 0 else new & (F.col("date") >= F.lit(ends[k - 1]))
        events.where(new).write.mode("append").parquet(src)
        stream = w.spark.readStream.schema(events.schema).parquet(src)
        out = scan.incremental_scan(stream, inp.states.frame, inp.universe, inp.company, inp.market, since=days[0], root=root)
    return out


@query("st3_bars_from_ticks", "key! date open:4 high:4 low:4 close:4 volume!", """SELECT user_id AS key, CAST(ts AS DATE) AS date, arg_min(value, {'t': ts, 'v': value}) AS open,
  max(value) AS high, min(value) AS low, arg_max(value, {'t': ts, 'v': value}) AS close, count(*) AS volume FROM events
  WHERE CAST(ts AS DATE) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) GROUP BY 1, 2""")
def _(w):
    ticks = streams.read_stream(w.spark, w.path, "events").select(F.col("user_id").alias("key"), "ts", "value")
    return streams.run_to_table(streams.bars_from_ticks(ticks), "daily-bars")
