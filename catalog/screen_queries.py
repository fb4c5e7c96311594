"""Statement metrics, filters, exits and screening pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.sql import CTE, scan_day
from tidemark.operators import exits, filters, metrics, prices, ranking, snapshots, statements
from tidemark.plans import pipelines as plans


def entries(w):
    lists = w.quarterly.where(F.col("f4_de_ratio") & F.col("ebit_yield").isNotNull())
    return plans.entries_at(lists, w.bars, F.when(F.col("ebit_yield") > 0.1, "qvm").otherwise("crash"))


# ---- statement metrics: each reads its columns of the quarterly panel ------

def panel_query(name: str, shape: str) -> None:
    query(name, f"ticker! as_of {shape}", "SELECT * FROM panel")(lambda w: w.quarterly)


panel_query("g4_revenue_growth", "g1:6 g2:6 growth_known")
panel_query("g5_gross_margin", "gm0:6 gm1:6")
panel_query("g6_roic", "roic:6")
panel_query("g7_debt_to_equity", "de_ratio:6")
panel_query("g8_free_cash_flow", "fcf:6")
panel_query("g9_cash_runway", "runway:4")
panel_query("g10_ttm", "revenue_ttm:6 net_income_ttm:6")
panel_query("g11_yields", "ev:2 fcf_yield:6 ebit_yield:6")
panel_query("g12_gross_over_assets", "gp_assets:6")
panel_query("g13_quality_score", "fscore!")
panel_query("g14_price_to_sales", "ps:6")
panel_query("g15_peg", "pe:4 peg:4")
panel_query("g16_profitable_and_balance", "profitable total_debt:6 cash:6 equity:6")
panel_query("g17_falling_periods", "falling!")
panel_query("g18_market_cap", "close:6 shares_used:0 market_cap:2 pe:4")
panel_query("g20_ps_percentile", "ps_n! ps_pct:6")
panel_query("g21_ps_summary", "ps_n! ps_min:6 ps_max:6 ps_rank!")
panel_query("f1_rev_growth", "f1_rev_growth")
panel_query("f2_gross_margin", "f2_gross_margin")
panel_query("f3_roic", "f3_roic")
panel_query("f4_de_ratio", "f4_de_ratio")
panel_query("f5_fcf", "f5_fcf")
panel_query("f6_peg_ps", "f6_peg_ps")
panel_query("f7_fcf_yield", "f7_fcf_yield")
panel_query("f13_quality_gate", "f1_rev_growth f2_gross_margin f3_roic f4_de_ratio f5_fcf f6_peg_ps f7_fcf_yield quality_pass")


@query("g1_availability", "ticker! as_of quarterly! annual! newest", """SELECT p.ticker, p.as_of,
  count(*) FILTER (WHERE s.freq = 'quarterly') AS quarterly, count(*) FILTER (WHERE s.freq = 'annual') AS annual, max(s.period_end) AS newest
  FROM probe_q p JOIN stmt s ON p.ticker = s.ticker AND s.period_end + 45 <= p.as_of GROUP BY 1, 2""")
def _(w):
    from tidemark.operators.asof import available_periods
    grid = plans.ticker_dates(plans.eligible(w.inputs), w.quarters, "eval_date").select("ticker", F.col("eval_date").alias("as_of"))
    inc = w.inputs.periods.where("statement = 'income'").select("ticker", "freq", "period_end")
    return available_periods(grid, inc, "ticker", "as_of", "period_end", 45).groupBy("ticker", "as_of").agg(
        F.count_if(F.col("freq") == "quarterly").alias("quarterly"), F.count_if(F.col("freq") == "annual").alias("annual"),
        F.max("period_end").alias("newest"))


@query("g2_label_resolution", "ticker! freq period_end label value:6", """SELECT ticker, freq, period_end,
  CASE WHEN s_acctbal > 0 THEN 'Total Revenue' ELSE 'Revenue' END AS label,
  CASE WHEN s_acctbal > 0 THEN CASE WHEN revenue > 500000 THEN revenue END ELSE revenue * 2 END AS value
  FROM stmt JOIN supplier ON s_suppkey = ticker""")
def _(w):
    # The preferred label may be NULL in a period, or absent from a statement.
    s = w.panel.statements_wide().select("ticker", "freq", "period_end", F.col("Total Revenue").alias("v"))
    bal = w.panel.table("supplier").select(F.col("s_suppkey").alias("ticker"), "s_acctbal")
    rows = s.join(bal, "ticker").select("ticker", "freq", "period_end", F.lit("income").alias("statement"), F.explode(F.array(
        F.when(F.col("s_acctbal") > 0, F.struct(F.lit("Total Revenue").alias("item"), F.when(F.col("v") > 500000, F.col("v")).alias("value"))),
        F.struct(F.lit("Revenue").alias("item"), (F.col("v") * 2).alias("value")))).alias("x"))
    long = rows.where("x IS NOT NULL").select("ticker", "freq", "statement", "period_end", "x.*")
    return statements.resolve_labels(long).select("ticker", "freq", "period_end", "label", "value")


@query("g3_frequency", "ticker! as_of income_freq balance_freq cash_freq",
       "SELECT *, income_freq AS cash_freq FROM panel")
def _(w):
    return w.quarterly


@query("g19_ps_history", "ticker! as_of ps_n! ps_sum:4 ps_threshold:6", """SELECT m.ticker, m.as_of, coalesce(h.ps_n, 0) AS ps_n, h.ps_sum, h.ps_threshold
  FROM met_q m LEFT JOIN (SELECT ticker, as_of, count(v) AS ps_n, sum(v) AS ps_sum, CASE WHEN count(v) >= 2 THEN quantile_cont(v, 0.25) END AS ps_threshold
  FROM (SELECT ticker, as_of, unnest(CASE WHEN len(hq) < 4 AND len(ha) > len(hq) THEN ha ELSE hq END) AS v FROM (
    SELECT p.ticker, p.as_of, coalesce(list(h.ps) FILTER (WHERE h.freq = 'quarterly'), []) AS hq, coalesce(list(h.ps) FILTER (WHERE h.freq = 'annual'), []) AS ha
    FROM probe_q p LEFT JOIN psp h ON p.ticker = h.ticker AND h.pub <= p.as_of AND h.pub >= p.as_of - 1095 GROUP BY 1, 2))
  GROUP BY 1, 2) h ON m.ticker = h.ticker AND m.as_of = h.as_of""")
def _(w):
    total = F.aggregate("ps_hist", F.lit(0.0), lambda a, x: a + x)
    return w.quarterly.withColumn("ps_sum", F.when(F.size("ps_hist") > 0, total))


@query("w7_run_length", "ticker! date run!", """SELECT ticker, date, CASE WHEN down THEN count(*) FILTER (WHERE down) OVER (PARTITION BY ticker, grp ORDER BY date) ELSE 0 END AS run
  FROM (SELECT *, sum(CASE WHEN down THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS grp
    FROM (SELECT ticker, date, coalesce(close < open, false) AS down FROM bars))""")
def _(w):
    return prices.run_length(w.bars.select("ticker", "date", "open", "close"), F.col("close") < F.col("open"), "run")


# ---- entry filters --------------------------------------------------------

@query("f8_fear_regime", "date vix:4 below_trend:6 drawdown:6 fear_count! f8_fear_regime", "SELECT *, f8 AS f8_fear_regime FROM market")
def _(w):
    i = w.inputs
    return filters.market_state(i.days, prices.benchmark_features(i.benchmark), i.vix)


def latest_query(name: str, shape: str, sql: str = "SELECT * FROM latest") -> None:
    query(name, f"ticker! as_of {shape}", sql)(lambda w: w.latest.withColumnRenamed("date", "as_of"))


latest_query("f9_price_disloc", "zscore:6 high_52w:6 f9_price_disloc")
latest_query("f10_momentum", "momentum_rank:6 f10_momentum")
latest_query("f11_ps_quartile", "ps:6 ps_threshold:6 f11_ps_quartile")
latest_query("f12_above_ema50", "close_row:6 ema_50:6 f12_above_ema50")
latest_query("f14_entry_gate", "f8_fear_regime f9_price_disloc f10_momentum f11_ps_quartile f12_above_ema50 entry_pass")
latest_query("f15_all_filters", "f1_rev_growth f2_gross_margin f3_roic f4_de_ratio f5_fcf f6_peg_ps f7_fcf_yield f8_fear_regime "
             "f9_price_disloc f10_momentum f11_ps_quartile f12_above_ema50 all_pass",
             "SELECT *, quality_pass AND entry_pass AS all_pass FROM latest")


@query("f16_sub_checks", "ticker! as_of check_id grp passed value:6 threshold:6", "SELECT * FROM checks")
def _(w):
    return filters.sub_checks(w.latest, ["ticker", "date"]).withColumnRenamed("date", "as_of")


@query("f17_group_rollup", "ticker! as_of grp yes! no! unknown! group_pass", "SELECT *, unk AS unknown FROM groups")
def _(w):
    return filters.rollup_checks(filters.sub_checks(w.latest, ["ticker", "date"]), ["ticker", "date"]).withColumnRenamed("date", "as_of")


def verdicts(w):
    v = filters.with_verdict(filters.with_group_flags(w.latest))
    return v.withColumn("failing", F.concat_ws(",", "failing")).withColumnRenamed("date", "as_of")


query("f18_conviction", "ticker! as_of n! conviction", "SELECT * FROM verdict")(
    lambda w: verdicts(w).withColumn("n", F.col("groups_passed")))
query("f19_next_action", "ticker! as_of failing action", "SELECT * FROM verdict")(verdicts)

TRIGGERS = """SELECT v.ticker, v.as_of, CASE WHEN no8 AND vix IS NOT NULL THEN 25.0 END AS trigger_vix, CASE WHEN no8 THEN 35.0 END AS trigger_sentiment,
  CASE WHEN no9 THEN high_52w * (1 - 0.20::DOUBLE) END AS trigger_high, CASE WHEN no9 AND sd_52w > 0 THEN mean_52w - 1.5 * sd_52w END AS trigger_zscore,
  CASE WHEN no12 THEN ema_50 * 0.90::DOUBLE END AS trigger_ema, v.n, v.conviction, v.action, v.failing, l.ps, l.ps_rank, l.roic, l.gm0, l.close_row
  FROM verdict v JOIN latest l ON v.ticker = l.ticker AND v.as_of = l.as_of"""


@query("f20_triggers", "ticker! as_of trigger_vix:2 trigger_sentiment:2 trigger_high:4 trigger_zscore:4 trigger_ema:4", TRIGGERS)
def _(w):
    v = filters.with_group_flags(w.latest)
    return v.select("ticker", F.col("date").alias("as_of"), *filters.trigger_levels())


@query("f21_signal_conviction", "ticker! scan_date price:4 pct_off_52w_high:6 conviction n_passed!", """SELECT ticker, as_of AS scan_date, close_row AS price,
  (high_52w - close_row) / high_52w AS pct_off_52w_high,
  CASE WHEN vix >= 35 AND (high_52w - close_row) / high_52w >= 0.30 THEN 'EXTREME'
    WHEN vix >= 25 AND (high_52w - close_row) / high_52w >= 0.20 THEN 'HIGH' ELSE 'MODERATE' END AS conviction,
  coalesce(CAST(f1_rev_growth AS INT), 0) + coalesce(CAST(f2_gross_margin AS INT), 0) + coalesce(CAST(f3_roic AS INT), 0)
  + coalesce(CAST(f4_de_ratio AS INT), 0) + coalesce(CAST(f5_fcf AS INT), 0) + coalesce(CAST(f6_peg_ps AS INT), 0)
  + coalesce(CAST(f7_fcf_yield AS INT), 0) + CAST(f8_fear_regime AS INT) + CAST(f9_price_disloc AS INT) + CAST(f10_momentum AS INT)
  + CAST(f11_ps_quartile AS INT) + CAST(f12_above_ema50 AS INT) AS n_passed FROM latest""")
def _(w):
    return plans.signal_records(w.latest)


QUICK = """SELECT s.*, off_high < -20 AS quick_f9, abs(vs_ema50) < 10 AS quick_f12, fear_count >= 2 AS quick_f8,
  CAST(fear_count >= 2 AS INT) + CAST(off_high < -20 AS INT) + CAST(abs(vs_ema50) < 10 AS INT) AS quick_pass
  FROM snap s CROSS JOIN (SELECT fear_count FROM market ORDER BY date DESC LIMIT 1)"""
CTE["quick"] = QUICK


def last_fear(w):
    return w.inputs.market.agg(F.max_by("fear_count", "date")).scalar()


@query("f22_quick_screen", "ticker! quick_f8 quick_f9 quick_f12 quick_pass! advice", """SELECT *, CASE quick_pass WHEN 3 THEN 'CRASH-TIER CANDIDATE'
  WHEN 0 THEN 'NO ACTION' ELSE 'WATCHLIST' END AS advice FROM quick""")
def _(w):
    return filters.quick_screen(prices.live_snapshot(w.bars), last_fear(w))


@query("f23_fear_history", "date fear_count! vix:4", "SELECT * FROM market WHERE fear_count >= 1")
def _(w):
    return filters.fear_history(w.inputs.market)


@query("f24_status_labels", "date status band", """SELECT m.date, CASE WHEN fear_count >= 2 THEN 'ACTIVE' WHEN fear_count = 1 THEN 'CAUTION' ELSE 'CALM' END AS status,
  CASE WHEN s < 25 THEN 'EXTREME FEAR' WHEN s < 35 THEN 'FEAR' WHEN s < 55 THEN 'NEUTRAL' WHEN s < 75 THEN 'GREED' WHEN s IS NOT NULL THEN 'EXTREME GREED' END AS band
  FROM market m LEFT JOIN (SELECT d AS date, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) / count(*) * 100 AS s FROM li GROUP BY 1 HAVING count(*) >= 10) USING (date)""")
def _(w):
    m = w.inputs.market.select("date", "fear_count").join(w.panel.side_inputs(), "date", "left")
    return m.select("date", filters.fear_status(F.col("fear_count")).alias("status"),
                    filters.sentiment_band(F.col("sentiment")).alias("band"))


@query("f25_score_labels", "ticker! date score! label", """SELECT *, CASE WHEN score >= 12 THEN 'Signal' WHEN score >= 11 THEN 'Near Signal'
  WHEN score >= 9 THEN 'Watch' ELSE 'Wait' END AS label FROM scores""")
def _(w):
    return w.panel.scores().withColumn("label", filters.score_label(F.col("score")))


# ---- exits ----------------------------------------------------------------

@query("x1_thesis_break", "ticker! published reason", "SELECT * FROM thesis")
def _(w):
    return plans.thesis_states(w.inputs)


@query("x2_max_hold", "ticker! entry_date hold_date", "SELECT * FROM hold_exit")
def _(w):
    return exits.hold_exits(w.entries, w.bars)


@query("x3_trailing_stop", "ticker! entry_date trailing_date peak_close:6", "SELECT * FROM stops")
def _(w):
    return exits.stop_exits(w.entries, w.bars)


@query("x4_chandelier_stop", "ticker! entry_date atr_date last_bar", "SELECT * FROM stops")
def _(w):
    return exits.stop_exits(w.entries, w.bars)


def resolved(w):
    ranked = ranking.top_n(w.scores, ["effective"], [F.col("score").desc(), F.col("ticker")], 10)
    return exits.resolve_exits(w.entries, w.bars, w.thesis, w.quarters, ranked)


query("q8_exit_resolution", "ticker! tier entry_date entry_price:4 exit_date exit_price:4 exit_reason", "SELECT * FROM resolved")(resolved)

query("q9_trade_table", "ticker! tier entry_date exit_date return_pct:4 pnl_dollars:2 hold_days! exit_reason", """SELECT *,
  (exit_price / entry_price - 1) * 100 AS return_pct, (exit_price / entry_price - 1) * 100000 AS pnl_dollars, exit_date - entry_date AS hold_days
  FROM resolved""")(lambda w: w.resolved_trades)


# ---- pipelines ------------------------------------------------------------

@query("q1_quality_watchlist", "effective evaluated! watchlist!", """SELECT effective, count(*) AS evaluated,
  count(*) FILTER (WHERE quality_pass) AS watchlist FROM panel GROUP BY 1""")
def _(w):
    return plans.watchlist_sizes(w.quarterly)


@query("q1_watchlist_members", "ticker! effective as_of", "SELECT * FROM panel WHERE quality_pass")
def _(w):
    return plans.watchlists(w.quarterly)


@query("q2_qvm_scores", "effective ticker! value_score:6 momentum_score:6 score:6", "SELECT * FROM scored")
def _(w):
    return ranking.qvm_scores(plans.watchlists(w.quarterly))


@query("q2_qvm_original", "effective ticker! value_score:6 momentum_score:6 score:6", "SELECT * FROM scored_orig")
def _(w):
    return ranking.qvm_scores(plans.watchlists(w.quarterly), cfg=w.inputs.variant(qvm_variant="original").cfg)


@query("q3_ranked_list", "effective ticker! score:6 rank!", "SELECT * FROM ranked")
def _(w):
    return plans.ranked_watchlist(w.inputs, w.quarterly)


@query("q4_quarterly_top", "effective ticker! rank! evaluated! watchlist!", """SELECT r.effective, r.ticker, r.rank, n.evaluated, n.watchlist
  FROM ranked r JOIN (SELECT effective, count(*) AS evaluated, count(*) FILTER (WHERE quality_pass) AS watchlist FROM panel GROUP BY 1) n USING (effective)""")
def _(w):
    return plans.ranked_watchlist(w.inputs, w.quarterly).join(plans.watchlist_sizes(w.quarterly), "effective")


@query("w9_top_per_group", "effective ticker! ebit_yield:6 rank!", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY effective
  ORDER BY ebit_yield DESC NULLS LAST, ticker) AS rank FROM panel) WHERE rank <= 20""")
def _(w):
    return ranking.top_n(w.quarterly, ["effective"], [F.col("ebit_yield").desc_nulls_last(), F.col("ticker")], 20)


@query("w10_top_capped", "effective ticker! sector rank!", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY effective ORDER BY score DESC, ticker) AS rank
  FROM (SELECT p.effective, p.ticker, u.sector, p.ebit_yield AS score, row_number() OVER (PARTITION BY p.effective, u.sector
    ORDER BY p.ebit_yield DESC, p.ticker) AS g FROM panel p JOIN univ u USING (ticker) WHERE p.ebit_yield IS NOT NULL) WHERE g <= 3) WHERE rank <= 10""")
def _(w):
    p = w.quarterly.where(F.col("ebit_yield").isNotNull()).join(w.panel.universe().select("ticker", "sector"), "ticker")
    return ranking.top_n_capped(p, ["effective"], "sector", [F.col("ebit_yield").desc(), F.col("ticker")], 10, 0.35)


@query("q4_targets_capped", "effective ticker! sector rank!", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY effective ORDER BY score DESC, ticker) AS rank
  FROM (SELECT s.*, u.sector, row_number() OVER (PARTITION BY effective, sector ORDER BY score DESC, ticker) AS g FROM scored s JOIN univ u USING (ticker))
  WHERE g <= 3) WHERE rank <= 10""")
def _(w):
    return plans.targets_capped(w.inputs, w.quarterly)


@query("q5_entry_signals", "ticker! date effective ps:6 zscore:6 momentum_rank:6", "SELECT *, as_of AS date FROM signals")
def _(w):
    return plans.entry_signals(w.inputs, plans.watchlists(w.quarterly), w.quarters)


CTE["probe_d"] = "SELECT ticker, DATE '2000-06-15' AS as_of FROM eligible"


def _scan_ctes():
    from catalog.sql import filters_cte, hist_cte, metrics_cte, timing_cte
    CTE["met_d"] = metrics_cte("probe_d")
    CTE["hist_d"] = hist_cte("met_d")
    CTE["filt_d"] = filters_cte("met_d", "hist_d")
    CTE["scan_d"] = timing_cte("filt_d")


_scan_ctes()


@query("q6_live_scan", "ticker! scan_date price:4 price_zscore:6 ps:6 roic:6 gm0:6 vix:4 all_pass", """SELECT *, as_of AS scan_date, close_row AS price,
  zscore AS price_zscore, quality_pass AND entry_pass AS all_pass FROM scan_d""")
def _(w):
    return plans.live_scan(w.inputs, F.lit("2000-06-15").cast("date"), only_passing=False)


def pairs_of_quarters(w):
    return plans.in_force(w.quarters).where("until IS NOT NULL").select(
        F.col("until").alias("effective"), F.col("effective").alias("previous"))


def ranked(w):
    return ranking.top_n(w.scores, ["effective"], [F.col("score").desc(), F.col("ticker")], 10)


@query("q7_rebalance_diff", "effective ticker! side", """SELECT coalesce(c.effective, p.effective) AS effective, coalesce(c.ticker, p.ticker) AS ticker,
  CASE WHEN p.ticker IS NULL THEN 'BUY' ELSE 'SELL' END AS side FROM ranked c
  FULL JOIN (SELECT s.until AS effective, r.ticker FROM ranked r JOIN spans s USING (effective) WHERE s.until IS NOT NULL) p
    ON c.effective = p.effective AND c.ticker = p.ticker WHERE c.ticker IS NULL OR p.ticker IS NULL""")
def _(w):
    return ranking.rebalance_diff(ranked(w), pairs_of_quarters(w))


BASKET = """SELECT r.effective, s.until, avg(b.close / a.close - 1) AS basket_ret, count(*) AS names,
    any_value(m1.close) / any_value(m0.close) - 1 AS bench_ret
  FROM ranked r JOIN (SELECT * FROM spans WHERE until IS NOT NULL) s ON r.effective = s.effective
  ASOF LEFT JOIN bars a ON r.ticker = a.ticker AND r.effective >= a.date
  ASOF LEFT JOIN bars b ON r.ticker = b.ticker AND s.until >= b.date
  JOIN bench m0 ON m0.date = r.effective JOIN bench m1 ON m1.date = s.until GROUP BY 1, 2"""


@query("q10_basket_returns", "effective until basket_ret:6 bench_ret:6 names! basket_growth:6 bench_growth:6",
       f"""SELECT *, product(1 + basket_ret) OVER (ORDER BY effective) AS basket_growth, product(1 + bench_ret) OVER (ORDER BY effective) AS bench_growth FROM ({BASKET})""")
def _(w):
    return plans.basket_returns(w.inputs, ranked(w), w.quarters)


@query("a8_funnel", "effective evaluated! watchlist! entries!", """SELECT effective, sum(evaluated) AS evaluated, sum(watchlist) AS watchlist, coalesce(sum(entries), 0) AS entries
  FROM (SELECT effective, count(*) AS evaluated, count(*) FILTER (WHERE quality_pass) AS watchlist FROM panel GROUP BY 1)
  LEFT JOIN (SELECT effective, count(*) AS entries FROM signals GROUP BY 1) USING (effective) GROUP BY ROLLUP (effective)""")
def _(w):
    return plans.funnel(w.quarterly, w.signals)


@query("a17_signal_counts", "ticker! n!", "SELECT ticker, count(*) AS n FROM signals GROUP BY 1")
def _(w):
    return w.signals.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("q17_change_detection", "ticker! change score! prev_score!", f"""SELECT * FROM (SELECT ticker, c.score, p.prev_score,
  CASE WHEN c.score >= 11 AND p.prev_score IS NULL THEN 'NEW' WHEN c.score >= 11 AND c.score <> p.prev_score THEN 'CHANGED'
    WHEN p.prev_score IS NOT NULL AND (c.score IS NULL OR c.score < 11) THEN 'REMOVED' END AS change
  FROM (SELECT ticker, score FROM scores WHERE date = {scan_day(1)}) c FULL JOIN
  (SELECT ticker, score AS prev_score FROM scores WHERE date = {scan_day(2)} AND score >= 11) p USING (ticker)) WHERE change IS NOT NULL""")
def _(w):
    from catalog.panel_queries import last_scans
    now, before = last_scans(w)
    return snapshots.detect_changes(now, snapshots.next_state(before))


@query("q18_board", "ticker! price:4 off_high:4 vs_ema50:4 quick_f8 quick_f9 quick_f12 score! label tier!", f"""SELECT *,
  CASE WHEN coalesce(score, 0) >= 11 THEN 0 WHEN coalesce(score, 0) >= 9 THEN 1 ELSE 2 END AS tier,
  CASE WHEN score IS NULL THEN 'Scan needed' WHEN score >= 12 THEN 'Signal' WHEN score >= 11 THEN 'Near Signal' WHEN score >= 9 THEN 'Watch' ELSE 'Wait' END AS label
  FROM quick q LEFT JOIN (SELECT ticker, score FROM scores WHERE date = {scan_day(1)}) s USING (ticker)""")
def _(w):
    from catalog.panel_queries import last_scans
    b = plans.board(prices.live_snapshot(w.bars), last_scans(w, 1)[0], last_fear(w))
    return b.withColumn("tier", ranking.board_order()[0])


@query("w8_board_order", "ticker! date score! tier!", """SELECT *, CASE WHEN score >= 11 THEN 0 WHEN score >= 9 THEN 1 ELSE 2 END AS tier FROM scores""")
def _(w):
    return w.panel.scores().withColumn("tier", ranking.board_order()[0]).orderBy(*ranking.board_order())


@query("q19_research_report", "ticker! as_of groups_passed! failing conviction action trigger_vix:2 trigger_high:4 trigger_zscore:4 trigger_ema:4 "
       "ps:6 ps_rank! roic:6 gm0:6 insider_buys! insider_value:0", f"""SELECT t.*, t.n AS groups_passed, i.n AS insider_buys, i.total AS insider_value
  FROM ({TRIGGERS}) t LEFT JOIN (SELECT o_custkey AS ticker, count(*) AS n, sum(floor(o_totalprice)) AS total FROM orders
    WHERE o_orderstatus = 'P' AND CAST(o_orderdate AS DATE) >= DATE '2001-08-01' - 90 GROUP BY 1) i USING (ticker)""")
def _(w):
    from catalog.panel_queries import filings
    r = plans.research_report(w.inputs, plans.latest_days(w.inputs), filings(w))
    return r.withColumn("failing", F.concat_ws(",", "failing")).withColumnRenamed("date", "as_of")


@query("q20_scenario_targets", "scenario effective ticker! score:6 rank!", """SELECT 'composite' AS scenario, * FROM ranked
  UNION ALL SELECT 'original', * FROM ranked_orig""")
def _(w):
    return plans.scenario_targets(w.inputs, w.quarterly, ["composite", "original"])


@query("j13_scenario_grid", "scenario cap:2 effective names! best:6", """SELECT s.scenario, s.cap, effective, count(*) AS names, max(score) AS best FROM scored
  CROSS JOIN (VALUES ('loose', 0.35), ('tight', 0.6), ('all', 0.0)) AS s(scenario, cap) WHERE score >= s.cap GROUP BY 1, 2, 3""")
def _(w):
    grid = [{"scenario": "loose", "cap": 0.35}, {"scenario": "tight", "cap": 0.6}, {"scenario": "all", "cap": 0.0}]
    s = plans.with_scenarios(w.scores, grid).where(F.col("score") >= F.col("cap"))
    return s.groupBy("scenario", "cap", "effective").agg(F.count(F.lit(1)).alias("names"), F.max("score").alias("best"))
