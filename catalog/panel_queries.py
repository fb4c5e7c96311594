"""Sources, universe, price features and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import query
from catalog.sql import ema, scan_day
from tidemark.functions.columns import effective_tax, parse_money, quarter_end, quarter_label, total_debt
from tidemark.operators import asof, prices, ranking, snapshots
from tidemark.operators.asof import Stream
from tidemark.operators.ranks import pct_rank_avg
from tidemark.plans import pipelines as plans
from tidemark.sources import files, sinks
from tidemark.sources.sinks import stage

OHLCV = "open:6 high:6 low:6 close:6 volume:2"


# ---- sources --------------------------------------------------------------

@query("s1_clean_bars", f"ticker! date {OHLCV}",
       "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS c FROM bars) WHERE c >= 530")
def _(w):
    return files.clean_bars(w.bars, 530)


@query("s2_coverage", "ticker! first last n! covered", """SELECT ticker, min(date) AS first, max(date) AS last, count(*) AS n,
  count(*) > 50 AND min(date) <= DATE '1995-01-05' AND max(date) >= DATE '2001-10-28' AS covered FROM bars GROUP BY 1""")
def _(w):
    return prices.coverage_gate(w.bars, "1994-12-26", "2001-11-07")


@query("s3_record_statements", "ticker! freq statement period_end item value:6", """SELECT ticker, freq, 'income' AS statement, period_end, u.item,
  u.value FROM stmt, LATERAL (VALUES ('Total Revenue', revenue), ('Gross Profit', gross), ('Operating Income', ebit),
  ('Net Income', net), ('Tax Rate For Calcs', CASE WHEN abs(ebit) > 1e-6 THEN greatest(0, least(net / ebit, 0.6::DOUBLE)) ELSE 0.21 END))
  AS u(item, value)""")
def _(w):
    q = w.panel.statements_wide()
    # Two records per period: the outdated first one must lose.
    rec = q.select("ticker", "freq", F.posexplode(F.array(F.lit(2.0), F.lit(1.0))).alias("pos", "k"), "period_end",
                   "Total Revenue", "Gross Profit", "Operating Income", "Net Income")
    js = rec.select("ticker", "freq", "pos", F.to_json(F.struct(
        F.date_format("period_end", "yyyy-MM-dd").alias("date"), (F.col("Total Revenue") * F.col("k")).alias("revenue"),
        (F.col("Gross Profit") * F.col("k")).alias("grossProfit"), (F.col("Operating Income") * F.col("k")).alias("operatingIncome"),
        (F.col("Net Income") * F.col("k")).alias("netIncome"), F.col("Net Income").alias("incomeTaxExpense"),
        F.col("Operating Income").alias("incomeBeforeTax"))).alias("j"))
    schema = ("date string, revenue double, grossProfit double, operatingIncome double, netIncome double, "
              "incomeTaxExpense double, incomeBeforeTax double")
    rows = js.select("ticker", "freq", "pos", F.from_json("j", schema).alias("r")).select("ticker", "freq", "pos", "r.*")
    both = [files.records_to_long(rows.where(F.col("freq") == f).drop("freq"), "income", f) for f in ("quarterly", "annual")]
    return both[0].unionByName(both[1])


@query("s3_rejects", "ticker! level reason n!", """SELECT NULL AS ticker, 'line' AS level, 'no JSON' AS reason, count(*) AS n
  FROM (SELECT DISTINCT ticker, freq FROM stmt JOIN supplier ON s_suppkey = ticker WHERE s_acctbal < 0) HAVING count(*) > 0
  UNION ALL SELECT ticker, 'record', 'no date', 2 * count(*) FROM good WHERE net < 0 GROUP BY 1
  UNION ALL SELECT ticker, 'record', 'superseded', count(*) FROM good WHERE net >= 0 GROUP BY 1
  UNION ALL SELECT ticker, 'record', 'used', count(*) FROM good WHERE net >= 0 GROUP BY 1
  UNION ALL SELECT ticker, 'item', 'no number: revenue', count(*) FROM good WHERE net >= 0 AND gross < revenue * 0.4::DOUBLE GROUP BY 1""")
def _(w):
    # Responses as a provider may send them: lines cut short, records without a day, amounts that are no numbers, outdated records first.
    s = w.panel.statements_wide().select("ticker", "freq", "period_end", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "Total Revenue", "Gross Profit", "Net Income")
    record = F.to_json(F.struct(
        F.when(F.col("Net Income") < 0, "n/a").otherwise(F.date_format("period_end", "yyyy-MM-dd")).alias("date"), F.col("Net Income").alias("netIncome"),
        F.when(F.col("Gross Profit") < F.col("Total Revenue") * 0.4, "n/m").otherwise(F.col("Total Revenue").cast("string")).alias("revenue")))
    # A ticker has a few dozen periods: one response per ticker and frequency, as delivered.
    sent = s.groupBy("ticker", "freq").agg(F.array_sort(F.collect_list(F.struct("period_end", "k", record.alias("r")))).alias("rs"))
    line = F.concat(F.lit('{"ticker": "'), F.col("ticker").cast("string"), F.lit('", "records": ['), F.array_join(F.transform("rs", lambda x: x["r"]), ", "), F.lit("]}"))
    short = w.panel.table("supplier").select(F.col("s_suppkey").alias("ticker"), (F.col("s_acctbal") < 0).alias("short"))
    lines = sent.join(short, "ticker").select("freq", F.when(F.col("short"), F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line).alias("value"))
    both = [files.checked_records(lines.where(F.col("freq") == f).select("value")) for f in ("quarterly", "annual")]  # as in a file of each
    checked = both[0].unionByName(both[1])
    used = checked.where((F.col("level") == "record") & F.col("reason").isNull()).select("level", "ticker", F.lit("used").alias("reason"))
    return files.rejects(checked).select("level", "ticker", "reason").unionByName(used).groupBy("ticker", "level", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("s4_compact_statements", "ticker! freq statement period_end item value:6", """SELECT ticker, freq, 'balance' AS statement, period_end,
  u.item, u.value FROM stmt, LATERAL (VALUES ('Total Assets', assets), ('Total Debt', debt + curl)) AS u(item, value)""")
def _(w):
    names = ["Fiscal Period", "Report Date", "Total Assets", "Long Term Debt", "Short Term Debt"]
    s = w.panel.statements_wide()
    period = F.when(F.col("freq") == "annual", "FY").otherwise(F.concat(F.lit("Q"), F.quarter("period_end")))
    row = F.array(period, F.date_format("period_end", "yyyy-MM-dd"),
                  *[F.col(c).cast("string") for c in ("Total Assets", "Total Debt", "Current Liabilities")])
    # A ticker has a few dozen periods: one response per ticker, as delivered.
    resp = s.groupBy("ticker").agg(F.collect_list(row).alias("data")).withColumn(
        "columns", F.array(*[F.lit(n) for n in names]))
    return files.compact_to_long(resp, "balance", {"Total Assets": "Total Assets"})


@query("s5_wide_statements", "ticker! freq statement period_end item value:6", """SELECT t.ticker, p.freq, u.statement, p.period_end, u.item, u.value
  FROM (SELECT DISTINCT ticker, freq FROM stmt) t JOIN (SELECT DISTINCT freq, period_end FROM stmt) p ON t.freq = p.freq
  LEFT JOIN stmt s ON s.ticker = t.ticker AND s.period_end = p.period_end AND s.freq = p.freq,
  LATERAL (VALUES ('income', 'Total Revenue', revenue), ('income', 'Gross Profit', gross), ('income', 'Operating Income', ebit), ('income', 'Net Income', net),
    ('cashflow', 'Operating Cash Flow', ocf), ('cashflow', 'Capital Expenditure', capex), ('balance', 'Total Debt', debt),
    ('balance', 'Stockholders Equity', equity), ('balance', 'Total Assets', assets), ('balance', 'Current Liabilities', curl),
    ('balance', 'Cash And Cash Equivalents', cash)) AS u(statement, item, value)""")
def _(w):
    long = stage(w.inputs.fundamentals.where("item <> 'Tax Rate For Calcs'"), "fundamentals")
    # One column per period end that occurs: as many as quarters in the calendar.
    ends = {f: [] for f in ("quarterly", "annual")}
    for r in long.select("freq", "period_end").distinct().orderBy("period_end").collect():
        ends[r.freq].append(str(r.period_end))
    out = []
    for freq, days in ends.items():
        for kind in ("income", "balance", "cashflow"):
            rows = long.where((F.col("freq") == freq) & (F.col("statement") == kind))
            wide = rows.groupBy("ticker", "item").pivot("period_end", days).agg(F.first("value"))
            out.append(files.wide_to_long(wide, ["ticker"], kind, freq))
    return reduce(DataFrame.unionByName, out)


@query("s6_provider_precedence", "ticker! freq provider period_end revenue:6", """SELECT ticker, freq,
  CASE WHEN s_acctbal > 5000 THEN 'A' WHEN s_acctbal > 0 THEN 'B' ELSE 'C' END AS provider, period_end, revenue
  FROM stmt JOIN supplier ON s_suppkey = ticker""")
def _(w):
    s = w.panel.statements_wide().select("ticker", "freq", "period_end", F.col("Total Revenue").alias("revenue"))
    bal = w.panel.table("supplier").select(F.col("s_suppkey").alias("ticker"), "s_acctbal")
    a, b = (s.join(bal.where(F.col("s_acctbal") > x), "ticker", "left_semi") for x in (5000, 0))
    return ranking.prefer([f.withColumn("provider", F.lit(n)) for f, n in ((a, "A"), (b, "B"), (s, "C"))], "ticker")


@query("s7_derived_items", "ticker! freq period_end tax:6 debt:6", """SELECT ticker, freq, period_end,
  CASE WHEN abs(ebit) > 1e-6 AND tax_rate IS NOT NULL THEN greatest(0, least(net / ebit, 0.6::DOUBLE)) ELSE 0.21 END AS tax,
  debt + coalesce(CASE WHEN cash > 0 THEN curl END, 0) AS debt FROM stmt""")
def _(w):
    s, c = w.panel.statements_wide(), F.col
    tax = effective_tax(F.when(c("Tax Rate For Calcs").isNotNull(), -c("Net Income")), c("Operating Income"), sign=-1)
    short = F.when(c("Cash And Cash Equivalents") > 0, c("Current Liabilities"))
    return s.select("ticker", "freq", "period_end", tax.alias("tax"), total_debt(c("Total Debt"), short).alias("debt"))


@query("s8_constituents", "ticker sector", """SELECT 'N' || s_nationkey || '-' || s_suppkey AS ticker, n_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(w):
    s, n = w.panel.table("supplier"), w.panel.table("nation")
    page = s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.concat(F.lit(" n"), "s_nationkey", F.lit("."), "s_suppkey").alias("Symbol"), F.col("n_name").alias("GICS Sector"))
    return files.constituents(page)


@query("s9_watchlist_lines", "ticker", """SELECT DISTINCT upper(trim(p_name)) AS ticker FROM part WHERE p_size >= 10""")
def _(w):
    line = (F.when(F.col("p_size") < 5, F.concat(F.lit(" # "), "p_name")).when(F.col("p_size") < 10, "  ")
            .otherwise(F.concat(F.lit("  "), "p_name", F.lit(" "))))
    return files.tickers_from_lines(w.panel.table("part").select(line.alias("value")))


@query("s10_trade_log_read", "ticker tier entry_date exit_date return_dec:8 return_pct:6 hold_days! exit_reason",
       """SELECT CAST(ticker AS VARCHAR) AS ticker, tier, entry_date, CASE WHEN tier = 'qvm' THEN exit_date END AS exit_date,
  return_dec, return_pct, hold_days, exit_reason FROM trades""")
def _(w):
    raw = w.trades.select(
        F.col("ticker").cast("string").alias("ticker"), "tier", F.col("entry_date").cast("string").alias("entry_date"),
        F.when(F.col("tier") == "qvm", F.col("exit_date").cast("string")).otherwise("n/a").alias("exit_date"),
        (F.col("return_pct") * 100).cast("string").alias("Return %"),
        F.col("hold_days").cast("string").alias("Hold Days"), "exit_reason")
    log = files.normalise_trades(raw)
    # The raw log is in hundredths of a percent, so its mean exceeds 1.
    return log.select("ticker", "tier", "entry_date", "exit_date", (F.col("return_dec") / 100).alias("return_dec"),
                      (F.col("return_pct") / 100).alias("return_pct"), "hold_days", "exit_reason")


@query("s11_trade_log_write", "ticker! tier mode entry_date entry_price:4 exit_date exit_price:4 return_pct:2 pnl_dollars:2 hold_days! exit_reason",
       "SELECT *, 'all' AS mode FROM trades")
def _(w):
    path = sinks.new_path(w.spark, "trade-log")
    sinks.write_trade_log(w.trades, path, "all", "parquet")
    return w.spark.read.parquet(path)


@query("s13_state_versions", "ticker! score!", f"""SELECT ticker, max(score) AS score FROM scores WHERE date = {scan_day(1)} GROUP BY 1""")
def _(w):
    root = sinks.new_path(w.spark, "state")
    for v, scan in enumerate(reversed(last_scans(w)), 1):
        sinks.write_state(scan, root, v)
    return sinks.read_state(w.spark, root)


@query("s14_scan_history", "ticker! scan_date score! alert", """SELECT ticker, date AS scan_date, score, score >= 11 AS alert FROM scores""")
def _(w):
    path = sinks.new_path(w.spark, "history")
    s = w.panel.scores().select("ticker", F.col("date").alias("scan_date"), "score")
    for half in (F.col("scan_date") < "2024-01-16", F.col("scan_date") >= "2024-01-16"):
        sinks.append_scan(s.where(half), path)
    return w.spark.read.parquet(path)


FILINGS = """SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS trade_date, o_orderpriority AS name,
  floor(o_totalprice) AS amount FROM orders WHERE o_orderstatus = 'P' AND CAST(o_orderdate AS DATE) >= DATE '2001-08-01' - 90"""


def filings(w):
    o = w.panel.table("orders")
    page = o.select(
        F.col("o_custkey").alias("ticker"), F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit(" 16:30")).alias("Trade\xa0Date"),
        F.col("o_orderpriority").alias("Insider\xa0Name"),
        F.when(F.col("o_orderstatus") == "P", "P - Purchase").otherwise("S - Sale").alias("Trade\xa0Type"),
        F.concat(F.lit("+$"), F.format_string("%,d", F.floor("o_totalprice"))).alias("Value"))
    return files.insider_purchases(files.insider_columns(page), F.lit("2001-08-01").cast("date"))


@query("s15_insider_newest", "ticker! trade_date name amount:0 rn!", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker
  ORDER BY trade_date DESC, amount DESC, name) AS rn FROM ({FILINGS})) WHERE rn <= 5""")
def _(w):
    return files.newest_purchases(filings(w))


@query("a20_insider_totals", "ticker! n! total:0", f"SELECT ticker, count(*) AS n, sum(amount) AS total FROM ({FILINGS}) GROUP BY 1")
def _(w):
    return snapshots.insider_summary(filings(w))


@query("s16_report_scores", "ticker! score! total! conviction", """SELECT ticker, coalesce(score, 0) AS score, coalesce(total, 12) AS total,
  coalesce(word, CASE WHEN coalesce(score, 0) >= 11 THEN 'HIGH' WHEN coalesce(score, 0) >= 9 THEN 'MEDIUM' ELSE 'DO NOT ENTER' END) AS conviction
  FROM (SELECT user_id AS ticker,
    arg_max(k % 13, event_id) FILTER (WHERE event_type IN ('click', 'view', 'purchase')) AS score,
    CAST(arg_max(CASE event_type WHEN 'purchase' THEN 13 ELSE 12 END, event_id)
      FILTER (WHERE event_type IN ('click', 'view', 'purchase')) AS BIGINT) AS total,
    arg_max(CASE event_type WHEN 'error' THEN 'DO NOT ENTER' ELSE 'MEDIUM' END, event_id)
      FILTER (WHERE event_type = 'error' AND k < 5 OR event_type NOT IN ('click', 'view', 'purchase', 'error') AND k < 10) AS word
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) GROUP BY 1)""")
def _(w):
    e = w.panel.table("events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"))
    n = (F.col("k") % 13).cast("string")
    kind = F.col("event_type")
    line = (F.when(kind == "click", F.concat(F.lit("  RESULT: passes "), n, F.lit(" of 12 checks")))
            .when(kind == "view", F.concat(n, F.lit(" /12 Filters pass")))
            .when(kind == "purchase", F.concat(F.lit("Score: "), n, F.lit("/13")))
            .when(kind == "error", F.when(F.col("k") < 5, "verdict: Do not enter").otherwise("nothing here"))
            .otherwise(F.when(F.col("k") < 10, "medium conviction").otherwise("high")))
    return files.parse_reports(e.select(F.col("user_id").alias("ticker"), F.col("event_id").alias("line_no"), line.alias("value")))


SIDE = """SELECT d AS date, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) / count(*) * 100 AS sentiment,
  CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') / count(*) > 0.5 THEN 'RED' ELSE 'GREEN' END AS regime
  FROM li GROUP BY 1 HAVING count(*) >= 10"""


@query("s17_side_inputs", "date sentiment:4 regime allowed fear_count! f8_fear_regime", f"""SELECT date, sentiment, regime, allowed, fear_count,
  fear_count >= 2 AND allowed AS f8_fear_regime FROM (
  SELECT m.date, CASE WHEN abs(m.date - DATE '1999-06-30') <= 3 THEN s.sentiment END AS sentiment, s.regime,
    coalesce(s.regime, 'GREEN') <> 'RED' AS allowed,
    m.fear_count + coalesce(CAST(abs(m.date - DATE '1999-06-30') <= 3 AND s.sentiment < 35 AS BIGINT), 0) AS fear_count
  FROM market m LEFT JOIN ({SIDE}) s USING (date))""")
def _(w):
    i = w.inputs
    state = plans.filters.market_state(i.days, prices.benchmark_features(i.benchmark), i.vix,
                                       w.panel.side_inputs(), "1999-06-30")
    return state.withColumn("allowed", files.regime_allows(F.col("regime")))


# ---- universe and calendar ------------------------------------------------

def two_lists(w):
    u = w.panel.universe().select("ticker", "sector")
    acct = w.panel.table("supplier").select(F.col("s_suppkey").alias("ticker"), "s_acctbal")
    large = u.join(acct.where("s_acctbal > 5000"), "ticker", "left_semi")
    mid = u.join(acct.where("s_acctbal > 0"), "ticker", "left_semi").withColumn("sector", F.lit("OTHER"))
    return large, mid


LARGE = "SELECT ticker, sector FROM univ JOIN supplier ON s_suppkey = ticker WHERE s_acctbal > 5000"
MID = "SELECT ticker, 'OTHER' AS sector FROM univ JOIN supplier ON s_suppkey = ticker WHERE s_acctbal > 0"


@query("u1_scope_union", "ticker! sector", f"{LARGE} UNION ALL SELECT * FROM ({MID}) WHERE ticker NOT IN (SELECT ticker FROM ({LARGE}))")
def _(w):
    return ranking.union_priority(*two_lists(w), "ticker")


@query("u2_sector_of", "ticker! sector n!", f"""SELECT b.ticker, coalesce(l.sector, 'Unknown') AS sector, b.n FROM
  (SELECT ticker, count(*) AS n FROM bars GROUP BY 1) b LEFT JOIN ({LARGE}) l USING (ticker)""")
def _(w):
    n = w.bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return n.join(two_lists(w)[0], "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


@query("u3_eligible", "ticker!", "SELECT ticker FROM eligible")
def _(w):
    return plans.eligible(w.inputs)


@query("u4_sample", "ticker!", "SELECT ticker FROM univ ORDER BY md5(ticker || '-42'), ticker LIMIT 50")
def _(w):
    return ranking.sample_keys(w.panel.universe(), "ticker", 50, 42)


@query("u5_trading_days", "date", "SELECT DISTINCT date FROM bench WHERE date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'")
def _(w):
    return plans.trading_days(w.panel.calendar(), "1997-01-01", "2000-12-31")


@query("u6_quarter_grid", "effective quarter_end eval_date", "SELECT * FROM quarters")
def _(w):
    return plans.quarter_grid(w.inputs.days)


@query("u7_reindex_ffill", "scenario date value:6", """SELECT t.scenario, b.date, s.value FROM (SELECT 'even' AS scenario UNION ALL SELECT 'odd') t
  CROSS JOIN bench b ASOF LEFT JOIN (SELECT CASE WHEN flag = 'A' THEN 'even' ELSE 'odd' END AS scenario, date, max(close) AS value
    FROM bars GROUP BY 1, 2) s
  ON s.scenario = t.scenario AND b.date >= s.date""")
def _(w):
    s = (w.bars.groupBy(F.when(F.col("flag") == "A", "even").otherwise("odd").alias("scenario"), "date")
         .agg(F.max("close").alias("value")))
    return asof.align_to_calendar(s, w.inputs.days, "scenario", "value")


@query("u8_next_rebalance", "date next label", """SELECT date, last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH) AS next,
  'Q' || quarter(date) || ' ' || year(date) AS label FROM bench""")
def _(w):
    return w.inputs.days.select("date", quarter_end("date").alias("next"), quarter_label("date").alias("label"))


# ---- price features -------------------------------------------------------

@query("p0_history_gate", "ticker! date close:6", "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS c FROM bars) WHERE c >= 525")
def _(w):
    return prices.history_gate(w.bars, 525)


@query("p1_ema", "ticker! date ema_50:6 ema_200:6", "SELECT * FROM feat")
def _(w):
    return w.inputs.features


@query("p1b_ema_adjusted", "ticker! date ema:6", f"""SELECT ticker, date, sum(close * pow({1 - 2 / 51!r}::DOUBLE, -n)) OVER t
  / sum(pow({1 - 2 / 51!r}::DOUBLE, -n)) OVER t AS ema FROM gated WINDOW t AS (PARTITION BY ticker ORDER BY date)""")
def _(w):
    return prices.with_ema(w.bars, "close", {"ema": 50}, adjust=True)


for _name, _shape in (("p2_year_high", "high_52w:6"), ("p3_zscore", "zscore:6"), ("p4_momentum_12_1", "ret_12_1:6"),
                      ("p5_return_6m", "ret_6m:6"), ("p_all_features", "close:6 ema_50:6 ema_200:6 high_52w:6 zscore:6 ret_12_1:6 ret_6m:6")):
    query(_name, f"ticker! date {_shape}", "SELECT * FROM feat")(
        lambda w: prices.price_features(w.bars))


@query("p6_benchmark", "date close:6 ema_200:6 high_rolling:6 below_trend:6 drawdown:6", "SELECT * FROM benchf")
def _(w):
    return prices.benchmark_features(w.panel.benchmark())


@query("p7_atr", "ticker! date atr:6", "SELECT * FROM atr")
def _(w):
    return prices.with_atr(w.bars)


@query("p8_peak_since_entry", "ticker! entry_date date close:6 peak:6", "SELECT * FROM since")
def _(w):
    from tidemark.operators.exits import since_entry
    return since_entry(w.entries, prices.with_atr(w.bars))


@query("p9_live_snapshot", "ticker! date price:4 high_52w:4 ema50:4 off_high:4 vs_ema50:4 mom_6m:4 pe_ratio:4 ps_ratio:4",
       "SELECT * FROM snap LEFT JOIN company USING (ticker)")
def _(w):
    return prices.live_snapshot(w.bars, w.panel.company().select("ticker", "pe_ratio", "ps_ratio"))


@query("p13_sector_momentum", "ticker! date sector momentum_rank:6", "SELECT * FROM momentum")
def _(w):
    return prices.sector_momentum(w.inputs.features, w.panel.universe())


# ---- joins ----------------------------------------------------------------

def month_probe(w):
    m = w.inputs.days.select(F.last_day("date").alias("on_day")).distinct()
    return plans.ticker_dates(w.panel.universe().select("ticker"), m, "on_day")


MONTHS = "SELECT ticker, on_day FROM univ, (SELECT DISTINCT last_day(date) AS on_day FROM bench)"


@query("j1_asof_column", "ticker! on_day close:6 ret_6m:6", f"""SELECT p.ticker, p.on_day, f.close, r.ret_6m FROM ({MONTHS}) p
  ASOF LEFT JOIN feat f ON p.ticker = f.ticker AND p.on_day >= f.date
  ASOF LEFT JOIN (SELECT * FROM feat WHERE ret_6m IS NOT NULL) r ON p.ticker = r.ticker AND p.on_day >= r.date""")
def _(w):
    return asof.asof_backward(month_probe(w), "ticker", "on_day", [Stream(w.inputs.features, "date", ["close", "ret_6m"])])


@query("j1_asof_ticks", "event_id! event_type ts then_id! then_value:6", """SELECT e.event_id, e.event_type, e.ts, p.event_id AS then_id, p.value AS then_value
  FROM events e ASOF LEFT JOIN events p ON e.event_type = p.event_type AND e.ts - INTERVAL 1 HOUR >= p.ts""")
def _(w):
    # Each tick against its kind an hour before. A kind is a fifth of all ticks, at every size: keys without a bound.
    e = stage(w.panel.table("events").select("event_id", "event_type", "ts", "value"), "ticks")
    probe = e.select("event_id", "event_type", "ts", (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("then"))
    series = e.select("event_type", F.col("ts").alias("at"), F.struct(F.col("event_id").alias("id"), "value").alias("tick"))
    seen = asof.asof_segmented(probe, "event_type", "then", [Stream(series, "at", ["tick"])])
    return seen.select("event_id", "event_type", "ts", F.col("tick.id").alias("then_id"), F.col("tick.value").alias("then_value"))


@query("j2_asof_row", "ticker! on_day ema_50:6 zscore:6 ret_12_1:6", f"""SELECT p.ticker, p.on_day, f.ema_50, f.zscore, f.ret_12_1 FROM ({MONTHS}) p
  ASOF LEFT JOIN featrow f ON p.ticker = f.ticker AND p.on_day >= f.date""")
def _(w):
    return asof.asof_backward_row(month_probe(w), w.inputs.features, "ticker", "on_day", ["ema_50", "zscore", "ret_12_1", "ret_6m"])


@query("j3_asof_forward", "ticker! on_day open:6", f"""SELECT p.ticker, p.on_day, b.open FROM ({MONTHS}) p
  ASOF LEFT JOIN bars b ON p.ticker = b.ticker AND p.on_day < b.date""")
def _(w):
    return asof.asof_forward(month_probe(w), w.bars, "ticker", "on_day", "open")


@query("j3_asof_ticks", "event_id! event_type ts next_id! next_value:6", """SELECT e.event_id, e.event_type, e.ts, n.event_id AS next_id, n.value AS next_value
  FROM events e ASOF LEFT JOIN events n ON e.event_type = n.event_type AND e.ts < n.ts""")
def _(w):
    e = stage(w.panel.table("events").select("event_id", "event_type", "ts", "value"), "ticks")
    series = e.select("event_type", F.col("ts").alias("at"), F.struct(F.col("event_id").alias("id"), "value").alias("tick"))
    seen = asof.asof_segmented(e.select("event_id", "event_type", "ts"), "event_type", "ts", [Stream(series, "at", ["tick"])], forward=True)
    return seen.select("event_id", "event_type", "ts", F.col("tick.id").alias("next_id"), F.col("tick.value").alias("next_value"))


@query("j4_available_periods", "ticker! as_of freq period_end revenue:6", """SELECT p.ticker, p.as_of, s.freq, s.period_end, s.revenue
  FROM probe_q p JOIN stmt s ON p.ticker = s.ticker AND s.period_end + 45 <= p.as_of AND s.period_end + 45 >= p.as_of - 365""")
def _(w):
    grid = plans.ticker_dates(plans.eligible(w.inputs), w.quarters, "eval_date").select("ticker", F.col("eval_date").alias("as_of"))
    p = w.inputs.periods.where("statement = 'income'").select("ticker", "freq", "period_end", "revenue")
    return asof.available_periods(grid, p, "ticker", "as_of", "period_end", 45, 365)


@query("j5_bars_since_entry", "ticker! entry_date bars! high_close:6 volume:2", """SELECT e.ticker, e.entry_date, count(*) AS bars,
  max(b.close) AS high_close, sum(b.volume) AS volume FROM pairs e JOIN bars b ON e.ticker = b.ticker AND b.date >= e.entry_date
  AND b.date <= e.entry_date + 180 GROUP BY 1, 2""")
def _(w):
    e = w.entries.select("ticker", "entry_date").distinct()
    r = asof.bars_since_entry(e, w.bars, "ticker", "entry_date", F.date_add("entry_date", 180), ["close", "volume"])
    return r.groupBy("ticker", "entry_date").agg(
        F.count(F.lit(1)).alias("bars"), F.max("close").alias("high_close"), F.sum("volume").alias("volume"))


@query("j6_features_and_statements", "ticker! rows! periods!", """SELECT ticker, rows, periods FROM
  (SELECT ticker, count(*) AS rows FROM feat GROUP BY 1) JOIN (SELECT ticker, count(*) AS periods FROM stmt GROUP BY 1) USING (ticker)""")
def _(w):
    f = w.inputs.features.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))
    s = w.panel.statements_wide().groupBy("ticker").agg(F.count(F.lit(1)).alias("periods"))
    return f.join(s, "ticker")


@query("j7_with_sector", "ticker! date close:6 sector", "SELECT b.ticker, b.date, b.close, u.sector FROM bars b LEFT JOIN univ u USING (ticker)")
def _(w):
    # No hint: Spark broadcasts the dimension only while its size allows.
    return w.bars.select("ticker", "date", "close").join(w.panel.universe().select("ticker", "sector"), "ticker", "left")


@query("j8_market_state", "ticker! date fear_count! vix:4", "SELECT b.ticker, b.date, m.fear_count, m.vix FROM bars b JOIN market m USING (date)")
def _(w):
    return w.bars.select("ticker", "date").join(w.inputs.market.select("date", "fear_count", "vix"), "date")


@query("j9_semi_anti", "ticker! date side", """SELECT b.ticker, b.date, 'listed' AS side FROM bars b WHERE ticker IN (SELECT ticker FROM panel WHERE quality_pass)
  UNION ALL SELECT b.ticker, b.date, 'held out' FROM bars b WHERE ticker NOT IN (SELECT ticker FROM panel WHERE quality_pass)""")
def _(w):
    b, wl = w.bars.select("ticker", "date"), plans.watchlists(w.quarterly).select("ticker").distinct()
    return (b.join(wl, "ticker", "left_semi").withColumn("side", F.lit("listed"))
            .unionByName(b.join(wl, "ticker", "left_anti").withColumn("side", F.lit("held out"))))


def last_scans(w, n: int = 2) -> list[DataFrame]:
    """The last ``n`` scans of the data, newest first."""
    s = w.panel.scores()
    days = [r.date for r in s.select("date").distinct().orderBy(F.desc("date")).limit(n).collect()]
    days += [None] * (n - len(days))
    return [s.where(F.col("date") == F.lit(d)).select("ticker", "score") for d in days]


@query("j10_snapshot_join", "ticker! score! prev_score!", f"""SELECT ticker, c.score, p.prev_score FROM
  (SELECT ticker, score FROM scores WHERE date = {scan_day(1)}) c FULL JOIN
  (SELECT ticker, score AS prev_score FROM scores WHERE date = {scan_day(2)}) p USING (ticker)""")
def _(w):
    return snapshots.snapshot_join(*last_scans(w))


@query("j14_mark_to_market", "ticker! shares:2 entry_price:4 price:4 cost:2 value:2 pnl:2 pnl_pct:4 stop_price:4",
       """SELECT *, CASE WHEN ok THEN entry_price * shares END AS cost, CASE WHEN ok THEN price * shares END AS value,
  CASE WHEN ok THEN price * shares - entry_price * shares END AS pnl, CASE WHEN ok THEN (price / entry_price - 1) * 100 END AS pnl_pct,
  CASE WHEN ok THEN entry_price * (1 - coalesce(stop_pct, 15) / 100) END AS stop_price
  FROM (SELECT x.*, s.price, entry_price > 0 AND shares > 0 AS ok FROM positions x JOIN snap s USING (ticker))""")
def _(w):
    return snapshots.mark_to_market(positions(w), prices.live_snapshot(w.bars))


def positions(w):
    first = w.bars.groupBy("ticker").agg(F.min_by("open", "date").alias("entry_price"), F.max("volume").alias("v"))
    return first.select("ticker", F.when(F.col("v") > 100, F.col("v")).otherwise(0.0).alias("shares"), "entry_price",
                        F.when(F.col("v") > 120, 20.0).alias("stop_pct"), (F.col("v") / 20).alias("weight"))


@query("x5_static_stop", "ticker! entry_price:4 stop:4", "SELECT *, entry_price * (1 - coalesce(stop_pct, 15.0) / 100) AS stop FROM positions")
def _(w):
    from tidemark.operators.exits import static_stop
    return positions(w).withColumn("stop", static_stop(F.col("entry_price"), F.coalesce("stop_pct", F.lit(15.0))))


@query("a18_position_pnl", "positions! cost:2 value:2 pnl:2 pnl_pct:4", """SELECT count(cost) AS positions, sum(cost) AS cost, sum(value) AS value,
  sum(value - cost) AS pnl, sum(value - cost) / sum(cost) * 100 AS pnl_pct FROM (SELECT CASE WHEN shares > 0 THEN entry_price * shares END AS cost,
  CASE WHEN shares > 0 THEN price * shares END AS value FROM positions JOIN snap USING (ticker))""")
def _(w):
    return snapshots.portfolio_totals(snapshots.mark_to_market(positions(w), prices.live_snapshot(w.bars)))


@query("a19_sector_allocation", "sector allocation:4 status", f"""SELECT sector, allocation, CASE WHEN allocation > 35 THEN 'OVER' ELSE 'OK' END AS status
  FROM (SELECT coalesce(l.sector, 'Unknown') AS sector, sum(weight) AS allocation FROM positions LEFT JOIN ({LARGE}) l USING (ticker) GROUP BY 1)""")
def _(w):
    return snapshots.sector_allocation(positions(w), two_lists(w)[0])


# ---- ranks, windows, sets -------------------------------------------------

@query("w1_pct_rank", "ticker! date r:8", """SELECT ticker, date, (rank() OVER (PARTITION BY date ORDER BY volume)
  + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date) AS r FROM bars""")
def _(w):
    return pct_rank_avg(w.bars.select("ticker", "date", "volume"), ["date"], "volume", "r")


@query("w2_row_mean", "ticker! as_of m:8", """SELECT ticker, as_of, (coalesce(roic, 0) + coalesce(fcf_yield, 0) + coalesce(gm0, 0))
  / nullif(CAST(roic IS NOT NULL AS INT) + CAST(fcf_yield IS NOT NULL AS INT) + CAST(gm0 IS NOT NULL AS INT), 0) AS m FROM panel""")
def _(w):
    from tidemark.functions.columns import row_mean
    return w.quarterly.select("ticker", "as_of", row_mean([F.col("roic"), F.col("fcf_yield"), F.col("gm0")]).alias("m"))


@query("w3_lags", "ticker! date c21:6 c126:6 c252:6", """SELECT ticker, date, lag(close, 21) OVER t AS c21, lag(close, 126) OVER t AS c126,
  lag(close, 252) OVER t AS c252 FROM bars WINDOW t AS (PARTITION BY ticker ORDER BY date)""")
def _(w):
    return w.bars.select("ticker", "date", *[prices.lagged("close", n).alias(f"c{n}") for n in (21, 126, 252)])


@query("w6_rolling_frames", "ticker! date vol_sum:2 low_min:6", """SELECT ticker, date, CASE WHEN count(volume) OVER f = 22 THEN sum(volume) OVER f END AS vol_sum,
  CASE WHEN count(low) OVER g >= 5 THEN min(low) OVER g END AS low_min FROM bars
  WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS 21 PRECEDING), g AS (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING)""")
def _(w):
    return w.bars.select("ticker", "date", prices.rolling(F.col("volume"), 22, 22, F.sum).alias("vol_sum"),
                         prices.rolling(F.col("low"), 10, 5, F.min).alias("low_min"))


@query("w11_last_k", "ticker! date close:6", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars) WHERE k <= 20""")
def _(w):
    return ranking.last_k(w.bars, ["ticker"], [F.col("date").desc()], 20)


@query("c2_intersect", "ticker! sector", f"SELECT * FROM ({MID}) WHERE ticker IN (SELECT ticker FROM ({LARGE}))")
def _(w):
    large, mid = two_lists(w)
    return ranking.intersect_keys(mid, large, "ticker")


@query("c3_dropped", "ticker! sector", f"SELECT * FROM ({MID}) WHERE ticker NOT IN (SELECT ticker FROM ({LARGE}))")
def _(w):
    large, mid = two_lists(w)
    return ranking.dropped(mid, large, ["ticker"])


@query("c4_all_years", "year!", "SELECT DISTINCT year(date) AS year FROM bars UNION SELECT year(o_orderdate) FROM orders")
def _(w):
    return (w.bars.select(F.year("date").alias("year"))
            .union(w.panel.table("orders").select(F.year("o_orderdate"))).distinct())
