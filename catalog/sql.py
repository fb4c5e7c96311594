"""Shared CTEs of the SQL twins, written independently of the library: closed
forms, ASOF joins and plain windows instead of staged as-of passes."""

from __future__ import annotations

import re

CTE: dict[str, str] = {}

CTE["li"] = """SELECT *, CAST(l_shipdate AS DATE) AS d, sqrt(sqrt(sqrt(l_extendedprice / l_quantity))) * 10 AS px,
  {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice} AS k FROM lineitem"""
CTE["bars"] = """SELECT l_suppkey AS ticker, d AS date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low,
  arg_max(px, k) AS close, sum(l_quantity) AS volume, max(l_returnflag) AS flag, min(l_linestatus) AS status
  FROM li GROUP BY 1, 2"""
CTE["bench"] = """SELECT d AS date, arg_max(px, {'k': k, 's': l_suppkey}) AS close FROM li GROUP BY 1"""
CTE["vix"] = """SELECT date, sd * 100 AS vix FROM (
  SELECT date, stddev_samp(r) OVER f AS sd, count(r) OVER f AS c
  FROM (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM bench)
  WINDOW f AS (ORDER BY date ROWS 19 PRECEDING)) WHERE c >= 20"""
CTE["univ"] = """SELECT s_suppkey AS ticker, r_name AS sector, n_name AS index_name, s_name AS name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
CTE["company"] = """SELECT s_suppkey AS ticker, CASE WHEN s_acctbal > 0 THEN 100000.0 + s_suppkey END AS shares,
  90000.0 + s_suppkey AS implied_shares, CASE WHEN s_acctbal > 5000 THEN s_acctbal * 300 END AS reported_cap,
  CASE WHEN s_acctbal > 0 THEN s_acctbal / 500 END AS pe_ratio,
  CASE WHEN s_acctbal > 0 THEN s_acctbal / 2000 END AS ps_ratio,
  CAST(CASE WHEN s_acctbal > 0 THEN 100000.0 + s_suppkey ELSE 90000.0 + s_suppkey END AS DOUBLE) AS shares_used
  FROM supplier"""
CTE["gated"] = """SELECT * FROM (SELECT *, count(close) OVER (PARTITION BY ticker) AS c,
  row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS n FROM bars) WHERE c >= 60"""


def ema(x: str, n: str, span: int, window: str) -> str:
    a = 2.0 / (span + 1)
    w = 1 - a
    return (f"pow({w!r}::DOUBLE, {n}) * sum(CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE {a!r}::DOUBLE END * {x} "
            f"* pow({w!r}::DOUBLE, -{n})) OVER {window}")


CTE["feat"] = f"""SELECT ticker, date, close, {ema('close', 'n', 50, 't')} AS ema_50, {ema('close', 'n', 200, 't')} AS ema_200,
  CASE WHEN count(close) OVER y >= 120 THEN max(close) OVER y END AS high_52w,
  CASE WHEN count(close) OVER y >= 120 THEN avg(close) OVER y END AS mean_52w,
  CASE WHEN count(close) OVER y >= 120 THEN stddev_samp(close) OVER y END AS sd_52w,
  CASE WHEN count(close) OVER y >= 120 THEN (close - avg(close) OVER y) / nullif(stddev_samp(close) OVER y, 0) END AS zscore,
  lag(close, 21) OVER t / lag(close, 252) OVER t - 1 AS ret_12_1,
  close / lag(close, 126) OVER t - 1 AS ret_6m FROM gated
  WINDOW t AS (PARTITION BY ticker ORDER BY date), y AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)"""
CTE["featrow"] = """SELECT * FROM feat WHERE ret_12_1 IS NOT NULL AND zscore IS NOT NULL AND high_52w IS NOT NULL
  AND ret_6m IS NOT NULL"""
CTE["benchf"] = f"""SELECT date, close, ema_200, high_rolling, (ema_200 - close) / ema_200 AS below_trend,
  (high_rolling - close) / high_rolling AS drawdown FROM (
  SELECT date, close, {ema('close', 'n', 200, 't')} AS ema_200,
    CASE WHEN count(close) OVER y >= 120 THEN max(close) OVER y END AS high_rolling
  FROM (SELECT date, close, row_number() OVER (ORDER BY date) - 1 AS n FROM bench)
  WINDOW t AS (ORDER BY date), y AS (ORDER BY date ROWS 251 PRECEDING))"""
CTE["market"] = """SELECT *, fear_count >= 2 AS f8 FROM (SELECT date, vix, below_trend, drawdown,
    coalesce(CAST(vix > 25 AS BIGINT), 0) + coalesce(CAST(below_trend > 0.10 AS BIGINT), 0)
    + coalesce(CAST(drawdown > 0.10 AS BIGINT), 0) AS fear_count
  FROM (SELECT b.date, v.vix, f.below_trend, f.drawdown FROM bench b
    ASOF LEFT JOIN vix v ON b.date >= v.date
    ASOF LEFT JOIN (SELECT * FROM benchf WHERE high_rolling IS NOT NULL) f ON b.date >= f.date))"""
CTE["momentum"] = """SELECT ticker, date, sector, ret_12_1,
  (rank() OVER (PARTITION BY date, sector ORDER BY ret_12_1)
   + (count(*) OVER (PARTITION BY date, sector, ret_12_1) - 1) / 2.0::DOUBLE)
   / count(*) OVER (PARTITION BY date, sector) AS momentum_rank
  FROM feat JOIN univ USING (ticker) WHERE ret_12_1 IS NOT NULL"""
CTE["atr"] = """SELECT *, CASE WHEN row_number() OVER t > 22 THEN avg(tr) OVER f END AS atr FROM (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER t), abs(low - lag(close) OVER t)) AS tr
  FROM bars WINDOW t AS (PARTITION BY ticker ORDER BY date))
  WINDOW t AS (PARTITION BY ticker ORDER BY date), f AS (PARTITION BY ticker ORDER BY date ROWS 21 PRECEDING)"""

# ---- statements -----------------------------------------------------------
CTE["qsum"] = """SELECT l_suppkey AS ticker, last_day(date_trunc('quarter', d) + INTERVAL 2 MONTH) AS period_end,
  sum(l_extendedprice) AS rev,
  sum(l_extendedprice * (1 - l_discount) * CASE l_returnflag WHEN 'R' THEN 0.2::DOUBLE WHEN 'A' THEN 0.5::DOUBLE
      ELSE 0.8::DOUBLE END) AS gp,
  sum(l_extendedprice * l_tax) AS tax FROM li GROUP BY 1, 2"""
CTE["stmt"] = """SELECT ticker, freq, period_end, rev AS revenue, gp AS gross, gp - rev * 0.35::DOUBLE AS ebit,
  gp - rev * 0.35::DOUBLE - tax - rev * 0.01::DOUBLE AS net,
  CASE WHEN tax > rev * 0.035::DOUBLE THEN tax / rev * 5 END AS tax_rate,
  gp - rev * 0.35::DOUBLE + tax * 1.5::DOUBLE - rev * 0.03::DOUBLE AS ocf, tax * 0.5::DOUBLE - rev * 0.03::DOUBLE AS capex,
  (rev / k * 2 + s_acctbal * 100) * 0.25::DOUBLE + rev / k * 0.1::DOUBLE AS debt,
  (rev / k * 2 + s_acctbal * 100) * 0.4::DOUBLE - s_acctbal * 50 AS equity,
  rev / k * 2 + s_acctbal * 100 AS assets, rev / k * 0.5::DOUBLE AS curl, s_acctbal * 20 AS cash
  FROM (SELECT ticker, period_end, rev, gp, tax, 'quarterly' AS freq, 1.0::DOUBLE AS k FROM qsum
        UNION ALL SELECT ticker, make_date(year(period_end), 12, 31), sum(rev), sum(gp), sum(tax), 'annual', 4.0
        FROM qsum GROUP BY 1, 2)
  JOIN supplier ON s_suppkey = ticker"""


CTE["good"] = "SELECT stmt.* FROM stmt JOIN supplier ON s_suppkey = ticker WHERE s_acctbal >= 0"


def _run(back: int, cap: int) -> str:
    run = "0"
    for i in reversed(range(cap)):
        now = f"lag(revenue, {i}) OVER t" if i else "revenue"
        base = f"lag(revenue, {i + back}) OVER t"
        run = f"CASE WHEN {base} <> 0 AND {now} < {base} THEN 1 + {run} ELSE 0 END"
    return run


CTE["qs"] = f"""SELECT ticker, period_end, period_end + 45 AS pub, row_number() OVER t AS n,
  revenue / lag(revenue, 4) OVER t - 1 AS g1, lag(revenue, 1) OVER t / lag(revenue, 5) OVER t - 1 AS g2,
  gross / revenue AS gm0, lag(gross) OVER t / lag(revenue) OVER t AS gm1,
  sum(revenue) OVER f AS revenue_ttm, sum(gross) OVER f AS gross_ttm, sum(ebit) OVER f AS ebit_ttm, sum(net) OVER f AS net_ttm,
  sum(revenue) OVER p AS revenue_prior, sum(gross) OVER p AS gross_prior, sum(net) OVER p AS net_prior, tax_rate,
  {_run(4, 4)} AS falling, sum(ocf) OVER f AS ocf, sum(capex) OVER f AS capex,
  assets, debt, equity, cash, curl, lag(assets) OVER t AS assets_prior, lag(debt) OVER t AS debt_prior
  FROM stmt WHERE freq = 'quarterly'
  WINDOW t AS (PARTITION BY ticker ORDER BY period_end),
   f AS (PARTITION BY ticker ORDER BY period_end ROWS 3 PRECEDING),
   p AS (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING)"""
CTE["an"] = f"""SELECT ticker, period_end, period_end + 45 AS pub, row_number() OVER t AS n,
  revenue / lag(revenue, 1) OVER t - 1 AS g1, lag(revenue, 1) OVER t / lag(revenue, 2) OVER t - 1 AS g2,
  gross / revenue AS gm0, lag(gross) OVER t / lag(revenue) OVER t AS gm1,
  revenue AS revenue_ttm, gross AS gross_ttm, ebit AS ebit_ttm, net AS net_ttm,
  lag(revenue) OVER t AS revenue_prior, lag(gross) OVER t AS gross_prior, lag(net) OVER t AS net_prior, tax_rate,
  {_run(1, 3)} AS falling, ocf, capex,
  assets, debt, equity, cash, curl, lag(assets) OVER t AS assets_prior, lag(debt) OVER t AS debt_prior
  FROM stmt WHERE freq = 'annual' WINDOW t AS (PARTITION BY ticker ORDER BY period_end)"""
_STATE = ("n g1 g2 gm0 gm1 revenue_ttm gross_ttm ebit_ttm net_ttm revenue_prior gross_prior net_prior tax_rate falling "
          "ocf capex assets debt equity cash curl assets_prior debt_prior").split()

CTE["quarters"] = """SELECT effective, max(quarter_end) AS quarter_end, arg_max(eval_date, quarter_end) AS eval_date FROM (
  SELECT qe AS quarter_end,
    coalesce((SELECT max(date) FROM bench WHERE date <= qe), (SELECT min(date) FROM bench)) AS eval_date,
    coalesce((SELECT min(date) FROM bench WHERE date > qe), (SELECT max(date) FROM bench)) AS effective
  FROM (SELECT last_day(CAST(x AS DATE) + INTERVAL 2 MONTH) AS qe FROM (SELECT unnest(generate_series(
    CAST(date_trunc('quarter', min(date) - INTERVAL 4 MONTH) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 3 MONTH)) AS x FROM bench))
  WHERE qe <= (SELECT max(date) FROM bench) AND qe >= (SELECT min(date) - INTERVAL 4 MONTH FROM bench)) GROUP BY effective"""
CTE["eligible"] = """SELECT DISTINCT ticker FROM feat WHERE ticker IN (SELECT ticker FROM stmt)"""
CTE["probe_q"] = """SELECT ticker, effective, quarter_end, eval_date AS as_of FROM eligible, quarters"""
CTE["psp"] = """SELECT s.ticker, s.period_end + 45 AS pub, s.freq,
  f.close * c.shares_used / (s.revenue * CASE s.freq WHEN 'quarterly' THEN 4 ELSE 1 END) AS ps
  FROM stmt s JOIN company c USING (ticker)
  ASOF JOIN feat f ON s.ticker = f.ticker AND s.period_end + 45 >= f.date WHERE s.revenue > 0"""


def metrics_cte(probe: str) -> str:
    """Metrics for each (ticker, as_of) of the probe CTE, all probe columns kept."""
    cols = ", ".join(f"q.{c} AS q_{c}, a.{c} AS a_{c}" for c in _STATE)

    def pick(c: str, k: int) -> str:
        return f"CASE WHEN q_n >= {k} THEN q_{c} ELSE a_{c} END"

    fcf = f"({pick('ocf', 4)}) + (CASE WHEN ({pick('capex', 4)}) > 0 THEN -({pick('capex', 4)}) ELSE ({pick('capex', 4)}) END)"
    tax = pick("tax_rate", 4)
    points = [
        "net4 / assets > 0", "ocf4 > 0", "assets_prior > 0 AND net4 / assets > netp / assets_prior", "ocf4 > net4",
        "assets_prior > 0 AND debt / assets <= debt_prior / assets_prior",
        "rev4 > 0 AND revp > 0 AND gross4 / rev4 > grossp / revp",
        "assets_prior > 0 AND rev4 / assets > revp / assets_prior"]
    score = " + ".join(f"coalesce(CAST(({p}) AS BIGINT), 0)" for p in points)
    return f"""SELECT *,
    CASE WHEN ev > 0 THEN fcf / ev END AS fcf_yield, CASE WHEN ev > 0 THEN ebit4 / ev END AS ebit_yield,
    CASE WHEN revenue_ttm > 0 THEN market_cap / revenue_ttm END AS ps,
    coalesce(net_income_ttm > 0, false) AS profitable,
    CASE WHEN net_income_ttm > 0 THEN market_cap / net_income_ttm END AS pe,
    CASE WHEN net_income_ttm > 0 AND market_cap / net_income_ttm > 0 THEN coalesce(
      CASE WHEN q_n >= 8 AND q_net_prior > 0 AND q_net_ttm / q_net_prior - 1 > 0
        THEN market_cap / net_income_ttm / ((q_net_ttm / q_net_prior - 1) * 100) END,
      CASE WHEN a_n >= 2 AND a_net_prior > 0 AND a_net_ttm / a_net_prior - 1 > 0
        THEN market_cap / net_income_ttm / ((a_net_ttm / a_net_prior - 1) * 100) END) END AS peg
  FROM (SELECT *, market_cap + coalesce(total_debt, 0) - coalesce(cash, 0) AS ev,
    CASE WHEN assets > 0 AND rev4 IS NOT NULL AND ocf4 IS NOT NULL THEN {score} END AS fscore,
    CASE WHEN assets > 0 THEN gross4 / assets END AS gp_assets,
    CASE WHEN assets - curl - coalesce(cash, 0) * 0.5::DOUBLE > 0 THEN ebit4 * (1 - rate)
      / (assets - curl - coalesce(cash, 0) * 0.5::DOUBLE) END AS roic
  FROM (SELECT *, close * shares_used AS market_cap,
    CASE WHEN q_n >= 4 THEN 'quarterly' WHEN a_n IS NOT NULL THEN 'annual' ELSE 'none' END AS income_freq,
    CASE WHEN q_n >= 1 THEN 'quarterly' WHEN a_n IS NOT NULL THEN 'annual' ELSE 'none' END AS balance_freq,
    coalesce(q_n >= 5, false) OR coalesce(a_n >= 2, false) AS growth_known,
    CASE WHEN q_n >= 5 THEN q_g1 WHEN a_n >= 2 THEN a_g1 END AS g1,
    CASE WHEN q_n >= 5 THEN q_g2 WHEN a_n >= 2 THEN a_g2 END AS g2,
    {pick('gm0', 2)} AS gm0, {pick('gm1', 2)} AS gm1,
    CASE WHEN q_n >= 5 THEN q_falling WHEN a_n >= 2 THEN a_falling ELSE 0 END AS falling,
    {fcf} AS fcf,
    CASE WHEN ({pick('cash', 1)}) IS NOT NULL AND ({pick('ocf', 1)}) IS NOT NULL THEN
      CASE WHEN ({pick('ocf', 1)}) < 0 THEN ({pick('cash', 1)}) / (-({pick('ocf', 1)}) / 12) ELSE 999.0 END END AS runway,
    ({pick('debt', 1)}) / abs(nullif({pick('equity', 1)}, 0)) AS de_ratio,
    {pick('revenue_ttm', 1)} AS revenue_ttm, {pick('net_ttm', 1)} AS net_income_ttm,
    {pick('debt', 1)} AS total_debt, {pick('debt', 1)} AS debt, {pick('cash', 1)} AS cash, {pick('equity', 1)} AS equity,
    {pick('assets', 1)} AS assets, {pick('curl', 1)} AS curl, {pick('assets_prior', 1)} AS assets_prior,
    {pick('debt_prior', 1)} AS debt_prior,
    {pick('ebit_ttm', 4)} AS ebit4, {pick('net_ttm', 4)} AS net4, {pick('net_prior', 4)} AS netp,
    {pick('revenue_ttm', 4)} AS rev4, {pick('revenue_prior', 4)} AS revp,
    {pick('gross_ttm', 4)} AS gross4, {pick('gross_prior', 4)} AS grossp, {pick('ocf', 4)} AS ocf4,
    CASE WHEN ({tax}) IS NULL THEN 0.21::DOUBLE
      ELSE greatest(0.0::DOUBLE, least(CASE WHEN ({tax}) > 1 THEN ({tax}) / 100 ELSE ({tax}) END, 0.6::DOUBLE)) END AS rate
  FROM (SELECT p.*, {cols}, f.close, r.ret_6m, c.shares_used FROM {probe} p
    LEFT JOIN company c ON p.ticker = c.ticker
    ASOF LEFT JOIN qs q ON p.ticker = q.ticker AND p.as_of >= q.pub
    ASOF LEFT JOIN an a ON p.ticker = a.ticker AND p.as_of >= a.pub
    ASOF LEFT JOIN feat f ON p.ticker = f.ticker AND p.as_of >= f.date
    ASOF LEFT JOIN (SELECT * FROM feat WHERE ret_6m IS NOT NULL) r ON p.ticker = r.ticker AND p.as_of >= r.date)))"""


def hist_cte(probe: str) -> str:
    """P/S history figures for each (ticker, as_of) of the metrics CTE ``probe``."""
    return f"""SELECT ticker, as_of, count(v) AS ps_n,
    CASE WHEN count(v) >= 2 AND any_value(ps) IS NOT NULL THEN avg(CAST(v <= ps AS DOUBLE)) END AS ps_pct,
    CASE WHEN count(v) >= 2 AND any_value(ps) IS NOT NULL THEN
      CAST(floor(count(*) FILTER (WHERE v < ps)::DOUBLE / count(v) * 100) AS BIGINT) END AS ps_rank,
    CASE WHEN count(v) >= 2 AND any_value(ps) IS NOT NULL THEN min(v) END AS ps_min,
    CASE WHEN count(v) >= 2 AND any_value(ps) IS NOT NULL THEN max(v) END AS ps_max,
    CASE WHEN count(v) >= 2 THEN quantile_cont(v, 0.25) END AS ps_threshold
  FROM (SELECT ticker, as_of, ps, unnest(CASE WHEN len(hq) < 4 AND len(ha) > len(hq) THEN ha ELSE hq END) AS v
    FROM (SELECT m.ticker, m.as_of, any_value(m.ps) AS ps,
      coalesce(list(h.ps) FILTER (WHERE h.freq = 'quarterly'), []) AS hq,
      coalesce(list(h.ps) FILTER (WHERE h.freq = 'annual'), []) AS ha
    FROM (SELECT DISTINCT ticker, as_of, ps FROM {probe}) m
    LEFT JOIN psp h ON m.ticker = h.ticker AND h.pub <= m.as_of AND h.pub >= m.as_of - 1095
    GROUP BY 1, 2)) GROUP BY 1, 2"""


QUALITY = """CASE WHEN growth_known THEN coalesce(g1 > 0.15, false) AND (g2 IS NULL OR g2 > 0.15) END AS f1_rev_growth,
  gm0 > 0.40 AND (gm1 IS NULL OR gm0 >= gm1 - 0.05::DOUBLE) AS f2_gross_margin,
  roic > 0.15 AS f3_roic, de_ratio < 1 AS f4_de_ratio,
  CASE WHEN fcf > 0 THEN true ELSE runway >= 24 END AS f5_fcf,
  CASE WHEN profitable AND peg IS NOT NULL THEN peg < 2
    WHEN ps IS NOT NULL THEN ps < 15 AND coalesce(g1 > 0.30, false) END AS f6_peg_ps,
  fcf_yield > 0.015 AS f7_fcf_yield"""


def filters_cte(metrics: str, hist: str) -> str:
    return f"""SELECT *, coalesce(f1_rev_growth AND f2_gross_margin AND f3_roic AND f4_de_ratio AND f5_fcf AND f6_peg_ps
    AND f7_fcf_yield, false) AS quality_pass
  FROM (SELECT m.*, coalesce(h.ps_n, 0) AS ps_n, h.ps_pct, h.ps_rank, h.ps_min, h.ps_max, h.ps_threshold, {QUALITY}
    FROM {metrics} m LEFT JOIN {hist} h ON m.ticker = h.ticker AND m.as_of = h.as_of)"""


def timing_cte(base: str) -> str:
    """F8-F12 next to the filters CTE ``base``."""
    return f"""SELECT *, f8_fear_regime AND f9_price_disloc AND f10_momentum AND f11_ps_quartile AND f12_above_ema50 AS entry_pass
  FROM (SELECT b.*, x.close AS close_row, x.high_52w, x.zscore, x.ema_50, x.ret_12_1, x.mean_52w, x.sd_52w,
    o.momentum_rank, k.vix, k.below_trend, k.drawdown, k.fear_count,
    coalesce(k.f8, false) AS f8_fear_regime,
    coalesce(x.zscore < -1.5, false) OR coalesce((x.high_52w - x.close) / x.high_52w > 0.20, false) AS f9_price_disloc,
    coalesce(o.momentum_rank > 0.10, true) AS f10_momentum,
    coalesce(b.ps <= b.ps_threshold, false) AS f11_ps_quartile,
    coalesce(x.close >= x.ema_50 * 0.90::DOUBLE, false) AS f12_above_ema50
  FROM {base} b LEFT JOIN market k ON k.date = b.as_of
    ASOF LEFT JOIN featrow x ON b.ticker = x.ticker AND b.as_of >= x.date
    ASOF LEFT JOIN momentum o ON b.ticker = o.ticker AND b.as_of >= o.date)"""


CTE["met_q"] = metrics_cte("probe_q")
CTE["hist_q"] = hist_cte("met_q")
CTE["panel"] = filters_cte("met_q", "hist_q")

CTE["usable"] = """SELECT * FROM panel WHERE quality_pass AND market_cap IS NOT NULL AND ret_6m IS NOT NULL"""


def rank_sql(col: str, by: str, out: str) -> str:
    return (f"CASE WHEN {col} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {col} NULLS LAST) "
            f"+ (count(*) OVER (PARTITION BY {by}, {col}) - 1) / 2.0::DOUBLE) / count({col}) OVER (PARTITION BY {by}) END AS {out}")


CTE["scored"] = f"""SELECT effective, ticker, value_score, momentum_score,
  0.5::DOUBLE * value_score + 0.5::DOUBLE * momentum_score AS score FROM (
  SELECT effective, ticker, CASE WHEN n = 1 THEN 0.5::DOUBLE ELSE
    (coalesce(r1, 0.0::DOUBLE) + coalesce(1 - r2, 0.0::DOUBLE) + coalesce(r3, 0.0::DOUBLE))
    / (CAST(r1 IS NOT NULL AS INT) + CAST(r2 IS NOT NULL AS INT) + CAST(r3 IS NOT NULL AS INT)) END AS value_score,
    CASE WHEN n = 1 THEN 0.5::DOUBLE ELSE r4 END AS momentum_score FROM (
  SELECT effective, ticker, count(*) OVER (PARTITION BY effective) AS n,
    {rank_sql('ebit_yield', 'effective', 'r1')}, {rank_sql('ps_pct', 'effective', 'r2')},
    {rank_sql('fcf_yield', 'effective', 'r3')}, {rank_sql('ret_6m', 'effective', 'r4')}
  FROM usable WHERE CAST(ebit_yield IS NULL AS INT) + CAST(ps_pct IS NULL AS INT) + CAST(fcf_yield IS NULL AS INT) < 2))"""
CTE["scored_orig"] = f"""SELECT effective, ticker, value_score, momentum_score,
  0.5::DOUBLE * value_score + 0.5::DOUBLE * momentum_score AS score FROM (
  SELECT effective, ticker, CASE WHEN n = 1 THEN 0.5::DOUBLE ELSE 1 - r2 END AS value_score,
    CASE WHEN n = 1 THEN 0.5::DOUBLE ELSE r4 END AS momentum_score FROM (
  SELECT effective, ticker, count(*) OVER (PARTITION BY effective) AS n,
    {rank_sql('ps_pct', 'effective', 'r2')}, {rank_sql('ret_6m', 'effective', 'r4')} FROM usable WHERE ps_pct IS NOT NULL))"""
CTE["ranked"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY effective ORDER BY score DESC, ticker) AS rank
  FROM scored) WHERE rank <= 10"""
CTE["ranked_orig"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY effective ORDER BY score DESC, ticker) AS rank
  FROM scored_orig) WHERE rank <= 10"""
CTE["spans"] = """SELECT effective, lead(effective) OVER (ORDER BY effective) AS until FROM quarters"""

CTE["probe_s"] = """SELECT b.ticker, b.date AS as_of, p.effective FROM (SELECT ticker, effective FROM panel WHERE quality_pass) p
  JOIN spans s ON p.effective = s.effective
  JOIN bars b ON p.ticker = b.ticker AND b.date >= s.effective AND (s.until IS NULL OR b.date < s.until)"""
CTE["met_s"] = metrics_cte("probe_s")
CTE["hist_s"] = hist_cte("met_s")
CTE["filt_s"] = filters_cte("met_s", "hist_s")
CTE["time_s"] = timing_cte("filt_s")
CTE["signals"] = "SELECT * FROM time_s WHERE entry_pass"

CTE["probe_l"] = """SELECT ticker, max(date) AS as_of FROM bars WHERE ticker IN (SELECT ticker FROM eligible) GROUP BY 1"""
CTE["met_l"] = metrics_cte("probe_l")
CTE["hist_l"] = hist_cte("met_l")
CTE["filt_l"] = filters_cte("met_l", "hist_l")
CTE["latest"] = timing_cte("filt_l")

CTE["probe_n"] = """SELECT ticker, date AS as_of FROM bars WHERE ticker IN (SELECT ticker FROM eligible)
  AND date IN (SELECT date FROM bench ORDER BY date DESC LIMIT 6)"""
CTE["met_n"] = metrics_cte("probe_n")
CTE["hist_n"] = hist_cte("met_n")
CTE["filt_n"] = filters_cte("met_n", "hist_n")
CTE["daily"] = timing_cte("filt_n")

_CHECKS = [
    ("F1a", "F1", "g1 > 0.15", "g1", 0.15), ("F1b", "F1", "g2 > 0.15", "g2", 0.15),
    ("F2a", "F2", "gm0 > 0.40", "gm0", 0.40), ("F2b", "F2", "gm0 >= gm1 - 0.05::DOUBLE", "gm0 - gm1", -0.05),
    ("F3", "F3", "f3_roic", "roic", 0.15), ("F4", "F4", "f4_de_ratio", "de_ratio", 1.0),
    ("F5", "F5", "CASE WHEN fcf > 0 THEN true ELSE runway >= 24 END", "fcf", 0.0),
    ("F6", "F6", "f6_peg_ps", "coalesce(peg, ps)", 2.0), ("F7", "F7", "f7_fcf_yield", "fcf_yield", 0.015),
    ("F8a", "F8", "vix > 25", "vix", 25.0), ("F8b", "F8", "below_trend > 0.10", "below_trend", 0.10),
    ("F8c", "F8", "drawdown > 0.10", "drawdown", 0.10), ("F8d", "F8", "CAST(NULL AS BOOLEAN)", "NULL", 35.0),
    ("F9a", "F9", "zscore < -1.5", "zscore", -1.5),
    ("F9b", "F9", "(high_52w - close_row) / high_52w > 0.20", "(high_52w - close_row) / high_52w", 0.20),
    ("F10", "F10", "coalesce(momentum_rank > 0.10, true)", "momentum_rank", 0.10),
    ("F11", "F11", "ps <= ps_threshold", "ps", 0.25),
    ("F12", "F12", "close_row >= ema_50 * 0.90::DOUBLE", "(close_row - ema_50) / ema_50", -0.1),
]
CTE["checks"] = " UNION ALL ".join(
    f"SELECT ticker, as_of, '{i}' AS check_id, '{g}' AS grp, {p} AS passed, CAST({v} AS DOUBLE) AS value, "
    f"{t}::DOUBLE AS threshold FROM latest" for i, g, p, v, t in _CHECKS)
CTE["groups"] = """SELECT ticker, as_of, grp, CASE
    WHEN grp = 'F8' THEN CASE WHEN yes >= 2 THEN true WHEN unk = yes + no + unk THEN NULL ELSE false END
    WHEN grp = 'F9' THEN CASE WHEN yes >= 1 THEN true WHEN unk = yes + no + unk THEN NULL ELSE false END
    WHEN grp IN ('F1', 'F2') THEN CASE WHEN no >= 1 THEN false WHEN yes >= 1 THEN true END
    ELSE CASE WHEN yes = yes + no + unk THEN true WHEN no >= 1 THEN false END END AS group_pass, yes, no, unk
  FROM (SELECT ticker, as_of, grp, count(*) FILTER (WHERE passed) AS yes, count(*) FILTER (WHERE NOT passed) AS no,
    count(*) FILTER (WHERE passed IS NULL) AS unk FROM checks GROUP BY 1, 2, 3)"""
CTE["verdict"] = """SELECT *, CASE WHEN n = 12 THEN 'HIGH CONVICTION' WHEN n >= 9 THEN 'MEDIUM' ELSE 'DO NOT ENTER' END AS conviction,
  CASE WHEN n = 12 THEN 'SIGNAL ACTIVE' WHEN n = 11 AND failing = 'F8' THEN 'WATCHLIST PRIORITY'
    WHEN n = 11 AND failing = 'F12' THEN 'STABILIZATION WATCH' WHEN n >= 9 THEN 'WATCH LIST' ELSE 'NO ACTION' END AS action
  FROM (SELECT ticker, as_of, count(*) FILTER (WHERE group_pass) AS n,
    coalesce(string_agg(grp, ',' ORDER BY CAST(substr(grp, 2) AS INT)) FILTER (WHERE NOT group_pass), '') AS failing,
    bool_or(NOT group_pass) FILTER (WHERE grp = 'F8') AS no8, bool_or(NOT group_pass) FILTER (WHERE grp = 'F9') AS no9,
    bool_or(NOT group_pass) FILTER (WHERE grp = 'F12') AS no12 FROM groups GROUP BY 1, 2)"""

# ---- exits ----------------------------------------------------------------
CTE["entries"] = """SELECT DISTINCT w.ticker, CASE WHEN ticker_even THEN 'qvm' ELSE 'crash' END AS tier, b.date AS entry_date, b.close AS entry_price
  FROM (SELECT ticker, effective, ebit_yield > 0.1 AS ticker_even FROM panel WHERE f4_de_ratio AND ebit_yield IS NOT NULL) w
  ASOF JOIN bars b ON w.ticker = b.ticker AND w.effective <= b.date"""
CTE["since"] = """SELECT e.ticker, e.entry_date, b.date, b.close, b.atr,
  max(b.close) OVER (PARTITION BY e.ticker, e.entry_date ORDER BY b.date) AS peak
  FROM (SELECT DISTINCT ticker, entry_date FROM entries) e JOIN atr b ON e.ticker = b.ticker
   AND b.date >= e.entry_date"""
CTE["stops"] = """SELECT ticker, entry_date, min(date) FILTER (WHERE close < peak * 0.85::DOUBLE) AS trailing_date,
  min(date) FILTER (WHERE date - entry_date >= 30 AND close < peak - 3.0::DOUBLE * atr) AS atr_date,
  max(peak) AS peak_close, max(date) AS last_bar FROM since GROUP BY 1, 2"""
CTE["probe_t"] = """SELECT DISTINCT ticker, pub AS as_of FROM (SELECT ticker, pub FROM qs UNION ALL SELECT ticker, pub FROM an)"""
CTE["met_t"] = metrics_cte("probe_t")
CTE["thesis"] = """SELECT ticker, as_of AS published, CASE WHEN falling >= 2 THEN 'neg_revenue_' || falling || 'q'
  WHEN gm0 < 0.30 THEN 'gm_below_30%' WHEN de_ratio > 2 THEN 'de_ratio_' || printf('%.1f', de_ratio) END AS reason FROM met_t"""
CTE["exits"] = """SELECT e.*, least(
    CASE WHEN e.tier = 'qvm' THEN {'d': atr_date, 'p': 0, 'r': 'atr_trailing_stop'} END) AS unused FROM entries e"""
CTE["pairs"] = "SELECT DISTINCT ticker, entry_date FROM entries"
CTE["thesis_due"] = """SELECT p.ticker, p.entry_date,
    CASE WHEN n.reason IS NOT NULL THEN p.entry_date + 1 ELSE x.published END AS due,
    coalesce(n.reason, x.reason) AS thesis_reason FROM pairs p
    ASOF LEFT JOIN thesis n ON p.ticker = n.ticker AND p.entry_date >= n.published
    ASOF LEFT JOIN (SELECT * FROM thesis WHERE reason IS NOT NULL) x ON p.ticker = x.ticker AND p.entry_date < x.published"""
CTE["thesis_exit"] = """SELECT t.ticker, t.entry_date, t.thesis_reason, b.date AS thesis_date FROM thesis_due t
    ASOF LEFT JOIN bars b ON t.ticker = b.ticker AND t.due <= b.date WHERE t.due IS NOT NULL"""
CTE["rebal_due"] = """SELECT p.ticker, p.entry_date, min(q.effective) AS due FROM pairs p JOIN quarters q ON q.effective > p.entry_date
    WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.effective = q.effective AND r.ticker = p.ticker) GROUP BY 1, 2"""
CTE["rebal_exit"] = """SELECT t.ticker, t.entry_date, b.date AS rebalance_date FROM rebal_due t
    ASOF LEFT JOIN bars b ON t.ticker = b.ticker AND t.due <= b.date"""
CTE["hold_exit"] = """SELECT p.ticker, p.entry_date, b.date AS hold_date FROM pairs p
    ASOF LEFT JOIN bars b ON p.ticker = b.ticker AND p.entry_date + 1825 <= b.date"""
CTE["resolved"] = """SELECT e.ticker, e.tier, e.entry_date, e.entry_price, o.d AS exit_date, o.r AS exit_reason, b.close AS exit_price FROM (
    SELECT ticker, tier, entry_date, entry_price, arg_min({'d': d, 'r': r}, {'d': d, 'p': p}) AS o FROM (
      SELECT e.*, atr_date AS d, 0 AS p, 'atr_trailing_stop' AS r FROM entries e JOIN stops USING (ticker, entry_date) WHERE tier = 'qvm'
      UNION ALL SELECT e.*, rebalance_date, 1, 'qvm_rebalance' FROM entries e JOIN rebal_exit USING (ticker, entry_date) WHERE tier = 'qvm'
      UNION ALL SELECT e.*, hold_date, 2, 'max_hold_3yr' FROM entries e JOIN hold_exit USING (ticker, entry_date) WHERE tier = 'crash'
      UNION ALL SELECT e.*, thesis_date, 3, thesis_reason FROM entries e JOIN thesis_exit USING (ticker, entry_date) WHERE tier = 'crash'
      UNION ALL SELECT e.*, l.d, 4, 'backtest_end' FROM entries e JOIN (SELECT ticker, max(date) AS d FROM bars GROUP BY 1) l USING (ticker)
    ) WHERE d IS NOT NULL GROUP BY 1, 2, 3, 4) e JOIN bars b ON b.ticker = e.ticker AND b.date = e.o.d"""
del CTE["exits"]

# ---- trades ---------------------------------------------------------------
CTE["trades"] = """SELECT ticker, tier, entry_date, entry_price, exit_date, entry_price * (1 + r) AS exit_price, r AS return_dec,
  r * 100 AS return_pct, r * 100000 AS pnl_dollars, exit_date - entry_date AS hold_days,
  CASE WHEN exit_date IS NULL THEN 'backtest_end' ELSE reason END AS exit_reason FROM (
  SELECT ticker, CASE flag WHEN 'R' THEN 'crash' ELSE 'qvm' END AS tier, date AS entry_date, close AS entry_price,
    lead(date) OVER t AS exit_date, (lead(close) OVER t - close) / (lead(close) OVER t + close) * 0.1::DOUBLE AS r,
    CASE status WHEN 'O' THEN 'qvm_rebalance' ELSE 'atr_trailing_stop' END AS reason
  FROM bars WINDOW t AS (PARTITION BY ticker ORDER BY date))"""
CTE["done"] = "SELECT *, md5(CAST(ticker AS VARCHAR)) AS h FROM trades WHERE return_dec IS NOT NULL"
CTE["byear"] = """SELECT year(date) AS year, arg_max(close, date) / arg_min(close, date) * 100 - 100 AS ret_pct FROM bench GROUP BY 1"""
CTE["active"] = "SELECT year(entry_date) AS year, count(*) AS n FROM done GROUP BY 1 HAVING count(*) >= 3"
CTE["wins"] = """WITH a AS (SELECT min(year) AS lo, max(year) AS hi, count(*) AS n, list(year ORDER BY year) AS ys FROM active)
  SELECT 'year' AS kind, row_number() OVER (ORDER BY year) AS fold, year AS start_year, year + 1 AS end_year FROM active
  UNION ALL SELECT 'train', y - lo + 1, y, y + 2 FROM (SELECT lo, hi, unnest(generate_series(lo, hi)) AS y FROM a) WHERE y + 3 <= hi + 1
  UNION ALL SELECT 'test', y - lo + 1, y + 2, y + 3 FROM (SELECT lo, hi, unnest(generate_series(lo, hi)) AS y FROM a) WHERE y + 3 <= hi + 1
  UNION ALL SELECT 'half', 1, lo, ys[n // 2] + 1 FROM a WHERE n >= 4
  UNION ALL SELECT 'half', 2, ys[n // 2 + 1], hi + 1 FROM a WHERE n >= 4"""
CTE["wtrades"] = """SELECT w.kind, w.fold, w.start_year, w.end_year, t.* FROM wins w JOIN done t
  ON year(t.entry_date) >= w.start_year AND year(t.entry_date) < w.end_year"""
CTE["wequity"] = """SELECT kind, fold, arg_max(e, n) AS growth, least(min(e / greatest(peak, 1)) - 1, 0) AS max_dd FROM (
  SELECT *, max(e) OVER (PARTITION BY kind, fold ORDER BY n) AS peak FROM (
  SELECT kind, fold, row_number() OVER o AS n, product(1 + 0.1::DOUBLE * return_dec) OVER o AS e FROM wtrades
  WINDOW o AS (PARTITION BY kind, fold ORDER BY entry_date, h, ticker ROWS UNBOUNDED PRECEDING))) GROUP BY 1, 2"""
CTE["wf"] = """SELECT b.kind || '-' || b.start_year || '-' || (b.end_year - 1) AS period, b.kind, b.fold, b.start_year, b.end_year,
  n_trades, n_qvm, n_crash, win_rate, avg_return, median_return, best_trade, worst_trade, avg_hold,
  (pow(growth, 1 / yrs) - 1) * 100 AS cagr, bench * 100 AS bench_cagr, (pow(growth, 1 / yrs) - 1 - bench) * 100 AS alpha,
  max_dd * 100 AS max_drawdown, CASE WHEN sd > 0 THEN mu / sd * sqrt(n_trades / yrs) ELSE 0 END AS sharpe,
  CASE WHEN lost IS NULL THEN won WHEN lost <> 0 THEN won / abs(lost) ELSE 'inf'::DOUBLE END AS profit_factor
  FROM (SELECT kind, fold, start_year, end_year, count(*) AS n_trades, count(*) FILTER (WHERE tier = 'qvm') AS n_qvm,
    count(*) FILTER (WHERE tier = 'crash') AS n_crash, avg(CAST(return_pct > 0 AS DOUBLE)) * 100 AS win_rate,
    avg(return_pct) AS avg_return, median(return_pct) AS median_return, max(return_pct) AS best_trade,
    min(return_pct) AS worst_trade, avg(hold_days) AS avg_hold, avg(return_dec * 0.1::DOUBLE) AS mu, stddev_pop(return_dec * 0.1::DOUBLE) AS sd,
    coalesce(sum(return_pct) FILTER (WHERE return_pct > 0), 0) AS won, sum(return_pct) FILTER (WHERE return_pct <= 0) AS lost,
    greatest(0.5, (make_date(end_year, 1, 1) - make_date(start_year, 1, 1)) / 365.25::DOUBLE) AS yrs
    FROM wtrades GROUP BY 1, 2, 3, 4) b JOIN wequity USING (kind, fold)
  JOIN (SELECT w.kind, w.fold, pow(product(1 + ret_pct / 100), 1.0::DOUBLE / count(*)) - 1 AS bench FROM wins w
    JOIN byear y ON y.year >= w.start_year AND y.year < w.end_year GROUP BY 1, 2) USING (kind, fold)"""

CTE["rtrades"] = """SELECT *, md5(CAST(ticker AS VARCHAR)) AS h, exit_price / entry_price - 1 AS return_dec FROM resolved WHERE exit_price / entry_price - 1 IS NOT NULL"""
CTE["idx"] = """SELECT return_dec, row_number() OVER (ORDER BY year(entry_date) * 12 + month(entry_date), substr(h, 1, 2), entry_date, ticker, tier) - 1 AS idx,
  count(*) OVER () AS n FROM rtrades"""
CTE["sims"] = """SELECT sim, draw, return_dec FROM (
  SELECT s.sim, d.draw, CAST('0x' || substr(md5(s.sim || '-' || d.draw || '-42'), 1, 8) AS BIGINT) % d.n AS idx
  FROM (SELECT unnest(range(1000)) AS sim) s, (SELECT idx AS draw, n FROM idx) d) JOIN idx USING (idx)"""
CTE["simstats"] = """SELECT sim, growth * 1000000.0::DOUBLE AS final_value, pow(growth, 0.2::DOUBLE) - 1 AS cagr, max_dd AS max_drawdown,
  CASE WHEN sd > 0 THEN mu / sd * sqrt(n / 5.0::DOUBLE) ELSE 0 END AS sharpe, win_rate FROM (
  SELECT sim, count(*) AS n, avg(CAST(return_dec > 0 AS DOUBLE)) AS win_rate, avg(return_dec * 0.1::DOUBLE) AS mu,
    stddev_pop(return_dec * 0.1::DOUBLE) AS sd, arg_max(e, draw) AS growth, least(min(e / greatest(peak, 1)) - 1, 0) AS max_dd FROM (
    SELECT *, max(e) OVER (PARTITION BY sim ORDER BY draw) AS peak FROM (
    SELECT *, product(1 + 0.1::DOUBLE * return_dec) OVER (PARTITION BY sim ORDER BY draw ROWS UNBOUNDED PRECEDING) AS e FROM sims))
  GROUP BY 1)"""

# The full number of simulations.
CTE["sims_full"] = CTE["sims"].replace("range(1000)", "range(10000)")
CTE["simstats_full"] = CTE["simstats"].replace("FROM sims)", "FROM sims_full)")

# ---- curves, snapshots ----------------------------------------------------
CTE["basketc"] = """SELECT date, avg(close) AS close FROM bars GROUP BY 1"""
CTE["curve"] = """SELECT 'benchmark' AS scenario, date, close / first_value(close) OVER (ORDER BY date) * 1000000 AS value FROM bench
  UNION ALL SELECT 'basket', date, close / first_value(close) OVER (ORDER BY date) * 1000000 FROM basketc"""
CTE["positions"] = """SELECT ticker, CASE WHEN v > 100 THEN v ELSE 0.0 END AS shares, entry_price, CASE WHEN v > 120 THEN 20.0 END AS stop_pct,
  v / 20 AS weight FROM (SELECT ticker, arg_min(open, date) AS entry_price, max(volume) AS v FROM bars GROUP BY 1)"""
CTE["scores"] = """SELECT user_id AS ticker, CAST(ts AS DATE) AS date, least(count(*) * 2 + 5, 12) AS score FROM events GROUP BY 1, 2"""
CTE["snap"] = f"""SELECT ticker, max(date) AS date, arg_max(close, date) AS price, max(close) AS high_52w, arg_max(e, date) AS ema50,
  max(close) FILTER (WHERE rn = 126) AS then_close,
  (arg_max(close, date) - max(close)) / max(close) * 100 AS off_high,
  (arg_max(close, date) - arg_max(e, date)) / arg_max(e, date) * 100 AS vs_ema50,
  (arg_max(close, date) / max(close) FILTER (WHERE rn = 126) - 1) * 100 AS mom_6m FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn,
    sum(close * pow({1 - 2 / 51!r}::DOUBLE, -n)) OVER t / sum(pow({1 - 2 / 51!r}::DOUBLE, -n)) OVER t AS e FROM (
    SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM (
      SELECT *, max(date) OVER (PARTITION BY ticker) AS last FROM bars) WHERE date > last - 365)
  WINDOW t AS (PARTITION BY ticker ORDER BY date)) GROUP BY 1"""


def scan_day(back: int) -> str:
    """The last scan day of the data (1), the one before (2), and so on."""
    return f"(SELECT DISTINCT date FROM scores ORDER BY date DESC LIMIT 1 OFFSET {back - 1})"


def with_ctes(body: str) -> str:
    """Prefixes the CTEs a query needs, in definition order."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"\b[a-z_]\w*\b", text)):
            if word in CTE and word not in need:
                need.add(word)
                visit(CTE[word])

    visit(body)
    parts = [f"{name} AS ({CTE[name]})" for name in CTE if name in need]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
