"""Point-in-time company statements.

A metric only changes when a new period is published, so positions ("four
periods back") are window lags over the periods of a statement, computed once
per period. The state in force at any as-of date is then one as-of lookup over
all statement kinds together: linear work, no period-by-date blow-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Settings
from tidemark.functions.columns import growth, ratio
from tidemark.operators.asof import Stream, asof_backward

# Canonical items per statement and the labels accepted for
# each, in order of preference.
ITEMS = {
    "income": {
        "revenue": ["Total Revenue", "Revenue", "TotalRevenue"],
        "gross": ["Gross Profit", "GrossProfit"],
        "ebit": ["Operating Income", "OperatingIncome", "EBIT"],
        "net": ["Net Income", "NetIncome", "Net Income Common Stockholders",
                "Net Income Including Noncontrolling Interests"],
        "tax_rate": ["Tax Rate For Calcs", "TaxRateForCalcs", "Effective Tax Rate"],
    },
    "cashflow": {
        "ocf": ["Operating Cash Flow", "Total Cash From Operating Activities",
                "OperatingCashFlow", "Cash Flow From Continuing Operating Activities"],
        "capex": ["Capital Expenditure", "CapitalExpenditures", "Capex",
                  "Purchase Of Property Plant And Equipment", "Capital Expenditure Reported"],
    },
    "balance": {
        "debt": ["Total Debt", "TotalDebt", "Long Term Debt And Capital Lease Obligation", "LongTermDebt"],
        "equity": ["Stockholders Equity", "Total Stockholders Equity", "StockholdersEquity",
                   "Total Equity Gross Minority Interest", "Common Stock Equity"],
        "assets": ["Total Assets", "TotalAssets"],
        "current_liabilities": ["Current Liabilities", "Total Current Liabilities", "CurrentLiabilities"],
        "cash": ["Cash And Cash Equivalents", "CashAndCashEquivalents",
                 "Cash Cash Equivalents And Short Term Investments", "Cash And Short Term Investments"],
    },
}

PERIOD = ["ticker", "freq", "statement", "period_end"]


def label_lookup() -> dict[str, tuple[str, str, int]]:
    """Label -> (statement, item, priority)."""
    return {label: (stmt, item, rank)
            for stmt, items in ITEMS.items() for item, labels in items.items()
            for rank, label in enumerate(labels)}


def to_long(wide: DataFrame) -> DataFrame:
    """Item columns to rows; the statement follows from the item's label."""
    known = label_lookup()
    labels = [c for c in wide.columns if c in known]
    long = wide.unpivot(["ticker", "freq", "period_end"], labels, "item", "value")
    stmt = F.create_map(*[x for label in labels for x in (F.lit(label), F.lit(known[label][0]))])
    return long.select("ticker", "freq", stmt[F.col("item")].alias("statement"), "period_end", "item", "value")


def resolve_labels(long: DataFrame) -> DataFrame:
    """Per statement and item, keep the first accepted label that is present
    at all, even where its value is missing."""
    known = label_lookup()
    dims = F.create_map(*[x for label, (s, i, p) in known.items() for x in (
        F.lit(f"{s}|{label}"), F.struct(F.lit(i).alias("item"), F.lit(p).alias("priority")))])
    named = (long.withColumn("_dim", dims[F.concat_ws("|", "statement", "item")])
             .where(F.col("_dim").isNotNull())
             .select("ticker", "freq", "statement", "period_end", F.col("item").alias("label"),
                     F.col("_dim.item").alias("item"), F.col("_dim.priority").alias("_p"), "value"))
    best = F.min("_p").over(Window.partitionBy("ticker", "freq", "statement", "item"))
    return named.withColumn("_best", best).where(F.col("_p") == F.col("_best")).drop("_p", "_best")


def period_table(long: DataFrame) -> DataFrame:
    """One row per period: item columns, plus ``has_<item>`` telling whether the
    statement carries the item at all."""
    r = resolve_labels(long)
    items = [i for group in ITEMS.values() for i in group]
    wide = r.groupBy(*PERIOD).agg(
        *[F.max(F.when(F.col("item") == i, F.col("value"))).alias(i) for i in items],
        *[F.max(F.col("item") == i).alias(f"_has_{i}") for i in items])
    whole = Window.partitionBy("ticker", "freq", "statement")
    return wide.select(*PERIOD, *items, *[F.max(f"_has_{i}").over(whole).alias(f"has_{i}") for i in items])


def _falling_run(item: str, back: int, cap: int, w: Window) -> Column:
    """How many of the latest periods in a row fell against ``back`` periods
    earlier; a missing or zero base ends the run."""
    run: Column = F.lit(0)
    for i in reversed(range(cap)):
        now = F.lag(item, i).over(w) if i else F.col(item)
        base = F.lag(item, i + back).over(w)
        run = F.when((base != 0) & (now < base), run + 1).otherwise(F.lit(0))
    return run.cast("bigint")


def statement_states(periods: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """What each period, as the newest known, says about the statement."""
    w = Window.partitionBy("ticker", "freq", "statement").orderBy("period_end")
    quarterly = F.col("freq") == "quarterly"
    last4, prior4 = w.rowsBetween(-3, 0), w.rowsBetween(-7, -4)

    def lag(c: str, n: int) -> Column:
        return F.lag(c, n).over(w)

    def pick(q: Column, a: Column) -> Column:
        return F.when(quarterly, q).otherwise(a)

    def ttm(c: str) -> Column:
        return pick(F.coalesce(F.sum(c).over(last4), F.lit(0.0)), F.col(c))

    def prior(c: str) -> Column:
        rows = F.count(F.lit(1)).over(prior4)
        return pick(F.when(rows > 0, F.coalesce(F.sum(c).over(prior4), F.lit(0.0))), lag(c, 1))

    rev = F.col("revenue")
    shared = [F.row_number().over(w).cast("bigint").alias("n"), F.col("period_end").alias("period_end")]
    income = F.struct(
        *shared,
        pick(growth(rev, lag("revenue", 4)), growth(rev, lag("revenue", 1))).alias("g1"),
        pick(growth(lag("revenue", 1), lag("revenue", 5)),
             growth(lag("revenue", 1), lag("revenue", 2))).alias("g2"),
        ratio("gross", "revenue").alias("gm0"),
        ratio(lag("gross", 1), lag("revenue", 1)).alias("gm1"),
        *[ttm(c).alias(f"{c}_ttm") for c in ("revenue", "gross", "ebit", "net")],
        *[prior(c).alias(f"{c}_prior") for c in ("revenue", "gross", "net")],
        "tax_rate",
        pick(_falling_run("revenue", 4, 4, w), _falling_run("revenue", 1, 3, w)).alias("falling"),
        *[F.col(f"has_{c}") for c in ("revenue", "gross", "ebit", "net", "tax_rate")])
    cash = F.struct(*shared, ttm("ocf").alias("ocf"),
                    F.when(F.col("has_capex"), ttm("capex")).otherwise(F.lit(0.0)).alias("capex"),
                    F.col("has_ocf").alias("has_ocf"))
    balance = F.struct(
        *shared, *[F.col(c) for c in ("assets", "debt", "equity", "cash", "current_liabilities")],
        lag("assets", 1).alias("assets_prior"), lag("debt", 1).alias("debt_prior"),
        F.col("has_assets"))
    published = F.date_add("period_end", cfg.lag_days)

    def slot(name: str, freq: str, value: Column) -> Column:
        return F.when((F.col("statement") == name) & (F.col("freq") == freq), value)

    return periods.select(
        "ticker", published.alias("published"),
        slot("income", "quarterly", income).alias("qi"), slot("income", "annual", income).alias("ai"),
        slot("balance", "quarterly", balance).alias("qb"), slot("balance", "annual", balance).alias("ab"),
        slot("cashflow", "quarterly", cash).alias("qc"), slot("cashflow", "annual", cash).alias("ac"))


STATE_COLS = ["qi", "ai", "qb", "ab", "qc", "ac"]


def ps_points(periods: DataFrame, closes: DataFrame, company: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Price/sales of each period on its publication day, one column per freq."""
    inc = (periods.where((F.col("statement") == "income") & (F.col("revenue") > 0))
           .select("ticker", "freq", "revenue", F.date_add("period_end", cfg.lag_days).alias("published")))
    priced = asof_backward(inc, "ticker", "published", [Stream(closes, "date", ["close"])])
    ps = (F.col("close") * F.col("shares_used")
          / (F.col("revenue") * F.when(F.col("freq") == "quarterly", 4).otherwise(1)))
    return (priced.join(shares_used(company), "ticker")
            .select("ticker", "published", F.when(F.col("freq") == "quarterly", ps).alias("ps_q"),
                    F.when(F.col("freq") == "annual", ps).alias("ps_a")))


def shares_used(company: DataFrame) -> DataFrame:
    """Shares outstanding, else implied shares; zero counts as unknown."""
    known = F.coalesce(F.nullif("shares", F.lit(0.0)), F.nullif("implied_shares", F.lit(0.0)))
    return company.select("ticker", known.alias("shares_used"))


def ps_histories(points: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """``ps_seen``: the P/S points of the look-back as of each publication. The
    frames run over a ticker's publications alone, a few dozen rows."""
    day = F.datediff("published", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("ticker").orderBy(day).rangeBetween(-cfg.ps_history_days, 0)

    def seen(c: str) -> Column:
        point = F.when(F.col(c).isNotNull(), F.struct(F.col("published").alias("d"), F.col(c).alias("v")))
        return F.collect_list(point).over(w).alias(c)

    return points.select("ticker", "published", F.struct(seen("ps_q"), seen("ps_a")).alias("ps_seen"))


def ps_stream(histories: DataFrame) -> Stream:
    return Stream(histories, "published", ["ps_seen"])


def with_ps_hist(seen: DataFrame, as_of: str, cfg: Settings = DEFAULT) -> DataFrame:
    """Replaces the carried ``ps_seen`` by ``ps_hist``, without the points that
    have left the look-back since their publication."""
    start = F.date_sub(as_of, cfg.ps_history_days)

    def values(c: str) -> Column:
        inside = F.filter(F.col(f"ps_seen.{c}"), lambda x: x["d"] >= start)
        return F.coalesce(F.transform(inside, lambda x: x["v"]), F.array().cast("array<double>"))

    out = seen.withColumn("_q", values("ps_q")).withColumn("_a", values("ps_a"))
    annual = (F.size("_q") < 4) & (F.size("_a") > F.size("_q"))
    return out.withColumn("ps_hist", F.when(annual, F.col("_a")).otherwise(F.col("_q"))).drop("_q", "_a", "ps_seen")


def with_ps_history(grid: DataFrame, points: DataFrame, as_of: str = "as_of", cfg: Settings = DEFAULT) -> DataFrame:
    """Adds ``ps_hist``: the P/S points published in the look-back."""
    return with_ps_hist(asof_backward(grid, "ticker", as_of, [ps_stream(ps_histories(points, cfg))]), as_of, cfg)

