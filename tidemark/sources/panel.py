"""Binds the star-schema tables to the equity-panel shapes the operators use.

``lineitem`` plays the price feed (damped unit price per supplier and ship
day) and the statements (sums per quarter); ``supplier``/``nation``/``region`` give
sectors and share counts; ``events`` gives snapshots and ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import quarter_end


def unit_price():
    """Ten times the eighth root of price per unit: raw unit prices spread over
    four orders of magnitude, square roots bring them to equity-like moves and
    round alike in every engine."""
    return F.sqrt(F.sqrt(F.sqrt(F.col("l_extendedprice") / F.col("l_quantity")))) * 10


# Intraday order of a supplier's lines.
SEQ = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


class Panel:
    """Lazy frames over one data directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def bars(self) -> DataFrame:
        """Daily OHLCV per supplier. Lines travel raw, spread by supplier and day, so a supplier with a third
        of all lines is on all reducers. Combining first would save nothing, as suppliers have about one line a
        day, and would sort all lines (ties are told by structs) in a few large map tasks, which spill."""
        raw = self.table("lineitem").select(
            F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), *SEQ,
            "l_quantity", "l_returnflag", "l_linestatus").repartition("ticker", "date")
        li = raw.withColumns({"px": unit_price(), "seq": F.struct(*SEQ)})
        return li.groupBy("ticker", "date").agg(
            F.min_by("px", "seq").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", "seq").alias("close"), F.sum("l_quantity").alias("volume"),
            F.max("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))

    def benchmark(self) -> DataFrame:
        """The last line's price of each day, whoever ships it."""
        last = F.struct(*SEQ, "l_suppkey")
        return self.table("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(
            F.max_by(unit_price(), last).alias("close"))

    def vix(self) -> DataFrame:
        """Volatility stand-in: 20-row deviation of the benchmark's return times 100."""
        w = Window.partitionBy("series").orderBy("date")
        b = self.benchmark().withColumn("series", F.lit("vix"))
        r = b.withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
        frame = w.rowsBetween(-19, 0)
        return (r.withColumn("vix", F.when(F.count("r").over(frame) >= 20, F.stddev_samp("r").over(frame) * 100))
                .where(F.col("vix").isNotNull()).select("date", "vix"))

    def calendar(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()

    def universe(self) -> DataFrame:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
                .select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"),
                        F.col("n_name").alias("index_name"), F.col("s_name").alias("name")))

    def company(self) -> DataFrame:
        """Share counts and reported figures; some entries are missing on purpose."""
        bal = F.col("s_acctbal")
        return self.table("supplier").select(
            F.col("s_suppkey").alias("ticker"),
            F.when(bal > 0, 100000.0 + F.col("s_suppkey")).alias("shares"),
            (90000.0 + F.col("s_suppkey")).alias("implied_shares"),
            F.when(bal > 5000, bal * 300).alias("reported_cap"),
            F.when(bal > 0, bal / 500).alias("pe_ratio"), F.when(bal > 0, bal / 2000).alias("ps_ratio"))

    def statements_wide(self) -> DataFrame:
        """One row per (supplier, freq, period): every canonical item as a column."""
        ext, disc = F.col("l_extendedprice"), F.col("l_discount")
        share = (F.when(F.col("l_returnflag") == "R", 0.2).when(F.col("l_returnflag") == "A", 0.5).otherwise(0.8))
        day = F.col("l_shipdate").cast("date")
        # Quarterly sums first; years are sums of quarters, so lines shuffle once.
        q = (self.table("lineitem")
             .groupBy(F.col("l_suppkey").alias("ticker"), quarter_end(day).alias("period_end"))
             .agg(F.sum(ext).alias("rev"), F.sum(ext * (1 - disc) * share).alias("gp"),
                  F.sum(ext * F.col("l_tax")).alias("tax")))
        a = (q.groupBy("ticker", F.make_date(F.year("period_end"), F.lit(12), F.lit(31)).alias("period_end"))
             .agg(F.sum("rev").alias("rev"), F.sum("gp").alias("gp"), F.sum("tax").alias("tax")))
        both = (q.withColumn("freq", F.lit("quarterly")).withColumn("k", F.lit(1.0))
                .unionByName(a.withColumn("freq", F.lit("annual")).withColumn("k", F.lit(4.0))))
        bal = self.table("supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_acctbal").alias("bal"))
        rev, gp, tax = F.col("rev"), F.col("gp"), F.col("tax")
        ebit = gp - rev * 0.35
        assets = rev / F.col("k") * 2 + F.col("bal") * 100
        return both.join(bal, "ticker").select(
            "ticker", "freq", "period_end",
            rev.alias("Total Revenue"), gp.alias("Gross Profit"), ebit.alias("Operating Income"),
            (ebit - tax - rev * 0.01).alias("Net Income"),
            F.when(tax > rev * 0.035, tax / rev * 5).alias("Tax Rate For Calcs"),
            (ebit + tax * 1.5 - rev * 0.03).alias("Operating Cash Flow"),
            (tax * 0.5 - rev * 0.03).alias("Capital Expenditure"),
            (assets * 0.25 + rev / F.col("k") * 0.1).alias("Total Debt"),
            (assets * 0.4 - F.col("bal") * 50).alias("Stockholders Equity"),
            assets.alias("Total Assets"), (rev / F.col("k") * 0.5).alias("Current Liabilities"),
            (F.col("bal") * 20).alias("Cash And Cash Equivalents"))

    def fundamentals(self) -> DataFrame:
        """Long statements ``(ticker, freq, statement, period_end, item, value)``."""
        from tidemark.operators.statements import to_long
        return to_long(self.statements_wide())

    def trades(self, bars: DataFrame | None = None) -> DataFrame:
        """Entry and exit on consecutive bars of a supplier, moves damped to one tenth. With bars stored by
        ticker this is a window on the scan, without a shuffle."""
        w = Window.partitionBy("ticker").orderBy("date")
        nxt, x = F.lead("close").over(w), F.col("close")
        b = (self.bars() if bars is None else bars).select(
            "ticker", F.when(F.col("flag") == "R", "crash").otherwise("qvm").alias("tier"),
            F.col("date").alias("entry_date"), x.alias("entry_price"),
            F.lead("date").over(w).alias("exit_date"), ((nxt - x) / (nxt + x) * 0.1).alias("r"),
            F.when(F.col("status") == "O", "qvm_rebalance").otherwise("atr_trailing_stop").alias("reason"))
        return b.select(
            "ticker", "tier", "entry_date", "entry_price", "exit_date",
            (F.col("entry_price") * (1 + F.col("r"))).alias("exit_price"),
            F.col("r").alias("return_dec"), (F.col("r") * 100).alias("return_pct"),
            (F.col("r") * 100000).alias("pnl_dollars"),
            F.date_diff("exit_date", "entry_date").cast("bigint").alias("hold_days"),
            F.when(F.col("exit_date").isNull(), "backtest_end").otherwise(F.col("reason")).alias("exit_reason"))

    def scores(self) -> DataFrame:
        """Daily score per user: 7 for one event, two more for each further one, at most 12."""
        return (self.table("events")
                .groupBy(F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("date"))
                .agg(F.least(F.count(F.lit(1)) * 2 + 5, F.lit(12)).alias("score")))

    def side_inputs(self) -> DataFrame:
        """Sentiment and regime per day; quiet days have none."""
        return (self.table("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"))
                .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("a"),
                     F.count_if(F.col("l_returnflag") == "R").alias("r"))
                .where(F.col("n") >= 10)
                .select("date", (F.col("a") / F.col("n") * 100).alias("sentiment"),
                        F.when(F.col("r") / F.col("n") > 0.5, "RED").otherwise("GREEN").alias("regime")))

    def inputs(self, **kw):
        from tidemark.plans.pipelines import Inputs
        return Inputs(self.bars(), self.fundamentals(), self.universe(), self.company(),
                      self.benchmark(), self.vix(), **kw)
