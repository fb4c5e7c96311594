"""First day on which a close falls through a level under the running peak since entry.

``stop_days`` finds, for every (ticker, entry), the first bar at which ``close < peak * (1 - fixed)`` and the first bar
of some age at which ``close < peak - k * ATR``, the peak being the highest close since entry. Expanding an entry to all
its later bars costs entries x calendar. Here the bars of a ticker are cut into blocks of ``BLOCK`` bars, and a block's
summary tells whether it can hold the breach:

* with the peak of its own bars alone: a flag, as a higher peak only breaks more;
* with a peak brought from before: its lowest close, or its lowest ``close + k * ATR``, lies below that peak's level.

A ticker's summaries travel as one array (bounded by the calendar over ``BLOCK``). A fold over them carries the peak and
names the blocks to open: the entry's own, the one in which it comes of age, the one of ``until``, and for either rule
the first that breaks. Only these are joined with bars, so an entry visits at most five blocks. The ATR rule compares
rounded sums; a block within ``_NEAR`` of the level is opened and the fold goes on, so rounding cannot hide a breach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Settings

#: Bars of a block; relative distance within which the sums of the ATR rule may be rounded apart.
BLOCK, _NEAR = 64, 1e-12


def blocked(bars: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Bars ``(ticker, date, close, atr)`` with their block, the block's peak up to each bar, and from each bar on."""
    order = Window.partitionBy("ticker").orderBy("date")
    inside = Window.partitionBy("ticker", "block").orderBy("date")
    rows = bars.where(F.col("close").isNotNull()).select("ticker", "date", "close", "atr")
    return (rows.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int"))
            .withColumn("peak_in", F.max("close").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("peak_on", F.max("close").over(inside.rowsBetween(0, Window.unboundedFollowing))))


def _fixed(close: Column, peak: Column, cfg: Settings) -> Column:
    return close < peak * (1 - cfg.trailing_stop)


def _by_atr(close: Column, peak: Column, atr: Column, cfg: Settings) -> Column:
    return close < peak - cfg.atr_multiple * atr


def summaries(rows: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """One row per ticker: its blocks in order."""
    c = F.col
    blocks = rows.groupBy("ticker", "block").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.max("close").alias("peak"), F.min("close").alias("low"),
        F.min(c("close") + cfg.atr_multiple * c("atr")).alias("need"),
        F.coalesce(F.bool_or(_fixed(c("close"), c("peak_in"), cfg)), F.lit(False)).alias("breaks"),
        F.coalesce(F.bool_or(_by_atr(c("close"), c("peak_in"), c("atr"), cfg)), F.lit(False)).alias("breaks_atr"))
    fields = [x for x in blocks.columns if x != "ticker"]
    return blocks.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("blocks"))


def _opened(cfg: Settings) -> Column:
    """The blocks to open of an entry, with the peak before each, from the summaries after its own block."""
    none = F.array().cast("array<struct<block:int,carry:double>>")
    start = F.struct(F.col("own.peak_on").alias("peak"), none.alias("open"), F.lit(False).alias("fixed"), F.lit(False).alias("atr"),
                     F.lit(None).cast("double").alias("top"), F.lit(None).cast("date").alias("end"))
    of_age = F.date_add("entry_date", cfg.stop_grace_days)
    until = F.coalesce("until", F.lit("9999-12-31").cast("date"))

    def step(s: Column, b: Column) -> Column:
        fixed = ~s["fixed"] & (b["breaks"] | _fixed(b["low"], s["peak"], cfg))
        gap, near = s["peak"] - b["need"], _NEAR * (F.abs(s["peak"]) + F.abs(b["need"]))
        young = b["first"] < of_age
        sure = b["breaks_atr"] | F.coalesce(gap > near, F.lit(False))
        perhaps = F.coalesce(gap > -near, F.lit(False))
        atr = ~s["atr"] & (b["last"] >= of_age) & (sure | perhaps)
        partial = (b["first"] <= until) & (b["last"] > until)
        take = (b["first"] <= until) & (fixed | atr | partial)
        whole = b["last"] <= until
        return F.struct(
            F.greatest(s["peak"], b["peak"]).alias("peak"),
            F.when(take, F.concat(s["open"], F.array(F.struct(b["block"].alias("block"), s["peak"].alias("carry"))))).otherwise(s["open"]).alias("open"),
            (s["fixed"] | fixed).alias("fixed"),
            (s["atr"] | (atr & sure & ~young)).alias("atr"),
            F.when(whole, F.greatest(s["top"], b["peak"])).otherwise(s["top"]).alias("top"),
            F.when(whole, F.greatest(s["end"], b["last"])).otherwise(s["end"]).alias("end"))

    return F.aggregate(F.filter("blocks", lambda b: b["block"] > F.col("own.block")), start, step)


def stop_days(pairs: DataFrame, bars: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """``trailing_date``, ``atr_date``, ``peak_close`` and ``last_bar`` of each (ticker, entry_date[, until]) of ``pairs``.

    ``bars`` carry ``atr``. Entries without a bar on or after their day (and up to ``until``) have no row.
    The blocked bars are stored by ticker once, as three steps read them.
    """
    from tidemark.operators.asof import asof_forward
    from tidemark.sources.sinks import store

    keys = ["ticker", "entry_date"]
    if "until" not in pairs.columns:
        pairs = pairs.withColumn("until", F.lit(None).cast("date"))
    rows = store(blocked(bars, cfg), "blocks", placed=True)
    own = rows.withColumn("own", F.struct("block", "peak_on"))
    placed = asof_forward(pairs, own, "ticker", "entry_date", "own", strict=False).where(F.col("own").isNotNull())
    found = placed.join(summaries(rows, cfg), "ticker").withColumn("found", _opened(cfg))
    mine = F.array(F.struct(F.col("own.block").alias("block"), F.lit(None).cast("double").alias("carry")))
    visits = found.select(*keys, "until", "found.top", "found.end", F.explode(F.concat(mine, "found.open")).alias("visit"))
    seen = (visits.select(*keys, "until", "top", "end", "visit.block", "visit.carry")
            .join(rows.select("ticker", "block", "date", "close", "atr"), ["ticker", "block"])
            .where((F.col("date") >= F.col("entry_date")) & (F.col("until").isNull() | (F.col("date") <= F.col("until")))))
    w = Window.partitionBy(*keys, "block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest("carry", F.max("close").over(w))
    c = F.col
    aged = F.datediff("date", "entry_date") >= cfg.stop_grace_days
    return seen.withColumn("peak", peak).groupBy(*keys).agg(
        F.min(F.when(_fixed(c("close"), c("peak"), cfg), c("date"))).alias("trailing_date"),
        F.min(F.when(aged & _by_atr(c("close"), c("peak"), c("atr"), cfg), c("date"))).alias("atr_date"),
        F.greatest(F.max("peak"), F.max("top")).alias("peak_close"),
        F.greatest(F.max("date"), F.max("end")).alias("last_bar"))
