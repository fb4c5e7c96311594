"""Incremental scan: the twelve filters on new bars, from keyed state instead of history.

A delivery is a set of *events* of days that follow those delivered before: bars, statement states on their publication
day, and the sales that a P/S point needs. The stream groups them by ticker; the state of a ticker is what its next rows
can depend on and nothing else: EMA levels, the closes of one year, the last complete feature row, the last statement
state of each kind, and the P/S points of the look-back. So a batch reads its own events and the state of its own
tickers, whatever the length of history; the first delivery may be the whole history.

What crosses tickers (the momentum rank inside a sector and day, the market's fear regime) is added per batch, so all
bars of a day come in one delivery. A bar at or before its ticker's last day is ignored. A ticker has features from its
``min_history``-th close on; the batch plan, which sees all closes, has them from the first.

State lives in the checkpoint of the stream, in RocksDB, and a batch that is run again after a failure replaces its own
output.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.config import DEFAULT, Settings
from tidemark.operators.prices import TS, sector_momentum
from tidemark.operators.statements import STATE_COLS, shares_used
from tidemark.plans.pipelines import Inputs, finish_timing, with_all_filters
from tidemark.sources.sinks import new_path
from tidemark.streaming.streams import rocksdb, run_batches

EVENTS = "date date, close double, slot string, state string, freq string, sales double, shares double"
#: Columns of the last complete feature row, in the order of the state's array.
ROW = ["close_row", "high_52w", "zscore", "ema_50", "ret_12_1", "mean_52w", "sd_52w"]
STATE = ("n long, day date, ema_50 double, ema_200 double, closes array<double>, row array<double>, ret_6m double, "
         "slots array<string>, point_days array<int>, point_freqs array<string>, points array<double>")
OUT = "date date, " + ", ".join(f"{c} double" for c in [*ROW, "close", "ret_6m", "ret_now"]) + ", " + \
    ", ".join(f"{c} string" for c in [*STATE_COLS, "ps_seen"])


def scan_events(bars: DataFrame, states: DataFrame, periods: DataFrame, company: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Bars, statement states and sales as rows ``(ticker, date, ...)`` of one table."""
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in EVENTS.split(", ")}

    def part(df: DataFrame, date: str, **own: Column) -> DataFrame:
        given = none | own | {"date": F.col(date)}
        return df.select("ticker", *[given[c].alias(c) for c in none])

    out = part(bars.where(F.col("close").isNotNull()), "date", close=F.col("close"))
    for c in STATE_COLS:
        out = out.unionByName(part(states.where(F.col(c).isNotNull()), "published", slot=F.lit(c), state=F.to_json(c)))
    sold = (periods.where((F.col("statement") == "income") & (F.col("revenue") > 0)).join(shares_used(company), "ticker")
            .withColumn("published", F.date_add("period_end", cfg.lag_days)))
    sales = F.col("revenue") * F.when(F.col("freq") == "quarterly", 4).otherwise(1)
    return out.unionByName(part(sold, "published", freq=F.col("freq"), sales=sales, shares=F.col("shares_used")))


def _features(before: np.ndarray, new: np.ndarray, cfg: Settings) -> dict[str, np.ndarray]:
    """Trailing figures of each new close; NaN where there is too little history. ``before`` are the latest closes."""
    year, closes = cfg.year_rows, np.concatenate((before, new))
    padded = np.concatenate((np.full(year, np.nan), closes))
    frames = np.lib.stride_tricks.sliding_window_view(padded, year)[-len(new):]
    known = np.minimum(np.arange(len(before), len(closes)) + 1, year)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # frames of one close have no deviation
        high, mean, sd = np.nanmax(frames, 1), np.nanmean(frames, 1), np.nanstd(frames, 1, ddof=1)
        sd = np.where(high == np.nanmin(frames, 1), 0.0, sd)
    for figure in (high, mean, sd):
        figure[known < cfg.warmup_rows] = np.nan

    def lag(n: int) -> np.ndarray:
        return padded[len(padded) - len(new) - n : len(padded) - n]

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)

    return {"high": high, "mean": mean, "sd": sd, "zscore": share(new - mean, sd),
            "ret_12_1": share(lag(cfg.month_rows), lag(year)) - 1, "ret_6m": share(new, lag(cfg.half_year_rows)) - 1}


def _known(x) -> bool:
    return x is not None and x == x


def _none(x: float) -> float | None:
    return None if x is None or x != x else float(x)


def step(cfg: Settings, since):
    """The update of one ticker: its events in, a row for each new bar from day ``since`` on out."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, day, ema50, ema200, closes, row, ret6, slots, p_days, p_freqs, points = state.get if state.exists else (
            0, None, None, None, [], [], None, [None] * len(STATE_COLS), [], [], [])
        slots, p_days, p_freqs, points = list(slots), list(p_days), list(p_freqs), list(points)
        events = pd.concat(parts).sort_values("date", kind="stable")
        bars = events[events.close.notna()].drop_duplicates("date")
        bars = bars[bars.date > day] if day is not None else bars
        figures = _features(np.array(closes, float), bars.close.to_numpy(float), cfg) if len(bars) else {}
        at = {d: k for k, d in enumerate(bars.date)}
        new, out = bars.close.to_numpy(float), []
        fast, slow = 2.0 / 51, 2.0 / 201
        last = closes[-1] if closes else None
        # Plain values, taken out once: pandas would spend most of the time on selecting the few rows of each day.
        dated = events[events.date.notna()]
        rows = zip(*(dated[c].tolist() for c in ("date", "slot", "state", "freq", "sales", "shares")))
        for date, some in groupby(rows, key=itemgetter(0)):
            some, k = list(some), at.get(date)
            if k is not None:  # the day's close is known before its publications
                x = float(new[k])
                ema50, ema200 = (x, x) if n == 0 else (fast * x + (1 - fast) * ema50, slow * x + (1 - slow) * ema200)
                n, day, last = n + 1, date, x
                f = {c: float(v[k]) for c, v in figures.items()}
                if all(f[c] == f[c] for c in ("high", "zscore", "ret_12_1", "ret_6m")):
                    row = [x, f["high"], f["zscore"], ema50, f["ret_12_1"], f["mean"], f["sd"]]
                ret6 = ret6 if f["ret_6m"] != f["ret_6m"] else f["ret_6m"]
            for _, slot, filed, _, _, _ in some:
                if _known(slot):
                    slots[STATE_COLS.index(slot)] = filed
            for _, _, _, freq, sales, shares in some:
                if _known(sales) and last is not None and _known(shares):
                    p_days.append((date - pd.Timestamp("1970-01-01").date()).days)
                    p_freqs.append(freq)
                    points.append(last * shares / sales)
            if k is not None and n >= cfg.min_history and (since is None or date >= since):
                begin = (date - pd.Timestamp("1970-01-01").date()).days - cfg.ps_history_days
                seen = {f"ps_{q[0]}": [{"d": str(pd.Timestamp(d, unit="D").date()), "v": v} for d, g, v in zip(p_days, p_freqs, points) if g == q and d >= begin]
                        for q in ("quarterly", "annual")}
                out.append((key[0], date, *(row or [None] * len(ROW)), x, ret6, _none(f["ret_12_1"]), *slots, json.dumps(seen)))
        if day is not None and points:  # points that no later row can see
            first = (day - pd.Timestamp("1970-01-01").date()).days - cfg.ps_history_days
            kept = [k for k, d in enumerate(p_days) if d >= first]
            p_days, p_freqs, points = ([v[k] for k in kept] for v in (p_days, p_freqs, points))
        closes = [float(c) for c in np.concatenate((closes, new))[-cfg.year_rows:]]
        state.update((n, day, ema50, ema200, closes, row, ret6, slots, p_days, p_freqs, points))
        if out:
            yield pd.DataFrame(out, columns=["ticker", *[c.split()[0] for c in OUT.split(", ")]])

    return update


def scan_rows(events: DataFrame, cfg: Settings = DEFAULT, since=None) -> DataFrame:
    """A row for each new bar, with its features and the statement states in force, from keyed state."""
    kind = events.schema["ticker"].dataType.simpleString()
    return events.groupBy("ticker").applyInPandasWithState(
        step(cfg, since), f"ticker {kind}, {OUT}", STATE, "append", GroupStateTimeout.NoTimeout)


def incremental_scan(events: DataFrame, states: DataFrame, universe: DataFrame, company: DataFrame, market: DataFrame,
                     cfg: Settings = DEFAULT, since=None, root: str | None = None) -> DataFrame:
    """Drains the new events; all scan rows so far. ``root`` keeps checkpoint, state and rows between deliveries.

    ``states`` only lends the types of its statement columns; ``market`` holds one row per day. Rows before ``since``
    build the state and are not scanned.
    """
    spark = events.sparkSession
    root = root or new_path(spark, "scan")
    types = {c: states.schema[c].dataType.simpleString() for c in STATE_COLS}
    points = "struct<ps_q:array<struct<d:date,v:double>>,ps_a:array<struct<d:date,v:double>>>"
    inp = Inputs(None, None, universe, company, None, None, cfg=cfg)
    inp.__dict__["market"] = market

    def batch_step(batch: DataFrame, batch_id: int, root: str) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")
        rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{root}/rows/batch={batch_id}")
        ranks = sector_momentum(rows.select("ticker", TS, F.col("ret_now").alias("ret_12_1")), universe)
        seen = rows.drop("ret_now").join(ranks.select("ticker", TS, "momentum_rank"), ["ticker", TS], "left")
        seen = seen.withColumns({c: F.from_json(c, t) for c, t in types.items()} | {"ps_seen": F.from_json("ps_seen", points)})
        filed = F.greatest(*[F.col(c).isNotNull() for c in STATE_COLS])
        scanned = with_all_filters(inp, finish_timing(inp, seen.where(filed), TS))
        scanned.drop("ps_hist").write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    with rocksdb(spark):
        run_batches(scan_rows(events, cfg, since), "scan", batch_step, root)
    return spark.read.parquet(f"{root}/out").drop("batch")
