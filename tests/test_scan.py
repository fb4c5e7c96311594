"""The incremental scan against the batch plan over the same bars."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.plans import pipelines as plans
from tidemark.sources.panel import Panel
from tidemark.streaming import scan

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    return Panel(spark, PATH).inputs()


@pytest.fixture(scope="module")
def events(spark, inputs):
    from tidemark.sources.sinks import stage
    return stage(scan.scan_events(inputs.bars, inputs.states.frame, inputs.periods, inputs.company), "events")


def deliver(spark, inputs, events, root, source, cuts, since):
    """One run per stretch of days; the rows so far, and how many events each batch read."""
    read = []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        new = events.where((F.lit(lo).isNull() | (F.col("date") >= F.lit(lo))) & (F.lit(hi).isNull() | (F.col("date") < F.lit(hi))))
        new.write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        out = scan.incremental_scan(stream, inputs.states.frame, inputs.universe, inputs.company, inputs.market, since=since, root=root)
        read.append(new.count())
    return out, read


def rows_of(df, columns):
    return {(r.ticker, r.date): tuple(None if v is None else round(v, 8) if isinstance(v, float) else v for v in r[2:])
            for r in df.select("ticker", "date", *columns).collect()}


def test_rows_of_many_deliveries_equal_the_batch_plan(spark, inputs, events, tmp_path):
    days = sorted(r.date for r in inputs.days.collect())[-60:]
    cuts = [days[0], days[1], days[20], days[45]]
    out, _ = deliver(spark, inputs, events, str(tmp_path / "root"), str(tmp_path / "in"), cuts, days[0])
    probe = inputs.bars.where(F.col("close").isNotNull() & (F.col("date") >= F.lit(days[0]))).select("ticker", "date").join(plans.eligible(inputs), "ticker", "left_semi")
    want = plans.all_filters(inputs, probe)
    columns = ["close_row", "close", "ret_6m", "high_52w", "zscore", "ema_50", "ret_12_1", "mean_52w", "sd_52w", "momentum_rank", "g1", "gm0", "roic",
               "ps", "ps_n", "ps_pct", "ps_threshold", "vix", "fear_count", *plans.filters.QUALITY, *plans.filters.TIMING, "quality_pass", "entry_pass", "all_pass"]
    got, want = rows_of(out, columns), rows_of(want, columns)
    assert len(want) > 100 and got.keys() == want.keys()
    for key, row in want.items():
        assert got[key] == pytest.approx(row, rel=1e-7, abs=1e-9), key


def test_no_batch_reads_old_bars(spark, inputs, events, tmp_path):
    days = sorted(r.date for r in inputs.days.collect())[-8:]
    root, source = str(tmp_path / "root"), str(tmp_path / "in")

    def run(new):
        new.write.mode("append").parquet(source)
        return scan.incremental_scan(spark.readStream.schema(events.schema).parquet(source), inputs.states.frame, inputs.universe,
                                     inputs.company, inputs.market, since=days[0], root=root)

    assert run(events.where(F.col("date") < F.lit(days[0]))).count() == 0
    for part in (tmp_path / "in").glob("part-*"):  # history is out of reach from now on
        part.write_bytes(b"unreadable")
    later = events.where(F.col("date") >= F.lit(days[0]))
    assert run(later).count() == later.where("close IS NOT NULL").count() > 0


def test_features_of_one_ticker_equal_pandas():
    rng = np.random.default_rng(1)
    closes = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 700)))
    closes[300:600] = 50.0  # flat: no deviation
    s = pd.Series(closes)
    whole = scan._features(np.zeros(0), closes, scan.DEFAULT)
    roll = s.rolling(252, min_periods=120)
    sd = roll.std().where(roll.max() != roll.min(), 0.0).where(roll.count() >= 120)
    for name, want in {"high": roll.max(), "mean": roll.mean(), "ret_12_1": s.shift(21) / s.shift(252) - 1, "ret_6m": s / s.shift(126) - 1}.items():
        np.testing.assert_allclose(whole[name], want.to_numpy(), rtol=1e-9, err_msg=name)
    np.testing.assert_allclose(whole["sd"], sd.to_numpy(), rtol=1e-6, atol=1e-6)
    assert np.isnan(whole["zscore"][560])
    for cut in (1, 251, 252, 253, 600):  # the same from a state of one year
        part = scan._features(closes[max(0, cut - 252):cut], closes[cut:], scan.DEFAULT)
        for name in part:
            np.testing.assert_allclose(part[name], whole[name][cut:], rtol=1e-9, err_msg=name)


def test_late_and_repeated_bars_are_ignored_and_empty_deliveries_change_nothing(spark, inputs, events, tmp_path):
    days = sorted(r.date for r in inputs.days.collect())[-4:]
    root, source = str(tmp_path / "root"), str(tmp_path / "in")

    def run(new):
        new.write.mode("append").parquet(source)
        return scan.incremental_scan(spark.readStream.schema(events.schema).parquet(source), inputs.states.frame, inputs.universe,
                                     inputs.company, inputs.market, since=days[0], root=root).count()

    n = run(events)
    assert n > 0 and run(events.limit(0)) == n
    assert run(events.where("close IS NOT NULL").where(F.col("date") >= F.lit(days[0]))) == n


def test_a_ticker_with_a_long_history_costs_little_per_day():
    import time

    class State:
        exists = False

        def update(self, value):
            self.get, self.exists = value, True

    days = [dt.date(2015, 1, 1) + dt.timedelta(d) for d in range(2000)]
    rows = [(d, 10.0 + k % 7, None, None, None, np.nan, np.nan) for k, d in enumerate(days)]
    rows += [(d, np.nan, scan.STATE_COLS[0], f'{{"k": {k}}}', None, np.nan, np.nan) for k, d in enumerate(days[::90])]
    rows += [(d, np.nan, None, None, "quarterly", 100.0 + k, 5.0) for k, d in enumerate(days[::90])]
    events = pd.DataFrame(rows, columns=["date", "close", "slot", "state", "freq", "sales", "shares"])
    state, begin = State(), time.process_time()
    out = pd.concat(scan.step(scan.DEFAULT, days[-1])((1,), iter([events]), state))
    assert time.process_time() - begin < 1.5  # some 4 s when each day was selected by pandas
    assert out.date.tolist() == [days[-1]] and out[scan.STATE_COLS[0]].tolist() == ['{"k": 22}']
    assert state.get[0] == 2000 and state.get[10][-1] == (10.0 + 1980 % 7) * 5 / 122
