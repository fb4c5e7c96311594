"""Plans over the bucketed feature store do not shuffle the stored side."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import prices
from tidemark.operators.asof import Stream, asof_backward, asof_forward
from tidemark.plans import pipelines as plans
from tidemark.sources.panel import Panel
from tidemark.sources.sinks import stage, store

PATH = "/root/testdata/sf0.001"


def shuffles(df):
    """Exchanges of a plan but broadcasts."""
    return len(re.findall(r"Exchange (?:hash|range|Round|Single)", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture(scope="module")
def inputs(spark):
    p = Panel(spark, PATH)
    return plans.Inputs(store(p.bars(), "bars"), store(p.fundamentals(), "fundamentals", order="period_end"), p.universe(), p.company(),
                        stage(p.benchmark(), "benchmark"), p.vix())


def test_features_start_from_the_scan(spark, inputs):
    assert shuffles(prices.price_features(inputs.bars)) == 0
    assert shuffles(prices.price_features(Panel(spark, PATH).bars())) > 0


def test_asof_over_stored_tables_has_no_shuffle(spark, inputs):
    probe = plans.latest_days(inputs)
    assert shuffles(probe) == 0
    assert shuffles(asof_backward(probe, "ticker", "date", [inputs.states, Stream(inputs.features, "date", ["close", "ret_6m"])])) == 0
    assert shuffles(asof_forward(probe, inputs.bars, "ticker", "date", "open")) == 0
    fresh = spark.range(20).select(F.col("id").alias("ticker"), F.lit("2000-01-01").cast("date").alias("date"))
    # A probe from elsewhere may cost its own shuffle or one of the whole stack, never more.
    assert shuffles(asof_backward(fresh, "ticker", "date", [Stream(inputs.features, "date", ["close"])])) <= 1


def test_screens_shuffle_nothing_that_is_stored(inputs):
    inputs.market, inputs.momentum, inputs.ps_histories
    assert shuffles(plans.all_filters(inputs, plans.latest_days(inputs))) == 0
    grid = plans.quarter_grid(inputs.days)
    quarterly = plans.quarterly_panel(inputs)
    assert shuffles(quarterly) <= shuffles(grid) + 1  # the calendar's own, one row per day


def test_a_store_has_one_sorted_file_per_bucket(spark, inputs):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = inputs.bars.select(F.input_file_name().alias("f")).distinct().count()
    assert files <= n
    w = Window.partitionBy("f").orderBy("at")
    rows = inputs.bars.select("ticker", "date", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at"))
    wrong = rows.withColumn("before", F.lag(F.struct("ticker", "date")).over(w)).where(F.col("before") > F.struct("ticker", "date"))
    assert wrong.count() == 0
    assert inputs.bars.count() == Panel(spark, PATH).bars().count()
