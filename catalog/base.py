"""Registry plumbing: output shapes shared by a query and its SQL twin, and a
workspace that stages the tables many queries build on."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import statements
from tidemark.plans import pipelines as plans
from tidemark.sources.panel import Panel
from tidemark.sources.sinks import children, stage, store


class Workspace:
    """Shared frames of one data directory: the daily bars, the feature store
    and the quarterly panel are staged on first use, as a nightly job would."""

    _open: dict[tuple[str, str], tuple[list, "Workspace"]] = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.panel = Panel(spark, path)

    @classmethod
    def of(cls, spark: SparkSession, path: str) -> "Workspace":
        """The workspace of a data directory; a new one if its files have changed."""
        key, files = (spark.sparkContext.applicationId, path), children(spark, path)
        if key not in cls._open or cls._open[key][0] != files:
            cls._open[key] = (files, cls(spark, path))
        return cls._open[key][1]

    @cached_property
    def bars(self) -> DataFrame:
        return store(self.panel.bars(), "bars")

    @cached_property
    def inputs(self) -> plans.Inputs:
        p = self.panel
        return plans.Inputs(self.bars, store(p.fundamentals(), "fundamentals", order="period_end"), p.universe(), p.company(),
                            stage(p.benchmark(), "benchmark"), p.vix())

    @cached_property
    def quarters(self) -> DataFrame:
        return stage(plans.quarter_grid(self.inputs.days), "quarters")

    @cached_property
    def quarterly(self) -> DataFrame:
        return stage(plans.quarterly_panel(self.inputs), "quarterly")

    @cached_property
    def latest(self) -> DataFrame:
        """All twelve filters on each ticker's last day."""
        return stage(plans.all_filters(self.inputs, plans.latest_days(self.inputs)), "latest")

    @cached_property
    def scores(self) -> DataFrame:
        return stage(plans.ranking.qvm_scores(plans.watchlists(self.quarterly)), "scores")

    @cached_property
    def signals(self) -> DataFrame:
        return stage(plans.entry_signals(self.inputs, plans.watchlists(self.quarterly), self.quarters), "signals")

    @cached_property
    def trades(self) -> DataFrame:
        """Made anew from the stored bars by each use: one window on their scan costs less than a table of its own."""
        return self.panel.trades(self.bars)

    @cached_property
    def entries(self) -> DataFrame:
        """Entries at every quarter's effective day, both tiers."""
        from catalog.screen_queries import entries
        return stage(entries(self), "entries")

    @cached_property
    def resolved_trades(self) -> DataFrame:
        """Entries with their exits, as the trade table."""
        from catalog.screen_queries import resolved
        from tidemark.operators.exits import trade_table
        return stage(trade_table(resolved(self)), "resolved")

    @cached_property
    def sim_stats(self) -> DataFrame:
        """Per-simulation statistics of the bootstrap."""
        from catalog.analytics_queries import sims
        return stage(sims(self), "sims")

    @cached_property
    def walk(self) -> DataFrame:
        from catalog.analytics_queries import wf
        return stage(wf(self), "walk-forward")

    @cached_property
    def thesis(self) -> DataFrame:
        return stage(plans.thesis_states(self.inputs), "thesis")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _fields(shape: str) -> list[tuple[str, str]]:
    """``name`` as it is, ``name!`` as BIGINT, ``name:4`` rounded to 4 digits."""
    out = []
    for token in shape.split():
        m = re.fullmatch(r"(\w+)(?:(!)|:(\d+))?", token)
        out.append((m[1], "!" if m[2] else (m[3] or "")))
    return out


def shaped(df: DataFrame, shape: str) -> DataFrame:
    cols = []
    for name, kind in _fields(shape):
        c = F.col(name)
        if kind == "!":
            c = c.cast("bigint")
        elif kind:
            c = F.floor(c * 10.0 ** int(kind) + 0.5) / 10.0 ** int(kind)
        cols.append(c.alias(name))
    return df.select(*cols)


def shaped_sql(body: str, shape: str) -> str:
    from catalog.sql import with_ctes
    cols = []
    for name, kind in _fields(shape):
        c = name
        if kind == "!":
            c = f"CAST({name} AS BIGINT)"
        elif kind:
            # 1eN literals are DOUBLE in DuckDB, as on the Spark side.
            c = f"floor({name} * 1e{kind} + 0.5) / 1e{kind}"
        cols.append(f"{c} AS {name}")
    return with_ctes(f"SELECT {', '.join(cols)} FROM ({body}) AS result")


def query(name: str, shape: str, sql: str | None):
    def register(fn: Callable[[Workspace], DataFrame]):
        QUERIES[name] = lambda spark, path: shaped(fn(Workspace.of(spark, path)), shape)
        if sql is not None:
            ORACLE[name] = shaped_sql(sql, shape)
        return fn
    return register
