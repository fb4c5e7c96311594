"""Statement metrics as column expressions over the as-of statement states
(``qi``/``ai`` income, ``qb``/``ab`` balance, ``qc``/``ac`` cash flow) and the
market columns ``close`` and ``shares_used``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Settings
from tidemark.functions.columns import array_percentile, clamp, growth, ratio


def chosen(kind: str, k: int) -> tuple[Column, Column]:
    """Quarterly state with at least ``k`` periods, else the annual state, and
    the name of the choice."""
    q, a = F.col(f"q{kind}"), F.col(f"a{kind}")
    enough = q["n"] >= k
    freq = F.when(enough, "quarterly").when(a.isNotNull(), "annual").otherwise("none")
    return F.when(enough, q).otherwise(a), freq


def growth_pair() -> tuple[Column, Column]:
    q, a = F.col("qi"), F.col("ai")
    quarterly = (q["n"] >= 5) & q["has_revenue"]
    annual = (a["n"] >= 2) & a["has_revenue"]
    return (F.when(quarterly, q["g1"]).when(annual, a["g1"]),
            F.when(quarterly, q["g2"]).when(annual, a["g2"]))


def growth_known() -> Column:
    q, a = F.col("qi"), F.col("ai")
    return F.coalesce((q["n"] >= 5) & q["has_revenue"], F.lit(False)) | \
        F.coalesce((a["n"] >= 2) & a["has_revenue"], F.lit(False))


def falling_periods() -> Column:
    q, a = F.col("qi"), F.col("ai")
    return (F.when((q["n"] >= 5) & q["has_revenue"], q["falling"])
            .when((a["n"] >= 2) & a["has_revenue"], a["falling"]).otherwise(F.lit(0)).cast("bigint"))


def margin_pair() -> tuple[Column, Column]:
    i, _ = chosen("i", 2)
    ok = i["has_revenue"] & i["has_gross"]
    return F.when(ok, i["gm0"]), F.when(ok & (i["n"] >= 2), i["gm1"])


def _ttm(item: str, k: int) -> Column:
    i, _ = chosen("i", k)
    return F.when(i["has_" + item], i[item + "_ttm"])


def roic(cfg: Settings = DEFAULT) -> Column:
    i, _ = chosen("i", 4)
    b, _ = chosen("b", 1)
    rate = F.when(i["tax_rate"] > 1, i["tax_rate"] / 100).otherwise(i["tax_rate"])
    rate = F.coalesce(clamp(rate, 0.0, cfg.tax_ceiling), F.lit(cfg.default_tax))
    rate = F.when(i["tax_rate"].isNull(), F.lit(cfg.default_tax)).otherwise(rate)
    capital = b["assets"] - b["current_liabilities"] - F.coalesce(b["cash"], F.lit(0.0)) * 0.5
    return F.when(capital > 0, _ttm("ebit", 4) * (1 - rate) / capital)


def leverage() -> Column:
    b, _ = chosen("b", 1)
    return ratio(b["debt"], F.abs(b["equity"]))


def free_cash_flow() -> Column:
    c, _ = chosen("c", 4)
    spent = F.when(c["capex"] > 0, -c["capex"]).otherwise(c["capex"])
    return F.when(c["has_ocf"], c["ocf"] + spent)


def runway_months() -> Column:
    b, _ = chosen("b", 1)
    c, _ = chosen("c", 1)
    months = F.when(c["ocf"] < 0, b["cash"] / (-c["ocf"] / 12)).otherwise(F.lit(999.0))
    return F.when(b["cash"].isNotNull() & c["has_ocf"], months)


def enterprise_value() -> Column:
    b, _ = chosen("b", 1)
    return F.col("market_cap") + F.coalesce(b["debt"], F.lit(0.0)) - F.coalesce(b["cash"], F.lit(0.0))


def gross_over_assets() -> Column:
    b, _ = chosen("b", 1)
    return F.when(b["assets"] > 0, _ttm("gross", 4) / b["assets"])


def quality_score() -> Column:
    """Seven yes/no points on profitability, cash, leverage and efficiency."""
    i, _ = chosen("i", 4)
    b, _ = chosen("b", 1)
    c, _ = chosen("c", 4)
    assets, before = b["assets"], b["assets_prior"]
    roa = ratio(i["net_ttm"], assets)
    gross = i["has_gross"]
    points = [
        roa > 0,
        c["ocf"] > 0,
        (before > 0) & (roa > ratio(i["net_prior"], before)),
        c["ocf"] > i["net_ttm"],
        (before > 0) & (ratio(b["debt"], assets) <= ratio(b["debt_prior"], before)),
        gross & (i["revenue_ttm"] > 0) & (i["revenue_prior"] > 0)
        & (ratio(i["gross_ttm"], i["revenue_ttm"]) > ratio(i["gross_prior"], i["revenue_prior"])),
        (before > 0) & (ratio(i["revenue_ttm"], assets) > ratio(i["revenue_prior"], before)),
    ]
    total: Column = F.lit(0)
    for p in points:
        total = total + F.coalesce(p.cast("int"), F.lit(0))
    usable = (i["has_net"] & i["has_revenue"] & b["has_assets"] & c["has_ocf"]
              & (assets.isNull() | (assets > 0)))
    return F.when(usable, total.cast("bigint"))


def peg(pe: Column) -> Column:
    q, a = F.col("qi"), F.col("ai")

    def from_growth(now: Column, before: Column) -> Column:
        g = growth(now, before)
        return F.when((before > 0) & (g > 0), pe / (g * 100))

    quarterly = F.when((q["n"] >= 8) & q["has_net"], from_growth(q["net_ttm"], q["net_prior"]))
    annual = F.when((a["n"] >= 2) & a["has_net"], from_growth(a["net_ttm"], a["net_prior"]))
    return F.when(pe > 0, F.coalesce(quarterly, annual))


def with_metrics(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """All metrics next to the as-of states. Expects ``close`` (NULL when no
    price is known) and ``shares_used``."""
    b, bal_freq = chosen("b", 1)
    _, inc_freq = chosen("i", 4)
    _, cash_freq = chosen("c", 4)
    g1, g2 = growth_pair()
    gm0, gm1 = margin_pair()
    out = df.withColumn("market_cap", F.col("close") * F.col("shares_used"))
    out = out.select(
        *out.columns,
        inc_freq.alias("income_freq"), bal_freq.alias("balance_freq"), cash_freq.alias("cash_freq"),
        growth_known().alias("growth_known"), g1.alias("g1"), g2.alias("g2"),
        gm0.alias("gm0"), gm1.alias("gm1"), roic(cfg).alias("roic"), leverage().alias("de_ratio"),
        free_cash_flow().alias("fcf"), runway_months().alias("runway"),
        _ttm("revenue", 1).alias("revenue_ttm"), _ttm("net", 1).alias("net_income_ttm"),
        gross_over_assets().alias("gp_assets"), quality_score().alias("fscore"),
        falling_periods().alias("falling"),
        b["debt"].alias("total_debt"), b["cash"].alias("cash"), b["equity"].alias("equity"),
        enterprise_value().alias("ev"), _ttm("ebit", 4).alias("ebit_ttm"))
    cap = F.col("market_cap")
    out = out.select(
        *out.columns,
        F.coalesce(F.col("net_income_ttm") > 0, F.lit(False)).alias("profitable"),
        F.when(F.col("ev") > 0, F.col("fcf") / F.col("ev")).alias("fcf_yield"),
        F.when(F.col("ev") > 0, F.col("ebit_ttm") / F.col("ev")).alias("ebit_yield"),
        F.when(F.col("revenue_ttm") > 0, cap / F.col("revenue_ttm")).alias("ps"),
        F.when(F.col("net_income_ttm") > 0, cap / F.col("net_income_ttm")).alias("pe"))
    return out.withColumn("peg", peg(F.col("pe"))).drop("qi", "ai", "qb", "ab", "qc", "ac")


def with_ps_stats(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Where the current P/S stands in its own history ``ps_hist``."""
    h, cur, n = F.col("ps_hist"), F.col("ps"), F.size("ps_hist")
    usable = (n >= 2) & cur.isNotNull()
    return df.select(
        *df.columns, n.cast("bigint").alias("ps_n"),
        F.when(usable, F.size(F.filter(h, lambda x: x <= cur)) / n).alias("ps_pct"),
        F.when(usable, F.floor(F.size(F.filter(h, lambda x: x < cur)) / n * 100)).cast("bigint").alias("ps_rank"),
        F.when(usable, F.array_min(h)).alias("ps_min"), F.when(usable, F.array_max(h)).alias("ps_max"),
        F.when(n >= 2, array_percentile(h, cfg.ps_quantile)).alias("ps_threshold"))
