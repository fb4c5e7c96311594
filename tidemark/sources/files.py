"""Readers: prices, statements in three shapes, constituents, watchlists,
trade logs, insider filings, report text and scalar side inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import effective_tax, nan_to_null, parse_money, to_provider_symbol, total_debt

OHLCV = ["open", "high", "low", "close", "volume"]


def clean_bars(raw: DataFrame, min_rows: int = 20) -> DataFrame:
    """Float columns with NULL for missing, naive dates, no all-null rows and
    no ticker with fewer than ``min_rows`` rows. The row count per ticker is a
    small aggregate; rows are not shuffled for it."""
    rows = raw.select("ticker", F.col("date").cast("date").alias("date"),
                      *[nan_to_null(F.col(c).cast("double")).alias(c) for c in OHLCV]).dropna("all", subset=OHLCV)
    enough = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return rows.join(enough.select("ticker"), "ticker", "left_semi")


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.schema("ticker string, date date, open double, high double, low double, "
                               "close double, volume double").option("header", True)
    return clean_bars(reader.load(path))


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate present, ignoring case and surrounding blanks."""
    seen = {c.replace("\xa0", " ").strip().lower(): c for c in columns}
    return next((seen[c.lower()] for c in candidates if c.lower() in seen), None)


# ---- statements -----------------------------------------------------------

# Record field -> canonical item.
RECORD_ITEMS = {
    "revenue": "Total Revenue", "grossProfit": "Gross Profit", "operatingIncome": "Operating Income",
    "netIncome": "Net Income", "totalAssets": "Total Assets", "totalCurrentLiabilities": "Current Liabilities",
    "cashAndCashEquivalents": "Cash And Cash Equivalents", "totalDebt": "Total Debt",
    "totalStockholdersEquity": "Stockholders Equity", "operatingCashFlow": "Operating Cash Flow",
    "capitalExpenditure": "Capital Expenditure",
}


def latest_duplicate(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Of repeated keys the row with the highest position wins. Grouping
    combines before the shuffle, so many repeats of one key are harmless."""
    rest = [c for c in df.columns if c not in (*keys, position)]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def records_to_long(records: DataFrame, statement: str, freq: str,
                    extra: dict[str, Column] | None = None) -> DataFrame:
    """``records`` (ticker, pos, date, fields...) to long items. ``extra`` adds
    derived items as plug-in columns; income statements get their tax rate."""
    extra = dict(extra or {})
    if statement == "income" and {"incomeTaxExpense", "incomeBeforeTax"} <= set(records.columns):
        extra.setdefault("Tax Rate For Calcs", effective_tax(
            F.coalesce(F.col("incomeTaxExpense"), F.lit(0.0)), F.col("incomeBeforeTax")))
    fields = [f for f in RECORD_ITEMS if f in records.columns]
    wide = (records.where(F.length("date") > 0)
            .select("ticker", "pos", F.substring("date", 1, 10).try_cast("date").alias("period_end"),
                    *[F.col(f).cast("double").alias(RECORD_ITEMS[f]) for f in fields],
                    *[c.alias(n) for n, c in extra.items()])
            .where(F.col("period_end").isNotNull()))
    once = latest_duplicate(wide, ["ticker", "period_end"], "pos")
    items = [c for c in once.columns if c not in ("ticker", "period_end")]
    return once.unpivot(["ticker", "period_end"], items, "item", "value").select(
        "ticker", F.lit(freq).alias("freq"), F.lit(statement).alias("statement"), "period_end", "item", "value")


RECORD_FIELDS = [*RECORD_ITEMS, "incomeTaxExpense", "incomeBeforeTax"]


def checked_records(lines: DataFrame) -> DataFrame:
    """Every record of JSON lines ``{ticker, records: [...]}`` (column ``value``), good or not.

    Payloads are parsed as VARIANT, so nothing that does not fit a schema vanishes: ``level`` tells what a row
    stands for (line, record), ``reason`` why it is not used (NULL if it is), ``payload`` is its text, ``bad``
    lists fields of a used record whose value is no number (they count as unknown). Lines in = rejected lines
    + lines with records; records in = used + rejected records.
    """
    line = lines.select("value", F.try_parse_json("value").alias("v"))
    line = line.select("value", "v", F.try_variant_get("v", "$.ticker", "string").alias("ticker"),
                       F.try_variant_get("v", "$.records", "array<variant>").alias("records"))
    why = (F.when(F.col("v").isNull(), "no JSON").when(F.col("ticker").isNull() | (F.col("ticker") == ""), "no ticker")
           .when(F.col("records").isNull(), "no records").when(F.size("records") == 0, "no records"))
    line = line.withColumn("reason", why)
    none = {"pos": "int", "date": "string", "period_end": "date", "bad": "array<string>", **{f: "double" for f in RECORD_FIELDS}}
    lost = line.where(F.col("reason").isNotNull()).select(
        F.lit("line").alias("level"), "ticker", "reason", F.col("value").alias("payload"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    rec = line.where(F.col("reason").isNull()).select("ticker", F.posexplode("records").alias("pos", "r"))

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get("r", f"$.{name}", kind)

    is_object = F.schema_of_variant("r").startswith("OBJECT")
    given = lambda f: field(f, "variant").isNotNull() & ~F.is_variant_null(field(f, "variant"))
    unread = [F.when(field(f, "double").isNull() & given(f), F.lit(f)) for f in RECORD_FIELDS]
    rec = rec.select("ticker", "pos", F.to_json("r").alias("payload"), is_object.alias("_object"), field("date", "string").alias("date"),
                     F.array_compact(F.array(*unread)).alias("bad"), *[field(f, "double").alias(f) for f in RECORD_FIELDS])
    rec = rec.withColumn("period_end", F.substring("date", 1, 10).try_cast("date"))
    rec = rec.withColumn("reason", F.when(~F.coalesce("_object", F.lit(False)), "no object").when(F.col("period_end").isNull(), "no date"))
    # Later records of a period replace earlier ones; a ticker has a few dozen records.
    newest = F.max(F.when(F.col("reason").isNull(), F.col("pos"))).over(Window.partitionBy("ticker", "period_end"))
    rec = rec.withColumn("reason", F.coalesce("reason", F.when(F.col("pos") < newest, "superseded")))
    return lost.unionByName(rec.withColumn("level", F.lit("record")).drop("_object"))


def rejects(checked: DataFrame) -> DataFrame:
    """``(level, ticker, pos, reason, payload)`` of what is not used: lines, records and single items."""
    whole = checked.where(F.col("reason").isNotNull()).select("level", "ticker", "pos", "reason", "payload")
    items = checked.where(F.col("reason").isNull()).select("ticker", "pos", F.explode("bad").alias("field"), "payload")
    return whole.unionByName(items.select(F.lit("item").alias("level"), "ticker", "pos", F.concat(F.lit("no number: "), "field").alias("reason"), "payload"))


def used_records(checked: DataFrame, statement: str, freq: str) -> DataFrame:
    """Long items of the records in use."""
    return records_to_long(checked.where((F.col("level") == "record") & F.col("reason").isNull()), statement, freq)


def read_records(spark: SparkSession, path: str, statement: str, freq: str) -> DataFrame:
    """JSON files, one array of records per ticker and line: ``{ticker, records: [...]}``. ``rejects`` of
    ``checked_records`` over the same lines tells what was not used."""
    return used_records(checked_records(spark.read.text(path)), statement, freq)


def compact_to_long(responses: DataFrame, statement: str, items: dict[str, str]) -> DataFrame:
    """Compact responses (ticker, columns, data) to long items of both
    frequencies, by fiscal period. ``items`` maps source column to item."""
    rows = (responses.select("ticker", "columns", F.posexplode("data").alias("pos", "row"))
            .select("ticker", "pos", F.map_from_arrays(
                "columns", F.slice(F.concat("row", F.array_repeat(F.lit(None).cast("string"), F.size("columns"))),
                                   F.lit(1), F.size("columns"))).alias("m")))
    def num(name: str) -> Column:
        return F.try_element_at("m", F.lit(name)).try_cast("double")
    period = F.try_element_at("m", F.lit("Fiscal Period"))
    freq = F.when(period.isin("Q1", "Q2", "Q3", "Q4"), "quarterly").when(period == "FY", "annual")
    cols = {dst: num(src) for src, dst in items.items()}
    if statement == "income":
        cols["Tax Rate For Calcs"] = effective_tax(
            num("Income Tax (Expense) Benefit, net"), num("Pretax Income (Loss), Adjusted"), sign=-1)
    if statement == "balance":
        cols["Total Debt"] = total_debt(num("Long Term Debt"), num("Short Term Debt"))
    wide = (rows.select("ticker", "pos", freq.alias("freq"),
                        F.substring(F.try_element_at("m", F.lit("Report Date")), 1, 10).try_cast("date").alias("period_end"),
                        *[c.alias(n) for n, c in cols.items()])
            .where(F.col("freq").isNotNull() & F.col("period_end").isNotNull()))
    once = latest_duplicate(wide, ["ticker", "freq", "period_end"], "pos")
    return once.unpivot(["ticker", "freq", "period_end"], list(cols), "item", "value").select(
        "ticker", "freq", F.lit(statement).alias("statement"), "period_end", "item", "value")


def read_compact(spark: SparkSession, path: str, statement: str, items: dict[str, str]) -> DataFrame:
    schema = "ticker string, statements array<struct<columns: array<string>, data: array<array<string>>>>"
    raw = spark.read.schema(schema).json(path)
    first = raw.select("ticker", F.get("statements", 0).alias("s"))
    return compact_to_long(first.select("ticker", "s.columns", "s.data"), statement, items)


def wide_to_long(wide: DataFrame, ids: list[str], statement: str, freq: str) -> DataFrame:
    """Label rows with one column per period end (named by date)."""
    periods = [c for c in wide.columns if c not in (*ids, "item")]
    long = wide.unpivot([*ids, "item"], periods, "period_end", "value")
    return long.select(*ids, F.lit(freq).alias("freq"), F.lit(statement).alias("statement"),
                       F.to_date("period_end").alias("period_end"), "item",
                       nan_to_null(F.col("value").cast("double")).alias("value"))


# ---- universe and lists ---------------------------------------------------

def constituents(df: DataFrame) -> DataFrame:
    """Finds the ticker column by name, the sector column by parts of its name
    (GICS sector before any sector), and normalises symbols."""
    t = pick_column(df.columns, ["Symbol", "Ticker", "Ticker symbol"])
    named = [(c, c.lower()) for c in df.columns]
    s = next((c for c, low in named if "gics" in low and "sector" in low), next((c for c, low in named if "sector" in low), None))
    if t is None:
        raise ValueError(f"no ticker column in {df.columns}")
    sector = F.coalesce(F.col(f"`{s}`"), F.lit("Unknown")) if s else F.lit("Unknown")
    return df.select(to_provider_symbol(F.col(f"`{t}`")).alias("ticker"), sector.alias("sector")).where("ticker <> ''")


def constituent_pairs(spark: SparkSession, path: str) -> DataFrame:
    """JSON list of ``[ticker, sector]`` pairs."""
    raw = spark.read.text(path, wholetext=True)
    pairs = F.from_json("value", "array<array<string>>")
    return raw.select(F.explode(pairs).alias("p")).select(
        to_provider_symbol(F.get("p", 0)).alias("ticker"), F.get("p", 1).alias("sector"))


def tickers_from_lines(lines: DataFrame) -> DataFrame:
    """Trimmed upper-case symbols, blanks and ``#`` comments dropped."""
    v = F.trim(F.col("value"))
    return lines.where((v != "") & ~v.startswith("#")).select(F.upper(v).alias("ticker")).distinct()


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    return tickers_from_lines(spark.read.text(path))


# ---- trade logs -----------------------------------------------------------

# Accepted column names, in order of preference.
RETURN_NAMES = ["return_pct", "return_%", "Return %", "return", "pnl_pct", "Return_Pct", "profit_pct"]
HOLD_NAMES = ["days_held", "hold_days", "holding_period", "Hold Days", "avg_hold", "duration"]


def normalise_trades(raw: DataFrame) -> DataFrame:
    """Candidate column names, bad dates to NULL, percent logs to fractions."""
    from tidemark.operators.trades import rescaled
    r = pick_column(raw.columns, RETURN_NAMES)
    if r is None:
        raise ValueError(f"no return column in {raw.columns}")
    h = pick_column(raw.columns, HOLD_NAMES)
    have = set(raw.columns)

    def col(name: str, kind: str) -> Column:
        return (F.col(f"`{name}`").try_cast(kind) if name in have else F.lit(None).cast(kind)).alias(name)

    hold = F.col(f"`{h}`").try_cast("bigint") if h else F.lit(None).cast("bigint")
    rows = raw.select(
        col("ticker", "string"), (F.col("tier") if "tier" in have else F.lit("qvm")).alias("tier"),
        col("entry_date", "date"), col("entry_price", "double"), col("exit_date", "date"),
        col("exit_price", "double"), nan_to_null(F.col(f"`{r}`").try_cast("double")).alias("return_pct"),
        col("pnl_dollars", "double"), hold.alias("hold_days"), col("exit_reason", "string"))
    return rescaled(rows)


def read_trades(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """First path that exists."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            return normalise_trades(spark.read.option("header", True).csv(p))
    raise FileNotFoundError(", ".join(paths))


# ---- filings, reports, side inputs ---------------------------------------

# Header (blanks normalised, lower case) -> column.
INSIDER_NAMES = {"trade date": "trade_date", "insider name": "name", "title": "title", "trade type": "trade_type",
                 "price": "price", "qty": "qty", "quantity": "qty", "value": "value", "ticker": "ticker"}


def insider_columns(raw: DataFrame) -> DataFrame:
    out, used = [], set()
    for c in raw.columns:
        name = INSIDER_NAMES.get(c.replace("\xa0", " ").strip().lower())
        if name and name not in used:
            used.add(name)
            out.append(F.col(f"`{c}`").alias(name))
    return raw.select(*out)


def insider_purchases(filings: DataFrame, today: Column, days: int = 90) -> DataFrame:
    """Open-market purchases of the last ``days`` days with parsed amounts."""
    d = F.substring("trade_date", 1, 10).try_cast("date")
    return (filings.withColumn("trade_date", d)
            .where(F.col("trade_type").startswith("P -") & (F.col("trade_date") >= F.date_sub(today, days)))
            .withColumn("amount", parse_money("value")))


def newest_purchases(purchases: DataFrame, k: int = 5) -> DataFrame:
    from tidemark.operators.ranking import top_n
    order = [F.col("trade_date").desc(), F.col("amount").desc(), F.col("name")]
    return top_n(purchases, ["ticker"], order, k, "rn")


# The four score patterns, in the order they are tried per line.
SCORE_PATTERNS = [
    r"(?i)PASSES\s+(\d+)\s+of\s+(\d+)",
    r"(?i)(\d+)\s*/\s*(\d+)\s*filter",
    r"(?i)(\d+)\s+of\s+(\d+)\s*filter",
    r"(?i)Score[:\s]+(\d+)\s*/\s*(\d+)",
]


def parse_reports(lines: DataFrame) -> DataFrame:
    """``(ticker, line_no, value)`` report lines to score, total and conviction.
    The last match wins; within a line, the later pattern. Both picks combine
    map-side, so a very long report is no burden on its reducer."""
    v = F.col("value")
    hits = F.array_compact(F.array(*[
        F.when(v.rlike(p), F.struct(F.lit(i).alias("pattern"),
                                    F.regexp_extract(v, p, 1).try_cast("bigint").alias("score"),
                                    F.regexp_extract(v, p, 2).try_cast("bigint").alias("total")))
        for i, p in enumerate(SCORE_PATTERNS)]))
    up = F.upper(v)
    # Words of the verdict, and the scores they stand for when none is found.
    word = (F.when(up.contains("DO NOT ENTER"), "DO NOT ENTER")
            .when(up.contains("HIGH") & (up.contains("CONVICTION") | up.contains("SIGNAL")), "HIGH")
            .when(up.contains("MEDIUM") & up.contains("CONVICTION"), "MEDIUM"))
    hit = F.element_at(hits, -1)
    marked = lines.select("ticker", "line_no", F.when(F.size(hits) > 0, hit).alias("hit"), word.alias("word"))
    found = marked.groupBy("ticker").agg(
        F.max_by("hit", F.when(F.col("hit").isNotNull(), F.col("line_no"))).alias("hit"),
        F.max_by("word", F.when(F.col("word").isNotNull(), F.col("line_no"))).alias("word"))
    score = F.coalesce("hit.score", F.lit(0))
    fallback = F.when(score >= 11, "HIGH").when(score >= 9, "MEDIUM").otherwise("DO NOT ENTER")
    return found.select("ticker", score.alias("score"), F.coalesce("hit.total", F.lit(12)).alias("total"),
                        F.coalesce("word", fallback).alias("conviction"))


def text_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered lines of whole texts."""
    return docs.select(F.col(key).alias("ticker"), F.posexplode(F.split(text, "\n")).alias("line_no", "value"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One report file per ticker; the file stem is the ticker."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return parse_reports(text_lines(raw.withColumn("_t", stem), "_t", "value"))


def fresh_side_inputs(side: DataFrame, now_seconds: float, ttl_hours: int = 24) -> DataFrame:
    """Drops sentiment older than the time to live; the regime stays."""
    fresh = F.lit(now_seconds) - F.col("ts") < ttl_hours * 3600
    return side.withColumn("sentiment", F.when(fresh, F.col("sentiment")))


def regime_allows(regime: Column) -> Column:
    return F.coalesce(F.upper(regime), F.lit("GREEN")) != "RED"
