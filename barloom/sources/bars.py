"""Bar tables: discovery, cleaning, ranges, status, names and calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import EOK, code_variants, finite, pad_code

# Raw column names of the yearly bar files -> our names.
RAW_BAR_COLUMNS = {
    "Date": "date", "Rank": "rank", "Code": "code", "Name": "name", "Open": "open",
    "High": "high", "Low": "low", "Close": "close", "Volume": "volume", "Amount": "amount",
    "Changes": "changes", "ChangeCode": "change_code", "ChagesRatio": "change_ratio",
    "Marcap": "marcap", "Stocks": "stocks", "MarketId": "market_id", "Market": "market",
    "Dept": "dept",
}
LABELS = ["name", "market", "market_id", "dept", "change_code"]
NUMBERS = ["open", "high", "low", "close", "volume", "amount", "marcap", "stocks", "rank",
           "changes", "change_ratio"]
DEFAULT_BAR_COLUMNS = ["date", "open", "high", "low", "close", "volume", "amount", "stocks",
                       "halted"]


def halted(open_: Column | None = None) -> Column:
    """A bar is unusable when any price is missing or not positive; volume is not consulted."""
    o = open_ if open_ is not None else F.col("open")
    live = (o > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0)
    return ~F.coalesce(live, F.lit(False))


def scan_bars(spark: SparkSession, root: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Yearly files ``marcap-YYYY.parquet`` under ``root``; ``year`` comes from the file name.

    Missing columns of older files become NULL.  When a year range is given only the files
    of those years are listed, so other years are never opened.
    """
    reader = spark.read.option("mergeSchema", "true")
    if years is None:
        df = reader.parquet(f"{root.rstrip('/')}/marcap-*.parquet")
    else:
        wanted = ",".join(str(y) for y in range(years[0], years[1] + 1))
        df = reader.parquet(f"{root.rstrip('/')}/marcap-{{{wanted}}}.parquet")
    year = F.regexp_extract(F.col("_metadata.file_path"), r"marcap-(\d{4})", 1).try_cast("int")
    return df.select("*", year.alias("year"))


def normalize_bars(raw: DataFrame) -> DataFrame:
    """Typed, cleaned bars: date, padded code, finite numbers, text labels, ``halted``.

    Accepts raw or our column names; absent columns become typed NULLs.  No sort: order is
    imposed only inside windows.
    """
    have = {RAW_BAR_COLUMNS.get(c, c): c for c in raw.columns}
    cols = [F.to_date(F.col(have["date"])).alias("date"), pad_code(have["code"]).alias("code")]
    for c in NUMBERS:
        if c in have:
            value = F.col(have[c])
            if isinstance(raw.schema[have[c]].dataType, T.StringType):
                value = F.trim(value).try_cast("double")
            cols.append(finite(value).alias(c))
        else:
            cols.append(F.lit(None).cast("double").alias(c))
    for c in LABELS:
        value = F.col(have[c]).cast("string") if c in have else F.lit(None).cast("string")
        cols.append(F.coalesce(value, F.lit("")).alias(c))
    if "year" in have:
        cols.append(F.col(have["year"]).alias("year"))
    return raw.select(*cols).withColumn("halted", halted())


def write_bars(bars: DataFrame, path: str, files_per_year: int = 0) -> None:
    """Store bars partitioned by year and sorted by (code, date) inside each file, so that a
    single-symbol read skips row groups and a date range prunes directories."""
    df = bars.withColumn("year", F.year("date"))
    if files_per_year:
        df = df.repartitionByRange(files_per_year, "year", "code")
    else:
        df = df.repartitionByRange("year", "code")
    (df.sortWithinPartitions("year", "code", "date").write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path))


def _range(bars: DataFrame, start, end) -> DataFrame:
    if start is not None and end is not None and str(start) > str(end):
        raise ValueError(f"start {start} is after end {end}")
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
        if "year" in bars.columns:
            bars = bars.where(F.col("year") >= F.year(F.lit(start).cast("date")))
    if end is not None:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
        if "year" in bars.columns:
            bars = bars.where(F.col("year") <= F.year(F.lit(end).cast("date")))
    return bars


def panel(bars: DataFrame, start=None, end=None, columns: list[str] | None = None,
          adjusted: bool = True) -> DataFrame:
    """All symbols in an inclusive date range, only the asked columns plus the keys.

    ``adjusted``: prices are scaled by the splits of all ``bars``, also later than ``end``, so a
    price does not depend on the range (tables without share counts cannot be adjusted and stay
    as traded).  The range is cut, and its columns are pruned, before anything is shuffled; the
    splits are found in four columns of the whole table.  Without a range the bars themselves
    show the splits, so they are read and moved once.
    """
    from ..operators.adjust import ADDED, PRICES, adjust_prices, factor_steps, scale_by_steps

    out = _range(bars, start, end)
    if columns is not None:
        keep = ["date", "code"] + [c for c in columns if c not in ("date", "code", "halted")]
        out = out.select(*keep, "halted")
    if adjusted and "stocks" in bars.columns and any(c in out.columns for c in PRICES):
        if start is None and end is None and not set(ADDED) & set(out.columns):
            needed = [c for c in ("close", "stocks") if c not in out.columns]
            return adjust_prices(bars.select(*out.columns, *needed)).select(*out.columns)
        out = scale_by_steps(out, factor_steps(bars))
    return out


def symbol_bars(bars: DataFrame, code: str, start=None, end=None,
                columns: list[str] | str | None = None, adjust: bool = True) -> DataFrame:
    """Bars of one symbol. Adjustment looks at every later bar, so it precedes the range."""
    from ..operators.adjust import adjust_prices

    one = bars.where(F.col("code") == F.lit(str(code).zfill(6)))
    if adjust:
        one = adjust_prices(one)
    out = _range(one, start, end)
    if columns == "all":
        return out
    return out.select(*(columns or [c for c in DEFAULT_BAR_COLUMNS if c in out.columns]))


def raw_symbol_rows(raw: DataFrame, code: str, column: str = "Code") -> DataFrame:
    """Symbol filter that still reaches the scan of files which dropped leading zeros."""
    return raw.where(F.col(column).isin(code_variants(code)))


def table_status(bars: DataFrame) -> DataFrame:
    return bars.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"),
                    F.count(F.lit(1)).alias("rows"),
                    F.countDistinct(F.year("date")).alias("years"))


def names(bars: DataFrame, on=None) -> DataFrame:
    """code -> name on one day; codes fall back to the last known name if that day is empty."""
    last = bars.groupBy("code").agg(F.max_by("name", "date").alias("name"))
    if on is None:
        return last
    day = bars.where(F.col("date") == F.lit(on).cast("date")).select("code", "name")
    empty = day.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))
    return day.unionByName(
        last.join(F.broadcast(empty), F.col("empty"), "left_semi"))


def trading_days(bars: DataFrame) -> DataFrame:
    return bars.select("date").distinct()


def calendar(bars: DataFrame) -> DataFrame:
    """Trading days with a dense 0-based index.

    One row per trading day, so the un-partitioned window sees a few thousand rows at most.
    """
    w = Window.orderBy("date")
    return trading_days(bars).select("date", (F.row_number().over(w) - 1).alias("day_idx"))


def with_day_index(bars: DataFrame, cal: DataFrame | None = None) -> DataFrame:
    """Attach the calendar index; the calendar has one row per day and is safe to broadcast."""
    return bars.join(F.broadcast(cal if cal is not None else calendar(bars)), "date")


def latest_rows(bars: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Newest row of every symbol."""
    cols = [c for c in (columns or bars.columns) if c not in ("code", "date")]
    picked = [F.max_by(c, "date").alias(c) for c in cols]
    return bars.groupBy("code").agg(F.max("date").alias("date"), *picked)


def symbol_snapshot(bars: DataFrame) -> DataFrame:
    """Rows of the newest trading day, market value in eok (rounded)."""
    newest = bars.agg(F.max("date").alias("date"))
    return (bars.join(F.broadcast(newest), "date", "left_semi")
            .select("code", "name", "market",
                    F.round(F.col("marcap") / EOK).cast("bigint").alias("marcap_eok")))
