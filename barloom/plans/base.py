"""Base tables of the registered queries, derived from the given tables, and the query registry.

The given tables hold no price bars, so both sides of the check derive them the same way:

* a *symbol* is a supplier (the number of symbols grows with the data), a *tick* is a line
  item, its price is ``1000 + (cents of l_extendedprice mod 10000) / 100``;
* ``bars``      - one row per (symbol, ship date);
* ``raw_bars``  - the same with labels, share counts and injected halts, price shocks, a split
  for one third of the symbols and a share issue for another third;
* ``filings``   - per (symbol, year, quarter) figures from the traded amounts, with restated
  rows, missing disclosure dates and missing items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import disclosure_due_date
from ..operators.filings import derive_columns
from ..sources.bars import halted

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _symbol(key: str) -> Column:
    s = F.col(key).cast("string")
    return F.when(F.length(s) < 6, F.lpad(s, 6, "0")).otherwise(s)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sk"), F.to_date("l_shipdate").alias("date"),
        cents.alias("cents"), F.col("l_quantity").alias("qty"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        (1000 + (cents % 10000).cast("double") / 100).alias("px"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (symbol, day).

    First and last tick are picked by one DECIMAL(38) key instead of a struct: a struct in
    an aggregation buffer forces a sort of every tick, a decimal stays in hash aggregation.
    """
    d = "decimal(38,0)"
    key = (F.col("seq").cast("decimal(20,0)") * F.lit(10 ** 15).cast("decimal(16,0)")
           + (F.col("cents") * 100 + F.col("qty").cast("bigint")).cast("decimal(18,0)")).cast(d)
    g = ticks(spark, sf_dir).groupBy("sk", "date").agg(
        F.min_by("px", key).alias("open"), F.max("px").alias("hi"), F.min("px").alias("lo"),
        F.max_by("px", key).alias("close"), F.sum("qty").alias("volume"),
        F.sum("cents").alias("cents"))
    return g.select(_symbol("sk").alias("code"), "date", "open",
                    (F.col("hi") * 1.01).alias("high"), (F.col("lo") * 0.99).alias("low"),
                    "close", "volume", (F.col("cents").cast("double") / 100).alias("amount"))


BARS_SQL = """
bars AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS date,
         arg_min(px, k) AS open, max(px) * CAST(1.01 AS DOUBLE) AS high,
         min(px) * CAST(0.99 AS DOUBLE) AS low, arg_max(px, k) AS close,
         CAST(sum(l_quantity) AS DOUBLE) AS volume,
         CAST(CAST(sum(cents) AS BIGINT) AS DOUBLE) / 100 AS amount
  FROM (SELECT *, 1000 + CAST(cents % 10000 AS DOUBLE) / 100 AS px,
               row(l_orderkey * 8 + l_linenumber, cents, l_quantity) AS k
        FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem))
  GROUP BY 1, 2)"""


def _pick(number: Column, modulus: int, values: dict[int, str], default: str = "") -> Column:
    m = number % modulus
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(m == k, F.lit(v)).otherwise(out)
    return out


NAME_TAGS = {1: "우", 2: "우B", 3: " KODEX", 4: " 스팩", 5: " ETN", 6: " 리츠"}
DEPTS = {1: "관리종목", 2: "거래정지", 3: "ETF"}
MARKETS = {0: "KOSPI", 1: "KOSDAQ", 2: "KONEX"}
MARKET_IDS = {0: "STK", 1: "KSQ", 2: "KNX"}


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    sk = F.col("code").cast("bigint")
    n = F.datediff("date", F.lit("1995-01-01").cast("date"))
    stop, surge, crash = n % 41 == 0, n % 97 == 0, n % 89 == 0
    late = F.col("date") >= F.lit("1998-07-01").cast("date")
    f = (F.when(surge, 1.32).when(crash, 0.68).otherwise(1.0)
         * F.when(late & (sk % 3 == 0), 0.5).otherwise(1.0))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    price = lambda c: F.when(stop, 0.0).otherwise(c * f)
    stocks = F.when(late & (sk % 3 != 2), 2000000.0).otherwise(1000000.0)
    return b.select(
        "code", "date",
        F.concat(F.lit("Supplier#"), "code", _pick(sk, 10, NAME_TAGS)).alias("name"),
        _pick(sk, 3, MARKETS).alias("market"), _pick(sk, 3, MARKET_IDS).alias("market_id"),
        _pick(sk, 7, DEPTS).alias("dept"),
        price(F.col("open")).alias("open"),
        price(F.when(surge, top).otherwise(F.col("high"))).alias("high"),
        price(F.when(crash, bottom).otherwise(F.col("low"))).alias("low"),
        (F.col("close") * f).alias("close"),
        F.when(stop, 0.0).otherwise(F.col("volume")).alias("volume"),
        F.when(stop, 0.0).otherwise(F.col("amount")).alias("amount"),
        stocks.alias("stocks"), (F.col("close") * f * stocks).alias("marcap"),
    ).withColumn("halted", halted())


def _case(expr: str, values: dict[int, str], default: str = "") -> str:
    return (f"CASE {expr} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items())
            + f" ELSE '{default}' END")


RAW_BARS_SQL = BARS_SQL + f""",
raw0 AS (
  SELECT *, n % 41 = 0 AS stop, n % 97 = 0 AS surge, n % 89 = 0 AS crash,
         (CASE WHEN n % 97 = 0 THEN CAST(1.32 AS DOUBLE) WHEN n % 89 = 0 THEN CAST(0.68 AS DOUBLE)
               ELSE CAST(1 AS DOUBLE) END)
         * (CASE WHEN late AND sk % 3 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) AS f,
         CASE WHEN late AND sk % 3 <> 2 THEN CAST(2000000 AS DOUBLE)
              ELSE CAST(1000000 AS DOUBLE) END AS stocks
  FROM (SELECT *, CAST(code AS BIGINT) AS sk, date_diff('day', DATE '1995-01-01', date) AS n,
               date >= DATE '1998-07-01' AS late FROM bars)),
raw_bars AS (
  SELECT code, date, 'Supplier#' || code || {_case('sk % 10', NAME_TAGS)} AS name,
         {_case('sk % 3', MARKETS)} AS market, {_case('sk % 3', MARKET_IDS)} AS market_id,
         {_case('sk % 7', DEPTS)} AS dept,
         CASE WHEN stop THEN 0 ELSE open * f END AS open,
         CASE WHEN stop THEN 0 WHEN surge THEN greatest(open, close) * f ELSE high * f END AS high,
         CASE WHEN stop THEN 0 WHEN crash THEN least(open, close) * f ELSE low * f END AS low,
         close * f AS close, CASE WHEN stop THEN 0 ELSE volume END AS volume,
         CASE WHEN stop THEN 0 ELSE amount END AS amount, stocks, close * f * stocks AS marcap,
         stop AS halted
  FROM raw0)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly filings with every derived column filled by the library."""
    from pyspark.sql import Window

    q = (ticks(spark, sf_dir).groupBy("sk", F.year("date").alias("year"),
                                      F.quarter("date").alias("quarter"))
         .agg(F.sum("cents").alias("rev")))
    i = F.col("year") * 4 + F.col("quarter")
    q = q.withColumn("op", F.col("rev") - F.expr(
        "(9 * sum(rev) OVER (PARTITION BY sk)) div (10 * count(*) OVER (PARTITION BY sk))"))
    ytd = (Window.partitionBy("sk", "year").orderBy("quarter")
           .rowsBetween(Window.unboundedPreceding, 0))
    sk, rev = F.col("sk"), F.col("rev")
    null_long = F.lit(None).cast("bigint")
    first = q.select(
        _symbol("sk").alias("code"), F.concat(F.lit("00"), _symbol("sk")).alias("corp_code"),
        "year", "quarter",
        F.when((sk + i) % 6 == 0, "OFS").otherwise("CFS").alias("fs_div"),
        F.lit("KRW").alias("currency"),
        F.when((sk + i) % 17 != 0, disclosure_due_date("year", "quarter")).alias("disclosed_at"),
        F.when(sk % 11 != 0, 2 * rev).otherwise(null_long).alias("cur_assets"),
        F.when(i % 13 == 0, F.expr("rev div 1000000")).otherwise(rev + rev * (i % 3))
        .alias("cur_liab"),
        (5 * rev).alias("assets"), (rev * (1 + sk % 7)).alias("liab"),
        (5 * rev - rev * (1 + sk % 7)).alias("equity"),
        F.sum("rev").over(ytd).alias("revenue"), F.sum("op").over(ytd).alias("op_income"),
        (F.sum("op").over(ytd) - F.lit(5000)).alias("net_income"))
    derived = derive_columns(first)
    restated = derived.where((F.col("year") * 4 + F.col("quarter")) % 5 == 0).withColumns({
        "disclosed_at": F.date_add("disclosed_at", 60),
        "op_income": F.col("op_income") - 1000000,
        "op_income_quarter": F.col("op_income_quarter") - 1000000})
    return derived.unionByName(restated)


FILINGS_SQL = """
fq AS (
  SELECT l_suppkey AS sk, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(quarter(l_shipdate) AS INTEGER) AS quarter,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS rev
  FROM lineitem GROUP BY 1, 2, 3),
fop AS (
  SELECT *, year * 4 + quarter AS i, lpad(CAST(sk AS VARCHAR), 6, '0') AS code,
         rev - CAST((9 * sum(rev) OVER (PARTITION BY sk))
                    // (10 * count(*) OVER (PARTITION BY sk)) AS BIGINT) AS op
  FROM fq),
fcum AS (
  SELECT code, '00' || code AS corp_code, year, quarter, i,
         CASE WHEN (sk + i) % 6 = 0 THEN 'OFS' ELSE 'CFS' END AS fs_div, 'KRW' AS currency,
         CASE WHEN (sk + i) % 17 <> 0 THEN
           CAST(last_day(make_date(year, quarter * 3, 1)) + CASE WHEN quarter = 4 THEN 90 ELSE 45 END
                AS DATE) END AS disclosed_at,
         CASE WHEN sk % 11 <> 0 THEN 2 * rev END AS cur_assets,
         CASE WHEN i % 13 = 0 THEN rev // 1000000 ELSE rev + rev * (i % 3) END AS cur_liab,
         5 * rev AS assets, rev * (1 + sk % 7) AS liab, 5 * rev - rev * (1 + sk % 7) AS equity,
         CAST(sum(rev) OVER y AS BIGINT) AS revenue, CAST(sum(op) OVER y AS BIGINT) AS op_income,
         CAST(sum(op) OVER y AS BIGINT) - 5000 AS net_income
  FROM fop
  WINDOW y AS (PARTITION BY sk, year ORDER BY quarter
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fder AS (
  SELECT a.*,
         CASE WHEN a.equity > 0 AND NOT a.equity < a.assets * 0.0001
              THEN round(CAST(a.liab AS DOUBLE) / a.equity * 100, 2) END AS debt_ratio_pct,
         CASE WHEN a.cur_liab > 0 AND a.cur_assets IS NOT NULL AND NOT a.cur_liab < a.assets * 0.0001
              THEN round(CAST(a.cur_assets AS DOUBLE) / a.cur_liab * 100, 2) END AS current_ratio_pct,
         a.equity <= 0 AS capital_impaired,
         CASE WHEN a.quarter = 1 THEN a.op_income
              WHEN b.fs_div = a.fs_div THEN a.op_income - b.op_income END AS op_income_quarter
  FROM fcum a LEFT JOIN fcum b
    ON a.code = b.code AND a.year = b.year AND a.quarter = b.quarter + 1),
filings AS (
  SELECT * FROM fder
  UNION ALL BY NAME
  SELECT * REPLACE (CAST(disclosed_at + 60 AS DATE) AS disclosed_at,
                    op_income - 1000000 AS op_income,
                    op_income_quarter - 1000000 AS op_income_quarter)
  FROM fder WHERE i % 5 = 0)"""


# ---------------------------------------------------------------------------- registry

REGISTERED: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Plain output types for the comparison: ISO dates, BIGINT and DOUBLE numbers."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query function under ``name`` with its oracle SQL.

    ``$bars``, ``$raw_bars`` and ``$filings`` in the SQL stand for the derivations above.
    """
    def register(fn: Query) -> Query:
        if name in REGISTERED:
            raise ValueError(f"query {name} registered twice")
        REGISTERED[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            for mark, ctes in (("$raw_bars", RAW_BARS_SQL), ("$bars", BARS_SQL),
                               ("$filings", FILINGS_SQL)):
                text = text.replace(mark, ctes.strip())
            ORACLES[name] = text
        return fn
    return register


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})
