"""Data-quality report of bars and filings: counters, coverage, gaps and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.filings import AMOUNTS
from .asof import as_of
from .quantiles import exact_quantiles

# Limits beyond which the report raises an issue.
MISSING_WARN_PCT = 30.0
MISSING_WARN_PCT_CURRENT = 55.0
DEBT_RATIO_ABSURD = 10_000.0
DEBT_MEDIAN_RANGE = (5.0, 400.0)
CURRENT_MEDIAN_RANGE = (30.0, 1000.0)
NEGATIVE_SHARE_MIN = 3.0
LIVE_COVERAGE_MIN = 80.0
# Fixed value: first year for which quarterly reports are published.
QUARTERLY_FROM_YEAR = 2016


def duplicate_bars(bars: DataFrame) -> DataFrame:
    """(code, date) pairs that occur more than once; empty when the key holds."""
    return (bars.groupBy("code", "date").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def rows_by_quarter(filings: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("quarter") == q).alias(f"q{q}") for q in (1, 2, 3, 4)]
    return filings.groupBy("year").agg(*counts, F.count(F.lit(1)).alias("total"))


def _long(one_row: DataFrame, names: list[str], fields: list[str], key: str) -> DataFrame:
    """One-row aggregate with ``name__field`` columns -> one row per name."""
    rows = F.array(*[F.struct(F.lit(n).alias(key), *[F.col(f"{n}__{f}").alias(f) for f in fields])
                     for n in names])
    return one_row.select(F.inline(rows))


def missing_rates(filings: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Known and missing counts per column, from one pass over the table."""
    cols = columns or [*AMOUNTS, "debt_ratio_pct", "current_ratio_pct", "op_income_quarter",
                       "disclosed_at"]
    n = F.count(F.lit(1))
    a = filings.agg(*[x for c in cols for x in (
        F.count(c).alias(f"{c}__known"), (n - F.count(c)).alias(f"{c}__missing"),
        ((n - F.count(c)) * 100.0 / n).alias(f"{c}__missing_pct"))])
    return _long(a, cols, ["known", "missing", "missing_pct"], "column")


def distribution(df: DataFrame, columns: list[str], approximate: bool = False,
                 accuracy: int = 10_000) -> DataFrame:
    """Count, minimum, quartiles and maximum per column, unknown values dropped.

    Exact percentiles are selected by rank over range-sorted value counts (no task holds a whole
    column); ``approximate`` reads the table once with bounded sketches (error 1/accuracy).
    """
    points = [0.0, 0.25, 0.5, 0.75, 1.0]
    names = ["min", "p25", "median", "p75", "max"]
    if approximate:
        sketches = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.percentile_approx(
            F.col(c).cast("double"), points, accuracy).alias("q")) for c in columns]
        found = df.agg(F.array(*sketches).alias("x")).select(F.inline("x"))
        return found.select("column", "n", *[F.get("q", F.lit(i)).alias(x)
                                             for i, x in enumerate(names)])
    return _per_column(df, columns, points).select(
        "column", "n", *[F.get("q", F.lit(i)).alias(x) for i, x in enumerate(names)])


def _per_column(df: DataFrame, columns: list[str], points: list[float]) -> DataFrame:
    """Exact percentiles with a row for every column, known values or not."""
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(exact_quantiles(df, columns, points), "column", "left").select(
        "column", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "q")


def ratio_outcomes(filings: DataFrame) -> DataFrame:
    """How often each guarded ratio had a value, and why not otherwise."""
    debt = C.ratio_reason("liab", "equity", "assets")
    current = C.ratio_reason("cur_assets", "cur_liab", "assets")
    both = filings.select(F.explode(F.array(
        F.struct(F.lit("debt_ratio").alias("ratio"), debt.alias("reason")),
        F.struct(F.lit("current_ratio").alias("ratio"), current.alias("reason")))).alias("x"))
    return both.groupBy("x.ratio", "x.reason").agg(F.count(F.lit(1)).alias("rows"))


def statement_share(filings: DataFrame) -> DataFrame:
    """Rows per statement basis with their share; the totals are a handful of rows."""
    n = filings.groupBy("fs_div").agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy(F.lit(1)))
    return n.select("fs_div", "rows", (F.col("rows") * 100.0 / total).alias("share_pct"))


def sign_statistics(filings: DataFrame) -> DataFrame:
    op, oq = F.col("op_income"), F.col("op_income_quarter")

    def share(x):
        return F.coalesce(F.try_divide(F.count_if(x < 0) * 100.0, F.count(x)), F.lit(0.0))

    return filings.agg(
        F.count_if(op < 0).alias("negative_cumulative"), share(op).alias("negative_cumulative_pct"),
        F.count_if(oq < 0).alias("negative_quarterly"), share(oq).alias("negative_quarterly_pct"),
        F.count_if(F.col("net_income") < 0).alias("negative_net"))


def impaired(filings: DataFrame) -> DataFrame:
    return filings.agg(
        F.count_if("capital_impaired").alias("impaired_rows"),
        F.countDistinct(F.when(F.col("capital_impaired"), F.col("code"))).alias("impaired_codes"))


def never_reported(filings: DataFrame, columns: tuple[str, ...] = ("cur_assets", "cur_liab")) -> DataFrame:
    """Symbols that never reported at least one of the columns."""
    c = filings.groupBy("code").agg(*[F.count(x).alias(x) for x in columns])
    return c.where(reduce(lambda p, q: p | q, [F.col(x) == 0 for x in columns])).select("code")


def absurd_ratios(filings: DataFrame) -> DataFrame:
    high = F.count_if(F.col("debt_ratio_pct") > DEBT_RATIO_ABSURD)
    return filings.agg(high.alias("absurd_rows"), F.coalesce(
        F.try_divide(high * 100.0, F.count("debt_ratio_pct")), F.lit(0.0)).alias("absurd_pct"))


def coverage(filings: DataFrame, live: DataFrame) -> DataFrame:
    """Share of live symbols that have any filing."""
    have = filings.select("code").distinct().withColumn("_f", F.lit(1))
    both = live.select("code").distinct().join(have, "code", "left")
    return both.agg(F.count(F.lit(1)).alias("live"), F.count("_f").alias("covered"),
                    F.coalesce(F.try_divide(F.count("_f") * 100.0, F.count(F.lit(1))), F.lit(0.0))
                    .alias("covered_pct"))


def survivorship_gap(bars: DataFrame, filings: DataFrame, live: DataFrame) -> DataFrame:
    """Symbols of the bar table without any filing, split into still live and gone."""
    ever = bars.select("code").distinct()
    now = live.select("code").distinct().withColumn("_live", F.lit(True))
    missing = ever.join(filings.select("code").distinct(), "code", "left_anti")
    return missing.join(now, "code", "left").select(
        "code", F.when(F.col("_live"), "live").otherwise("gone").alias("state"))


def due_table(filings: DataFrame, today, lag_days=C.DISCLOSURE_LAG_DAYS,
              annual_lag_days=C.ANNUAL_DISCLOSURE_LAG_DAYS) -> DataFrame:
    """The same grid over the years a filing table covers."""
    span = filings.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    years = span.select(F.explode(F.sequence("lo", "hi")).alias("year"))
    return _due(years, today, lag_days, annual_lag_days)


def _due(years: DataFrame, today, lag_days, annual_lag_days) -> DataFrame:
    grid = years.withColumn("quarter", F.explode(F.array(*[F.lit(q) for q in (1, 2, 3, 4)])))
    due = C.disclosure_due_date("year", "quarter", lag_days, annual_lag_days)
    return grid.withColumn("due", due).withColumn(
        "is_due", F.col("due") <= F.lit(today).cast("date"))


def quarter_gaps(filings: DataFrame, fetched: DataFrame, today,
                 quarterly_from: int = QUARTERLY_FROM_YEAR) -> DataFrame:
    """State of every (year, quarter) of the covered years.

    ``fetched`` lists the quarters that were asked for.  The grid has four rows per year.
    """
    n = filings.groupBy("year", "quarter").agg(F.count(F.lit(1)).alias("rows"))
    every = Window.partitionBy(F.lit(1))
    n = n.withColumn("_half", F.percentile("rows", F.lit(0.5)).over(every) * 0.5)
    log = fetched.select("year", "quarter").distinct().withColumn("_asked", F.lit(True))
    g = (due_table(filings, today).join(F.broadcast(n), ["year", "quarter"], "left")
         .join(F.broadcast(log), ["year", "quarter"], "left"))
    state = (F.when(F.col("rows").isNotNull(),
                    F.when(F.col("rows") < F.col("_half"), "thin").otherwise("ok"))
             .when(~F.col("is_due"), "not_due")
             .when((F.col("quarter") < 4) & (F.col("year") < quarterly_from), "no_coverage")
             .when(F.col("_asked"), "no_data").otherwise("never"))
    return g.select("year", "quarter", "due", F.coalesce("rows", F.lit(0)).alias("rows"),
                    state.alias("state"))


def audit_dates(filings: DataFrame, n: int = 8) -> DataFrame:
    """``n`` evenly spaced days between the first and the last disclosure."""
    span = filings.agg(F.min("disclosed_at").alias("lo"), F.max("disclosed_at").alias("hi"))
    step = F.greatest(F.lit(1), F.floor(F.datediff("hi", "lo") / (n - 1))).cast("int")
    return span.select(F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_add("lo", i * step))).alias("date"))


def lookahead_audit(filings: DataFrame, n: int = 8, lookup=as_of) -> DataFrame:
    """Symbols with a filing per audit date and how many of these were disclosed later.

    ``lookup`` is the as-of join under test; it answers every symbol on each of the ``n``
    dates (an array in a scalar subquery), and a right one has no violations.
    """
    dates = audit_dates(filings, n).agg(F.collect_list("date").alias("dates")).scalar()
    probes = (filings.select("code").distinct().withColumn("dates", dates)
              .select("code", F.explode("dates").alias("date")))
    seen = lookup(probes, filings, columns=["code"]).where("disclosed_at IS NOT NULL")
    return seen.groupBy("date").agg(
        F.count(F.lit(1)).alias("symbols"),
        F.count_if(F.col("disclosed_at") > F.col("date")).alias("violations"))


def disclosure_day_probes(filings: DataFrame, code: str, n: int = 4) -> DataFrame:
    """The day before and the day of the last ``n`` disclosures of one symbol."""
    days = (filings.where((F.col("code") == code) & F.col("disclosed_at").isNotNull())
            .select("code", "disclosed_at").distinct().orderBy(F.desc("disclosed_at")).limit(n))
    return days.select("code", F.explode(F.array(F.date_sub("disclosed_at", 1), "disclosed_at"))
                       .alias("date"))


def longest_loss_history(filings: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The symbol with a losing quarter that has the most rows."""
    c = filings.groupBy("code").agg(F.count(F.lit(1)).alias("rows"),
                                    F.count_if(F.col("op_income_quarter") < 0).alias("losses"))
    if exclude:
        c = c.where(~F.col("code").isin(list(exclude)))
    return c.where("losses > 0").orderBy(F.desc("rows"), "code").limit(1).select("code", "rows")


def symbol_sanity(filings: DataFrame, code: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Median of chosen ratios of one symbol against stated bounds."""
    one = filings.where(F.col("code") == code)
    median = F.get("q", F.lit(0))
    limits = F.create_map(*[x for c, (lo, hi) in bounds.items() for x in (
        F.lit(c), F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")))])
    limit = limits[F.col("column")]
    return _per_column(one, list(bounds), [0.5]).select(
        "column", median.alias("median"), median.between(limit["lo"], limit["hi"]).alias("in_range"))


def quality_checks(filings: DataFrame, live: DataFrame) -> DataFrame:
    """All threshold checks as rows (check, value, low, high, status).

    The filing table is read once for all aggregates and once for the medians, which are exact
    (:func:`~barloom.operators.quantiles.exact_quantiles`); the coverage adds one row.
    """
    n = F.count(F.lit(1))
    missing = {c: MISSING_WARN_PCT for c in AMOUNTS if c not in ("cur_assets", "cur_liab")}
    missing |= {"cur_assets": MISSING_WARN_PCT_CURRENT, "cur_liab": MISSING_WARN_PCT_CURRENT}
    limits = {f"missing_{c}": (None, hi) for c, hi in missing.items()}
    limits |= {"median_debt_ratio": DEBT_MEDIAN_RANGE, "median_current_ratio": CURRENT_MEDIAN_RANGE,
               "negative_income_share": (NEGATIVE_SHARE_MIN, None),
               "consolidated_rows": (1.0, None)}
    values = {f"missing_{c}": (n - F.count(c)) * 100.0 / n for c in missing}
    values |= {
        "negative_income_share": F.try_divide(F.count_if(F.col("op_income") < 0) * 100.0,
                                              F.count("op_income")),
        "consolidated_rows": F.count_if(F.col("fs_div") == "CFS").cast("double")}
    one = filings.agg(*[v.alias(k) for k, v in values.items()])
    def row(k, value):
        lo, hi = limits[k]
        return F.struct(F.lit(k).alias("check"), value.cast("double").alias("value"),
                        F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high"))

    rows = F.array(*[row(k, F.col(k)) for k in values])
    ratios = {"debt_ratio_pct": "median_debt_ratio", "current_ratio_pct": "median_current_ratio"}
    median = F.get("q", F.lit(0))
    medians = _per_column(filings, list(ratios), [0.5]).select(F.inline(F.array(*[
        row(k, F.when(F.col("column") == c, median)) for c, k in ratios.items()])), "column")
    medians = medians.where(F.col("check") == F.create_map(*[
        F.lit(x) for pair in ratios.items() for x in pair])[F.col("column")]).drop("column")
    covered = coverage(filings, live).select(
        F.lit("live_coverage").alias("check"), F.col("covered_pct").alias("value"),
        F.lit(LIVE_COVERAGE_MIN).alias("low"), F.lit(None).cast("double").alias("high"))
    checks = one.select(F.inline(rows)).unionByName(medians).unionByName(covered)
    bad = (F.col("value").isNull() | F.coalesce(F.col("value") < F.col("low"), F.lit(False))
           | F.coalesce(F.col("value") > F.col("high"), F.lit(False)))
    return checks.withColumn("status", F.when(bad, "issue").otherwise("ok"))

