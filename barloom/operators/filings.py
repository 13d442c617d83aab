"""Filing rows from account items, derived ratios, quarterly figures from cumulative ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.filings import AMOUNTS


def pivot_items(items: DataFrame, keys: tuple[str, ...] = ("year", "quarter")) -> DataFrame:
    """Account items -> one row per company and period.

    Consolidated statements win over separate ones, which win over anything else; within the
    chosen statement the first non-NULL amount of each account counts.  The preferred
    statement is found with the same hash aggregation (one shuffle on the company), so no
    window sorts the items.
    """
    corp = F.lpad(F.trim(F.coalesce("corp_code", F.lit(""))), 8, "0")
    fs = F.upper(F.trim(F.coalesce("fs_div", F.lit(""))))
    x = items.select(
        *keys, "pos", corp.alias("corp_code"),
        F.when(fs == "", F.lit("OFS")).otherwise(fs).alias("fs_div"),
        C.normalize_account("account_nm").alias("account"),
        C.parse_amount("thstrm_amount").alias("amount"),
        F.trim("stock_code").alias("stock_code"), F.trim("currency").alias("currency"),
        F.trim("rcept_no").alias("rcept_no"),
    ).where(F.col("corp_code") != "00000000")
    six = F.col("stock_code").rlike(r"^\d{6}$")
    per_statement = x.groupBy(*keys, "corp_code", "fs_div").agg(
        F.min("pos").alias("first_pos"),
        F.min_by(F.when(six, F.col("stock_code")), F.when(six, F.col("pos"))).alias("stock_code"),
        F.min_by("currency", F.when(F.col("currency") != "", F.col("pos"))).alias("currency"),
        F.max(F.when(F.col("rcept_no") != "", F.col("rcept_no"))).alias("rcept_no"),
        *[F.min_by("amount", F.when((F.col("account") == a) & F.col("amount").isNotNull(),
                                    F.col("pos"))).alias(a) for a in AMOUNTS])
    order = (F.when(F.col("fs_div") == "CFS", 0).when(F.col("fs_div") == "OFS", 1)
             .otherwise(2))
    best = Window.partitionBy(*keys, "corp_code").orderBy(order, "first_pos")
    return (per_statement.withColumn("rn", F.row_number().over(best)).where("rn = 1")
            .select(*keys, "corp_code", "fs_div", "stock_code",
                    F.coalesce("currency", F.lit("KRW")).alias("currency"),
                    C.receipt_date("rcept_no").alias("disclosed_at"), *AMOUNTS))


def quarterly_from_cumulative(filings: DataFrame, value: str = "op_income",
                              out: str = "op_income_quarter") -> DataFrame:
    """Year-to-date value -> value of the quarter itself, as known when the row was disclosed.

    Unknown when the previous quarter is missing, was not yet disclosed, or was reported on
    another basis.  A quarter may have been restated any number of times: each row subtracts the
    version of the previous quarter that was the newest on the row's own disclosure day, so no
    row sees a restatement of its future.  A version without a disclosure date counts as the
    oldest one, and a row without one sees all versions.  Versions of one day: the greater value,
    then the later basis.

    One exchange on company and year; the newest version of each quarter is a running maximum
    over the disclosure days, which is linear in the rows.
    """
    year = Window.partitionBy("corp_code", "year")
    known = (year.orderBy(F.asc_nulls_first("disclosed_at"))
             .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    version = F.struct(F.coalesce("disclosed_at", F.lit("0001-01-01").cast("date")).alias("at"),
                       F.col(value).alias("v"), F.col("fs_div").alias("fs"))
    quarter = F.col("quarter").cast("int")
    newest = lambda q, over: F.max(F.when(quarter == q, version)).over(over)
    before = [F.when(F.col("disclosed_at").isNull(), newest(q, year)).otherwise(newest(q, known))
              for q in (1, 2, 3)]
    df = filings.withColumn("_before", F.when(quarter.between(2, 4), F.get(F.array(*before), quarter - 2)))
    own = F.when(quarter == 1, F.col(value)).when(
        F.col("_before").isNotNull() & F.col("_before.fs").eqNullSafe(F.col("fs_div")),
        F.col(value) - F.col("_before.v"))
    return df.withColumn(out, own.cast("bigint")).drop("_before")


def derive_columns(filings: DataFrame) -> DataFrame:
    """Recompute ratios, the impairment flag and the quarterly operating income."""
    return quarterly_from_cumulative(filings.withColumns({
        "debt_ratio_pct": C.guarded_ratio("liab", "equity", "assets"),
        "current_ratio_pct": C.guarded_ratio("cur_assets", "cur_liab", "assets"),
        "capital_impaired": C.capital_impaired("equity"),
    }))
