"""Company filings: yearly tables, the company map, the account API payload, quarter parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import pad_code

AMOUNTS = ["cur_assets", "cur_liab", "assets", "liab", "equity", "revenue", "op_income",
           "net_income"]

# Column names of stored filing tables -> our names.
RAW_FILING_COLUMNS = {
    "유동자산": "cur_assets", "유동부채": "cur_liab", "자산총계": "assets", "부채총계": "liab",
    "자본총계": "equity", "매출액": "revenue", "영업이익": "op_income", "당기순이익": "net_income",
}

FILING_TYPES = {
    "code": "string", "corp_code": "string", "fs_div": "string", "currency": "string",
    "year": "int", "quarter": "tinyint", "disclosed_at": "date",
    **{c: "bigint" for c in AMOUNTS},
    "debt_ratio_pct": "double", "current_ratio_pct": "double",
    "op_income_quarter": "bigint", "capital_impaired": "boolean",
}

ITEM = T.StructType([T.StructField(n, T.StringType()) for n in (
    "corp_code", "stock_code", "fs_div", "account_nm", "thstrm_amount", "currency", "rcept_no")])
PAYLOAD = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("list", T.ArrayType(ITEM)),
])

# Payload status "data follows" and "no data for this query".
STATUS_OK = "000"
STATUS_NO_DATA = "013"


def type_filings(raw: DataFrame) -> DataFrame:
    """Our columns with fixed types; unknown columns dropped, absent ones NULL."""
    have = {RAW_FILING_COLUMNS.get(c, c): c for c in raw.columns}
    out = []
    for name, dtype in FILING_TYPES.items():
        value = F.col(f"`{have[name]}`") if name in have else F.lit(None)
        out.append((pad_code(value) if name == "code" and name in have
                    else value.try_cast(dtype)).alias(name))
    return raw.select(*out)


def scan_filings(spark: SparkSession, root: str) -> DataFrame:
    """Union of ``fundamentals-YYYY.parquet``; restated rows stay as extra rows."""
    return type_filings(spark.read.option("mergeSchema", "true")
                        .parquet(f"{root.rstrip('/')}/fundamentals-*.parquet"))


def corp_map(spark: SparkSession, path: str) -> DataFrame:
    """Company <-> symbol dimension; empty when the table does not exist yet."""
    from pyspark.errors import AnalysisException

    schema = "corp_code string, corp_name string, code string, modify_date string"
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return df.select(*[F.col(c).cast("string") for c in
                       ("corp_code", "corp_name", "code", "modify_date")])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Account API answers, one JSON document per file."""
    return spark.read.schema(PAYLOAD).option("multiLine", "true").json(path)


def parse_payloads(df: DataFrame, column: str = "payload") -> DataFrame:
    """Same, from a text column."""
    return df.withColumn(column, F.from_json(column, PAYLOAD)).select(
        *[c for c in df.columns if c != column], f"{column}.*")


def account_items(payloads: DataFrame) -> DataFrame:
    """One row per account item with its position; "no data" answers give no rows."""
    keep = [c for c in payloads.columns if c not in ("status", "message", "list")]
    return (payloads.where(F.col("status") == STATUS_OK)
            .select(*keep, F.posexplode("list").alias("pos", "item"))
            .select(*keep, "pos", "item.*"))


def rejected_payloads(payloads: DataFrame) -> DataFrame:
    """Answers with any other status, to be written to a quarantine table."""
    return payloads.where(~F.coalesce(F.col("status").isin(STATUS_OK, STATUS_NO_DATA),
                                      F.lit(False))).drop("list")


def read_company_list(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("xml").option("rowTag", "list")
            .schema("corp_code string, corp_name string, stock_code string, modify_date string")
            .load(path))


def listed_companies(entries: DataFrame) -> DataFrame:
    """Entries with a six-digit symbol; the latest ``modify_date`` wins per symbol."""
    e = entries.select(
        F.lpad(F.trim("corp_code"), 8, "0").alias("corp_code"),
        F.trim("corp_name").alias("corp_name"),
        F.trim("stock_code").alias("code"),
        F.trim("modify_date").alias("modify_date"),
    ).where(F.col("code").rlike(r"^\d{6}$"))
    newest = Window.partitionBy("code").orderBy(F.desc_nulls_last("modify_date"), "corp_code")
    return (e.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn"))


def attach_symbol(rows: DataFrame, companies: DataFrame, own: str = "stock_code") -> DataFrame:
    """Symbol of a filing row: its own code, else the company map's; others are dropped.

    The company list may be large on a wide universe; Spark broadcasts it only below
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    six = r"^\d{6}$"
    mapped = companies.select("corp_code", F.col("code").alias("mapped_code"))
    own_code = F.when(F.trim(own).rlike(six), F.trim(own))
    return (rows.join(mapped, "corp_code", "left")
            .withColumn("code", F.coalesce(own_code, "mapped_code"))
            .where(F.col("code").rlike(six)).drop("mapped_code", own))


def write_parts(rows: DataFrame, path: str) -> None:
    """Quarter parts; a re-fetched (year, quarter) replaces only its own partition."""
    (rows.repartition("year", "quarter").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("year", "quarter").parquet(path))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return type_filings(spark.read.parquet(path))


def rebuild(parts: DataFrame) -> DataFrame:
    """Year tables from quarter parts: derived columns are recomputed, nothing is fetched."""
    from ..operators.filings import derive_columns

    return derive_columns(parts.select(*[c for c in FILING_TYPES if c in parts.columns]))


def write_years(filings: DataFrame, path: str) -> None:
    (filings.withColumn("y", F.col("year")).repartitionByRange("y", "code")
     .sortWithinPartitions("y", "code").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("y").parquet(path))


def filing_status(filings: DataFrame) -> DataFrame:
    return filings.agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"),
                       F.count(F.lit(1)).alias("rows"),
                       F.countDistinct("code").alias("codes"))


def period_index(year: Column | str = "year", quarter: Column | str = "quarter") -> Column:
    y = F.col(year) if isinstance(year, str) else year
    q = F.col(quarter) if isinstance(quarter, str) else quarter
    return y.cast("int") * 4 + q.cast("int")
