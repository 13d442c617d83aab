"""Registered queries: filings, parsing, data-quality report (A7-A14, E8-E16, I, J7-J11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import asof as AO
from ..operators import filings as FO
from ..operators import quality as Q
from ..operators import views as V
from ..sources import bars as S
from ..sources import filings as SF
from . import base
from .base import query, rounded


@query("a7_filings", """WITH $filings
SELECT code, year, quarter, fs_div, coalesce(CAST(disclosed_at AS VARCHAR), '') AS disclosed_at,
       revenue, op_income, coalesce(debt_ratio_pct, -1) AS debt_ratio_pct,
       coalesce(current_ratio_pct, -1) AS current_ratio_pct, CAST(capital_impaired AS BIGINT) AS impaired
FROM filings""")
def a7(spark, sf):
    """Filing table typed by the scanner, ratios and impairment derived (I5, I6)."""
    raw = base.filings(spark, sf).withColumn("unused", F.lit(1)).drop("net_income")
    return SF.type_filings(raw).select(
        "code", "year", "quarter", "fs_div",
        F.coalesce(F.date_format("disclosed_at", "yyyy-MM-dd"), F.lit("")).alias("disclosed_at"),
        "revenue", "op_income", F.coalesce("debt_ratio_pct", F.lit(-1.0)).alias("debt_ratio_pct"),
        F.coalesce("current_ratio_pct", F.lit(-1.0)).alias("current_ratio_pct"),
        F.col("capital_impaired").cast("bigint").alias("impaired"))


@query("a14_filing_status", """WITH $filings
SELECT min(year) AS min_year, max(year) AS max_year, count(*) AS rows, count(DISTINCT code) AS codes
FROM filings""")
def a14(spark, sf):
    return SF.filing_status(base.filings(spark, sf))


_KNOWN_SQL = """known AS (
  SELECT *, CASE WHEN quarter = 1 THEN op_income WHEN pfs = fs_div THEN op_income - pv END AS own
  FROM (SELECT f.*, p.op_income AS pv, p.fs_div AS pfs, row_number() OVER (PARTITION BY f.rid
          ORDER BY coalesce(p.disclosed_at, DATE '0001-01-01') DESC, p.op_income DESC, p.fs_div DESC) AS rn
        FROM (SELECT *, row_number() OVER () AS rid FROM filings) f
        LEFT JOIN filings p ON p.code = f.code AND p.year = f.year AND p.quarter = f.quarter - 1
         AND (f.disclosed_at IS NULL OR p.disclosed_at IS NULL OR p.disclosed_at <= f.disclosed_at))
  WHERE rn = 1)"""


@query("a12_rebuild", f"""WITH $filings, {_KNOWN_SQL}
SELECT code, year, quarter, coalesce(CAST(disclosed_at AS VARCHAR), '') AS disclosed_at,
       coalesce(debt_ratio_pct, -1) AS debt_ratio_pct, CAST(own AS DOUBLE) AS op_income_quarter FROM known""")
def a12(spark, sf):
    """Derived columns of the year tables recomputed from bare quarter parts, restatements too."""
    return SF.rebuild(_parts(spark, sf)).select(
        "code", "year", "quarter", _day("disclosed_at"),
        F.coalesce("debt_ratio_pct", F.lit(-1.0)).alias("debt_ratio_pct"),
        F.col("op_income_quarter").cast("double").alias("op_income_quarter"))


def _day(c):
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")).alias(c)


def _parts(spark, sf):
    """Quarter parts as fetched: every filing and restatement, nothing derived."""
    return base.filings(spark, sf).select("code", "corp_code", "fs_div", "currency", "year", "quarter",
                                          "disclosed_at", *SF.AMOUNTS)


def _versions(spark, sf):
    """The parts with ``version``: 0 as first published, 1 restated (to a smaller income)."""
    again = Window.partitionBy("code", "year", "quarter").orderBy(F.desc("op_income"))
    return _parts(spark, sf).withColumn("version", F.row_number().over(again) - 1)


@query("f24_quarterly_income", f"""WITH $filings, {_KNOWN_SQL}
SELECT code, year, quarter, coalesce(CAST(disclosed_at AS VARCHAR), '') AS disclosed_at,
       CAST(op_income AS DOUBLE) AS cumulative, CAST(own AS DOUBLE) AS quarterly FROM known""")
def f24(spark, sf):
    out = FO.quarterly_from_cumulative(_parts(spark, sf))
    return out.select("code", "year", "quarter", _day("disclosed_at"),
                      F.col("op_income").cast("double").alias("cumulative"),
                      F.col("op_income_quarter").cast("double").alias("quarterly"))


# ------------------------------------------------------------------ account items

# spellings used to print the accounts of the derived filings
_SPELL = [("유동자산", "cur_assets"), ("유동 부채", "cur_liab"), ("자산총계", "assets"),
          ("부채총계", "liab"), ("자본총계", "equity"), ("수익(매출액)", "revenue"),
          ("영업이익(손실)", "op_income"), ("당기순이익의 귀속", "net_income"), ("비유동자산", "assets")]


def _items(spark, sf):
    """Filings printed as account items, the way the filing service answers.

    Odd symbols carry their own stock code, even ones need the company map; negative amounts
    are written in brackets or with a triangle; a separate statement precedes the
    consolidated one and must be ignored.  A restatement is an answer of its own with a later
    receipt.
    """
    f = _versions(spark, sf)
    odd = F.col("code").cast("bigint") % 2 == 1

    def text(c):
        v = F.format_number(F.abs(F.col(c)), 0)
        return (F.when(F.col(c).isNull(), "-").when(F.col(c) >= 0, v)
                .when(odd, F.concat(F.lit("("), v, F.lit(")"))).otherwise(F.concat(F.lit("△ "), v)))

    def item(name, fs, value):
        return F.struct(
            F.col("code").cast("bigint").cast("string").alias("corp_code"),
            F.when(odd, F.col("code")).otherwise("").alias("stock_code"), F.lit(fs).alias("fs_div"),
            F.lit(name).alias("account_nm"), value.alias("thstrm_amount"),
            F.lit("KRW").alias("currency"),
            F.concat(F.date_format(F.date_add(C.disclosure_due_date("year", "quarter"),
                                              60 * F.col("version")), "yyyyMMdd"),
                     F.lit("000123")).alias("rcept_no"))

    separate = [item("매출액", "OFS", F.lit("1"))]
    listed = [item(n, "CFS", text(c)) for n, c in _SPELL]
    return f.select("year", "quarter", "version", F.array(*separate, *listed).alias("list"))


_VERSIONS_SQL = """versions AS (SELECT *, row_number() OVER (
  PARTITION BY code, year, quarter ORDER BY op_income DESC) - 1 AS version FROM filings)"""
_ITEM_SQL = """SELECT code, year, quarter, version, 'CFS' AS fs_div,
       CAST(last_day(make_date(year, quarter * 3, 1)) + CASE WHEN quarter = 4 THEN 90 ELSE 45 END
            + 60 * CAST(version AS INTEGER) AS DATE)
         AS d, coalesce(cur_assets, -1) AS cur_assets, cur_liab, assets, liab, equity, revenue, op_income,
       net_income FROM versions
WHERE corp_code <> '00000000' /* an all-zero company code is no company */"""


@query("e20_pivot_items", f"""WITH $filings, {_VERSIONS_SQL}, x AS ({_ITEM_SQL})
SELECT * EXCLUDE (d), CAST(d AS VARCHAR) AS disclosed_at FROM x""")
def e20(spark, sf):
    """JSON payload text -> items -> one row per company, symbol from the item or the map."""
    payload = F.to_json(F.struct(F.lit("000").alias("status"), F.lit("ok").alias("message"), "list"))
    items = SF.account_items(SF.parse_payloads(
        _items(spark, sf).select("year", "quarter", "version", payload.alias("payload"))))
    rows = FO.pivot_items(items, ("year", "quarter", "version"))
    companies = SF.listed_companies(_company_entries(spark, sf)).select("corp_code", "code")
    out = SF.attach_symbol(rows, companies)
    return out.select("code", "year", "quarter", "version", "fs_div", "disclosed_at",
                      F.coalesce("cur_assets", F.lit(-1)).alias("cur_assets"),
                      *[c for c in SF.AMOUNTS if c != "cur_assets"])


def _company_entries(spark, sf):
    """Company list: every supplier twice (old and new entry) plus unlisted companies."""
    s = base.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    code = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    return s.select(
        F.col("s_suppkey").cast("string").alias("corp_code"), F.col("s_name").alias("corp_name"),
        F.explode(F.array(
            F.struct(F.concat(F.lit(" "), code).alias("stock_code"), F.lit("20200101").alias("modify_date")),
            F.struct(code.alias("stock_code"), F.lit("20230101").alias("modify_date")),
            F.struct(F.lit(" ").alias("stock_code"), F.lit("20240101").alias("modify_date")))).alias("e")
    ).select("corp_code", "corp_name", "e.*")


@query("a10_listed_companies", """
SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS corp_code, s_name AS corp_name,
       lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, '20230101' AS modify_date FROM supplier""")
def a10(spark, sf):
    return SF.listed_companies(_company_entries(spark, sf))


@query("a9_payload_status", """WITH $filings
SELECT quarter, count(*) AS payloads, CAST(count(*) FILTER (WHERE quarter IN (1, 2)) * 10 AS BIGINT) AS items,
       CAST(count(*) FILTER (WHERE quarter = 4) AS BIGINT) AS rejected FROM filings GROUP BY quarter""")
def a9(spark, sf):
    """Two answers with data, one without, one refused: items only from the first two."""
    status = F.when(F.col("quarter") <= 2, "000").when(F.col("quarter") == 3, "013").otherwise("020")
    p = _items(spark, sf).select("quarter", F.to_json(F.struct(
        status.alias("status"), F.lit("m").alias("message"), "list")).alias("payload"))
    parsed = SF.parse_payloads(p)
    n = parsed.groupBy("quarter").agg(F.count(F.lit(1)).alias("payloads"))
    items = SF.account_items(parsed).groupBy("quarter").agg(F.count(F.lit(1)).alias("items"))
    bad = SF.rejected_payloads(parsed).groupBy("quarter").agg(F.count(F.lit(1)).alias("rejected"))
    return n.join(items, "quarter", "left").join(bad, "quarter", "left").select(
        "quarter", "payloads", F.coalesce("items", F.lit(0)).alias("items"),
        F.coalesce("rejected", F.lit(0)).alias("rejected"))


@query("i1_scalar_functions", """WITH $filings, x AS (SELECT *, i % 6 AS v FROM filings)
SELECT code, year, quarter,
       CASE v WHEN 0 THEN 'revenue' WHEN 1 THEN 'op_income' WHEN 2 THEN 'net_income' WHEN 3 THEN 'revenue'
              WHEN 4 THEN 'op_income' ELSE 'none' END AS account,
       CASE v WHEN 0 THEN revenue WHEN 1 THEN -revenue WHEN 2 THEN -revenue WHEN 3 THEN -revenue
              WHEN 4 THEN -1 ELSE -revenue END AS amount,
       CASE WHEN v < 5 THEN strftime(last_day(make_date(year, quarter * 3, 1)), '%Y-%m-%d') ELSE '' END AS received,
       CAST(strftime(last_day(make_date(year, quarter * 3, 1)), '%Y%m%d') AS INTEGER) AS day_number,
       CAST(revenue // 7 AS BIGINT) AS shares FROM x""")
def i1(spark, sf):
    """Account names, amount texts, receipt numbers, date numbers and share counts."""
    f = _parts(spark, sf)
    v = (F.col("year") * 4 + F.col("quarter")) % 6
    names = F.array(*[F.lit(n) for n in ("영업 수익", "영업이익(손실)", "당기순이익(손실)", "매출액(순)",
                                         "영업이익률", "자본금")])
    n = F.format_number("revenue", 0)
    texts = F.array(n, F.concat(F.lit("("), n, F.lit(")")), F.concat(F.lit("△"), n),
                    F.concat(F.lit("▲ "), n), F.lit("N/A"), F.concat(F.lit("-"), n))
    end = C.quarter_end("year", "quarter")
    number = F.when(v < 5, F.concat(F.date_format(end, "yyyyMMdd"), F.lit("-000777"))).otherwise(
        F.lit("20209999000777"))
    return f.select(
        "code", "year", "quarter",
        F.coalesce(C.normalize_account(F.get(names, v)), F.lit("none")).alias("account"),
        F.coalesce(C.parse_amount(F.get(texts, v)), F.lit(-1)).alias("amount"),
        F.coalesce(F.date_format(C.receipt_date(number), "yyyy-MM-dd"), F.lit("")).alias("received"),
        C.yyyymmdd(end).alias("day_number"),
        C.entry_quantity(F.col("revenue").cast("double"), 100.0, F.lit(7.0)).alias("shares"))


@query("i6_ratio_reasons", """WITH $filings
SELECT code, year, quarter, CASE WHEN cur_assets IS NULL OR cur_liab IS NULL THEN 'missing'
       WHEN cur_liab <= 0 THEN 'nonpositive' WHEN cur_liab < assets * 0.0001 THEN 'tiny' ELSE 'ok' END AS reason,
       CASE WHEN equity <= 0 THEN 'nonpositive' WHEN equity < assets * 0.0001 THEN 'tiny' ELSE 'ok' END AS debt_reason
FROM filings""")
def i6(spark, sf):
    return base.filings(spark, sf).select(
        "code", "year", "quarter", C.ratio_reason("cur_assets", "cur_liab", "assets").alias("reason"),
        C.ratio_reason("liab", "equity", "assets").alias("debt_reason"))


# ------------------------------------------------------------------ report


@query("e8_rows_by_quarter", """WITH $filings
SELECT year, """ + ", ".join(f"CAST(count(*) FILTER (WHERE quarter = {q}) AS BIGINT) AS q{q}"
                             for q in (1, 2, 3, 4)) + ", count(*) AS total FROM filings GROUP BY year")
def e8(spark, sf):
    return Q.rows_by_quarter(base.filings(spark, sf))


_MISSING = ["cur_assets", "debt_ratio_pct", "current_ratio_pct", "op_income_quarter", "disclosed_at"]


@query("e9_missing_rates", "WITH $filings " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS known, count(*) - count({c}) AS missing,
    round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 4) AS missing_pct FROM filings"""
    for c in _MISSING))
def e9(spark, sf):
    return rounded(Q.missing_rates(base.filings(spark, sf), _MISSING), 4, "missing_pct")


_DIST = ["debt_ratio_pct", "current_ratio_pct", "op_income_quarter"]


@query("e10_distribution", "WITH $filings " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(min({c})::DOUBLE, 4) AS "min",
    round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median,
    round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, round(max({c})::DOUBLE, 4) AS "max" FROM filings"""
    for c in _DIST))
def e10(spark, sf):
    return rounded(Q.distribution(base.filings(spark, sf), _DIST), 4, "min", "p25", "median",
                   "p75", "max")


@query("e11_ratio_outcomes", """WITH $filings, r AS (
  SELECT 'current_ratio' AS ratio, CASE WHEN cur_assets IS NULL OR cur_liab IS NULL THEN 'missing'
       WHEN cur_liab <= 0 THEN 'nonpositive' WHEN cur_liab < assets * 0.0001 THEN 'tiny' ELSE 'ok' END AS reason
  FROM filings UNION ALL
  SELECT 'debt_ratio', CASE WHEN equity <= 0 THEN 'nonpositive' WHEN equity < assets * 0.0001 THEN 'tiny'
       ELSE 'ok' END FROM filings)
SELECT ratio, reason, count(*) AS rows FROM r GROUP BY 1, 2""")
def e11(spark, sf):
    return Q.ratio_outcomes(base.filings(spark, sf))


@query("e12_statement_share", """WITH $filings
SELECT fs_div, count(*) AS rows, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS share_pct
FROM filings GROUP BY fs_div""")
def e12(spark, sf):
    return rounded(Q.statement_share(base.filings(spark, sf)), 4, "share_pct")


@query("e13_sign_statistics", """WITH $filings
SELECT CAST(count(*) FILTER (WHERE op_income < 0) AS BIGINT) AS negative_cumulative,
       round(count(*) FILTER (WHERE op_income < 0) * 100.0::DOUBLE / count(op_income), 4) AS negative_cumulative_pct,
       CAST(count(*) FILTER (WHERE op_income_quarter < 0) AS BIGINT) AS negative_quarterly,
       round(count(*) FILTER (WHERE op_income_quarter < 0) * 100.0::DOUBLE / count(op_income_quarter), 4)
         AS negative_quarterly_pct,
       CAST(count(*) FILTER (WHERE net_income < 0) AS BIGINT) AS negative_net FROM filings""")
def e13(spark, sf):
    return rounded(Q.sign_statistics(base.filings(spark, sf)), 4, "negative_cumulative_pct",
                   "negative_quarterly_pct")


@query("e14_impaired", """WITH $filings
SELECT CAST(count(*) FILTER (WHERE equity <= 0) AS BIGINT) AS impaired_rows,
       count(DISTINCT CASE WHEN equity <= 0 THEN code END) AS impaired_codes FROM filings""")
def e14(spark, sf):
    return Q.impaired(base.filings(spark, sf))


@query("e15_never_reported", """WITH $filings
SELECT code FROM filings GROUP BY code HAVING count(cur_assets) = 0 OR count(cur_liab) = 0""")
def e15(spark, sf):
    return Q.never_reported(base.filings(spark, sf))


@query("e16_absurd_ratios", """WITH $filings
SELECT CAST(count(*) FILTER (WHERE debt_ratio_pct > 10000) AS BIGINT) AS absurd_rows,
       round(count(*) FILTER (WHERE debt_ratio_pct > 10000) * 100.0::DOUBLE / count(debt_ratio_pct), 4) AS absurd_pct
FROM filings""")
def e16(spark, sf):
    return rounded(Q.absurd_ratios(base.filings(spark, sf)), 4, "absurd_pct")


def _live(spark, sf):
    return S.symbol_snapshot(base.raw_bars(spark, sf))


_LIVE_SQL = "live AS (SELECT code FROM raw_bars WHERE date = (SELECT max(date) FROM raw_bars))"
_SOME_SQL = "part_f AS (SELECT * FROM filings WHERE CAST(code AS BIGINT) % 4 <> 1)"


def _some_filings(spark, sf):
    """A filing table that lacks every fourth symbol (the gap the report must find)."""
    return base.filings(spark, sf).where(F.col("code").cast("bigint") % 4 != 1)


@query("h2_coverage", f"""WITH $raw_bars, $filings, {_LIVE_SQL}, {_SOME_SQL}
SELECT count(*) AS live, CAST(count(*) FILTER (WHERE code IN (SELECT code FROM part_f)) AS BIGINT) AS covered,
       round(count(*) FILTER (WHERE code IN (SELECT code FROM part_f)) * 100.0::DOUBLE / count(*), 4) AS covered_pct
FROM live""")
def h2(spark, sf):
    return rounded(Q.coverage(_some_filings(spark, sf), _live(spark, sf)), 4, "covered_pct")


@query("h3_survivorship_gap", f"""WITH $raw_bars, $filings, {_LIVE_SQL}, {_SOME_SQL}
SELECT code, CASE WHEN code IN (SELECT code FROM live) THEN 'live' ELSE 'gone' END AS state
FROM (SELECT DISTINCT code FROM raw_bars) WHERE code NOT IN (SELECT code FROM part_f)""")
def h3(spark, sf):
    return Q.survivorship_gap(base.raw_bars(spark, sf), _some_filings(spark, sf), _live(spark, sf))


_GAPPY_SQL = """gappy AS (SELECT * FROM filings WHERE NOT (i % 7 = 0) AND NOT (i % 11 = 0
  AND CAST(code AS BIGINT) % 5 <> 0)),
n AS (SELECT year, quarter, count(*) AS rows FROM gappy GROUP BY 1, 2),
grid AS (SELECT y.year, q.quarter, CAST(last_day(make_date(CAST(y.year AS INTEGER), q.quarter * 3, 1))
           + CASE WHEN q.quarter = 4 THEN 90 ELSE 45 END AS DATE) AS due
         FROM (SELECT unnest(range((SELECT min(year) FROM gappy), (SELECT max(year) FROM gappy) + 1)) AS year) y
         CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS quarter) q)"""


@query("j7_quarter_gaps", f"""WITH $filings, {_GAPPY_SQL}
SELECT g.year, CAST(g.quarter AS BIGINT) AS quarter, CAST(due AS VARCHAR) AS due, coalesce(rows, 0) AS rows,
  CASE WHEN rows IS NOT NULL THEN CASE WHEN rows < (SELECT quantile_cont(rows, 0.5) * 0.5 FROM n)
            THEN 'thin' ELSE 'ok' END
       WHEN due > DATE '2001-12-31' THEN 'not_due' WHEN g.quarter < 4 AND g.year < 1998 THEN 'no_coverage'
       WHEN g.quarter = 2 THEN 'no_data' ELSE 'never' END AS state
FROM grid g LEFT JOIN n ON g.year = n.year AND g.quarter = n.quarter""")
def j7(spark, sf):
    i = F.col("year") * 4 + F.col("quarter")
    f = base.filings(spark, sf)
    gappy = f.where(~(i % 7 == 0) & ~((i % 11 == 0) & (F.col("code").cast("bigint") % 5 != 0)))
    asked = f.where("quarter = 2").select("year", "quarter")
    return Q.quarter_gaps(gappy, asked, "2001-12-31", quarterly_from=1998)


@query("j8_lookahead_audit", """WITH $filings, s AS (
  SELECT min(disclosed_at) AS lo, max(disclosed_at) AS hi FROM filings),
d AS (SELECT CAST(lo + CAST(k * greatest(1, date_diff('day', lo, hi) // 7) AS INTEGER) AS DATE) AS date
      FROM s, (SELECT unnest(range(8)) AS k))
SELECT CAST(d.date AS VARCHAR) AS date, count(DISTINCT code) AS symbols, CAST(0 AS BIGINT) AS violations
FROM d JOIN filings f ON f.disclosed_at <= d.date GROUP BY d.date""")
def j8(spark, sf):
    return Q.lookahead_audit(base.filings(spark, sf))


@query("j8_disclosure_day_probes", """WITH $filings, d AS (
  SELECT DISTINCT disclosed_at FROM filings WHERE code = '000003' AND disclosed_at IS NOT NULL
  ORDER BY 1 DESC LIMIT 4),
p AS (SELECT CAST(disclosed_at - 1 AS DATE) AS date FROM d UNION SELECT disclosed_at FROM d),
r AS (SELECT p.date, f.*, row_number() OVER (PARTITION BY p.date
        ORDER BY year DESC, quarter DESC, disclosed_at DESC) AS rn
      FROM p JOIN filings f ON f.code = '000003' AND f.disclosed_at <= p.date)
SELECT code, CAST(date AS VARCHAR) AS date, year, quarter, CAST(disclosed_at AS VARCHAR) AS disclosed_at
FROM r WHERE rn = 1""")
def j8b(spark, sf):
    f = base.filings(spark, sf)
    probes = Q.disclosure_day_probes(f, "000003").distinct()
    return AO.as_of(probes, f, columns=["fs_div"]).drop("fs_div")


@query("j9_quality_checks", f"""WITH $raw_bars, $filings, {_LIVE_SQL}, c AS (
  {' UNION ALL '.join(f"SELECT 'missing_{c}' AS k, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS v, NULL::DOUBLE AS lo, {55.0 if c.startswith('cur_') else 30.0}::DOUBLE AS hi FROM filings" for c in SF.AMOUNTS)}
  UNION ALL SELECT 'median_debt_ratio', quantile_cont(debt_ratio_pct, 0.5), 5, 400 FROM filings
  UNION ALL SELECT 'median_current_ratio', quantile_cont(current_ratio_pct, 0.5), 30, 1000 FROM filings
  UNION ALL SELECT 'negative_income_share', count(*) FILTER (WHERE op_income < 0) * 100.0::DOUBLE
                   / count(op_income), 3, NULL FROM filings
  UNION ALL SELECT 'consolidated_rows', count(*) FILTER (WHERE fs_div = 'CFS'), 1, NULL FROM filings
  UNION ALL SELECT 'live_coverage', count(*) FILTER (WHERE code IN (SELECT code FROM filings)) * 100.0::DOUBLE
                   / count(*), 80, NULL FROM live)
SELECT k AS "check", round(v, 4) AS value, lo AS low, hi AS high,
       CASE WHEN v IS NULL OR coalesce(v < lo, false) OR coalesce(v > hi, false) THEN 'issue' ELSE 'ok' END AS status
FROM c""")
def j9(spark, sf):
    return rounded(Q.quality_checks(base.filings(spark, sf), _live(spark, sf)), 4, "value")


@query("j10_symbol_sanity", """WITH $filings, m AS (
  SELECT quantile_cont(debt_ratio_pct, 0.5) AS d, quantile_cont(current_ratio_pct, 0.5) AS c
  FROM filings WHERE code = '000002')
SELECT 'debt_ratio_pct' AS "column", round(d, 4) AS median, CAST(d BETWEEN 10 AND 200 AS BIGINT) AS in_range FROM m
UNION ALL SELECT 'current_ratio_pct', round(c, 4), CAST(c BETWEEN 150 AND 500 AS BIGINT) FROM m""")
def j10(spark, sf):
    out = Q.symbol_sanity(base.filings(spark, sf), "000002",
                          {"debt_ratio_pct": (10.0, 200.0), "current_ratio_pct": (150.0, 500.0)})
    return rounded(out, 4, "median").withColumn("in_range", F.col("in_range").cast("bigint"))


@query("j11_due_table", """WITH $filings
SELECT y.year, CAST(q AS BIGINT) AS quarter, CAST(due AS VARCHAR) AS due, CAST(due <= DATE '2000-06-30' AS BIGINT) AS is_due
FROM (SELECT year, q, CAST(last_day(make_date(CAST(year AS INTEGER), q * 3, 1))
        + CASE WHEN q = 4 THEN 90 ELSE 45 END AS DATE) AS due
      FROM (SELECT unnest(range((SELECT min(year) FROM filings), (SELECT max(year) FROM filings) + 1)) AS year),
           (SELECT unnest([1, 2, 3, 4]) AS q)) y""")
def j11(spark, sf):
    return Q.due_table(base.filings(spark, sf), "2000-06-30").withColumn(
        "is_due", F.col("is_due").cast("bigint"))


@query("g6_longest_loss_history", """WITH $filings
SELECT code, count(*) AS rows FROM filings GROUP BY code
HAVING count(*) FILTER (WHERE op_income_quarter < 0) > 0 ORDER BY rows DESC, code LIMIT 1""")
def g6(spark, sf):
    return Q.longest_loss_history(base.filings(spark, sf))


@query("g7_last_quarters", """WITH $filings
SELECT code, year, quarter, revenue FROM (SELECT *, row_number() OVER (PARTITION BY code
  ORDER BY year DESC, quarter DESC, disclosed_at DESC NULLS LAST, op_income) AS rn FROM filings) WHERE rn <= 12""")
def g7(spark, sf):
    order = [F.desc("year"), F.desc("quarter"), F.desc_nulls_last("disclosed_at"), F.asc("op_income")]
    return V.last_per_symbol(base.filings(spark, sf), 12, order).select(
        "code", "year", "quarter", "revenue")
