from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.functions import columns as C
from barloom.sources import bars as S
from barloom.sources import filings as SF
from barloom.sources.sinks import write_result


def _column(df, name):
    return [r[name] for r in df.collect()]


def test_halted_mask_ignores_volume(spark):
    rows = [(1, 10., 11., 9., 10., 5.), (2, 0., 0., 0., 10., 0.), (3, 10., 11., 9., 10., 0.),
            (4, 0., 0., 0., 10., 11000.), (5, float("nan"), 11., 9., 10., 1.), (6, None, 1., 1., 1., 1.)]
    df = spark.createDataFrame(rows, "i int, open double, high double, low double, close double, volume double")
    df = df.withColumn("open", C.finite("open"))
    assert _column(df.withColumn("h", S.halted()).orderBy("i"), "h") == [
        False, True, False, True, True, True]


def test_yearly_files_with_short_codes_and_missing_columns(spark, tmp_path):
    new = spark.createDataFrame([(dt.date(2024, 1, 2), "005930", 1., 2., 1., 2., 10.)],
                                "Date date, Code string, Open double, High double, Low double, Close double, Volume double")
    old = spark.createDataFrame([("2023-01-02", "5930", 1., 2., 1., 2.)],
                                "Date string, Code string, Open double, High double, Low double, Close double")
    new.write.parquet(str(tmp_path / "marcap-2024.parquet"))
    old.withColumn("Date", F.to_date("Date")).write.parquet(str(tmp_path / "marcap-2023.parquet"))
    raw = S.scan_bars(spark, str(tmp_path))
    bars = S.normalize_bars(raw)
    assert {(r.code, r.year if "year" in bars.columns else None) for r in bars.collect()} == {
        ("005930", r) for r in _column(bars, "year")}
    assert _column(bars.orderBy("date"), "volume") == [None, 10.0]
    assert S.raw_symbol_rows(raw, "5930").count() == 2
    assert S.scan_bars(spark, str(tmp_path), (2024, 2024)).count() == 1


def test_partitioned_store_prunes_years(spark, tmp_path, make_bars):
    bars = make_bars({"000010": [(1, 2, 1, 2)] * 300}).drop("is_event")
    S.write_bars(bars, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    cut = S.panel(back, "2025-01-01", "2025-12-31", ["close"])
    plan = cut._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert cut.columns == ["date", "code", "close", "halted"]
    assert cut.count() == bars.where("year(date) = 2025").count() > 0


def test_reversed_range_is_refused(make_bars):
    with pytest.raises(ValueError):
        S.panel(make_bars({"000010": [(1, 2, 1, 2)]}), "2025-01-02", "2025-01-01")


def test_long_codes_stay_whole(spark):
    df = spark.createDataFrame([("5930",), ("005930",), ("1234567",)], "c string")
    assert _column(df.select(C.pad_code("c").alias("c")), "c") == ["005930", "005930", "1234567"]
    assert C.code_variants("5930") == ["005930", "05930", "5930"]


def test_amount_texts(spark):
    cases = {"1,234": 1234, "(1,234)": -1234, "△500": -500, "▲ 500": -500, "-7": -7, "−7": -7,
             "": None, "-": None, "N/A": None, "abc": None, "12.6": 13, None: None, "0": 0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.v for r in df.withColumn("v", C.parse_amount("t")).collect()}
    assert got == cases


def test_account_names(spark):
    cases = {"유동자산": "cur_assets", " 자산 총계 ": "assets", "수익(매출액)": "revenue",
             "영업이익(손실)": "op_income", "당기순이익의귀속": "net_income", "비유동자산": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.v for r in df.withColumn("v", C.normalize_account("n")).collect()} == cases


def test_receipt_dates(spark):
    cases = {"20240315000123": dt.date(2024, 3, 15), "2024-03-15": dt.date(2024, 3, 15),
             "20241399000000": None, "2024": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.v for r in df.withColumn("v", C.receipt_date("n")).collect()} == cases


def test_due_dates(spark):
    df = spark.createDataFrame([(2024, q) for q in (1, 2, 3, 4)], "y int, q int")
    assert _column(df.select(C.disclosure_due_date("y", "q").alias("d")), "d") == [
        dt.date(2024, 5, 15), dt.date(2024, 8, 14), dt.date(2024, 11, 14), dt.date(2025, 3, 31)]


def test_company_list_from_xml(spark, tmp_path):
    entry = "<list><corp_code>{}</corp_code><corp_name>{}</corp_name><stock_code>{}</stock_code><modify_date>{}</modify_date></list>"
    body = "".join(entry.format(*e) for e in [("126380", "A", "005930", "20200101"),
                                              ("999", "B", "005930", "20240101"), ("1", "C", " ", "20240101")])
    (tmp_path / "corp.xml").write_text(f"<result>{body}</result>", encoding="utf-8")
    got = SF.listed_companies(SF.read_company_list(spark, str(tmp_path / "corp.xml"))).collect()
    assert [(r.corp_code, r.code) for r in got] == [("00000999", "005930")]


def test_payload_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"status": "000", "message": "ok", "list": [{"corp_code": "1", "account_nm": "매출액"}]}')
    (tmp_path / "b.json").write_text('{"status": "013", "message": "none"}')
    (tmp_path / "c.json").write_text('{"status": "020", "message": "limit"}')
    p = SF.read_payloads(spark, str(tmp_path))
    assert SF.account_items(p).count() == 1
    assert _column(SF.rejected_payloads(p), "status") == ["020"]


def test_quarter_parts_replace_only_their_own(spark, tmp_path):
    def rows(q, v):
        return spark.createDataFrame([("000010", "00000010", "CFS", 2024, q, v)],
                                     "code string, corp_code string, fs_div string, year int, quarter int, op_income long")

    path = str(tmp_path / "parts")
    SF.write_parts(rows(1, 100).unionByName(rows(2, 250)), path)
    SF.write_parts(rows(2, 260), path)
    out = SF.rebuild(SF.read_parts(spark, path)).orderBy("quarter").collect()
    assert [(r.quarter, r.op_income, r.op_income_quarter) for r in out] == [(1, 100, 100), (2, 260, 160)]
    SF.write_years(SF.rebuild(SF.read_parts(spark, path)), str(tmp_path / "years"))
    assert spark.read.parquet(str(tmp_path / "years")).count() == 2


def test_missing_company_map_is_empty(spark, tmp_path):
    assert SF.corp_map(spark, str(tmp_path / "none")).count() == 0


def test_result_tables(spark, tmp_path):
    write_result({"trades": spark.range(3)}, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/trades")).count() == 3
    with pytest.raises(ValueError):
        write_result({"other": spark.range(1)}, str(tmp_path / "run"))
