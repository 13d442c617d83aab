from __future__ import annotations

import datetime as dt

from barloom.streaming.bars import append_bars, read_bar_stream


def test_new_files_are_cleaned_once(spark, tmp_path):
    schema = "Date date, Code string, Open double, High double, Low double, Close double"

    def drop(day, code):
        spark.createDataFrame([(dt.date(2024, 1, day), code, 1., 2., 1., 2.)], schema).write.mode(
            "append").parquet(str(tmp_path / "in"))

    def pull():
        stream = read_bar_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        append_bars(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        return sorted(r.code for r in spark.read.parquet(str(tmp_path / "out")).collect())

    drop(2, "5930")
    assert pull() == ["005930"]
    drop(3, "660")
    assert pull() == ["000660", "005930"]
