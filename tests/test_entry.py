from __future__ import annotations

import __spark_entry__ as entry


def test_registry_is_complete():
    q, sql = entry.queries(), entry.oracle_sql()
    assert len(q) > 90 and set(sql) <= set(q)
    assert set(entry.REGISTERED) - set(sql) <= {"f0_all_indicators"}


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["code", "spikes", "top_volume", "last_spike"] and df.count() > 0
