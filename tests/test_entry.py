"""The driver's contract."""

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "scanned", "in_band", "kept"] and df.count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
