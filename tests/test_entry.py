import re

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    out = entry.entry(spark)
    assert out.columns and out.count() > 0


def test_queries_and_sql_share_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60
    assert all(re.fullmatch(r"\w+", n) for n in entry.queries())
