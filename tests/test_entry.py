import os

import pytest

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the generated tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10 and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
