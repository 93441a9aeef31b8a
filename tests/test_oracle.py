"""Every registered query against its checking SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_file
from cairnlens.plans import catalogue
from compare import differences

CHECKED = [name for name, q in catalogue.QUERIES.items() if q.check]
UNCHECKED = [name for name, q in catalogue.QUERIES.items() if not q.check]


@pytest.mark.parametrize("name", CHECKED)
def test_matches_check(spark, con, folder, name):
    df = catalogue.run(name, spark, folder)
    assert differences(df, con, catalogue.QUERIES[name].check) == ""


@pytest.mark.parametrize("name", UNCHECKED)
def test_runs(spark, folder, name):
    assert catalogue.run(name, spark, folder).count() > 0


def test_entry(spark):
    df = entry_file.entry(spark)
    assert df.columns == ["task_id", "risk_rank", "risk_level"]
    assert df.count() > 0
    assert set(entry_file.oracle_sql()) <= set(entry_file.queries())
