"""Every query that has a SQL form, against DuckDB over the smallest tables; a few of the others run."""

import pytest
from conftest import DATA

from tesela.plans import reports


@pytest.mark.parametrize("name", sorted(reports.ORACLES))
def test_query_equals_sql(name, spark, duck, same):
    same(reports.QUERIES[name](spark, f"{DATA}/sf0.001"), duck(reports.ORACLES[name]))


@pytest.mark.parametrize("name", ["answers", "summaries", "stem_reduction", "noise_markers", "normalized_vocabulary", "text_clusters", "bootstrap_interval"])
def test_query_runs(name, spark):
    df = reports.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
