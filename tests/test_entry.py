"""The driver contract: names, SQL for known queries, and a smoke run of the flagship."""

import __spark_entry__ as entry


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert "runs_to_review" in queries and set(oracles) <= set(queries)
    assert all(callable(f) for f in queries.values())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["run_id", "results", "errors", "warnings", "passed", "top_severity", "top_finding"]
    assert df.count() > 0
