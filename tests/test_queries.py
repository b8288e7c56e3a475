"""Every query of the engine itself against its oracle, or for rows only where it has none."""

from datetime import datetime as D

import pytest

from tests import oracle
from tidegauge.plans import registry


@pytest.fixture(scope="module")
def duck(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    assert len({c.lower() for c in df.columns}) == len(df.columns)  # else it couldn't be written
    got = df.toPandas()
    if name in registry.ORACLE_SQL:
        oracle.assert_same(got, duck.execute(registry.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_candle_times_of_all_events(spark, tmp_path):
    """Values that occur more than once count, and the least time of the highest value is taken."""
    at = [D(2024, 1, 1, h) for h in (9, 10, 11, 12)]
    spark.createDataFrame(list(zip(at, [1.0, 3.0, 3.0, 1.0], ["a"] * 4, strict=True)), "ts timestamp_ntz, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["AG22_candle_times"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(D(2024, 1, 1), "a", at[0], at[3], at[1])]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
