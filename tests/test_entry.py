"""Driver contract: flagship runs on sf0.001; every oracle has a query."""

import __spark_entry__ as E

from conftest import SF


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["series_id", "feature", "value"]
    assert df.count() > 0


def test_oracles_have_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_registered_queries_run_small(spark):
    q = E.queries()
    for name in ("regions_series", "catalogue_pairs", "features_location", "model_gnb_predictions"):
        assert q[name](spark, SF).count() > 0
