"""The driver contract, and a sample of the registered queries against their SQL twins.

``python -m checks.compare`` runs all of them.
"""

import __spark_entry__ as entry
import pytest

from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "resample_bars", "indicators_all", "signal_ha_streak", "signal_cooldown", "backtest_summary", "rules_validate",
    "walk_forward_folds", "external_align_ffill", "trailing_trade_flow", "bars_upsert", "lineage_chain", "stream_rollup",
]


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.queries()) - set(entry.oracle_sql()) <= {k for k in entry.queries() if k.startswith("op") and k[2:3].isdigit()} | {"pipeline"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) > 0
    assert difference(got, connect(SF).sql(entry.oracle_sql()[name]).df()) is None
