"""Every core query runs on the smallest tables; those with an oracle agree with it."""

import pytest
from oracle import compare, connect

from warraq.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, sf, con):
    compare(QUERIES[name](spark, sf), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns
    assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_does_not_import_llm():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; import warraq.plans.catalog, warraq.streaming.incremental, warraq.sources.records; assert not [m for m in sys.modules if m.startswith('warraq.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
