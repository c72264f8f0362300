import pytest

from matchloom import queries as core
from tests.compare import same


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_sql(spark, duck, sf_dir, name):
    same(core.QUERIES[name](spark, sf_dir), duck, core.SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, sf_dir, name):
    assert core.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(core.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() >= 0
