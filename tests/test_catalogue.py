"""Every registered query of the engine against its SQL, or its rows where it has none."""

import pytest

from oracle import differences
from vecspan.plans import graphs, storage, transforms  # noqa: F401
from vecspan.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert differences(spark, SF, QUERIES[name], ORACLES[name])[:3] == []
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
