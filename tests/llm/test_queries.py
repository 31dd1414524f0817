"""Every registered query over the small tables: against its SQL, or brute force below."""

import pytest

from oracle import differences
from vecspan.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    assert differences(spark, SF, registry.queries()[name], registry.oracle_sql()[name])[:2] == []


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in registry.queries()
