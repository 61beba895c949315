"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as contract
from checks import queries as own
from checks.compare import compare, connect


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(own.queries()) - set(contract.oracle_sql()) == {"tag_names", "mask_names"}


def test_entry(spark, sf):
    result = contract.entry(spark)
    assert result.columns == ["source", "documents", "spans", "masked_documents"]
    assert result.count() > 0


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, sf, name):
    verdict, _ = compare(spark, connect(sf), name, sf)
    assert verdict.startswith(("ok", "rows only")), verdict
