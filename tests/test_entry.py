"""The driver's contract."""

import importlib.util

import __spark_entry__ as contract
from loomspace.queries import registry


def test_every_query_is_callable_and_named_once():
    names = contract.queries()
    assert set(registry.QUERIES) <= set(names)
    assert set(contract.oracle_sql()) <= set(names)


def test_core_stands_without_optional_subpackages():
    text = [importlib.util.find_spec(m).origin for m in ("loomspace.queries.registry", "loomspace.queries.problems", "loomspace.operators.proximity")]
    assert not any("loomspace.llm" in open(f).read() for f in text)


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["bid", "n"] and df.count() > 0
