"""Every registered query against its DuckDB counterpart, and the driver contract."""

import re

import pytest
from oracle import compare

from tidemark.queries import all_oracles, all_queries

# Full-size boosted models take long; tests/test_models.py covers the same code with fewer trees.
SLOW = {"f13_fit_boosted", "f16_run_experiment"}

OPERATORS = (
    [f"sc{i}" for i in (*range(1, 11), 12, 13, 14)] + [f"p{i}" for i in range(1, 18)] + [f"j{i}" for i in range(1, 11)]
    + [f"a{i}" for i in range(1, 15)] + [f"w{i}" for i in range(1, 7)] + [f"l{i}" for i in range(1, 8)]
    + [f"u{i}" for i in range(1, 6)] + [f"s{i}" for i in (*range(1, 19), 20)] + [f"st{i}" for i in range(1, 4)]
    + [f"r{i}" for i in range(1, 10)] + [f"f{i}" for i in range(1, 19)] + ["f4s"]
)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - SLOW))
def test_query(spark, duck, sf_dir, name):
    result = compare(spark, duck, all_queries()[name], all_oracles().get(name), sf_dir)
    assert result.startswith(("ok", "rows only")), result


def test_every_operator_has_a_query():
    prefixes = {name.split("_")[0] for name in all_queries()}
    assert len(OPERATORS) == 122
    assert set(OPERATORS) <= prefixes


def test_oracles_belong_to_queries():
    assert set(all_oracles()) <= set(all_queries())
    assert set(all_queries()) == set(all_oracles())


def test_entry(spark):
    import __spark_entry__ as entry

    hits = entry.entry(spark)
    assert hits.columns[:3] == ["query_id", "rank", "id"]
    assert hits.count() > 0
    assert not any(re.search("local", c) for c in hits.columns)


def test_features_are_computed_once_to_fit_and_to_score(spark, sf_dir):
    from tidemark.queries import evaluation

    files = evaluation.scored(spark, sf_dir, "lr").inputFiles()
    assert files and not any("documents" in f for f in files)
