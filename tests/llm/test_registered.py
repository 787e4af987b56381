"""The registered queries run over whole tables."""

import __spark_entry__ as entry
import pytest
from compare import connect, differences
from orderloom.llm import registry

DIRECTORY = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = set(entry.queries())
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.QUERIES) <= names and set(registry.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, connect(DIRECTORY), DIRECTORY, name, registry.QUERIES[name], registry.ORACLES[name]) == []


@pytest.mark.parametrize("name", ["op1_warc_round_trip", "op5_bpe_round_trip", "op6_token_counts", "op7_quality_scores", "op9_personal_data", "op12_toxicity_scores"])
def test_query_has_a_row_for_each_row(spark, name):
    table = "pages" if name.startswith("op1_") else "documents"
    assert registry.QUERIES[name](spark, DIRECTORY).count() == spark.read.parquet(f"{DIRECTORY}/{table}.parquet").count()
