"""Every training-data query beside its SQL, at the smallest size."""

import pytest

import verify
from quillcheck.llm import entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in entry.queries() if n != "pipeline"])
def test_query_matches_its_sql(spark, name):
    said = verify.compare(spark, SF, name)
    assert said.startswith(("ok", "rows")), said


def test_names_and_oracles():
    assert set(entry.oracle_sql()) < set(entry.queries())
