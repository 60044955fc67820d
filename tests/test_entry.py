"""Every registered query beside its SQL, at the smallest size."""

import pytest

import __spark_entry__ as entry
import verify

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"])
def test_query_matches_its_sql(spark, name):
    said = verify.compare(spark, SF, name)
    assert said.startswith(("ok", "rows")), said


def test_flagship(spark):
    assert entry.entry(spark).count() == 8
