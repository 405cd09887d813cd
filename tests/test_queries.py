"""Every query against its SQL on the smallest tables."""

import pytest
from compare import compare

from tidewater.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLE_SQL[name]) is None


def test_flagship(spark):
    assert QUERIES["flagship"](spark, SF).count() >= 1
    row = QUERIES["tile_assessment"](spark, SF).first()
    assert 0 <= row.overall_score <= 90
