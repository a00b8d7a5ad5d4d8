import pytest

from cloakspark.llm.oracle import ORACLE
from cloakspark.llm.queries import QUERIES

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from test_queries import DATA, compare, needs_data


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
