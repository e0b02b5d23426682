import subprocess
import sys
from pathlib import Path

import pytest
from oracle import same

from streamwatch.plans import extra_queries, forecast_queries, frame_queries, library_queries, more_queries, run_queries, series_queries, serving_queries  # noqa: F401
from streamwatch.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), sf, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_optional_subpackage_is_not_needed():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['streamwatch.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 80 and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True).returncode == 0
