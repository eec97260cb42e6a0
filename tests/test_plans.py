"""Physical plans: only the columns that are needed are read, joins are by keys."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plan(spark, name):
    return entry.queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned_and_filters_pushed(spark):
    p = plan(spark, "p1_found")
    schemas = {x.split(">")[0] for x in p.split("ReadSchema: struct<")[1:]}
    assert schemas <= {"seq:bigint,message_id:string", "seq:bigint,message_id:strin..."} and "IsNotNull(message_id)" in p
    p = plan(spark, "metadata_filter")
    assert "EqualTo(is_initial,true)" in p.replace("EqualNullSafe", "EqualTo")


@pytest.mark.parametrize("name", ["p1_found", "length_outliers", "rare_token_filter", "discretised_lines", "irun_thinning", "windowdiff", "pk", "combine_results", "annotation_lookup", "message_keys", "run_statistics", "ngram_hits"])
def test_joins_are_by_keys(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "NestedLoop" not in p
