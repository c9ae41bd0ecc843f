"""Every registered query against its SQL on DuckDB, and checks of the physical plans."""

import os
import re

import pytest

from __spark_entry__ import entry
from tabloom.catalog import CHECKS, QUERIES
from tools.check import compare, duck

TINY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TINY), reason="the given tables are absent")


@pytest.fixture(scope="module")
def con():
    return duck(TINY)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, note, _ = compare(spark, con, name, QUERIES[name], CHECKS[name], TINY)
    assert ok, note
    assert "TYPES" not in note and "INEXACT" not in note, note


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|single|round)", plan(df), re.I))


@pytest.mark.parametrize("name", ["prepare_sample", "encode_sample", "quantile_bin", "standardise"])
def test_sample_work_needs_one_exchange_and_one_scan(spark, name):
    df = QUERIES[name](spark, TINY)
    assert exchanges(df) == 1
    assert plan(df).count("FileScan parquet") == 1


@pytest.mark.parametrize("name", ["date_parts", "time_seconds", "bag_query_plan"])
def test_narrow_work_stays_narrow(spark, name):
    assert exchanges(QUERIES[name](spark, TINY)) <= (1 if name == "bag_query_plan" else 0)


def test_scans_read_only_the_columns_they_need(spark):
    df = QUERIES["context_query_split"](spark, TINY)
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan(df)


PYTHON = {
    "query_context_pairs", "class_max_similarity", "similarity_classify", "score_hook",
    "metric_pair_loss", "metric_pair_jaccard", "predict_proba_bagged", "predict_class_bagged",
    "predict_value_bagged",
}


@pytest.mark.parametrize("name", ["encode_sample", "sliding_bags", "cap_context", "text_dictionary", "hash_embed", "combine_bags_cls", "symmetrise", "label_encode", "column_profile", "spec_replay"])
def test_no_python_and_no_cross_join_in_sql_operators(spark, name):
    assert name not in PYTHON
    text = plan(QUERIES[name](spark, TINY))
    assert not re.search(r"InPandas|InArrow|PythonUDF|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["event_id", "is_query", "floor", "delta", "bin"] and df.count() == 1000
