"""Every registered query against its SQL counterpart, over whole tables."""

import pytest
from compare import compare, oracle_connection

from __spark_entry__ import entry, queries
from plumbline.plans.catalogue import QUERIES
from plumbline.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, con, name):
    same, message = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert same, message


def test_entry(spark, sf_dir):
    df = entry(spark)
    assert df.columns == ["conv_id", "objects", "relations", "object_hallucination_num", "relation_hallucination_num"]


def test_judge_plan(spark, sf_dir):
    plan = queries()["judge_scores"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Python" not in plan
