"""Contexts of many questions: what several steps read is put together once."""

import pytest

from graphloom.plans import catalog, question_queries


@pytest.mark.parametrize("mode", ["hybrid", "mix"])
def test_lines_are_read_once_after_what_is_written(spark, mode):
    plan = question_queries._contexts(spark, "/root/testdata/sf0.001", mode)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "l_orderkey" in line for line in plan.split("\n")) == 1
    assert f"{mode}_contexts" in catalog.QUERIES
