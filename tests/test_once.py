"""Costly columns are made once: no filter of the plan makes them again."""

from __future__ import annotations

from linegrain.plans import QUERIES_AND_ORACLES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_table_cells_are_made_once(spark):
    df = QUERIES_AND_ORACLES()[0]["src_html_table_rows"](spark, SF)
    assert plan(df).count("[•·|/…]") == 1  # the sequence of a cell
