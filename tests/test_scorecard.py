"""Both arms of the stress guard, and which support the gate compares."""

from __future__ import annotations

import pytest

from linegrain.operators import scorecard as sc

NAMES = (
    "lines long, artifacts long, sources long, winner_ll double, unigram_ll double, position_alignment double, identity_ll double, "
    "permissive_ll double, benign double, destructive double, guard_delta double, flag_count long, event_count long, coverage double, "
    "structural_confidence double, semantic_confidence double"
)


def corpus(guard_delta, structural, semantic, lines=5_000, destructive=2.0):
    return (lines, 500, 5_000, -1.0, -3.0, 100.0, -1.0, -1.0, 0.0, destructive, guard_delta, 0, 100, 1.0, structural, semantic)


@pytest.mark.parametrize(
    ("row", "triggered", "collapsed"),
    [
        (corpus(-0.5, 80.0, 29.0), True, True),  # a high score that does not stand the stress
        (corpus(-0.4, 80.0, 29.0), True, False),
        (corpus(-0.5, 20.0, 29.0, lines=10), True, True),  # a low score whose semantic support is the stronger
        (corpus(-0.5, 30.0, 29.0, lines=10), False, False),
        (corpus(None, 20.0, 29.0, lines=10), True, False),
    ],
)
def test_guard(spark, row, triggered, collapsed):
    scored = sc.scored(spark.createDataFrame([row], NAMES))
    found = sc.gate(scored).first()
    assert (found["guard_triggered"], found["guard_collapse"]) == (triggered, collapsed)
    assert found["semantic_stronger"] == (row[-1] > row[-2])
    assert ("stress_guard_collapse" in found["limiting_factors"]) == collapsed
    assert (found["final_score"] <= sc.CAP) == (collapsed or found["raw_score"] <= sc.CAP or not found["strict_gate"])


def test_hypotheses(spark):
    pivots = spark.createDataFrame([("a", 40.0), ("b", 61.5)], "pivot string, support double")
    stems = pivots.limit(0)
    got = {r["hypothesis_id"]: (r["analysis_type"], r["confidence_percent"]) for r in sc.hypotheses(pivots, stems).collect()}
    assert got == {
        "H-S1": ("structural mapping", 61.5), "H-S2": ("structural mapping", 0.0), "H-P1": ("phonetic mapping", 18.0),
        "H-M1": ("semantic mapping", 29.0),
    }
