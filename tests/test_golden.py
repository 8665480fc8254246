"""Published values of the 43-line corpus."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linegrain.operators import components as cc
from linegrain.operators import cv
from linegrain.operators import profiles as pf
from linegrain.operators import similarity as sm
from linegrain.operators import stats as st
from linegrain.operators import templates as tp


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_frequencies(internal):
    uni = as_dict(pf.ngram_frequency(internal, 1, "sign").select("sign", "count"))
    assert (sum(uni.values()), len(uni)) == (123, 39)
    assert (uni["AB22"], uni["AB67"], uni["KU"], uni["TE"]) == (15, 9, 7, 7)
    bi = as_dict(pf.ngram_frequency(internal, 2, "g").select("g", "count"))
    assert (sum(bi.values()), len(bi)) == (80, 47)
    tri = as_dict(pf.ngram_frequency(internal, 3, "g").select("g", "count"))
    assert sum(tri.values()) == 39
    first = as_dict(pf.edge_frequency(internal).select("sign", "count"))
    assert (first["KU"], first["VIN"], first["AB81"], first["AB54"]) == (7, 6, 5, 4)
    last = as_dict(pf.edge_frequency(internal, terminal=True).select("sign", "count"))
    assert (last["TE"], last["AB67"]) == (7, 5)
    assert pf.edge_patterns(internal).count() == 17
    assert pf.edge_patterns(internal, suffix=True).count() == 20
    lengths = as_dict(internal.groupBy(F.size("signs")).count())
    assert lengths == {1: 2, 2: 17, 3: 9, 4: 15}


def test_types_edges_clusters_templates(internal):
    types = tp.sequence_types(internal)
    pairs = sm.similar_pairs(types).cache()
    found = cc.clusters(types, pairs)
    sizes = as_dict(found.select("cluster_id", "cluster_size").distinct())
    assert (types.count(), pairs.count(), len(sizes), max(sizes.values())) == (32, 13, 25, 5)
    rows = tp.templates(internal)
    assert [tuple(r)[:3] for r in rows.collect()] == [(4, "* * AB22 *", 1)]
    assert tp.weighted_coverage(internal, rows).first()[0] == 1.0


def test_hypotheses_and_metrics(internal):
    row = st.position_test(internal, "AB22", 4, 3).first()
    assert (row["observed_total"], row["observed_count"]) == (15, 15)
    assert row["expected_mean_under_null"] == 3.75
    assert row["p_value_ge_observed"] == pytest.approx(1 / 5001)
    support = st.pivot_support(st.position_test(internal, "AB22", 4, 3)).first()["support"]
    assert support == 84.0
    stem = st.stem_endings(internal).where("stem = 'KU RA2'").first()
    assert tuple(stem)[1:] == (5, 5, 6, 2)
    endings = st.stem_ending_lists(internal).where("stem = 'KU RA2'").first()["items"]
    assert endings == "<ZERO>,NE,SI,TA,TE"
    metrics = st.structural_metrics(internal).first()
    wanted = (0.7887567851, 0.1627906977, 0.4390243902, 0.0674467269)
    assert tuple(metrics) == pytest.approx(wanted, abs=1e-9)


def test_leave_one_artifact_out(internal):
    models = ("unigram", "first_bigram", "bigram", "trigram", "position")
    rows = cv.leave_one_group_out(internal, models=models).collect()
    got = {r["model"]: r["mean_log_likelihood_per_token"] for r in rows}
    assert got == pytest.approx(
        {
            "unigram": -4.6034837801,
            "first_bigram": -4.9982104784,
            "bigram": -3.7019144069,
            "trigram": -3.7325162967,
            "position": -3.4760258627,
        },
        abs=1e-9,
    )


def test_result_does_not_depend_on_partitions(spark, internal):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        types = tp.sequence_types(internal.repartition(int(n)))
        seen.add(tuple(sorted((r["seq_no"], tuple(r["signs"])) for r in types.collect())))
        dealt = cv.fold_of(internal.repartition(int(n)), 5).select("line_id", "fold").collect()
        seen.add(tuple(sorted(map(tuple, dealt))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 2
