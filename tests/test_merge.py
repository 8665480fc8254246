"""What a merge keeps and moves: short keys, slim rows, each text once."""

from __future__ import annotations

from pyspark.sql import functions as F

from linegrain.operators import validate as va
from linegrain.plans import validate_queries as vq

ROW = "row_number long, source_name string, source_id string, artifact_id string, line_id string, sign_sequence string, provenance string, notes string, ingestion_timestamp string, provenance_url string"


def test_texts_of_stored_keys_move_once(spark):
    """New rows with a stored key bring their lists and not their text; others bring both."""
    old = [(i, f"S{i % 3}", f"s{i % 3}", "A", "l", f"T{i % 4}", f"p{i}", "", "old", f"u{i}") for i in range(12)]
    new = [(i, "S9", "s9", "A", "l", f"T{i}", "", f"n{i}", "", f"v{i}") for i in (2, 3, 4, 4)]
    found = va.merge_lists(spark.createDataFrame(old, ROW), spark.createDataFrame(new, ROW), "now")
    rows = {(r["sign_sequence"], r["field"]): (r["items"], r["item_count"], r["artifact_id"], r["line_id"]) for r in found.collect()}
    assert len(rows) == found.count() == 4 * 4 + 2 + 5
    assert rows["T2", "provenance"] == ("p10 | p2 | p6 | u10 | u2 | u6 | v2", 7, "A", "l")
    assert rows["T4", "source_id"] == ("s9", 1, "A", "l") and rows["T4", "notes"] == ("n4", 1, "A", "l")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan
    assert len([x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x and "field#" in x]) <= 1
    assert len(spark.range(1).select(va.key_hash(F.lit("a"), F.lit("b")).alias("k")).first()["k"]) == 16


def test_repeats_meet_by_a_short_key(spark):
    """The sequences of accepted rows are grouped by 128 bits, and the first row of each key stays."""
    rows = [(i, f"T{i % 3} " * 50, "s", "a", "l", None) for i in range(9)] + [(9, "x", "s", "a", "l", "bad")]
    prepared = spark.createDataFrame(rows, "row_number long, sanitized string, k_source string, k_artifact string, k_line string, hard string")
    marked = va.mark_repeats(prepared)
    assert {r["row_number"] for r in marked.where("not is_repeat").collect()} == {0, 1, 2}
    assert marked.count() == 9
    grouped = [x for x in marked._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
    assert grouped and all("sanitized" not in x for x in grouped), grouped


def test_merge_inputs_are_kept_without_their_tokens(spark, monkeypatch):
    kept, keep = [], vq.stored

    def seen(df):
        kept.append(df.columns)
        return keep(df)

    monkeypatch.setattr(vq, "stored", seen)
    vq.merge_inputs(spark, "/root/testdata/sf0.001")
    assert len(kept) == 3 and not {"toks", "valid", "bad", "seq"} & {c for names in kept for c in names}
