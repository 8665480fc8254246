"""Readers of landed files, and whole runs on a small corpus."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linegrain.operators import perturb as pt
from linegrain.operators import validate as va
from linegrain.plans import jobs
from linegrain.sources import files, pages, sinks
from tests.conftest import internal_rows

PAGE = """<h1>HT13</h1><h2>Original Tablet Text</h2>
<pre>
AB54-AB67 AB22 AB03 5

- +
QA+TU
</pre>
<p>See (raw: KU RA2 10) and (raw:  ).</p>"""
NOTE = """# HT13
(raw: DA NE 2)
## Original Tablet Text
KU RA2 7

TE
## Next
VIN 3
### ZA10
again (raw: AB22 AB04 1), (raw: QE)
### Other
(raw: PA3)
"""


@pytest.fixture(scope="module")
def landed(spark):
    rows = [
        ("file:/x/HT13.html", "HT13", PAGE),
        ("file:/x/index.html", "index", PAGE),
        ("file:/x/HT13.md", "HT13", NOTE),
        ("file:/x/report.md", "report", NOTE),
    ]
    return spark.createDataFrame(rows, "path string, name string, text string")


def test_documents_become_numbered_observations(landed):
    got = [
        (r["observation_id"], r["source_kind"], r["artifact_id"], r["line_id"], r["sign_sequence"], r["quantity"])
        for r in jobs.collect_observations(landed).orderBy("observation_id").collect()
    ]
    assert [r[1:] for r in got] == [
        ("html_original", "HT13", "1", "AB54-AB67 AB22 AB03", 5),
        ("html_original", "HT13", "4", "QA+TU", None),
        ("raw_annotation", "HT13", "8", "KU RA2", 10),
        ("md_original", "HT13", "1", "KU RA2", 7),
        ("md_original", "HT13", "2", "TE", None),
        ("raw_annotation", "HT13", "2", "DA NE", 2),
        ("raw_annotation", "ZA10", "10", "AB22 AB04", 1),
        ("raw_annotation", "ZA10", "10", "QE", None),
        ("raw_annotation", "ZA10", "12", "PA3", None),
        ("raw_annotation", "ZA10", "10", "AB22 AB04", 1),
        ("raw_annotation", "ZA10", "10", "QE", None),
        ("raw_annotation", "ZA10", "12", "PA3", None),
    ]
    assert [r[0] for r in got] == [f"OBS_{i:06d}" for i in range(1, 13)]


def test_table_rows_with_default_patterns(spark):
    html = (
        "<dl><dt><b>HT 1a</b><table><tr><td>line</td><td>statement</td><td>logogram</td></tr>"
        "<tr><td>.1</td><td>QA-QA-RU &bull; 5</td><td>GRA</td></tr>"
        "<tr><td></td><td>x</td></tr><tr><td>.2</td><td>vacat</td></tr></table>"
        "<dt><b>Intro</b><table><tr><td>.1</td><td>KU-RO</td></tr></table></dl>"
    )
    df = spark.createDataFrame([(1, html)], "id int, html string")
    got = [tuple(r)[4:] for r in pages.table_rows(df, "id", "html").collect()]
    assert ("HT 1A", ".1_log", "GRA") in got
    assert not [r for r in got if r[0] == "INTRO" or "VACAT" in r[2]]


def test_missing_files_and_columns(spark):
    assert files.read_variant_map(spark, "/nowhere/map.csv").count() == 0
    with pytest.raises(ValueError, match="line_id"):
        files.external_observations(spark.createDataFrame([("a",)], "artifact_id string"), "n")


def test_csv_is_split_unless_lines_may_be_quoted(spark, tmp_path):
    path = str(tmp_path / "rows.csv")
    with open(path, "w") as f:
        f.write("artifact_id,line_id,sign_sequence,notes\n")
        for i in range(20_000):
            f.write(f'HT {i},l{i},"KU, RO","said ""{i}"""\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        plain = files.read_csv(spark, path, files.EXTERNAL_COLUMNS)
        assert plain.rdd.getNumPartitions() > 4
        assert files.read_csv(spark, path, [], quoted_newlines=True).rdd.getNumPartitions() == 1
        rows = files.read_external_rows(spark, path)
        got = rows.orderBy("row_number").select("row_number", "artifact_id", "sign_sequence", "notes", "provenance").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in got] == [(i + 1, f"HT {i}", "KU, RO", f'said "{i}"', None) for i in range(20_000)]
    assert files.external_observations(rows, "row_number").count() == 20_000
    broken = tmp_path / "lines.csv"
    broken.write_text('artifact_id,line_id,sign_sequence\nHT 1,l1,"KU\nRO"\n')
    (row,) = files.read_external_rows(spark, str(broken), quoted_newlines=True).collect()
    assert row["sign_sequence"] == "KU\nRO"
    (tmp_path / "map.csv").write_text("variant,canonical\nra,ra2\n")
    (entry,) = files.read_variant_map(spark, str(tmp_path / "map.csv")).collect()
    assert (entry["variant"], entry["canonical"], entry["status"], entry["confidence"]) == ("RA", "RA2", "exact", 1.0)
    (tmp_path / "bad.csv").write_text("canonical\nx\n")
    with pytest.raises(ValueError, match="variant"):
        files.read_variant_map(spark, str(tmp_path / "bad.csv"))


def test_structural_run_and_deep_validation(spark, tmp_path):
    rows = [
        (f"OBS_{i:06d}", "f", "html_original" if i % 2 else "external_csv", a, str(i), i, " ".join(s), q, f"p{i}", "")
        for i, (_, a, s, q) in enumerate(internal_rows())
    ]
    obs = spark.createDataFrame(
        [*rows, ("OBS_000900", *rows[0][1:])],
        "observation_id string, source_id string, source_kind string, artifact_id string, "
        "line_id string, line_no int, sign_sequence string, quantity bigint, provenance string, "
        "notes string",
    )
    variants = files.variant_map(
        spark.createDataFrame([("RA", "RA2", "uncertain", "0.35", "")], files.VARIANT_COLUMNS)
    )
    summary = jobs.run_structural(spark, obs, variants, str(tmp_path), "2026-01-01_0000").first()
    assert (summary["observations_all_sources"], summary["canonical_entries"]) == (44, 43)
    assert summary["artifact_count"] == 9
    assert summary["limiting_factors"].startswith("corpus_size,artifact_diversity")
    assert 0 < summary["final_score"] <= 84.99
    links = sinks.read_table(spark, str(tmp_path), "provenance_links")
    assert links.count() == 44
    assert (tmp_path / "run_delta").exists() is False
    own = obs.where("source_kind = 'html_original'")
    jobs.run_structural(spark, own, variants, str(tmp_path), "2026-01-02_0000")
    delta = {r["metric"]: r for r in sinks.read_table(spark, str(tmp_path), "run_delta").collect()}
    assert delta["observations"]["before"] == 44 and delta["observations"]["after"] == own.count()
    assert delta["best_model"]["before_label"] in pt.cv.RANKED and delta["coverage"]["delta"] is not None
    assert delta["observations"]["baseline_run"] == "2026-01-01_0000"
    assert {"final_score", "structural_confidence", "artifact_count"} <= delta.keys()
    assert sinks.read_table(spark, str(tmp_path), "latest_run").first()["latest"] == "2026-01-02_0000"
    assert sinks.read_table(spark, str(tmp_path), "initial_share_gains", "2026-01-02_0000").columns[0] == "sign"
    suite = sinks.read_table(spark, str(tmp_path), "stress_suite").collect()
    relabel = next(r for r in suite if r["test_name"] == "randomized_sign_relabel_global")
    assert relabel["delta_log_likelihood"] == pytest.approx(0, abs=1e-9)
    deep = jobs.run_deep_validation(spark, str(tmp_path), "2026-01-01_0000")
    assert deep["metadata"].count() == 9
    assert deep["tiers"].count() == 6
    assert {r["anchor_id"]: r["observed_support_count"] for r in deep["anchors"].collect()}[
        "ab22_positional_pivot"
    ] == 15


def _imports(spark, rows):
    names = "row_number long, source_name string, artifact_id string, line_id string, sign_sequence string, provenance_url string, notes string"
    return spark.createDataFrame(rows, names)


def test_hot_line_keeps_every_source_through_two_merges(spark, tmp_path):
    names = "row_number long, source_id string, artifact_id string, line_id string, sign_sequence string, provenance string, notes string, ingestion_timestamp string, source_name string, provenance_url string"
    urls = [f"u{i:04d}" for i in range(1_500)]
    stored = spark.createDataFrame(
        [(i, f"s{i:04d}", "HT 1", "l0", "KU RO", u, f"n{i:04d}", "T0", f"N {i:04d}", u) for i, u in enumerate(urls)], names
    )
    known = va.inventory(stored.select(F.lit("KU")), stored.select(F.lit("RO")))
    raw = _imports(spark, [(1, "New", "HT 1", "l0", "KU RO", "v0", "")])
    once = jobs.run_ingest(spark, raw, stored, known, str(tmp_path), "r1")["merged"].drop("merged_rows")
    row = once.first()
    assert row["provenance"].split(" | ") == row["provenance_url"].split(" | ") == [*urls, "v0"]
    assert row["source_id"].split("|") == ["new", *(f"s{i:04d}" for i in range(1_500))]
    assert row["notes"].count("n") == 1_500
    again = _imports(spark, [(1, "Last", "HT 1", "l0", "KU RO", "w0", "")])
    twice = jobs.run_ingest(spark, again, once.withColumn("row_number", F.lit(1)), known, str(tmp_path), "r2")["merged"].first()
    assert twice["provenance"].split(" | ") == [*urls, "v0", "w0"]


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    names = "row_number long, source_id string, artifact_id string, line_id string, sign_sequence string, provenance string, notes string, ingestion_timestamp string, source_name string, provenance_url string"
    rows = [(i, "s", f"HT {i % 90}", f"l{i % 7}", "KU RO", f"u{i}", "", "T0", "S", f"u{i}") for i in range(400)]
    stored = va.normalize_stored(spark.createDataFrame(rows, names))
    path = str(tmp_path / "corpus")
    va.write_corpus(va.merge(stored, va.accepted_rows(va.mark_repeats(va.prepare(_imports(spark, [])))), "T0"), path, 32)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "corpus").rglob("*.parquet")}
    raw = _imports(spark, [(1, "New", "HT 3", "l3", "KU RO", "v0", "n"), (2, "New", "HT 999", "l0", "KU RO", "v1", "")])
    new = va.accepted_rows(va.mark_repeats(va.prepare(raw)))
    changed = va.upsert(spark, path, new, "T1", 32).collect()
    assert {(r["artifact_id"], r["line_id"]) for r in changed} == {("HT 3", "l3"), ("HT 999", "l0")}
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "corpus").rglob("*.parquet")}
    touched = {f.parent.name for f, _ in set(before.items()) ^ set(after.items())}
    assert 1 <= len(touched) <= 2
    columns = ["artifact_id", "line_id", "sign_sequence", *va.LISTS, "ingestion_timestamp"]
    got = {tuple(r) for r in spark.read.parquet(path).select(*columns).collect()}
    assert got == {tuple(r) for r in va.merge(stored, new, "T1").select(*columns).collect()}


def test_hot_line_keeps_every_tag_in_a_run(spark, tmp_path):
    tags = [f"p{i:04d}" for i in range(1_200)]
    rows = [
        ("f", "html_original", a, str(i), i, " ".join(s), q, f"q{i}", "") for i, (_, a, s, q) in enumerate(internal_rows())
    ]
    hot = rows[0][2:7]
    rows += [("f", "html_original", *hot, t, f"n{t}") for t in tags]
    obs = spark.createDataFrame(
        [(f"OBS_{i:06d}", *r) for i, r in enumerate(rows)],
        "observation_id string, source_id string, source_kind string, artifact_id string, "
        "line_id string, line_no int, sign_sequence string, quantity bigint, provenance string, notes string",
    )
    variants = files.variant_map(spark.createDataFrame([("RA", "RA2", "uncertain", "0.35", "")], files.VARIANT_COLUMNS))
    root, run = str(tmp_path), "2026-01-01_0000"
    jobs.run_structural(spark, obs, variants, root, run)
    for name in ("corpus_manifest", "canonical_corpus"):
        top = sinks.read_table(spark, root, name, run).orderBy(F.length("provenance_tags").desc()).first()
        assert top["provenance_tags"].split(",") == [*tags, "q0"]
        assert name == "canonical_corpus" or top["notes"].split(" | ") == [f"n{t}" for t in tags]
    found = jobs.run_deep_validation(spark, root, run)["metadata"]
    assert any(all(t in r["provenance_source_url"] for t in tags) for r in found.collect())


def test_ingest_merges_and_gate_closes(spark, tmp_path):
    good = [(i, "Src A", "HT 1", f"l{i}", "KU RO", f"u{i}", "") for i in range(30)]
    raw = _imports(spark, [*good, (30, "Src A", "HT 1", "l0", "KU RO", "u0", "again")])
    stored = spark.createDataFrame(
        [(1, "old", "HT 1", "l0", "ku ro", "", "kept", "T0", "", "")],
        "row_number long, source_id string, artifact_id string, line_id string, "
        "sign_sequence string, provenance string, notes string, ingestion_timestamp string, "
        "source_name string, provenance_url string",
    )
    known = va.inventory(raw.select(F.lit("KU")), raw.select(F.lit("RO")))
    done = jobs.run_ingest(spark, raw, stored, known, str(tmp_path / "a"), "r1")
    assert done["summary"].first()["warning_count"] == 1
    first = done["merged"].where("line_id = 'l0'").first()
    assert (first["source_id"], first["notes"]) == ("old|src_a", "kept")
    assert first["ingestion_timestamp"] != "T0"
    assert first["provenance"] == "external_import | u0"
    assert done["merged"].count() == 30
    bad = _imports(spark, [*good[:10], (11, "Src A", "HT 1", "x", "", "u", "")])
    with pytest.raises(ValueError, match="aborted"):
        jobs.run_ingest(spark, bad, stored, known, str(tmp_path / "b"), "r1")


def test_patterns_search_no_ranges():
    """Ranges in a class cost a test each for every character; named characters are one look-up."""
    from linegrain.functions import text as tx

    assert not any(r in p for p in (tx.TOKEN, tx.SHAPE) for r in ("A-Z", "0-9", r"\s"))
