"""Readers of landed files and tables: variant maps, text blocks, annotations, imported rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linegrain.functions import text as tx
from linegrain.scale import ordered_index

VARIANT_COLUMNS = ["variant", "canonical", "status", "confidence", "notes"]
EXTERNAL_COLUMNS = [
    "source_id", "artifact_id", "line_id", "sign_sequence", "provenance", "notes",
    "ingestion_timestamp", "source_name", "provenance_url",
]
OBSERVATION_COLUMNS = [
    "source_id", "source_kind", "artifact_id", "line_id", "line_no", "sign_sequence",
    "quantity", "provenance", "notes",
]

# The block that holds the transcription in a landed page.
BLOCK = r"(?is)<h2>\s*Original Tablet Text\s*</h2>\s*<pre>\s*(.*?)\s*</pre>"
SECTION = "## Original Tablet Text"
RAW_NOTE = r"\(raw:\s*([^)]+?)\)"
HEADING = r"^###\s+([A-Z0-9]+)\s*$"
ARTIFACT = r"(?i)^(HT[0-9]+|ZA[0-9]+)$"


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def read_csv(
    spark: SparkSession, path: str, columns: list[str], required: Sequence[str] = (), quoted_newlines: bool = False
) -> DataFrame:
    """A CSV with a header, all strings; a missing file is an empty table.

    Of ``columns``, those that the file lacks are NULL, unless they are
    ``required``. A file is read in as many tasks as it has splits. Only if
    values may hold line ends inside quotes must each file be one task: ask for
    that by ``quoted_newlines``.
    """
    reader = spark.read.option("escape", '"').option("multiLine", quoted_newlines)
    try:
        found = reader.csv(path, header=True)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    require_columns(found, list(required))
    return found.withColumns({c: F.lit(None).cast("string") for c in columns if c not in found.columns})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole landed files as (path, name, text); a file is one row."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("name"),
        F.col("value").alias("text"),
    )


def variant_map(rows: DataFrame) -> DataFrame:
    """Typed variant map out of string rows."""
    text = {c: F.trim(F.coalesce(c, F.lit(""))) for c in VARIANT_COLUMNS}
    variant = F.upper(text["variant"])
    confidence = F.coalesce(text["confidence"].try_cast("double"), F.lit(1.0))
    return rows.where(variant != "").select(
        variant.alias("variant"),
        F.coalesce(F.nullif(F.upper(text["canonical"]), F.lit("")), variant).alias("canonical"),
        F.coalesce(F.nullif(F.lower(text["status"]), F.lit("")), F.lit("exact")).alias("status"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
        text["notes"].alias("notes"),
    )


def read_variant_map(spark: SparkSession, path: str) -> DataFrame:
    return variant_map(read_csv(spark, path, VARIANT_COLUMNS, ["variant"]))


def _with_sequence(df: DataFrame, line: Column) -> DataFrame:
    surface = tx.surface_part(line)
    return (
        df.withColumn("sign_sequence", F.upper(surface))
        .withColumn("quantity", tx.quantity_part(line))
        .where(F.size(tx.tokens(F.col("sign_sequence"))) > 0)
    )


def titled_block_lines(
    docs: DataFrame, key: str, text: str, block: str = BLOCK, line_break: str = "\n"
) -> DataFrame:
    """Lines of the first titled block of each page; numbered inside the block."""
    body = F.regexp_extract(text, block, 1)
    lines = docs.select(key, F.posexplode(F.split(body, line_break)).alias("pos", "line"))
    numbered = lines.select(key, (F.col("pos") + 1).alias("line_no"), tx.collapse(F.col("line")).alias("line"))
    return _with_sequence(numbered, F.col("line")).select(
        key, "line_no", "sign_sequence", "quantity"
    )


def section_lines(docs: DataFrame, key: str, text: str, title: str = SECTION) -> DataFrame:
    """Lines of a titled Markdown section, up to the next heading of its level.

    ``line_no`` is the line in the file, ``line_id`` counts the lines kept.
    """
    lines = F.transform(F.split(text, "\n"), F.trim)
    start = F.array_position(F.transform(lines, lambda s: s.startswith(title)), True)
    rest = F.slice(lines, start.cast("int") + 1, F.greatest(F.size(lines), F.lit(1)))
    ends = F.array_position(
        F.transform(rest, lambda s: s.startswith("## ") & ~s.startswith(title)), True
    )
    body = F.when(ends > 0, F.slice(rest, 1, (ends - 1).cast("int"))).otherwise(rest)
    found = docs.where(start > 0).select(
        key, start.alias("start"), F.posexplode(body).alias("pos", "line")
    )
    kept = _with_sequence(
        found.where(~F.col("line").startswith(title))
        .select(key, (F.col("start") + F.col("pos") + 1).cast("int").alias("line_no"), "line"),
        F.col("line"),
    )
    # A window over one file: a file is one row, so its lines fit in a task.
    order = W.partitionBy(key).orderBy("line_no")
    return kept.select(
        key,
        F.row_number().over(order).cast("string").alias("line_id"),
        "line_no",
        "sign_sequence",
        "quantity",
    )


def inline_annotations(
    docs: DataFrame,
    key: str,
    text: str,
    default: Column | None = None,
    note: str = RAW_NOTE,
    heading: str = HEADING,
    artifact: str = ARTIFACT,
) -> DataFrame:
    """Annotations of every line, given to the latest heading above them, else to ``default``."""
    owner = (default if default is not None else F.lit(None).cast("string")).alias("owner")
    lines = docs.select(key, owner, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    title = F.upper(F.regexp_extract(F.trim("line"), heading, 1))
    named = lines.withColumn("title", F.when(title.rlike(artifact), title))
    above = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    owned = named.withColumn(
        "artifact_id", F.coalesce(F.last("title", ignorenulls=True).over(above), F.col("owner"))
    )
    notes = owned.where(F.col("artifact_id").isNotNull()).select(
        key,
        "artifact_id",
        (F.col("pos") + 1).alias("line_no"),
        F.posexplode(F.regexp_extract_all("line", F.lit(note), 1)).alias("note_no", "note"),
    )
    return _with_sequence(notes, F.col("note")).select(
        key, "artifact_id", "line_no", "note_no", "sign_sequence", "quantity"
    )


def file_observations(docs: DataFrame, text: str = "text") -> DataFrame:
    """All observations of landed files ``(path, name, text)``, ordered by ``file_order``.

    Pages come before Markdown files, each by name; an index page is skipped.
    """
    stem = F.upper("name")
    files = docs.where(F.lower("name") != "index").select(
        "path",
        text,
        F.when(stem.rlike(ARTIFACT), stem).alias("artifact_id"),
        F.lower("path").endswith(".html").alias("is_html"),
    )
    known = files.where(F.col("artifact_id").isNotNull())
    owner = known.select("path", "artifact_id")

    def shaped(df: DataFrame, kind: str, place: str, rank: int) -> DataFrame:
        return df.select(
            F.col("path").alias("source_id"),
            F.lit(kind).alias("source_kind"),
            "artifact_id",
            F.col("line_id").cast("string").alias("line_id"),
            "line_no",
            "sign_sequence",
            "quantity",
            F.concat("path", F.lit(f":{place}")).alias("provenance"),
            F.lit("").alias("notes"),
            F.lit(rank).alias("kind_rank"),
            F.col("note_no").cast("int").alias("note_no"),
        )

    none = F.lit(0)
    html = titled_block_lines(known.where("is_html"), "path", text).join(owner, "path")
    html = html.withColumns({"line_id": F.col("line_no"), "note_no": none})
    md = section_lines(known.where("NOT is_html"), "path", text).join(owner, "path")
    md = md.withColumn("note_no", none)
    raw = inline_annotations(files, "path", text, F.col("artifact_id"))
    raw = raw.withColumn("line_id", F.col("line_no"))
    return (
        shaped(html, "html_original", "original_pre", 0)
        .unionByName(shaped(md, "md_original", "original_md_section", 0))
        .unionByName(shaped(raw, "raw_annotation", "raw_annotation", 1))
        .withColumn("is_md", ~F.lower("source_id").endswith(".html"))
    )


FILE_ORDER = ["is_md", "source_id", "kind_rank", "line_no", "note_no"]


def number_observations(df: DataFrame, order: list[str], start: int = 1) -> DataFrame:
    """``OBS_000001`` … in the given total order."""
    numbered = ordered_index(df, order, "_n")
    label = F.format_string("OBS_%06d", F.col("_n") + (start - 1))
    return numbered.withColumn("observation_id", label).drop("_n")


def read_external_rows(spark: SparkSession, path: str, quoted_newlines: bool = False) -> DataFrame:
    """Imported rows of a CSV with ``row_number``, their place in it from 1 on; optional columns may be missing."""
    need = ["artifact_id", "line_id", "sign_sequence"]
    rows = read_csv(spark, path, EXTERNAL_COLUMNS, need, quoted_newlines)
    return ordered_index(rows.withColumn("_at", F.monotonically_increasing_id()), ["_at"], "row_number").drop("_at")


def external_observations(rows: DataFrame, row_no: str) -> DataFrame:
    """Imported rows as observations; ``row_no`` is the row's place in its file."""
    require_columns(rows, ["artifact_id", "line_id", "sign_sequence"])
    have = {
        c: F.trim(F.coalesce(c, F.lit(""))) if c in rows.columns else F.lit("")
        for c in EXTERNAL_COLUMNS
    }

    def or_else(*choices: Column) -> Column:
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])

    def append(base: Column, extra: Column, present: Column) -> Column:
        joined = F.when(base == "", extra).otherwise(F.concat(base, F.lit(" | "), extra))
        return F.when((present == "") | F.contains(base, extra), base).otherwise(joined)

    url, name, stamp = have["provenance_url"], have["source_name"], have["ingestion_timestamp"]
    origin = or_else(have["provenance"], url, F.lit("external_csv"))
    notes = append(have["notes"], F.concat(F.lit("source="), name), name)
    notes = append(notes, F.concat(F.lit("ingested="), stamp), stamp)
    source = or_else(have["source_id"], name, F.lit("external"))
    shaped = rows.select(
        F.concat(F.lit("external:"), source).alias("source_id"),
        F.lit("external_csv").alias("source_kind"),
        or_else(F.upper(have["artifact_id"]), F.lit("EXT")).alias("artifact_id"),
        or_else(have["line_id"], F.col(row_no).cast("string")).alias("line_id"),
        F.col(row_no).cast("int").alias("line_no"),
        have["sign_sequence"].alias("_text"),
        append(origin, url, url).alias("provenance"),
        notes.alias("notes"),
    )
    return _with_sequence(shaped, F.col("_text")).select(*OBSERVATION_COLUMNS)
