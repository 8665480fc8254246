"""Sequences out of landed HTML: table rows under headings, link targets, document links.

Patterns are parameters; the defaults fit catalogue pages with definition
lists and tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linegrain.functions import text as tx

SECTION_HEADING = r"(?is)<dt><b>(.*?)</b>"
TABLE = r"(?is)<table[^>]*>(.*?)</table>"
ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<td[^>]*>(.*?)</td>"
LINK_SEQUENCE = r"seq-pattern:([^/\"<]+)//"
TITLE = r"(?i)<div class=\"title\">([^<]+)</div>"
DOCUMENT_LINK = r"href=\"(document/[^\"]+/)\""

# Words that mark the header row of a table.
HEADER_MARKS = ["LINE", "STATEMENT", "LOGOGRAM"]
HEADER_LABELS = [*HEADER_MARKS, "NUMBER", "FRACTION", "SIDE", "SIDE.LINE"]


def _made(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns made once: behind a one-row generator no filter or other column makes them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def table_rows(
    pages: DataFrame,
    key: str,
    html: str,
    heading: str = SECTION_HEADING,
    table: str = TABLE,
    row: str = ROW,
    cell: str = CELL,
) -> DataFrame:
    """Statement (second cell) and logogram (third cell) of each table row under a heading."""
    titles = F.regexp_extract_all(html, F.lit(heading), 1)
    bodies = F.slice(F.split(html, heading), 2, F.size(titles) + 1)
    sections = pages.select(
        key, F.posexplode(F.arrays_zip(titles.alias("title"), bodies.alias("body"))).alias("s", "x")
    )
    named = _made(sections, artifact_id=tx.artifact_key(F.col("x.title"))).withColumn("body", F.col("x.body"))
    tables = named.where(F.col("artifact_id").rlike("[0-9]")).select(
        key,
        "s",
        "artifact_id",
        F.posexplode(F.regexp_extract_all("body", F.lit(table), 1)).alias("t", "inner"),
    )
    rows = tables.select(
        key,
        "s",
        "artifact_id",
        (F.col("t") + 1).alias("t"),
        F.posexplode(F.regexp_extract_all("inner", F.lit(row), 1)).alias("r", "tr"),
    ).select(
        key,
        "s",
        "artifact_id",
        "t",
        (F.col("r") + 1).alias("r"),
        "tr",
    )
    rows = _made(rows, cells=F.regexp_extract_all("tr", F.lit(cell), 1)).drop("tr").where(F.size("cells") >= 2)
    rows = _made(rows, label=tx.clean_html(F.get("cells", F.lit(0))))
    upper = F.upper("label")
    marked = (F.col("r") == 1) & upper.rlike("|".join(HEADER_MARKS))
    body = rows.where(~marked & ~upper.isin(HEADER_LABELS))
    fallback = F.concat(F.lit("table"), "t", F.lit("_row"), "r")
    body = _made(body, line=tx.line_key(F.col("label"), fallback))
    parts = F.array(
        F.struct(F.lit("stmt").alias("part"), F.get("cells", F.lit(1)).alias("cell")),
        F.struct(F.lit("log").alias("part"), F.get("cells", F.lit(2)).alias("cell")),
    )
    found = body.select(key, "s", "artifact_id", "t", "r", "line", F.explode(parts).alias("p"))
    found = _made(found.where(F.col("p.cell").isNotNull()), sign_sequence=tx.canonical_sequence(F.col("p.cell")))
    found = _made(found, _tokens=tx.tokens(F.col("sign_sequence")))
    return found.where(tx.plausible(F.col("_tokens"))).select(
        key, "s", "t", "r", "artifact_id", F.concat("line", F.lit("_"), "p.part").alias("line_id"), "sign_sequence"
    )


def link_sequences(
    pages: DataFrame,
    key: str,
    html: str,
    pattern: str = LINK_SEQUENCE,
    title: str = TITLE,
    catalog_only: bool = True,
) -> DataFrame:
    """Sequences that are spelled out in link targets, with the artifact from the page title."""
    raw = F.transform(F.regexp_extract_all(html, F.lit(pattern), 1), tx.canonical_sequence)
    found = F.filter(raw, lambda s: s != "")
    if catalog_only:
        found = F.filter(found, lambda s: tx.catalog_sequence(tx.tokens(s)))
    words = pages.select(
        key,
        tx.artifact_key(F.regexp_extract(html, title, 1)).alias("artifact_id"),
        F.posexplode(found).alias("pos", "sign_sequence"),
    )
    return words.where(tx.plausible(tx.tokens(F.col("sign_sequence")))).select(
        key,
        "artifact_id",
        F.concat(F.lit("word_"), F.col("pos") + 1).alias("line_id"),
        "sign_sequence",
    )


def document_links(pages: DataFrame, html: str, pattern: str = DOCUMENT_LINK) -> DataFrame:
    links = pages.select(F.explode(F.regexp_extract_all(html, F.lit(pattern), 1)).alias("path"))
    return links.distinct().orderBy("path")
