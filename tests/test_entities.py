"""Character references, against the standard library's decoder."""

import html

from pyspark.sql import functions as F

from linegrain.functions import text as tx

CASES = [
    None, "", "plain", "a & b", "&", "&&amp;", "&amp;lt;", "&lt;&gt;", "KU&hellip;RO &eacute; QA", "&notit; &notin;",
    "&ampx &copyleft &unknown; &unknownword", "&#65;&#x41;&#X41 &#8226;", "&#128;&#x81;&#159;", "&#0;&#xD800;&#1114112;",
    "&#1;&#11;&#xFDD0;&#xFFFE;&#x1FFFF;z", "&#99999999999999999999;", "&#000000000000065;", "&#x;&#;", "&#128512;",
    "&NewLine;&Tab;&nbsp;|", "&CounterClockwiseContourIntegral;", "&acE;", "\n&lt\n&gt", "&frac12;&frac12x",
]


def test_all_references(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, c string")
    got = {r["i"]: r["u"] for r in rows.select("i", tx.unescape(F.col("c")).alias("u")).collect()}
    assert got == {i: None if c is None else html.unescape(c) for i, c in enumerate(CASES)}


def test_references_are_no_tokens(spark):
    rows = spark.createDataFrame([("KU&hellip;RO &eacute; QA &bull; TE &#8226; X",)], "c string")
    assert rows.select(tx.canonical_sequence(F.col("c"))).first()[0] == "KU RO QA TE X"


def test_long_numbers(spark):
    rows = spark.createDataFrame([("AB 12345678901234567890",), ("AB 12",)], "c string")
    got = rows.select(tx.surface_part(F.col("c")), tx.quantity_part(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("AB", None), ("AB", 12)]
