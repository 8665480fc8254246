"""Lists as of the day of a fetch."""

from __future__ import annotations

import datetime as dt

from linegrain.llm import urllists


def test_intervals_and_edge_rows(spark):
    day = lambda n: dt.date(2024, 1, n)
    entries = [("a.org", day(2), True), ("a.org", day(5), False), ("a.org", day(5), True), ("a.org", day(8), False),
               ("b.net", day(3), True), (None, day(1), True), ("c.org", None, True), ("org", day(1), True)]
    captures = [("http://a.org/x", day(1)), ("http://a.org", day(2)), ("https://u@M.A.org:80/", day(7)), ("http://a.org", day(8)),
                ("http://xb.net", day(9)), ("http://b.net", day(9)), ("http://b.net", day(9)), (None, day(9)), ("junk", day(9)),
                ("", None), ("http://a.org", None), ("http://org/", day(3)), ("http://c.org", day(3))]
    e = spark.createDataFrame(entries, "domain string, day date, listed boolean")
    c = spark.createDataFrame(captures, "url string, day date").selectExpr("*", "1 AS host", "2 AS listed")
    found = sorted((repr((r._row.url, r._row.day)), r.blocked) for r in urllists.as_of(c, e).collect())
    want = [False, True, True, False, False, True, True, False, False, False, False, True, False]
    assert found == sorted((repr(x), b) for x, b in zip(captures, want, strict=True))
    assert urllists.as_of(c.limit(0), e).count() == 0
    assert urllists.as_of(c, e.limit(0)).where("blocked").count() == 0
