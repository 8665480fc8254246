"""The audit finds exactly the damaged offsets."""

from __future__ import annotations

from linegrain.llm import fixity


def test_audit(spark):
    rows = [("a", i, f"record {i}") for i in range(300)] + [(None, 3, "x"), ("b", None, None), ("b", 7, ""), ("c", 1, "t"), ("c", 1, "t")]
    other = [(s, o, p + "!" if (s, o) == ("a", 17) else p) for s, o, p in rows if (s, o) != ("a", 256)][:-1]
    other = [(s, o, None if (s, o) == ("b", 7) else p) for s, o, p in other] + [("a", 70_000, "new")]
    kind = "s string, o long, p string"
    one, two = spark.createDataFrame(rows, kind), spark.createDataFrame(other, kind)
    found = {(r.shard, r.offset, r.state) for r in fixity.audit(one, two, "s", "o", "p").collect()}
    a, b, c = '{"s":"a"}', '{"s":"b"}', '{"s":"c"}'
    assert found == {(a, 17, "changed"), (a, 256, "missing"), (a, 70_000, "extra"), (b, 7, "changed"), (c, 1, "changed")}
    assert fixity.audit(one, one.repartition(3), "s", "o", "p").count() == 0
    assert fixity.audit(one.limit(0), two.limit(0), "s", "o", "p").count() == 0
