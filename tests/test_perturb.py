"""Weighted draws and cross prediction against plain versions, and what they cost in rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from linegrain.operators import models as md
from linegrain.operators import perturb as pt


def number(*parts) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def lines_of(spark, rows):
    return spark.createDataFrame(rows, "line_id string, artifact_id string, signs array<string>")


def test_draws_on_a_skewed_vocabulary(spark):
    """One token holds most of the corpus, a thousand others occur once."""
    rows = [(f"l{i}", "a", ["hot"] * 9 + [f"rare{i}"]) for i in range(1000)] + [("empty", "a", [])]
    counts = Counter(t for _, _, signs in rows for t in signs)
    owner = [t for t in sorted(counts) for _ in range(counts[t])]
    for share in (0.2, 1.0):
        got = {r["line_id"]: r["signs"] for r in pt.redraw_tokens(lines_of(spark, rows), share, 5).collect()}
        for line, _, signs in rows:
            hit = [number(line, i, "5hit") % 1_000_000 < share * 1_000_000 for i in range(len(signs))]
            want = [owner[number(line, i, "5draw") % len(owner)] if h else t for i, (h, t) in enumerate(zip(hit, signs, strict=True))]
            assert got[line] == want
    none = pt.redraw_tokens(lines_of(spark, []), 1.0)
    assert none.count() == 0


def plain_cross(groups, alpha=md.ALPHA):
    """The position model of each group on the lines of all others."""
    out = {}
    for g, own in groups.items():
        uni = Counter(t for s in own for t in s)
        pos = defaultdict(Counter)
        lengths = Counter(len(s) for s in own)
        for s in own:
            for i, t in enumerate(s):
                pos[len(s), i][t] += 1
        ll = 0.0
        for other, lines in groups.items():
            for s in lines if other != g else []:
                ll += math.log((lengths[len(s)] + alpha) / (len(own) + alpha * (len(lengths) + 1)))
                for i, t in enumerate(s):
                    c = pos.get((len(s), i), uni)
                    ll += math.log((c[t] + alpha) / (sum(c.values()) + alpha * (len(uni) + 1)))
        out[g] = ll
    return out


def test_cross_prediction_with_many_groups(spark):
    """200 groups of unlike lengths; a group's tokens meet at most twice as many rows as there are cells."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    groups = {f"g{g}": [[words[int(rng.random() ** 3 * 300)] for _ in range(rng.choice([1, 2, 3, 4, 5, 5 + g % 9]))] for _ in range(1 + g % 13)] for g in range(200)}
    groups["g0"] += [[words[0]] * rng.randint(1, 13) for _ in range(2000)]
    rows = [(f"{g}-{i}", g, s) for g, lines in groups.items() for i, s in enumerate(lines)]
    made = md.cells(lines_of(spark, rows).withColumn("grp", F.col("artifact_id")), ["grp"], md.needed(["position"])).cache()
    got = {r["grp"]: r["ll"] for r in md.cross_groups(made, "grp", ["position"]).collect()}
    want = plain_cross(groups)
    assert got.keys() == want.keys()
    for g in want:
        assert math.isclose(got[g], want[g], rel_tol=1e-9), g
    total = made.groupBy(*md.CELL).agg(F.sum("n").alias("total"))
    _, met = md._tokens_by_length(made, total, "grp")
    assert met.count() <= 2 * made.count()
