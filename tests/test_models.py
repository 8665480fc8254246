"""Groups left out of a model, against a plain version, and what is shuffled for them."""

from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from linegrain.operators import models as md


def plain_leave_out(groups, model, alpha=md.ALPHA):
    """Log-likelihood of each group under the counts of all others, line by line."""
    out = {}
    for g, own in groups.items():
        rest = [s for other, lines in groups.items() if other != g for s in lines]
        uni, lengths = Counter(t for s in rest for t in s), Counter(len(s) for s in rest)
        cells = Counter()
        for s in rest:
            for i, t in enumerate(s):
                cells["pos", len(s), i, t] += 1
                cells["pos", len(s), i] += 1
                cells["bi", s[i - 1] if i else None, t] += 1
                cells["bi", s[i - 1] if i else None] += 1
        ll, width = 0.0, alpha * (max(1, len(uni)) + 1)
        for s in own:
            ll += math.log((lengths[len(s)] + alpha) / (len(rest) + alpha * (len(lengths) + 1)))
            for i, t in enumerate(s):
                key = {"unigram": (), "position": ("pos", len(s), i), "bigram": ("bi", s[i - 1] if i else None)}[model]
                n, c = (cells[key], cells[(*key, t)]) if key else (sum(uni.values()), uni[t])
                if model == "position" and n == 0:
                    n, c = sum(uni.values()), uni[t]
                ll += math.log((c + alpha) / (n + width))
        out[g] = ll
    return out


def test_groups_left_out_move_each_cell_once(spark):
    """Lengths that one group alone has, tokens of one group, several splits; no cell is shuffled again behind its total."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    groups = {f"g{g}": [[words[int(rng.random() ** 2 * 40)] for _ in range(rng.choice([1, 2, 3, 4]))] for _ in range(1 + g % 5)] for g in range(12)}
    groups["g3"] += [["only", "w1", "w2", "w1", "only", "w3", "w4"]] * 2
    groups["g5"] += [["w1"] * 9, ["w1"] * 9]
    groups["g6"] += [["w2"] * 9]
    rows = [(f"{g}-{i}", g, s) for g, lines in groups.items() for i, s in enumerate(lines)]
    lines = spark.createDataFrame(rows, "line_id string, grp string, signs array<string>")
    both = lines.withColumn("split", F.explode(F.array(F.lit("a"), F.lit("b")))).where("split = 'a' or grp <> 'g6'")
    models = ["unigram", "bigram", "position"]
    scored = md.leave_out(md.cells(both, ["split", "grp"], md.needed(models)), ["grp"], models)
    got = {(r["split"], r["model"], r["grp"]): (r["ll"], r["lines"], r["tokens"]) for r in scored.collect()}
    for split, held in (("a", groups), ("b", {g: v for g, v in groups.items() if g != "g6"})):
        for model in models:
            want = plain_leave_out(held, model)
            for g, ll in want.items():
                found, n, tokens = got.pop((split, model, g))
                assert math.isclose(found, ll, rel_tol=1e-9), (split, model, g)
                assert (n, tokens) == (len(held[g]), sum(map(len, held[g])))
    assert not got
    moved = [x for x in scored._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert not [x for x in moved if "ctx#" in x and "tok#" in x], moved
