"""Dictionary substitution and volumes by commodity, with group shares and their clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linegrain.session import cut

# Litres in one unit.
LITRES = {
    "big jar": 50, "amphoraA": 30, "amphoraB": 30, "large measure": 10, "small jar": 5,
    "measure tag": 1, "unit?": 0,
}
STAPLES = ["grain", "oil", "wine"]


def substitute(lines: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Look every sequence up in ``dictionary (sequence, commodity, unit, confidence)``."""
    keyed = lines.withColumn("sequence", F.array_join("signs", " "))
    return keyed.join(dictionary, ["sequence"], "left")


def volumes(substituted: DataFrame) -> DataFrame:
    """Count times litres per unit, for lines with a known unit and a count."""
    litres = F.create_map(*[F.lit(x) for pair in LITRES.items() for x in pair])
    known = substituted.where(F.col("unit").isNotNull() & F.col("quantity").isNotNull())
    return known.withColumn("litres", F.col("quantity") * litres[F.col("unit")])


def totals(volume_rows: DataFrame) -> DataFrame:
    """Litres by commodity and their share of all litres."""
    by = volume_rows.groupBy("commodity").agg(F.sum("litres").alias("litres"))
    everything = by.agg(F.sum("litres")).scalar()
    return by.withColumn("percent", F.round(100.0 * F.col("litres") / everything, 6))


def group_ratios(volume_rows: DataFrame, group: str = "artifact_id") -> DataFrame:
    """Shares of the staples in each group, over the staples alone."""
    wide = (
        volume_rows.where(F.col("commodity").isin(STAPLES))
        .groupBy(group)
        .pivot("commodity", STAPLES)
        .agg(F.sum("litres"))
        .na.fill(0, STAPLES)
    )
    total = F.col("grain") + F.col("oil") + F.col("wine")
    kept = wide.where(total > 0)
    return kept.select(group, *[F.round(F.col(c) / total, 6).alias(c) for c in STAPLES])


#: Where the clusters start, as shares of the staples: all grain, all wine.
CENTRES = ((1.0, 0.0, 0.0), (0.0, 0.0, 1.0))


def _nearest(centres: list[tuple[float, ...]]) -> Column:
    """The number of the nearest centre; of two as near, the first."""

    def far(centre: tuple[float, ...]) -> Column:
        parts = [(F.col(c) - F.lit(x)) * (F.col(c) - F.lit(x)) for c, x in zip(STAPLES, centre, strict=True)]
        return sum(parts[1:], parts[0])

    ways = [F.struct(F.round(far(x), 12).alias("d"), F.lit(i).alias("i")) for i, x in enumerate(centres)]
    return F.least(*ways)["i"] if len(ways) > 1 else F.lit(0)


def ratio_clusters(ratios: DataFrame, centres: tuple[tuple[float, ...], ...] = CENTRES) -> DataFrame:
    """Groups with similar shares: Lloyd's steps from fixed centres until the centres stay.

    A step is one aggregate of the rows by nearest centre, whose few numbers
    are the next step's centres; rows are written once. A centre that loses all
    its rows stays where it is.
    """
    rows = cut(ratios)
    now, met = [tuple(c) for c in centres], []
    while now not in met:  # rounded means may also alternate between two states
        met.append(now)
        means = rows.groupBy(_nearest(now).alias("i")).agg(*[F.round(F.avg(c), 9).alias(c) for c in STAPLES])
        found = {r["i"]: tuple(r[c] for c in STAPLES) for r in means.collect()}  # a row for each centre
        now = [found.get(i, c) for i, c in enumerate(now)]
    return rows.withColumn("cluster", _nearest(now))
