"""URL filters: dated list entries joined to captures as of their fetch time.

An entry says that from a day on a domain is listed or is not. Entries of a
domain become intervals that end where its next entry begins; on one day a
listing wins. A capture is blocked if its host, or a domain above it of at
least two labels, was listed when it was fetched. Intervals of a domain do not
overlap, so a capture meets at most one of each of its domains. The as-of join
takes each domain and fetch day once, so a hot domain has no more rows there
than days; captures then meet its hits by domain and day, and adaptive
execution splits a hot day.

Captures with NULL or unreadable url or NULL day stay and are not blocked.
Entries with NULL in any column say nothing. Equal rows give equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAR = "9999-12-31"


def host(url: Column | str) -> Column:
    """The lower-case host of a URL, NULL if it has none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, since, until) while listed, from entries of (domain, day, listed)."""
    daily = entries.dropna(subset=["domain", "day", "listed"]).groupBy("domain", "day").agg(F.max("listed").alias("listed"))
    following = F.lead("day").over(W.partitionBy("domain").orderBy("day"))
    ended = daily.withColumn("until", F.coalesce(following, F.lit(FAR).cast("date"))).where("listed")
    return ended.select("domain", F.col("day").alias("since"), "until")


def as_of(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """``captures`` as ``_row``, with host, n_listed (domains listed on its day) and blocked."""
    row = F.struct(*[F.col(c) for c in captures.columns]).alias("_row")
    base = captures.select(
        F.monotonically_increasing_id().alias("_rid"), row, host(url).alias("host"), F.col(day).alias("_day")
    )
    labels = F.split("host", r"\.")
    above = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    domains = base.withColumn("_domain", F.explode_outer(above))
    listed = intervals(entries).withColumnRenamed("domain", "_listed")
    same = (F.col("_domain") == F.col("_listed")) & (F.col("_day") >= F.col("since")) & (F.col("_day") < F.col("until"))
    # What was listed depends on domain and day alone: a domain meets its intervals once a day, however often it was fetched.
    asked = domains.select("_domain", "_day").dropna().distinct()
    hits = asked.join(listed, same).select(F.col("_domain").alias("_hit"), F.col("_day").alias("_hit_day"))
    met = domains.join(hits, (F.col("_domain") == F.col("_hit")) & (F.col("_day") == F.col("_hit_day")), "left")
    out = met.groupBy("_rid", "_row", "host").agg(F.count("_hit").alias("n_listed"))
    return out.select("_row", "host", "n_listed", (F.col("n_listed") > 0).alias("blocked"))
