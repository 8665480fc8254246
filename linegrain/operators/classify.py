"""Attributes read off artifact codes and sequences, and the inventories built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linegrain.scale import ordered_index

# Regions by site code.
REGIONS = {
    "crete_central": ["HT", "KN", "ARKH", "PH", "PK"],
    "crete_east": ["ZA", "PE", "PS", "SY"],
    "crete_west": ["KH"],
    "aegean_islands": ["KE", "MI", "MA", "TH", "KY"],
    "mainland_or_external": ["MY", "PYR", "TY"],
}
# Tokens that name a commodity, and further ideograms.
COMMODITIES = ["GRA", "OLE", "OLIV", "VINA", "VIN", "FIC"]
IDEOGRAMS = [*COMMODITIES, "OVIS", "CAP"]
# Confidence of a formula class, and why.
FORMULA_CONFIDENCE = {
    "commodity_accounting": (0.68, "explicit commodity/logogram tokens are present"),
    "ab22_positional_formula": (0.58, "AB22 positional recurrence is measurable"),
    "total_formula_candidate": (0.58, "KU RO candidate is traditionally treated as functional"),
    "short_mark_or_label": (0.42, "short labels recur but are not semantically classified"),
    "a_series_sequence": (0.36, "A-series sign patterns need external sign-function review"),
}
OTHER_CONFIDENCE = 0.22
BASIS = "classification is currently metadata/sequence assisted"
# Anchor, what to count in the running text, confidence.
ANCHORS = [
    ("commodity_logograms", ["GRA", "OLE", "VINA", "FIC", "OLIV"], 0.62),
    ("ku_ro_total_formula", ["KU RO"], 0.58),
    ("ab22_positional_pivot", ["AB22"], 0.54),
]


def site(artifact: Column) -> Column:
    code = F.regexp_extract(F.trim(artifact), "^([A-Z]+)", 1)
    return F.coalesce(F.nullif(code, F.lit("")), F.lit("UNKNOWN"))


def region(site_code: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, codes in REGIONS.items():
        found = F.coalesce(found, F.when(site_code.isin(codes), name))
    return F.coalesce(found, F.lit("unknown"))


def object_class(artifact: Column) -> Column:
    code = F.upper(artifact)
    return (
        F.when(F.contains(code, F.lit("WC")), "sealed_document_or_roundel")
        .when(F.contains(code, F.lit("WA")), "nodule_or_sealing")
        .when(F.contains(code, F.lit(" Z")), "inscription_or_vessel")
        .when(code.rlike(r"\b(HT|KH|ZA|ARKH|PH|KN)\b"), "administrative_tablet_like")
        .otherwise("unclassified")
    )


def formula_class(signs: Column) -> Column:
    commodity = F.arrays_overlap(signs, F.array(*map(F.lit, COMMODITIES)))
    return (
        F.when(commodity, "commodity_accounting")
        .when(F.contains(F.array_join(signs, " "), F.lit("KU RO")), "total_formula_candidate")
        .when((F.size(signs) == 4) & (F.get(signs, F.lit(2)) == "AB22"), "ab22_positional_formula")
        .when(F.size(signs) <= 2, "short_mark_or_label")
        .when(F.exists(signs, lambda t: t.rlike("^A[0-9]+$")), "a_series_sequence")
        .otherwise("unclassified")
    )


def purpose(object_cls: Column, formula: Column) -> Column:
    administrative = ["commodity_accounting", "total_formula_candidate", "ab22_positional_formula"]
    return (
        F.when(formula.isin(administrative), "administrative")
        .when(object_cls == "inscription_or_vessel", "ritual_or_display_possible")
        .otherwise("unknown")
    )


def length_bucket(signs: Column) -> Column:
    n = F.size(signs)
    return F.when(n <= 2, "short_1_2").when(n <= 4, "medium_3_4").otherwise("long_5_plus")


def attributes(lines: DataFrame) -> DataFrame:
    """Lines with everything that a holdout split can be made of."""
    artifact, signs = F.col("artifact_id"), F.col("signs")
    where = site(artifact)
    return lines.withColumns(
        {
            "site": where,
            "region": region(where),
            "object_class": object_class(artifact),
            "formula_class": formula_class(signs),
            "length_bucket": length_bucket(signs),
        }
    )


def _distinct_values(
    df: DataFrame, group: str, value: str, separator: str, shown: int | None = None
) -> DataFrame:
    """The distinct values of each group in order, joined: all, or the first ``shown`` for a report."""
    distinct = df.select(group, value).where(F.col(value).isNotNull()).distinct()
    if shown is not None:
        # The rank filter runs before the shuffle too, so each task sends few rows of a group.
        order = W.partitionBy(group).orderBy(value)
        distinct = distinct.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= shown)
    return distinct.groupBy(group).agg(
        F.array_join(F.array_sort(F.collect_list(value)), separator).alias(value)
    )


def artifact_metadata(lines: DataFrame, shown: int | None = None) -> DataFrame:
    """One row per artifact; ``lines`` needs line_id, signs, quantity and provenance.

    Lists of tokens and of sources are whole unless ``shown`` cuts them.

    Ties of the modal formula class go to the class of the earliest line.
    """
    base = attributes(lines)
    per_class = base.groupBy("artifact_id", "formula_class").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_id").alias("first_line")
    )
    modal = per_class.groupBy("artifact_id").agg(
        F.min_by("formula_class", F.struct((-F.col("n")).alias("n"), "first_line")).alias("formula_class")
    )
    unknown = F.size(F.filter("signs", lambda t: t.isin("[?]", "?")))
    ideogram = F.arrays_overlap("signs", F.array(*map(F.lit, IDEOGRAMS)))
    rolled = base.groupBy("artifact_id").agg(
        F.sum(F.size("signs")).alias("sign_count"),
        F.count(F.lit(1)).alias("line_count"),
        F.sum(unknown).alias("unknown_count"),
        F.bool_or(ideogram).alias("has_ideogram"),
        F.bool_or(F.col("quantity").isNotNull()).alias("has_numeral"),
    )
    tokens = base.select("artifact_id", F.explode(F.array_distinct("signs")).alias("signs_used"))
    used = _distinct_values(tokens, "artifact_id", "signs_used", " ", shown)
    tags = _distinct_values(base, "artifact_id", "provenance", "; ", shown)
    artifact = F.col("artifact_id")
    where = site(artifact)
    obj = object_class(artifact)
    joined = rolled.join(modal, "artifact_id").join(used, "artifact_id", "left").join(
        tags, "artifact_id", "left"
    )

    def yes(c: Column) -> Column:
        return F.when(c, "1").otherwise("0")

    kind = purpose(obj, F.col("formula_class"))
    return joined.select(
        F.col("artifact_id").alias("inscription_id"),
        F.coalesce("provenance", F.lit("")).alias("provenance_source_url"),
        where.alias("site_find_place"),
        region(where).alias("region"),
        obj.alias("object_type"),
        kind.alias("classification"),
        "formula_class",
        F.col("sign_count").alias("inscription_length"),
        "line_count",
        "sign_count",
        F.col("sign_count").alias("word_count"),
        F.coalesce("signs_used", F.lit("")).alias("sign_inventory_used"),
        yes(
            (obj == "inscription_or_vessel") & (F.col("formula_class") != "commodity_accounting")
        ).alias("libation_formula_candidate"),
        yes(kind == "administrative").alias("accounting_candidate"),
        yes(F.col("has_ideogram")).alias("ideogram_presence"),
        yes(F.col("has_numeral")).alias("numeral_presence"),
        F.round(F.col("unknown_count") / F.greatest(F.lit(1), "sign_count"), 4).alias(
            "damage_unreadability_level"
        ),
    )


def metadata_coverage(metadata: DataFrame) -> DataFrame:
    """Artifacts by region, by object type and by formula class, and in all, in one pass."""
    sets = [["region"], ["object_type"], ["formula_class"], []]
    grouped = metadata.groupingSets(sets, "region", "object_type", "formula_class").agg(
        F.count(F.lit(1)).alias("inscriptions"),
        F.count_distinct("site_find_place").alias("sites"),
        F.grouping_id().alias("gid"),
    )
    return grouped.select(
        F.when(F.col("gid") == 3, "region")
        .when(F.col("gid") == 5, "object_type")
        .when(F.col("gid") == 6, "formula_class")
        .otherwise("all")
        .alias("dimension"),
        F.coalesce("region", "object_type", "formula_class", F.lit("")).alias("value"),
        "inscriptions",
        "sites",
    )


def formula_inventory(metadata: DataFrame, shown: int | None = None) -> DataFrame:
    """One row per formula class with its sites (all, or the first ``shown``), usual object and confidence."""
    kinds = metadata.groupBy("formula_class", "object_type").agg(F.count(F.lit(1)).alias("n"))
    usual = kinds.groupBy("formula_class").agg(
        F.min_by("object_type", F.struct((-F.col("n")).alias("n"), "object_type")).alias("dominant_object_type")
    )
    sites = _distinct_values(
        metadata.select("formula_class", F.col("site_find_place").alias("sites")),
        "formula_class", "sites", "; ", shown,
    )
    rolled = metadata.groupBy("formula_class").agg(
        F.count(F.lit(1)).alias("supporting_inscriptions"),
        F.count_if(F.col("accounting_candidate") == "1").alias("accounting_candidates"),
        F.count_if(F.col("libation_formula_candidate") == "1").alias("libation_candidates"),
    )
    confidence, basis = F.lit(OTHER_CONFIDENCE), F.lit(BASIS)
    for name, (value, reason) in FORMULA_CONFIDENCE.items():
        hit = F.col("formula_class") == name
        confidence = F.when(hit, value).otherwise(confidence)
        basis = F.when(hit, f"{BASIS}; {reason}").otherwise(basis)
    return rolled.join(sites, "formula_class").join(usual, "formula_class").select(
        "formula_class",
        "supporting_inscriptions",
        "sites",
        "dominant_object_type",
        "accounting_candidates",
        "libation_candidates",
        F.round(confidence * 100, 1).alias("confidence_percent"),
        basis.alias("classification_basis"),
    )


def anchor_support(lines: DataFrame, order: list[str]) -> DataFrame:
    """How often each anchor text stands in the corpus, read as one running text.

    Inside a line, hits are counted without overlap. An anchor of two tokens
    may also start at the end of a line: the last token of every line is
    paired with the first of the next one by their places in ``order``.
    """
    text = F.array_join("signs", " ")
    inside = lines.select(text.alias("text")).agg(
        *[
            sum(
                F.coalesce(F.sum((F.length("text") - F.length(F.replace("text", F.lit(p), F.lit("")))) / len(p)), F.lit(0.0))
                for p in parts
            ).cast("long").alias(name)
            for name, parts, _ in ANCHORS
        ]
    )
    numbered = ordered_index(
        lines.select(
            *order,
            F.element_at("signs", -1).alias("last"),
            F.element_at("signs", 1).alias("first"),
        ),
        order,
        "_n",
    )
    ends = numbered.where(F.col("last").endswith("KU")).select((F.col("_n") + 1).alias("_n"))
    starts = numbered.where(F.col("first").startswith("RO")).select("_n")
    across = ends.join(starts, "_n").agg(F.count(F.lit(1))).scalar()
    counted = inside.withColumn("_across", across)
    rows = [
        F.struct(
            F.lit(name).alias("anchor_id"),
            (F.col(name) + (F.col("_across") if name == "ku_ro_total_formula" else F.lit(0))).alias(
                "observed_support_count"
            ),
            F.lit(round(conf * 100, 1)).alias("confidence_percent"),
            F.lit("moderate" if conf >= 0.55 else "low").alias("tier"),
        )
        for name, _, conf in ANCHORS
    ]
    return counted.select(F.inline(F.array(*rows)))
