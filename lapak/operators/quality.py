"""Data quality and manual review (A6-A8, SRC1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapak.functions.text import has_top_sold_marker, is_missing, or_blank, strip

# Fields of the quality report (wire name -> column) and unclear condition words.
REQUIRED_FIELDS = (
    ("platform", "platform"), ("sourceUrl", "source_url"), ("title", "title"), ("description", "description"),
    ("status", "status"), ("firstFetchedAt", "first_fetched_at"),
)
QUALITY_FIELDS = (
    ("price", "price"), ("category", "category"), ("brand", "brand"), ("locationTexts", "location_texts"),
    ("conditionText", "condition_text"), ("postedAt", "posted_at"), ("status", "status"), ("images", "image_count"),
)
AMBIGUOUS_CONDITIONS = ("bekas", "like new", "mulus", "normal", "second", "used")
COVERAGE_TARGET = 0.80


def scan_listings(listings: DataFrame, images: DataFrame, ordered: bool = False) -> DataFrame:
    """SRC1: listings with their image count; ``ordered`` sorts by platform, newest first fetch and id.

    The order is off by default, since sorting a full table only pays when it is written sorted.
    """
    counts = images.groupBy(F.col("listing_id").alias("id")).agg(F.count(F.lit(1)).alias("image_count"))
    rows = listings.join(counts, "id", "left").withColumn(
        "image_count", F.coalesce("image_count", F.lit(0).cast("bigint")))
    return rows.orderBy("platform", F.col("first_fetched_at").desc(), "id") if ordered else rows


def _missing(column: str) -> Column:
    c = F.col(column)
    if column == "location_texts":
        return is_missing(c, "array")
    if column in ("price", "posted_at", "first_fetched_at"):
        return is_missing(c, "value")
    return is_missing(c)


def _uncertain(wire: str, column: str) -> Column:
    if wire == "status":
        return F.lower(or_blank(F.col("status"))) == "unknown"
    if wire == "images":
        return F.col("image_count") <= 0
    return _missing(column)


def quality_fields(rows: DataFrame) -> DataFrame:
    """Arrays of missing required fields, low-confidence fields and review reasons per listing."""
    array = lambda tests: F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))
    return rows.withColumns({
        "missing": array([(wire, _missing(c)) for wire, c in REQUIRED_FIELDS]),
        "uncertain": array([(wire, _uncertain(wire, c)) for wire, c in QUALITY_FIELDS]),
        "reasons": array(_review_tests()),
    })


def _review_tests():
    condition = strip(or_blank(F.col("condition_text")))
    places = F.size(F.filter(F.coalesce("location_texts", F.array().cast("array<string>")), lambda v: strip(v) != ""))
    status = F.lower(or_blank(F.col("status")))
    return [
        ("missing_condition", condition == ""),
        ("ambiguous_condition", F.lower(condition).isin(*AMBIGUOUS_CONDITIONS)),
        ("missing_location", places == 0),
        ("multiple_locations", places > 1),
        ("unknown_sold_status", status == "unknown"),
        ("sold_status_conflict", ~status.isin("unknown", "sold") & has_top_sold_marker(F.col("description"))),
    ]


def quality_counts(rows: DataFrame) -> DataFrame:
    """(kind, field, count) of missing required and low-confidence fields; zero counts are left out.

    One pass of conditional counts, turned into rows afterwards, so nothing is exploded before the aggregation.
    """
    tests = [("missing", wire, _missing(c)) for wire, c in REQUIRED_FIELDS]
    tests += [("low_confidence", wire, _uncertain(wire, c)) for wire, c in QUALITY_FIELDS]
    counted = rows.agg(*[F.count_if(t).alias(f"c{i}") for i, (_, _, t) in enumerate(tests)])
    cells = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(wire).alias("field"), F.col(f"c{i}").alias("count"))
                      for i, (kind, wire, _) in enumerate(tests)])
    return counted.select(F.inline(cells)).filter(F.col("count") > 0)


def coverage(rows: DataFrame, target: float = COVERAGE_TARGET) -> DataFrame:
    """Share of listings with each field, overall (platform null) and per platform, in one pass.

    Grouping sets give both levels from one scan; an empty table has coverage one.
    """
    shares = [(wire, _uncertain(wire, c)) for wire, c in QUALITY_FIELDS]
    platform = F.lower(F.coalesce(F.nullif("platform", F.lit("")), F.lit("unknown")))
    keyed = rows.withColumn("_p", platform)
    grouped = keyed.groupingSets([[], ["_p"]], "_p").agg(
        F.grouping("_p").alias("_overall"), F.count(F.lit(1)).alias("total"),
        *[F.count_if(~F.coalesce(t, F.lit(True))).alias(f"c{i}") for i, (_, t) in enumerate(shares)])
    ratio = lambda i: F.when(F.col("total") == 0, F.lit(1.0)).otherwise(
        F.bround(F.col(f"c{i}") / F.col("total"), 4))
    cells = F.array(*[F.struct(F.lit(wire).alias("field"), ratio(i).alias("coverage"))
                      for i, (wire, _) in enumerate(shares)])
    return grouped.select("_p", "_overall", "total", F.inline(cells)).select(
        F.when(F.col("_overall") == 1, F.lit("(all)")).otherwise(F.col("_p")).alias("scope"), "total", "field",
        "coverage", (F.col("coverage") < target).alias("below_target"))


def manual_review(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings with review reasons, count per reason)."""
    tests = _review_tests()
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))
    items = rows.withColumn("reasons", reasons).filter(F.size("reasons") > 0).select(
        "id", "platform", "source_url", "external_id", "title", "status", "condition_text", "location_texts", "reasons")
    counted = rows.agg(*[F.count_if(t).alias(n) for n, t in tests])
    cells = F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("count")) for n, _ in tests])
    return items, counted.select(F.inline(cells)).filter(F.col("count") > 0)


def attention_items(rows: DataFrame) -> DataFrame:
    """Listings of the quality report: any missing required or low-confidence field."""
    marked = quality_fields(rows).filter((F.size("missing") > 0) | (F.size("uncertain") > 0))
    return marked.select("id", "platform", "source_url", "external_id", "title", "missing", "uncertain")
