"""Facets, collection roll-up and feed revision (A1-A5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapak.functions.text import (
    plausible_condition, plausible_location, sanitize_facet_text, sanitize_public_location,
)
from lapak.functions.urls import DEFAULT_MEDIA_ORIGIN, is_safe_cached_media_url, is_safe_https_url
from lapak.functions.values import MIN_PUBLIC_PRICE, PLACEHOLDER_PRICES, effective_at, iso_millis, \
    normalize_public_price
from lapak.schemas import COLLECTIONS


def cover_order() -> Column:
    """Largest struct wins: unsold before sold, then newest, then largest id."""
    return F.struct((F.col("status") != "sold").alias("unsold"), effective_at().alias("at"), F.col("id").alias("id"))


def category_stats(visible: DataFrame) -> DataFrame:
    """A1/W1 core: count, lowest usable price and cover listing per category in one partial aggregation.

    Taking the cover with max_by instead of a ranking window keeps a category with a third of all rows from meeting
    in one task.
    """
    usable = (F.col("price") >= MIN_PUBLIC_PRICE) & ~F.col("price").isin(*PLACEHOLDER_PRICES)
    rows = visible.filter(F.col("category").isNotNull() & (F.trim("category") != ""))
    return rows.groupBy(F.col("category").alias("value")).agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.when(usable, F.col("price"))).alias("min_price"),
        F.max_by(F.struct("id", "platform"), cover_order()).alias("_cover"),
    ).select("value", "count", "min_price", F.col("_cover.id").alias("cover_id"),
             F.col("_cover.platform").alias("cover_platform"))


def category_covers(visible: DataFrame) -> DataFrame:
    """The cover listing of each category."""
    return category_stats(visible).select("value", "cover_id", "cover_platform")


def top_categories(visible: DataFrame, images: DataFrame, limit: int = 50) -> DataFrame:
    """Statistics with the position-0 image of the cover, before cleaning.

    The limit comes before the image join, so few rows meet the position-0 images.
    """
    top = category_stats(visible).orderBy(F.col("count").desc(), "value").limit(limit)
    first = images.filter(F.col("position") == 0).select(
        F.col("listing_id").alias("cover_id"), F.col("source_url").alias("_source"), F.col("cached_url").alias("_cached"),
        F.col("alt_text").alias("cover_alt_text"))
    return top.join(first, "cover_id", "left").select(
        "value", "count", "min_price", F.coalesce("_cached", "_source").alias("cover_image_url"),
        F.col("_cached").isNotNull().alias("cover_image_cached"), "cover_platform", "cover_alt_text")


def category_facets(visible: DataFrame, images: DataFrame, limit: int = 50,
                    origin: str = DEFAULT_MEDIA_ORIGIN) -> DataFrame:
    """A1: cleaned category facets. The limit comes before cleaning, so the result may be shorter."""
    raw = top_categories(visible, images, limit)
    url = F.col("cover_image_url")
    safe = F.when(F.col("cover_image_cached"), is_safe_cached_media_url(url, F.col("cover_platform"), origin)) \
        .otherwise(is_safe_https_url(url))
    return raw.select(
        sanitize_facet_text(F.col("value"), 64).alias("value"), "count",
        normalize_public_price(F.col("min_price")).alias("min_price"),
        F.when(url.isNotNull() & safe, url).alias("cover_image_url"),
        sanitize_facet_text(F.col("cover_alt_text"), 160).alias("cover_alt_text"),
    ).filter(F.col("value").isNotNull())


def location_occurrences(visible: DataFrame) -> DataFrame:
    """One row per location of a listing; a repeated location counts again."""
    return visible.select("id", F.explode("location_texts").alias("value")).filter(F.trim("value") != "")


def location_facets(visible: DataFrame, limit: int = 100) -> DataFrame:
    """A2."""
    counts = location_occurrences(visible).groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.col("count").desc(), "value").limit(limit)
    cleaned = top.select(sanitize_public_location(F.col("value")).alias("value"), "count")
    return cleaned.filter(F.col("value").isNotNull() & plausible_location(F.col("value")))


def condition_facets(visible: DataFrame, limit: int = 50) -> DataFrame:
    """A3."""
    rows = visible.filter(F.col("condition_text").isNotNull() & (F.trim("condition_text") != ""))
    counts = rows.groupBy(F.col("condition_text").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.col("count").desc(), "value").limit(limit)
    cleaned = top.select(sanitize_facet_text(F.col("value"), 80).alias("value"), "count")
    return cleaned.filter(F.col("value").isNotNull() & plausible_condition(F.col("value")))


def collection_dimension(spark) -> DataFrame:
    """One row per collection and category (fixed list); 'all' has no categories of its own."""
    rows = [(place, slug, category) for place, (slug, categories) in enumerate(COLLECTIONS) for category in categories]
    return spark.createDataFrame(rows, "place int, slug string, category string")


def collection_rollup(facets: DataFrame) -> DataFrame:
    """A4: count and lowest price per collection; collections without listings stay with zero."""
    dimension = collection_dimension(facets.sparkSession)
    matched = dimension.join(facets, dimension["category"] == facets["value"], "left")
    return matched.groupBy("slug").agg(
        F.coalesce(F.sum("count"), F.lit(0).cast("bigint")).alias("count"), F.min("min_price").alias("lowest_price"))


def feed_version(visible: DataFrame) -> DataFrame:
    """A5: total count and revision, the unpadded base64url SHA-256 of count and newest first fetch."""
    totals = visible.agg(F.count(F.lit(1)).alias("total_count"), F.max("first_fetched_at").alias("latest"))
    return totals.select(revision(F.col("total_count"), F.col("latest")).alias("revision"), "total_count")


def revision(count: Column, latest: Column) -> Column:
    text = F.concat(count.cast("string"), F.lit("\x00"), F.coalesce(iso_millis(latest), F.lit("empty")))
    return F.translate(F.base64(F.unhex(F.sha2(text, 256))), "+/=", "-_")


def platform_status_counts(listings: DataFrame) -> DataFrame:
    """A21."""
    return listings.groupBy("platform", "status").agg(F.count(F.lit(1)).alias("count"))
