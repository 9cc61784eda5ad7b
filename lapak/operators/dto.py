"""The public shape of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapak.functions.text import sanitize_public_location
from lapak.functions.urls import DEFAULT_MEDIA_ORIGIN, is_safe_cached_media_url, is_safe_https_url
from lapak.functions.values import effective_at, effective_seller, normalize_public_price


def public_image_url(platform: Column, source_url: Column, cached_url: Column, origin: str = DEFAULT_MEDIA_ORIGIN) -> Column:
    """The cached copy when it is safe for the platform, else the source."""
    safe = cached_url.isNotNull() & is_safe_cached_media_url(cached_url, platform, origin)
    return F.when(safe, cached_url).otherwise(source_url)


def to_listing_dto(listings: DataFrame, images: DataFrame, moderation: DataFrame, on_unsafe: str = "error",
                   origin: str = DEFAULT_MEDIA_ORIGIN) -> DataFrame:
    """One row per listing. ``on_unsafe='quarantine'`` marks unsafe source URLs instead of failing.

    Images are collected per listing, where the unique (listing, position) pair bounds the array, and meet the listing
    once; which of them are public is decided inside the array.
    """
    gallery = images.groupBy(F.col("listing_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("position", "source_url", "cached_url", "alt_text"))).alias("_gallery"))
    marks = moderation.select(F.col("listing_id").alias("id"), "seller_name_override")
    rows = listings.join(marks, "id", "left").join(gallery, "id", "left")
    safe = is_safe_https_url(F.col("source_url"))
    if on_unsafe == "error":
        source = F.when(safe, F.col("source_url")).otherwise(
            F.raise_error(F.lit("listing source URL must use HTTPS")))
        extra = []
    else:
        source = F.col("source_url")
        extra = [(~safe).alias("unsafe")]
    places = F.filter(F.transform("location_texts", sanitize_public_location), lambda v: v.isNotNull())
    public = F.transform("_gallery", lambda i: F.struct(
        public_image_url(F.col("platform"), i["source_url"], i["cached_url"], origin).alias("source_url"),
        i["position"].alias("position"), i["alt_text"].alias("alt_text")))
    shown = F.filter(public, lambda i: is_safe_https_url(i["source_url"]))
    return rows.select(
        "id", "platform", source.alias("source_url"), "title", "description", "category", "brand",
        normalize_public_price(F.col("price")).alias("price"), F.lit("IDR").alias("currency"),
        places.alias("location_texts"), "condition_text", effective_seller().alias("seller_name"), "status",
        effective_at().alias("listed_at"),
        F.coalesce(shown, F.array().cast("array<struct<source_url:string,position:int,alt_text:string>>")).alias("images"),
        *extra,
    )
