"""Seller flags: legacy mapping, constraints, duplicate statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapak.functions.text import normalize_listing_content, normalize_seller_name, or_blank, seller_name_clean
from lapak.functions.values import effective_seller
from lapak.schemas import FACEBOOK_PLATFORMS


def event_platforms(events: DataFrame) -> DataFrame:
    """Distinct Facebook platforms named by moderation events per normalized seller name."""
    name = F.coalesce(F.nullif(F.get_json_object("details", "$.sellerName"), F.lit("")), F.col("entity_id"))
    named = F.get_json_object("details", "$.platform")
    about = F.col("action").isin("block_seller", "admin_backfill") | (F.col("entity_type") == "facebook_seller")
    return events.filter(about).groupBy(normalize_seller_name(name).alias("normalized_seller_name")).agg(
        F.array_sort(F.collect_set(F.when(named.isin(*FACEBOOK_PLATFORMS), named))).alias("event_platforms"))


def stored_platforms(listings: DataFrame, moderation: DataFrame) -> DataFrame:
    """Distinct Facebook platforms of stored listings per normalized effective seller."""
    marks = moderation.select(F.col("listing_id").alias("id"), "seller_name_override")
    rows = listings.filter(F.col("platform").isin(*FACEBOOK_PLATFORMS)).join(marks, "id", "left")
    named = rows.filter(F.coalesce(F.trim(effective_seller()), F.lit("")) != "")
    return named.groupBy(normalize_seller_name(effective_seller()).alias("normalized_seller_name")).agg(
        F.array_sort(F.collect_set("platform")).alias("stored_platforms"))


def resolve_legacy_seller_platform(flags: DataFrame, events: DataFrame, listings: DataFrame, moderation: DataFrame,
                                   strict: bool = False) -> DataFrame:
    """One platform per legacy flag: automatic flags are Marketplace flags, then the only event platform, then
    the only stored platform. Unresolved flags keep null, or fail the query with ``strict``."""
    rows = flags.join(event_platforms(events), "normalized_seller_name", "left").join(
        stored_platforms(listings, moderation), "normalized_seller_name", "left")
    only = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1))
    platform = F.when(F.col("source") == "auto", F.lit("facebook")).otherwise(
        F.coalesce(only("event_platforms"), only("stored_platforms")))
    if strict:
        platform = F.coalesce(platform, F.raise_error(F.lit("a legacy seller flag cannot be mapped to one platform")))
    return rows.select(*flags.columns, platform.alias("platform"))


def check_flag_constraints(flags: DataFrame) -> DataFrame:
    """Broken constraints per flag (rows without any are left out)."""
    copies = flags.groupBy("platform", "normalized_seller_name").agg(F.count(F.lit(1)).alias("_n"))
    rows = flags.join(copies, ["platform", "normalized_seller_name"], "left")
    tests = [
        (~F.length(F.trim("seller_name")).between(1, 120), "seller_name length"),
        (F.col("normalized_seller_name") != normalize_seller_name(F.col("seller_name")), "normalized_seller_name"),
        (F.length("reason") > 500, "reason length"),
        (F.col("recent_listing_count") < 0, "recent_listing_count"),
        (F.col("duplicate_listing_count") < 0, "duplicate_listing_count"),
        (~F.col("duplicate_ratio").between(0, 1), "duplicate_ratio"),
        (~F.col("platform").isin(*FACEBOOK_PLATFORMS), "platform"),
        (F.col("_n") > 1, "unique platform and name"),
    ]
    broken = F.array_compact(F.array(*[F.when(test, F.lit(label)) for test, label in tests]))
    return rows.withColumn("violations", broken).filter(F.size("violations") > 0).drop("_n")


def fill_seller_names(listings: DataFrame, names: DataFrame) -> DataFrame:
    """Rows without a seller take a looked-up name (external_id, name); rows without id or URL never ask."""
    found = names.select("external_id", seller_name_clean(F.col("name")).alias("_found"))
    rows = listings.join(found, "external_id", "left")
    asks = (seller_name_clean(F.col("seller_name")).isNull() & (or_blank(F.col("external_id")) != "")
            & (or_blank(F.col("source_url")) != ""))
    seller = F.when(asks & F.col("_found").isNotNull(), F.col("_found")).otherwise(F.col("seller_name"))
    return rows.withColumn("seller_name", seller).select(*listings.columns)


def seller_duplicate_stats(listings: DataFrame, moderation: DataFrame, flags: DataFrame, as_of, window_days: int = 7,
                           min_listings: int = 5, min_duplicates: int = 4, min_ratio: float = 0.7,
                           auto_block: bool = True, platform: str = "facebook") -> DataFrame:
    """A13 (assumed rule): share of a seller's recent listings that repeat title and description of another one.

    Counts combine per seller and content first, then per seller, so neither a busy seller nor a much copied text
    ever meets in one task. Flags that are allowlisted or set by hand stay as they are.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    oldest = F.timestamp_add("DAY", F.lit(-window_days), now)
    marks = moderation.select(F.col("listing_id").alias("id"), "seller_name_override")
    recent = listings.filter(
        (F.col("platform") == platform) & (F.col("first_fetched_at") >= oldest) & (F.col("first_fetched_at") <= now)
    ).join(marks, "id", "left")
    named = recent.select(
        normalize_seller_name(effective_seller()).alias("normalized_seller_name"),
        F.sha2(F.concat_ws("\x00", normalize_listing_content(F.col("title")),
                           normalize_listing_content(F.col("description"))), 256).alias("_content"),
    ).filter(F.coalesce("normalized_seller_name", F.lit("")) != "")
    per_text = named.groupBy("normalized_seller_name", "_content").agg(F.count(F.lit(1)).alias("_n"))
    stats = per_text.groupBy("normalized_seller_name").agg(
        F.sum("_n").alias("recent_listing_count"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("duplicate_listing_count"))
    scored = stats.withColumn(
        "duplicate_ratio", F.bround(F.col("duplicate_listing_count") / F.col("recent_listing_count"), 4))
    hit = ((F.col("recent_listing_count") >= min_listings) & (F.col("duplicate_listing_count") >= min_duplicates)
           & (F.col("duplicate_listing_count") / F.col("recent_listing_count") >= min_ratio))
    kept = flags.filter((F.col("platform") == platform) & (
        (F.col("status") == "allowlisted") | (F.col("source") == "manual"))).select("normalized_seller_name").distinct()
    status = F.lit("blocked" if auto_block else "review")
    return scored.withColumn("flagged", hit).join(
        kept.withColumn("_kept", F.lit(True)), "normalized_seller_name", "left").select(
        F.lit(platform).alias("platform"), "normalized_seller_name", "recent_listing_count", "duplicate_listing_count",
        "duplicate_ratio", (F.col("flagged") & F.col("_kept").isNull()).alias("flagged"),
        F.when(F.col("flagged") & F.col("_kept").isNull(), status).alias("new_status"))

