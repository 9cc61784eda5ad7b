"""Public visibility (P1) and the joins it is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapak.functions.text import normalize_listing_content, normalize_seller_name
from lapak.functions.values import effective_seller
from lapak.schemas import FACEBOOK_PLATFORMS, PLATFORMS


def with_moderation(listings: DataFrame, moderation: DataFrame, controls: DataFrame) -> DataFrame:
    """Moderation by listing id and the platform switch.

    Only rows of known platforms count, one each, so the broadcast side has at most four rows.
    """
    switches = controls.select("platform", "public_visible").filter(
        F.col("platform").isin(*PLATFORMS)).dropDuplicates(["platform"])
    marks = moderation.select(F.col("listing_id").alias("id"), "hidden", "seller_name_override")
    return listings.join(F.broadcast(switches), "platform", "left").join(marks, "id", "left")


def content_key(platform: Column, text: Column) -> list[Column]:
    """128 bits that stand for a platform and a normalized text. A missing text has no key."""
    value = normalize_listing_content(text)
    return [F.when(value.isNotNull(), F.xxhash64(F.lit(k), platform, value)) for k in (1, 2)]


def with_content_keys(rows: DataFrame) -> DataFrame:
    """Rows with the keys of their title and description. Made before the first join, so no text is shuffled for it."""
    made = {f"_{field}{k}": key for field in ("title", "description")
            for k, key in enumerate(content_key(F.col("platform"), F.col(field)))}
    return rows.withColumns(made)


def without_blocked_content(rows: DataFrame, blocks: DataFrame, field: str) -> DataFrame:
    """Drop rows whose title or description is blocked on their platform.

    Texts are compared by 128-bit keys, so what is sorted and sent is narrow however long a text is. The block list is
    joined by size: Spark broadcasts it below the size threshold and otherwise sorts and merges, where adaptive
    execution splits a hot title into several tasks.
    """
    keys = [f"_{field}0", f"_{field}1"]
    value = F.col("normalized_value")
    listed = blocks.filter(F.col("field") == field).select(
        *[F.xxhash64(F.lit(k + 1), F.col("platform"), value).alias(name) for k, name in enumerate(keys)]).distinct()
    own = rows if keys[0] in rows.columns else with_content_keys(rows)
    return own.join(listed, keys, "left_anti").select(*[c for c in rows.columns])


def without_blocked_sellers(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Drop Facebook rows of a blocked seller on the same platform; a missing seller stays visible.

    ``rows`` must carry ``seller_name_override``. The flag side is cut to blocked Facebook flags first, so other
    platforms simply never match.
    """
    blocked = (
        flags.filter((F.col("status") == "blocked") & F.col("platform").isin(*FACEBOOK_PLATFORMS))
        .select("platform", F.col("normalized_seller_name").alias("_seller")).distinct()
    )
    keyed = rows.withColumn("_seller", normalize_seller_name(effective_seller()))
    return keyed.join(blocked, ["platform", "_seller"], "left_anti").drop("_seller")


def visible_listings(listings: DataFrame, moderation: DataFrame, controls: DataFrame, blocks: DataFrame,
                     flags: DataFrame, check_sellers: bool = True) -> DataFrame:
    """Listings the public may see, with the seller override kept for later use.

    ``check_sellers=False`` gives the variant of the reconciliation job that has no seller rule.
    """
    rows = with_moderation(with_content_keys(listings), moderation, controls)
    rows = rows.filter(
        F.coalesce(F.col("public_visible"), F.lit(True)) & ~F.coalesce(F.col("hidden"), F.lit(False))
    ).drop("public_visible", "hidden")
    rows = without_blocked_content(rows, blocks, "title")
    rows = without_blocked_content(rows, blocks, "description").drop(*[f"_{c}{k}" for c in ("title", "description") for k in (0, 1)])
    return without_blocked_sellers(rows, flags) if check_sellers else rows


def visibility_columns(listings: DataFrame, moderation: DataFrame, controls: DataFrame, images: DataFrame) -> DataFrame:
    """The scalar lookups of a listing (override, hidden, switch, image count) as left joins."""
    counts = images.groupBy(F.col("listing_id").alias("id")).agg(F.count(F.lit(1)).alias("image_count"))
    return (
        with_moderation(listings, moderation, controls)
        .join(counts, "id", "left")
        .withColumn("image_count", F.coalesce("image_count", F.lit(0).cast("bigint")))
        .withColumn("hidden", F.coalesce("hidden", F.lit(False)))
        .withColumn("public_visible", F.coalesce("public_visible", F.lit(True)))
    )
