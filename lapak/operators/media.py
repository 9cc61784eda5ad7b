"""Image cache work lists, galleries and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lapak.functions.once import computed
from lapak.functions.text import or_blank
from lapak.functions.urls import reddit_image_url, is_reddit_image
from lapak.functions.values import record_id


def images_with_owner(images: DataFrame, listings: DataFrame) -> DataFrame:
    """J8."""
    owners = listings.select(F.col("id").alias("listing_id"), "platform", "external_id", "first_fetched_at")
    return images.join(owners, "listing_id")


def pending_media(images: DataFrame, listings: DataFrame, as_of, after_id: str = "", limit: int | None = 25,
                  hours: int = 24) -> DataFrame:
    """Uncached images in id order; Marketplace images only while their listing is fresh. No limit means all."""
    oldest = F.timestamp_add("HOUR", F.lit(-hours), F.lit(as_of).cast("timestamp_ntz"))
    todo = images.filter(F.col("cached_url").isNull() & (F.col("id") > after_id)).select("id", "listing_id", "source_url")
    owners = listings.filter(
        F.col("platform").isin("instagram", "reddit", "facebook_group")
        | ((F.col("platform") == "facebook") & (F.col("first_fetched_at") >= oldest))
    ).select(F.col("id").alias("listing_id"), "platform")
    media_platform = F.when(F.col("platform") == "facebook_group", F.lit("facebook_groups")).otherwise(F.col("platform"))
    found = todo.join(owners, "listing_id").select("id", "source_url", media_platform.alias("media_platform")).orderBy("id")
    return found if limit is None else found.limit(limit)


def single_cover_groups(listings: DataFrame, images: DataFrame, since, after_id: str = "", limit: int = 50) -> DataFrame:
    """Instagram covers, grouped per listing and URL: one image with that URL, at position zero."""
    recent = listings.filter(
        (F.col("platform") == "instagram") & (F.col("first_fetched_at") >= F.lit(since).cast("timestamp_ntz"))
        & (F.col("id") > after_id)).select(F.col("id").alias("listing_id"), "external_id")
    groups = images.select("listing_id", "source_url", "position").join(recent, "listing_id").groupBy(
        "listing_id", "external_id", "source_url").agg(
        F.count(F.lit(1)).alias("_n"), F.min("position").alias("_first"))
    return groups.filter((F.col("_n") == 1) & (F.col("_first") == 0)).select(
        "listing_id", "external_id", "source_url").orderBy("listing_id", "source_url").limit(limit)


def media_summary(downloads: DataFrame, images: DataFrame, stored: DataFrame) -> DataFrame:
    """Outcome counts of a media batch.

    ``downloads``: id, storage_key (null when the download failed). An image cached meanwhile is skipped. A key that
    is already stored, or that an earlier image of the batch stored, counts as reused.
    """
    # Keys are long texts and are only compared, so 128 bits of each are moved and sorted.
    key = F.unhex(F.md5("storage_key")).alias("_key")
    state = images.select("id", F.col("cached_url").isNotNull().alias("_done"))
    asked = downloads.select("id", key)
    known = stored.select(key, F.lit(True).alias("_known")).distinct()
    first = asked.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("id").alias("_first"))
    rows = asked.join(state, "id", "left").join(known, "_key", "left").join(first, "_key", "left")
    failed = F.col("_key").isNull()
    skipped = ~failed & F.coalesce("_done", F.lit(True))
    updated = ~failed & ~F.coalesce("_done", F.lit(True))
    reused = updated & (F.col("_known").isNotNull() | (F.col("id") != F.col("_first")))
    return rows.agg(
        F.count(F.lit(1)).alias("selected"), F.count_if(updated).alias("updated"),
        F.count_if(updated & ~reused).alias("cached"), F.count_if(reused).alias("reused"),
        F.count_if(failed).alias("failed"), F.count_if(skipped).alias("skipped"))


def listing_page_images(listings: DataFrame, images: DataFrame, after_id: str = "", limit: int = 25) -> DataFrame:
    """A page of ``limit`` listings with their images."""
    page = listings.filter(F.col("id") > after_id).orderBy("id").limit(limit).select(
        F.col("id").alias("listing_id"), F.col("source_url").alias("listing_url"), "title")
    theirs = images.select("listing_id", "source_url", "position").join(
        page.select("listing_id"), "listing_id", "left_semi")
    return page.join(theirs, "listing_id", "left")


def canonicalize_gallery(listings: DataFrame, images: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class per listing, rewritten image rows) of the Reddit gallery repair.

    Stored canonical URLs are kept; fetched ones only help listings without any stored image. A gallery is unchanged
    when every stored URL is already canonical and distinct, which counts decide, so no gallery is built as an array.
    Repeated captures combine per (listing, URL) before anything is ranked.
    """
    base = listings.filter(F.col("platform") == "reddit").select(F.col("id").alias("listing_id"), "title")
    columns = ["listing_id", "position", "source_url"]
    both = images.select(F.lit(True).alias("stored"), *columns).unionByName(
        fetched.select(F.lit(False).alias("stored"), *columns)).filter(or_blank(F.col("source_url")) != "")
    canonical = computed(both, _u=reddit_image_url(F.col("source_url"), unescaped=True))
    url = F.when((F.col("_u") != "") & is_reddit_image(F.col("_u")), F.col("_u"))
    per_url = canonical.withColumn("url", url).groupBy("listing_id", "stored", "url").agg(
        F.min("position").alias("place"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("url") == F.col("source_url")).alias("same")).join(
        base.select("listing_id"), "listing_id", "left_semi")
    own, usable = F.col("stored"), F.col("url").isNotNull()
    sides = per_url.groupBy("listing_id").agg(
        F.sum(F.when(own, F.col("n"))).alias("n_own"), F.sum(F.when(own, F.col("same"))).alias("n_same"),
        F.count_if(own & usable).alias("n_kept"), F.count_if(~own & usable).alias("n_help"))
    kind = (
        F.when(F.col("n_own").isNull() & (F.coalesce("n_help", F.lit(0)) > 0), F.lit("recovered"))
        .when(F.coalesce("n_kept", F.lit(0)) == 0, F.lit("missing"))
        .when((F.col("n_own") == F.col("n_same")) & (F.col("n_own") == F.col("n_kept")), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    classes = base.join(sides, "listing_id", "left").select("listing_id", "title", kind.alias("kind"))
    wanted = per_url.filter(usable).join(classes.filter(F.col("kind").isin("changed", "recovered")), "listing_id").filter(
        own | (F.col("kind") == "recovered"))
    order = Window.partitionBy("listing_id").orderBy("place")
    rewritten = wanted.withColumn("position", F.row_number().over(order) - 1).select(
        "listing_id", F.col("url").alias("source_url"), "position",
        F.concat("title", F.lit(" image "), (F.col("position") + 1).cast("string")).alias("alt_text"))
    return classes.select("listing_id", "kind"), rewritten


def additional_image_rows(pending: DataFrame, details: DataFrame, images: DataFrame) -> DataFrame:
    """Children from position one for listings whose detail has the same id and at least two URLs.

    ``pending``: listing_id, external_id. ``details``: shortcode, urls (array in order). Existing positions stay.
    """
    matched = pending.join(details, F.trim(details["shortcode"]) == pending["external_id"]).filter(F.size("urls") >= 2)
    children = matched.select("listing_id", "external_id", F.posexplode("urls").alias("position", "source_url")).filter(
        F.col("position") >= 1)
    absent = children.join(images.select("listing_id", "position"), ["listing_id", "position"], "left_anti")
    return absent.select(
        record_id(F.concat_ws(":", "listing_id", F.col("position").cast("string"))).alias("id"), "listing_id",
        "source_url", "position", F.col("external_id").alias("alt_text"))


def expected_image_count():
    """Image count a carousel should have, zero when it is not a carousel."""
    from lapak.functions.values import blank_integer

    count = blank_integer(F.col("media_count"))
    kind = blank_integer(F.col("media_type"))
    container = F.lower(F.trim(or_blank(F.col("product_type")))) == "carousel_container"
    return F.when(count >= 2, count).when((kind == 8) | container, F.lit(2)).otherwise(F.lit(0)).cast("bigint")


def carousel_completeness(posts: DataFrame, cache: DataFrame, details: DataFrame) -> DataFrame:
    """First complete source of a carousel's images: own, cached, detail; incomplete ones keep what they have.

    ``posts``: shortcode, urls, media_count, media_type, product_type; ``cache`` and ``details``: shortcode, urls.
    """
    valid = F.array_distinct(F.filter(F.transform("urls", F.trim), lambda u: u.startswith("https://")))
    stored = cache.select("shortcode", valid.alias("_cached"))
    fetched = details.select("shortcode", F.col("urls").alias("_detail"))
    rows = posts.join(stored, "shortcode", "left").join(fetched, "shortcode", "left").withColumn(
        "expected", expected_image_count())
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    enough = lambda c: size(c) >= F.col("expected")
    source = (
        F.when(F.col("expected") < 2, F.lit("not_carousel"))
        .when(enough("urls"), F.lit("current"))
        .when(enough("_cached"), F.lit("cache"))
        .when(enough("_detail"), F.lit("detail"))
        .when(size("_detail") > 0, F.lit("merged"))
        .otherwise(F.lit("incomplete"))
    )
    chosen = (
        F.when(F.col("source") == "cache", F.col("_cached")).when(F.col("source") == "detail", F.col("_detail"))
        .when(F.col("source") == "merged", F.array_distinct(F.concat("urls", "_detail"))).otherwise(F.col("urls"))
    )
    return rows.withColumn("source", source).select("shortcode", "expected", "source", chosen.alias("urls"))


def merge_detail_images(posts: DataFrame, details: DataFrame) -> DataFrame:
    """Detail images before feed images, canonical and distinct; without usable URLs the post stays as it is."""
    from lapak.functions.urls import unique_image_urls

    rows = posts.join(details.select("post_id", F.col("images").alias("_detail")), "post_id", "left")
    merged = unique_image_urls(F.concat("_detail", F.coalesce("images", F.array().cast("array<string>"))))
    return rows.withColumn("images", F.when(F.size(F.coalesce(merged, F.array().cast("array<string>"))) > 0, merged)
                           .otherwise(F.col("images"))).drop("_detail")
