"""Platform records to the connector contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapak.functions.text import SOLD_LABELS, blank_to_null, lines, listing_title, normalize_spaces, or_blank, strip
from lapak.functions.urls import group_permalink_fallback, html_unescape, marketplace_url, reddit_id, reddit_url
from lapak.functions.values import iso_millis, parse_iso, parse_posted_at
from lapak.schemas import CONTRACT_COLUMNS



def _image_rows(urls: Column, alt: Column) -> Column:
    """URLs to positioned images; the array index is the position."""
    return F.transform(urls, lambda u, i: F.struct(
        u.alias("source_url"), i.cast("string").alias("position"), alt.alias("alt_text")))


def _contract(rows: DataFrame, fetched_at: Column, facts: Column, **columns: Column) -> DataFrame:
    """Contract columns in order, as text; what a connector does not know is null. ``seq`` columns pass through."""
    at = iso_millis(fetched_at)
    none = F.lit(None).cast("string")
    filled = {
        "category": none, "brand": none, "price": none, "condition_text": none,
        "location_texts": F.array().cast("array<string>"), "first_fetched_at": at, "last_fetched_at": at, **columns,
    }
    extra = ["seq"] if "seq" in rows.columns else []
    return rows.select(*extra, *[filled[c].alias(c) for c in CONTRACT_COLUMNS], facts.alias("source_facts"))


def _facts(**values: Column) -> Column:
    pairs = [part for name, value in values.items() for part in (F.lit(name), value.cast("string"))]
    return F.create_map(*pairs)


def normalize_reddit(posts: DataFrame, fetched_at: Column) -> DataFrame:
    """Feed posts (url, atom_id, title, description, author, updated, flair, images)."""
    flair = strip(or_blank(F.col("flair")))
    low = F.lower(flair)
    status = F.when(low == "sold out", F.lit("SOLD")).when(low.startswith("wts:"), F.lit("AVAILABLE")).otherwise(
        F.lit("UNKNOWN"))
    return _contract(
        posts, fetched_at, _facts(currentFlair=F.nullif(flair, F.lit(""))), platform=F.lit("REDDIT"),
        source_url=reddit_url(F.col("url")), external_id=reddit_id(F.col("url"), F.col("atom_id")),
        title=strip(or_blank(F.col("title"))), description=strip(or_blank(F.col("description"))),
        seller_name=blank_to_null(F.col("author")), status=status,
        posted_at=iso_millis(parse_iso(F.col("updated"))),
        images=_image_rows(F.col("images"), F.nullif("title", F.lit(""))))


def instagram_images(display_url: Column, thumbnail: Column, children: Column) -> Column:
    """Cover, thumbnail and children as distinct URLs in that order."""
    return F.array_distinct(F.filter(F.concat(F.array(display_url, thumbnail), F.coalesce(
        children, F.array().cast("array<string>"))), lambda u: u.isNotNull() & (u != "")))


def normalize_instagram(posts: DataFrame, fetched_at: Column, account: Column) -> DataFrame:
    """Merged profile posts (shortcode, caption, taken_at, display_url, thumbnail_src, children)."""
    code = F.col("shortcode")
    taken = F.when(F.col("taken_at") != 0, F.timestamp_seconds("taken_at").cast("timestamp_ntz"))
    return _contract(
        posts, fetched_at, F.create_map().cast("map<string,string>"), platform=F.lit("INSTAGRAM"),
        source_url=F.concat(F.lit("https://www.instagram.com/p/"), code, F.lit("/")), external_id=code, title=code,
        description=strip(html_unescape(or_blank(F.col("caption")))), seller_name=account, status=F.lit("UNKNOWN"),
        posted_at=iso_millis(taken),
        images=_image_rows(instagram_images(F.col("display_url"), F.col("thumbnail_src"), F.col("children")), code))


def marketplace_status(is_sold: Column, is_live: Column, raw_text: Column) -> Column:
    """The sold flag or a sold label beats everything; available needs both flags; else unknown."""
    flat = F.transform(lines(or_blank(raw_text)), lambda x: F.lower(normalize_spaces(x)))
    label = F.exists(flat, lambda x: x.isin(*SOLD_LABELS) | x.rlike(r"(?U)(?:^|[·|])\s*habis$"))
    return (
        F.when(is_sold, F.lit("SOLD")).when(label, F.lit("SOLD"))
        .when(~is_sold & is_live, F.lit("AVAILABLE")).otherwise(F.lit("UNKNOWN"))
    )


def normalize_marketplace(cards: DataFrame, fetched_at: Column) -> DataFrame:
    """Cards joined with their detail columns (posted, condition, description, approx_location, seller).

    Detail columns may be null where no detail page was read.
    """
    c = F.col
    filled = lambda name: F.nullif(c(name), F.lit(""))
    posted = parse_posted_at(c("posted"), fetched_at)
    image = F.when(or_blank(c("image_url")) != "", F.array(F.struct(
        c("image_url").alias("source_url"), F.lit("0").alias("position"), filled("image_alt").alias("alt_text"))))
    return _contract(
        cards, fetched_at,
        _facts(priceText=c("price"), priceAmount=c("price_amount"), location=c("location"),
               condition=or_blank(c("condition")), approxLocation=or_blank(c("approx_location")), isLive=c("is_live"),
               isSold=c("is_sold"), isPending=c("is_pending"), isHidden=c("is_hidden")),
        platform=F.lit("FACEBOOK"), source_url=marketplace_url(c("item_id"), c("url")), external_id=c("item_id"),
        title=listing_title(c("title"), c("image_alt")), description=F.coalesce(filled("description"), c("raw_text")),
        seller_name=F.coalesce(filled("seller"), filled("seller_name")),
        status=marketplace_status(c("is_sold"), c("is_live"), c("raw_text")), posted_at=iso_millis(posted),
        images=F.coalesce(image, F.array().cast("array<struct<source_url:string,position:string,alt_text:string>>")))


def normalize_group_posts(posts: DataFrame, targets: DataFrame, fetched_at: Column) -> DataFrame:
    """Merged group posts that have text and images. ``targets``: group_id, group_name, group_url, sorting.

    Targets are a short configured list, joined by size.
    """
    c = F.col
    rows = posts.join(targets, "group_id").withColumn("message", strip(or_blank(c("message")))).filter(
        (c("message") != "") & (F.size("images") > 0))
    filled = lambda col: F.nullif(strip(or_blank(col)), F.lit(""))
    seller = F.coalesce(filled(c("seller_name")), filled(c("commerce.seller_name")))
    title = F.coalesce(F.try_element_at(lines(c("message")), F.lit(1)), F.concat(F.lit("Facebook post "), c("post_id")))
    secure = F.filter(
        F.transform("images", lambda im, i: F.struct(
            F.trim(im["url"]).alias("source_url"), i.cast("string").alias("position"),
            F.nullif(F.trim(or_blank(im["alt"])), F.lit("")).alias("alt_text"))),
        lambda im: im["source_url"].startswith("https://"))
    posted = F.when(c("published_timestamp") != 0, F.timestamp_seconds("published_timestamp").cast("timestamp_ntz"))
    return _contract(
        rows, fetched_at,
        _facts(sourceType=F.lit("facebook_group"), groupId=c("group_id"), groupName=c("group_name"),
               sortingSetting=c("sorting"), sellerId=F.coalesce(filled(c("seller_id")), filled(c("commerce.seller_id"))),
               sellerName=seller, formattedPrice=filled(c("commerce.formatted_price")),
               locationText=filled(c("commerce.location_text")), productId=filled(c("commerce.product_id")),
               usedAttachedStory=c("used_attached_story")),
        platform=F.lit("FACEBOOK_GROUP"),
        source_url=F.coalesce(filled(c("permalink")), group_permalink_fallback(c("group_url"), c("post_id"))),
        external_id=F.concat_ws(":", "group_id", "post_id"), title=F.left(title, F.lit(300)), description=c("message"),
        seller_name=seller, status=F.lit("UNKNOWN"), posted_at=iso_millis(posted), images=secure)
