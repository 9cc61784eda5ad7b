"""Extraction from platform JSON.

Where a field lies in a payload is stated in tables of paths, which one reader applies to the objects of a text inside
the tasks. It yields texts; types, clean-up and everything across payloads (first wins, merge, order, limits) are Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lapak.functions.once import computed
from lapak.functions.text import or_blank
from lapak.functions.urls import group_permalink, html_unescape, is_reddit_image, reddit_image_url, url_host
from lapak.operators.relevance import select_first
from lapak.schemas import CARD, COMMERCE_FIELDS, GROUP_RECORD, PROFILE_RECORD
from lapak.sources.payloads import at, first_text, parsed, parsed_all, record, walk

# Where the platforms put each field. Later paths stand in for earlier ones.
CARD_EDGES = "marketplace_search.feed_units.edges.*.node"
CARD_FIELDS = {
    "item_id": ("id",), "title": ("marketplace_listing_title", "custom_title"),
    "price": ("listing_price.formatted_amount",), "price_amount": ("listing_price.amount",),
    "location": ("location.reverse_geocode.city_page.display_name",), "image_url": ("primary_listing_photo.image.uri",),
    "seller_name": ("marketplace_listing_seller.name", "marketplace_listing_seller.display_name"),
    "is_live": ("is_live",), "is_sold": ("is_sold",), "is_pending": ("is_pending",), "is_hidden": ("is_hidden",),
}
JUST_LISTED = "if_gk_just_listed_tag_on_search_feed"
STORY_MARKS = (
    "message", "actors", "target_group", "attachments", "attached_story", "comet_sections", "permalink_url", "wwwURL",
)
MESSAGE = ("message", "message.text", "message.text.text")
PHOTO = tuple(f"{holder}.{key}" for holder in ("image", "viewer_image", "photo_image") for key in ("uri", "url"))
COMMERCE = {
    "product_id": ("id", "product_item.id"), "formatted_price": ("formatted_price", "formatted_price.text"),
    "location_text": ("location_text", "location_text.text"), "seller_id": ("marketplace_listing_seller.id",),
    "seller_name": ("marketplace_listing_seller.name",),
}
LINKS = ("permalink_url", "url", "wwwURL")
TIMES = ("creation_time", "publish_time")
TIMELINES = tuple(f"{name}.edges.*.node" for name in (
    "polaris_ordered_timeline_connection", "edge_owner_to_timeline_media"))
PICTURE = ("display_uri", "display_url", "thumbnail_src", "image_versions2.candidates.*.url")
POST_FIELDS = {
    "shortcode": ("code", "shortcode"), "pk": ("pk", "id"), "taken_at": ("taken_at", "taken_at_timestamp"),
    "caption": ("caption.text", "edge_media_to_caption.edges.0.node.text"), "display_url": PICTURE,
    "thumbnail_src": ("thumbnail_src",), "media_count": ("carousel_media_count",), "media_type": ("media_type",),
    "product_type": ("product_type",),
}
CHILDREN = ("carousel_media.*", "edge_sidecar_to_children.edges.*.node")


def _typed(name: str, kind: T.DataType) -> Column:
    """Column of a field from its text: whole numbers and booleans are read, nothing else is."""
    text = F.col(name)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return F.when(text.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?$"), text.try_cast("decimal(38,6)").cast(kind)).alias(name)
    if isinstance(kind, T.BooleanType):
        return F.when(text == "True", True).when(text == "False", False).alias(name)
    return (or_blank(text) if isinstance(kind, T.StringType) else text).alias(name)


PAYLOADS, RECORDS = 128, 1024  # payloads and records that a task holds as Python objects at once


def _emit(payloads: DataFrame, reader, schema: T.StructType, columns=("page_id", "script_index", "text")) -> DataFrame:
    """Run ``reader(text) -> records of texts`` over each payload; records keep their place inside the payload.

    Texts stay in Arrow until their turn comes and records go back to Arrow in small batches, so what a task holds does
    not follow the number of payloads in a batch.
    """
    keys = [c for c in columns if c != "text"]
    scalar = (T.LongType, T.IntegerType, T.BooleanType)
    raw = T.StructType(
        [f for f in payloads.schema.fields if f.name in keys] + [T.StructField("place", T.IntegerType())]
        + [T.StructField(f.name, T.StringType() if isinstance(f.dataType, scalar) else f.dataType) for f in schema.fields])
    fields, arrow = schema.fieldNames(), to_arrow_schema(raw)
    order = [f.name for f in raw.fields if f.name in keys]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, PAYLOADS):
                part = batch.slice(start, PAYLOADS)
                for *given, text in zip(*(part.column(c).to_pylist() for c in (*order, "text"))):
                    for place, found in enumerate(reader(text)):
                        rows.append((*given, place, *map(found.get, fields)))
                        if len(rows) >= RECORDS:
                            yield made(rows)
                            rows.clear()
        if rows:
            yield made(rows)

    return payloads.select(*columns).mapInArrow(run, raw).select(
        *keys, "place", *[_typed(f.name, f.dataType) for f in schema.fields])


# Marketplace -------------------------------------------------------------------------------------------------------

def _cards(text: str):
    for found in walk(parsed(text)):
        for node in at(found, CARD_EDGES):
            inner = [x for x in at(node, "listing") if isinstance(x, dict)]
            card = record((inner or [node])[0], CARD_FIELDS)
            if card["item_id"] and card["title"]:
                listed = any(map(bool, at((inner or [node])[0], JUST_LISTED)))
                yield {**card, "is_newly_listed": str(listed)}


def _complete_cards(found: DataFrame) -> DataFrame:
    """Columns of a card that follow from the others."""
    lines = F.array("price", "title", "location")
    return found.withColumns({
        "url": F.concat(F.lit("https://www.facebook.com/marketplace/item/"), "item_id", F.lit("/")),
        "image_alt": F.col("title"), "raw_text": F.array_join(F.filter(lines, lambda x: x != ""), "\n")})


def _first_cards(limit: int | None):
    """Reader of the first card per item id of a payload, of its first ``limit`` items: no other can be among those of
    its page, as each of these stands before it."""
    def read(text: str):
        seen: set[str] = set()
        for card in _cards(text):
            if card["item_id"] not in seen:
                seen.add(card["item_id"])
                yield card
                if len(seen) == limit:
                    return

    return read


def extract_marketplace(payloads: DataFrame, limit: int | None = None) -> DataFrame:
    """Search cards of each page, first card per item id, at most ``limit`` per page."""
    found = _complete_cards(_emit(payloads, _first_cards(limit), CARD))
    if limit is not None:
        # A page has few cards now, so one shuffle serves both windows.
        found = found.repartition("page_id")
    order = Window.partitionBy("page_id", "item_id").orderBy("script_index", "place")
    first = found.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    if limit is None:
        return first
    return select_first(first.withColumn("_seq", F.struct("script_index", "place")), "page_id", "_seq", limit).drop(
        "_seq")


# Group posts -------------------------------------------------------------------------------------------------------

# What a story may consist of, as the reader meets it. ``inner`` marks what stands in the attached story, ``depth`` is 0
# for the story object itself; ``urls`` are the addresses of a photo where they belong, ``nested`` those further inside.
_PART = T.StructType(
    [T.StructField("inner", T.BooleanType()), T.StructField("kind", T.StringType()), T.StructField("depth", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("text", "name")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("urls", "nested")]
    + [T.StructField(n, T.StringType()) for n in COMMERCE_FIELDS])
_STORY = T.StructType([T.StructField("post_id", T.StringType()), T.StructField("group_id", T.StringType()),
                       T.StructField("parts", T.ArrayType(_PART))])
_TEXTS = (("message", MESSAGE, (str,)), ("link", LINKS, (str,)), ("time", TIMES, (str, int, float)))


def _parts(story: Any, inner: bool) -> Iterator[dict]:
    """Everything in a story that a rule may choose from, in the order of the walk and without the attached story."""
    for depth, found in enumerate(walk(story, skip=("attached_story",))):
        part = {**dict.fromkeys(_PART.fieldNames()), "inner": inner, "depth": min(depth, 1)}
        for kind, paths, kinds in _TEXTS:
            texts = (first_text(found, (path,), kinds) for path in paths)
            yield from ({**part, "kind": kind, "text": t} for t in texts if t)
        for actor in at(found, "actors.*"):
            yield {**part, "kind": "actor", "text": first_text(actor, ("id",)), "name": first_text(actor, ("name",))}
        for media in at(found, "attachments"):
            for photo in (p for p in walk(media) if p.get("__typename") == "Photo"):
                urls = [first_text(photo, (path,), (str,)) for path in PHOTO]
                yield {**part, "kind": "photo", "name": first_text(photo, ("accessibility_caption",)),
                       "urls": [u for u in urls if u], "nested": [u for u in (first_text(p, ("uri",), (str,)) for p in walk(photo)) if u]}
        if found.get("__typename") == "GroupCommerceProductItem":
            yield {**part, "kind": "product", **record(found, COMMERCE)}


def _stories(text: str):
    """Stories of a payload with their parts. An attached story is no story of its own."""
    for story in (s for payload in parsed_all(text) for s in walk(payload, skip=("attached_story",))):
        names = {name: first_text(story, (path,)) for name, path in (("post_id", "post_id"), ("group_id", "target_group.id"))}
        if all(names.values()) and any(mark in story for mark in STORY_MARKS):
            attached = next((o["attached_story"] for o in walk(story) if isinstance(o.get("attached_story"), dict)), None)
            yield {**names, "parts": [*_parts(story, False), *(_parts(attached, True) if attached else ())]}


def _photo(part: Column) -> Column:
    """Address and caption of a photo part: the first safe one in place, else the first of the image servers."""
    safe = F.filter(part["urls"], lambda u: u.startswith("https://"))
    hosted = F.filter(part["nested"], lambda u: u.startswith("https://") & F.contains(url_host(u), F.lit("fbcdn")))
    return F.struct(or_blank(F.coalesce(F.get(safe, 0), F.get(hosted, 0))).alias("url"), or_blank(part["name"]).alias("alt"))


def group_records(payloads: DataFrame) -> DataFrame:
    """X2 first half: every story of the payloads as a flat record with its place.

    The reader lists the parts of a story; which of them counts is decided here. The attached story stands in where the
    story itself has no message, photo, actor or product.
    """
    found = _emit(payloads, _stories, _STORY)
    parts = lambda kind, inner: F.filter("parts", lambda p: (p["kind"] == kind) & (p["inner"] == inner))
    first = lambda rows: F.get(rows, 0)
    split = computed(found, **{f"_{kind}{int(inner)}": parts(kind, inner) for kind in ("message", "photo", "actor", "product")
                               for inner in (False, True)}, _link=parts("link", False), _time=parts("time", False))
    named = lambda kind: F.filter(kind, lambda p: F.coalesce(p["text"], p["name"]).isNotNull())
    photos = lambda c: F.filter(F.transform(c, _photo), lambda p: p["url"] != "")
    ready = computed(split, _own=photos("_photo0"), _far=photos("_photo1"), _person=F.coalesce(
        first(named("_actor0")), first(named("_actor1"))), _sold=F.coalesce(first("_product0"), first("_product1")))
    in_group = lambda p: p["text"].startswith("https://") & F.contains(p["text"], F.lit("/groups/"))
    link = F.coalesce(first(F.filter("_link", lambda p: (p["depth"] == 0) & in_group(p))),
                      first(F.filter("_link", lambda p: in_group(p) & F.contains(p["text"], F.lit("/posts/")))))
    time = F.filter(F.transform("_time", lambda p: F.when(p["text"].rlike("^[0-9]+$"), p["text"].try_cast("bigint"))), lambda n: n > 0)
    borrows = lambda own, far: (F.size(own) == 0) & (F.size(far) > 0)
    images = F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.col("_far"))
    distinct = F.filter(images, lambda p, k: F.array_position(F.transform(images, lambda q: q["url"]), p["url"]) == k + 1)
    columns = {
        "permalink": group_permalink(or_blank(link["text"])),
        "message": or_blank(F.coalesce(first("_message0"), first("_message1"))["text"]),
        "seller_id": or_blank(F.col("_person.text")), "seller_name": or_blank(F.col("_person.name")),
        "published_timestamp": F.coalesce(first(time), F.lit(0).cast("bigint")), "images": distinct,
        "commerce": F.struct(*[F.when(F.col("_sold").isNotNull(), or_blank(F.col(f"_sold.{f}"))).alias(f) for f in COMMERCE_FIELDS]),
        "used_attached_story": borrows("_message0", "_message1") | borrows("_own", "_far"),
    }
    return computed(ready, **columns).select("page_id", "script_index", "place", *GROUP_RECORD.fieldNames())


def _first_filled(column: str, seq: Column) -> Column:
    filled = or_blank(F.col(column)) != ""
    return F.coalesce(F.min_by(F.when(filled, F.col(column)), F.when(filled, seq)), F.lit(""))


def _last_known(column: Column, seq: Column) -> Column:
    return F.max_by(column, F.when(column.isNotNull(), seq))


def merge_group_records(records: DataFrame, key: str = "post_id", seq: str = "seq") -> DataFrame:
    """One record per post: first filled texts, newest time, later commerce values, distinct images in order.

    Texts merge in one partial aggregation. Images are made distinct per (post, URL) before they are collected, so
    many captures of one post add nothing to the array.
    """
    at = F.col(seq)
    merged = records.groupBy(key).agg(
        *[_first_filled(c, at).alias(c) for c in ("permalink", "message", "seller_id", "seller_name")],
        F.min_by("group_id", at).alias("group_id"),
        F.max(F.coalesce("published_timestamp", F.lit(0))).alias("published_timestamp"),
        F.bool_or(F.coalesce("used_attached_story", F.lit(False))).alias("used_attached_story"),
        F.struct(*[_last_known(F.col(f"commerce.{f}"), at).alias(f) for f in COMMERCE_FIELDS]).alias("commerce"),
    )
    each = records.select(key, at.alias("_seq"), F.posexplode("images").alias("_pos", "_i"))
    each = each.select(key, "_seq", "_pos", F.trim("_i.url").alias("url"), F.trim(or_blank(F.col("_i.alt"))).alias("alt"))
    distinct = each.filter(or_blank(F.col("url")) != "").groupBy(key, "url").agg(
        F.min(F.struct("_seq", "_pos", "alt")).alias("_at"))
    images = distinct.groupBy(key).agg(F.transform(
        F.sort_array(F.collect_list(F.struct(F.col("_at._seq"), F.col("_at._pos"), "url", F.col("_at.alt").alias("alt")))),
        lambda x: F.struct(x["url"].alias("url"), x["alt"].alias("alt"))).alias("images"))
    empty = F.array().cast("array<struct<url:string,alt:string>>")
    return merged.join(images, key, "left").withColumn("images", F.coalesce("images", empty))


def extract_group_posts(payloads: DataFrame, targets: DataFrame, limit: int = 3) -> DataFrame:
    """Newest posts of each wanted group. ``targets`` has group_id."""
    wanted = group_records(payloads).join(targets.select("group_id").distinct(), "group_id", "left_semi")
    sequenced = wanted.withColumn("seq", F.struct("page_id", "script_index", "place"))
    keyed = sequenced.withColumn("_key", F.concat_ws(":", "group_id", "post_id"))
    merged = merge_group_records(keyed, "_key").withColumn("post_id", F.substring_index("_key", ":", -1))
    newest = F.row_number().over(Window.partitionBy("group_id").orderBy(
        F.col("published_timestamp").desc(), F.col("post_id").desc()))
    return merged.withColumn("place", newest).filter(F.col("place") <= max(1, limit)).drop("_key")


# Profile posts -----------------------------------------------------------------------------------------------------

def _post(node: dict) -> dict | None:
    post = record(node, POST_FIELDS)
    if not post["shortcode"]:
        return None
    shown = ([first_text(child, PICTURE, (str,)) for child in at(node, path)] for path in CHILDREN)
    return {**post, "taken_at": post["taken_at"] or "0",
            "children": next((urls for urls in ([u for u in s if u] for s in shown) if urls), [])}


def _timeline_posts(text: str):
    nodes = (n for found in walk(parsed(text)) for path in TIMELINES for n in at(found, path) if isinstance(n, dict))
    yield from filter(None, map(_post, nodes))


def _all_posts(text: str):
    yield from filter(None, map(_post, walk(parsed(text))))


def merge_posts(records: DataFrame, keys=("shortcode",), seq: str = "seq") -> DataFrame:
    """One post per key: gaps filled from later records, largest time and pk, first caption, distinct children."""
    keys = list(keys)
    at = F.col(seq)
    whole = F.coalesce(F.col("pk").try_cast("bigint"), F.lit(0))
    merged = records.groupBy(*keys).agg(
        *[_first_filled(c, at).alias(c) for c in ("caption", "display_url", "thumbnail_src", "product_type")],
        F.max("taken_at").alias("taken_at"),
        F.max(whole).alias("_pk"), _first_filled("pk", at).alias("_first_pk"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in ("media_count", "media_type")])
    merged = merged.withColumn("pk", F.when(F.col("_pk") > 0, F.col("_pk").cast("string")).otherwise(
        F.col("_first_pk"))).drop("_pk", "_first_pk")
    each = records.select(*keys, at.alias("_seq"), F.posexplode("children").alias("_pos", "url"))
    distinct = each.groupBy(*keys, "url").agg(F.min(F.struct("_seq", "_pos")).alias("_at"))
    children = distinct.groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_at", "url"))), lambda x: x["url"]).alias("children"))
    return merged.join(children, keys, "left").withColumn(
        "children", F.coalesce("children", F.array().cast("array<string>")))


def extract_profile_posts(payloads: DataFrame) -> DataFrame:
    """Merged timeline posts with their place in the profile order (has time, time, pk, all descending).

    The place is per page; ties go by shortcode.
    """
    found = _emit(payloads, _timeline_posts, PROFILE_RECORD).withColumn("seq", F.struct("script_index", "place"))
    merged = merge_posts(found, ("page_id", "shortcode"))
    order = [F.col("taken_at").desc(), F.coalesce(F.col("pk").try_cast("bigint"), F.lit(0)).desc(), F.col("shortcode")]
    return merged.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)))


def extract_post_detail(payloads: DataFrame, shortcodes: DataFrame) -> DataFrame:
    """The richest object of the wanted post on each page. ``shortcodes``: page_id, shortcode."""
    found = _emit(payloads, _all_posts, PROFILE_RECORD).withColumn("seq", F.struct("script_index", "place"))
    wanted = found.join(shortcodes.select("page_id", F.trim("shortcode").alias("shortcode")),
                        ["page_id", "shortcode"], "left_semi")
    return merge_posts(wanted, ("page_id", "shortcode"))


# Galleries ---------------------------------------------------------------------------------------------------------

_IMAGE = "struct<status: string, m: string, s: struct<u: string, gif: string>, p: array<struct<x: string, y: string, u: string>>>"
_POST = (f"struct<id: string, gallery_data: struct<items: array<struct<media_id: string>>>, media_metadata: map<string, {_IMAGE}>, "
         "preview: struct<images: array<struct<source: struct<url: string>>>>, url_overridden_by_dest: string, url: string>")
_POSTS = f"array<struct<data: struct<children: array<struct<data: {_POST}>>>>>"


def _image_urls(image: Column) -> Column:
    """URLs of one gallery image: the source, its animation, and the largest preview; none if it is not a valid image."""
    usable = (or_blank(image["status"]).isin("", "valid")) & ((or_blank(image["m"]) == "") | image["m"].startswith("image/"))
    size = lambda p, c: F.coalesce(p[c].try_cast("double"), F.lit(0.0))
    largest = F.array_max(F.transform(image["p"], lambda p, i: F.struct(size(p, "x") * size(p, "y"), -i, p["u"].alias("u"))))
    none = F.array().cast("array<string>")
    return F.when(usable, F.array_compact(F.array(image["s"]["u"], image["s"]["gif"], largest["u"]))).otherwise(none)


def gallery_images(payloads: DataFrame) -> DataFrame:
    """X11: image rows of each post payload: page_id, position, url. Gallery order, distinct by canonical URL.

    Gallery media come in gallery order, or as the metadata lists them, then previews, then the link of the post.
    """
    posts = computed(payloads.select("page_id", "script_index", "text"), _p=F.from_json(F.col("text"), _POSTS)).select(
        "page_id", "script_index", F.get(F.filter(F.transform(F.get("_p", 0)["data"]["children"], lambda c: c["data"]),
                                                  lambda d: or_blank(d["id"]) != ""), 0).alias("post"))
    post, none = F.col("post"), F.array().cast("array<string>")
    listed = F.filter(F.transform(post["gallery_data"]["items"], lambda i: i["media_id"]), lambda m: or_blank(m) != "")
    names = F.when(F.size(F.coalesce(listed, none)) > 0, listed).otherwise(F.map_keys(post["media_metadata"]))
    media = F.flatten(F.transform(names, lambda n: F.coalesce(_image_urls(F.try_element_at(post["media_metadata"], n)), none)))
    previews = F.array_compact(F.transform(post["preview"]["images"], lambda i: i["source"]["url"]))
    urls = F.concat(*[F.coalesce(c, none) for c in (media, previews)],
                    F.array_compact(F.array(post["url_overridden_by_dest"], post["url"])))
    found = posts.select("page_id", "script_index", F.posexplode(urls).alias("place", "url"))
    rows = found.withColumn("url", reddit_image_url(html_unescape(F.col("url")), unescaped=True))
    usable = rows.filter((F.col("url") != "") & is_reddit_image(F.col("url")))
    first = usable.groupBy("page_id", "url").agg(F.min(F.struct("script_index", "place")).alias("_at"))
    order = Window.partitionBy("page_id").orderBy("_at")
    return first.select("page_id", (F.row_number().over(order) - 1).alias("position"), "url")


