"""Feed, visibility, facets and public shape: P1-P11, P18, J1-J6, J10, O1-O5, A1-A5, A21, W1, N19, SRC1."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lapak.functions import text, values
from lapak.operators import dto, facets, feed, quality, visibility
from lapak.plans.registry import query
from lapak.plans.views import norm_sql

_JS_PLACE = r"(?i)\b(?:harga|price|link|oren|cod|ongkir|kirim|ready|stok|stock|bekas|second|nego|wa|dm)\b"
_CONDITION_SQL = r"(?i)^(?:Baru(?:\s*/\s*BNIB)?|BNIB|Like New|Second|Bekas(?:\s*-\s*(?:baik|normal|minus))?)$"


def join_list(column: str):
    return F.array_join(column, "|")


@query("p1_visible_listings", "SELECT id, platform, seller_name_override FROM v_visible")
def _(t):
    return t.visible.select("id", "platform", "seller_name_override")


@query("p1_visible_without_seller_rule", f"""
    SELECT l.id FROM v_listings l LEFT JOIN v_moderation m ON m.listing_id = l.id
    WHERE NOT coalesce(m.hidden, FALSE) AND l.platform <> 'instagram'
      AND NOT EXISTS (SELECT 1 FROM v_blocks b WHERE b.platform = l.platform AND b.field = 'title'
                      AND b.normalized_value = {norm_sql('l.title')})
      AND NOT EXISTS (SELECT 1 FROM v_blocks b WHERE b.platform = l.platform AND b.field = 'description'
                      AND b.normalized_value = {norm_sql('l.description')})""")
def _(t):
    controls = t.controls.withColumn("public_visible", F.col("platform") != "instagram")
    return visibility.visible_listings(t.listings, t.moderation, controls, t.blocks, t.flags, check_sellers=False).select("id")


@query("j1_listing_moderation_controls", """
    SELECT l.id, m.hidden, m.seller_name_override, c.public_visible
    FROM v_listings l LEFT JOIN v_moderation m ON m.listing_id = l.id LEFT JOIN v_controls c ON c.platform = l.platform""")
def _(t):
    return visibility.with_moderation(t.listings, t.moderation, t.controls).select(
        "id", "hidden", "seller_name_override", "public_visible")


@query("j2_without_content_blocks", f"""
    SELECT l.id FROM v_listings l
    WHERE NOT EXISTS (SELECT 1 FROM v_blocks b WHERE b.platform = l.platform AND b.field = 'title'
                      AND b.normalized_value = {norm_sql('l.title')})
      AND NOT EXISTS (SELECT 1 FROM v_blocks b WHERE b.platform = l.platform AND b.field = 'description'
                      AND b.normalized_value = {norm_sql('l.description')})""")
def _(t):
    rows = visibility.without_blocked_content(t.listings, t.blocks, "title")
    return visibility.without_blocked_content(rows, t.blocks, "description").select("id")


@query("j3_without_blocked_sellers", f"""
    SELECT l.id, m.seller_name_override FROM v_listings l LEFT JOIN v_moderation m ON m.listing_id = l.id
    WHERE NOT (l.platform IN ('facebook', 'facebook_group') AND EXISTS (
        SELECT 1 FROM v_flags f WHERE f.status = 'blocked' AND f.platform = l.platform
        AND f.normalized_seller_name = {norm_sql('coalesce(m.seller_name_override, l.seller_name)')}))""")
def _(t):
    marks = t.moderation.select(F.col("listing_id").alias("id"), "seller_name_override")
    return visibility.without_blocked_sellers(t.listings.join(marks, "id", "left"), t.flags).select(
        "id", "seller_name_override")


@query("j10_scalar_lookups", """
    SELECT l.id, (SELECT m.seller_name_override FROM v_moderation m WHERE m.listing_id = l.id) AS seller_name_override,
           coalesce((SELECT m.hidden FROM v_moderation m WHERE m.listing_id = l.id), FALSE) AS hidden,
           coalesce((SELECT c.public_visible FROM v_controls c WHERE c.platform = l.platform), TRUE) AS public_visible,
           (SELECT count(*) FROM v_images i WHERE i.listing_id = l.id) AS image_count
    FROM v_listings l""")
def _(t):
    return visibility.visibility_columns(t.listings, t.moderation, t.controls, t.images).select(
        "id", "seller_name_override", "hidden", "public_visible", "image_count")


@query("src1_scan_listings", """
    SELECT l.id, l.platform, l.source_url, l.title, l.status, l.first_fetched_at, coalesce(i.n, 0) AS image_count
    FROM v_listings l LEFT JOIN (SELECT listing_id, count(*) AS n FROM v_images GROUP BY 1) i ON i.listing_id = l.id""")
def _(t):
    return quality.scan_listings(t.listings, t.images).select(
        "id", "platform", "source_url", "title", "status", "first_fetched_at", "image_count")


# Filters -----------------------------------------------------------------------------------------------------------

def _filter_query(name, condition, **filters):
    @query(name, f"SELECT id FROM v_visible WHERE {condition}")
    def _(t):
        return feed.apply_feed_filters(t.visible, **filters).select("id")


_filter_query("p2_platform_in", "platform IN ('reddit', 'facebook')", platforms=("reddit", "facebook"))
_filter_query("p3_status_in", "status IN ('available', 'unknown')", statuses=("available", "unknown"))
_filter_query("p4_category_in", "category IN ('Laptop', 'RAM')", categories=("Laptop", "RAM"))
_filter_query("p5_location_overlap", "list_has_any(location_texts, ['Kota B', 'Jawa'])", locations=("Kota B", "Jawa"))
_filter_query("p6_condition_in", "condition_text IN ('Like New', 'mulus')", conditions=("Like New", "mulus"))
_filter_query(
    "p7_text_search",
    "title ILIKE '%red w%' OR description ILIKE '%red w%' OR coalesce(brand, '') ILIKE '%red w%' OR "
    "coalesce(category, '') ILIKE '%red w%' OR coalesce(seller_name_override, seller_name, '') ILIKE '%red w%'",
    q="RED w")


@query("p7_text_search_literal", "SELECT page_id FROM pages WHERE contains(lower(url), '%%% e') OR contains(lower(html), '%%% e')")
def _(t):
    none = F.lit(None).cast("string")
    rows = t.table("pages").select("page_id", F.col("url").alias("title"), F.col("html").alias("description"),
                                   *[none.alias(c) for c in ("brand", "category", "seller_name_override", "seller_name")])
    return rows.filter(feed.text_search("%%% E")).select("page_id")


_filter_query("p8_price_range", "price >= 500000 AND price <= 3000000", min_price=500_000, max_price=3_000_000)


_REQUEST_COLUMNS = """
    SELECT o_orderkey AS request_id,
           CASE WHEN o_orderkey % 6 = 0 THEN list_value('reddit', 'reddit') WHEN o_orderkey % 7 = 0 THEN list_value('ebay')
                WHEN o_orderkey % 2 = 0 THEN list_value('reddit', 'facebook') END AS platforms,
           CASE WHEN o_orderkey % 5 = 0 THEN list_value('sold', 'available', 'unknown', 'gone') END AS statuses,
           CASE WHEN o_orderkey % 4 = 0 THEN list_value(o_orderpriority, repeat(o_orderpriority, 12)) END AS categories,
           CASE WHEN o_orderkey % 3 = 0 THEN list_value(o_orderstatus, concat(' ', o_orderstatus)) END AS locations,
           CASE WHEN o_orderkey % 8 = 0 THEN CAST([] AS VARCHAR[]) END AS conditions,
           CASE WHEN o_orderkey % 9 = 0 THEN repeat(o_orderpriority, 10) WHEN o_orderkey % 10 = 0 THEN '  ' END AS q,
           CAST(floor(o_totalprice) AS BIGINT) - 5000 AS min_price, CAST(floor(o_totalprice * 0.9) AS BIGINT) AS max_price,
           CASE o_orderstatus WHEN 'F' THEN 'newest' WHEN 'O' THEN 'cheapest' END AS sort,
           o_orderkey % 60 AS "limit", CASE WHEN o_orderkey % 12 = 0 THEN repeat('a', 513) END AS cursor
    FROM orders"""


def _request_rows(t):
    empty = "CAST(array() AS ARRAY<STRING>)"
    return t.table("orders").selectExpr(
        "o_orderkey AS request_id",
        "CASE WHEN o_orderkey % 6 = 0 THEN array('reddit', 'reddit') WHEN o_orderkey % 7 = 0 THEN array('ebay') "
        "WHEN o_orderkey % 2 = 0 THEN array('reddit', 'facebook') END AS platforms",
        "CASE WHEN o_orderkey % 5 = 0 THEN array('sold', 'available', 'unknown', 'gone') END AS statuses",
        "CASE WHEN o_orderkey % 4 = 0 THEN array(o_orderpriority, repeat(o_orderpriority, 12)) END AS categories",
        "CASE WHEN o_orderkey % 3 = 0 THEN array(o_orderstatus, concat(' ', o_orderstatus)) END AS locations",
        f"CASE WHEN o_orderkey % 8 = 0 THEN {empty} END AS conditions",
        "CASE WHEN o_orderkey % 9 = 0 THEN repeat(o_orderpriority, 10) WHEN o_orderkey % 10 = 0 THEN '  ' END AS q",
        "CAST(floor(o_totalprice) AS BIGINT) - 5000 AS min_price", "CAST(floor(o_totalprice * 0.9) AS BIGINT) AS max_price",
        "CASE o_orderstatus WHEN 'F' THEN 'newest' WHEN 'O' THEN 'cheapest' END AS sort", "o_orderkey % 60 AS limit",
        "CASE WHEN o_orderkey % 12 = 0 THEN repeat('a', 513) END AS cursor")


def _audit_sql() -> str:
    parts = []
    for name, bound in feed.ARRAY_BOUNDS.items():
        parts.append(f"CASE WHEN len({name}) NOT BETWEEN 1 AND {bound} THEN '{name} size' END")
        parts.append(f"CASE WHEN len(list_distinct([trim(x) for x in {name}])) <> len({name}) "
                     f"THEN '{name} unique' END")
        if name == "platforms":
            bad = "x NOT IN ('reddit', 'instagram', 'facebook', 'facebook_group')"
        elif name == "statuses":
            bad = "x NOT IN ('available', 'sold', 'unknown')"
        else:
            bad = "length(trim(x)) NOT BETWEEN 1 AND 80"
        parts.append(f"CASE WHEN len([x for x in {name} if {bad}]) > 0 THEN '{name} value' END")
    parts += [
        "CASE WHEN length(trim(q)) NOT BETWEEN 1 AND 80 THEN 'q' END",
        "CASE WHEN min_price NOT BETWEEN 0 AND 2000000000 THEN 'min_price' END",
        "CASE WHEN max_price NOT BETWEEN 0 AND 2000000000 THEN 'max_price' END",
        "CASE WHEN min_price > max_price THEN 'price range' END",
        "CASE WHEN sort NOT IN ('newest', 'price-high', 'price-low', 'available-first', 'sold-first') THEN 'sort' END",
        "CASE WHEN \"limit\" NOT BETWEEN 1 AND 50 THEN 'limit' END",
        "CASE WHEN length(cursor) NOT BETWEEN 1 AND 512 THEN 'cursor' END",
    ]
    return f"SELECT request_id, concat_ws('|', {', '.join(parts)}) AS errors FROM ({_REQUEST_COLUMNS}) r"


@query("p9_audit_feed_requests", _audit_sql())
def _(t):
    return feed.audit_feed_requests(_request_rows(t)).select("request_id", join_list("errors").alias("errors"))


@query("p10_parse_feed_params", """
    SELECT o_orderkey AS request_id,
           concat_ws('|', CASE WHEN o_orderstatus = 'F' THEN 'reddit' END, 'facebook') AS platforms,
           CASE WHEN o_orderstatus = 'P' THEN 'sold' ELSE '' END AS statuses,
           concat_ws('|', o_orderpriority, 'Kota B') AS locations, '' AS conditions,
           CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(o_totalprice) AS BIGINT) END AS min_price,
           CAST(NULL AS BIGINT) AS max_price,
           CASE WHEN o_orderstatus = 'F' THEN 'price-low' ELSE 'newest' END AS sort, 'rtx 4070' AS q
    FROM orders""")
def _(t):
    urls = t.table("orders").selectExpr(
        "o_orderkey AS request_id",
        "concat('https://shop.example/search?platform=', CASE o_orderstatus WHEN 'F' THEN 'reddit' ELSE 'ebay' END, "
        "'&platform=facebook&platform=facebook&status=', CASE o_orderstatus WHEN 'P' THEN 'sold' ELSE 'gone' END, "
        "'&location=', url_encode(concat(' ', o_orderpriority, ' ')), '&location=Kota+B&location=', "
        "url_encode(o_orderpriority), '&condition=', repeat('x', 81), '&minPrice=', "
        "CASE o_orderstatus WHEN 'O' THEN '-5' ELSE CAST(floor(o_totalprice) AS STRING) END, '&maxPrice=cheap', "
        "'&sort=', CASE o_orderstatus WHEN 'F' THEN 'price-low' ELSE 'cheapest' END, '&q=%20rtx%204070+#top') AS url")
    return feed.parse_feed_params(urls).select(
        "request_id", *[join_list(c).alias(c) for c in ("platforms", "statuses", "locations", "conditions")],
        "min_price", "max_price", "sort", "q")


@query("p11_scope_filter", """
    SELECT id, 'platform' AS scope FROM v_visible WHERE platform = 'instagram'
    UNION ALL SELECT id, 'gpu' FROM v_visible WHERE category IN ('Graphics Card')
    UNION ALL SELECT id, 'pc-build' FROM v_visible WHERE category IN ('Desktop PC', 'PC Case', 'CPU', 'RAM', 'Storage',
        'Motherboard', 'Power Supply')
    UNION ALL SELECT id, 'all' FROM v_visible""")
def _(t):
    scopes = {"platform": ("platform", "instagram"), **{c: ("collection", c) for c in ("gpu", "pc-build", "all")}}
    return feed.in_scopes(t.visible, scopes).select("id", "scope")


@query("p18_plausible_facets", f"""
    SELECT id, value, length(value) <= 48 AND NOT regexp_matches(value, '(?i)[0-9]|%|https?:|www\\.|@')
           AND NOT regexp_matches(value, '{_JS_PLACE}') AS plausible
    FROM (SELECT id, unnest(location_texts) AS value FROM v_listings) x
    UNION ALL SELECT id, condition_text, length(condition_text) <= 32
           AND regexp_matches(condition_text, '{_CONDITION_SQL}') FROM v_listings WHERE condition_text IS NOT NULL""")
def _(t):
    places = t.listings.select("id", F.explode("location_texts").alias("value")).withColumn(
        "plausible", text.plausible_location(F.col("value")))
    conditions = t.listings.filter("condition_text is not null").select("id", F.col("condition_text").alias("value")).withColumn(
        "plausible", text.plausible_condition(F.col("value")))
    return places.union(conditions)


# Order and pages ---------------------------------------------------------------------------------------------------

_RANKS = {
    "newest": ("0", "0", "DESC"),
    "price-high": ("CASE status WHEN 'sold' THEN 1 ELSE 0 END", "coalesce(price, -1)", "DESC"),
    "price-low": ("CASE status WHEN 'sold' THEN 1 ELSE 0 END", "coalesce(price, 2147483647)", "ASC"),
    "available-first": ("CASE status WHEN 'available' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END", "0", "DESC"),
    "sold-first": ("CASE status WHEN 'sold' THEN 0 ELSE 1 END", "0", "DESC"),
}


def _ranked_sql(sort: str, source: str = "v_visible", where: str = "TRUE") -> str:
    rank, value, _ = _RANKS[sort]
    return (f"SELECT id, {rank} AS status_rank, {value} AS sort_value, "
            f"date_trunc('millisecond', coalesce(posted_at, first_fetched_at)) AS effective_at FROM {source} WHERE {where}")


def _order_sql(sort: str) -> str:
    return f"status_rank, sort_value {_RANKS[sort][2]}, effective_at DESC, id DESC"


def _placed(page, sort):
    """Page rows with their place; a page has at most 51 rows, so one small window numbers it."""
    from pyspark.sql import Window

    order = Window.orderBy(*feed.sort_order(sort))
    return page.withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))


def _page_query(sort: str):
    @query(f"o1_feed_page_{sort.replace('-', '_')}", f"""
        SELECT *, row_number() OVER (ORDER BY {_order_sql(sort)}) - 1 AS place FROM (
            SELECT * FROM ({_ranked_sql(sort)}) r ORDER BY {_order_sql(sort)} LIMIT 25) p""")
    def _(t):
        return _placed(feed.feed_page(t.visible, sort, 24), sort)


for _sort in _RANKS:
    _page_query(_sort)


def _after_query(sort: str, rank: int, value: int, at: str, last_id: str):
    direction = ">" if sort == "price-low" else "<"

    @query(f"o2_after_cursor_{sort.replace('-', '_')}", f"""
        SELECT * FROM ({_ranked_sql(sort)}) r
        WHERE status_rank > {rank} OR (status_rank = {rank} AND sort_value {direction} {value})
           OR (status_rank = {rank} AND sort_value = {value} AND effective_at < TIMESTAMP '{at}')
           OR (status_rank = {rank} AND sort_value = {value} AND effective_at = TIMESTAMP '{at}' AND id < '{last_id}')""")
    def _(t):
        cursor = feed.Cursor(sort, rank, value, dt.datetime.fromisoformat(at), last_id)
        keys = feed.ranked(t.visible, sort).select("id", "status_rank", "sort_value", "effective_at")
        return keys.filter(feed.after_cursor(cursor))


_after_query("newest", 0, 0, "1998-10-03 00:00:00", "000000000100")
_after_query("price-high", 0, 2_000_000, "1998-01-01 00:00:00", "000000000100")
_after_query("price-low", 0, 2_000_000, "1998-01-01 00:00:00", "000000000100")
_after_query("available-first", 1, 0, "1998-01-01 00:00:00", "000000000100")
_after_query("sold-first", 1, 0, "1999-01-01 00:00:00", "000000000100")

_ENCODED = """translate(base64(encode(concat('{"v":3,"s":"price-high","r":', status_rank, ',"k":', sort_value, ',"t":"',
    strftime(effective_at, '%Y-%m-%dT%H:%M:%S.%g'), 'Z","i":"', id, '"}'))), '+/=', '-_')"""


@query("o3_cursor_round_trip", f"""
    SELECT id, {_ENCODED} AS token, 'price-high' AS sort, CAST(status_rank AS INTEGER) AS status_rank,
           CAST(sort_value AS BIGINT) AS sort_value, effective_at, id AS cursor_id
    FROM ({_ranked_sql('price-high', 'v_listings')}) r""")
def _(t):
    rows = feed.ranked(t.listings, "price-high").select("id", feed.cursor_column("price-high").alias("token"))
    back = rows.withColumn("c", feed.decode_cursor_column(F.col("token")))
    return back.select("id", "token", "c.sort", "c.status_rank", "c.sort_value", "c.effective_at",
                       F.col("c.id").alias("cursor_id"))


@query("o3_cursor_rejects", """
    SELECT id, FALSE AS readable FROM v_listings""")
def _(t):
    tokens = feed.ranked(t.listings, "newest").select("id", F.translate(
        F.base64(F.encode(F.concat(F.lit('{"v":2,"i":"'), "id", F.lit('"}')), "UTF-8")), "+/=", "-_").alias("token"))
    return tokens.select("id", feed.decode_cursor_column(F.col("token")).isNotNull().alias("readable"))


@query("o4_page_items", f"""
    SELECT p.place, l.id, l.source_url, l.title FROM (
        SELECT id, row_number() OVER (ORDER BY {_order_sql('price-low')}) - 1 AS place FROM (
            SELECT * FROM ({_ranked_sql('price-low', where='price >= 50000')}) r
            ORDER BY {_order_sql('price-low')} LIMIT 24) k) p
    JOIN v_listings l ON l.id = p.id""")
def _(t):
    request = feed.validate_feed_input({"sort": "price-low", "minPrice": 50_000})
    page = feed.get_feed(t.visible, t.listings, t.images, t.moderation, request)
    rows = [(i, r["id"], r["source_url"], r["title"]) for i, r in enumerate(page.items)]
    return t.spark.createDataFrame(rows, "place bigint, id string, source_url string, title string")


@query("o5_assign_pages", f"""
    SELECT id, row_number() OVER (ORDER BY {_order_sql('price-low')}) - 1 AS rank,
           CAST(floor((row_number() OVER (ORDER BY {_order_sql('price-low')}) - 1) / 24) AS BIGINT) AS page
    FROM ({_ranked_sql('price-low')}) r""")
def _(t):
    return feed.assign_pages(t.visible, "price-low", 24).select("id", "rank", "page")


@query("j6_page_read_back", f"""
    SELECT p.id, p.place, l.title, l.price, l.source_url, m.seller_name_override FROM (
        SELECT id, row_number() OVER (ORDER BY {_order_sql('newest')}) - 1 AS place FROM (
            SELECT * FROM ({_ranked_sql('newest')}) r ORDER BY {_order_sql('newest')} LIMIT 51) k) p
    JOIN v_listings l ON l.id = p.id LEFT JOIN v_moderation m ON m.listing_id = p.id""")
def _(t):
    page = _placed(feed.feed_page(t.visible, "newest", 50), "newest").select("id", "place")
    return feed.read_page(page, t.listings, t.moderation).select(
        "id", "place", "title", "price", "source_url", "seller_name_override")


# Facets ------------------------------------------------------------------------------------------------------------

_STATS = """SELECT category AS value, count(*) AS count,
        CAST(min(price) FILTER (WHERE price >= 10000 AND price NOT IN (12345, 123456)) AS INTEGER) AS min_price
    FROM v_visible WHERE category IS NOT NULL AND trim(category) <> '' GROUP BY category"""
_COVERS = """SELECT id, category, platform, row_number() OVER (PARTITION BY category ORDER BY
        CASE status WHEN 'sold' THEN 1 ELSE 0 END, coalesce(posted_at, first_fetched_at) DESC, id DESC) AS place
    FROM v_visible WHERE category IS NOT NULL AND trim(category) <> ''"""
_TOP = f"""SELECT s.value, s.count, s.min_price, coalesce(i.cached_url, i.source_url) AS cover_image_url,
        i.cached_url IS NOT NULL AS cover_image_cached, c.platform AS cover_platform, i.alt_text AS cover_alt_text
    FROM ({_STATS}) s LEFT JOIN ({_COVERS}) c ON c.category = s.value AND c.place = 1
    LEFT JOIN v_images i ON i.listing_id = c.id AND i.position = 0 ORDER BY s.count DESC, s.value LIMIT 50"""
_FOLDER_OF = "CASE {p} WHEN 'facebook_group' THEN 'facebook-groups' ELSE {p} END"
_FACETS = f"""SELECT value, count, min_price,
        CASE WHEN CASE WHEN cover_image_cached THEN starts_with(cover_image_url, concat(
            'https://media.example.com/production/', {_FOLDER_OF.format(p='cover_platform')}, '/'))
            ELSE starts_with(cover_image_url, 'https://') END THEN cover_image_url END AS cover_image_url,
        cover_alt_text FROM ({_TOP}) x"""


@query("a1_category_facets", _FACETS)
def _(t):
    return facets.category_facets(t.visible, t.images)


@query("j4_category_cover_images", _TOP)
def _(t):
    return facets.top_categories(t.visible, t.images)


@query("w1_cover_ranking", f"SELECT category AS value, id AS cover_id, platform AS cover_platform FROM ({_COVERS}) c WHERE place = 1")
def _(t):
    return facets.category_covers(t.visible)


@query("j5_location_unnest", """
    SELECT id, value FROM (SELECT id, unnest(location_texts) AS value FROM v_visible) x WHERE trim(value) <> ''""")
def _(t):
    return facets.location_occurrences(t.visible)


@query("a2_location_facets", f"""
    SELECT value, count FROM (
        SELECT trim(value) AS value, count FROM (
            SELECT value, count(*) AS count FROM (SELECT unnest(location_texts) AS value FROM v_visible) x
            WHERE trim(value) <> '' GROUP BY value ORDER BY count DESC, value LIMIT 100) y
        WHERE length(trim(value)) BETWEEN 1 AND 80 AND NOT regexp_matches(value, '[0-9]{{6,}}')) z
    WHERE length(value) <= 48 AND NOT regexp_matches(value, '(?i)[0-9]|%|https?:|www\\.|@')
      AND NOT regexp_matches(value, '{_JS_PLACE}')""")
def _(t):
    return facets.location_facets(t.visible)


@query("a3_condition_facets", f"""
    SELECT value, count FROM (SELECT condition_text AS value, count(*) AS count FROM v_visible
        WHERE condition_text IS NOT NULL AND trim(condition_text) <> '' GROUP BY 1 ORDER BY count DESC, value LIMIT 50) x
    WHERE length(value) <= 32 AND regexp_matches(value, '{_CONDITION_SQL}')""")
def _(t):
    return facets.condition_facets(t.visible)


@query("a4_collection_rollup", f"""
    SELECT slug, CAST(coalesce(sum(count), 0) AS BIGINT) AS count, min(min_price) AS lowest_price
    FROM (VALUES ('laptop', 'Laptop'), ('gpu', 'Graphics Card'), ('pc-build', 'Desktop PC'), ('pc-build', 'PC Case'),
          ('pc-build', 'CPU'), ('pc-build', 'RAM'), ('pc-build', 'Storage'), ('pc-build', 'Motherboard'),
          ('pc-build', 'Power Supply'), ('peripheral', 'Keyboard'), ('peripheral', 'Mouse'), ('peripheral', 'Peripheral'),
          ('peripheral', 'Audio'), ('peripheral', 'Network Adapter'), ('monitor', 'Monitor'), ('gaming', 'Game Console'),
          ('gaming', 'Game'), ('gaming', 'Controller'), ('gaming', 'Handheld PC'), ('smartphone', 'Smartphone'))
          AS d(slug, category) LEFT JOIN ({_FACETS}) f ON f.value = d.category GROUP BY slug""")
def _(t):
    return facets.collection_rollup(facets.category_facets(t.visible, t.images))


@query("a5_feed_version", """
    SELECT translate(base64(unhex(sha256(concat(CAST(n AS VARCHAR), chr(0), strftime(latest, '%Y-%m-%dT%H:%M:%S.%g'), 'Z')))),
                     '+/=', '-_') AS revision, n AS total_count
    FROM (SELECT count(*) AS n, max(first_fetched_at) AS latest FROM v_visible) x""")
def _(t):
    return facets.feed_version(t.visible)


@query("a21_platform_status_counts", "SELECT platform, status, count(*) AS count FROM v_listings GROUP BY 1, 2")
def _(t):
    return facets.platform_status_counts(t.listings)


# Public shape ------------------------------------------------------------------------------------------------------

@query("n19_listing_dto", f"""
    SELECT l.id, l.platform, l.source_url, CASE WHEN price >= 10000 AND price NOT IN (12345, 123456) THEN price END AS price,
           array_to_string([x for x in location_texts if length(x) BETWEEN 1 AND 80
                AND NOT regexp_matches(x, '[0-9]{{6,}}')], '|') AS location_texts,
           coalesce(m.seller_name_override, l.seller_name) AS seller_name,
           coalesce(l.posted_at, l.first_fetched_at) AS listed_at, coalesce(g.images, '') AS images
    FROM v_listings l LEFT JOIN v_moderation m ON m.listing_id = l.id LEFT JOIN (
        SELECT listing_id, string_agg(concat(position, ' ', url), '|' ORDER BY position) AS images FROM (
            SELECT i.listing_id, i.position, CASE WHEN i.cached_url IS NOT NULL AND starts_with(i.cached_url, concat(
                'https://media.example.com/production/', {_FOLDER_OF.format(p='o.platform')}, '/'))
                THEN i.cached_url ELSE i.source_url END AS url
            FROM v_images i JOIN v_listings o ON o.id = i.listing_id) x
        WHERE starts_with(url, 'https://') GROUP BY listing_id) g ON g.listing_id = l.id""")
def _(t):
    rows = dto.to_listing_dto(t.listings, t.images, t.moderation)
    images = F.array_join(F.transform("images", lambda i: F.concat_ws(" ", i["position"].cast("string"), i["source_url"])), "|")
    return rows.select("id", "platform", "source_url", "price", join_list("location_texts").alias("location_texts"),
                       "seller_name", "listed_at", images.alias("images"))


@query("f13_effective_at", "SELECT id, coalesce(posted_at, first_fetched_at) AS effective_at FROM v_listings")
def _(t):
    return t.listings.select("id", values.effective_at().alias("effective_at"))


@query("f14_effective_seller", """
    SELECT l.id, coalesce(m.seller_name_override, l.seller_name) AS seller
    FROM v_listings l LEFT JOIN v_moderation m ON m.listing_id = l.id""")
def _(t):
    marks = t.moderation.select(F.col("listing_id").alias("id"), "seller_name_override")
    return t.listings.join(marks, "id", "left").select("id", values.effective_seller().alias("seller"))


@query("slice_first_page", f"""
    SELECT p.place, p.id, l.title, l.price, coalesce(m.seller_name_override, l.seller_name) AS seller_name FROM (
        SELECT id, row_number() OVER (ORDER BY {_order_sql('price-low')}) - 1 AS place FROM (
            SELECT * FROM ({_ranked_sql('price-low', where="price >= 20000 AND (title ILIKE '%ring%' OR description ILIKE '%ring%' OR coalesce(brand, '') ILIKE '%ring%' OR coalesce(category, '') ILIKE '%ring%' OR coalesce(seller_name_override, seller_name, '') ILIKE '%ring%')")}) r
            ORDER BY {_order_sql('price-low')} LIMIT 25) k) p
    JOIN v_listings l ON l.id = p.id LEFT JOIN v_moderation m ON m.listing_id = p.id""")
def flagship(t):
    """Visible, searched, filtered and ordered first page with its rows: the read path end to end."""
    rows = feed.apply_feed_filters(t.visible, q="ring", min_price=20_000)
    page = _placed(feed.feed_page(rows, "price-low", 24), "price-low").select("id", "place")
    return feed.read_page(page, t.listings, t.moderation).select(
        "place", "id", "title", "price", values.effective_seller().alias("seller_name"))
