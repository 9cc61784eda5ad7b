"""Extraction, normalization and streams over payloads that Spark derives from the driver tables: SRC3, SRC4, X1-X7,
X11, X14, N1-N4, T1, T5, T7-T9 as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapak.operators import extract_json, extract_text, normalize, reconcile
from lapak.plans.flow_queries import NEXT_QUEUE_SQL
from lapak.plans.registry import query
from lapak.plans.views import SQL_VIEWS
from lapak.session import scratch_path, shuffles_removed
from lapak.streaming import jobs, stateful

_FETCHED = "2001-08-05 00:00:00"


def fetched_at():
    return F.lit(_FETCHED).cast("timestamp_ntz")


def _payload(rows, page, text, script=None):
    return rows.select(page.cast("string").alias("page_id"), (F.lit(0) if script is None else script).cast("int").alias(
        "script_index"), text.alias("text"))


def _scripts(rows, page, *texts):
    """Several scripts of a page, from one pass over ``rows``."""
    each = F.array(*[F.struct(F.lit(k).alias("script_index"), text.alias("text")) for k, text in enumerate(texts)])
    return rows.select(page.cast("string").alias("page_id"), F.inline(each))


# Marketplace: one page per order, one edge per order line; parts repeat inside a page now and then.
SQL_VIEWS["v_edges"] = """
    SELECT CAST(l_orderkey AS VARCHAR) AS page_id, l_partkey, l_linenumber, l_returnflag, l_linestatus, l_extendedprice,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_returnflag, l_linestatus) AS place
    FROM lineitem"""
SQL_VIEWS["v_market"] = """
    SELECT page_id, CAST(l_partkey AS VARCHAR) AS item_id, concat('Part ', l_partkey, ' L', l_linenumber) AS title,
           CAST(floor(l_extendedprice) AS BIGINT) AS price_amount, CASE WHEN l_returnflag = 'R' THEN TRUE WHEN l_returnflag = 'A' THEN FALSE END
           AS is_sold, l_linestatus = 'O' AS is_live, place FROM v_edges
    QUALIFY row_number() OVER (PARTITION BY page_id, l_partkey ORDER BY place) = 1"""


def market_payloads(t):
    edge = lambda k: F.struct(F.struct(F.struct(
        k["l_partkey"].cast("string").alias("id"),
        F.concat(F.lit("Part "), k["l_partkey"].cast("string"), F.lit(" L"), k["l_linenumber"].cast("string")).alias("marketplace_listing_title"),
        F.struct(F.concat(F.lit("Rp"), F.floor(k["l_extendedprice"]).cast("bigint").cast("string")).alias("formatted_amount"),
                 F.floor(k["l_extendedprice"]).cast("bigint").cast("string").alias("amount")).alias("listing_price"),
        F.expr("named_struct('reverse_geocode', named_struct('city_page', named_struct('display_name', ' Kota A ')))").alias("location"),
        F.when(k["l_returnflag"] == "R", True).when(k["l_returnflag"] == "A", False).alias("is_sold"),
        (k["l_linestatus"] == "O").alias("is_live")).alias("listing")).alias("node"))
    line = F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    # An order has a handful of lines, so its page is small. Only the columns of a line are shuffled, not its JSON.
    pages = t.table("lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(line)), edge).alias("edges"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.struct("edges").alias("feed_units")).alias("marketplace_search"))).alias("require")))
    return _payload(pages, F.col("l_orderkey"), body)


@query("x1_extract_marketplace", "SELECT page_id, item_id, title, price_amount, is_sold, is_live FROM v_market")
def _(t):
    return extract_json.extract_marketplace(market_payloads(t)).select(
        "page_id", "item_id", "title", "price_amount", "is_sold", "is_live")


@query("x1_extract_marketplace_limit", """
    SELECT page_id, item_id FROM v_market QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY place) <= 2""")
def _(t):
    return extract_json.extract_marketplace(market_payloads(t), 2).select("page_id", "item_id")


@query("n3_normalize_marketplace", f"""
    SELECT page_id, concat('https://www.facebook.com/marketplace/item/', item_id, '/') AS source_url, item_id AS external_id, title,
           concat('Rp', price_amount, chr(10), title, chr(10), 'Kota A') AS description,
           CASE WHEN is_sold THEN 'SOLD' WHEN is_live AND NOT is_sold THEN 'AVAILABLE' ELSE 'UNKNOWN' END AS status,
           strftime(TIMESTAMP '{_FETCHED}' - INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S.%gZ') AS posted_at, CAST(price_amount AS VARCHAR) AS price_fact
    FROM v_market""")
def _(t):
    none = F.lit(None).cast("string")
    cards = extract_json.extract_marketplace(market_payloads(t)).withColumns({
        "posted": F.lit("Ditawarkan 3 jam lalu"), "condition": none, "description": none, "approx_location": none, "seller": none,
        "seq": F.col("page_id")})
    rows = normalize.normalize_marketplace(cards, fetched_at())
    return rows.select(F.col("seq").alias("page_id"), "source_url", "external_id", "title", "description", "status", "posted_at",
                       F.col("source_facts")["priceAmount"].alias("price_fact"))


# Group posts: each post is captured twice, the second time with less text but with its sale data.
SQL_VIEWS["v_posts"] = """
    SELECT seq, concat('g', seq % 7) AS group_id, CAST(seq AS VARCHAR) AS post_id, description, source_url,
           CAST(epoch(date_trunc('second', first_fetched_at)) AS BIGINT) AS made, brand FROM v_listings WHERE platform = 'facebook_group'"""


def story_payloads(t):
    rows = t.listings.filter("platform = 'facebook_group'").withColumn(
        "at", F.unix_seconds(F.col("first_fetched_at").cast("timestamp")))
    photo = F.array(F.struct(F.struct(F.lit("Photo").alias("__typename"), F.struct(F.concat(
        F.lit("https://scontent.fbcdn.net/"), "id", F.lit(".jpg")).alias("uri")).alias("image"),
        F.lit(" front ").alias("accessibility_caption")).alias("media")))
    group = F.struct(F.concat(F.lit("g"), (F.col("seq") % 7).cast("string")).alias("id"))
    inner = F.struct(F.struct(F.concat(F.lit("  "), "description").alias("text")).alias("message"), photo.alias("attachments"))
    first = F.to_json(F.struct(F.struct(
        F.col("seq").alias("post_id"), group.alias("target_group"), F.col("at").alias("creation_time"), F.when(
            F.col("brand").isNull(), inner).alias("attached_story"),
        F.when(F.col("brand").isNotNull(), inner["message"]).alias("message"),
        F.when(F.col("brand").isNotNull(), photo).alias("attachments"),
        F.array(F.struct(F.lit("42").alias("id"), F.concat(F.lit("Shop "), F.coalesce("brand", F.lit("none"))).alias("name"))).alias("actors")
    ).alias("node")))
    second = F.to_json(F.struct(F.array(F.struct(
        F.col("seq").cast("string").alias("post_id"), group.alias("target_group"), F.concat("source_url", F.lit("?ref=x")).alias("permalink_url"),
        F.struct(F.lit("GroupCommerceProductItem").alias("__typename"), F.struct(F.lit("Rp5").alias("text")).alias("formatted_price"),
                 F.lit("Kota A").alias("location_text")).alias("comet_sections"))).alias("data")))
    return _scripts(rows, F.col("seq"), F.concat(F.lit("for (;;);"), first), F.concat(second, F.lit("\n"), F.lit('{"other":1}')))


def group_targets(t):
    names = t.table("nation").select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("group_id"),
                                     F.concat(F.lit("Grup "), "n_name").alias("group_name"))
    return names.withColumns({"group_url": F.lit("https://www.facebook.com/groups/pasar/"), "sorting": F.lit("CHRONOLOGICAL")})


_POST_ROWS = """SELECT group_id, post_id, source_url AS permalink, description AS message, made AS published_timestamp,
        brand IS NULL AS used_attached_story, 1 AS n_images, 'Rp5' AS formatted_price, row_number() OVER (PARTITION BY group_id
        ORDER BY made DESC, post_id DESC) AS place FROM v_posts"""


@query("x2_extract_group_posts", f"SELECT * FROM ({_POST_ROWS}) x WHERE place <= 3")
def _(t):
    posts = extract_json.extract_group_posts(story_payloads(t), group_targets(t), 3)
    return posts.select("group_id", "post_id", "permalink", "message", "published_timestamp", "used_attached_story",
                        F.size("images").alias("n_images"), F.col("commerce.formatted_price").alias("formatted_price"),
                        F.col("place").cast("bigint").alias("place"))


@query("x3_merge_group_records", f"SELECT * EXCLUDE (place) FROM ({_POST_ROWS}) x")
def _(t):
    records = extract_json.group_records(story_payloads(t)).withColumn("seq", F.struct("script_index", "place"))
    merged = extract_json.merge_group_records(records)
    return merged.select("group_id", "post_id", "permalink", "message", "published_timestamp", "used_attached_story",
                         F.size("images").alias("n_images"), F.col("commerce.formatted_price").alias("formatted_price"))


@query("n4_normalize_group_posts", """
    SELECT concat(group_id, ':', post_id) AS external_id, source_url, string_split(description, chr(10))[1] AS title,
           concat('Shop ', coalesce(brand, 'none')) AS seller_name, strftime(make_timestamp(made * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS posted_at,
           'Grup ' || n_name AS group_name, CASE WHEN brand IS NULL THEN 'true' ELSE 'false' END AS used FROM v_posts JOIN nation ON group_id = concat('g', n_nationkey)""")
def _(t):
    records = extract_json.group_records(story_payloads(t)).withColumn("seq", F.struct("script_index", "place"))
    rows = normalize.normalize_group_posts(extract_json.merge_group_records(records), group_targets(t), fetched_at())
    return rows.select("external_id", "source_url", "title", "seller_name", "posted_at",
                       F.col("source_facts")["groupName"].alias("group_name"), F.col("source_facts")["usedAttachedStory"].alias("used"))


# Profiles: one page per customer with its Instagram orders; a second script repeats them with captions.
SQL_VIEWS["v_profile"] = """
    SELECT CAST(o.o_custkey AS VARCHAR) AS page_id, CAST(l.seq AS VARCHAR) AS shortcode, l.description, l.brand,
           CASE WHEN posted_at IS NULL THEN 0 ELSE CAST(epoch(posted_at) AS BIGINT) END AS taken_at, l.seq
    FROM v_listings l JOIN orders o ON o.o_orderkey = l.seq WHERE l.platform = 'instagram'"""


def profile_payloads(t):
    owners = t.table("orders").select(F.col("o_orderkey").alias("seq"), "o_custkey")
    rows = t.listings.filter("platform = 'instagram'").join(owners, "seq")
    link = lambda x, p: F.concat(F.lit(f"https://cdn.example/{p}/"), x["id"], F.lit(".jpg"))
    bare = lambda x: F.struct(F.struct(
        x["seq"].cast("string").alias("code"), x["seq"].cast("string").alias("pk"), F.unix_seconds(x["posted_at"].cast("timestamp")).alias("taken_at"),
        F.struct(F.array(F.struct(link(x, "a").alias("url"))).alias("candidates")).alias("image_versions2"),
        F.array(F.struct(link(x, "a").alias("display_uri")), F.struct(link(x, "b").alias("display_uri"))).alias("carousel_media")).alias("node"))
    full = lambda x: F.struct(F.struct(
        x["seq"].cast("string").alias("shortcode"), F.struct(F.concat(x["description"], F.lit(" &amp; more")).alias("text")).alias("caption"),
        F.lit(2).alias("carousel_media_count"), F.struct(F.array(F.struct(F.struct(link(x, "c").alias("display_url")).alias("node"))).alias("edges"))
        .alias("edge_sidecar_to_children")).alias("node"))
    # A customer has a bounded number of orders per profile page. Only their columns are shuffled, not their JSON.
    pages = rows.groupBy("o_custkey").agg(F.collect_list(F.struct("seq", "id", "posted_at", "description")).alias("posts"))
    first = F.to_json(F.struct(F.struct(F.struct(F.transform("posts", bare).alias("edges")).alias("polaris_ordered_timeline_connection")).alias("data")))
    second = F.to_json(F.struct(F.struct(F.struct(F.struct(F.transform("posts", full).alias("edges")).alias("edge_owner_to_timeline_media")).alias("user")).alias("data")))
    return _scripts(pages, F.col("o_custkey"), first, second)


@query("x4_extract_profile_posts", """
    SELECT page_id, shortcode, concat(description, ' &amp; more') AS caption, taken_at, 3 AS n_children, row_number() OVER (
        PARTITION BY page_id ORDER BY taken_at DESC, seq DESC, shortcode) AS place FROM v_profile""")
def _(t):
    return extract_json.extract_profile_posts(profile_payloads(t)).select(
        "page_id", "shortcode", "caption", "taken_at", F.size("children").alias("n_children"),
        F.col("place").cast("bigint").alias("place"))


@query("x5_merge_posts", """
    SELECT shortcode, concat(description, ' &amp; more') AS caption, taken_at, shortcode AS pk, CAST(2 AS BIGINT) AS media_count FROM v_profile""")
def _(t):
    found = extract_json._emit(profile_payloads(t), extract_json._timeline_posts, extract_json.PROFILE_RECORD)
    merged = extract_json.merge_posts(found.withColumn("seq", F.struct("script_index", "place")))
    return merged.select("shortcode", "caption", "taken_at", "pk", "media_count")


@query("x6_extract_post_detail", """
    SELECT page_id, max(shortcode) AS shortcode, concat(arg_max(description, shortcode), ' &amp; more') AS caption FROM v_profile GROUP BY 1""")
def _(t):
    owners = t.table("orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("page_id"))
    wanted = t.listings.filter("platform = 'instagram'").join(owners, "seq").groupBy("page_id").agg(
        F.max(F.col("seq").cast("string")).alias("shortcode"))
    return extract_json.extract_post_detail(profile_payloads(t), wanted).select("page_id", "shortcode", "caption")


@query("n2_normalize_instagram", """
    SELECT shortcode AS external_id, concat('https://www.instagram.com/p/', shortcode, '/') AS source_url, concat(description, ' & more') AS description,
           CASE WHEN taken_at <> 0 THEN strftime(make_timestamp(taken_at * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') END AS posted_at,
           concat('https://cdn.example/a/', lpad(shortcode, 12, '0'), '.jpg|https://cdn.example/b/', lpad(shortcode, 12, '0'),
                  '.jpg|https://cdn.example/c/', lpad(shortcode, 12, '0'), '.jpg') AS images FROM v_profile""")
def _(t):
    posts = extract_json.extract_profile_posts(profile_payloads(t))
    rows = normalize.normalize_instagram(posts, fetched_at(), F.lit("toko"))
    return rows.select("external_id", "source_url", "description", "posted_at",
                       F.array_join(F.transform("images", lambda i: i["source_url"]), "|").alias("images"))


# Feeds: one Atom document per customer with its Reddit orders.
SQL_VIEWS["v_entries"] = """
    SELECT CAST(o.o_custkey AS VARCHAR) AS page_id, row_number() OVER (PARTITION BY o.o_custkey ORDER BY l.seq) - 1 AS place, l.seq, l.title, l.id,
           l.source_url, l.first_fetched_at, l.status FROM v_listings l JOIN orders o ON o.o_orderkey = l.seq WHERE l.platform = 'reddit'"""


def atom_payloads(t):
    owners = t.table("orders").select(F.col("o_orderkey").alias("seq"), "o_custkey")
    entry = F.concat(
        F.lit("<entry><title> "), "title", F.lit("</title><updated>"), F.date_format("first_fetched_at", "yyyy-MM-dd'T'HH:mm:ss'+07:00'"),
        F.lit("</updated><author><name>/u/x</name></author><id>t3_"), F.col("seq").cast("string"),
        F.lit('</id><link href="https://www.reddit.com/"/><link rel="alternate" href="'), "source_url",
        F.lit('"/><content type="html">&lt;p&gt;Jual '), "title", F.lit(" &amp;amp; lain&lt;/p&gt;&lt;a href=\"https://preview.redd.it/"), "id",
        F.lit(".jpg?w=1\"&gt;foto&lt;/a&gt; submitted by &lt;a href=\"https://www.reddit.com/user/x\"&gt; /u/x &lt;/a&gt;</content></entry>"))
    # A customer has a bounded number of orders per feed page.
    rows = t.listings.filter("platform = 'reddit'").join(owners, "seq").select("o_custkey", "seq", entry.alias("e"))
    pages = rows.groupBy("o_custkey").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "e"))), lambda x: x["e"]), "").alias("entries"))
    body = F.concat(F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">'), "entries", F.lit("</feed>"))
    return _payload(pages, F.col("o_custkey"), body)


@query("x7_parse_atom", """
    SELECT page_id, CAST(place AS INTEGER) AS place, title, concat('t3_', seq) AS atom_id, source_url AS url,
           concat('Jual ', replace(title, '  ', ' '), ' & lain https://preview.redd.it/', id, '.jpg?w=1 foto') AS description,
           concat('https://i.redd.it/', id, '.jpg') AS images FROM v_entries WHERE place < 3""")
def _(t):
    return extract_text.parse_atom(atom_payloads(t), 3).select(
        "page_id", "place", "title", "atom_id", "url", "description", F.array_join("images", "|").alias("images"))


@query("n1_normalize_reddit", """
    SELECT CAST(seq AS VARCHAR) AS external_id, source_url, trim(title) AS title, CASE WHEN status = 'sold' THEN 'SOLD' ELSE 'AVAILABLE' END AS status,
           strftime(date_trunc('second', first_fetched_at) - INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') AS posted_at, '/u/x' AS seller_name FROM v_entries""")
def _(t):
    flairs = t.listings.select(F.col("source_url").alias("url"), F.when(
        F.col("status") == "sold", F.lit("SOLD OUT")).otherwise(F.lit("WTS: Computers")).alias("flair"))
    posts = extract_text.parse_atom(atom_payloads(t), None).join(flairs, "url")
    return normalize.normalize_reddit(posts, fetched_at()).select(
        "external_id", "source_url", "title", "status", "posted_at", "seller_name")


# Galleries: one post page per order, media metadata per order line.
@query("x11_gallery_images", """
    SELECT CAST(l_orderkey AS VARCHAR) AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY p) - 1 AS position, url FROM (
        SELECT l_orderkey, min(p) AS p, url FROM (
            SELECT l_orderkey, concat('https://i.redd.it/', l_partkey, '.jpg') AS url, row_number() OVER (PARTITION BY l_orderkey
                ORDER BY l_linenumber, l_partkey, l_returnflag) AS p FROM lineitem WHERE l_returnflag <> 'R'
            UNION ALL SELECT l_orderkey, concat('https://i.redd.it/post', l_orderkey, '.png'), 1000000 FROM lineitem) a GROUP BY 1, 3) b""")
def _(t):
    media = lambda x: F.struct(
        F.when(x["l_returnflag"] == "R", F.lit("failed")).otherwise(F.lit("valid")).alias("status"), F.lit("image/jpg").alias("m"),
        F.array(F.struct(F.lit(10).alias("x"), F.lit(10).alias("y"), F.lit("https://preview.redd.it/small.gif").alias("u")),
                F.struct(F.lit(20).alias("x"), F.lit(30).alias("y"), F.concat(
                    F.lit("https://preview.redd.it/"), x["l_partkey"].cast("string"), F.lit(".jpg?w=1&amp;s=2")).alias("u"))).alias("p"))
    key = lambda i: F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), (i + 1).cast("string"))
    # An order has a handful of lines, so its gallery is small. Only the columns of a line are shuffled, not its JSON.
    lines = t.table("lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("lines"))
    posts = lines.select("l_orderkey", F.transform("lines", lambda x, i: F.struct(key(i).alias("k"))).alias("ids"), F.map_from_entries(
        F.transform("lines", lambda x, i: F.struct(key(i).alias("k"), media(x).alias("m")))).alias("media_metadata"))
    data = F.struct(
        F.col("l_orderkey").cast("string").alias("id"),
        F.struct(F.transform("ids", lambda x: F.struct(x["k"].alias("media_id"))).alias("items")).alias("gallery_data"), "media_metadata",
        F.concat(F.lit("https://i.redd.it/post"), F.col("l_orderkey").cast("string"), F.lit(".png")).alias("url"))
    body = F.to_json(F.array(F.struct(F.struct(F.array(F.struct(data.alias("data"))).alias("children")).alias("data"))))
    return extract_json.gallery_images(_payload(posts, F.col("l_orderkey"), body)).select(
        "page_id", F.col("position").cast("bigint").alias("position"), "url")


# Status pages ------------------------------------------------------------------------------------------------------

@query("x14_status_evidence", """
    SELECT external_id, CASE WHEN login THEN NULL WHEN kind = 0 THEN 'sold' WHEN kind = 1 THEN 'available' WHEN kind IN (2, 3, 4) THEN 'sold' END AS status,
           CASE WHEN login THEN 'login_blocked' WHEN kind = 0 THEN 'structured_is_sold' WHEN kind = 1 THEN 'structured_is_live'
                WHEN kind IN (2, 3, 4) THEN 'visible_sold_marker' WHEN kind = 5 THEN 'unavailable_without_sold_evidence'
                ELSE 'page_checked_without_status_signal' END AS signal, NOT login AS checked
    FROM (SELECT external_id, seq % 8 AS kind, brand IS NULL AS login FROM v_listings WHERE platform = 'facebook') x""")
def _(t):
    rows = t.listings.filter("platform = 'facebook'").withColumn("kind", F.col("seq") % 8)
    visible = F.expr(
        "CASE kind WHEN 2 THEN concat(title, '\\nRp 5 · Habis\\nDetail') WHEN 3 THEN concat(title, '\\n  SOLD   out \\nx') WHEN 4 THEN "
        "'Maaf, barang ini telah\\nterjual kemarin' WHEN 5 THEN 'This listing is no longer  available' WHEN 6 THEN "
        "concat(title, '\\nPilihan  hari ini\\nterjual') ELSE title END")
    pages = rows.select(
        F.col("id").alias("page_id"), "external_id", "source_url",
        F.when(F.col("brand").isNull(), F.lit("https://www.facebook.com/login/?next=x")).otherwise(
            F.concat("source_url", F.lit("?ref=1"))).alias("final_url"),
        F.concat(visible, F.lit("\nMasuk ke Facebook")).alias("visible_text"))
    record = lambda key: F.struct(key.alias("id"), F.expr("kind = 0").alias("is_sold"), F.lit(True).alias("is_live"))
    own = F.to_json(F.struct(F.array(record(F.lit("0")), F.when(F.col("kind") < 2, record(F.col("external_id")))).alias("items")))
    scripts = _payload(rows, F.col("id"), F.lit("{broken")).union(_payload(rows, F.col("id"), own, F.lit(1)))
    return reconcile.status_evidence(pages, scripts).select("external_id", "status", "signal", "checked")


# Bronze and images -------------------------------------------------------------------------------------------------

@query("src3_scan_payloads", """
    SELECT 'web' AS platform, url AS target, CAST(page_id AS VARCHAR) AS page_id, md5(html) AS digest FROM pages""")
def _(t):
    from lapak.sources.payloads import scan_payloads

    path = scratch_path(t.spark, "payloads")
    t.table("pages").select(
        F.lit("web").alias("platform"), F.col("url").alias("target"), F.col("page_id").cast("string").alias("page_id"),
        F.lit(0).alias("script_index"), fetched_at().alias("fetched_at"), F.col("html").alias("text")).write.parquet(path)
    return scan_payloads(t.spark, path).select("platform", "target", "page_id", F.md5("text").alias("digest"))


@query("src4_describe_images", """
    SELECT id, CASE seq % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' ELSE 'image/avif' END AS content_type,
           CASE seq % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'avif' END AS extension FROM v_listings WHERE seq % 5 <> 4""")
def _(t):
    from lapak.sources.images import describe_images

    # File contents derived from listings: a signature, then the description.
    head = F.expr("CASE seq % 5 WHEN 0 THEN X'FFD8FFE0' WHEN 1 THEN X'89504E470D0A1A0A' WHEN 2 THEN X'524946460000000057454250' "
                  "WHEN 3 THEN X'000000206674797061766966' ELSE X'474946383961' END")
    files = t.listings.select(F.col("id").alias("path"), F.concat(head, F.encode("description", "UTF-8")).alias("content")).withColumn(
        "length", F.length("content"))
    return describe_images(files).select(F.col("path").alias("id"), "content_type", "extension")


# Streams -----------------------------------------------------------------------------------------------------------

def _event_stream(t):
    """The events table as a file stream; the file bound limits each micro-batch. The pattern also fits one plain file."""
    schema = t.table("events").schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{t.sf_dir}/events*.parquet")


def _thirds(rows, column):
    """Conditions that cut ``rows`` into three parts by a number or time; two values reach the driver."""
    timed = dict(rows.dtypes)[column].startswith("timestamp")
    value = F.col(column).cast("timestamp").cast("double") if timed else F.col(column)
    low, high = rows.agg(F.min(value), F.max(value)).first()
    one, two = (low + (high - low) * k / 3 for k in (1, 2))
    return [value < one, (value >= one) & (value < two), value >= two]


@query("t1_change_stream", """
    SELECT seq, candidate_key, fingerprint, CASE WHEN prev IS NULL THEN 'new' WHEN prev = fingerprint THEN 'unchanged' ELSE 'changed' END AS change,
           row_number() OVER (PARTITION BY candidate_key ORDER BY seq) AS seen_count
    FROM (SELECT *, lag(fingerprint) OVER (PARTITION BY candidate_key ORDER BY seq) AS prev FROM v_obs) x""")
def _(t):
    return jobs.run_in_parts(t.obs, _thirds(t.obs, "seq"), stateful.detect_changes_stream, "changes").select(
        "seq", "candidate_key", "fingerprint", "change", "seen_count")


@query("t1_queue_stream", NEXT_QUEUE_SQL)
def _(t):
    """The queue of T2, by a stream over three parts that starts from the stored state and queue."""
    events = jobs.run_in_parts(t.obs, _thirds(t.obs, "seq"), lambda s: stateful.queue_event_stream(s, t.state, t.versions), "queue")
    return stateful.queue_after(t.versions, events).select(
        "candidate_key", "fingerprint", "status", "attempts", "enqueued_at", "done_at", "payload_json")


@query("t9_lookup_stream", """
    WITH RECURSIVE o AS (
        SELECT CAST(user_id AS VARCHAR) AS external_id, ts AS asked_at, event_type = 'purchase' AS found,
               row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
    r AS (
        SELECT external_id, n, asked_at, CASE WHEN found THEN 'found' ELSE 'miss' END AS action,
               CASE WHEN NOT found THEN asked_at + INTERVAL 6 HOUR END AS until FROM o WHERE n = 1
        UNION ALL
        SELECT o.external_id, o.n, o.asked_at, CASE WHEN r.until > o.asked_at THEN 'skip' WHEN o.found THEN 'found' ELSE 'miss' END,
               CASE WHEN r.until > o.asked_at THEN r.until WHEN NOT o.found THEN o.asked_at + INTERVAL 6 HOUR END
        FROM r JOIN o ON o.external_id = r.external_id AND o.n = r.n + 1)
    SELECT external_id, asked_at, action FROM r""")
def _(t):
    lookups = t.table("events").selectExpr("CAST(user_id AS STRING) AS external_id", "ts AS asked_at", "event_type = 'purchase' AS found")
    out = jobs.run_in_parts(lookups, _thirds(lookups, "asked_at"), stateful.lookup_stream, "lookups")
    return out.select("external_id", F.col("asked_at").cast("timestamp_ntz").alias("asked_at"), "action")


_CUT = "2000-01-01"


@query("t6_revision_stream", f"""
    WITH shown AS (SELECT l.id, l.first_fetched_at, v.id IS NOT NULL AS seen FROM v_listings l LEFT JOIN (SELECT id FROM v_visible) v ON v.id = l.id),
    steps AS (SELECT 0 AS seq, first_fetched_at FROM shown
              UNION ALL SELECT 1, first_fetched_at FROM shown WHERE seen
              UNION ALL SELECT 2, first_fetched_at FROM shown WHERE seen AND first_fetched_at < TIMESTAMP '{{cut}}'),
    totals AS (SELECT seq, count(*) AS n, max(first_fetched_at) AS latest FROM steps GROUP BY 1)
    SELECT CAST(seq AS BIGINT) AS seq, translate(base64(unhex(sha256(concat(CAST(n AS VARCHAR), chr(0), strftime(latest,
           '%Y-%m-%dT%H:%M:%S.%g'), 'Z')))), '+/=', '-_') AS revision, n AS total_count FROM totals""".replace("{cut}", _CUT))
def _(t):
    """Everything appears; then what moderation hides goes; then all that was fetched since a day, the newest with it."""
    keys = t.listings.select(F.col("id").alias("listing_id"), "first_fetched_at")
    seen = t.visible.select(F.col("id").alias("listing_id"), F.lit(True).alias("seen"))
    step = lambda rows, k, shown: rows.select("listing_id", "first_fetched_at", F.lit(k).cast("bigint").alias("seq"), F.lit(shown).alias("visible"))
    rows = step(keys, 0, True).unionByName(step(keys.join(seen, "listing_id", "left_anti"), 1, False)).unionByName(
        step(keys.join(seen, "listing_id", "left_semi").filter(F.col("first_fetched_at") >= F.lit(_CUT).cast("timestamp_ntz")), 2, False))
    totals = jobs.run_in_parts(rows, [F.col("seq") == k for k in range(3)], stateful.revision_stream, "revision")
    return stateful.revision_after(totals, [0, 1, 2])


@query("t7_health_stream", """
    SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, CASE user_id % 3 WHEN 0 THEN 'reddit' WHEN 1 THEN 'instagram' ELSE 'facebook' END
           AS connector, event_type AS status, count(*) AS count, max(ts) AS latest FROM events GROUP BY 1, 2, 3""")
def _(t):
    records = _event_stream(t).selectExpr(
        "ts AS logged_at", "CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'reddit' WHEN 1 THEN 'instagram' ELSE 'facebook' END AS connector",
        "event_type AS status")
    base = scratch_path(t.spark, "health")

    def keep(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    # Update mode gives each changed count again; the latest row per group is the current one.
    jobs.run_log_health_stream(records).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.parquet(f"{base}/out/*")
    last = rows.groupBy("window_start", "connector", "status").agg(
        F.max_by(F.struct("count", "latest"), F.col("batch_id")).alias("l"))
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "connector", "status", "l.count",
                       F.col("l.latest").cast("timestamp_ntz").alias("latest"))


@query("t8_seen_filter_stream", "SELECT DISTINCT user_id AS identity FROM events")
def _(t):
    rows = _event_stream(t).selectExpr("user_id AS identity", "ts AS observed_at")
    return jobs.run_available(jobs.seen_filter_stream(rows, "40 days"), "seen").select("identity")


@query("t5_upsert_stream", """
    SELECT 'listings' AS part, count(*) AS rows, CAST(sum(price) AS BIGINT) AS total FROM v_listings WHERE platform <> 'reddit'
    UNION ALL SELECT 'images', count(*), CAST(sum(position) AS BIGINT) FROM v_images i JOIN v_listings l ON l.id = i.listing_id WHERE l.platform <> 'reddit'
    UNION ALL SELECT 'rejections', count(*), count(*) FROM v_listings WHERE platform = 'reddit'""")
def _(t):
    base = scratch_path(t.spark, "store")
    # A reviewed row carries its images, so that they are numbered once and no micro-batch reads those of the others.
    image = F.struct(*[c for c in t.images.columns if c not in ("id", "listing_id")])
    gallery = t.images.groupBy("listing_id").agg(F.collect_list(image).alias("images"))
    with shuffles_removed(t.spark):
        t.listings.join(gallery, F.col("id") == F.col("listing_id"), "left").drop("listing_id").write.option("compression", "zstd").parquet(f"{base}/in")
    reviewed = t.spark.read.parquet(f"{base}/in")
    # There are three micro-batches whatever the size of the input; buckets grow in number with it.
    files = len(reviewed.inputFiles())
    stream = t.spark.readStream.schema(reviewed.schema).option("maxFilesPerTrigger", max(4, -(-files // 3))).parquet(f"{base}/in")

    def split(batch):
        accepted, dropped = batch.filter("platform <> 'reddit'"), batch.filter("platform = 'reddit'")
        return accepted, None, dropped.withColumn("reason_code", F.lit("OTHER"))

    store = jobs.Store(f"{base}/tables", max(16, files))
    jobs.upsert_stream(stream, store, split, _FETCHED, f"{base}/checkpoint")
    part = lambda name, table, total: table.read(t.spark).agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"), total.alias("total"))
    return part("listings", store.listings, F.sum("price")).union(part("images", store.images, F.sum("position"))).union(
        part("rejections", store.rejections, F.sum("rejection_count")))
