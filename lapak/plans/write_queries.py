"""Contract, dedupe, merges and repairs: N5-N7, N14-N18, U1-U7, W2, W3, SNK1-SNK9, J7-J9, J13, P13-P16, A14, A19."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapak.functions import once
from lapak.operators import contract, media, moderation, ordering, queue, reconcile, sets, upsert
from lapak.plans.registry import query
from lapak.plans.views import AS_OF, LISTING_AS_OF, SQL_VIEWS, norm_sql
from lapak.schemas import CONTRACT_COLUMNS, REJECTION
from lapak.session import scratch_path
from lapak.sources.tables import apply_once
from lapak.streaming import jobs

# Raw connector rows with planted defects, one per listing.
SQL_VIEWS["v_contract"] = """
    SELECT seq, CASE WHEN seq % 23 = 0 THEN 'EBAY' ELSE concat(' ', platform) END AS platform,
           CASE WHEN seq % 31 = 0 THEN ' ' ELSE source_url END AS source_url,
           CASE WHEN brand IS NULL THEN '' ELSE external_id END AS external_id, title, description, category, brand,
           CASE WHEN price IS NULL THEN NULL WHEN seq % 37 = 0 THEN '12.5' WHEN seq % 41 = 0 THEN '-5'
                ELSE CAST(price AS VARCHAR) END AS price,
           location_texts, condition_text, seller_name, CASE WHEN seq % 29 = 0 THEN NULL ELSE upper(status) END AS status,
           CASE WHEN posted_at IS NULL THEN '' WHEN seq % 43 = 0 THEN 'yesterday'
                ELSE strftime(posted_at, '%Y-%m-%dT%H:%M:%SZ') END AS posted_at,
           CASE WHEN seq % 59 = 0 THEN NULL ELSE strftime(first_fetched_at + INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S.%f+07:00') END
                AS first_fetched_at,
           strftime(last_fetched_at, '%Y-%m-%d %H:%M:%S') AS last_fetched_at
    FROM v_listings"""
_PASSING = "seq % 23 <> 0 AND seq % 29 <> 0 AND seq % 31 <> 0 AND seq % 59 <> 0 AND (posted_at = '' OR seq % 43 <> 0) " \
           "AND (price IS NULL OR (seq % 37 <> 0 AND seq % 41 <> 0)) AND seq % 47 <> 0 AND seq % 53 <> 0"


def contract_rows(t):
    image = "named_struct('source_url', {url}, 'position', {pos}, 'alt_text', {alt})"
    first = image.format(url="CASE WHEN seq % 47 = 0 THEN ' ' ELSE concat(' ', source_url) END", pos="CAST(NULL AS STRING)",
                         alt="'  '")
    second = image.format(url="'https://a.example/2.jpg'", pos="CASE WHEN seq % 53 = 0 THEN 'x' ELSE '7' END", alt="title")
    return once.computed(t.listings, **dict(_named(
        "seq", "CASE WHEN seq % 23 = 0 THEN 'EBAY' ELSE concat(' ', platform) END AS platform",
        "CASE WHEN seq % 31 = 0 THEN ' ' ELSE source_url END AS source_url",
        "CASE WHEN brand IS NULL THEN '' ELSE external_id END AS external_id", "title", "description", "category", "brand",
        "CASE WHEN price IS NULL THEN NULL WHEN seq % 37 = 0 THEN '12.5' WHEN seq % 41 = 0 THEN '-5' "
        "ELSE CAST(price AS STRING) END AS price", "location_texts", "condition_text", "seller_name",
        "CASE WHEN seq % 29 = 0 THEN NULL ELSE upper(status) END AS status",
        "CASE WHEN posted_at IS NULL THEN '' WHEN seq % 43 = 0 THEN 'yesterday' "
        "ELSE date_format(posted_at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END AS posted_at",
        "CASE WHEN seq % 59 = 0 THEN NULL ELSE concat(date_format(first_fetched_at + INTERVAL '7' HOUR, "
        "\"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), '+07:00') END AS first_fetched_at",
        "date_format(last_fetched_at, 'yyyy-MM-dd HH:mm:ss') AS last_fetched_at",
        f"array({first}, {second}) AS images"))).select("seq", *CONTRACT_COLUMNS)


def _named(*expressions):
    for text in expressions:
        name = text.rsplit(" ", 1)[-1]
        yield name, F.expr(text.removesuffix(f" AS {name}"))


@query("n5_contract_valid", f"""
    SELECT seq, upper(trim(platform)) AS platform, source_url, nullif(external_id, '') AS external_id, title,
           CAST(price AS BIGINT) AS price, trim(seller_name) AS seller_name, status,
           CASE WHEN posted_at <> '' THEN CAST(replace(posted_at, 'Z', '') AS TIMESTAMP) END AS posted_at,
           CAST(left(first_fetched_at, 26) AS TIMESTAMP) - INTERVAL 7 HOUR AS first_fetched_at,
           concat(source_url, ' 0 -|https://a.example/2.jpg 7 ', trim(title)) AS images
    FROM v_contract WHERE {_PASSING}""")
def _(t):
    valid, _ = contract.validate_contract(contract_rows(t))
    shown = F.array_join(F.transform("images", lambda i: F.concat_ws(
        " ", i["source_url"], i["position"].cast("string"), F.coalesce(i["alt_text"], F.lit("-")))), "|")
    return valid.select("seq", "platform", "source_url", "external_id", "title", "price", "seller_name", "status",
                        "posted_at", "first_fetched_at", shown.alias("images"))


@query("n5_contract_invalid", f"""
    SELECT seq, source_url, concat(coalesce(nullif(external_id, ''), nullif(trim(source_url), ''), '<unknown>'), ': ', concat_ws('; ',
        CASE WHEN seq % 23 = 0 THEN 'platform must be REDDIT, INSTAGRAM, FACEBOOK, or FACEBOOK_GROUP' END,
        CASE WHEN status IS NULL THEN 'status must be AVAILABLE, SOLD, or UNKNOWN' END,
        CASE WHEN trim(source_url) = '' THEN 'sourceUrl is required' END,
        CASE WHEN first_fetched_at IS NULL THEN 'firstFetchedAt is required' END,
        CASE WHEN posted_at = 'yesterday' THEN 'postedAt must be an ISO datetime string or null' END,
        CASE WHEN price = '12.5' THEN 'price must be an integer or null' END,
        CASE WHEN price = '-5' THEN 'price must be zero or greater' END,
        CASE WHEN seq % 47 = 0 THEN 'images[0].sourceUrl is required' END,
        CASE WHEN seq % 53 = 0 THEN 'images[1].position must be an integer' END)) AS error
    FROM v_contract WHERE NOT ({_PASSING})""")
def _(t):
    _, invalid = contract.validate_contract(contract_rows(t))
    return invalid.select("seq", "source_url", "error")


# The same listings as JSON lines, with values of other types planted.
_IMAGE_AT = """concat('{"sourceUrl":"https://a.example/1.jpg"}',
    CASE WHEN seq % 71 = 0 THEN ',"https://a.example/2.jpg"' WHEN seq % 73 = 0 THEN ',{"sourceUrl":"u","position":null}'
         WHEN seq % 79 = 0 THEN ',{"sourceUrl":"u","position":true}' WHEN seq % 83 = 0 THEN ',{"sourceUrl":"u","position":"3"}'
         ELSE ',{"sourceUrl":" https://a.example/2.jpg ","position":7,"altText":12}' END)"""
_BODY = f"""concat('{{"platform":"', upper(platform), '","sourceUrl":"', source_url, '","externalId":', seq, ',"title":',
    CASE WHEN seq % 89 = 0 THEN '12' ELSE concat('"', title, '"') END, ',"description":"d","price":',
    CASE WHEN seq % 101 = 0 THEN 'true' WHEN seq % 103 = 0 THEN '12.0' ELSE coalesce(CAST(price AS STRING), 'null') END,
    ',"locationTexts":', CASE WHEN seq % 61 = 0 THEN '"Kota"' ELSE '["Kota ", 5, " ", null]' END,
    ',"status":"', upper(status), '","postedAt":', CASE WHEN seq % 97 = 0 THEN '5' ELSE 'null' END,
    ',"firstFetchedAt":"2001-01-01T00:00:00Z","lastFetchedAt":"2001-01-02T00:00:00+01:00","images":',
    CASE WHEN seq % 67 = 0 THEN '{{"sourceUrl":"u"}}' ELSE concat('[', {_IMAGE_AT}, ']') END, '}}')"""


@query("n5_contract_json", """
    SELECT seq, CASE WHEN seq % 107 = 0 THEN 'listing must be an object' WHEN e <> '' THEN concat(seq, ': ', e) ELSE concat(
        CASE WHEN seq % 89 = 0 THEN '12' ELSE trim(title) END, '|Kota|0 https://a.example/1.jpg -|7 https://a.example/2.jpg 12') END AS said
    FROM (SELECT seq, title, concat_ws('; ', CASE WHEN seq % 97 = 0 THEN 'postedAt must be an ISO datetime string or null' END,
            CASE WHEN seq % 101 = 0 OR seq % 103 = 0 THEN 'price must be an integer or null' END,
            CASE WHEN seq % 61 = 0 THEN 'locationTexts must be a string array' END, CASE WHEN seq % 67 = 0 THEN 'images must be an array'
                 WHEN seq % 71 = 0 THEN 'images[1] must be an object' WHEN seq % 73 = 0 OR seq % 79 = 0 OR seq % 83 = 0
                 THEN 'images[1].position must be an integer' END) AS e FROM v_listings) x""")
def _(t):
    body = F.expr(f"CASE WHEN seq % 214 = 0 THEN '[1, 2]' WHEN seq % 107 = 0 THEN '{{broken' ELSE {_BODY} END")
    valid, invalid = contract.validate_contract(contract.contract_of_json(t.listings.select("seq", body.alias("value"))))
    image = lambda i: F.concat_ws(" ", i["position"].cast("string"), i["source_url"], F.coalesce(i["alt_text"], F.lit("-")))
    shown = F.concat_ws("|", "title", F.array_join("location_texts", ","), F.array_join(F.transform("images", image), "|"))
    return valid.select("seq", shown.alias("said")).unionByName(invalid.select("seq", F.col("error").alias("said")))


@query("n6_storage_rows", f"""
    SELECT left(sha256(source_url), 32) AS id, lower(trim(platform)) AS platform, source_url, nullif(external_id, '') AS external_id,
           CAST(price AS INTEGER) AS price, array_to_string(location_texts, '|') AS location_texts, trim(seller_name) AS seller_name,
           lower(status) AS status, CAST(left(first_fetched_at, 26) AS TIMESTAMP) - INTERVAL 7 HOUR AS first_fetched_at
    FROM v_contract WHERE {_PASSING}""")
def _(t):
    valid, _ = contract.validate_contract(contract_rows(t))
    rows = contract.coerce_storage_row(valid)
    return rows.select("id", "platform", "source_url", "external_id", "price",
                       F.array_join("location_texts", "|").alias("location_texts"), "seller_name", "status", "first_fetched_at")


@query("n7_attach_source_facts", """
    SELECT l.seq, max_by(r.l_shipmode, r.n) AS fact FROM v_listings l LEFT JOIN (
        SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS id, concat(l_returnflag, l_linestatus) AS l_shipmode,
               row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) AS n
        FROM lineitem) r ON r.id = l.id GROUP BY l.seq""")
def _(t):
    # Every order line is one raw observation of the listing; the last one in line order carries the facts.
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    raw = t.table("lineitem").select(
        F.col("l_orderkey").cast("string").alias("external_id"), F.lit(None).cast("string").alias("source_url"),
        line.alias("seq"), F.create_map(F.lit("mode"), F.concat("l_returnflag", "l_linestatus")).alias("source_facts"))
    valid = t.listings.select(F.col("seq"), F.col("seq").cast("string").alias("external_id"), "source_url")
    return contract.attach_source_facts(valid, raw).select("seq", F.col("source_facts")["mode"].alias("fact"))


# Merges ------------------------------------------------------------------------------------------------------------

# The store holds what was collected before 1998; the batch re-observes every listing, sold ones twice.
SQL_VIEWS["v_store"] = "SELECT * FROM v_listings WHERE first_fetched_at < TIMESTAMP '1998-01-01 00:00:00'"
SQL_VIEWS["v_batch"] = """
    SELECT seq * 2 AS batch_seq, source_url, id, title, price + 1 AS price, 'unknown' AS status, posted_at, first_fetched_at,
           last_fetched_at + INTERVAL 1 DAY AS last_fetched_at FROM v_listings
    UNION ALL
    SELECT seq * 2 + 1, source_url, id, concat(title, ' (2)'), price + 2, 'sold', NULL, first_fetched_at,
           last_fetched_at + INTERVAL 2 DAY FROM v_listings WHERE status = 'sold'"""


def store(t):
    return t.listings.filter("first_fetched_at < TIMESTAMP_NTZ '1998-01-01 00:00:00'").drop("seq")


def batch(t):
    first = t.listings.withColumns({
        "seq": F.expr("seq * 2"), "price": F.expr("price + 1"), "status": F.lit("unknown"),
        "last_fetched_at": F.expr("last_fetched_at + INTERVAL '1' DAY")})
    again = t.listings.filter("status = 'sold'").withColumns({
        "seq": F.expr("seq * 2 + 1"), "title": F.expr("concat(title, ' (2)')"), "price": F.expr("price + 2"),
        "status": F.lit("sold"), "posted_at": F.lit(None).cast("timestamp_ntz"),
        "last_fetched_at": F.expr("last_fetched_at + INTERVAL '2' DAY")})
    return first.unionByName(again)


_UPSERTED_SQL = f"""
    SELECT coalesce(s.id, b.id) AS id, b.source_url, b.title, b.price, b.status, b.posted_at,
           coalesce(s.first_fetched_at, b.first_fetched_at) AS first_fetched_at, b.last_fetched_at,
           coalesce(s.created_at, TIMESTAMP '{LISTING_AS_OF}') AS created_at, TIMESTAMP '{LISTING_AS_OF}' AS updated_at
    FROM (SELECT * FROM v_batch QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY batch_seq DESC) = 1) b
    LEFT JOIN v_store s ON s.source_url = b.source_url"""
_UPSERTED = ("id", "source_url", "title", "price", "status", "posted_at", "first_fetched_at", "last_fetched_at", "created_at", "updated_at")


@query("snk1_upsert_listings", _UPSERTED_SQL)
def _(t):
    after, _ = upsert.upsert_listings(store(t), batch(t), LISTING_AS_OF)
    return after.select(*_UPSERTED)


@query("snk1_upsert_buckets", _UPSERTED_SQL)
def _(t):
    """The same merge into a bucketed table: what is stored is staged and put in place, then the batch."""
    target = jobs.Store(scratch_path(t.spark, "buckets"), 16).listings
    for name, rows in (("stored", store(t)), ("batch", batch(t))):
        held, to = target.folders(t.spark, rows.select("source_url"))
        after = rows if name == "stored" else upsert.upsert_listings(target.read(t.spark, held), rows, LISTING_AS_OF)[0]
        apply_once(t.spark, f"{target.path}-batches", name, lambda folder: target.stage(after, held, to, folder),  # noqa: B023
             lambda folder: target.replace(t.spark, folder))
    return target.read(t.spark).select(*_UPSERTED)


@query("snk1_upsert_summary", """
    SELECT CAST(sum(n) AS BIGINT) AS requested, count(*) AS deduplicated, CAST(sum(n - 1) AS BIGINT) AS duplicates,
           count(*) FILTER (WHERE s.source_url IS NULL) AS inserted, count(*) FILTER (WHERE s.source_url IS NOT NULL) AS updated
    FROM (SELECT source_url, count(*) AS n FROM v_batch GROUP BY 1) b LEFT JOIN v_store s ON s.source_url = b.source_url""")
def _(t):
    return upsert.upsert_listings(store(t), batch(t), LISTING_AS_OF)[1]


# New gallery of every sold listing: each image again, its URL with other parameters, plus a rewritten position 0.
SQL_VIEWS["v_new_images"] = """
    SELECT i.listing_id, concat(i.source_url, CASE WHEN contains(i.source_url, '?') THEN '&v=2' ELSE '?v=2' END) AS source_url,
           i.position, i.alt_text, 1 AS seq FROM v_images i JOIN v_listings l ON l.id = i.listing_id WHERE l.status = 'sold'
    UNION ALL
    SELECT l.id, concat('https://a.example/', l.id, '.jpg'), 0, 'again', 2 FROM v_listings l WHERE l.status = 'sold' AND l.brand IS NULL"""


def new_images(t):
    sold = t.listings.filter("status = 'sold'")
    none = {c: F.lit(None) for c in ("cached_url", "storage_key", "content_hash", "content_type", "byte_size", "cached_at")}
    tail = F.when(F.col("source_url").contains("?"), F.lit("&v=2")).otherwise(F.lit("?v=2"))
    # Filtered as replace_images filters, for the shuffle they share.
    owned = t.images.filter("listing_id is not null")
    first = owned.join(sold.select(F.col("id").alias("listing_id")), "listing_id", "left_semi").select(
        "listing_id", F.concat("source_url", tail).alias("source_url"), "position", "alt_text", F.lit(1).alias("seq"))
    again = sold.filter("brand is null").select(
        F.col("id").alias("listing_id"), F.concat(F.lit("https://a.example/"), "id", F.lit(".jpg")).alias("source_url"),
        F.lit(0).alias("position"), F.lit("again").alias("alt_text"), F.lit(2).alias("seq"))
    kinds = {f.name: f.dataType for f in t.images.schema.fields}
    return first.unionByName(again).withColumns({c: v.cast(kinds[c]) for c, v in none.items()})


@query("snk2_replace_images", """
    SELECT i.listing_id, i.position, i.source_url, i.cached_url, i.content_hash, i.alt_text FROM v_images i
    JOIN v_listings l ON l.id = i.listing_id WHERE l.status <> 'sold'
    UNION ALL
    SELECT n.listing_id, n.position, n.source_url, o.cached_url, o.content_hash, n.alt_text FROM (
        SELECT * FROM v_new_images QUALIFY row_number() OVER (PARTITION BY listing_id, position ORDER BY seq DESC) = 1) n
    LEFT JOIN v_images o ON o.listing_id = n.listing_id AND o.position = n.position
         AND regexp_extract(o.source_url, '^[^?]*') = regexp_extract(n.source_url, '^[^?]*')""")
def _(t):
    touched = t.listings.filter("status = 'sold'").select(F.col("id").alias("listing_id"))
    after, _ = upsert.replace_images(t.images, new_images(t), touched)
    return after.select("listing_id", "position", "source_url", "cached_url", "content_hash", "alt_text")


@query("snk2_image_summary", """
    SELECT (SELECT count(*) FROM v_images i JOIN v_listings l ON l.id = i.listing_id WHERE l.status = 'sold') AS images_deleted,
           (SELECT count(*) FROM (SELECT DISTINCT listing_id, position FROM v_new_images) x) AS images_inserted""")
def _(t):
    touched = t.listings.filter("status = 'sold'").select(F.col("id").alias("listing_id"))
    return upsert.replace_images(t.images, new_images(t), touched)[1]


# Ledger from customers; every order line is one rejection of its part's page.
SQL_VIEWS["v_ledger"] = """
    SELECT concat('r', CAST(c_custkey AS VARCHAR)) AS id, 'reddit' AS platform,
           concat('https://www.reddit.com/p/', CAST(c_custkey AS VARCHAR)) AS source_url, c_name AS title,
           TIMESTAMP '2000-01-01 00:00:00' AS first_rejected_at, CAST(c_nationkey + 1 AS BIGINT) AS rejection_count FROM customer"""
SQL_VIEWS["v_rejected"] = """
    SELECT concat('https://www.reddit.com/p/', CAST(l_partkey AS VARCHAR)) AS source_url,
           concat('line ', CAST(l_linenumber AS VARCHAR), ' of ', CAST(l_orderkey AS VARCHAR)) AS title,
           l_orderkey * 100 + l_linenumber AS seq FROM lineitem"""


def ledger(t):
    none = F.lit(None).cast("string")
    return t.table("customer").select(
        F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("id"), F.lit("reddit").alias("platform"),
        F.concat(F.lit("https://www.reddit.com/p/"), F.col("c_custkey").cast("string")).alias("source_url"),
        none.alias("external_id"), F.col("c_name").alias("title"), F.lit("old").alias("description"), none.alias("seller_name"),
        F.lit("OTHER").alias("reason_code"), F.lit("2000-01-01").cast("timestamp_ntz").alias("first_rejected_at"),
        F.lit("2000-01-01").cast("timestamp_ntz").alias("last_rejected_at"),
        (F.col("c_nationkey") + 1).cast("bigint").alias("rejection_count")).select(*REJECTION.fieldNames())


def rejected(t):
    none = F.lit(None).cast("string")
    title = F.expr("concat('line ', CAST(l_linenumber AS STRING), ' of ', CAST(l_orderkey AS STRING))")
    return t.table("lineitem").select(
        F.lit("reddit").alias("platform"),
        F.concat(F.lit("https://www.reddit.com/p/"), F.col("l_partkey").cast("string")).alias("source_url"),
        none.alias("external_id"), title.alias("title"), F.lit("new").alias("description"), none.alias("seller_name"),
        F.lit("NOT_A_LISTING").alias("reason_code"), F.expr("l_orderkey * 100 + l_linenumber").alias("seq"))


_LEDGER_AFTER = f"""
    SELECT coalesce(l.id, left(sha256(b.source_url), 32)) AS id, coalesce(l.source_url, b.source_url) AS source_url,
           coalesce(b.title, l.title) AS title, CASE WHEN b.n IS NULL THEN 'OTHER' ELSE 'NOT_A_LISTING' END AS reason_code,
           coalesce(l.first_rejected_at, TIMESTAMP '{LISTING_AS_OF}') AS first_rejected_at,
           CASE WHEN b.n IS NULL THEN TIMESTAMP '2000-01-01 00:00:00' ELSE TIMESTAMP '{LISTING_AS_OF}' END AS last_rejected_at,
           coalesce(l.rejection_count, 0) + coalesce(b.n, 0) AS rejection_count
    FROM v_ledger l FULL OUTER JOIN (SELECT source_url, count(*) AS n, max_by(title, seq) AS title FROM v_rejected GROUP BY 1) b
         ON b.source_url = l.source_url"""


@query("snk3_upsert_rejections", _LEDGER_AFTER)
def _(t):
    return upsert.upsert_rejections(ledger(t), rejected(t), LISTING_AS_OF).select(
        "id", "source_url", "title", "reason_code", "first_rejected_at", "last_rejected_at", "rejection_count")


@query("snk4_clear_rejections", f"""
    SELECT source_url, rejection_count FROM ({_LEDGER_AFTER}) x WHERE source_url NOT IN (
        SELECT concat('https://www.reddit.com/p/', CAST(s_suppkey AS VARCHAR)) FROM supplier)""")
def _(t):
    accepted = t.table("supplier").select(
        F.concat(F.lit("https://www.reddit.com/p/"), F.col("s_suppkey").cast("string")).alias("source_url"))
    after = upsert.upsert_rejections(ledger(t), rejected(t), LISTING_AS_OF)
    return upsert.clear_rejections(after, accepted).select("source_url", "rejection_count")


@query("snk5_update_reconciled", f"""
    SELECT l.id, CASE WHEN hit AND l.price IS NULL THEN 'sold' ELSE l.status END AS status,
           CASE WHEN hit THEN TIMESTAMP '{LISTING_AS_OF}' ELSE l.last_fetched_at END AS last_fetched_at,
           CASE WHEN hit AND l.price IS NULL THEN TIMESTAMP '{LISTING_AS_OF}' ELSE l.updated_at END AS updated_at
    FROM (SELECT l.*, l.platform = 'facebook' AND l.status IN ('available', 'unknown') AND l.brand IS NOT NULL
          AND v.id IS NOT NULL AS hit FROM v_listings l LEFT JOIN v_visible v ON v.id = l.id) l""")
def _(t):
    evidence = t.listings.select(
        "source_url", F.when(F.col("price").isNull(), F.lit("sold")).alias("status"), F.col("brand").isNotNull().alias("checked"))
    after = upsert.update_reconciled(t.listings, evidence, t.visible.select("id"), "facebook", LISTING_AS_OF)
    return after.select("id", "status", "last_fetched_at", "updated_at")


@query("snk6_update_media_cache", """
    SELECT id, coalesce(cached_url, 'https://media.example.com/new') AS cached_url, CASE WHEN cached_url IS NULL THEN 'h' ELSE content_hash END
        AS content_hash, coalesce(byte_size, 5) AS byte_size FROM v_images""")
def _(t):
    cached = t.images.select(
        "id", F.lit("https://media.example.com/new").alias("cached_url"), F.lit("k").alias("storage_key"),
        F.lit("h").alias("content_hash"), F.lit("image/png").alias("content_type"), F.lit(5).cast("bigint").alias("byte_size"),
        F.lit("2001-01-01").cast("timestamp_ntz").alias("cached_at"))
    return upsert.update_media_cache(t.images, cached).select("id", "cached_url", "content_hash", "byte_size")


@query("snk9_write_listings", "SELECT id, price, array_to_string(location_texts, '|') AS location_texts FROM v_listings")
def _(t):
    from lapak.session import scratch_path
    from lapak.sources.tables import write_listings

    path = scratch_path(t.spark, "listings")
    write_listings(t.listings, path)
    back = t.spark.read.schema("id string, price int, location_texts array<string>").json(path)
    return back.select("id", "price", F.array_join("location_texts", "|").alias("location_texts"))


# Dedupe and sets ---------------------------------------------------------------------------------------------------

@query("w2_dedupe_last", """
    SELECT source_url, title, price, batch_seq AS seq FROM v_batch
    QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY batch_seq DESC) = 1""")
def _(t):
    return ordering.dedupe_last(batch(t), "source_url", "seq").select("source_url", "title", "price", "seq")


@query("w3_dedupe_first", """
    SELECT source_url, title, price, batch_seq AS seq FROM v_batch
    QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY batch_seq) = 1""")
def _(t):
    return ordering.dedupe_first(batch(t), "source_url", "seq").select("source_url", "title", "price", "seq")


@query("u1_union_connectors", """
    SELECT id, title, NULL AS brand FROM v_listings WHERE platform = 'reddit'
    UNION ALL SELECT id, NULL, brand FROM v_listings WHERE platform <> 'reddit'""")
def _(t):
    return sets.union_connectors([t.listings.filter("platform = 'reddit'").select("id", "title"),
                                  t.listings.filter("platform <> 'reddit'").select("id", "brand")])


@query("u2_batch_counts", """
    SELECT CAST(sum(n) AS BIGINT) AS requested, count(*) AS deduplicated, CAST(sum(n - 1) AS BIGINT) AS duplicates
    FROM (SELECT source_url, count(*) AS n FROM v_batch GROUP BY 1) x""")
def _(t):
    return sets.dedupe_batch(batch(t))[1]


@query("u3_identity_dedupe", """
    SELECT category AS identity, seq FROM v_listings WHERE category IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY seq) = 1""")
def _(t):
    rows = t.listings.select(F.coalesce("category", F.lit("")).alias("identity"), "seq")
    return ordering.dedupe_first(rows, "identity", "seq")


@query("u4_post_dedupe", """
    SELECT post_id AS identity, seq FROM (SELECT regexp_extract(external_id, '[0-9]+$') AS post_id, seq FROM v_listings
        WHERE platform = 'reddit') x
    UNION ALL SELECT '', seq FROM v_listings WHERE platform = 'facebook'
    UNION ALL SELECT brand, min(seq) FROM v_listings WHERE platform NOT IN ('reddit', 'facebook') AND brand IS NOT NULL GROUP BY brand
    UNION ALL SELECT '', seq FROM v_listings WHERE platform NOT IN ('reddit', 'facebook') AND brand IS NULL""")
def _(t):
    url = F.when(F.col("platform") == "reddit", F.col("source_url"))
    atom = F.when(~F.col("platform").isin("reddit", "facebook"), F.concat("brand", F.lit("#")))
    posts = t.listings.select(url.alias("url"), atom.alias("atom_id"), "seq")
    twice = posts.unionByName(posts.filter("url is not null").withColumn("seq", F.col("seq") + 10**12))
    return sets.dedupe_posts(twice).select(F.regexp_replace("identity", "#$", "").alias("identity"), "seq")


@query("u5_page_merge", """
    SELECT source_url, first_seq, title FROM (SELECT source_url, min(batch_seq) AS first_seq, max_by(title, batch_seq) AS title
        FROM v_batch GROUP BY 1) x""")
def _(t):
    return ordering.first_seen_order(batch(t), "source_url", "seq").select("source_url", "first_seq", "title")


_SEEN = "SELECT CAST(user_id AS VARCHAR) AS value, max(ts) AS seen_at FROM events GROUP BY 1"


@query("o9_recent_ids", f"SELECT value, seen_at FROM ({_SEEN}) x ORDER BY seen_at DESC, value LIMIT 50")
def _(t):
    seen = t.table("events").select(F.col("user_id").cast("string").alias("value"), F.col("ts").alias("seen_at"))
    return ordering.recent_ids(seen, 50)


@query("u6_merge_seen", """
    SELECT value, max(seen_at) AS seen_at FROM (
        SELECT CAST(user_id AS VARCHAR) AS value, ts AS seen_at FROM events
        UNION ALL SELECT event_type, ts + INTERVAL 30 DAY FROM events) x GROUP BY 1 ORDER BY seen_at DESC, value LIMIT 50""")
def _(t):
    events = t.table("events")
    old = events.select(F.col("user_id").cast("string").alias("value"), F.col("ts").alias("seen_at"))
    fresh = events.select(F.col("event_type").alias("value"), F.expr("ts + INTERVAL '30' DAY").alias("seen_at"))
    return ordering.merge_seen(old, fresh, 50)


@query("u7_missing_members", """
    SELECT CAST(c_custkey AS VARCHAR) AS member FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def _(t):
    required = t.table("customer").select(F.col("c_custkey").cast("string").alias("member"))
    observed = t.table("events").select(F.col("user_id").cast("string").alias("member"))
    return sets.missing_members(required, observed, "member")


_NEW = """SELECT id FROM v_listings WHERE external_id NOT IN (SELECT CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'view')
    AND source_url NOT IN (SELECT concat('https://www.instagram.com/p/', CAST(event_id AS VARCHAR), '/') FROM events
                           WHERE event_type = 'click')"""


def seen(t):
    events = t.table("events")
    ids = events.filter("event_type = 'view'").select(F.col("event_id").cast("string").alias("value"))
    links = events.filter("event_type = 'click'").select(F.concat(
        F.lit("https://www.instagram.com/p/"), F.col("event_id").cast("string"), F.lit("/")).alias("value"))
    return ids, links


@query("p13_new_listings", _NEW)
def _(t):
    return sets.new_listings(t.listings, *seen(t)).select("id")


@query("p14_needs_detail", f"SELECT 'new' AS scope, id FROM ({_NEW}) x UNION ALL SELECT 'all', id FROM v_listings")
def _(t):
    fresh = sets.needs_detail(t.listings, *seen(t)).select(F.lit("new").alias("scope"), "id")
    return fresh.union(sets.needs_detail(t.listings, *seen(t), scope="all").select(F.lit("all"), "id"))


@query("j13_seen_membership", """
    SELECT id FROM v_listings WHERE external_id NOT IN (SELECT CAST(event_id * 3 AS VARCHAR) FROM events)
      AND source_url NOT IN (SELECT concat('https://shop.example/item/', l_partkey) FROM lineitem)""")
def _(t):
    ids = t.table("events").select((F.col("event_id") * 3).cast("string").alias("value"))
    urls = t.table("lineitem").select(F.concat(F.lit("https://shop.example/item/"), F.col("l_partkey").cast("string")).alias("value"))
    return sets.new_listings(t.listings, ids, urls).select("id")


# Moderation --------------------------------------------------------------------------------------------------------

_EVENTS = f"""SELECT {norm_sql("coalesce(nullif(json_extract_string(details, '$.sellerName'), ''), entity_id)")} AS name,
        list_sort(list(DISTINCT json_extract_string(details, '$.platform')) FILTER (
            WHERE json_extract_string(details, '$.platform') IN ('facebook', 'facebook_group'))) AS event_platforms
    FROM v_mod_events WHERE action IN ('block_seller', 'admin_backfill') OR entity_type = 'facebook_seller' GROUP BY 1"""
_STORED = f"""SELECT {norm_sql('coalesce(m.seller_name_override, l.seller_name)')} AS name,
        list_sort(list(DISTINCT l.platform)) AS stored_platforms
    FROM v_listings l LEFT JOIN v_moderation m ON m.listing_id = l.id
    WHERE l.platform IN ('facebook', 'facebook_group') AND trim(coalesce(m.seller_name_override, l.seller_name, '')) <> '' GROUP BY 1"""


@query("n14_resolve_seller_platform", f"""
    SELECT f.id, f.normalized_seller_name, f.source, CASE WHEN f.source = 'auto' THEN 'facebook'
        WHEN len(e.event_platforms) = 1 THEN e.event_platforms[1] WHEN len(s.stored_platforms) = 1 THEN s.stored_platforms[1] END AS platform
    FROM v_legacy f LEFT JOIN ({_EVENTS}) e ON e.name = f.normalized_seller_name
    LEFT JOIN ({_STORED}) s ON s.name = f.normalized_seller_name""")
def _(t):
    return moderation.resolve_legacy_seller_platform(t.legacy, t.mod_events, t.listings, t.moderation).select(
        "id", "normalized_seller_name", "source", "platform")


@query("j7_seller_evidence", f"""
    SELECT f.id, coalesce(array_to_string(e.event_platforms, '|'), '') AS event_platforms,
           coalesce(array_to_string(s.stored_platforms, '|'), '') AS stored_platforms
    FROM v_legacy f LEFT JOIN ({_EVENTS}) e ON e.name = f.normalized_seller_name
    LEFT JOIN ({_STORED}) s ON s.name = f.normalized_seller_name""")
def _(t):
    rows = t.legacy.join(moderation.event_platforms(t.mod_events), "normalized_seller_name", "left").join(
        moderation.stored_platforms(t.listings, t.moderation), "normalized_seller_name", "left")
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)
    return rows.select("id", joined("event_platforms"), joined("stored_platforms"))


@query("n15_flag_constraints", f"""
    SELECT id, violations FROM (SELECT f.id, concat_ws('|',
        CASE WHEN length(trim(seller_name)) NOT BETWEEN 1 AND 120 THEN 'seller_name length' END,
        CASE WHEN normalized_seller_name <> {norm_sql('seller_name')} THEN 'normalized_seller_name' END,
        CASE WHEN length(reason) > 500 THEN 'reason length' END,
        CASE WHEN recent_listing_count < 0 THEN 'recent_listing_count' END,
        CASE WHEN duplicate_listing_count < 0 THEN 'duplicate_listing_count' END,
        CASE WHEN duplicate_ratio NOT BETWEEN 0 AND 1 THEN 'duplicate_ratio' END,
        CASE WHEN platform NOT IN ('facebook', 'facebook_group') THEN 'platform' END,
        CASE WHEN count(*) OVER (PARTITION BY platform, normalized_seller_name) > 1 THEN 'unique platform and name' END) AS violations
      FROM v_flag_rows f) x WHERE violations <> ''""")
def _(t):
    return moderation.check_flag_constraints(t.flag_rows).select("id", F.array_join("violations", "|").alias("violations"))


@query("n16_fill_seller_names", """
    SELECT l.id, CASE WHEN l.seller_name IS NULL AND c.c_custkey IS NOT NULL THEN c.c_name ELSE l.seller_name END AS seller_name
    FROM v_listings l LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = l.external_id""")
def _(t):
    names = t.table("customer").select(F.col("c_custkey").cast("string").alias("external_id"),
                                       F.concat(F.lit(" "), "c_name", F.lit("\n")).alias("name"))
    return moderation.fill_seller_names(t.listings, names).select("id", "seller_name")


@query("a13_seller_duplicates", f"""
    SELECT 'facebook' AS platform, s.name AS normalized_seller_name, s.recent AS recent_listing_count,
           s.dup AS duplicate_listing_count, round_even(s.dup / s.recent, 4) AS duplicate_ratio,
           s.recent >= 5 AND s.dup >= 4 AND s.dup / s.recent >= 0.7 AND k.name IS NULL AS flagged,
           CASE WHEN s.recent >= 5 AND s.dup >= 4 AND s.dup / s.recent >= 0.7 AND k.name IS NULL THEN 'blocked' END AS new_status
    FROM (SELECT name, CAST(sum(n) AS BIGINT) AS recent, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS dup FROM (
            SELECT {norm_sql('coalesce(m.seller_name_override, l.seller_name)')} AS name, {norm_sql('l.title')} AS title,
                   {norm_sql('l.description')} AS body, count(*) AS n
            FROM v_listings l LEFT JOIN v_moderation m ON m.listing_id = l.id
            WHERE l.platform = 'facebook' AND l.first_fetched_at >= TIMESTAMP '{LISTING_AS_OF}' - INTERVAL 2400 DAY
              AND l.first_fetched_at <= TIMESTAMP '{LISTING_AS_OF}' GROUP BY 1, 2, 3) x
          WHERE coalesce(name, '') <> '' GROUP BY name) s
    LEFT JOIN (SELECT DISTINCT normalized_seller_name AS name FROM v_flags WHERE platform = 'facebook'
               AND (status = 'allowlisted' OR source = 'manual')) k ON k.name = s.name""")
def _(t):
    return moderation.seller_duplicate_stats(t.listings, t.moderation, t.flags, LISTING_AS_OF, window_days=2400)


# Media -------------------------------------------------------------------------------------------------------------

@query("j8_images_with_owner", """
    SELECT i.id, o.platform, o.external_id, o.first_fetched_at FROM v_images i JOIN v_listings o ON o.id = i.listing_id""")
def _(t):
    return media.images_with_owner(t.images, t.listings).select("id", "platform", "external_id", "first_fetched_at")


@query("p16_pending_media", """
    SELECT i.id, i.source_url, CASE WHEN l.platform = 'facebook_group' THEN 'facebook_groups' ELSE l.platform END AS media_platform
    FROM v_images i JOIN v_listings l ON l.id = i.listing_id
    WHERE (l.platform IN ('instagram', 'reddit', 'facebook_group') OR (l.platform = 'facebook'
           AND l.first_fetched_at >= TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 24 HOUR)) AND i.cached_url IS NULL
      AND i.id > '000000000100' ORDER BY i.id LIMIT 500""")
def _(t):
    return media.pending_media(t.images, t.listings, "2000-01-01 00:00:00", "000000000100", 500)


@query("t10_rolling_window", """
    SELECT i.id FROM v_images i JOIN v_listings l ON l.id = i.listing_id WHERE l.platform = 'facebook' AND i.cached_url IS NULL
      AND l.first_fetched_at >= TIMESTAMP '1999-01-01 00:00:00' - INTERVAL 24 HOUR""")
def _(t):
    only = t.listings.filter("platform = 'facebook'")
    return media.pending_media(t.images, only, "1999-01-01 00:00:00", "", None).select("id")


@query("a14_single_cover_groups", """
    SELECT l.id AS listing_id, l.external_id, i.source_url FROM v_listings l JOIN v_images i ON i.listing_id = l.id
    WHERE l.platform = 'instagram' AND l.first_fetched_at >= TIMESTAMP '1997-01-01 00:00:00' AND l.id > '000000000050'
    GROUP BY l.id, l.external_id, i.source_url HAVING count(i.id) = 1 AND min(i.position) = 0
    ORDER BY l.id, i.source_url LIMIT 1000""")
def _(t):
    return media.single_cover_groups(t.listings, t.images, "1997-01-01 00:00:00", "000000000050", 1000)


@query("a19_media_summary", """
    SELECT count(*) AS selected, count(*) FILTER (WHERE s = 'u') AS updated, count(*) FILTER (WHERE s = 'u' AND NOT reused) AS cached,
           count(*) FILTER (WHERE s = 'u' AND reused) AS reused, count(*) FILTER (WHERE s = 'f') AS failed,
           count(*) FILTER (WHERE s = 's') AS skipped
    FROM (SELECT CASE WHEN starts_with(i.source_url, 'http://') THEN 'f' WHEN i.cached_url IS NOT NULL THEN 's' ELSE 'u' END AS s,
                 sha256(i.source_url) IN (SELECT sha256(concat('https://scontent.fbcdn.net/v/', CAST(p_partkey AS VARCHAR), '.jpg'))
                     FROM part WHERE p_size > 25) OR i.id <> min(i.id) OVER (PARTITION BY i.source_url) AS reused FROM v_images i) x""")
def _(t):
    ok = ~F.col("source_url").startswith("http://")
    downloads = t.images.select("id", F.when(ok, F.sha2("source_url", 256)).alias("storage_key"))
    stored = t.table("part").filter("p_size > 25").select(F.sha2(F.concat(
        F.lit("https://scontent.fbcdn.net/v/"), F.col("p_partkey").cast("string"), F.lit(".jpg")), 256).alias("storage_key"))
    return media.media_summary(downloads, t.images, stored)


@query("j9_listing_page_images", """
    SELECT l.id AS listing_id, l.source_url AS listing_url, i.source_url, i.position FROM (
        SELECT * FROM v_listings WHERE id > '000000000010' ORDER BY id LIMIT 25) l LEFT JOIN v_images i ON i.listing_id = l.id""")
def _(t):
    return media.listing_page_images(t.listings, t.images, "000000000010", 25).select(
        "listing_id", "listing_url", "source_url", "position")


@query("o11_id_scan", "SELECT id FROM v_images WHERE id > '000000000200' ORDER BY id LIMIT 500")
def _(t):
    return ordering.id_scan(t.images.select("id"), "000000000200", 500)


_CANON = """CASE WHEN regexp_matches(source_url, '^https://(i|preview)\\.redd\\.it/') THEN concat('https://i.redd.it/',
        regexp_extract(source_url, '^https://[^/]*/([^?]*)', 1)) WHEN regexp_matches(source_url, '^https://.*\\.(jpg|jpeg|png|webp)(\\?|$)')
        THEN source_url END"""
SQL_VIEWS["v_gallery"] = f"""
    SELECT listing_id, url, row_number() OVER (PARTITION BY listing_id ORDER BY place) - 1 AS position FROM (
        SELECT listing_id, url, min(position) AS place FROM (SELECT listing_id, position, {_CANON} AS url FROM v_images) a
        WHERE url IS NOT NULL GROUP BY 1, 2
        UNION ALL
        SELECT l.id, concat('https://i.redd.it/f', l.id, '.jpg'), 0 FROM v_listings l WHERE l.brand IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM v_images b WHERE b.listing_id = l.id)) c
    WHERE listing_id IN (SELECT id FROM v_listings WHERE platform = 'reddit')"""
_GALLERY_CLASS = """
    SELECT l.id AS listing_id, CASE WHEN n.urls IS NULL THEN 'missing' WHEN n.urls = o.urls THEN 'unchanged'
        WHEN o.urls IS NULL THEN 'recovered' ELSE 'changed' END AS kind
    FROM v_listings l LEFT JOIN (SELECT listing_id, list(url ORDER BY position) AS urls FROM v_gallery GROUP BY 1) n ON n.listing_id = l.id
    LEFT JOIN (SELECT listing_id, list(source_url ORDER BY position) AS urls FROM v_images GROUP BY 1) o ON o.listing_id = l.id
    WHERE l.platform = 'reddit'"""


def fetched(t):
    return t.listings.filter("brand is not null").select(
        F.col("id").alias("listing_id"), F.lit(0).alias("position"),
        F.concat(F.lit("https://preview.redd.it/f"), "id", F.lit(".jpg?w=1")).alias("source_url"))


@query("n17_gallery_classes", _GALLERY_CLASS)
def _(t):
    return media.canonicalize_gallery(t.listings, t.images, fetched(t))[0]


@query("n17_gallery_rows", f"""
    SELECT g.listing_id, g.url AS source_url, g.position, concat(l.title, ' image ', g.position + 1) AS alt_text
    FROM v_gallery g JOIN v_listings l ON l.id = g.listing_id JOIN ({_GALLERY_CLASS}) k ON k.listing_id = g.listing_id
    WHERE k.kind IN ('changed', 'recovered')""")
def _(t):
    return media.canonicalize_gallery(t.listings, t.images, fetched(t))[1].withColumn("position", F.col("position").cast("bigint"))


@query("n18_additional_images", """
    SELECT l.id AS listing_id, 'https://a.example/' || l.external_id || '/' || p AS source_url, CAST(p AS INTEGER) AS position,
           l.external_id AS alt_text
    FROM v_listings l, range(1, 4) AS r(p) WHERE l.platform = 'instagram' AND l.brand IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM v_images i WHERE i.listing_id = l.id AND i.position = p)""")
def _(t):
    posts = t.listings.filter("platform = 'instagram'")
    pending = posts.select(F.col("id").alias("listing_id"), "external_id")
    links = F.expr("transform(sequence(0, 3), p -> concat('https://a.example/', external_id, '/', p))")
    details = posts.select(F.concat(F.lit(" "), "external_id").alias("shortcode"),
                           F.when(F.col("brand").isNotNull(), links).otherwise(F.slice(links, 1, 1)).alias("urls"))
    return media.additional_image_rows(pending, details, t.images).drop("id")


@query("x16_carousel_completeness", """
    SELECT id AS shortcode, CAST(expected AS BIGINT) AS expected, CASE WHEN expected < 2 THEN 'not_carousel' WHEN n_own >= expected THEN 'current'
        WHEN n_cache >= expected THEN 'cache' WHEN n_detail >= expected THEN 'detail' WHEN n_detail > 0 THEN 'merged' ELSE 'incomplete' END AS source,
      CASE WHEN expected < 2 OR n_own >= expected THEN n_own WHEN n_cache >= expected THEN n_cache WHEN n_detail >= expected THEN n_detail
        WHEN n_detail > 0 THEN greatest(n_own, n_detail) ELSE n_own END AS n_urls
    FROM (SELECT id, CASE WHEN seq % 4 = 0 THEN 3 WHEN seq % 4 = 1 THEN 2 WHEN seq % 4 = 2 THEN 2 ELSE 0 END AS expected,
                 CAST(seq % 3 AS INTEGER) AS n_own, CASE WHEN brand IS NULL THEN 0 ELSE CAST(seq % 5 AS INTEGER) END AS n_cache,
                 CASE WHEN category IS NULL THEN 0 ELSE CAST(seq % 7 AS INTEGER) END AS n_detail FROM v_listings) x""")
def _(t):
    links = "slice(array('https://a.example/1', 'https://a.example/2', 'https://a.example/3', 'https://a.example/4', " \
            "'https://a.example/5', 'https://a.example/6'), 1, CAST({n} AS INT))"
    posts = t.listings.selectExpr(
        "id AS shortcode", f"{links.format(n='seq % 3')} AS urls", "CASE WHEN seq % 4 = 0 THEN 3 END AS media_count",
        "CASE WHEN seq % 4 = 1 THEN 8 END AS media_type", "CASE WHEN seq % 4 = 2 THEN 'Carousel_Container ' END AS product_type")
    cache = t.listings.filter("brand is not null").selectExpr("id AS shortcode", f"{links.format(n='seq % 5')} AS urls")
    details = t.listings.filter("category is not null").selectExpr("id AS shortcode", f"{links.format(n='seq % 7')} AS urls")
    return media.carousel_completeness(posts, cache, details).select(
        "shortcode", "expected", "source", F.size("urls").alias("n_urls"))


@query("x17_merge_detail_images", """
    SELECT id AS post_id, CASE WHEN brand IS NULL THEN concat('https://i.redd.it/', id, '.jpg')
        WHEN category IS NULL THEN concat('https://i.redd.it/', id, '.jpg')
        ELSE concat('https://i.redd.it/d', id, '.png|https://i.redd.it/', id, '.jpg') END AS images FROM v_listings""")
def _(t):
    posts = t.listings.selectExpr("id AS post_id", "array(concat('https://i.redd.it/', id, '.jpg')) AS images")
    details = t.listings.filter("brand is not null").selectExpr(
        "id AS post_id", "array(CASE WHEN category IS NULL THEN 'http://plain.example/x.jpg' ELSE concat('https://preview.redd.it/d', id, '.png?w=2') END, "
        "concat('https://preview.redd.it/', id, '.jpg?w=3')) AS images")
    return media.merge_detail_images(posts, details).select("post_id", F.array_join("images", "|").alias("images"))


# Reconciliation ----------------------------------------------------------------------------------------------------

_OPEN = "platform = '{p}' AND status IN ('available', 'unknown')"


@query("p15_reconcile_candidates", f"""
    SELECT id, platform FROM v_visible WHERE {_OPEN.format(p='facebook')} AND regexp_matches(external_id, '^[0-9]+$')
       AND regexp_matches(source_url, '^https://www\\.facebook\\.com/marketplace/item/[0-9]+/?$')
    UNION ALL SELECT id, platform FROM v_visible WHERE {_OPEN.format(p='reddit')} AND regexp_matches(external_id, '^[A-Za-z0-9]+$')""")
def _(t):
    return queue.reconcile_candidates(t.visible, "facebook").select("id", "platform").union(
        queue.reconcile_candidates(t.visible, "reddit").select("id", "platform"))


@query("o6_rotating_candidates", f"""
    SELECT id, last_fetched_at, listed_at FROM (
        SELECT id, last_fetched_at, coalesce(posted_at, first_fetched_at) AS listed_at FROM v_visible WHERE {_OPEN.format(p='facebook')}
        ORDER BY listed_at DESC, id DESC LIMIT 60) x ORDER BY last_fetched_at NULLS FIRST, listed_at DESC, id LIMIT 5""")
def _(t):
    open_rows = queue.reconcile_candidates(t.visible, "facebook")
    return queue.rotating_candidates(open_rows, 60, 5).select("id", "last_fetched_at", "listed_at")


@query("x15_sold_feed_match", """
    SELECT l.id, CASE WHEN o.event_type IS NOT NULL THEN 'sold' END AS evidence_status,
           CASE WHEN o.event_type IS NOT NULL THEN 'sold_out_feed_match' ELSE 'not_in_recent_sold_feed' END AS signal
    FROM v_listings l LEFT JOIN events o ON CAST(o.event_id AS VARCHAR) = l.external_id AND o.event_type = 'purchase'""")
def _(t):
    feed = t.table("events").filter("event_type = 'purchase'").select(F.col("event_id").cast("string").alias("external_id"))
    return reconcile.sold_feed_match(t.listings, feed).select("id", "evidence_status", "signal")


@query("a18_reconcile_summary", """
    SELECT count(*) AS selected, count(*) FILTER (WHERE event_type <> 'error') AS checked, count(*) FILTER (WHERE event_type = 'purchase') AS sold,
           count(*) FILTER (WHERE event_type = 'view') AS available, count(*) FILTER (WHERE event_type IN ('click', 'signup')) AS unchanged,
           count(*) FILTER (WHERE event_type = 'error') AS failed FROM events""")
def _(t):
    evidence = t.table("events").select(
        (F.col("event_type") != "error").alias("checked"),
        F.when(F.col("event_type") == "purchase", F.lit("sold")).when(F.col("event_type") == "view", F.lit("available")).alias("status"))
    return reconcile.reconcile_summary(evidence)


# Queue -------------------------------------------------------------------------------------------------------------

_RECOVERED = f"""SELECT id, candidate_key, attempts, enqueued_at, payload_json, done_at,
        CASE WHEN stale THEN 'pending' ELSE status END AS status,
        CASE WHEN stale THEN TIMESTAMP '{AS_OF}' ELSE available_at END AS available_at,
        CASE WHEN NOT stale THEN leased_at END AS leased_at, CASE WHEN stale THEN coalesce(error, 'stale lease recovered') ELSE error END AS error
    FROM (SELECT *, coalesce(status = 'leased' AND leased_at <= TIMESTAMP '{AS_OF}' - INTERVAL 300 SECOND, FALSE) AS stale FROM v_queue) q"""


@query("t3_recover_stale", f"SELECT id, status, available_at, leased_at, error FROM ({_RECOVERED}) x")
def _(t):
    return queue.recover_stale(t.queue, AS_OF).select("id", "status", "available_at", "leased_at", "error")


READY_AT = "2024-01-31 00:00:00"
_NEWEST = """SELECT * FROM {src} WHERE status = 'pending'
    QUALIFY row_number() OVER (PARTITION BY candidate_key ORDER BY enqueued_at DESC, id DESC) = 1"""


@query("w4_newest_pending", f"SELECT id, candidate_key FROM ({_NEWEST.format(src='v_queue')}) x")
def _(t):
    return queue.newest_pending(t.queue).select("id", "candidate_key")


@query("j11_superseded_versions", f"""
    SELECT q.id, CASE WHEN q.status = 'pending' AND n.id IS NULL THEN 'done' ELSE q.status END AS status,
           CASE WHEN q.status = 'pending' AND n.id IS NULL THEN 'superseded by newer pending version' ELSE q.error END AS error
    FROM v_queue q LEFT JOIN ({_NEWEST.format(src='v_queue')}) n ON n.id = q.id""")
def _(t):
    return queue.close_superseded(t.queue, AS_OF).select("id", "status", "error")


@query("o7_ready_batch", f"""
    SELECT id, attempts, enqueued_at FROM ({_NEWEST.format(src=f'({_RECOVERED.replace(AS_OF, READY_AT)}) r')}) x
    WHERE available_at <= TIMESTAMP '{READY_AT}'
    ORDER BY CASE WHEN attempts = 0 THEN 0 ELSE 1 END, enqueued_at, id LIMIT 50""")
def _(t):
    return queue.ready_batch(t.queue, READY_AT, 50).select("id", "attempts", "enqueued_at")


@query("o8_ready_or_wait", f"""
    WITH ready AS (SELECT id, enqueued_at FROM ({_RECOVERED}) r WHERE status = 'pending' AND available_at <= TIMESTAMP '{AS_OF}')
    SELECT 'size' AS gate, id FROM (SELECT id FROM ready WHERE (SELECT count(*) FROM ready) >= 20 OR
        (SELECT epoch(TIMESTAMP '{AS_OF}') - epoch(min(enqueued_at)) FROM ready) >= 1e9 ORDER BY enqueued_at, id LIMIT 20) a
    UNION ALL SELECT 'wait', id FROM (SELECT id FROM ready ORDER BY enqueued_at, id LIMIT 1000000) b
    WHERE (SELECT count(*) FROM ready) >= 1000000 OR (SELECT epoch(TIMESTAMP '{AS_OF}') - epoch(min(enqueued_at)) FROM ready) >= 60""")
def _(t):
    by_size = queue.ready_batch_or_wait(t.queue, AS_OF, 20, 1e9).select(F.lit("size").alias("gate"), "id")
    by_wait = queue.ready_batch_or_wait(t.queue, AS_OF, 1_000_000, 60).select(F.lit("wait"), "id")
    none = queue.ready_batch_or_wait(t.queue, AS_OF, 10**9, 1e9).select(F.lit("none"), "id")
    return by_size.union(by_wait).union(none)


@query("t4_apply_outcomes", f"""
    SELECT id, CASE WHEN leased AND ok THEN 'done' WHEN leased THEN 'pending' ELSE status END AS status,
           CASE WHEN leased AND NOT ok THEN TIMESTAMP '{AS_OF}' + INTERVAL 300 SECOND ELSE available_at END AS available_at,
           CASE WHEN NOT leased THEN leased_at END AS leased_at,
           CASE WHEN leased AND ok THEN TIMESTAMP '{AS_OF}' ELSE done_at END AS done_at,
           CASE WHEN leased AND ok THEN NULL WHEN leased THEN 'bad answer' ELSE error END AS error
    FROM (SELECT *, status = 'leased' AS leased, attempts = 0 AS ok FROM v_queue) q""")
def _(t):
    outcomes = t.queue.select("id", F.when(F.col("attempts") == 0, F.lit("complete")).otherwise(F.lit("retry")).alias("outcome"),
                              F.lit("bad\nanswer").alias("error"), F.lit(300).alias("delay_seconds"))
    return queue.apply_outcomes(t.queue, outcomes, AS_OF).select(
        "id", "status", "available_at", "leased_at", "done_at", "error")


@query("a15_queue_stats", """
    SELECT s.status, count(q.id) AS count FROM (VALUES ('pending'), ('leased'), ('done')) AS s(status)
    LEFT JOIN v_queue q ON q.status = s.status GROUP BY 1""")
def _(t):
    return queue.queue_stats(t.queue)


_MISSES = f"""
    SELECT external_id, retry_at FROM (
        SELECT CAST(c_custkey AS VARCHAR) AS external_id, TIMESTAMP '2024-01-21 00:00:00' AS retry_at FROM customer
        WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'view')
        UNION ALL
        SELECT DISTINCT CAST(user_id AS VARCHAR), TIMESTAMP '{AS_OF}' + INTERVAL 21600 SECOND FROM events WHERE event_type = 'view'
          AND CAST(user_id AS VARCHAR) NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)) x"""


@query("t9_lookup_misses", f"{_MISSES} ORDER BY retry_at DESC, external_id LIMIT 1000")
def _(t):
    misses = t.table("customer").select(F.col("c_custkey").cast("string").alias("external_id"),
                                        F.lit("2024-01-21").cast("timestamp_ntz").alias("retry_at"))
    asked = t.table("events").filter("event_type = 'view'").select(F.col("user_id").cast("string").alias("external_id"))
    found = t.table("supplier").select(F.col("s_suppkey").cast("string").alias("external_id"))
    return queue.lookup_misses(misses, asked, found, AS_OF)


@query("o10_miss_list", """
    SELECT CAST(event_id AS VARCHAR) AS external_id, ts AS retry_at FROM events ORDER BY ts DESC, external_id LIMIT 1000""")
def _(t):
    misses = t.table("events").select(F.col("event_id").cast("string").alias("external_id"), F.col("ts").alias("retry_at"))
    return ordering.miss_list(misses)
