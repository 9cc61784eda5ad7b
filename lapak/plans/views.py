"""Listing tables derived from the driver tables, once in Spark and once as SQL with the same rows.

Every view reads its driver tables whole. Arithmetic on keys only spreads column values; no view keeps a subset of
keys to stay small.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


AS_OF = "2024-01-20 00:00:00"
LISTING_AS_OF = "2001-08-05 00:00:00"
MEDIA_ORIGIN = "https://media.example.com"


def norm_sql(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


_PLATFORM = """CASE {c} % 4 WHEN 0 THEN 'reddit' WHEN 1 THEN 'instagram' WHEN 2 THEN 'facebook'
    ELSE 'facebook_group' END"""
_FOLDER = """CASE l_linenumber % 4 WHEN 0 THEN 'reddit' WHEN 1 THEN 'instagram' WHEN 2 THEN 'facebook'
    ELSE 'facebook-groups' END"""
_CATEGORY = """CASE p_type WHEN 'ECONOMY' THEN 'Laptop' WHEN 'STANDARD' THEN 'Graphics Card' WHEN 'MEDIUM' THEN 'RAM'
    WHEN 'LARGE' THEN 'Monitor' WHEN 'SMALL' THEN 'Keyboard' WHEN 'PROMO' THEN 'Smartphone' END"""
_CONDITION = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Baru / BNIB' WHEN '2-HIGH' THEN 'Like New'
    WHEN '3-MEDIUM' THEN 'Bekas - baik' WHEN '5-LOW' THEN 'mulus' END"""
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'sold' WHEN 'O' THEN 'available' ELSE 'unknown' END"
_SOURCE_URL = """CASE o_custkey % 4
    WHEN 0 THEN concat('https://www.reddit.com/r/market/comments/', CAST(o_orderkey AS {s}), '/item/')
    WHEN 1 THEN concat('https://www.instagram.com/p/', CAST(o_orderkey AS {s}), '/')
    WHEN 2 THEN concat('https://www.facebook.com/marketplace/item/', CAST(o_orderkey AS {s}), '/')
    ELSE concat('https://www.facebook.com/groups/77/posts/', CAST(o_orderkey AS {s}), '/') END"""
_EXTERNAL_ID = """CASE o_custkey % 4 WHEN 3 THEN concat('77:', CAST(o_orderkey AS {s}))
    ELSE CAST(o_orderkey AS {s}) END"""
_TITLE = "CASE WHEN o_custkey % 40 = 2 THEN 'Laptop  PROMO' ELSE p_name END"
_DESCRIPTION = """CASE WHEN o_custkey % 40 = 2 THEN 'ready stok garansi'
    WHEN o_orderkey % 9 = 0 THEN concat('Terjual', {nl}, p_type, ' ', p_name, {nl}, p_brand, {nl}, o_orderpriority)
    ELSE concat(p_type, ' ', p_name, {nl}, p_brand, {nl}, o_orderpriority) END"""
_IMAGE_URL = """CASE l_suppkey % 4
    WHEN 0 THEN concat('https://i.redd.it/', CAST(l_partkey AS {s}), '.jpg?s=', CAST(l_linenumber AS {s}))
    WHEN 1 THEN concat('https://scontent.fbcdn.net/v/', CAST(l_partkey AS {s}), '.jpg')
    WHEN 2 THEN concat('https://preview.redd.it/', CAST(l_partkey AS {s}), '.png?width=640&s=',
                       CAST(l_linenumber AS {s}))
    ELSE concat('http://cdn.example/', CAST(l_partkey AS {s}), '.gif') END"""
_IMAGE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity", "l_tax",
                "l_discount", "l_shipdate")


def _place(key: str) -> str:
    return (f"CASE WHEN o_orderkey % 3 = 0 THEN {key}({{city}}, 'Jawa') WHEN o_orderkey % 17 = 0 THEN "
            f"{key}('081234567890') WHEN o_orderkey % 29 = 0 THEN {{empty}} WHEN o_orderkey % 31 = 0 THEN "
            f"{key}(concat('COD ', {{city}})) ELSE {key}({{city}}) END")


# SQL views ---------------------------------------------------------------------------------------------------------

SQL_VIEWS: dict[str, str] = {
    "v_listings": f"""
        SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, {_PLATFORM.format(c='o_custkey')} AS platform,
               {_SOURCE_URL.format(s='VARCHAR')} AS source_url, {_EXTERNAL_ID.format(s='VARCHAR')} AS external_id,
               {_TITLE} AS title, {_DESCRIPTION.format(nl='chr(10)')} AS description,
               CASE WHEN o_orderkey % 11 <> 0 THEN {_CATEGORY} END AS category,
               CASE WHEN o_orderkey % 13 <> 0 THEN p_brand END AS brand,
               CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 12345
                    ELSE floor(o_totalprice * 10) END AS INTEGER) AS price,
               {_place('list_value').format(city="concat('Kota ', chr(65 + n_nationkey))", empty="CAST([] AS VARCHAR[])")}
                    AS location_texts,
               {_CONDITION} AS condition_text,
               CASE WHEN o_orderkey % 19 <> 0 THEN concat('  Seller  ', CAST(o_custkey % 40 AS VARCHAR), ' ') END
                    AS seller_name,
               {_STATUS} AS status,
               CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS posted_at,
               o_orderdate + INTERVAL 1 HOUR + to_microseconds((o_orderkey % 1000) * 1500) AS first_fetched_at,
               o_orderdate + INTERVAL 30 HOUR AS last_fetched_at,
               o_orderdate + INTERVAL 1 HOUR AS created_at, o_orderdate + INTERVAL 30 HOUR AS updated_at,
               o_orderkey AS seq
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
             LEFT JOIN part ON p_partkey = o_custkey""",
    "v_images": f"""
        SELECT concat(listing_id, '-', lpad(CAST(position AS VARCHAR), 6, '0')) AS id, listing_id, source_url,
               CASE WHEN cached THEN concat('{MEDIA_ORIGIN}/production/', folder, '/aa/', part_text, '.jpg') END
                    AS cached_url,
               CASE WHEN cached THEN concat('production/', folder, '/', left(sha256(part_text), 2), '/',
                    sha256(part_text), '.jpg') END AS storage_key,
               CASE WHEN cached THEN sha256(part_text) END AS content_hash,
               CASE WHEN cached THEN 'image/jpeg' END AS content_type,
               CASE WHEN cached THEN 1000 + l_partkey END AS byte_size,
               CASE WHEN cached THEN l_shipdate END AS cached_at, CAST(position AS INTEGER) AS position, alt_text
        FROM (SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS listing_id, l_partkey, l_shipdate,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_IMAGE_ORDER)}) - 1 AS position,
                     {_IMAGE_URL.format(s='VARCHAR')} AS source_url, {_FOLDER} AS folder,
                     CAST(l_partkey AS VARCHAR) AS part_text, l_returnflag = 'R' AS cached,
                     CASE WHEN l_linenumber > 1 THEN concat('photo ', CAST(l_linenumber AS VARCHAR)) END AS alt_text
              FROM lineitem)""",
    "v_moderation": """
        SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS listing_id, event_type = 'error' AND value > 60 AS hidden,
               CASE WHEN event_type = 'signup' THEN concat('Seller ', CAST(user_id % 40 AS VARCHAR)) END
                    AS seller_name_override
        FROM events""",
    "v_controls": """
        SELECT * FROM (VALUES ('reddit', TRUE), ('instagram', TRUE), ('facebook', TRUE), ('facebook_group', TRUE))
               AS c(platform, public_visible)""",
    "v_flags": """
        SELECT concat('flag-', CAST(n_nationkey AS VARCHAR)) AS id,
               CASE n_nationkey % 2 WHEN 0 THEN 'facebook' ELSE 'facebook_group' END AS platform,
               concat('Seller ', CAST(n_nationkey AS VARCHAR)) AS seller_name,
               concat('seller ', CAST(n_nationkey AS VARCHAR)) AS normalized_seller_name,
               CASE n_regionkey WHEN 1 THEN 'review' WHEN 3 THEN 'allowlisted' ELSE 'blocked' END AS status,
               CASE n_regionkey WHEN 4 THEN 'manual' ELSE 'auto' END AS source
        FROM nation""",
    "v_blocks": f"""
        SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'reddit' WHEN 1 THEN 'instagram' WHEN 2 THEN 'facebook'
                    ELSE 'facebook_group' END AS platform, 'title' AS field, {norm_sql('p_name')} AS normalized_value
        FROM part WHERE p_size = 50 AND p_type = 'PROMO'
        UNION ALL
        SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'reddit' WHEN 1 THEN 'instagram' WHEN 2 THEN 'facebook'
                    ELSE 'facebook_group' END AS platform, 'description' AS field,
               {norm_sql("concat(p_type, ' ', p_name, ' ', p_brand, ' 1-URGENT')")} AS normalized_value
        FROM part WHERE p_size > 40""",
    "v_visible": f"""
        SELECT l.*, m.seller_name_override
        FROM v_listings l LEFT JOIN v_moderation m ON m.listing_id = l.id
             LEFT JOIN v_controls c ON c.platform = l.platform
        WHERE coalesce(c.public_visible, TRUE) AND NOT coalesce(m.hidden, FALSE)
          AND NOT EXISTS (SELECT 1 FROM v_blocks b WHERE b.platform = l.platform AND b.field = 'title'
                          AND b.normalized_value = {norm_sql('l.title')})
          AND NOT EXISTS (SELECT 1 FROM v_blocks b WHERE b.platform = l.platform AND b.field = 'description'
                          AND b.normalized_value = {norm_sql('l.description')})
          AND NOT (l.platform IN ('facebook', 'facebook_group') AND EXISTS (
                SELECT 1 FROM v_flags f WHERE f.status = 'blocked' AND f.platform = l.platform
                AND f.normalized_seller_name = {norm_sql('coalesce(m.seller_name_override, l.seller_name)')}))""",
    "v_flag_rows": """
        SELECT CAST(c_custkey AS VARCHAR) AS id,
               CASE c_mktsegment WHEN 'FURNITURE' THEN 'reddit' WHEN 'MACHINERY' THEN 'facebook_group'
                    ELSE 'facebook' END AS platform,
               concat('Shop ', CAST(c_custkey % 997 AS VARCHAR), ' ', c_mktsegment) AS seller_name,
               CASE WHEN c_nationkey = 7 THEN concat('Shop ', CAST(c_custkey % 997 AS VARCHAR), ' ', c_mktsegment)
                    ELSE lower(concat('Shop ', CAST(c_custkey % 997 AS VARCHAR), ' ', c_mktsegment)) END
                    AS normalized_seller_name,
               CASE WHEN c_nationkey = 3 THEN repeat('x', 501) ELSE 'copied texts' END AS reason,
               CAST(floor(c_acctbal) AS INTEGER) AS recent_listing_count, c_nationkey AS duplicate_listing_count,
               c_acctbal / 9000 AS duplicate_ratio
        FROM customer""",
    "v_legacy": """
        SELECT concat('legacy-', CAST(n_nationkey AS VARCHAR)) AS id,
               concat('Seller ', CAST(n_nationkey AS VARCHAR)) AS seller_name,
               concat('seller ', CAST(n_nationkey AS VARCHAR)) AS normalized_seller_name,
               CASE n_regionkey WHEN 0 THEN 'auto' ELSE 'manual' END AS source
        FROM nation""",
    "v_mod_events": """
        SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'block_seller' WHEN 'signup' THEN 'admin_backfill'
                    ELSE 'note' END AS action,
               CASE event_type WHEN 'error' THEN 'facebook_seller' ELSE 'listing' END AS entity_type,
               concat('Seller ', CAST(user_id % 40 AS VARCHAR)) AS entity_id,
               CASE WHEN user_id % 3 = 0 THEN concat('{"platform":"',
                         CASE WHEN user_id % 2 = 0 THEN 'facebook' ELSE 'facebook_group' END, '"}')
                    WHEN user_id % 3 = 1 THEN concat('{"sellerName":"seller   ', CAST(user_id % 25 AS VARCHAR),
                         '","platform":"facebook"}')
                    ELSE concat('{"platform":"', event_type, '"}') END AS details
        FROM events""",
    "v_queue": """
        SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, concat('FACEBOOK:', CAST(user_id AS VARCHAR))
                    AS candidate_key, 'FACEBOOK' AS platform, concat('job-', CAST(user_id % 3 AS VARCHAR)) AS source_id,
               concat(event_type, CAST(event_id AS VARCHAR)) AS fingerprint, props AS payload_json,
               CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'leased' ELSE 'done' END AS status,
               CAST(event_id % 3 AS INTEGER) AS attempts, ts AS enqueued_at,
               ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS available_at,
               CASE WHEN event_type = 'click' THEN ts + INTERVAL 60 SECOND END AS leased_at,
               CASE WHEN event_type NOT IN ('view', 'click') THEN ts + INTERVAL 1 HOUR END AS done_at,
               CASE WHEN event_id % 5 = 0 THEN 'earlier error' END AS error
        FROM events""",
    "v_obs": """
        SELECT event_id AS seq, concat('FACEBOOK:', CAST(user_id AS VARCHAR)) AS candidate_key,
               'FACEBOOK' AS platform, concat('job-', CAST(user_id % 3 AS VARCHAR)) AS source_id,
               event_type AS fingerprint, ts AS observed_at, props AS payload_json
        FROM events""",
    "v_state": """
        SELECT concat('FACEBOOK:', CAST(c_custkey AS VARCHAR)) AS candidate_key, 'FACEBOOK' AS platform,
               'job-9' AS source_id,
               CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'view' WHEN 'MACHINERY' THEN 'click' WHEN 'FURNITURE' THEN 'error'
                    WHEN 'BUILDING' THEN 'signup' ELSE 'purchase' END AS fingerprint,
               TIMESTAMP '2023-12-01 00:00:00' AS first_seen_at, TIMESTAMP '2023-12-31 00:00:00' AS last_seen_at,
               CAST(c_nationkey + 1 AS BIGINT) AS seen_count
        FROM customer""",
    "v_versions": """
        SELECT concat(candidate_key, '/', fingerprint) AS id, candidate_key, 'FACEBOOK' AS platform,
               'job-9' AS source_id, fingerprint, '{}' AS payload_json, status, 2 AS attempts,
               TIMESTAMP '2023-12-31 00:00:00' AS enqueued_at, TIMESTAMP '2023-12-31 00:00:00' AS available_at,
               CASE WHEN status = 'leased' THEN TIMESTAMP '2023-12-31 06:00:00' END AS leased_at,
               CASE WHEN status = 'done' THEN TIMESTAMP '2023-12-31 07:00:00' END AS done_at,
               CAST(NULL AS VARCHAR) AS error
        FROM (SELECT concat('FACEBOOK:', CAST(c_custkey AS VARCHAR)) AS candidate_key, fingerprint,
                     CASE (c_nationkey + shift) % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'leased' ELSE 'done' END AS status
              FROM customer, (VALUES ('view', 0), ('click', 1), ('error', 2)) AS k(fingerprint, shift)
             )""",
    "v_runlog": """
        SELECT 'events.jsonl' AS file_name, event_id AS line,
               CASE event_type WHEN 'purchase' THEN 'scheduler' ELSE 'orchestrator' END AS source,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'no_new_data' ELSE 'success' END AS status,
               event_type <> 'error' AS ok, concat('job-', CAST(user_id % 7 AS VARCHAR)) AS job_id,
               CASE event_type WHEN 'signup' THEN 'n/a' ELSE concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 'Z') END
                    AS log_time,
               CASE event_type WHEN 'signup' THEN NULL ELSE ts END AS logged_time,
               CASE CAST(user_id % 3 AS INTEGER) WHEN 0 THEN 'reddit' WHEN 1 THEN 'instagram' ELSE 'facebook' END
                    AS connector,
               CASE event_type WHEN 'error' THEN 'degraded' WHEN 'click' THEN 'no_new_data' ELSE 'success' END
                    AS connector_status,
               CAST(floor(value) AS BIGINT) AS validated, CAST(event_id % 4 AS BIGINT) AS validation_errors,
               CAST(floor(value) AS BIGINT) AS requested, CAST(floor(value / 2) AS BIGINT) AS inserted,
               CAST(floor(value / 3) AS BIGINT) AS updated, CAST(floor(value / 10) AS BIGINT) AS duplicates
        FROM events WHERE NOT (event_type = 'click' AND value < 12)""",
}


# Spark views -------------------------------------------------------------------------------------------------------

def pad(column: str) -> str:
    return f"lpad(CAST({column} AS STRING), 12, '0')"



class Tables:
    """Lazily built DataFrames over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, str(sf_dir).rstrip("/")

    _schemas: dict[str, object] = {}

    def table(self, name: str) -> DataFrame:
        """A driver table. Its schema is read from the file once per process, which saves a job per scan."""
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in Tables._schemas:
            Tables._schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(Tables._schemas[path]).parquet(path)

    @cached_property
    def listings(self) -> DataFrame:
        t = self.table
        joined = (
            t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
            .join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
            .join(t("part"), F.col("p_partkey") == F.col("o_custkey"), "left")
        )
        city = "concat('Kota ', char(65 + n_nationkey))"
        return joined.selectExpr(
            f"{pad('o_orderkey')} AS id", f"{_PLATFORM.format(c='o_custkey')} AS platform",
            f"{_SOURCE_URL.format(s='STRING')} AS source_url", f"{_EXTERNAL_ID.format(s='STRING')} AS external_id",
            f"{_TITLE} AS title", f"{_DESCRIPTION.format(nl='char(10)')} AS description",
            f"CASE WHEN o_orderkey % 11 <> 0 THEN {_CATEGORY} END AS category",
            "CASE WHEN o_orderkey % 13 <> 0 THEN p_brand END AS brand",
            "CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 12345 "
            "ELSE floor(o_totalprice * 10) END AS INT) AS price",
            f"{_place('array').format(city=city, empty='CAST(array() AS ARRAY<STRING>)')} AS location_texts",
            f"{_CONDITION} AS condition_text",
            "CASE WHEN o_orderkey % 19 <> 0 THEN concat('  Seller  ', CAST(o_custkey % 40 AS STRING), ' ') END "
            "AS seller_name",
            f"{_STATUS} AS status", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS posted_at",
            "timestampadd(MICROSECOND, (o_orderkey % 1000) * 1500, o_orderdate + INTERVAL '1' HOUR) AS first_fetched_at",
            "o_orderdate + INTERVAL '30' HOUR AS last_fetched_at", "o_orderdate + INTERVAL '1' HOUR AS created_at",
            "o_orderdate + INTERVAL '30' HOUR AS updated_at", "o_orderkey AS seq")

    @cached_property
    def images(self) -> DataFrame:
        # The one shuffle, by listing, also serves what joins images to their listings.
        order = Window.partitionBy("listing_id", "l_orderkey").orderBy(*_IMAGE_ORDER)
        lines = self.table("lineitem").withColumn("listing_id", F.expr(pad("l_orderkey"))).repartition("listing_id")
        rows = lines.withColumn("position", F.row_number().over(order) - 1).selectExpr(
            "listing_id", "l_partkey", "l_shipdate", "position",
            f"{_IMAGE_URL.format(s='STRING')} AS source_url", f"{_FOLDER} AS folder",
            "CAST(l_partkey AS STRING) AS part_text", "l_returnflag = 'R' AS cached",
            "CASE WHEN l_linenumber > 1 THEN concat('photo ', CAST(l_linenumber AS STRING)) END AS alt_text")
        return rows.selectExpr(
            "concat(listing_id, '-', lpad(CAST(position AS STRING), 6, '0')) AS id", "listing_id", "source_url",
            f"CASE WHEN cached THEN concat('{MEDIA_ORIGIN}/production/', folder, '/aa/', part_text, '.jpg') END "
            "AS cached_url",
            "CASE WHEN cached THEN concat('production/', folder, '/', left(sha2(part_text, 256), 2), '/', "
            "sha2(part_text, 256), '.jpg') END AS storage_key",
            "CASE WHEN cached THEN sha2(part_text, 256) END AS content_hash",
            "CASE WHEN cached THEN 'image/jpeg' END AS content_type",
            "CASE WHEN cached THEN 1000 + l_partkey END AS byte_size", "CASE WHEN cached THEN l_shipdate END AS cached_at",
            "CAST(position AS INT) AS position", "alt_text")

    @cached_property
    def moderation(self) -> DataFrame:
        return self.table("events").selectExpr(
            f"{pad('event_id')} AS listing_id", "event_type = 'error' AND value > 60 AS hidden",
            "CASE WHEN event_type = 'signup' THEN concat('Seller ', CAST(user_id % 40 AS STRING)) END "
            "AS seller_name_override")

    @cached_property
    def controls(self) -> DataFrame:
        rows = [(p, True) for p in ("reddit", "instagram", "facebook", "facebook_group")]
        return self.spark.createDataFrame(rows, "platform string, public_visible boolean")

    @cached_property
    def flags(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "concat('flag-', CAST(n_nationkey AS STRING)) AS id",
            "CASE n_nationkey % 2 WHEN 0 THEN 'facebook' ELSE 'facebook_group' END AS platform",
            "concat('Seller ', CAST(n_nationkey AS STRING)) AS seller_name",
            "concat('seller ', CAST(n_nationkey AS STRING)) AS normalized_seller_name",
            "CASE n_regionkey WHEN 1 THEN 'review' WHEN 3 THEN 'allowlisted' ELSE 'blocked' END AS status",
            "CASE n_regionkey WHEN 4 THEN 'manual' ELSE 'auto' END AS source")

    @cached_property
    def blocks(self) -> DataFrame:
        from lapak.functions.text import normalize_listing_content

        part = self.table("part").withColumn("platform", F.expr(_PLATFORM.format(c="p_partkey")))
        titles = part.filter("p_size = 50 AND p_type = 'PROMO'").select(
            "platform", F.lit("title").alias("field"), normalize_listing_content(F.col("p_name")).alias("normalized_value"))
        text = F.concat("p_type", F.lit(" "), "p_name", F.lit(" "), "p_brand", F.lit(" 1-URGENT"))
        bodies = part.filter("p_size > 40").select(
            "platform", F.lit("description").alias("field"), normalize_listing_content(text).alias("normalized_value"))
        return titles.distinct().union(bodies.distinct())

    @cached_property
    def visible(self) -> DataFrame:
        from lapak.operators.visibility import visible_listings

        return visible_listings(self.listings, self.moderation, self.controls, self.blocks, self.flags)

    @cached_property
    def flag_rows(self) -> DataFrame:
        name = "concat('Shop ', CAST(c_custkey % 997 AS STRING), ' ', c_mktsegment)"
        return self.table("customer").selectExpr(
            "CAST(c_custkey AS STRING) AS id",
            "CASE c_mktsegment WHEN 'FURNITURE' THEN 'reddit' WHEN 'MACHINERY' THEN 'facebook_group' "
            "ELSE 'facebook' END AS platform",
            f"{name} AS seller_name",
            f"CASE WHEN c_nationkey = 7 THEN {name} ELSE lower({name}) END AS normalized_seller_name",
            "CASE WHEN c_nationkey = 3 THEN repeat('x', 501) ELSE 'copied texts' END AS reason",
            "CAST(floor(c_acctbal) AS INT) AS recent_listing_count", "c_nationkey AS duplicate_listing_count",
            "c_acctbal / 9000 AS duplicate_ratio")

    @cached_property
    def legacy(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "concat('legacy-', CAST(n_nationkey AS STRING)) AS id",
            "concat('Seller ', CAST(n_nationkey AS STRING)) AS seller_name",
            "concat('seller ', CAST(n_nationkey AS STRING)) AS normalized_seller_name",
            "CASE n_regionkey WHEN 0 THEN 'auto' ELSE 'manual' END AS source")

    @cached_property
    def mod_events(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS id",
            "CASE event_type WHEN 'purchase' THEN 'block_seller' WHEN 'signup' THEN 'admin_backfill' ELSE 'note' END "
            "AS action",
            "CASE event_type WHEN 'error' THEN 'facebook_seller' ELSE 'listing' END AS entity_type",
            "concat('Seller ', CAST(user_id % 40 AS STRING)) AS entity_id",
            "CASE WHEN user_id % 3 = 0 THEN concat('{\"platform\":\"', CASE WHEN user_id % 2 = 0 THEN 'facebook' "
            "ELSE 'facebook_group' END, '\"}') "
            "WHEN user_id % 3 = 1 THEN concat('{\"sellerName\":\"seller   ', CAST(user_id % 25 AS STRING), "
            "'\",\"platform\":\"facebook\"}') ELSE concat('{\"platform\":\"', event_type, '\"}') END AS details")

    @cached_property
    def queue(self) -> DataFrame:
        return self.table("events").selectExpr(
            f"{pad('event_id')} AS id", "concat('FACEBOOK:', CAST(user_id AS STRING)) AS candidate_key",
            "'FACEBOOK' AS platform", "concat('job-', CAST(user_id % 3 AS STRING)) AS source_id",
            "concat(event_type, CAST(event_id AS STRING)) AS fingerprint", "props AS payload_json",
            "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'leased' ELSE 'done' END AS status",
            "CAST(event_id % 3 AS INT) AS attempts", "ts AS enqueued_at",
            "timestampadd(SECOND, CAST(floor(value * 60) AS BIGINT), ts) AS available_at",
            "CASE WHEN event_type = 'click' THEN ts + INTERVAL '60' SECOND END AS leased_at",
            "CASE WHEN event_type NOT IN ('view', 'click') THEN ts + INTERVAL '1' HOUR END AS done_at",
            "CASE WHEN event_id % 5 = 0 THEN 'earlier error' END AS error")

    @cached_property
    def obs(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS seq", "concat('FACEBOOK:', CAST(user_id AS STRING)) AS candidate_key",
            "'FACEBOOK' AS platform", "concat('job-', CAST(user_id % 3 AS STRING)) AS source_id",
            "event_type AS fingerprint", "ts AS observed_at", "props AS payload_json")

    @cached_property
    def state(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "concat('FACEBOOK:', CAST(c_custkey AS STRING)) AS candidate_key", "'FACEBOOK' AS platform",
            "'job-9' AS source_id",
            "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'view' WHEN 'MACHINERY' THEN 'click' WHEN 'FURNITURE' THEN 'error' "
            "WHEN 'BUILDING' THEN 'signup' ELSE 'purchase' END AS fingerprint",
            "TIMESTAMP_NTZ '2023-12-01 00:00:00' AS first_seen_at", "TIMESTAMP_NTZ '2023-12-31 00:00:00' AS last_seen_at",
            "CAST(c_nationkey + 1 AS BIGINT) AS seen_count")

    @cached_property
    def versions(self) -> DataFrame:
        kinds = "explode(array(struct('view' AS f, 0 AS s), struct('click' AS f, 1 AS s), struct('error' AS f, 2 AS s)))"
        rows = self.table("customer").selectExpr(
            "concat('FACEBOOK:', CAST(c_custkey AS STRING)) AS candidate_key", "c_nationkey", f"{kinds} AS k").selectExpr(
            "candidate_key", "k.f AS fingerprint",
            "CASE (c_nationkey + k.s) % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'leased' ELSE 'done' END AS status")
        return rows.selectExpr(
            "concat(candidate_key, '/', fingerprint) AS id", "candidate_key", "'FACEBOOK' AS platform",
            "'job-9' AS source_id", "fingerprint", "'{}' AS payload_json", "status", "2 AS attempts",
            "TIMESTAMP_NTZ '2023-12-31 00:00:00' AS enqueued_at", "TIMESTAMP_NTZ '2023-12-31 00:00:00' AS available_at",
            "CASE WHEN status = 'leased' THEN TIMESTAMP_NTZ '2023-12-31 06:00:00' END AS leased_at",
            "CASE WHEN status = 'done' THEN TIMESTAMP_NTZ '2023-12-31 07:00:00' END AS done_at",
            "CAST(NULL AS STRING) AS error")

    @cached_property
    def run_log_lines(self) -> DataFrame:
        """Run-log text lines, some of them broken or not objects, as a log folder holds them."""
        status = ("CASE event_type WHEN 'error' THEN '{bad}' WHEN 'click' THEN 'no_new_data' ELSE 'success' END")
        time = ("CASE event_type WHEN 'signup' THEN 'n/a' ELSE "
                "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), 'Z') END")
        counters = ("named_struct('requested', CAST(floor(value) AS BIGINT), 'inserted', CAST(floor(value / 2) AS BIGINT), "
                    "'updated', CAST(floor(value / 3) AS BIGINT), 'duplicates', CAST(floor(value / 10) AS BIGINT))")
        rows = self.table("events").selectExpr(
            "event_id AS line", "event_type", "value AS amount",
            "CASE event_type WHEN 'purchase' THEN 'scheduler' ELSE 'orchestrator' END AS source",
            f"{status.format(bad='failed')} AS status", "event_type <> 'error' AS ok",
            "concat('job-', CAST(user_id % 7 AS STRING)) AS job_id",
            f"CASE WHEN event_type <> 'view' THEN {time} END AS logged_at",
            f"CASE WHEN event_type = 'view' THEN {time} END AS finished_at",
            f"named_struct('ok', true, 'summary', {counters}) AS storage",
            "array(named_struct('connector', CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'reddit' WHEN 1 THEN 'instagram' "
            "ELSE 'facebook' END, 'ok', event_type <> 'error', 'status', "
            f"{status.format(bad='degraded')}, 'validated', CAST(floor(value) AS BIGINT), "
            "'validationErrors', CAST(event_id % 4 AS BIGINT))) AS connectors")
        text = F.to_json(F.struct("source", "status", "ok", "job_id", "logged_at", "finished_at", "storage", "connectors"))
        broken = (F.col("event_type") == "click") & (F.col("amount") < 12)
        value = F.when(broken & (F.col("amount") < 10), F.left(text, F.lit(25))).when(broken, F.lit("[1, 2]")).otherwise(text)
        from lapak.functions.once import computed

        return computed(rows, value=value).select("value", F.lit("events.jsonl").alias("file_name"), "line")

    @cached_property
    def run_log(self) -> DataFrame:
        from lapak.sources.runlogs import parse_run_log_lines

        return parse_run_log_lines(self.run_log_lines)
