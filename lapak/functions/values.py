"""Prices, times, statuses, buckets and identities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lapak.functions.text import blank_to_null, distinct_ignoring_case, lenient_integer, or_blank, strip
from lapak.functions.urls import canonical_url
from lapak.schemas import CONDITIONS

PLACEHOLDER_PRICES = (12345, 123456)
MIN_PUBLIC_PRICE = 10_000
MAX_STORED_PRICE = 200_000_000


# Prices ------------------------------------------------------------------------------------------------------------

def normalize_public_price(c: Column) -> Column:
    """small and placeholder prices are shown as unknown; no upper bound."""
    return F.when((c >= MIN_PUBLIC_PRICE) & ~c.isin(*PLACEHOLDER_PRICES), c)


def normalize_price_text(c: Column) -> Column:
    """F15 for text: digits only, then the stored range."""
    amount = F.regexp_replace(c, r"[^0-9]", "").try_cast("decimal(38,0)")
    return F.when(amount.between(MIN_PUBLIC_PRICE, MAX_STORED_PRICE), amount.cast("int"))


def normalize_price_number(c: Column) -> Column:
    """F15 for numbers: truncated towards zero, then the stored range."""
    amount = F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
    return F.when(amount.between(MIN_PUBLIC_PRICE, MAX_STORED_PRICE), amount.cast("int"))


def format_rupiah(c: Column) -> Column:
    """Indonesian grouping, a no-break space after the currency sign."""
    digits = F.translate(F.format_number(F.abs(c), 0), ",", ".")
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(c.isNull(), F.lit("Harga tidak dicantumkan")).otherwise(F.concat(sign, F.lit("Rp\xa0"), digits))


# Indonesian short month names.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des")


def format_listed_at(at: Column, now: Column) -> Column:
    """relative within a week, then day and month, with the year when it is another year (UTC)."""
    minutes = F.floor(F.greatest(F.lit(0), F.unix_millis(now.cast("timestamp")) - F.unix_millis(at.cast("timestamp")))
                      / 60_000)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(at))
    date = F.concat_ws(" ", F.dayofmonth(at).cast("string"), month,
                       F.when(F.year(at) != F.year(now), F.year(at).cast("string")))
    return (
        F.when(minutes < 1, F.lit("Baru saja"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" menit lalu")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" jam lalu")))
        .when(days < 7, F.concat(days.cast("string"), F.lit(" hari lalu")))
        .otherwise(date)
    )


# Times -------------------------------------------------------------------------------------------------------------

def to_millis(c: Column) -> Column:
    """Cut to milliseconds, the precision of stored times and cursors."""
    return F.date_trunc("MILLISECOND", c).cast("timestamp_ntz")


def iso_millis(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso(c: Column) -> Column:
    """ISO text with or without offset -> UTC without zone; anything else -> null. Needs a UTC session."""
    shaped = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}(?::?[0-9]{2}){0,2}(?:[.,][0-9]+)?"
                     r"(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$")
    return F.when(shaped, c.try_cast("timestamp").cast("timestamp_ntz"))


def parse_posted_at(text: Column, fetched_at: Column) -> Column:
    """'3 jam lalu', 'kemarin' and the like, counted back from the fetch time; a month is 30 days."""
    low = F.lower(or_blank(text))
    pattern = r"(?U)(\d+)\s*(menit|mnt|jam|hari|minggu|bulan)\s+lalu"
    amount = F.regexp_extract(low, pattern, 1).try_cast("bigint")
    unit = F.regexp_extract(low, pattern, 2)
    seconds = (
        F.when(unit.isin("menit", "mnt"), F.lit(60))
        .when(unit == "jam", F.lit(3600))
        .when(unit == "hari", F.lit(86400))
        .when(unit == "minggu", F.lit(604800))
        .when(unit == "bulan", F.lit(2592000))
    )
    back = F.when(amount.isNotNull(), amount * seconds).when(low.contains("kemarin"), F.lit(86400))
    return F.timestamp_add("SECOND", -back, fetched_at)


def effective_at(posted_at="posted_at", first_fetched_at="first_fetched_at") -> Column:
    """F13."""
    return F.coalesce(F.col(posted_at), F.col(first_fetched_at))


def effective_seller(override="seller_name_override", seller="seller_name") -> Column:
    """a blank override still counts."""
    return F.coalesce(F.col(override), F.col(seller))


# Buckets -----------------------------------------------------------------------------------------------------------

def _bucket(c: Column, steps, last: str) -> Column:
    test = F.when(c <= steps[0][0], F.lit(steps[0][1]))
    for limit, label in steps[1:]:
        test = test.when(c <= limit, F.lit(label))
    return test.otherwise(F.lit(last))


def query_length_bucket(c: Column) -> Column:
    """F22."""
    return _bucket(c, ((0, "0"), (5, "1-5"), (15, "6-15"), (30, "16-30")), "31-80")


def result_count_bucket(c: Column) -> Column:
    """F21."""
    return _bucket(c, ((0, "0"), (5, "1-5"), (12, "6-12"), (24, "13-24")), "25+")


def price_bucket(c: Column) -> Column:
    """F20."""
    return (
        F.when(c.isNull(), F.lit("unknown"))
        .when(c < 500_000, F.lit("<500k"))
        .when(c < 1_500_000, F.lit("500k-1.5m"))
        .when(c < 5_000_000, F.lit("1.5m-5m"))
        .when(c < 15_000_000, F.lit("5m-15m"))
        .otherwise(F.lit("15m+"))
    )


def sanitized_page_path(c: Column) -> Column:
    """F22."""
    return F.when(c.startswith("/"), c).otherwise(F.lit("/"))


# Model answers -----------------------------------------------------------------------------------------------------

def normalize_condition(c: Column) -> Column:
    """F16."""
    text = blank_to_null(c)
    return F.when(text.isin(*CONDITIONS), text)


def normalize_status(c: Column) -> Column:
    """F16: upper case on the wire."""
    text = F.upper(strip(c))
    return F.when(text.isin("AVAILABLE", "SOLD", "UNKNOWN"), text)


def normalize_locations(values: Column) -> Column:
    """F17 for arrays: stripped, 160 characters, first spelling wins, at most eight."""
    cleaned = F.filter(F.transform(values, lambda v: F.left(strip(v), F.lit(160))), lambda v: v != "")
    return F.coalesce(F.slice(distinct_ignoring_case(cleaned), 1, 8), F.array().cast("array<string>"))


def normalize_locations_text(text: Column) -> Column:
    """F17 for one text with commas or slashes."""
    return normalize_locations(F.split(F.replace(text, F.lit("/"), F.lit(",")), ","))


def classify_model_error(message: Column) -> Column:
    """the first matching class wins."""
    m = F.lower(or_blank(message))
    has = m.contains
    unavailable = (has("http 400") & has("degraded function cannot be invoked")) | (
        has("http 404") & has("function id") & has("specified function") & has("not found"))
    malformed = m.rlike(
        "non-json|invalid response json|exactly one result|invalid instagram title|rejection reason|"
        "out_of_scope is valid only|json root was not an object")
    return (
        F.when(has("http 429") | has("rate limit"), F.lit("rate_limit"))
        .when(has("http 503") | has("resourceexhausted") | has("request limit reached"), F.lit("capacity"))
        .when(unavailable, F.lit("provider_unavailable"))
        .when(malformed, F.lit("invalid_output"))
        .when(has("request failed"), F.lit("transport"))
        .otherwise(F.lit("other"))
    )


# Runs --------------------------------------------------------------------------------------------------------------

def connector_status(ok: Column, validated: Column) -> Column:
    """F35 for one connector."""
    return F.when(~ok, F.lit("degraded")).when(validated > 0, F.lit("success")).otherwise(F.lit("no_new_data"))


def account_status(ok: Column, validated: Column, cooling: Column, failed: Column, skipped: Column,
                   requested: Column) -> Column:
    """F35 for a connector that visits several accounts; all arguments but ``ok`` are counts."""
    return (
        F.when((requested > 0) & (skipped == requested), F.lit("cooldown_skip"))
        .when((cooling > 0) | (failed > 0), F.lit("degraded"))
        .otherwise(connector_status(ok, validated))
    )


def run_status(exit_code: Column, ok: Column, listings: Column, connector_statuses: Column) -> Column:
    """F35 for a whole run."""
    distinct = F.array_distinct(F.transform(connector_statuses, or_blank))
    only_cooling = (F.size(distinct) == 1) & (F.element_at(distinct, 1) == "cooldown_skip")
    return (
        F.when(F.coalesce(F.when(F.size(distinct) > 0, only_cooling), F.lit(False)), F.lit("cooldown_skip"))
        .when((exit_code == 0) & ok & (F.coalesce(listings, F.lit(0)) > 0), F.lit("success"))
        .when((exit_code == 0) & ok, F.lit("no_new_data"))
        .otherwise(F.lit("degraded"))
    )


def unseen_count(acknowledged_revision, acknowledged_count, revision, count) -> Column:
    """F40."""
    changed = acknowledged_revision != revision
    return F.when(changed, F.greatest(F.lit(0).cast("bigint"), count - acknowledged_count)).otherwise(
        F.lit(0).cast("bigint"))


def active_filter_groups(platforms, statuses, locations, conditions, min_price, max_price) -> Column:
    """F30."""
    groups = [F.coalesce(F.size(a) > 0, F.lit(False)) for a in (platforms, statuses, locations, conditions)]
    groups.append(min_price.isNotNull() | max_price.isNotNull())
    total = F.lit(0)
    for g in groups:
        total = total + g.cast("int")
    return total


# Identities --------------------------------------------------------------------------------------------------------

def listing_identity(external_id="external_id", source_url="source_url") -> Column:
    """first non-blank of external id and source URL, blank when both are."""
    return F.coalesce(F.nullif(F.col(external_id), F.lit("")), F.col(source_url), F.lit(""))


def card_identity(item_id: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(item_id, F.lit("")), url, F.lit(""))


def record_id(key: Column) -> Column:
    """stable 32-digit id, so that a retried batch writes the same rows."""
    return F.left(F.sha2(key, 256), F.lit(32))


def candidate_key(platform: Column, external_id: Column, source_url: Column) -> Column:
    """PLATFORM:identity; a row without identity is an error."""
    name = F.upper(F.coalesce(F.nullif(platform, F.lit("")), F.lit("UNKNOWN")))
    identity = F.coalesce(blank_to_null(external_id), F.nullif(canonical_url(source_url), F.lit("")))
    return F.when(identity.isNull(), F.raise_error(F.lit("candidate requires external_id or source_url"))) \
        .otherwise(F.concat(name, F.lit(":"), identity))


def evidence_fingerprint(platform: Column, source_url: Column, external_id: Column, title: Column,
                         description: Column, seller_name: Column, source_facts: Column) -> Column:
    """F8: hash of the JSON text, keys sorted, of what a reviewer would look at. Images and posting time do not count.

    ``source_facts`` is a map; its entries are sorted so that equal maps give equal hashes. Group posts count by
    identity only, so edits never send them back to review.
    """
    name = F.upper(F.coalesce(F.nullif(platform, F.lit("")), F.lit("UNKNOWN")))
    url, external, named = (canonical_url(source_url).alias("sourceUrl"), or_blank(external_id).alias("externalId"),
                            name.alias("platform"))
    facts = F.map_from_entries(F.array_sort(F.map_entries(source_facts)))
    keep_nulls = {"ignoreNullFields": "false"}
    group = F.to_json(F.struct(external, named, F.lit("facebook_group").alias("sourceType"), url), keep_nulls)
    full = F.to_json(F.struct(
        description.alias("description"), or_blank(external_id).alias("externalId"), name.alias("platform"),
        seller_name.alias("sellerName"), facts.alias("sourceFacts"), canonical_url(source_url).alias("sourceUrl"),
        title.alias("title")), keep_nulls)
    is_group = F.coalesce(F.try_element_at(source_facts, F.lit("sourceType")) == "facebook_group", F.lit(False))
    return F.concat(F.lit("v2:"), F.sha2(F.when(is_group, group).otherwise(full), 256))


# Media -------------------------------------------------------------------------------------------------------------

def image_type(content: Column) -> Column:
    """F32: MIME type by the first bytes; null when unsupported."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), F.lit("image/jpeg"))
        .when(head.startswith("89504E470D0A1A0A"), F.lit("image/png"))
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("image/webp"))
        .when((F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin("61766966", "61766973"),
              F.lit("image/avif"))
    )


def image_extension(mime: Column) -> Column:
    return F.when(mime == "image/jpeg", F.lit("jpg")).otherwise(F.regexp_extract(mime, "^image/(.*)$", 1))


def blank_integer(c: Column) -> Column:
    """Missing or unparsable integers count as zero."""
    return F.coalesce(lenient_integer(c), F.lit(0).cast("bigint"))
