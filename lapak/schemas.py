"""Declared schemas and the fixed value sets of the listing contract."""

from pyspark.sql import types as T

# Enumerations of the public contract.
PLATFORMS = ("reddit", "instagram", "facebook", "facebook_group")
STATUSES = ("available", "sold", "unknown")
SELLER_STATUSES = ("review", "blocked", "allowlisted")
FACEBOOK_PLATFORMS = ("facebook", "facebook_group")
FEED_SORTS = ("newest", "price-high", "price-low", "available-first", "sold-first")
REJECTION_REASONS = (
    "NOT_A_LISTING",
    "OUT_OF_SCOPE",
    "MARKETPLACE_STORE_OR_PROMOTION",
    "MARKETPLACE_CONTACT_OR_STORE_INFO",
    "WANTED_OR_SERVICE",
    "OTHER",
)
CONDITIONS = ("Baru / BNIB", "Like New", "Bekas - baik", "Bekas - normal", "Bekas - minus")

# Collection slug -> categories, in display order.
COLLECTIONS = (
    ("all", ()),
    ("laptop", ("Laptop",)),
    ("gpu", ("Graphics Card",)),
    ("pc-build", ("Desktop PC", "PC Case", "CPU", "RAM", "Storage", "Motherboard", "Power Supply")),
    ("peripheral", ("Keyboard", "Mouse", "Peripheral", "Audio", "Network Adapter")),
    ("monitor", ("Monitor",)),
    ("gaming", ("Game Console", "Game", "Controller", "Handheld PC")),
    ("smartphone", ("Smartphone",)),
)

_S, _I, _L, _B, _D, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampNTZType(),
)


def _struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


LISTING = _struct(
    ("id", _S), ("platform", _S), ("source_url", _S), ("external_id", _S), ("title", _S), ("description", _S),
    ("category", _S), ("brand", _S), ("price", _I), ("location_texts", T.ArrayType(_S)), ("condition_text", _S),
    ("seller_name", _S), ("status", _S), ("posted_at", _TS), ("first_fetched_at", _TS), ("last_fetched_at", _TS),
    ("created_at", _TS), ("updated_at", _TS),
)
LISTING_COLUMNS = tuple(LISTING.fieldNames())
CACHE_FIELDS = ("cached_url", "storage_key", "content_hash", "content_type", "byte_size", "cached_at")
IMAGE = _struct(
    ("id", _S), ("listing_id", _S), ("source_url", _S), ("cached_url", _S), ("storage_key", _S), ("content_hash", _S),
    ("content_type", _S), ("byte_size", _L), ("cached_at", _TS), ("position", _I), ("alt_text", _S),
)
MODERATION = _struct(("listing_id", _S), ("hidden", _B), ("seller_name_override", _S))
CONTROL = _struct(("platform", _S), ("public_visible", _B))
CONTENT_BLOCK = _struct(("platform", _S), ("field", _S), ("normalized_value", _S))
REJECTION = _struct(
    ("id", _S), ("platform", _S), ("source_url", _S), ("external_id", _S), ("title", _S), ("description", _S),
    ("seller_name", _S), ("reason_code", _S), ("first_rejected_at", _TS), ("last_rejected_at", _TS),
    ("rejection_count", _L),
)

# Connector contract as it arrives: everything is text until validated.
CONTRACT_IMAGE = _struct(("source_url", _S), ("position", _S), ("alt_text", _S))
CONTRACT = _struct(
    ("platform", _S), ("source_url", _S), ("external_id", _S), ("title", _S), ("description", _S), ("category", _S),
    ("brand", _S), ("price", _S), ("location_texts", T.ArrayType(_S)), ("condition_text", _S), ("seller_name", _S),
    ("status", _S), ("posted_at", _S), ("first_fetched_at", _S), ("last_fetched_at", _S),
    ("images", T.ArrayType(CONTRACT_IMAGE)),
)
CONTRACT_COLUMNS = tuple(CONTRACT.fieldNames())

# Run logs: scheduler and orchestrator records share one declared shape.
STORAGE_COUNTERS = (
    "requested", "deduplicated", "duplicates", "inserted", "updated", "imagesDeleted", "imagesInserted",
)
_COUNTERS = _struct(*((name, _L) for name in STORAGE_COUNTERS))
_STORAGE = _struct(("ok", _B), ("summary", _COUNTERS))
_CONNECTOR = _struct(
    ("connector", _S), ("ok", _B), ("status", _S), ("exitCode", _L), ("normalized", _L), ("validated", _L),
    ("validationErrors", _L), ("durationMs", _L),
)
_RUN_TOTALS = _struct(("connectors", _L), ("succeeded", _L), ("failed", _L), ("listings", _L))
_RUN_SUMMARY = _struct(
    ("ok", _B), ("summary", _RUN_TOTALS), ("storage", _STORAGE), ("connectors", T.ArrayType(_CONNECTOR)),
)
RUN_LOG = _struct(
    ("source", _S), ("status", _S), ("ok", _B), ("job_id", _S), ("logged_at", _S), ("started_at", _S),
    ("finished_at", _S), ("durationMs", _L), ("storage", _STORAGE), ("connectors", T.ArrayType(_CONNECTOR)),
    ("summary", T.StructType(_RUN_SUMMARY.fields + [T.StructField(f.name, f.dataType) for f in _RUN_TOTALS.fields
                                                    if f.name not in ("connectors",)])),
)

QUEUE = _struct(
    ("id", _S), ("candidate_key", _S), ("platform", _S), ("source_id", _S), ("fingerprint", _S), ("payload_json", _S),
    ("status", _S), ("attempts", _I), ("enqueued_at", _TS), ("available_at", _TS), ("leased_at", _TS),
    ("done_at", _TS), ("error", _S),
)
CANDIDATE_STATE = _struct(
    ("candidate_key", _S), ("platform", _S), ("source_id", _S), ("fingerprint", _S), ("first_seen_at", _TS),
    ("last_seen_at", _TS), ("seen_count", _L),
)

# Extracted records.
CARD = _struct(
    ("item_id", _S), ("url", _S), ("price", _S), ("price_amount", _L), ("title", _S), ("location", _S),
    ("image_url", _S), ("image_alt", _S), ("raw_text", _S), ("seller_name", _S), ("is_newly_listed", _B),
    ("is_live", _B), ("is_sold", _B), ("is_pending", _B), ("is_hidden", _B),
)
GROUP_IMAGE = _struct(("url", _S), ("alt", _S))
COMMERCE_FIELDS = ("product_id", "formatted_price", "location_text", "seller_id", "seller_name")
GROUP_RECORD = _struct(
    ("post_id", _S), ("group_id", _S), ("permalink", _S), ("message", _S), ("seller_id", _S), ("seller_name", _S),
    ("published_timestamp", _L), ("images", T.ArrayType(GROUP_IMAGE)),
    ("commerce", _struct(*((name, _S) for name in COMMERCE_FIELDS))), ("used_attached_story", _B),
)
PROFILE_RECORD = _struct(
    ("shortcode", _S), ("pk", _S), ("taken_at", _L), ("caption", _S), ("display_url", _S), ("thumbnail_src", _S),
    ("children", T.ArrayType(_S)), ("media_count", _L), ("media_type", _L), ("product_type", _S),
)
