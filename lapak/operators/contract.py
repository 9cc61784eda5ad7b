"""Connector contract: validation, storage coercion, source facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapak.functions.once import computed
from lapak.functions.text import blank_to_null, lenient_integer, or_blank, strip
from lapak.functions.values import listing_identity, parse_iso, record_id
from lapak.schemas import CONTRACT_COLUMNS

# Contract messages.
PLATFORM_ERROR = "platform must be REDDIT, INSTAGRAM, FACEBOOK, or FACEBOOK_GROUP"
STATUS_ERROR = "status must be AVAILABLE, SOLD, or UNKNOWN"
WIRE_PLATFORMS = ("REDDIT", "INSTAGRAM", "FACEBOOK", "FACEBOOK_GROUP")
WIRE_STATUSES = ("AVAILABLE", "SOLD", "UNKNOWN")


OBJECT_ERROR = "listing must be an object"
LOCATIONS_ERROR = "locationTexts must be a string array"
IMAGES_ERROR = "images must be an array"
# What the JSON reader found out about types; the text columns of the contract cannot say it.
SHAPES = ("is_object", "has_locations", "has_images")
_WIRE = {c: "".join(w if k == 0 else w.capitalize() for k, w in enumerate(c.split("_"))) for c in CONTRACT_COLUMNS}
_NOT_IT = "?"  # neither a number nor a time, so the rules on the text refuse it


def contract_of_json(rows: DataFrame, column: str = "value") -> DataFrame:
    """The contract columns of listings written as JSON text, and ``SHAPES``; other columns pass through.

    The text is read as VARIANT, so types are those of the JSON: a price in quotes is no number, a missing position is
    not a null one. Text fields take any value as text. What is no JSON, or no object, gives a row without values.
    """
    parsed = computed(rows, _json=F.try_parse_json(F.col(column)))
    own = {c: F.try_variant_get("_json", f"$.{_WIRE[c]}", "variant") for c in CONTRACT_COLUMNS}
    fields = computed(parsed, **{"_v_" + c: v for c, v in own.items()}, _kind=_kind(F.col("_json")))
    value = {c: F.col("_v_" + c) for c in CONTRACT_COLUMNS}
    kinds = {c: _kind(value[c]) for c in CONTRACT_COLUMNS}
    read = {c: _as_text(value[c], kinds[c]) for c in CONTRACT_COLUMNS if c not in ("location_texts", "images")}
    for c in ("posted_at", "first_fetched_at", "last_fetched_at"):
        read[c] = F.when(kinds[c].isin("STRING", "VOID"), read[c]).otherwise(F.lit(_NOT_IT))
    read["price"] = F.when(kinds["price"].isin("BIGINT", "VOID"), read["price"]).otherwise(F.lit(_NOT_IT))
    place = F.filter(F.try_variant_get(value["location_texts"], "$", "array<variant>"), lambda v: _kind(v) == "STRING")
    read["location_texts"] = F.transform(place, lambda v: v.cast("string"))
    read["images"] = F.transform(F.try_variant_get(value["images"], "$", "array<variant>"), _image_of_json)
    shapes = {"is_object": F.startswith("_kind", F.lit("OBJECT")),
              "has_locations": (kinds["location_texts"] == "VOID") | F.startswith(kinds["location_texts"], F.lit("ARRAY")),
              "has_images": (kinds["images"] == "VOID") | F.startswith(kinds["images"], F.lit("ARRAY"))}
    kept = [c for c in rows.columns if c not in CONTRACT_COLUMNS and c not in SHAPES]
    return computed(fields, **read, **shapes).select(*kept, *CONTRACT_COLUMNS, *SHAPES)


def _kind(value: Column) -> Column:
    """Type of a VARIANT; VOID for a missing one and for JSON's null."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _as_text(value: Column, kind: Column) -> Column:
    return F.when(kind == "BOOLEAN", F.initcap(value.cast("string"))).when(kind != "VOID", value.cast("string"))


def _image_of_json(image: Column) -> Column:
    field = lambda name: F.try_variant_get(image, f"$.{name}", "variant")
    text = lambda name: _as_text(field(name), _kind(field(name)))
    position = F.when(field("position").isNull(), F.lit(None)).when(_kind(field("position")) == "BIGINT", field(
        "position").cast("string")).otherwise(F.lit(_NOT_IT))
    return F.when(F.startswith(_kind(image), F.lit("OBJECT")), F.struct(
        text("sourceUrl").alias("source_url"), position.alias("position"), text("altText").alias("alt_text")))


def validate_contract(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid). Invalid rows carry every error, joined, behind their identity.

    Input columns are the contract as text plus arrays, with ``SHAPES`` if they come from ``contract_of_json``; further
    columns pass through to both results.
    """
    checked = _checked(rows)
    passing = [c for c in rows.columns if c not in CONTRACT_COLUMNS and c not in SHAPES]
    valid = checked.filter(F.size("_errors") == 0).select(
        *passing, *[F.col(f"_c.{c}").alias(c) for c in CONTRACT_COLUMNS])
    identity = F.coalesce(F.col("_c.external_id"), F.nullif(F.col("_c.source_url"), F.lit("")), F.lit("<unknown>"))
    said = F.array_join("_errors", "; ")
    error = F.concat(identity, F.lit(": "), said)
    if "is_object" in rows.columns:
        error = F.when(F.col("is_object"), error).otherwise(said)
    invalid = checked.filter(F.size("_errors") > 0).select(*passing, error.alias("error"), "source_url")
    return valid, invalid


def _checked(rows: DataFrame) -> DataFrame:
    times = ("posted_at", "first_fetched_at", "last_fetched_at")
    parsed = {"_" + c: blank_to_null(F.col(c)) for c in CONTRACT_COLUMNS if c not in ("location_texts", "images")}
    parsed.update({"_at_" + c: parse_iso(F.col(c)) for c in times}, _number=lenient_integer(F.col("price")))
    # Parsing happens once; rules and cleaned values below only look at its results.
    once = computed(rows, **parsed)
    text = {c: F.col("_" + c) for c in CONTRACT_COLUMNS if c not in ("location_texts", "images")}
    platform, status = F.upper(text["platform"]), F.upper(text["status"])
    errors = [
        F.when(~F.coalesce(platform.isin(*WIRE_PLATFORMS), F.lit(False)), F.lit(PLATFORM_ERROR)),
        F.when(~F.coalesce(status.isin(*WIRE_STATUSES), F.lit(False)), F.lit(STATUS_ERROR)),
    ]
    for column, wire in (("source_url", "sourceUrl"), ("title", "title"), ("description", "description"),
                         ("first_fetched_at", "firstFetchedAt"), ("last_fetched_at", "lastFetchedAt")):
        errors.append(F.when(text[column].isNull(), F.lit(f"{wire} is required")))
    for column, wire in zip(times, ("postedAt", "firstFetchedAt", "lastFetchedAt")):
        errors.append(F.when((or_blank(F.col(column)) != "") & F.col("_at_" + column).isNull(),
                             F.lit(f"{wire} must be an ISO datetime string or null")))
    price = F.col("_number")
    errors.append(F.when(F.col("price").isNotNull() & price.isNull(), F.lit("price must be an integer or null")))
    errors.append(F.when(price < 0, F.lit("price must be zero or greater")))
    image_errors = F.filter(F.transform("images", _image_error), lambda e: e.isNotNull())
    if set(SHAPES) <= set(rows.columns):
        errors.append(F.when(~F.col("has_locations"), F.lit(LOCATIONS_ERROR)))
        errors.append(F.when(~F.col("has_images"), F.lit(IMAGES_ERROR)))
    all_errors = F.concat(F.array_compact(F.array(*errors)),
                          F.coalesce(image_errors, F.array().cast("array<string>")))
    if "is_object" in rows.columns:
        all_errors = F.when(F.col("is_object"), all_errors).otherwise(F.array(F.lit(OBJECT_ERROR)))
    clean = {
        **text, "platform": platform, "status": status, **{c: F.col("_at_" + c) for c in times}, "price": price,
        "location_texts": F.coalesce(
            F.filter(F.transform("location_texts", strip), lambda v: v != ""), F.array().cast("array<string>")),
        "images": F.coalesce(
            F.transform(F.filter("images", lambda i: i.isNotNull()), _clean_image),
            F.array().cast("array<struct<source_url:string,position:int,alt_text:string>>")),
    }
    whole = F.struct(*[clean[c].alias(c) for c in CONTRACT_COLUMNS])
    return computed(once, _errors=all_errors, _c=whole).drop(*parsed)


def _image_error(image: Column, index: Column) -> Column:
    place = F.concat(F.lit("images["), index.cast("string"), F.lit("]"))
    return (
        F.when(image.isNull(), F.concat(place, F.lit(" must be an object")))
        .when(blank_to_null(image["source_url"]).isNull(), F.concat(place, F.lit(".sourceUrl is required")))
        .when(image["position"].isNotNull() & lenient_integer(image["position"]).isNull(),
              F.concat(place, F.lit(".position must be an integer")))
    )


def _clean_image(image: Column, index: Column) -> Column:
    return F.struct(
        strip(image["source_url"]).alias("source_url"),
        F.coalesce(lenient_integer(image["position"]), index.cast("bigint")).cast("int").alias("position"),
        blank_to_null(image["alt_text"]).alias("alt_text"),
    )


def coerce_storage_row(valid: DataFrame) -> DataFrame:
    """Storage row of a validated listing: lower-case enumerations, blank to null, stable id.

    A value the storage rules forbid (unknown enumeration, missing text, negative price) is an error.
    """
    def required(column):
        value = blank_to_null(F.col(column))
        return F.when(value.isNull(), F.raise_error(F.lit(f"{column} is required"))).otherwise(value)

    def enumerated(column, allowed):
        value = F.upper(strip(F.col(column)))
        return F.when(~F.coalesce(value.isin(*allowed), F.lit(False)),
                      F.raise_error(F.lit(f"{column} must be one of the contract values"))).otherwise(F.lower(value))

    price = F.when(F.col("price") < 0, F.raise_error(F.lit("price must be zero or greater"))).otherwise(
        F.col("price").cast("int"))
    kept = [c for c in valid.columns if c not in CONTRACT_COLUMNS]
    return valid.select(
        *kept, record_id(F.col("source_url")).alias("id"), enumerated("platform", WIRE_PLATFORMS).alias("platform"),
        required("source_url").alias("source_url"), blank_to_null(F.col("external_id")).alias("external_id"),
        required("title").alias("title"), required("description").alias("description"),
        blank_to_null(F.col("category")).alias("category"), blank_to_null(F.col("brand")).alias("brand"),
        price.alias("price"), "location_texts", blank_to_null(F.col("condition_text")).alias("condition_text"),
        blank_to_null(F.col("seller_name")).alias("seller_name"), enumerated("status", WIRE_STATUSES).alias("status"),
        "posted_at", "first_fetched_at", "last_fetched_at", *(["images"] if "images" in valid.columns else []),
    )


def attach_source_facts(valid: DataFrame, raw: DataFrame, seq: str = "seq") -> DataFrame:
    """Give validated rows the private facts of the raw row with the same identity; the last raw row wins."""
    from lapak.operators.ordering import dedupe_last

    facts = raw.withColumn("_identity", listing_identity()).select("_identity", seq, "source_facts")
    last = dedupe_last(facts, "_identity", seq).drop(seq)
    return valid.withColumn("_identity", listing_identity()).join(last, "_identity", "left").drop("_identity")
