"""Model review of candidate batches: packing, checking, merging, routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lapak.functions.text import blank_to_null, or_blank, strip
from lapak.functions.values import (
    normalize_condition, normalize_locations, normalize_price_text, normalize_status,
)
from lapak.operators.ordering import pack_batches
from lapak.schemas import REJECTION_REASONS


def pack_review_batches(rows: DataFrame, order: list[Column], size: int = 5) -> DataFrame:
    """Batch number and request JSON of at most ``size`` listings in the given order.

    ``rows`` carry platform, external_id, title, description and the map source_facts.
    """
    item = F.struct(
        or_blank(F.col("platform")).alias("platform"), or_blank(F.col("external_id")).alias("externalId"),
        or_blank(F.col("title")).alias("title"), or_blank(F.col("description")).alias("description"),
        F.col("source_facts").alias("sourceFacts"))
    packed = pack_batches(rows, order, size, F.to_json(item))
    request = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    return packed.select("batch", F.size("items").alias("n_items"), request.alias("request"))


def is_group_item() -> Column:
    return (F.try_element_at("source_facts", F.lit("sourceType")) == "facebook_group") | (
        F.upper(strip(F.col("platform"))) == "FACEBOOK_GROUP")


def match_results(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Listings and results side by side by (batch, external id); either side may be missing.

    Result columns get the prefix ``r_``.
    """
    left = rows.withColumn("external_id", or_blank(F.col("external_id"))).withColumn("_listed", F.lit(True))
    right = results.select(
        "batch", or_blank(F.col("external_id")).alias("external_id"), F.lit(True).alias("_answered"),
        *[F.col(c).alias("r_" + c) for c in results.columns if c not in ("batch", "external_id")])
    return left.join(right, ["batch", "external_id"], "full_outer")


def validate_review(rows: DataFrame, results: DataFrame) -> DataFrame:
    """One row per batch with ``valid`` and the first broken rule.

    A batch needs exactly one result per listing and distinct ids; a rejection reason must fit the platform; an
    Instagram title must say more than the post id. Item rules only count once the id sets match.
    """
    ids = lambda df, flag: df.groupBy("batch", or_blank(F.col("external_id")).alias("external_id")).agg(
        F.count(F.lit(1)).alias(flag))
    pairs = ids(rows, "n_listed").join(ids(results, "n_answered"), ["batch", "external_id"], "full_outer")
    shape = pairs.groupBy("batch").agg(
        F.bool_and((F.coalesce("n_listed", F.lit(0)) == 1) & (F.coalesce("n_answered", F.lit(0)) == 1)).alias("_match"))
    matched = match_results(rows, results)
    accepted = F.coalesce(F.col("r_is_listing"), F.lit(False))
    reason = F.upper(strip(F.coalesce(F.nullif("r_rejection_reason", F.lit("")), F.lit("OTHER"))))
    platform = F.upper(strip(or_blank(F.col("platform"))))
    is_group = F.coalesce(is_group_item(), F.lit(False))
    title = blank_to_null(F.col("r_title"))
    scope = ~accepted & (reason == "OUT_OF_SCOPE") & ~is_group
    market = ~accepted & reason.startswith("MARKETPLACE_") & reason.isin(*REJECTION_REASONS) & (platform != "FACEBOOK")
    bare = accepted & (platform == "INSTAGRAM") & (
        title.isNull() | (F.lower(title) == F.lower(strip(F.col("external_id")))))
    flags = matched.groupBy("batch").agg(*[
        F.coalesce(F.bool_or(test), F.lit(False)).alias(name)
        for test, name in ((scope, "_scope"), (market, "_market"), (bare, "_bare"))])
    error = (
        F.when(~F.col("_match"), F.lit("not exactly one result for every listing"))
        .when(F.col("_scope"), F.lit("OUT_OF_SCOPE is valid only for group items"))
        .when(F.col("_market"), F.lit("marketplace reason on another platform"))
        .when(F.col("_bare"), F.lit("invalid Instagram title"))
    )
    return shape.join(flags, "batch").select("batch", error.isNull().alias("valid"), error.alias("error"))


def merge_results(rows: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of batches that passed ``validate_review``.

    Price, places and condition come from the result alone; a sold or available status of a Marketplace or Reddit
    source beats the result; group posts count as available; the seller name only ever comes from the source.
    """
    matched = match_results(rows, results).filter("_listed and _answered")
    accepted = F.coalesce(F.col("r_is_listing"), F.lit(False))
    source_status = F.upper(F.coalesce(F.nullif("status", F.lit("")), F.lit("UNKNOWN")))
    fixed = F.when(F.upper(or_blank(F.col("platform"))).isin("FACEBOOK", "REDDIT")
                   & source_status.isin("AVAILABLE", "SOLD"), source_status)
    in_group = F.coalesce(F.try_element_at("source_facts", F.lit("sourceType")) == "facebook_group", F.lit(False))
    changes = {
        "title": F.coalesce(blank_to_null(F.col("r_title")), "title"),
        "price": normalize_price_text(F.col("r_price")),
        "location_texts": normalize_locations(F.col("r_location_texts")),
        "condition_text": normalize_condition(F.col("r_condition_text")),
        "status": F.when(in_group, F.lit("AVAILABLE")).otherwise(
            F.coalesce(fixed, normalize_status(F.col("r_status")), F.lit("UNKNOWN"))),
        "category": blank_to_null(F.col("r_category")),
        "brand": blank_to_null(F.col("r_brand")),
        "seller_name": blank_to_null(F.col("seller_name")),
    }
    kept = [c for c in rows.columns if c != "source_facts"]
    yes = matched.filter(accepted).select(*[changes.get(c, F.col(c)).alias(c) for c in kept])
    reason = F.upper(strip(F.coalesce(F.nullif("r_rejection_reason", F.lit("")), F.lit("OTHER"))))
    no = matched.filter(~accepted).select(
        *kept, F.when(reason.isin(*REJECTION_REASONS), reason).otherwise(F.lit("OTHER")).alias("reason_code"))
    return yes, no


def route_batches(accepted: DataFrame, rejected: DataFrame, rows: DataFrame, checks: DataFrame,
                  invalid: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, retry). One invalid row or a failed check sends its whole batch to retry.

    ``checks`` is the result of ``validate_review``; ``invalid`` has the batches of rows that broke the contract.
    """
    broken = checks.filter(~F.col("valid")).select("batch").union(invalid.select("batch")).distinct()
    return (
        accepted.join(broken, "batch", "left_anti"),
        rejected.join(broken, "batch", "left_anti"),
        rows.join(broken, "batch", "left_semi"),
    )


def enrich(batches: DataFrame, fn: Callable[[str], str], out_schema: str) -> DataFrame:
    """Apply a user-supplied callable to each packed request, inside the tasks.

    ``fn`` takes the request JSON and returns the answer JSON array; ``out_schema`` is the DDL of one answer item.
    No client is shipped here.
    """
    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"batch": frame["batch"], "answer": frame["request"].map(fn)})

    raw = batches.select("batch", "request").mapInPandas(answer, "batch bigint, answer string")
    items = F.explode(F.from_json("answer", f"array<struct<{out_schema}>>"))
    return raw.select("batch", items.alias("_i")).select("batch", "_i.*")
