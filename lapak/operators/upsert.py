"""Set-based merges of batches into snapshots (SNK1-SNK6, T5 building blocks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapak.functions.text import blank_to_null
from lapak.functions.urls import canonical_url
from lapak.functions.values import record_id
from lapak.operators.ordering import dedupe_last
from lapak.schemas import CACHE_FIELDS, LISTING_COLUMNS, REJECTION

_OVERWRITTEN = [c for c in LISTING_COLUMNS
                if c not in ("id", "source_url", "first_fetched_at", "created_at", "updated_at")]


def upsert_listings(current: DataFrame, batch: DataFrame, as_of, seq: str = "seq",
                    near: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """SNK1: (next snapshot, one-row summary).

    Key is the source URL and the last row of a batch wins. A match keeps id, first fetch and creation time and
    overwrites the rest, also with null. ``batch`` carries the listing columns and an arrival number. ``near`` are columns
    that follow from the key and by which the batch has been shuffled; it is not shuffled again for its last rows then.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    keyed = batch.withColumn("source_url", F.when(
        blank_to_null(F.col("source_url")).isNull(), F.raise_error(F.lit("cannot write a listing without source_url"))
    ).otherwise(blank_to_null(F.col("source_url"))))
    fresh = dedupe_last(keyed, [*near, "source_url"], seq).select(
        "source_url", F.lit(True).alias("_new"), F.col("id").alias("_id"), F.col("first_fetched_at").alias("_first"),
        *[F.col(c).alias("_" + c) for c in _OVERWRITTEN])
    merged = current.withColumn("_old", F.lit(True)).join(fresh, "source_url", "full_outer")
    hit = F.col("_new").isNotNull()
    chosen = {c: F.when(hit, F.col("_" + c)).otherwise(F.col(c)) for c in _OVERWRITTEN}
    chosen.update(
        id=F.coalesce("id", "_id"), source_url=F.col("source_url"),
        first_fetched_at=F.when(F.col("_old").isNull(), F.col("_first")).otherwise(F.col("first_fetched_at")),
        created_at=F.when(F.col("_old").isNull(), now).otherwise(F.col("created_at")),
        updated_at=F.when(hit, now).otherwise(F.col("updated_at")),
    )
    nxt = merged.select(*[chosen[c].alias(c) for c in LISTING_COLUMNS])
    return nxt, upsert_summary(current, keyed)


def upsert_summary(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Counts of SNK1 without touching wide rows: one aggregation of the batch by URL, one narrow join."""
    per_url = batch.groupBy("source_url").agg(F.count(F.lit(1)).alias("n"))
    known = current.select("source_url", F.lit(True).alias("_old"))
    zero = F.lit(0).cast("bigint")
    return per_url.join(known, "source_url", "left").agg(
        F.coalesce(F.sum("n"), zero).alias("requested"), F.count(F.lit(1)).alias("deduplicated"),
        F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicates"),
        F.count_if(F.col("_old").isNull()).alias("inserted"), F.count_if(F.col("_old").isNotNull()).alias("updated"))


def replace_images(current_images: DataFrame, batch_images: DataFrame, touched: DataFrame, seq: str = "seq",
                   near: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """SNK2: (next images, one-row summary of deleted and inserted rows).

    All images of a touched listing give way to the batch, last row per position. A new image without cache fields
    takes them from the old image at the same position with the same canonical URL; partly filled fields are an error.
    ``touched`` has one column listing_id; ``near`` as in ``upsert_listings``.
    """
    ids = touched.select("listing_id").distinct()
    filled = F.size(F.array_compact(F.array(*[F.col(c).cast("string") for c in CACHE_FIELDS])))
    checked = batch_images.withColumn("position", F.when(
        filled.between(1, len(CACHE_FIELDS) - 1),
        F.raise_error(F.lit("cached image metadata must be complete or absent"))).otherwise(F.col("position")))
    newest = dedupe_last(checked.withColumn("_filled", filled > 0), [*near, "listing_id", "position"], seq)
    # Only rows with something to carry are moved, and all three passes leave out null listings at the same place, so
    # that one shuffle of the current images can serve them.
    known, stray = (current_images.filter(c) for c in (F.col("listing_id").isNotNull(), F.col("listing_id").isNull()))
    carries = F.greatest(*[F.col(c).isNotNull() for c in CACHE_FIELDS])
    old = known.filter(carries).withColumn("_url", canonical_url(F.col("source_url"))).select(
        "listing_id", "position", "_url", *[F.col(c).alias("_" + c) for c in CACHE_FIELDS])
    carried = newest.withColumn("_url", canonical_url(F.col("source_url"))).join(
        old, ["listing_id", "position", "_url"], "left")
    inserted = carried.select(
        record_id(F.concat_ws(":", "listing_id", F.col("position").cast("string"), "source_url")).alias("id"),
        "listing_id", "source_url",
        *[F.when(F.col("_filled"), F.col(c)).otherwise(F.col("_" + c)).alias(c) for c in CACHE_FIELDS],
        "position", "alt_text")
    kept = known.join(ids, "listing_id", "left_anti").unionByName(stray).select(*inserted.columns)
    summary = image_summary(current_images, batch_images, ids)
    return kept.unionByName(inserted), summary


def image_summary(current_images: DataFrame, batch_images: DataFrame, ids: DataFrame) -> DataFrame:
    deleted = current_images.join(ids, "listing_id", "left_semi").agg(F.count(F.lit(1)).alias("images_deleted"))
    inserted = batch_images.select("listing_id", "position").distinct().agg(F.count(F.lit(1)).alias("n"))
    return deleted.select("images_deleted", inserted.scalar().alias("images_inserted"))


def upsert_rejections(ledger: DataFrame, batch: DataFrame, as_of, seq: str = "seq") -> DataFrame:
    """SNK3: ledger after a batch of rejections. The counter grows with every occurrence, the last one gives the text.

    ``batch`` carries platform, source_url, external_id, title, description, seller_name and reason_code.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    fields = ["platform", "external_id", "title", "description", "seller_name", "reason_code"]
    counts = batch.groupBy("source_url").agg(F.count(F.lit(1)).alias("_n"))
    last = dedupe_last(batch, "source_url", seq).select("source_url", *[F.col(c).alias("_" + c) for c in fields])
    fresh = last.join(counts, "source_url")
    merged = ledger.join(fresh, "source_url", "full_outer")
    hit = F.col("_n").isNotNull()
    chosen = {c: F.when(hit, F.col("_" + c)).otherwise(F.col(c)) for c in fields}
    chosen.update(
        id=F.coalesce("id", record_id(F.col("source_url"))), source_url=F.col("source_url"),
        first_rejected_at=F.coalesce("first_rejected_at", now),
        last_rejected_at=F.when(hit, now).otherwise(F.col("last_rejected_at")),
        rejection_count=F.coalesce("rejection_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
    )
    return merged.select(*[chosen[c].alias(c) for c in REJECTION.fieldNames()])


def clear_rejections(ledger: DataFrame, accepted: DataFrame) -> DataFrame:
    """SNK4: an accepted listing removes its rejection."""
    return ledger.join(accepted.select("source_url"), "source_url", "left_anti")


def update_reconciled(listings: DataFrame, evidence: DataFrame, visible_ids: DataFrame, platform: str,
                      as_of) -> DataFrame:
    """SNK5: apply checked evidence (source_url, status, checked) to open, still visible listings of a platform.

    The fetch time always advances; the update time moves only when the status changes.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    checked = evidence.filter("checked").select("source_url", F.col("status").alias("_status"), F.lit(True).alias("_hit"))
    seen = visible_ids.select("id", F.lit(True).alias("_visible"))
    rows = listings.join(checked, "source_url", "left").join(seen, "id", "left")
    hit = (F.coalesce("_hit", F.lit(False)) & F.coalesce("_visible", F.lit(False)) & (F.col("platform") == platform)
           & F.col("status").isin("available", "unknown"))
    moved = hit & F.col("_status").isNotNull() & (F.col("_status") != F.col("status"))
    changes = {
        "status": F.when(hit, F.coalesce("_status", "status")).otherwise(F.col("status")),
        "last_fetched_at": F.when(hit, now).otherwise(F.col("last_fetched_at")),
        "updated_at": F.when(moved, now).otherwise(F.col("updated_at")),
    }
    return rows.select(*[changes.get(c, F.col(c)).alias(c) for c in listings.columns])


def update_media_cache(images: DataFrame, cached: DataFrame) -> DataFrame:
    """SNK6: fill the six cache fields by image id, only where no cached URL is stored yet."""
    found = cached.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias("_" + c) for c in CACHE_FIELDS])
    rows = images.join(found, "id", "left")
    fill = F.col("_hit").isNotNull() & F.col("cached_url").isNull()
    new = {c: F.when(fill, F.col("_" + c)).otherwise(F.col(c)) for c in CACHE_FIELDS}
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in images.columns])
