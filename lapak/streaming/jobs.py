"""Streaming jobs: upserts (T5), unseen counts (T6), run-log health (T7), seen filter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lapak.functions.text import blank_to_null
from lapak.functions.values import unseen_count
from lapak.operators.ordering import SEGMENT, segmented
from lapak.operators.upsert import clear_rejections, replace_images, upsert_listings, upsert_rejections
from lapak.schemas import IMAGE, LISTING, REJECTION
from lapak.session import scratch_path, shuffles_removed
from lapak.sources.tables import BucketedTable, apply_once


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into a table of the shared folder and read that table."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_in_parts(rows: DataFrame, cuts: list[Column], stream_of: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Run a stream over ``rows`` in parts that arrive one after another, restarted from its checkpoint each time.

    ``cuts`` are the conditions of the parts. The result is read as a table.
    """
    spark = rows.sparkSession
    base = scratch_path(spark, label)
    for cut in cuts:
        rows.filter(cut).write.mode("append").parquet(f"{base}/in")
        stream = stream_of(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option(
            "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@dataclass(frozen=True)
class Store:
    """Listings, images and rejections as bucketed tables below one folder."""

    base: str
    buckets: int = 64

    @property
    def listings(self) -> BucketedTable:
        return BucketedTable(f"{self.base}/listings", LISTING, "source_url", self.buckets)

    @property
    def images(self) -> BucketedTable:
        return BucketedTable(f"{self.base}/images", IMAGE, "listing_id", self.buckets)

    @property
    def rejections(self) -> BucketedTable:
        return BucketedTable(f"{self.base}/rejections", REJECTION, "source_url", self.buckets)


def galleries(accepted: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """Images of the ``images`` column of a batch, one row per listing: listing_id, images.

    The last row per URL gives the gallery. Rows that are not the last or whose listing is stored under another id are
    written apart; few as they are in most batches, they are joined without moving the galleries.
    ``ids`` has listing_id and listing_url.
    """
    own = accepted.select("source_url", "seq", "id").withColumn("_last", F.max("seq").over(Window.partitionBy("source_url")))
    last = F.col("seq") == F.col("_last")
    odd = own.join(ids.withColumnRenamed("listing_url", "source_url"), "source_url").filter(
        ~last | ~F.col("id").eqNullSafe(F.col("listing_id"))).select("source_url", "seq", "listing_id", last.alias("_kept"))
    odd.write.mode("overwrite").parquet(folder)
    moved = accepted.sparkSession.read.schema(odd.schema).parquet(folder)
    found = accepted.select("source_url", "seq", "id", "images").join(moved, ["source_url", "seq"], "left").filter(
        F.coalesce("_kept", F.lit(True)))
    return found.select(F.when(F.col("_kept").isNull(), F.col("id")).otherwise(F.col("listing_id")).alias("listing_id"), "images")


def apply_batch(spark: SparkSession, store: Store, accepted: DataFrame, images: DataFrame | None, rejected: DataFrame, as_of,
                batch_id: int, query_id: str = "") -> None:
    """T5 body, SNK1 to SNK4: merge a batch into the folders that hold its keys, and put what is new into new ones.

    ``accepted``: listing columns and seq; ``images``: source_url of the listing as listing_url, image columns and seq, or
    none if ``accepted`` has them as an array ``images``; ``rejected``: rejection columns and seq. The inputs of a
    micro-batch are read several times and give the same rows each time, as the sources of streams do. A batch is known by
    query and number.
    """
    def prepare(folder: str) -> None:
        new = accepted.withColumn("source_url", blank_to_null(F.col("source_url")))
        keys = new.select("source_url")
        held, to = store.listings.folders(spark, keys)
        batch, near = store.listings.spread(new, held)
        after, _ = upsert_listings(store.listings.read(spark, held), batch, as_of, near=near)
        store.listings.stage(after, held, to, f"{folder}/listings", near)
        staged = spark.read.schema(LISTING).parquet(f"{folder}/listings").filter("source_url is not null")
        # Without held folders only rows of the batch have been staged.
        ids = (staged.join(keys.distinct(), "source_url", "left_semi") if held else staged).select(
            F.col("id").alias("listing_id"), F.col("source_url").alias("listing_url"))
        held, to = store.images.folders(spark, ids.select("listing_id"))
        owned = galleries(new, ids, f"{folder}/moved") if images is None else images.withColumn(
            "listing_url", blank_to_null(F.col("listing_url"))).join(ids, "listing_url").drop("listing_url")
        batch, near = store.images.spread(owned, held)
        if images is None:
            batch = batch.select(*near, "listing_id", F.posexplode("images").alias("seq", "_i")).select(*near, "listing_id", "seq", "_i.*")
        after, _ = replace_images(store.images.read(spark, held), batch, ids, near=near)
        store.images.stage(after, held, to, f"{folder}/images", near)
        held, to = store.rejections.folders(spark, keys, rejected.select("source_url"))
        ledger = upsert_rejections(store.rejections.read(spark, held), rejected, as_of)
        store.rejections.stage(clear_rejections(ledger, new), held, to, f"{folder}/rejections")

    def put(folder: str) -> None:
        store.listings.replace(spark, f"{folder}/listings")
        store.images.replace(spark, f"{folder}/images")
        store.rejections.replace(spark, f"{folder}/rejections")

    apply_once(spark, f"{store.base}/_batches", f"{query_id}-{batch_id}", prepare, put)


def upsert_stream(stream: DataFrame, store: Store, split: Callable[[DataFrame], tuple[DataFrame, DataFrame | None, DataFrame]],
                  as_of, checkpoint: str):
    """T5: run a stream of reviewed rows into the tables of ``store``; replays change nothing.

    ``split`` turns a micro-batch into accepted listings, their images (none if they are a column) and rejections.
    """
    def body(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        with shuffles_removed(batch.sparkSession):
            apply_batch(batch.sparkSession, store, *split(batch), as_of, batch_id, own)

    query = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    query.awaitTermination()
    return query


def feed_revision(history: DataFrame, acknowledgements: DataFrame | None = None, segment_size: int = SEGMENT) -> DataFrame:
    """Unseen count at every observed version.

    ``history``: seq, revision, total_count, one row per poll; ``acknowledgements``: seq of the polls a reader
    confirmed. The first poll counts as confirmed. The confirmed version is carried inside segments of arrival numbers
    and, through one summary row per segment, across them, so no task sees the whole history.
    """
    rows = history.withColumn("_ack", F.lit(False))
    if acknowledgements is not None:
        marks = acknowledgements.select("seq", F.lit(True).alias("_mark")).distinct()
        rows = history.join(marks, "seq", "left").withColumn("_ack", F.coalesce("_mark", F.lit(False))).drop("_mark")
    rows = segmented(rows, "seq", segment_size).withColumn("_b", F.struct("revision", "total_count"))
    inside = Window.partitionBy("_seg").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    near = F.last(F.when(F.col("_ack"), F.col("_b")), ignorenulls=True).over(inside)
    segments = rows.groupBy("_seg").agg(
        F.max_by("_b", F.when(F.col("_ack"), F.col("seq"))).alias("_last"), F.min_by("_b", "seq").alias("_first"))
    before = Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, 0)
    carried = segments.select("_seg", F.coalesce(
        F.last("_last", ignorenulls=True).over(before), F.first("_first").over(whole)).alias("_far"))
    return rows.withColumn("_near", near).join(carried, "_seg").withColumn("_base", F.coalesce("_near", "_far")).select(
        "seq", "revision", "total_count",
        unseen_count(F.col("_base.revision"), F.col("_base.total_count"), F.col("revision"), F.col("total_count"))
        .alias("unseen"))


def run_log_health_stream(records: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts per connector and status and the latest record time, per event-time window.

    ``records``: logged_at, connector, status. The watermark bounds the state; it is ours, the log has none.
    """
    timed = records.withColumn("at", F.col("logged_at").cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", window), "connector", "status").agg(
        F.count(F.lit(1)).alias("count"), F.max("at").alias("latest")).select(
        F.col("window.start").alias("window_start"), "connector", "status", "count", "latest")


def seen_filter_stream(rows: DataFrame, delay: str = "7 days", key: str = "identity", at: str = "observed_at") -> DataFrame:
    """First sight of every identity within the time bound, which stands in for a bounded list of recent ids."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.dropDuplicatesWithinWatermark([key])
