"""Work queue over a snapshot: leases, outcomes, ready batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapak.operators.ordering import _nth

MAX_CAPACITY = 50
STALE = "stale lease recovered"
NEWER = "superseded by newer pending version"


def _at(as_of):
    return F.lit(as_of).cast("timestamp_ntz")


def recover_stale(queue: DataFrame, as_of, lease_seconds: int = 300) -> DataFrame:
    """Leases older than the lease time become pending again."""
    limit = F.timestamp_add("SECOND", F.lit(-max(1, lease_seconds)), _at(as_of))
    stale = F.coalesce((F.col("status") == "leased") & (F.col("leased_at") <= limit), F.lit(False))
    return queue.withColumns({
        "status": F.when(stale, F.lit("pending")).otherwise(F.col("status")),
        "available_at": F.when(stale, _at(as_of)).otherwise(F.col("available_at")),
        "leased_at": F.when(stale, F.lit(None)).otherwise(F.col("leased_at")),
        "error": F.when(stale, F.coalesce("error", F.lit(STALE))).otherwise(F.col("error")),
    })


def newest_pending(queue: DataFrame) -> DataFrame:
    """The newest pending version of each candidate, by enqueue time and id."""
    order = F.struct("enqueued_at", "id").desc()
    return _nth(queue.filter(F.col("status") == "pending"), "candidate_key", order)


def close_superseded(queue: DataFrame, as_of) -> DataFrame:
    """Pending versions with a newer pending version are done.

    The newest one comes from an aggregation per candidate and is joined back, in place of the quadratic comparison
    of versions.
    """
    newest = queue.filter(F.col("status") == "pending").groupBy("candidate_key").agg(
        F.max(F.struct("enqueued_at", "id")).alias("_newest"))
    rows = queue.join(newest, "candidate_key", "left")
    older = F.coalesce((F.col("status") == "pending") & (F.struct("enqueued_at", "id") < F.col("_newest")), F.lit(False))
    return rows.withColumns({
        "status": F.when(older, F.lit("done")).otherwise(F.col("status")),
        "done_at": F.when(older, _at(as_of)).otherwise(F.col("done_at")),
        "leased_at": F.when(older, F.lit(None)).otherwise(F.col("leased_at")),
        "error": F.when(older, F.lit(NEWER)).otherwise(F.col("error")),
    }).drop("_newest").select(*queue.columns)


def ready_batch(queue: DataFrame, as_of, capacity: int = 3, lease_seconds: int = 300) -> DataFrame:
    """The next batch after stale leases came back: never-tried first, then oldest. Capacity 1 to 50."""
    recovered = recover_stale(queue, as_of, lease_seconds)
    ready = newest_pending(recovered.filter(F.col("status") == "pending")).filter(F.col("available_at") <= _at(as_of))
    tried = F.when(F.col("attempts") == 0, 0).otherwise(1)
    return ready.orderBy(tried, "enqueued_at", "id").limit(max(1, min(MAX_CAPACITY, capacity)))


def ready_batch_or_wait(queue: DataFrame, as_of, size: int, max_wait: float, lease_seconds: int = 300) -> DataFrame:
    """A batch only when enough rows are ready or the oldest has waited long enough.

    The gate is a scalar subquery over the ready rows.
    """
    ready = recover_stale(queue, as_of, lease_seconds).filter(
        (F.col("status") == "pending") & (F.col("available_at") <= _at(as_of)))
    waited = F.timestamp_diff("MICROSECOND", F.min("enqueued_at"), _at(as_of)) / 1_000_000
    gate = ready.agg(((F.count(F.lit(1)) >= max(1, size)) | (waited >= max(0.0, max_wait))).alias("go"))
    return ready.filter(gate.scalar()).orderBy("enqueued_at", "id").limit(max(1, size))


def lease(queue: DataFrame, batch: DataFrame, as_of) -> DataFrame:
    """Mark the rows of a ready batch as leased."""
    taken = batch.select("id", F.lit(True).alias("_taken"))
    rows = queue.join(taken, "id", "left")
    hit = F.coalesce("_taken", F.lit(False)) & (F.col("status") == "pending")
    return rows.withColumns({
        "status": F.when(hit, F.lit("leased")).otherwise(F.col("status")),
        "leased_at": F.when(hit, _at(as_of)).otherwise(F.col("leased_at")),
        "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")),
        "error": F.when(hit, F.lit(None)).otherwise(F.col("error")),
    }).select(*queue.columns)


def apply_outcomes(queue: DataFrame, outcomes: DataFrame, as_of) -> DataFrame:
    """T4: complete or retry leased rows. ``outcomes``: id, outcome (complete/retry), error, delay_seconds."""
    marks = outcomes.select("id", "outcome", F.col("error").alias("_error"), "delay_seconds")
    rows = queue.join(marks, "id", "left")
    leased = F.col("status") == "leased"
    done = F.coalesce(leased & (F.col("outcome") == "complete"), F.lit(False))
    retry = F.coalesce(leased & (F.col("outcome") == "retry"), F.lit(False))
    message = F.left(F.replace("_error", F.lit("\n"), F.lit(" ")), F.lit(1000))
    later = F.timestamp_add("SECOND", F.greatest(F.lit(0), F.col("delay_seconds")), _at(as_of))
    return rows.withColumns({
        "status": F.when(done, F.lit("done")).when(retry, F.lit("pending")).otherwise(F.col("status")),
        "available_at": F.when(retry, later).otherwise(F.col("available_at")),
        "leased_at": F.when(done | retry, F.lit(None)).otherwise(F.col("leased_at")),
        "done_at": F.when(done, _at(as_of)).otherwise(F.col("done_at")),
        "error": F.when(done, F.lit(None)).when(retry, message).otherwise(F.col("error")),
    }).select(*queue.columns)


def queue_stats(queue: DataFrame) -> DataFrame:
    """Counts of the three states, zeros included."""
    return queue.agg(*[
        F.count_if(F.col("status") == s).alias(s) for s in ("pending", "leased", "done")
    ]).selectExpr("stack(3, 'pending', pending, 'leased', leased, 'done', done) as (status, count)")


def rotating_candidates(visible: DataFrame, window: int = 60, take: int = 1) -> DataFrame:
    """Of the newest ``window`` rows the least recently fetched. Two bounded sorts."""
    from lapak.functions.values import effective_at

    newest = visible.withColumn("listed_at", effective_at()).orderBy(
        F.col("listed_at").desc(), F.col("id").desc()).limit(window)
    return newest.orderBy(F.col("last_fetched_at").asc_nulls_first(), F.col("listed_at").desc(), "id").limit(take)


def reconcile_candidates(visible: DataFrame, platform: str) -> DataFrame:
    """Visible open listings of a platform whose id and URL can be checked."""
    rows = visible.filter((F.col("platform") == platform) & F.col("status").isin("available", "unknown"))
    if platform == "facebook":
        return rows.filter(F.col("external_id").rlike("^[0-9]+$") & F.col("source_url").rlike(
            r"^https://www\.facebook\.com/marketplace/item/[0-9]+/?$"))
    return rows.filter(F.col("external_id").rlike("^[A-Za-z0-9]+$"))


def lookup_misses(misses: DataFrame, asked: DataFrame, found: DataFrame, as_of, retry_seconds: int = 21_600,
                  limit: int = 1000) -> DataFrame:
    """The miss list after a lookup: found ids leave, asked but unknown ids wait ``retry_seconds``."""
    from lapak.operators.ordering import miss_list

    retry_at = F.timestamp_add("SECOND", F.lit(max(300, retry_seconds)), _at(as_of))
    failed = asked.select("external_id").distinct().join(found.select("external_id"), "external_id", "left_anti")
    kept = misses.select("external_id", "retry_at").join(asked.select("external_id"), "external_id", "left_anti")
    return miss_list(kept.unionByName(failed.withColumn("retry_at", retry_at)), limit)


def active_misses(misses: DataFrame, as_of) -> DataFrame:
    return misses.filter(F.col("retry_at") > _at(as_of))
