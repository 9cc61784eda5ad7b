"""Change detection of observed candidates and the versions it enqueues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapak.functions.values import record_id
from lapak.operators.ordering import SEGMENT, lag_by_key
from lapak.schemas import CANDIDATE_STATE, QUEUE

SUPERSEDED = "superseded by newer source evidence"


def classify_changes(observations: DataFrame, state: DataFrame, segment_size: int = SEGMENT) -> DataFrame:
    """Every observation with ``change`` new / changed / unchanged against the one before it.

    ``observations``: seq (unique arrival number), candidate_key, fingerprint and more; ``state`` gives the
    fingerprint before the batch. Arrival order counts, not event time. Where there is an observed_at, ``next_at`` is
    that of the key's next observation.
    """
    ahead = ("observed_at", "next_at") if "observed_at" in observations.columns else None
    seeded = lag_by_key(observations, "candidate_key", "seq", "fingerprint", "_prev", segment_size, ahead)
    before = state.select("candidate_key", F.col("fingerprint").alias("_stored"))
    rows = seeded.join(before, "candidate_key", "left")
    previous = F.when(F.col("_prev_exists"), F.col("_prev")).otherwise(F.col("_stored"))
    change = (
        F.when(previous.isNull(), F.lit("new"))
        .when(previous == F.col("fingerprint"), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return rows.withColumn("change", change).drop("_prev", "_prev_exists", "_stored")


def next_state(observations: DataFrame, state: DataFrame) -> DataFrame:
    """T1 state after the batch: latest fingerprint and source, first and last sight, number of sights.

    One mergeable aggregation per key, so a hot key is combined inside each task first. The stored platform only
    moves when the fingerprint does.
    """
    seen = observations.groupBy("candidate_key").agg(
        F.max_by(F.struct("platform", "source_id", "fingerprint"), F.col("seq")).alias("_l"),
        F.min_by("observed_at", "seq").alias("_first"), F.max_by("observed_at", "seq").alias("_last"),
        F.count(F.lit(1)).alias("_n"))
    merged = state.join(seen, "candidate_key", "full_outer")
    hit = F.col("_n").isNotNull()
    moved = hit & (F.col("fingerprint").isNull() | (F.col("fingerprint") != F.col("_l.fingerprint")))
    chosen = {
        "candidate_key": F.col("candidate_key"),
        "platform": F.when(moved, F.col("_l.platform")).otherwise(F.col("platform")),
        "source_id": F.when(hit, F.col("_l.source_id")).otherwise(F.col("source_id")),
        "fingerprint": F.when(hit, F.col("_l.fingerprint")).otherwise(F.col("fingerprint")),
        "first_seen_at": F.coalesce("first_seen_at", "_first"),
        "last_seen_at": F.coalesce("_last", "last_seen_at"),
        "seen_count": F.coalesce("seen_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
    }
    return merged.select(*[chosen[c].alias(c) for c in CANDIDATE_STATE.fieldNames()])


def enqueued_versions(changes: DataFrame, queue: DataFrame) -> DataFrame:
    """Observations with ``enqueued``: 1 when the observation puts a version into the queue.

    New and changed observations enqueue their version unless it is leased, or still pending because no other change
    came before it in this batch. A version closed earlier, in the queue or in this batch, comes back (A, B, A).
    """
    moves = changes.filter(F.col("change") != "unchanged")
    first = moves.groupBy("candidate_key").agg(F.min("seq").alias("_first_move"))
    stored = queue.select("candidate_key", "fingerprint", F.col("status").alias("_stored"))
    rows = changes.join(first, "candidate_key", "left").join(stored, ["candidate_key", "fingerprint"], "left")
    blocked = (F.col("_stored") == "leased") | ((F.col("_stored") == "pending") & (F.col("seq") == F.col("_first_move")))
    enters = (F.col("change") != "unchanged") & ~F.coalesce(blocked, F.lit(False))
    return rows.withColumn("enqueued", enters.cast("int")).drop("_first_move", "_stored")


def enqueue_summary(enqueued: DataFrame) -> DataFrame:
    """Counts per source."""
    kinds = [F.count_if(F.col("change") == k).alias(k) for k in ("new", "changed", "unchanged")]
    return enqueued.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("received"), *kinds, F.sum("enqueued").cast("bigint").alias("enqueued"))


def next_queue(changes: DataFrame, queue: DataFrame) -> DataFrame:
    """Queue snapshot after the batch (T1 versions, T2 payload refresh).

    Per key the version of the last change is the one that may be pending; every other version that was pending, or
    entered in this batch, is closed. ``changes`` come from ``classify_changes`` and carry platform, source_id,
    payload_json and observed_at. They are read once, into one mergeable row per version, which is rolled up per key:
    what follows the last sight of a version is the change that closes it.
    """
    moved = F.col("change") != "unchanged"
    at_move = F.when(moved, F.col("seq"))
    sights = changes.groupBy("candidate_key", "fingerprint").agg(
        F.max_by(F.struct("platform", "source_id", "payload_json"), F.col("seq")).alias("_sight"),
        F.max(at_move).alias("_last"), F.max_by("observed_at", at_move).alias("_last_at"),
        F.min(at_move).alias("_first"), F.min_by("observed_at", at_move).alias("_first_at"),
        F.max_by("next_at", "seq").alias("_next_at"), F.count_if(~moved).alias("_quiet"))
    keys = sights.groupBy("candidate_key").agg(
        F.max_by("fingerprint", "_last").alias("_current"), F.min("_first").alias("_key_first"),
        F.min_by("_first_at", "_first").alias("_key_at"))
    rows = queue.withColumn("_stored", F.col("status")).join(sights, ["candidate_key", "fingerprint"], "full_outer").join(
        keys, "candidate_key", "left").filter(F.col("_stored").isNotNull() | F.col("_last").isNotNull())

    sure = lambda c: F.coalesce(c, F.lit(False))
    leased, pending = (sure(F.col("_stored") == s) for s in ("leased", "pending"))
    # The first change of a batch finds a pending version of its own still pending, any later one finds it closed.
    entered = F.col("_last").isNotNull() & ~leased & ~(pending & (F.col("_last") == F.col("_key_first")))
    is_current = sure(F.col("_current") == F.col("fingerprint"))
    opens = entered & is_current
    closes = F.col("_current").isNotNull() & ~leased & ~is_current & (entered | pending)
    closed_at = F.when(F.col("_last").isNotNull(), F.col("_next_at")).otherwise(F.col("_key_at"))
    # An unchanged sight refreshes a version while it is pending, also when a later change closes it.
    refreshed = entered | (pending & sure(F.col("_quiet") > 0))
    pick = lambda name: F.when(refreshed, F.col(f"_sight.{name}")).otherwise(F.col(name))
    nothing = F.lit(None)
    since = lambda name: F.when(entered, F.col("_last_at")).otherwise(F.col(name))
    chosen = {
        "id": F.coalesce("id", record_id(F.concat_ws(":", "candidate_key", "fingerprint"))),
        "candidate_key": F.col("candidate_key"), "fingerprint": F.col("fingerprint"),
        "platform": pick("platform"), "source_id": pick("source_id"), "payload_json": pick("payload_json"),
        "status": F.when(opens, F.lit("pending")).when(closes, F.lit("done")).otherwise(F.col("status")),
        "attempts": F.when(entered, F.lit(0)).otherwise(F.col("attempts")),
        "enqueued_at": since("enqueued_at"), "available_at": since("available_at"),
        "leased_at": F.when(opens | closes, nothing).otherwise(F.col("leased_at")),
        "done_at": F.when(opens, nothing).when(closes, closed_at).otherwise(F.col("done_at")),
        "error": F.when(opens, nothing).when(closes, F.lit(SUPERSEDED)).otherwise(F.col("error")),
    }
    return rows.select(*[chosen[c].alias(c) for c in QUEUE.fieldNames()])


def detect_changes(observations: DataFrame, state: DataFrame, queue: DataFrame | None = None):
    """(changes, next state), and the next queue when a queue snapshot is given."""
    changes = classify_changes(observations, state)
    after = next_state(observations, state)
    return (changes, after) if queue is None else (changes, after, next_queue(changes, queue))
