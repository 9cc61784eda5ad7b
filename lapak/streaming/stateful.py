"""Keyed state: change detection with its queue (T1), the feed revision (T6) and the negative lookup cache."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lapak.functions.values import record_id
from lapak.operators.changes import SUPERSEDED as SUPERSEDED_BY
from lapak.operators.facets import revision
from lapak.schemas import QUEUE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed processors keep their state in RocksDB, outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


QUEUE_EVENTS = ("candidate_key string, seq bigint, fingerprint string, effect string, queued string, observed_at timestamp, "
                "platform string, source_id string, payload_json string, seen_count bigint, first_seen_at timestamp")
SIGHT, SUPERSEDED = "sight", "superseded"
CHANGES = ("new", "changed", "unchanged")
EVENT_COLUMNS = tuple(c.split()[0] for c in QUEUE_EVENTS.split(", "))
CHUNK = 10_000


def _in_order(parts: list[tuple[np.ndarray, ...]]) -> Iterator[tuple]:
    """Rows of the narrow columns of all frames, by the first column."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    order = np.argsort(columns[0], kind="stable")
    return zip(*(c[order] for c in columns))


def _frames(rows: Iterator[tuple], columns: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """Frames of a few thousand rows."""
    while chunk := list(islice(rows, CHUNK)):
        yield pd.DataFrame(chunk, columns=list(columns))


SHARDS, PARTS = 256, 64
NO_TIME = np.iinfo(np.int64).min  # how a missing time is held among whole microseconds


def _shard(key: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard")


def _name(*texts: str | None) -> str:
    return "\0".join("" if t is None else "+" + t for t in texts)


class Packed:
    """Named JSON values of a shard in a fixed number of parts of its map state.

    A call to the state store costs far more than the work on a row. So a part is read when one of its names is first
    asked for, and written once, at the end, if it has changed: two calls per part and micro-batch, whatever the rows.
    """

    SCHEMA = ("part int", "entries string")

    def __init__(self, state, parts: int = PARTS):
        self._state, self._count, self._parts, self._changed = state, parts, {}, set()

    def part(self, name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "surrogatepass")) % self._count

    def entries(self, part: int) -> dict:
        if part not in self._parts:
            stored = self._state.getValue((part,))
            self._parts[part] = json.loads(stored[0]) if stored else {}
        return self._parts[part]

    def get(self, name: str):
        return self.entries(self.part(name)).get(name)

    def put(self, name: str, value) -> int:
        part = self.part(name)
        self.entries(part)[name] = value
        self._changed.add(part)
        return part

    def drop(self, name: str) -> int:
        part = self.part(name)
        if self.entries(part).pop(name, None) is not None:
            self._changed.add(part)
        return part

    def write(self) -> None:
        for part in self._changed:
            if self._parts[part]:
                self._state.updateValue((part,), (json.dumps(self._parts[part]),))
            elif self._state.containsKey((part,)):
                self._state.removeKey((part,))
        self._changed.clear()


class ChangeProcessor(StatefulProcessor):
    """State per shard of candidates: fingerprint, first sight, sights and pending versions of each candidate, and the
    status of each version it ever had.

    Frames are handled one by one: what is wide, the payload, goes out again at once as a ``sight``; only numbers and
    fingerprints of a shard's share of the micro-batch are kept to put them in arrival order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._candidates = handle.getMapState("candidates", *Packed.SCHEMA)
        self._versions = handle.getMapState("versions", *Packed.SCHEMA)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        candidates, versions = Packed(self._candidates), Packed(self._versions)
        firsts = initialState["first_seen_at"].to_numpy("datetime64[us]").astype(np.int64).tolist()
        for candidate, fingerprint, status, first, count in zip(
                *(initialState[c].tolist() for c in ("candidate_key", "fingerprint", "status")), firsts, initialState["seen_count"].tolist()):
            name = _name(candidate)
            entry = candidates.get(name) or [None, None, 0, []]
            if not isinstance(status, str):
                candidates.put(name, [fingerprint, first, int(count), entry[3]])
                continue
            versions.put(_name(candidate, fingerprint), status)
            candidates.put(name, [*entry[:3], entry[3] + [fingerprint] if status == "pending" else entry[3]])
        candidates.write()
        versions.write()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for frame in rows:
            parts.append((frame["seq"].to_numpy(np.int64), frame["candidate_key"].to_numpy(object), frame["fingerprint"].to_numpy(object),
                          frame["status"].to_numpy(object), frame["observed_at"].to_numpy("datetime64[us]").astype(np.int64)))
            seen = frame[frame["status"].isna()].drop(columns="status")
            yield seen.assign(effect=SIGHT, queued=None, seen_count=None, first_seen_at=None)[list(EVENT_COLUMNS)]
        effects = self._effects(parts)
        while chunk := list(islice(effects, CHUNK)):
            made = pd.DataFrame(dict(zip(("candidate_key", "seq", "fingerprint", "effect", "queued", "seen_count"),
                                         ([row[k] for row in chunk] for k in (0, 1, 2, 3, 4, 6)))))
            made["observed_at"], made["first_seen_at"] = (
                np.array([row[k] for row in chunk], np.int64).view("datetime64[us]") for k in (5, 7))
            yield made.assign(platform=None, source_id=None, payload_json=None)[list(EVENT_COLUMNS)]

    def _effects(self, parts: list) -> Iterator[tuple]:
        candidates, versions = Packed(self._candidates), Packed(self._versions)
        known: dict[str, list] = {}  # what has been touched; pending versions as keys, which keep their order

        def put(candidate: str, pending: dict, fingerprint: str, status: str) -> None:
            versions.put(_name(candidate, fingerprint), status)
            if status == "pending":
                pending[fingerprint] = None
            else:
                pending.pop(fingerprint, None)

        for seq, candidate, fingerprint, status, at in _in_order(parts):
            seq, at, name = int(seq), int(at), _name(candidate)
            if name not in known:
                current, first, count, waiting = candidates.get(name) or (None, None, 0, [])
                known[name] = [current, first, count, dict.fromkeys(waiting)]
            entry = known[name]
            current, pending = entry[0], entry[3]
            if isinstance(status, str):
                put(candidate, pending, fingerprint, status)
                continue
            entry[2] += 1
            if entry[1] is None:
                entry[1] = at
            change = "unchanged" if fingerprint == current else "new" if current is None else "changed"
            queued, entry[0] = None, fingerprint
            if change == "unchanged":
                queued = "refresh" if fingerprint in pending else None
            else:
                for other in [p for p in pending if change == "changed" and p != fingerprint]:
                    put(candidate, pending, other, "done")
                    yield (candidate, seq, other, SUPERSEDED, None, at, None, NO_TIME)
                if versions.get(_name(candidate, fingerprint)) in (None, "done"):
                    put(candidate, pending, fingerprint, "pending")
                    queued = "enter"
            yield (candidate, seq, fingerprint, change, queued, at, entry[2], entry[1])
        for name, (current, first, count, pending) in known.items():
            candidates.put(name, [current, first, count, list(pending)])
        candidates.write()
        versions.write()

    def close(self) -> None:
        pass


def queue_event_stream(observations: DataFrame, state: DataFrame | None = None, queue: DataFrame | None = None) -> DataFrame:
    """T1 as a stream: what every observation does to the queue (``QUEUE_EVENTS``), see ``queue_after``.

    ``observations``: seq, candidate_key, fingerprint, observed_at, and where at hand platform, source_id, payload_json and
    status. A row with a status is no observation: it says that a version has been leased, done or given back as
    pending. ``state`` and ``queue`` are what holds before the first micro-batch. Rows of a shard are put in arrival
    order inside each micro-batch; bound the micro-batch at the source (maxFilesPerTrigger, maxOffsetsPerTrigger).
    """
    use_rocksdb(observations.sparkSession)
    text = lambda c: (F.col(c) if c in observations.columns else F.lit(None)).cast("string").alias(c)
    rows = observations.select("seq", "candidate_key", "fingerprint", F.col("observed_at").cast("timestamp").alias("observed_at"),
                               *[text(c) for c in ("platform", "source_id", "payload_json", "status")])
    before = None
    if state is not None or queue is not None:
        none = rows.sparkSession.createDataFrame(
            [], "candidate_key string, fingerprint string, status string, first_seen_at timestamp, seen_count bigint")
        known = none if state is None else state.select(
            "candidate_key", "fingerprint", F.lit(None).cast("string").alias("status"),
            F.col("first_seen_at").cast("timestamp").alias("first_seen_at"), "seen_count")
        versions = none if queue is None else queue.select(
            "candidate_key", "fingerprint", "status", F.lit(None).cast("timestamp").alias("first_seen_at"),
            F.lit(None).cast("bigint").alias("seen_count"))
        before = known.unionByName(versions).select(_shard("candidate_key", SHARDS), "*").groupBy("shard")
    return rows.select(_shard("candidate_key", SHARDS), "*").groupBy("shard").transformWithStateInPandas(
        statefulProcessor=ChangeProcessor(), outputStructType=QUEUE_EVENTS, outputMode="append", timeMode="none",
        initialState=before)


def detect_changes_stream(observations: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Of the stream, the verdict on each observation: candidate_key, seq, fingerprint, change and sight counters."""
    return queue_event_stream(observations, state).filter(F.col("effect").isin(*CHANGES)).select(
        "candidate_key", "seq", "fingerprint", F.col("effect").alias("change"), "seen_count", "first_seen_at",
        F.col("observed_at").alias("last_seen_at"))


def queue_after(queue: DataFrame, events: DataFrame) -> DataFrame:
    """Queue snapshot after the events of one or more micro-batches, as ``changes.next_queue`` gives it.

    Two mergeable aggregations: per (candidate, version, arrival number), which brings an effect and its payload
    together, and per version. A hot candidate is combined in its tasks first.
    """
    taken = F.col("queued").isNotNull()
    zone = F.col("observed_at").cast("timestamp_ntz")
    steps = events.groupBy("candidate_key", "fingerprint", "seq").agg(
        F.max("queued").alias("queued"), F.max(F.when(F.col("effect") == SUPERSEDED, zone)).alias("closed"),
        F.max(zone).alias("at"),
        F.max(F.when(F.col("effect") == SIGHT, F.struct("platform", "source_id", "payload_json"))).alias("sight"))
    enters = F.col("queued") == "enter"
    per_version = steps.groupBy("candidate_key", "fingerprint").agg(
        F.max(F.when(enters, F.col("seq"))).alias("_enter"), F.max_by("at", F.when(enters, F.col("seq"))).alias("_entered"),
        F.max(F.when(F.col("closed").isNotNull(), F.col("seq"))).alias("_close"),
        F.max_by("closed", F.when(F.col("closed").isNotNull(), F.col("seq"))).alias("_closed"),
        F.max_by("sight", F.when(taken, F.col("seq"))).alias("_sight"), F.count(F.when(taken, True)).alias("_taken"))
    rows = queue.join(per_version.filter("_enter IS NOT NULL OR _close IS NOT NULL OR _taken > 0"),
                      ["candidate_key", "fingerprint"], "full_outer")
    entered = F.col("_enter").isNotNull()
    closes = F.coalesce(F.col("_close") > F.coalesce("_enter", F.lit(-1)), F.lit(False))
    opens = entered & ~closes
    pick = lambda c: F.when(F.col("_taken") > 0, F.col(f"_sight.{c}")).otherwise(F.col(c))
    nothing = F.lit(None)
    chosen = {
        "id": F.coalesce("id", record_id(F.concat_ws(":", "candidate_key", "fingerprint"))),
        "candidate_key": F.col("candidate_key"), "fingerprint": F.col("fingerprint"), "platform": pick("platform"),
        "source_id": pick("source_id"), "payload_json": pick("payload_json"),
        "status": F.when(opens, F.lit("pending")).when(closes, F.lit("done")).otherwise(F.col("status")),
        "attempts": F.when(entered, F.lit(0)).otherwise(F.col("attempts")),
        "enqueued_at": F.coalesce("_entered", "enqueued_at"), "available_at": F.coalesce("_entered", "available_at"),
        "leased_at": F.when(opens | closes, nothing).otherwise(F.col("leased_at")),
        "done_at": F.when(opens, nothing).when(closes, F.col("_closed")).otherwise(F.col("done_at")),
        "error": F.when(opens, nothing).when(closes, F.lit(SUPERSEDED_BY)).otherwise(F.col("error")),
    }
    return rows.select(*[chosen[c].alias(c) for c in QUEUE.fieldNames()])


SHARD_TOTALS = "shard int, seq bigint, step bigint, visible bigint, latest timestamp"


class VisibleProcessor(StatefulProcessor):
    """State per shard of listings: which are visible and when they were first fetched, in parts; the newest time of each
    part; the number of visible listings and the newest time of all.

    A listing that becomes hidden takes back what it gave; the newest time is looked up anew only in the parts that lost
    or gained a listing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._listed = handle.getMapState("listed", *Packed.SCHEMA)
        self._totals = handle.getValueState("totals", "seq bigint, step bigint, visible bigint, newest binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, step, visible, stored = self._totals.get() if self._totals.exists() else (-1, 0, 0, None)
        newest = np.full(PARTS, NO_TIME) if stored is None else np.frombuffer(stored, np.int64).copy()
        last: dict[str, tuple] = {}
        for frame in rows:
            at = frame["at"].to_numpy("datetime64[us]").astype(np.int64)
            for number, listing, shown, time in zip(frame["seq"].tolist(), frame["listing_id"].tolist(),
                                                    frame["visible"].tolist(), at.tolist()):
                if listing not in last or last[listing][0] <= number:
                    last[listing] = (number, shown, time)
        listed, touched = Packed(self._listed), set()
        for listing, (number, shown, time) in last.items():
            name = _name(listing)
            seq = max(seq, number)
            visible += int(shown) - (listed.get(name) is not None)
            touched.add(listed.put(name, time) if shown else listed.drop(name))
        for part in touched:
            newest[part] = max(listed.entries(part).values(), default=NO_TIME)
        listed.write()
        latest = int(newest.max())
        self._totals.update((seq, step + 1, visible, newest.tobytes()))
        yield pd.DataFrame({"shard": [key[0]], "seq": [seq], "step": [step + 1], "visible": [visible],
                            "latest": [None if latest == NO_TIME else pd.Timestamp(latest, unit="us")]})

    def close(self) -> None:
        pass


def revision_stream(listings: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Totals of the feed, kept up to date as listings become visible, change or become hidden.

    ``listings``: listing_id, seq (arrival number), visible, first_fetched_at. One row per shard and micro-batch in which
    it changed (``SHARD_TOTALS``); ``revision_after`` makes feed versions of them. A listing without a time, or one
    whose visibility is unknown, is hidden.
    """
    use_rocksdb(listings.sparkSession)
    rows = listings.select(
        _shard("listing_id", shards), "listing_id", "seq",
        (F.coalesce("visible", F.lit(False)) & F.col("first_fetched_at").isNotNull()).alias("visible"),
        F.coalesce(F.col("first_fetched_at").cast("timestamp"), F.timestamp_seconds(F.lit(0))).alias("at"))
    return rows.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=VisibleProcessor(), outputStructType=SHARD_TOTALS, outputMode="append", timeMode="none")


def revision_after(totals: DataFrame, marks: list[int]) -> DataFrame:
    """Feed version after each of a few arrival numbers: seq, revision, total_count. At most one row per shard is summed."""
    rows = totals.select("*", F.explode(F.array(*[F.lit(m).cast("bigint") for m in marks])).alias("mark")).filter(F.col("seq") <= F.col("mark"))
    newest = rows.groupBy("mark", "shard").agg(F.max_by(F.struct("visible", "latest"), F.struct("seq", "step")).alias("t"))
    summed = newest.groupBy("mark").agg(F.sum("t.visible").alias("total_count"), F.max("t.latest").cast("timestamp_ntz").alias("latest"))
    return summed.select(F.col("mark").alias("seq"), revision(F.col("total_count"), F.col("latest")).alias("revision"), "total_count")


LOOKUPS = "external_id string, asked_at timestamp, action string"


class MissProcessor(StatefulProcessor):
    """State per external id: time until which a failed lookup is not repeated; a timer clears it then."""

    def __init__(self, retry_seconds: int):
        self._retry = pd.Timedelta(seconds=max(300, retry_seconds))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._until = handle.getValueState("retry_at", "retry_at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(f["asked_at"].to_numpy("datetime64[us]"), f["found"].to_numpy(bool)) for f in rows]
        yield from _frames(self._actions(key[0], parts), ("external_id", "asked_at", "action"))

    def _actions(self, key: str, parts: list) -> Iterator[tuple]:
        stored = pd.Timestamp(self._until.get()[0]) if self._until.exists() else None
        until = stored
        for at, found in _in_order(parts):
            at = pd.Timestamp(at)
            if until is not None and until > at:
                yield (key, at, "skip")
            else:
                until = None if found else at + self._retry
                yield (key, at, "found" if found else "miss")
        if until == stored:
            return
        if stored is not None:
            self._handle.deleteTimer(_millis(stored))
        if until is None:
            self._until.clear()
        else:
            self._until.update((until,))
            self._handle.registerTimer(_millis(until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed the time to retry: every later lookup is asked again, so nothing need be kept."""
        if self._until.exists() and _millis(pd.Timestamp(self._until.get()[0])) <= expiredTimerInfo.getExpiryTimeInMs():
            self._until.clear()
        return iter([])

    def close(self) -> None:
        pass


def _millis(at: pd.Timestamp) -> int:
    """Milliseconds of a UTC time, rounded up, so that a timer never fires early."""
    return -(-(at - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1))


def lookup_stream(lookups: DataFrame, retry_seconds: int = 21_600, delay: str = "1 hour") -> DataFrame:
    """T9 as a stream of lookups (external_id, asked_at, found): which ones to skip, and what the others gave.

    Lookups later than ``delay`` behind the newest one are dropped. A miss leaves the state when its time is over.
    """
    use_rocksdb(lookups.sparkSession)
    rows = lookups.select("external_id", F.col("asked_at").cast("timestamp").alias("asked_at"), "found").withWatermark("asked_at", delay)
    return rows.groupBy("external_id").transformWithStateInPandas(
        statefulProcessor=MissProcessor(retry_seconds), outputStructType=LOOKUPS, outputMode="append", timeMode="EventTime")
