"""Behaviour over time and across jobs: pages, changes, queue, merges, extraction, files."""

import datetime as dt
import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from lapak.operators import (
    changes, contract, extract_json, extract_text, feed, media, moderation, normalize, ordering, queue, reconcile, runs,
    upsert,
)
from lapak.plans import load
from lapak.plans.registry import QUERIES
from lapak.schemas import CANDIDATE_STATE, IMAGE, LISTING, QUEUE, REJECTION
from lapak.sources import images as image_source, runlogs, tables
from lapak.streaming import jobs, stateful

T0 = dt.datetime(2024, 1, 1)


def listings(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        posted = None if rng.random() < 0.2 else T0 + dt.timedelta(hours=rng.randrange(4))
        fetched = T0 + dt.timedelta(hours=rng.randrange(4), microseconds=rng.randrange(3) * 700)
        values = dict.fromkeys(LISTING.fieldNames())
        values.update(id=f"{i:04d}", platform="reddit", source_url=f"https://e.example/{i}", title=f"t{i}", description="d",
                      price=rng.choice([None, 5, 5, 9]), location_texts=[], status=rng.choice(["sold", "available", "unknown"]),
                      posted_at=posted, first_fetched_at=fetched, last_fetched_at=fetched)
        rows.append(tuple(values[f] for f in LISTING.fieldNames()))
    return spark.createDataFrame(rows, LISTING).cache()


@pytest.mark.parametrize("sort", ["newest", "price-high", "price-low", "available-first", "sold-first"])
def test_walking_pages_gives_the_full_order(spark, sort):
    rows = listings(spark)
    whole = [r["id"] for r in feed.ranked(rows, sort).orderBy(*feed.sort_order(sort)).collect()]
    walked, cursor = [], None
    while True:
        page = feed.feed_page(rows, sort, 17, cursor).collect()
        walked += [r["id"] for r in page[:17]]
        if len(page) <= 17:
            break
        last = page[16]
        token = feed.encode_cursor(feed.Cursor(sort, last["status_rank"], last["sort_value"], last["effective_at"], last["id"]))
        cursor = feed.decode_cursor(token, sort)
    assert walked == whole
    ranked = feed.assign_pages(rows, sort, 17).orderBy("rank").collect()
    assert [r["id"] for r in ranked] == whole
    assert [r["page"] for r in ranked] == [i // 17 for i in range(len(whole))]


def test_cursor_of_another_order_is_refused(spark):
    with pytest.raises(feed.InvalidCursor):
        feed.feed_page(listings(spark), "newest", 5, feed.Cursor("price-low", 0, 0, T0, "x"))


# Change detection against a row-by-row model of the queue -----------------------------------------------------------

class Model:
    def __init__(self):
        self.state, self.queue = {}, {}

    def observe(self, key, fingerprint, at, payload):
        stored = self.state.get(key)
        entered, kind = 0, "new"
        if stored and stored["fp"] == fingerprint:
            kind = "unchanged"
            stored.update(last=at, n=stored["n"] + 1)
            version = self.queue.get((key, fingerprint))
            if version and version["status"] == "pending":
                version["payload"] = payload
            return kind, entered
        if stored:
            kind = "changed"
            stored.update(fp=fingerprint, last=at, n=stored["n"] + 1)
            for (k, f), version in self.queue.items():
                if k == key and f != fingerprint and version["status"] == "pending":
                    version.update(status="done", done=at)
        else:
            self.state[key] = {"fp": fingerprint, "first": at, "last": at, "n": 1}
        version = self.queue.get((key, fingerprint))
        if version is None or version["status"] == "done":
            self.queue[key, fingerprint] = {"status": "pending", "attempts": 0, "at": at, "payload": payload, "done": None}
            entered = 1
        return kind, entered


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes_follow_the_model_over_two_batches(spark, seed):
    rng = random.Random(seed)
    model = Model()
    state = spark.createDataFrame([], CANDIDATE_STATE)
    pool = spark.createDataFrame([], QUEUE)
    seq = 0
    for round_ in range(2):
        observed, expected = [], []
        for _ in range(150):
            seq += 1
            # One key owns about a third of all rows.
            key = "K:hot" if rng.random() < 0.34 else f"K:{rng.randrange(12)}"
            fingerprint, at, payload = rng.choice("ABC"), T0 + dt.timedelta(seconds=seq), f"p{seq}"
            observed.append((seq, key, "FACEBOOK", "job", fingerprint, at, payload))
            expected.append((seq, *model.observe(key, fingerprint, at, payload)))
        rows = spark.createDataFrame(
            observed, "seq bigint, candidate_key string, platform string, source_id string, fingerprint string, "
                      "observed_at timestamp_ntz, payload_json string")
        seen = changes.classify_changes(rows, state, segment_size=16)
        entered = changes.enqueued_versions(seen, pool)
        assert sorted((r["seq"], r["change"], r["enqueued"]) for r in entered.collect()) == expected
        _, state, pool = changes.detect_changes(rows, state, pool)
        state, pool = state.cache(), pool.cache()
        got = {r["candidate_key"]: (r["fingerprint"], r["first_seen_at"], r["last_seen_at"], r["seen_count"]) for r in state.collect()}
        assert got == {k: (s["fp"], s["first"], s["last"], s["n"]) for k, s in model.state.items()}
        got = {(r["candidate_key"], r["fingerprint"]): (r["status"], r["attempts"], r["enqueued_at"], r["payload_json"], r["done_at"])
               for r in pool.collect()}
        assert got == {k: (v["status"], v["attempts"], v["at"], v["payload"], v["done"]) for k, v in model.queue.items()}
        # Between the batches some versions are leased, some of them retried or completed.
        moved = {}
        for place, (k, v) in enumerate(sorted(model.queue.items())):
            if v["status"] == "pending" and place % 2 == 0:
                v["status"] = moved[k] = ("leased", "done", "pending")[place % 3]
        marks = spark.createDataFrame([(*k, s) for k, s in moved.items()] or [("-", "-", "-")],
                                      "candidate_key string, fingerprint string, moved string")
        pool = pool.join(marks, ["candidate_key", "fingerprint"], "left").withColumn(
            "status", F.coalesce("moved", "status")).select(*QUEUE.fieldNames()).cache()


def test_stream_and_batch_detect_the_same_changes(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, f"K:{rng.randrange(6)}", rng.choice("AB"), T0 + dt.timedelta(seconds=i)) for i in range(120)]
    schema = "seq bigint, candidate_key string, fingerprint string, observed_at timestamp_ntz"
    for part in range(3):  # three files, one per micro-batch, in arrival order
        spark.createDataFrame(rows[part * 40:(part + 1) * 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed = jobs.run_available(stateful.detect_changes_stream(stream), "t1").select("seq", "change")
    batch = changes.classify_changes(spark.createDataFrame(rows, schema), spark.createDataFrame([], CANDIDATE_STATE))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.select("seq", "change").collect()))


def run_parts(spark, tmp_path, parts, schema, stream_of, label):
    """Run a stream once per part, from the same checkpoint; the rows of all parts and the state folder."""
    source, out, checkpoint = (str(tmp_path / label / x) for x in ("in", "out", "checkpoint"))
    for rows in parts:
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(source)
        stream = stream_of(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.parquet(out), checkpoint


def test_queue_stream_follows_the_model_over_three_batches(spark, tmp_path, monkeypatch):
    """A, B, A over micro-batches, leases and retries in between, a hot key, and a queue from before the stream."""
    monkeypatch.setattr(stateful, "CHUNK", 7)
    rng, model, seq = random.Random(5), Model(), 0
    schema = ("seq bigint, candidate_key string, platform string, source_id string, fingerprint string, observed_at timestamp_ntz, "
              "payload_json string, status string")
    start = [("K:0", "A", "pending"), ("K:0", "B", "leased"), ("K:0", "C", "done"), ("K:1", "B", "pending"), ("K:9", "A", "pending")]
    before = T0 - dt.timedelta(days=1)
    for key, fingerprint, status in start:
        model.queue[key, fingerprint] = {"status": status, "attempts": 2, "at": before, "payload": "old", "done": None}
    model.state["K:0"] = {"fp": "A", "first": before, "last": before, "n": 3}
    queue_0 = spark.createDataFrame([(f"{k}/{f}", k, "FACEBOOK", "job", f, "old", s, 2, before, before, None, None, None)
                                     for k, f, s in start], QUEUE)
    state_0 = spark.createDataFrame([("K:0", "FACEBOOK", "job", "A", before, before, 3)], CANDIDATE_STATE)
    parts, expected = [], []
    for _ in range(3):
        rows = []
        for _ in range(60):
            seq += 1
            key, fingerprint = ("K:hot" if rng.random() < 0.34 else f"K:{rng.randrange(5)}"), rng.choice("ABC")
            at, payload = T0 + dt.timedelta(seconds=seq), f"p{seq}"
            known = model.queue.get((key, fingerprint))
            if known and rng.random() < 0.2:
                moved = {"pending": "leased", "leased": rng.choice(["done", "pending"]), "done": "done"}[known["status"]]
                known["status"] = moved
                rows.append((seq, key, None, None, fingerprint, at, None, moved))
            else:
                rows.append((seq, key, "FACEBOOK", "job", fingerprint, at, payload, None))
                expected.append((seq, *model.observe(key, fingerprint, at, payload)))
        rng.shuffle(rows)
        parts.append(rows)
    events, _ = run_parts(spark, tmp_path, parts, schema, lambda s: stateful.queue_event_stream(s, state_0, queue_0), "queue")
    told = events.filter(F.col("effect").isin(*stateful.CHANGES)).select("seq", "effect", (F.col("queued") == "enter").alias("e"))
    assert sorted((r.seq, r.effect, int(bool(r.e))) for r in told.collect()) == sorted(expected)
    last = {}
    for key, version in model.queue.items():
        last[key] = (version["attempts"], version["at"], version["payload"])
    got = {(r.candidate_key, r.fingerprint): (r.attempts, r.enqueued_at, r.payload_json)
           for r in stateful.queue_after(queue_0, events).collect()}
    assert got == last


def test_queue_stream_equals_the_batch_queue(spark, tmp_path):
    rng = random.Random(11)
    schema = ("seq bigint, candidate_key string, platform string, source_id string, fingerprint string, observed_at timestamp_ntz, "
              "payload_json string")
    rows = [(i, f"K:{rng.randrange(7) if rng.random() < 0.7 else 0}", "FACEBOOK", f"job{i % 2}", rng.choice("ABCD"), T0 + dt.timedelta(seconds=i), f"p{i}")
            for i in range(180)]
    batch, state, pool = spark.createDataFrame(rows, schema), spark.createDataFrame([], CANDIDATE_STATE), spark.createDataFrame([], QUEUE)
    events, _ = run_parts(spark, tmp_path, [rows[:60], rows[60:61], rows[61:]], schema, stateful.queue_event_stream, "equal")
    expected = changes.next_queue(changes.classify_changes(batch, state), pool)
    assert sorted(map(str, stateful.queue_after(pool, events).collect())) == sorted(map(str, expected.collect()))


def lookups_by_hand(rows, retry):
    until, out = {}, []
    for key, at, found in sorted(rows, key=lambda r: r[1]):
        if key in until and until[key] > at:
            out.append((key, at, "skip"))
        else:
            until.pop(key, None)
            if not found:
                until[key] = at + dt.timedelta(seconds=retry)
            out.append((key, at, "found" if found else "miss"))
    return sorted(out)


def test_lookup_stream_waits_before_asking_again(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", at(0), False), ("a", at(4), True), ("a", at(6), False), ("a", at(30), True), ("a", at(31), False), ("b", at(1), True)]
    schema = "external_id string, asked_at timestamp_ntz, found boolean"
    out, _ = run_parts(spark, tmp_path, [rows], schema, lambda s: stateful.lookup_stream(s, 300), "t9")
    assert [r["action"] for r in out.orderBy("external_id", "asked_at").collect()] == ["miss", "skip", "miss", "found", "miss", "found"]


def test_lookup_stream_over_batches_forgets_old_misses(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted(((rng.choice("abcdef"), T0 + dt.timedelta(minutes=i, microseconds=rng.randrange(999)), rng.random() < 0.3)
                   for i in range(120)), key=lambda r: r[1])
    rows.append(("z", T0 + dt.timedelta(days=3), True))  # moves the watermark behind all that was missed
    schema = "external_id string, asked_at timestamp_ntz, found boolean"
    parts = [rows[:40], rows[40:80], rows[80:120], rows[120:]]
    out, checkpoint = run_parts(spark, tmp_path, parts, schema, lambda s: stateful.lookup_stream(s, 900, "10 minutes"), "misses")
    assert sorted((r.external_id, r.asked_at, r.action) for r in out.collect()) == lookups_by_hand(rows, 900)
    left = spark.read.format("statestore").option("stateVarName", "retry_at").load(checkpoint)
    assert left.count() == 0


def test_failure_streaks_with_small_segments(spark):
    states = "dddsddsddddd"
    rows = [(i, "j", {"d": "degraded", "s": "success"}[c]) for i, c in enumerate(states)]
    frame = spark.createDataFrame(rows, "seq bigint, job_id string, status string")
    bad = F.col("status") == "degraded"
    for size in (1, 2, 5, 100):
        got = ordering.running_since_reset(frame, "job_id", "seq", ~bad, bad, "streak", size).orderBy("seq").collect()
        assert [r["streak"] for r in got] == [1, 2, 3, 0, 1, 2, 0, 1, 2, 3, 4, 5]
    delays = runs.failure_streaks(frame).orderBy("seq").collect()
    assert [r["delay_seconds"] for r in delays][:4] == [300, 900, 1800, 180]


@pytest.mark.parametrize("number", ["id * 10000000", "id", "if(id < 2900, id, id * 1000000000000)", "-id * id * id"])
def test_hot_keys_are_cut_into_even_segments(spark, number):
    """Sparse, dense, bursty and negative numbers: no group of a key and a segment is large, and values are the same."""
    rows = spark.range(3000).selectExpr(f"{number} AS seq", "IF(id % 10 < 3, 'hot', concat('k', id % 50)) AS key", "id % 4 AS v").repartition(5)
    cut = ordering.segmented(rows, "seq", 100).groupBy("key", "_seg").count()
    assert cut.agg(F.max("count")).first()[0] <= 60 and cut.select("_seg").distinct().count() >= 15
    whole = rows.selectExpr("seq", "lag(v) OVER (PARTITION BY key ORDER BY seq) AS p").collect()
    parts = ordering.lag_by_key(rows, "key", "seq", "v", "p", 100).select("seq", "p").collect()
    assert sorted(map(tuple, parts), key=str) == sorted(map(tuple, whole), key=str)


def test_rank_survives_hot_values(spark):
    frame = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"))
    got = ordering.assign_rank(frame.repartition(7), [F.col("v"), F.col("id")]).collect()
    expected = sorted(range(5000), key=lambda i: (0 if i % 3 == 0 else i, i))
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == expected


# Queue -------------------------------------------------------------------------------------------------------------

def version(i, key, status="pending", attempts=0, enqueued=0, available=None, leased=None):
    at = T0 + dt.timedelta(seconds=enqueued)
    return (f"{i:03d}", key, "FACEBOOK", "job", f"fp{i}", "{}", status, attempts, at,
            at if available is None else T0 + dt.timedelta(seconds=available),
            None if leased is None else T0 + dt.timedelta(seconds=leased), None, None)


def test_ready_batch_order_and_gates(spark):
    pool = spark.createDataFrame([
        version(1, "a", enqueued=10), version(2, "a", enqueued=20), version(3, "b", attempts=1, enqueued=1),
        version(4, "c", enqueued=5), version(5, "d", status="leased", enqueued=2, leased=0), version(6, "e", available=10_000)], QUEUE)
    now = T0 + dt.timedelta(seconds=1000)
    assert [r["id"] for r in queue.ready_batch(pool, now, 50).collect()] == ["005", "004", "002", "003"]
    assert [r["id"] for r in queue.ready_batch(pool, now, 2).collect()] == ["005", "004"]
    assert queue.ready_batch_or_wait(pool, now, 50, 5000).count() == 0
    assert queue.ready_batch_or_wait(pool, now, 5, 5000).count() == 5
    assert queue.ready_batch_or_wait(pool, now, 50, 900).count() == 5
    leased = queue.lease(queue.close_superseded(queue.recover_stale(pool, now), now), queue.ready_batch(pool, now, 2), now)
    by_id = {r["id"]: r for r in leased.collect()}
    assert by_id["005"]["status"] == "leased" and by_id["005"]["attempts"] == 1 and by_id["001"]["status"] == "done"


# Merges ------------------------------------------------------------------------------------------------------------

def test_upsert_twice_changes_nothing(spark, tmp_path):
    rows = listings(spark, 20).withColumn("seq", F.monotonically_increasing_id())
    gallery = spark.createDataFrame(
        [("https://e.example/1", "https://i.example/a.jpg", 0, 1), ("https://e.example/1", "https://i.example/b.jpg", 0, 2)],
        "listing_url string, source_url string, position int, seq bigint")
    for f in IMAGE.fields:
        if f.name not in gallery.columns and f.name not in ("id", "listing_id"):
            gallery = gallery.withColumn(f.name, F.lit(None).cast(f.dataType))
    dropped = rows.limit(0).withColumn("reason_code", F.lit("OTHER"))
    store = jobs.Store(str(tmp_path / "store"), 8)
    jobs.apply_batch(spark, store, rows, gallery, dropped, "2024-02-01", 0)
    read = lambda: [sorted(map(str, t.read(spark).collect())) for t in (store.listings, store.images, store.rejections)]
    first = read()
    jobs.apply_batch(spark, store, rows, gallery, dropped, "2024-02-01", 0)  # replay of the batch
    assert read() == first and len(first[0]) == 20
    # After a checkpoint reset numbers start again under a new query: the batch counts.
    jobs.apply_batch(spark, store, rows, gallery, dropped, "2024-02-02", 0, "second")
    assert "2, 2" in read()[0][0]
    jobs.apply_batch(spark, store, rows, gallery, dropped, "2024-02-01", 1)  # same rows again
    again = read()
    assert len(again[0]) == 20 and len(again[1]) == 1 and "b.jpg" in again[1][0]


def files_of(path):
    """File names by bucket folder."""
    found = {}
    for file in (f for f in path.rglob("*.parquet") if "_batches" not in f.parts):
        found.setdefault(f"{file.parent.parent.name}/{file.parent.name}", set()).add(file.name)
    return found


def rejected(spark, *numbers):
    rows = [(i, "reddit", f"https://e.example/{n}", None, "t", "d", None, "OTHER") for i, n in enumerate(numbers)]
    return spark.createDataFrame(rows, "seq bigint, platform string, source_url string, external_id string, title string, "
                                       "description string, seller_name string, reason_code string")


def test_a_small_batch_leaves_other_buckets_alone(spark, tmp_path):
    rows = listings(spark, 200).withColumn("seq", F.monotonically_increasing_id())
    owner = lambda n: F.concat(F.lit("https://e.example/"), n)
    gallery = spark.range(200).select(owner(F.col("id")).alias("listing_url"), F.concat(F.lit("https://i.example/"), "id").alias("source_url"),
                                      F.lit(0).alias("position"), F.lit(1).cast("bigint").alias("seq"))
    for f in IMAGE.fields:
        if f.name not in gallery.columns and f.name not in ("id", "listing_id"):
            gallery = gallery.withColumn(f.name, F.lit(None).cast(f.dataType))
    store = jobs.Store(str(tmp_path / "store"), 32)
    jobs.apply_batch(spark, store, rows, gallery, rejected(spark, 500, 501, 502), "2024-02-01", 0)
    before = files_of(tmp_path / "store")
    two = rows.filter("id in ('0007', '0008')").withColumn("title", F.lit("new"))
    jobs.apply_batch(spark, store, two, gallery.filter("listing_url like '%/7'").withColumn("source_url", F.lit("https://i.example/x")),
                     rejected(spark, 500, 500), "2024-03-01", 1)
    after = files_of(tmp_path / "store")
    changed = {k for k in after if after[k] != before.get(k)}
    assert len([k for k in changed if k.startswith("listings/")]) <= 2 and len([k for k in changed if k.startswith("images/")]) <= 2
    assert {k.split("/")[0] for k in changed} == {"listings", "images", "rejections"}
    found = {r.id: r for r in store.listings.read(spark).collect()}
    assert len(found) == 200 and [i for i, r in found.items() if r.title == "new"] == ["0007", "0008"]
    images = {r.listing_id: r.source_url for r in store.images.read(spark).collect()}
    assert len(images) == 199 and images["0007"].endswith("/x") and "0008" not in images
    assert {r.source_url[-3:]: r.rejection_count for r in store.rejections.read(spark).collect()} == {"500": 3, "501": 1, "502": 1}
    # Accepting the only rejection of a bucket empties it.
    taken = rows.limit(1).withColumn("source_url", F.lit("https://e.example/501")).withColumn("id", F.lit("new"))
    jobs.apply_batch(spark, store, taken, gallery.limit(0), rejected(spark), "2024-03-02", 2)
    assert {r.source_url[-3:] for r in store.rejections.read(spark).collect()} == {"500", "502"}


@pytest.mark.parametrize("lost_at", ["stage", "replace"])
def test_a_batch_that_is_lost_half_way_is_repeated_whole(spark, tmp_path, monkeypatch, lost_at):
    rows = listings(spark, 30).withColumn("seq", F.monotonically_increasing_id())
    none = spark.createDataFrame([], IMAGE).withColumn("listing_url", F.lit("")).withColumn("seq", F.lit(1)).drop("id", "listing_id")
    store = jobs.Store(str(tmp_path / "store"), 4)
    jobs.apply_batch(spark, store, rows.limit(0), none, rejected(spark, 900, 900, 3), "2024-02-01", 0)
    real = getattr(tables.BucketedTable, lost_at)

    def loses(self, *args):
        if self.path.endswith("rejections"):
            raise RuntimeError("lost")
        return real(self, *args)

    monkeypatch.setattr(tables.BucketedTable, lost_at, loses)
    with pytest.raises(RuntimeError):
        jobs.apply_batch(spark, store, rows, none, rejected(spark, 900), "2024-02-02", 1)
    monkeypatch.setattr(tables.BucketedTable, lost_at, real)
    for _ in range(2):
        jobs.apply_batch(spark, store, rows, none, rejected(spark, 900), "2024-02-02", 1)
        assert store.listings.read(spark).count() == 30
        assert {r.source_url[-3:]: r.rejection_count for r in store.rejections.read(spark).collect()} == {"900": 3}


def with_images(rows, *galleries):
    """Listings with the images of a gallery, which are (URL, position) each, by order of seq."""
    fields = [f for f in IMAGE.fields if f.name not in ("id", "listing_id")]
    image = lambda url, position: F.struct(*[F.lit({"source_url": url, "position": position}.get(f.name)).cast(f.dataType).alias(f.name) for f in fields])
    given = F.when(F.lit(False), F.array().cast(T.ArrayType(T.StructType(fields))))
    for seq, gallery in enumerate(galleries):
        given = given.when(F.col("seq") == seq, F.array(*[image(*g) for g in gallery]).cast(T.ArrayType(T.StructType(fields))))
    return rows.withColumn("images", given)


def test_a_batch_of_new_rows_rewrites_nothing_and_folders_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PARTS", 3)
    rows = with_images(listings(spark, 120).withColumn("seq", F.col("id").cast("bigint") % 2), [("https://i.example/a", 0)], [("https://i.example/b", 0)])
    store = jobs.Store(str(tmp_path / "store"), 2)
    before = {}
    for k in range(4):
        some = rows.filter(F.col("id").cast("int").between(30 * k, 30 * k + 29))
        jobs.apply_batch(spark, store, some, None, rejected(spark, *range(500 + 50 * k, 520 + 50 * k)), "2024-02-01", k)
        after = files_of(tmp_path / "store")
        if k < 3:  # the fourth batch puts the three folders of each bucket together
            assert all(after[folder] == names for folder, names in before.items()) and len(after) == 6 * (k + 1)
        before = after
    assert len(after) == 18
    live = [r.bucket for r in spark.read.parquet(store.listings.path).filter("source_url is not null").select("bucket").distinct().collect()]
    assert sorted(live) == [0, 1]
    assert sorted(r.id for r in store.listings.read(spark).collect()) == [f"{n:04d}" for n in range(120)]
    assert sorted((r.listing_id, r.source_url[-1]) for r in store.images.read(spark).collect()) == [(f"{n:04d}", "ab"[n % 2]) for n in range(120)]
    assert store.rejections.read(spark).count() == 80


def test_reviewed_rows_bring_the_gallery_of_the_last_row(spark, tmp_path):
    rows = listings(spark, 3).withColumn("seq", F.lit(0))
    store = jobs.Store(str(tmp_path / "store"), 2)
    old = [("https://i.example/old", 0), ("https://i.example/gone", 1)]
    jobs.apply_batch(spark, store, with_images(rows, old), None, rejected(spark), "2024-02-01", 0)
    one, two = rows.filter("id = '0000'"), rows.filter("id = '0001'")
    fresh = two.withColumn("id", F.lit("n")).withColumn("source_url", F.lit("https://e.example/n"))
    batch = one.withColumn("id", F.lit("other")).unionByName(one.withColumn("seq", F.lit(1))).unionByName(two.withColumn("seq", F.lit(2))) \
        .unionByName(fresh).unionByName(fresh.withColumn("seq", F.lit(1)).withColumn("id", F.lit("m")))
    batch = with_images(batch, [("https://i.example/first", 0), ("https://i.example/first", 5)], [("https://i.example/x", 0), ("https://i.example/y", 0)], [])
    jobs.apply_batch(spark, store, batch, None, rejected(spark), "2024-02-02", 1)
    assert sorted(r.id for r in store.listings.read(spark).collect()) == ["0000", "0001", "0002", "m"]
    assert sorted((r.listing_id, r.position, r.source_url[18:]) for r in store.images.read(spark).collect()) == [
        ("0000", 0, "y"), ("0002", 0, "old"), ("0002", 1, "gone"), ("m", 0, "y")]


def test_padded_urls_of_a_batch_lose_no_stored_rows(spark, tmp_path):
    rows = with_images(listings(spark, 60).withColumn("seq", F.lit(0)), [("https://i.example/a", 0)])
    flat = lambda some: some.select(F.col("source_url").alias("listing_url"), F.explode("images").alias("i"), "seq").select("listing_url", "i.*", "seq")
    store = jobs.Store(str(tmp_path / "store"), 16)
    jobs.apply_batch(spark, store, rows.drop("images"), flat(rows), rejected(spark, 1000), "2024-02-01", 0)
    padded = rows.limit(5).withColumn("source_url", F.concat(F.lit(" "), "source_url")).unionByName(
        rows.limit(1).withColumn("source_url", F.lit("https://e.example/1000 ")).withColumn("id", F.lit("1000")))
    jobs.apply_batch(spark, store, padded.drop("images"), flat(padded), rejected(spark), "2024-02-02", 1)
    assert store.listings.read(spark).count() == 61 and store.images.read(spark).count() == 61 and store.rejections.read(spark).count() == 0


def test_shuffle_files_go_when_their_query_ends(spark, tmp_path):
    from lapak.session import shuffles_removed

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}

    before = files()
    with shuffles_removed(spark):
        spark.range(100_000).repartition(8, "id").write.parquet(str(tmp_path / "out"))
    deadline = time.time() + 20
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before


def test_merge_errors(spark):
    rows = listings(spark, 3).withColumn("seq", F.lit(1))
    with pytest.raises(Exception, match="without source_url"):
        upsert.upsert_listings(rows.drop("seq"), rows.withColumn("source_url", F.lit(" ")), "2024-01-01")[0].collect()
    half = spark.createDataFrame([("l", "https://e.example/a", "https://c.example", 0, None, 1)],
                                 "listing_id string, source_url string, cached_url string, position int, alt_text string, seq int")
    for f in IMAGE.fields:
        if f.name not in half.columns and f.name != "id":
            half = half.withColumn(f.name, F.lit(None).cast(f.dataType))
    touched = spark.createDataFrame([("l",)], "listing_id string")
    with pytest.raises(Exception, match="complete or absent"):
        upsert.replace_images(spark.createDataFrame([], IMAGE), half, touched)[0].collect()


def test_rejections_count_each_occurrence(spark):
    batch = spark.createDataFrame(
        [(i, "reddit", "https://e.example/x", None, f"t{i}", "d", None, "OTHER") for i in range(3)],
        "seq int, platform string, source_url string, external_id string, title string, description string, seller_name string, reason_code string")
    once = upsert.upsert_rejections(spark.createDataFrame([], REJECTION), batch, "2024-01-01")
    twice = upsert.upsert_rejections(once, batch, "2024-01-02").first()
    assert twice["rejection_count"] == 6 and twice["title"] == "t2" and twice["first_rejected_at"] == dt.datetime(2024, 1, 1)


def test_unresolved_legacy_flag_fails_when_strict(spark):
    flags = spark.createDataFrame([("f", "nobody", "manual")], "id string, normalized_seller_name string, source string")
    events = spark.createDataFrame([], "action string, entity_type string, entity_id string, details string")
    marks = spark.createDataFrame([], "listing_id string, seller_name_override string")
    args = (flags, events, listings(spark, 2), marks)
    assert moderation.resolve_legacy_seller_platform(*args).first()["platform"] is None
    with pytest.raises(Exception, match="cannot be mapped"):
        moderation.resolve_legacy_seller_platform(*args, strict=True).collect()


def test_contract_reports_every_error(spark):
    row = dict.fromkeys(contract.CONTRACT_COLUMNS)
    row.update(platform="ebay", title=" ", price="true", location_texts=[" a ", ""], images=[None])
    from lapak.schemas import CONTRACT

    frame = spark.createDataFrame([tuple(row[c] for c in contract.CONTRACT_COLUMNS)], CONTRACT)
    _, invalid = contract.validate_contract(frame)
    error = invalid.first()["error"]
    assert error.startswith("<unknown>: platform must be") and "title is required" in error
    assert "price must be an integer or null" in error and "images[0] must be an object" in error


def json_listing(**changes):
    row = {"platform": "reddit", "sourceUrl": "https://e.example/1", "externalId": "x", "title": "T", "description": "d", "price": 5,
           "locationTexts": ["A"], "status": "sold", "postedAt": None, "firstFetchedAt": "2024-01-01T00:00:00Z",
           "lastFetchedAt": "2024-01-01T00:00:00", "images": []}
    return json.dumps({k: v for k, v in {**row, **changes}.items() if v != "-"})


@pytest.mark.parametrize("text, error", [
    (json_listing(), None), (json_listing(price="5"), "x: price must be an integer or null"), (json_listing(price=-1), "x: price must be zero or greater"),
    (json_listing(price=5.5), "x: price must be an integer or null"), (json_listing(price=False), "x: price must be an integer or null"),
    (json_listing(price="-"), None), (json_listing(locationTexts="A"), "x: locationTexts must be a string array"),
    (json_listing(locationTexts={"a": 1}), "x: locationTexts must be a string array"), (json_listing(locationTexts=None), None),
    (json_listing(images={}), "x: images must be an array"), (json_listing(images=None), None), (json_listing(images=7), "x: images must be an array"),
    (json_listing(images=[1]), "x: images[0] must be an object"), (json_listing(images=[{}]), "x: images[0].sourceUrl is required"),
    (json_listing(images=[{"sourceUrl": "u"}]), None), (json_listing(images=[{"sourceUrl": "u", "position": None}]), "x: images[0].position must be an integer"),
    (json_listing(images=[{"sourceUrl": "u", "position": True}]), "x: images[0].position must be an integer"),
    (json_listing(images=[{"sourceUrl": "u", "position": 1.0}, [1]]), "x: images[0].position must be an integer; images[1] must be an object"),
    (json_listing(postedAt=5), "x: postedAt must be an ISO datetime string or null"), (json_listing(postedAt=""), None),
    (json_listing(firstFetchedAt=7), "x: firstFetchedAt must be an ISO datetime string or null"),
    (json_listing(firstFetchedAt=None, externalId=None), "https://e.example/1: firstFetchedAt is required"),
    (json_listing(title=True, externalId=3), None), ("[1]", "listing must be an object"), ("nope", "listing must be an object"),
    ("null", "listing must be an object"), (None, "listing must be an object")])
def test_contract_types_of_json(spark, text, error):
    valid, invalid = contract.validate_contract(contract.contract_of_json(spark.createDataFrame([(1, text)], "seq int, value string")))
    assert [r.error for r in invalid.collect()] == ([] if error is None else [error])
    rows = valid.collect()
    assert len(rows) == (error is None)
    if text == json_listing(title=True, externalId=3):
        assert (rows[0].title, rows[0].external_id, rows[0].location_texts) == ("True", "3", ["A"])


def test_no_description_is_shuffled_to_decide_visibility(spark):
    """Without broadcasts, an exchange carries keys of the texts and never the texts."""
    from lapak.operators import visibility
    from lapak.plans.views import Tables

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = Tables(spark, "/root/testdata/sf0.001")
        rows = t.listings.withColumnRenamed("description", "_d").withColumn("description", F.concat("_d", F.lit("")).alias("description")).drop("_d")
        seen = visibility.visible_listings(rows, t.moderation, t.controls, t.blocks, t.flags).select("id")
        physical = seen._jdf.queryExecution().sparkPlan().toString()
        plan = seen._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "xxhash64" in physical and plan.count("Exchange hashpartitioning") >= 4
    joins = [line for line in plan.split("\n") if "SortMergeJoin" in line or "Exchange" in line]
    assert joins and not any("description#" in line for line in joins if "normalized_value#" not in line)  # the block list names its field


# Extraction --------------------------------------------------------------------------------------------------------

def payload(spark, *texts, page="p"):
    return spark.createDataFrame([(page, i, t) for i, t in enumerate(texts)], "page_id string, script_index int, text string")


def test_marketplace_cards(spark):
    def node(i, **more):
        return {"node": {"listing": {"id": i, "marketplace_listing_title": f"T{i}", **more}}}

    body = {"a": [{"marketplace_search": {"feed_units": {"edges": [
        node("1", is_sold="yes", is_live=True, listing_price={"formatted_amount": "Rp1", "amount": "100"}), {"node": None},
        {"node": {"id": "2", "custom_title": "T2", "is_sold": False}}, node("1", is_sold=True), {"node": {"id": "3"}}, "x"]}}}]}
    got = extract_json.extract_marketplace(payload(spark, "{broken", json.dumps(body))).orderBy("item_id").collect()
    assert [(r["item_id"], r["title"], r["is_sold"], r["is_live"], r["price_amount"]) for r in got] == [
        ("1", "T1", None, True, 100), ("2", "T2", False, None, None)]
    assert got[0]["raw_text"] == "Rp1\nT1"
    assert extract_json.extract_marketplace(payload(spark, json.dumps(body)), 1).first()["item_id"] == "1"


def test_group_stories(spark):
    attached = {"message": {"text": {"text": " inner "}}, "attachments": [{"media": {
        "__typename": "Photo", "viewer_image": {"uri": "https://x.fbcdn.net/1.jpg"}}}], "actors": [{"id": 9, "name": "Inner"}]}
    outer = {"post_id": 5, "target_group": {"id": "g"}, "attached_story": attached, "creation_time": "100"}
    late = {"post_id": "5", "target_group": {"id": "g"}, "message": "late", "wwwURL": "https://facebook.com/groups/g/posts/5?x=1",
            "comet_sections": {"c": {"__typename": "GroupCommerceProductItem", "formatted_price": {"text": "Rp5"}, "id": 7}}}
    other = {"post_id": "6", "target_group": {"id": "other"}, "message": "no"}
    texts = ("for (;;);" + json.dumps({"data": outer}), json.dumps(late) + "\n" + json.dumps([other]) + " trailing {")
    targets = spark.createDataFrame([("g",)], "group_id string")
    row = extract_json.extract_group_posts(payload(spark, *texts), targets).collect()
    assert len(row) == 1
    row = row[0]
    assert (row["message"], row["seller_name"], row["published_timestamp"], row["used_attached_story"]) == ("inner", "Inner", 100, True)
    assert row["permalink"] == "https://www.facebook.com/groups/g/posts/5/"
    assert row["commerce"]["formatted_price"] == "Rp5" and [i["url"] for i in row["images"]] == ["https://x.fbcdn.net/1.jpg"]


def test_profile_posts(spark):
    one = {"polaris_ordered_timeline_connection": {"edges": [
        {"node": {"code": "A", "pk": "1", "taken_at": 5, "carousel_media": [{"display_uri": "u1"}, {"display_uri": "u2"}]}},
        {"node": {"code": "B", "pk": "9", "taken_at": 5}}, {"node": {"code": "C"}}, {"node": {}}]}}
    two = {"edge_owner_to_timeline_media": {"edges": [{"node": {
        "shortcode": "A", "taken_at_timestamp": 7, "edge_media_to_caption": {"edges": [{"node": {"text": " hi "}}]},
        "edge_sidecar_to_children": {"edges": [{"node": {"display_url": "u2"}}, {"node": {"display_url": "u3"}}]}}}]}}
    got = extract_json.extract_profile_posts(payload(spark, json.dumps(one), json.dumps(two))).orderBy("place").collect()
    assert [r["shortcode"] for r in got] == ["A", "B", "C"]
    assert got[0]["taken_at"] == 7 and got[0]["caption"] == "hi" and got[0]["children"] == ["u1", "u2", "u3"]


def test_galleries(spark):
    post = {"id": "x", "gallery_data": {"items": [{"media_id": "b"}, {"media_id": "a"}]}, "media_metadata": {
        "a": {"status": "valid", "m": "image/jpg", "s": {"u": "https://preview.redd.it/a.jpg?x=1&amp;y=2"},
              "p": [{"x": 1, "y": 1, "u": "https://preview.redd.it/s.jpg"}, {"x": 2, "y": 2, "u": "https://preview.redd.it/big.jpg"}]},
        "b": {"status": "failed"}}, "preview": {"images": [{"source": {"url": "https://preview.redd.it/a.jpg?z"}}]},
        "url": "https://example.com/page"}
    text = json.dumps([{"data": {"children": [{"data": {}}, {"data": post}]}}])
    got = extract_json.gallery_images(payload(spark, text)).orderBy("position").collect()
    assert [r["url"] for r in got] == ["https://i.redd.it/a.jpg", "https://i.redd.it/big.jpg"]


def test_atom_feed(spark):
    feed_text = ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><id>t3_aa</id><updated>2024-01-01T00:00:00+00:00</updated>'
                 '<link href="https://x.example/1"/><link href="https://www.reddit.com/r/m/comments/aa/t/"/>'
                 '<content type="html">&lt;p&gt;Hi&lt;/p&gt;</content></entry><entry><title>B</title><content></content></entry></feed>')
    got = extract_text.parse_atom(payload(spark, feed_text, "<broken"), 5).orderBy("place").collect()
    assert [(r["title"], r["url"], r["description"]) for r in got] == [
        ("A", "https://www.reddit.com/r/m/comments/aa/t/", "Hi"), ("B", "", "")]
    rows = extract_text.parse_atom(payload(spark, feed_text), 1).withColumn("flair", F.lit("SOLD OUT"))
    out = normalize.normalize_reddit(rows, F.lit("2024-01-02").cast("timestamp_ntz")).first()
    assert (out["external_id"], out["status"], out["posted_at"]) == ("aa", "SOLD", "2024-01-01T00:00:00.000Z")


def test_status_evidence_precedence(spark):
    page = lambda i, final, text: (i, i, f"https://www.facebook.com/marketplace/item/{i}/", final, text)
    item = "https://www.facebook.com/marketplace/item/"
    pages = spark.createDataFrame([
        page("1", item + "1/?x", "Terjual"), page("2", item + "2", "log in to facebook"), page("3", "https://www.facebook.com/login", "kata sandi"),
        page("4", item + "4/", "Barang\nRelated searches\nsold")],
        "page_id string, external_id string, source_url string, final_url string, visible_text string")
    scripts = spark.createDataFrame([("1", 0, json.dumps({"x": [{"id": "1"}, {"id": 1, "is_sold": False, "is_live": True}]}))],
                                    "page_id string, script_index int, text string")
    got = {r["external_id"]: (r["status"], r["signal"], r["checked"]) for r in reconcile.status_evidence(pages, scripts).collect()}
    assert got == {"1": ("available", "structured_is_live", True), "2": (None, "page_checked_without_status_signal", True),
                   "3": (None, "login_blocked", False), "4": (None, "page_checked_without_status_signal", True)}


# Files -------------------------------------------------------------------------------------------------------------

def test_run_log_files(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    lines = [{"source": "scheduler", "status": "success", "logged_at": "2024-01-01T00:00:00+07:00"},
             {"source": "scheduler", "status": "failed", "finished_at": "2024-01-05T00:00:00Z"},
             {"source": "scheduler", "status": "odd", "logged_at": "n/a"}]
    (folder / "a.jsonl").write_text("\n".join([json.dumps(x) for x in lines] + ["{broken", "[1]", ""]))
    (folder / "b.txt").write_text("ignored")
    got = runlogs.scan_run_logs(spark, str(folder), "2024-01-02").collect()
    assert sorted(r["status"] for r in got) == ["failed", "odd"] and {r["file_name"] for r in got} == {"a.jsonl"}


def test_fallback_to_scheduler_summaries(spark):
    summary = {"ok": True, "connectors": [{"connector": "reddit", "status": "success", "ok": True}],
               "storage": {"summary": {"requested": 4, "inserted": 3}}}
    line = json.dumps({"source": "scheduler", "status": "success", "logged_at": "2024-01-01T00:00:00Z", "summary": summary})
    frame = spark.createDataFrame([(line, "f", 1)], "value string, file_name string, line bigint")
    logs = runlogs.parse_run_log_lines(frame)
    assert runs.connector_records(logs).first()["connector"] == "reddit"
    assert runs.storage_totals(logs).first()["inserted"] == 3
    out = runs.yield_summary(logs).first()
    assert (out["new_per_successful_run"], out["inserted_share"]) == (3.0, 0.75)
    ready = runs.readiness(logs, required=("reddit",)).first()
    assert ready["ready"] is True and runs.readiness(logs).first()["ready"] is False


def test_image_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\xff\xd8\xff123")
    (tmp_path / "b.bin").write_bytes(b"GIF89a")
    (tmp_path / "c.bin").write_bytes(b"\x89PNG\r\n\x1a\n" + b"x" * 100)
    (tmp_path / "d.bin").write_bytes(b"")
    got = image_source.scan_images(spark, str(tmp_path), max_bytes=50).collect()
    assert [(r["content_type"], r["extension"], r["byte_size"]) for r in got] == [("image/jpeg", "jpg", 6)]


def test_reports_replace_only_their_day(spark, tmp_path):
    one, two = spark.range(3).toDF("n"), spark.range(5).toDF("n")
    for frame, day in ((one, "2024-01-01"), (two, "2024-01-02"), (two, "2024-01-01")):
        paths = tables.write_reports(frame, frame, str(tmp_path), day)
    counts = {str(r["report_date"]): r["count"] for r in spark.read.json(paths[0]).groupBy("report_date").count().collect()}
    assert counts == {"2024-01-01": 5, "2024-01-02": 5}


def test_rolling_window_has_no_cap(spark):
    rows = listings(spark)
    images = rows.select(F.col("id"), F.col("id").alias("listing_id"), "source_url", F.lit(None).cast("string").alias("cached_url"))
    assert media.pending_media(images, rows, T0, limit=None).count() == 60
    assert media.pending_media(images, rows, T0).count() == 25
    load()
    found = QUERIES["t10_rolling_window"](spark, "/root/testdata/sf0.001")
    assert "Limit" not in found._jdf.queryExecution().optimizedPlan().toString()


class CountedState:
    """Map state of one shard in a dict, with its calls counted."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]


def processor_with_states(processor):
    states = []

    class Handle:
        def getMapState(self, *names):
            states.append(CountedState())
            return states[-1]

        def getValueState(self, *names):
            state = CountedState()
            state.exists, state.get, state.update = (
                lambda: () in state.held, lambda: state.held[()], lambda value: state.held.update({(): value}))
            return state

    processor.init(Handle())
    return processor, states


def test_change_state_is_called_per_part_and_not_per_row():
    processor, states = processor_with_states(stateful.ChangeProcessor())
    n = 30_000
    frame = pd.DataFrame({"candidate_key": [f"K:{i % 5000}" for i in range(n)], "seq": range(n), "fingerprint": [f"v{i // 5000 % 2}" for i in range(n)],
                          "observed_at": pd.Timestamp(T0), "platform": "x", "source_id": "y", "payload_json": "z", "status": None})
    first = pd.concat(processor.handleInputRows((0,), iter([frame[: n // 2], frame[n // 2:]]), None))
    assert (first["effect"] == "new").sum() == 5000 and (first["effect"] == "changed").sum() == n - 5000
    assert sum(s.calls for s in states) <= 2 * 2 * stateful.PARTS
    again = pd.concat(processor.handleInputRows((0,), iter([frame[-1:].assign(seq=n)]), None)).iloc[-1]
    assert (again["effect"], again["queued"], again["seen_count"]) == ("unchanged", "refresh", 7)


def test_initial_state_of_a_shard_may_come_in_frames():
    processor, _ = processor_with_states(stateful.ChangeProcessor())
    rows = [("K:1", "A", "pending", None, None), ("K:1", "B", None, pd.Timestamp(T0), 3), ("K:1", "C", "pending", None, None)]
    for row in rows:
        processor.handleInitialState((0,), pd.DataFrame([row], columns=["candidate_key", "fingerprint", "status", "first_seen_at", "seen_count"]), None)
    frame = pd.DataFrame({"candidate_key": ["K:1"], "seq": [1], "fingerprint": ["D"], "observed_at": pd.Timestamp(T0), "platform": "x", "source_id": "y",
                          "payload_json": "z", "status": None})
    out = pd.concat(processor.handleInputRows((0,), iter([frame]), None))
    assert [(r.fingerprint, r.effect) for r in out.itertuples() if r.effect != "sight"] == [("A", "superseded"), ("C", "superseded"), ("D", "changed")]
    assert out.iloc[-1]["seen_count"] == 4


def test_revision_state_is_called_per_part_and_takes_back_the_newest():
    processor, states = processor_with_states(stateful.VisibleProcessor())
    n, start = 20_000, pd.Timestamp(T0)
    frame = pd.DataFrame({"listing_id": [str(i) for i in range(n)], "seq": 0, "visible": True, "at": [start + pd.Timedelta(seconds=i) for i in range(n)]})
    (shown,) = processor.handleInputRows((7,), iter([frame]), None)
    assert (shown["visible"][0], shown["latest"][0]) == (n, start + pd.Timedelta(seconds=n - 1))
    (hidden,) = processor.handleInputRows((7,), iter([frame[10:].assign(seq=1, visible=False)]), None)
    assert (hidden["visible"][0], hidden["latest"][0]) == (10, start + pd.Timedelta(seconds=9))
    (none,) = processor.handleInputRows((7,), iter([frame[:10].assign(seq=2, visible=False)]), None)
    assert (none["visible"][0], none["latest"][0]) == (0, None)
    assert sum(s.calls for s in states) <= 8 * stateful.PARTS


def test_upsert_stream_takes_three_batches_however_many_files(spark, monkeypatch):
    from lapak.plans.views import Tables

    calls, listings_of, body = [], Tables.listings.func, jobs.apply_batch
    monkeypatch.setattr(Tables, "listings", property(lambda t: listings_of(t).repartition(30)))
    monkeypatch.setattr(jobs, "apply_batch", lambda *args: (calls.append(1), body(*args)))
    load()
    rows = {r.part: r.rows for r in QUERIES["t5_upsert_stream"](spark, "/root/testdata/sf0.001").collect()}
    assert rows["listings"] + rows["rejections"] == 1500 and 1 <= len(calls) <= 3


def _plain_plan(spark, make):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_images_are_shuffled_once_for_their_replacement(spark):
    import __spark_entry__ as entry

    plan = _plain_plan(spark, lambda: entry.queries()["snk2_replace_images"](spark, "/root/testdata/sf0.001"))
    scans = [line for line in plan.splitlines() if "FileScan" in line and "l_orderkey" in line and "[isnull(" not in line]
    assert len(scans) == 1


def test_replaced_images_carry_their_cache_and_spare_stray_rows(spark):
    row = {f.name: None for f in IMAGE.fields}
    cached = {"cached_url": "c", "storage_key": "k", "content_hash": "h", "content_type": "t", "byte_size": 1,
              "cached_at": dt.datetime(2024, 1, 1)}
    old = [row | {"id": "1", "listing_id": "a", "source_url": "https://x/1.jpg?s=1", "position": 0} | cached,
           row | {"id": "2", "listing_id": "a", "source_url": "https://x/2.jpg", "position": 1},
           row | {"id": "3", "listing_id": None, "source_url": "https://x/3.jpg", "position": 0},
           row | {"id": "4", "listing_id": "b", "source_url": "https://x/4.jpg", "position": 0} | cached]
    new = spark.createDataFrame([row | {"id": "n", "listing_id": "a", "source_url": f"https://x/{p + 1}.jpg?s=2", "position": p}
                                 for p in (0, 1)], IMAGE).withColumn("seq", F.lit(1))
    touched = spark.createDataFrame([("a",)], "listing_id string")
    after = upsert.replace_images(spark.createDataFrame(old, IMAGE), new, touched)[0]
    assert sorted((r.source_url, r.cached_url) for r in after.collect()) == [
        ("https://x/1.jpg?s=2", "c"), ("https://x/2.jpg?s=2", None), ("https://x/3.jpg", None), ("https://x/4.jpg", "c")]


def test_media_summary_moves_no_long_keys(spark):
    from lapak.operators import media

    downloads = spark.createDataFrame([("1", "k"), ("2", "k"), ("2", "k"), ("3", "s"), ("4", None), ("5", "m"), (None, "k"), ("9", "q")],
                                      "id string, storage_key string")
    images = spark.createDataFrame([("1", None), ("2", None), ("3", None), ("4", None), ("5", "done")], "id string, cached_url string")
    stored = spark.createDataFrame([("s",), ("s",), (None,)], "storage_key string")
    assert media.media_summary(downloads, images, stored).first() == (8, 4, 1, 3, 1, 3)
    assert "hashpartitioning(storage_key" not in _plain_plan(spark, lambda: media.media_summary(downloads, images, stored))
