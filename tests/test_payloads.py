"""Payload texts of any depth, broken texts, the run-log round trip, and limits that are taken as given."""

import time

from pyspark.sql import functions as F

from lapak.operators import extract_json, feed, media, runs
from lapak.functions import values
from lapak.sources import runlogs
from lapak.sources.payloads import PAYLOAD_SCHEMA, bad_payloads, parsed, parsed_all, walk


def payloads(spark, *texts):
    rows = [("facebook", "t", f"p{i}", 0, None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, PAYLOAD_SCHEMA)


def test_walk_has_no_depth_limit_and_keeps_its_order():
    value = {"k": 1}
    for _ in range(100_000):
        value = [{"n": value}]
    assert sum(1 for _ in walk(value)) == 100_001
    tree = {"a": {"x": 1}, "b": [{"y": 1}, {"z": 1}]}
    assert [sorted(o)[0] for o in walk(tree)] == ["a", "z", "y", "x"]
    assert [sorted(o)[0] for o in walk(tree, reverse=False)] == ["a", "x", "y", "z"]
    assert [sorted(o)[0] for o in walk(tree, skip=("b",))] == ["a", "x"]


def test_broken_texts_take_one_scan():
    begin = time.time()
    assert parsed("[" * 100_000 + "]" * 100_000) is None
    assert parsed_all('{"a":' * 100_000) == []
    assert parsed_all('{"a":[1,{"b":"}"}],"c":{"d":1}, "e": "tru' + "x" * 10_000_000) == [[1, {"b": "}"}], {"d": 1}]
    assert time.time() - begin < 20
    assert parsed_all('for (;;);{"a":1}\n{"b":{"c":2}}') == [{"a": 1}, {"b": {"c": 2}}]
    assert parsed_all(None) == []


def test_one_deep_payload_does_not_fail_the_job(spark):
    card = '{"marketplace_search":{"feed_units":{"edges":[{"node":{"id":"7","marketplace_listing_title":"x"}}]}}}'
    rows = payloads(spark, card, "[" * 100_000 + "]" * 100_000, '{"n":' * 5000 + card + "}" * 5000, None)
    assert [r.item_id for r in extract_json.extract_marketplace(rows).collect()][:1] == ["7"]
    assert "p1" in {r.page_id for r in bad_payloads(rows).collect()}
    assert extract_json.extract_group_posts(rows, spark.createDataFrame([("1",)], "group_id string")).collect() == []


def test_prices_of_urls_are_numbers_up_to_the_safe_integer(spark):
    given = {"00000000000000500": 500, "1e5": 100000, "0x10": 16, "9007199254740991": 9007199254740991,
             "9999999999999999": None, "9007199254740993": None, "2.5": None, "-1": None, "": None, "5.": 5, "x": None}
    urls = spark.createDataFrame([(k, f"https://a.example/?minPrice={k}") for k in given], "k string, url string")
    assert {r.k: r.min_price for r in feed.parse_feed_params(urls).collect()} == given


def test_page_limit_is_taken_as_given(spark):
    listings = spark.range(1500).select(F.format_string("%05d", "id").alias("id"), F.lit("u").alias("source_url"), F.lit("t").alias("title"))
    images = listings.select(F.col("id").alias("listing_id"), "source_url", F.lit(0).alias("position"))
    assert media.listing_page_images(listings, images, limit=1200).count() == 1200


def test_streaks_without_steps(spark):
    rows = spark.createDataFrame([("a", k, "degraded") for k in range(3)], "job_id string, seq long, status string")
    assert [(r.streak, r.delay_seconds) for r in runs.failure_streaks(rows, backoff=()).orderBy("seq").collect()] == [
        (1, 180), (2, 180), (3, 180)]


def test_run_log_round_trip(spark, tmp_path):
    events = spark.createDataFrame([("scheduler", "success", "secret")], "source string, status string, api_token string")
    runlogs.append_run_log(events, str(tmp_path / "log"), "2024-01-01T00:00:00Z")
    runlogs.append_run_log(events, str(tmp_path / "log"), "2024-01-02T00:00:00Z")
    assert sorted(r.log_time for r in runlogs.scan_run_logs(spark, str(tmp_path / "log")).collect()) == [
        "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"]


def test_group_fingerprint_has_sorted_keys(spark):
    import hashlib

    row = spark.range(1).select(values.evidence_fingerprint(
        F.lit("facebook_group"), F.lit("https://a.example/x"), F.lit("7"), F.lit("t"), F.lit("d"), F.lit("s"),
        F.create_map(F.lit("sourceType"), F.lit("facebook_group"))).alias("f")).first()
    text = '{"externalId":"7","platform":"FACEBOOK_GROUP","sourceType":"facebook_group","sourceUrl":"https://a.example/x"}'
    assert row.f == "v2:" + hashlib.sha256(text.encode()).hexdigest()


def market_text(*ids):
    import json

    nodes = [{"node": {"id": i, "marketplace_listing_title": f"t{i}{k}"}} for k, i in enumerate(ids)]
    return json.dumps({"marketplace_search": {"feed_units": {"edges": nodes}}})


def test_a_limit_reads_no_more_cards_than_it_can_keep(spark):
    text = market_text("a", "a", "b", "c", "d", "b")
    assert [c["title"] for c in extract_json._first_cards(2)(text)] == ["ta0", "tb2"]
    assert [c["title"] for c in extract_json._first_cards(None)(text)] == ["ta0", "tb2", "tc3", "td4"]
    scripts = [["a", "a", "b", "c"], ["c", "d", "a"], ["e", "d", "c", "b"]]
    rows = [("facebook", "t", "p", k, None, market_text(*ids)) for k, ids in enumerate(scripts)]
    frame = spark.createDataFrame(rows, PAYLOAD_SCHEMA).repartition(3)
    order = list(dict.fromkeys(i for ids in scripts for i in ids))
    for limit in range(1, 7):
        cards = extract_json.extract_marketplace(frame, limit).orderBy("place").collect()
        assert [c.item_id for c in cards] == order[:limit]


def test_the_reader_passes_small_batches_on(monkeypatch, spark):
    sizes = []

    class Payloads:
        schema, columns = spark.createDataFrame([], PAYLOAD_SCHEMA).schema, ["page_id", "script_index", "text"]

        def select(self, *columns):
            return self

        def mapInArrow(self, run, raw):
            import pyarrow as pa

            batch = pa.RecordBatch.from_pydict({"page_id": ["p"] * 900, "script_index": pa.array([0] * 900, pa.int32()),
                                                "text": [market_text(*map(str, range(9)))] * 900})
            sizes.extend(b.num_rows for b in run(iter([batch])))
            return self

    extract_json._emit(Payloads(), extract_json._cards, extract_json.CARD)
    assert sum(sizes) == 8100 and max(sizes) <= extract_json.RECORDS
