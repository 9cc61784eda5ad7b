"""Expected values of the public contract: shape, cursors, inputs, facets, revisions, buckets."""

import datetime as dt
import html
import random

import pytest
from pyspark.sql import Row, functions as F

from lapak.functions import text, urls, values
from lapak.operators import dto, extract_text, facets, feed, relevance
from lapak.schemas import IMAGE, LISTING, MODERATION
from lapak.streaming.jobs import feed_revision

T0 = dt.datetime(2026, 7, 12, 10, 0, 0)
ORIGIN = urls.DEFAULT_MEDIA_ORIGIN


def listing(**changes):
    row = dict(id="listing-1", platform="instagram", source_url="https://www.instagram.com/p/example/", external_id="example",
               title="RTX 4070", description="Full seller caption", category="GPU", brand="NVIDIA", price=7_500_000,
               location_texts=["Jakarta"], condition_text="Used", seller_name="seller", status="available", posted_at=None,
               first_fetched_at=T0, last_fetched_at=T0, created_at=T0, updated_at=T0)
    row.update(changes)
    return tuple(row[f] for f in LISTING.fieldNames())


def image(position, source, cached=None, alt=None):
    row = dict.fromkeys(IMAGE.fieldNames())
    row.update(id=f"i{position}", listing_id="listing-1", source_url=source, cached_url=cached, position=position, alt_text=alt)
    return tuple(row[f] for f in IMAGE.fieldNames())


def shape(spark, listing_row, images, override=None, **options):
    marks = [("listing-1", False, override)] if override else []
    return dto.to_listing_dto(
        spark.createDataFrame([listing_row], LISTING), spark.createDataFrame(images, IMAGE),
        spark.createDataFrame(marks, MODERATION), **options).first()


GALLERY = [
    (2, "https://scontent.example/image-2.jpg", f"{ORIGIN}/production/instagram/aa/two.jpg", None),
    (1, "javascript:alert(1)", None, "unsafe"),
    (3, "not-a-url", None, "malformed"),
    (0, "https://scontent.example/image-0.jpg", None, "front"),
]


def test_dto_shape(spark):
    row = shape(spark, listing(), [image(*g) for g in GALLERY])
    assert (row["id"], row["price"], row["currency"], row["status"]) == ("listing-1", 7_500_000, "IDR", "available")
    assert row["listed_at"] == T0 and row["location_texts"] == ["Jakarta"] and row["seller_name"] == "seller"
    assert [tuple(i) for i in row["images"]] == [
        ("https://scontent.example/image-0.jpg", 0, "front"), (f"{ORIGIN}/production/instagram/aa/two.jpg", 2, None)]


@pytest.mark.parametrize("platform, folder, cached", [
    ("facebook", "facebook", True), ("facebook", "facebook-groups", False), ("facebook_group", "facebook-groups", True),
    ("reddit", "reddit", True), ("reddit", "instagram", False), ("instagram", "../instagram", False)])
def test_cached_media_must_fit_the_platform(spark, platform, folder, cached):
    url = f"{ORIGIN}/production/{folder}/aa/two.jpg"
    row = shape(spark, listing(platform=platform), [image(2, "https://s.example/2.jpg", url)])
    assert row["images"][0]["source_url"] == (url if cached else "https://s.example/2.jpg")


@pytest.mark.parametrize("cached", ["http://media.example/image.jpg", "https://attacker.example/production/instagram/image.jpg"])
def test_unsafe_cached_media_falls_back(spark, cached):
    row = shape(spark, listing(), [image(2, "https://s.example/2.jpg", cached)])
    assert row["images"][0]["source_url"] == "https://s.example/2.jpg"


def test_dto_fails_closed_or_marks(spark):
    plain = listing(source_url="http://example.com/listing")
    with pytest.raises(Exception, match="must use HTTPS"):
        shape(spark, plain, [])
    assert shape(spark, plain, [], on_unsafe="quarantine")["unsafe"] is True


def test_dto_override_locations_prices(spark):
    assert shape(spark, listing(), [], override="Correct Seller")["seller_name"] == "Correct Seller"
    places = [" Bandung ", "081234567890", "https://example.com/location", "x" * 81]
    assert shape(spark, listing(location_texts=places), [])["location_texts"] == ["Bandung"]
    for price in (0, 123, 123_456):
        assert shape(spark, listing(price=price), [])["price"] is None


def test_cursor_round_trip_and_rejects(spark):
    cursor = feed.Cursor("price-low", 1, 2_147_483_647, dt.datetime(2026, 7, 1, 1, 2, 3, 456000), "listing-9")
    token = feed.encode_cursor(cursor)
    assert feed.decode_cursor(token) == cursor and "=" not in token
    import base64
    import json

    def pack(**changes):
        body = {"v": 3, "s": "newest", "r": 0, "k": 0, "t": "2026-07-01T00:00:00.000Z", "i": "a", **changes}
        return base64.urlsafe_b64encode(json.dumps(body).encode()).decode().rstrip("=")

    bad = [pack(v=1), pack(v=2), pack(s="cheapest"), pack(r=3), pack(k=1.5), pack(t="yesterday"), pack(i=""), pack(i="x" * 129),
           "***", "abc", "", "a" * 513, pack(r=True)]
    for token in bad:
        with pytest.raises(feed.InvalidCursor):
            feed.decode_cursor(token)
    with pytest.raises(feed.InvalidCursor):
        feed.decode_cursor(pack(), "price-low")
    column = spark.createDataFrame([(t,) for t in [pack(), feed.encode_cursor(cursor), *bad]], "t string")
    decoded = [r["c"] for r in column.select(feed.decode_cursor_column(F.col("t")).alias("c")).collect()]
    assert decoded[0]["id"] == "a" and decoded[1]["sort_value"] == 2_147_483_647
    assert all(c is None for c in decoded[2:])


def test_feed_input_defaults_and_example():
    assert feed.validate_feed_input() == feed.FeedInput()
    full = {"platforms": ["reddit", "instagram"], "statuses": ["available"], "categories": [" GPU "], "locations": ["Jakarta"],
            "conditions": ["Used"], "q": " rtx ", "minPrice": 1, "maxPrice": 2, "sort": "price-high", "limit": 50,
            "cursor": "abc", "direction": "forward"}
    got = feed.validate_feed_input(full)
    assert got.q == "rtx" and got.categories == ("GPU",) and got.limit == 50 and got.sort == "price-high"


@pytest.mark.parametrize("bad", [
    {"platforms": []}, {"platforms": ["ebay"]}, {"platforms": ["reddit", "reddit"]}, {"statuses": []}, {"statuses": ["gone"]},
    {"statuses": ["sold", "sold"]}, {"categories": []}, {"categories": [""]}, {"categories": ["x" * 81]},
    {"categories": [str(i) for i in range(21)]}, {"locations": ["a", " a "]}, {"locations": [str(i) for i in range(11)]},
    {"conditions": [" "]}, {"q": " "}, {"q": "x" * 81}, {"minPrice": -1}, {"minPrice": 1.5}, {"maxPrice": 2_000_000_001},
    {"minPrice": 2, "maxPrice": 1}, {"sort": "cheapest"}, {"limit": 0}, {"limit": 51}, {"cursor": ""}, {"cursor": "x" * 513},
    {"direction": "backward"}, {"offset": 3}])
def test_feed_input_rejects(bad):
    with pytest.raises(feed.InvalidFeedInput):
        feed.validate_feed_input(bad)


def test_search_takes_wildcards_literally(spark):
    rows = spark.createDataFrame(
        [(1, "100% RTX_4070"), (2, "100x RTX 4070"), (3, "cheap 100% rtx_4070 now"), (4, "a\\b")], "n int, title string")
    for c in ("description", "brand", "category", "seller_name_override", "seller_name"):
        rows = rows.withColumn(c, F.lit(""))
    hits = lambda q: [r["n"] for r in rows.filter(feed.text_search(q)).orderBy("n").collect()]
    assert hits("100% RTX_4070") == [1, 3]
    assert hits("a\\b") == [4]


def test_facet_cleaning(spark):
    base = dict(posted_at=T0, location_texts=["Jakarta", "Jakarta", "0812345678", "Harga nego"], condition_text="Like New")
    rows = [listing(id="a", category="GPU", price=123_456, **base),
            listing(id="b", category="GPU", price=None, **{**base, "condition_text": "mulus banget"}),
            listing(id="c", category=" ", price=10_000, **base)]
    visible = spark.createDataFrame(rows, LISTING)
    images = spark.createDataFrame([(*image(0, "javascript:x")[:1], "b", *image(0, "javascript:x")[2:])], IMAGE)
    assert [tuple(r) for r in facets.category_facets(visible, images).collect()] == [("GPU", 2, None, None, None)]
    assert [tuple(r) for r in facets.location_facets(visible).collect()] == [("Jakarta", 6)]
    assert [tuple(r) for r in facets.condition_facets(visible).collect()] == [("Like New", 2)]


def test_revision(spark):
    one = spark.createDataFrame([listing()], LISTING)
    two = spark.createDataFrame([listing(), listing(id="x")], LISTING)
    first, again, more = (facets.feed_version(df).first() for df in (one, one, two))
    none = facets.feed_version(one.limit(0)).first()
    assert len(first["revision"]) == 43 and first == again and first["revision"] != more["revision"]
    assert none["total_count"] == 0 and len(none["revision"]) == 43


def test_unseen_counts(spark):
    polls = [(1, "a", 20), (2, "b", 23), (3, "c", 22), (4, "d", 30), (5, "e", 31)]
    history = spark.createDataFrame(polls, "seq bigint, revision string, total_count bigint")
    confirmed = spark.createDataFrame([(3,)], "seq bigint")
    for size in (1, 2, 100):
        unseen = [r["unseen"] for r in feed_revision(history, confirmed, size).orderBy("seq").collect()]
        assert unseen == [0, 3, 0, 8, 9]


def test_buckets(spark):
    row = spark.range(1).select(
        values.query_length_bucket(F.lit(14)), values.result_count_bucket(F.lit(19)), values.price_bucket(F.lit(7_500_000)),
        values.price_bucket(F.lit(None).cast("int"))).first()
    assert tuple(row) == ("6-15", "13-24", "5m-15m", "unknown")


def test_scope_filter(spark):
    rows = spark.createDataFrame([Row(platform="reddit", category="Graphics Card"), Row(platform="facebook", category="RAM")])
    kept = lambda *a: [r["platform"] for r in feed.scope_filter(rows, *a).collect()]
    assert kept("collection", "gpu") == ["reddit"] and kept("collection", "pc-build") == ["facebook"]
    assert kept("platform", "facebook") == ["facebook"] and len(kept("collection", "all")) == 2


@pytest.mark.parametrize("url, expected", [
    ("https://u:p@host.example:8080/x?q=1", "https://u:***@host.example:8080/x?q=1"),
    ("postgres://user@db/x?sslpassword=a&b=c%20d", "postgres://user@db/x?sslpassword=%2A%2A%2A&b=c+d"),
    ("https://h.example/x#frag", "https://h.example/x#***"), ("https://h.example/x?a=%20", "https://h.example/x?a=%20"),
    ("https://:pw@H.example/x", "https://h.example/x"), ("plain", "plain")])
def test_redact_url(spark, url, expected):
    assert spark.range(1).select(urls.redact_url(F.lit(url))).first()[0] == expected


@pytest.mark.parametrize("content, expected", [
    ('```json\n{"a":1}\n```', '{"a":1}'), ('Sure {"a":{"b":2}} ok', '{"a":{"b":2}}'), ("nothing", None), ("[1]", None),
    ('```\n{"a":"```x"}\n```', '{"a":"```x"}'), (' {"a":1} ', '{"a":1}'), ("{broken", None)])
def test_model_json(spark, content, expected):
    assert spark.range(1).select(text.model_json(F.lit(content))).first()[0] == expected


def test_python_spaces_and_locations(spark):
    row = spark.range(1).select(
        text.strip(F.lit("\xa0\t x　")), text.normalize_spaces(F.lit("a\xa0\n b")),
        values.normalize_locations(F.array(F.lit(" Jakarta "), F.lit("jakarta"), F.lit(""), F.lit("Bogor"))),
        values.normalize_locations_text(F.lit("Depok/ Bogor,depok")),
        values.normalize_price_text(F.lit("Rp 1.500.000,-")), values.normalize_price_text(F.lit("gratis"))).first()
    assert tuple(row) == ("x", "a b", ["Jakarta", "Bogor"], ["Depok", "Bogor"], 1_500_000, None)


def test_reddit_image_entities(spark):
    source = "https://preview.redd.it/a.jpg?width=1&amp;s=2)."
    assert spark.range(1).select(urls.reddit_image_url(F.lit(source))).first()[0] == "https://i.redd.it/a.jpg"


@pytest.mark.parametrize("part, times, body", [
    ("if a <b then ", 800_000, "if a"), ("<b ", 3_400_000, ""), ("<script>", 1_300_000, ""), ("<style>x", 1_300_000, ""),
    ("<!--", 2_600_000, ""), ("<a href=\"", 1_200_000, ""), ("<b '", 2_600_000, ""), ("</", 5_200_000, ""), ("<p>x</p>", 400_000, None),
    ("🙂a", 2_500_000, None), ("< ", 1_000_000, None), ("<", 10_400_000, None), ("&amp;", 1_000_000, None)])
def test_html_to_text_is_linear(spark, part, times, body):
    """Ten megabytes of what is never closed, quoted, nested or escaped, in one text."""
    rows = spark.range(1).select(extract_text.html_to_text(F.expr(f"repeat('{part.replace(chr(39), chr(92) + chr(39))}', {times})")).alias("body"))
    found = rows.select(F.length("body").alias("n"), F.left("body", F.lit(20)).alias("head")).first()
    if body is not None:
        assert (found.n, found.head) == (len(body), body)
    else:
        assert found.n > 0


@pytest.mark.parametrize("html, body", [
    ("a <b title=\"x>y\">c</b> d", "a c d"), ("a <b title=\"x>y d", "a y d"), ("a < b <p>c", "a < b \nc"),
    ("<script>if (a<b) {}</script>x", "if (a<b) {}x"), ("x<script>var a = 1;", "x"), ("x<!-- <p>y</p> -->z", "xz"), ("x<!-- <p>y</p>", "x"),
    ("see <a class='k' href='https://e.example/1?a=1&amp;b=2'>it</a>", "see https://e.example/1?a=1&b=2 it"), ("1 <<< 2", "1 <<< 2"),
    ("&amp;lt;b&amp;gt; caf&eacute;", "<b> café"), (None, None), ("", "")])
def test_html_to_text_pieces(spark, html, body):
    frame = spark.createDataFrame([(html,)], "html string")
    assert frame.select(extract_text.html_to_text(F.col("html")).alias("b")).first().b == body


def test_references_cut_before_their_semicolon_stay_in_page_texts(spark):
    page = "<title>a&amp;&amp</title><style>p{}</style>b&am<i>p c &#38 &#38; &quot;&amp;lt;"
    found = spark.createDataFrame([(page,)], "html string").select(
        extract_text.html_to_text(F.col("html"), closed=True).alias("closed"), extract_text.html_to_text(F.col("html")).alias("open")).first()
    assert found.closed == 'a&&ampp{}b&amp c &#38 & "<'
    assert found.open == 'a&&p{}b& c & & "<'


def test_relevance_by_target(spark):
    cards = spark.createDataFrame([
        (1, "a", "1", "Laptop with PC parts", None), (2, "a", "2", "a kulkas and a pc", ""), (3, "a", "3", "upcycled wood", ""),
        (4, "a", "4", "RAM RAM", ""), (5, "b", "5", "kulkas", ""), (6, "b", "6", "anything", ""), (7, "c", "7", "only a drone", ""),
        (8, "d", "8", "a drone", ""), (9, "d", "9", "laptop", ""), (10, "a", "10", "gpus", "ssd")],
        "seq long, target_id string, item_id string, raw_text string, image_alt string").withColumn("title", F.col("raw_text"))
    rows = [("a", ["Wood", " "], ["ssd"], None, None), ("b", None, None, 1, True), ("d", ["DRONE"], [], 0, False), ("e", None, None, 500, None)]
    targets = spark.createDataFrame(rows, "target_id string, positive_keywords array<string>, blocked_keywords array<string>, card_limit int, bypass boolean")
    selected, metrics = relevance.relevance_filter(cards, targets=relevance.prepared_targets(targets))
    assert sorted((r.target_id, r.item_id, r.place) for r in selected.collect()) == [("a", "1", 1), ("a", "3", 2), ("a", "4", 3), ("b", "5", 1), ("d", "8", 1)]
    found = {r.target_id: (r.candidates, r.matched, r.skipped, r.blocked, r.matched_keywords, r.blocked_keywords) for r in metrics.collect()}
    assert found == {"a": (5, 3, 0, 2, ["pc", "laptop", "Wood", "ram"], ["kulkas", "ssd"]), "b": (2, 1, 0, 0, [], []),
                     "c": (1, 0, 1, 0, [], []), "d": (2, 2, 0, 0, ["DRONE", "laptop"], []), "e": (0, 0, 0, 0, [], [])}
    run = relevance.prepared_targets(targets, limit=2, bypass=True)
    selected, metrics = relevance.relevance_filter(cards, targets=run)
    assert {r.target_id: r.matched for r in metrics.collect()} == {"a": 2, "b": 2, "c": 0, "d": 2, "e": 0}
    report = {r.target_id: (r.selected, r.sample_ids) for r in relevance.calibration(selected, metrics).collect()}
    assert report == {"a": (2, ["1", "2"]), "b": (2, ["5", "6"]), "c": (0, []), "d": (2, ["8", "9"]), "e": (0, [])}


def test_html_unescape_follows_the_standard_library(spark):
    rng = random.Random(8)
    names = ["amp;", "amp", "lt", "gt;", "notit;", "not", "notin;", "copy", "copyx", "eacute;", "eacutex", "AMP", "bogus;", "CounterClockwiseContourIntegral;",
             "#38;", "#x26;", "#X26", "#0;", "#128;", "#129;", "#55296;", "#1114112;", "#99999999999999999999999;", "#x1F642;", "#11;", "#64976;", "#65534;",
             "#", "#x", "#;", "", " amp;", "a" * 40, "ngE;", "acE;", "#13;", "#0000000000065;", "sup2", "sup2;3"]
    texts = ["".join(rng.choice(["&", "&", "x", " ", ";", "<", "🙂"]) + rng.choice(names) for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "t string")
    for row in frame.select("t", urls.html_unescape(F.col("t")).alias("u")).collect():
        assert row.u == (None if row.t is None else html.unescape(row.t)), row.t


def test_image_urls_of_a_fragment(spark):
    """In order, distinct, with references resolved twice; a name that is in no table stays as it is."""
    page = ('<a href="https://preview.redd.it/a.png?width=640&amp;amp;s=1">x</a> <img src="https://i.redd.it/a.png"> '
            'https://a.example/x.jpg?a=1&amp;v=2, https://a.example/x.jpg?a=1&v=2 https://a.example/&eacute;.webp https://a.example/page')
    row = spark.createDataFrame([(page,), (None,)], "t string").select(extract_text.extract_image_urls(F.col("t")).alias("u")).collect()
    assert row[0].u == ["https://i.redd.it/a.png", "https://a.example/x.jpg?a=1&v=2", "https://a.example/é.webp"] and row[1].u == []
