"""Feed filters (P2-P11), order, keyset pages, cursors and page numbers."""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lapak.functions.once import computed, let
from lapak.functions.text import escape_like, web_trim
from lapak.functions.values import effective_at, iso_millis, parse_iso, to_millis
from lapak.operators.ordering import assign_rank
from lapak.schemas import COLLECTIONS, FEED_SORTS, PLATFORMS, STATUSES

MAX_PAGE = 50
NO_PRICE_HIGH = -1
NO_PRICE_LOW = 2_147_483_647
MAX_PRICE = 2_000_000_000


# Filters -----------------------------------------------------------------------------------------------------------

def text_search(q: str) -> Column:
    """Case-insensitive substring over five columns; percent, underscore and backslash are plain characters."""
    pattern = f"%{escape_like(q)}%"
    columns = [
        F.col("title"), F.col("description"), F.coalesce("brand", F.lit("")), F.coalesce("category", F.lit("")),
        F.coalesce("seller_name_override", "seller_name", F.lit("")),
    ]
    test = columns[0].ilike(pattern)
    for c in columns[1:]:
        test = test | c.ilike(pattern)
    return test


def apply_feed_filters(visible: DataFrame, platforms=None, statuses=None, categories=None, locations=None,
                       conditions=None, q=None, min_price=None, max_price=None) -> DataFrame:
    """Only the filters that are given reach the plan."""
    rows = visible
    for name, values in (("platform", platforms), ("status", statuses), ("category", categories),
                         ("condition_text", conditions)):
        if values:
            rows = rows.filter(F.col(name).isin(*values))
    if locations:
        rows = rows.filter(F.arrays_overlap("location_texts", F.array(*[F.lit(v) for v in locations])))
    if min_price is not None:
        rows = rows.filter(F.col("price") >= min_price)
    if max_price is not None:
        rows = rows.filter(F.col("price") <= max_price)
    if q:
        rows = rows.filter(text_search(q))
    return rows


def scope_filter(rows: DataFrame, scope_type: str, slug: str) -> DataFrame:
    """A platform page pins the platform, a collection page its categories; 'all' keeps everything."""
    return rows.filter(_in_scope(scope_type, slug))


def _in_scope(scope_type: str, slug: str) -> Column:
    if scope_type == "platform":
        return F.col("platform") == slug
    categories = dict(COLLECTIONS).get(slug, ())
    return F.col("category").isin(*categories) if categories else F.lit(True)


def in_scopes(rows: DataFrame, scopes: dict[str, tuple[str, str]]) -> DataFrame:
    """P11 for many pages in one pass: rows once per scope they belong to, with its label in ``scope``."""
    labels = F.array_compact(F.array(*[F.when(_in_scope(kind, slug), F.lit(label)) for label, (kind, slug) in scopes.items()]))
    return rows.withColumn("scope", F.explode(labels))


# Input checks ------------------------------------------------------------------------------------------------------

class InvalidFeedInput(ValueError):
    """The request breaks a bound of the feed contract."""


class InvalidCursor(ValueError):
    """The cursor is malformed, of another version, or belongs to another order."""


@dataclass(frozen=True)
class FeedInput:
    platforms: tuple = ()
    statuses: tuple = ()
    categories: tuple = ()
    locations: tuple = ()
    conditions: tuple = ()
    q: str | None = None
    min_price: int | None = None
    max_price: int | None = None
    sort: str = "newest"
    limit: int = 24
    cursor: str | None = None

    def filters(self) -> dict:
        return {
            "platforms": self.platforms, "statuses": self.statuses, "categories": self.categories,
            "locations": self.locations, "conditions": self.conditions, "q": self.q,
            "min_price": self.min_price, "max_price": self.max_price,
        }


# Bounds of the feed request.
ARRAY_BOUNDS = {"platforms": 4, "statuses": 3, "categories": 20, "locations": 10, "conditions": 10}
TEXT_BOUND = 80


def validate_feed_input(raw: dict | None = None) -> FeedInput:
    """Strict check of one request; unknown keys are errors."""
    raw = dict(raw or {})
    known = {*ARRAY_BOUNDS, "q", "minPrice", "maxPrice", "sort", "limit", "cursor", "direction"}
    if set(raw) - known:
        raise InvalidFeedInput(f"unknown keys: {sorted(set(raw) - known)}")
    clean: dict = {}
    for name, bound in ARRAY_BOUNDS.items():
        if name not in raw:
            continue
        values = raw[name]
        if not isinstance(values, (list, tuple)) or not 1 <= len(values) <= bound:
            raise InvalidFeedInput(f"{name} must hold 1 to {bound} values")
        if name in ("platforms", "statuses"):
            allowed = PLATFORMS if name == "platforms" else STATUSES
            if any(v not in allowed for v in values):
                raise InvalidFeedInput(f"{name} holds an unknown value")
        else:
            if any(not isinstance(v, str) for v in values):
                raise InvalidFeedInput(f"{name} must hold text")
            values = [v.strip() for v in values]
            if any(not 1 <= len(v) <= TEXT_BOUND for v in values):
                raise InvalidFeedInput(f"{name} values must have 1 to {TEXT_BOUND} characters")
        if len(set(values)) != len(values):
            raise InvalidFeedInput(f"{name} values must be unique")
        clean[name] = tuple(values)
    if "q" in raw:
        if not isinstance(raw["q"], str) or not 1 <= len(raw["q"].strip()) <= TEXT_BOUND:
            raise InvalidFeedInput("q must have 1 to 80 characters")
        clean["q"] = raw["q"].strip()
    for key, name in (("minPrice", "min_price"), ("maxPrice", "max_price")):
        if key in raw:
            if not _is_int(raw[key]) or not 0 <= raw[key] <= MAX_PRICE:
                raise InvalidFeedInput(f"{key} is out of range")
            clean[name] = int(raw[key])
    if clean.get("min_price", 0) > clean.get("max_price", MAX_PRICE):
        raise InvalidFeedInput("minPrice must not exceed maxPrice")
    if "sort" in raw:
        if raw["sort"] not in FEED_SORTS:
            raise InvalidFeedInput("unknown sort")
        clean["sort"] = raw["sort"]
    if "limit" in raw:
        if not _is_int(raw["limit"]) or not 1 <= raw["limit"] <= MAX_PAGE:
            raise InvalidFeedInput("limit must be 1 to 50")
        clean["limit"] = int(raw["limit"])
    if "cursor" in raw:
        if not isinstance(raw["cursor"], str) or not 1 <= len(raw["cursor"]) <= 512:
            raise InvalidFeedInput("cursor must have 1 to 512 characters")
        clean["cursor"] = raw["cursor"]
    if raw.get("direction", "forward") != "forward":
        raise InvalidFeedInput("direction must be forward")
    return FeedInput(**clean)


def _is_int(value) -> bool:
    return not isinstance(value, bool) and (isinstance(value, int) or (isinstance(value, float) and value.is_integer()))


def audit_feed_requests(requests: DataFrame) -> DataFrame:
    """P9 over logged requests: the broken bounds of each request, in a fixed order.

    Columns: platforms, statuses, categories, locations, conditions (arrays, null when absent), q, min_price,
    max_price, sort, limit, cursor.
    """
    errors = []
    for name, bound in ARRAY_BOUNDS.items():
        c = F.col(name)
        errors.append(F.when(~F.size(c).between(1, bound), F.lit(f"{name} size")))
        errors.append(F.when(F.size(F.array_distinct(F.transform(c, web_trim))) != F.size(c), F.lit(f"{name} unique")))
        if name in ("platforms", "statuses"):
            allowed = PLATFORMS if name == "platforms" else STATUSES
            errors.append(F.when(F.exists(c, lambda v: ~v.isin(*allowed)), F.lit(f"{name} value")))
        else:
            errors.append(F.when(F.exists(c, lambda v: ~F.length(web_trim(v)).between(1, TEXT_BOUND)),
                                 F.lit(f"{name} value")))
    errors += [
        F.when(~F.length(web_trim(F.col("q"))).between(1, TEXT_BOUND), F.lit("q")),
        F.when(~F.col("min_price").between(0, MAX_PRICE), F.lit("min_price")),
        F.when(~F.col("max_price").between(0, MAX_PRICE), F.lit("max_price")),
        F.when(F.col("min_price") > F.col("max_price"), F.lit("price range")),
        F.when(~F.col("sort").isin(*FEED_SORTS), F.lit("sort")),
        F.when(~F.col("limit").between(1, MAX_PAGE), F.lit("limit")),
        F.when(~F.length("cursor").between(1, 512), F.lit("cursor")),
    ]
    return requests.withColumn("errors", F.array_compact(F.array(*errors)))


MAX_WHOLE = (1 << 53) - 1  # largest whole number a double tells from its neighbours


def parse_feed_params(urls: DataFrame, column: str = "url") -> DataFrame:
    """P10: filters, order and search text of feed URLs; unsupported and repeated values are dropped."""
    query = F.regexp_extract(F.col(column), r"^[^?#]*\?([^#]*)", 1)
    decode = lambda t: F.coalesce(F.try_url_decode(t), t)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(
        decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), decode(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("v")))
    rows = computed(urls, _pairs=pairs)
    values = lambda key: F.transform(F.filter("_pairs", lambda p: p["k"] == key), lambda p: p["v"])
    first = lambda key: F.try_element_at(values(key), F.lit(1))

    def known(key, allowed):
        return F.array_distinct(F.filter(values(key), lambda v: v.isin(*allowed)))

    def free(key):
        texts = F.filter(F.transform(values(key), web_trim), lambda v: F.length(v).between(1, TEXT_BOUND))
        return F.slice(F.array_distinct(texts), 1, 10)

    def price(key):
        text = web_trim(first(key))
        decimal = F.when(text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), text.cast("double"))
        number = F.when(text.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(text, 3, 1 << 30), 16, 10).cast("double"))
        value = F.coalesce(decimal, number)
        return F.when((value == F.floor(value)) & value.between(0, MAX_WHOLE), value.cast("bigint"))

    search = F.left(web_trim(F.coalesce(first("q"), F.lit(""))), F.lit(TEXT_BOUND))
    return rows.select(
        *urls.columns, known("platform", PLATFORMS).alias("platforms"), known("status", STATUSES).alias("statuses"),
        free("location").alias("locations"), free("condition").alias("conditions"),
        price("minPrice").alias("min_price"), price("maxPrice").alias("max_price"),
        F.coalesce(F.when(first("sort").isin(*FEED_SORTS), first("sort")), F.lit("newest")).alias("sort"),
        F.nullif(search, F.lit("")).alias("q"),
    )


# Order -------------------------------------------------------------------------------------------------------------

def status_rank(sort: str) -> Column:
    status = F.col("status")
    if sort == "newest":
        return F.lit(0)
    if sort == "available-first":
        return F.when(status == "available", 0).when(status == "unknown", 1).otherwise(2)
    if sort == "sold-first":
        return F.when(status == "sold", 0).otherwise(1)
    return F.when(status == "sold", 1).otherwise(0)


def sort_value(sort: str) -> Column:
    if sort == "price-high":
        return F.coalesce("price", F.lit(NO_PRICE_HIGH))
    if sort == "price-low":
        return F.coalesce("price", F.lit(NO_PRICE_LOW))
    return F.lit(0)


def ranked(rows: DataFrame, sort: str = "newest") -> DataFrame:
    """Order columns of one of the five sorts. Times are cut to milliseconds, as cursors carry them."""
    if sort not in FEED_SORTS:
        raise InvalidFeedInput("unknown sort")
    return rows.select("*", status_rank(sort).alias("status_rank"), sort_value(sort).alias("sort_value"),
                       to_millis(effective_at()).alias("effective_at"))


def sort_order(sort: str) -> list[Column]:
    value = F.col("sort_value").asc() if sort == "price-low" else F.col("sort_value").desc()
    return [F.col("status_rank").asc(), value, F.col("effective_at").desc(), F.col("id").desc()]


@dataclass(frozen=True)
class Cursor:
    sort: str
    status_rank: int
    sort_value: int
    effective_at: dt.datetime
    id: str


def after_cursor(cursor: Cursor) -> Column:
    """O2: rows strictly behind the cursor in the mixed-direction order.

    The leading rank bound is implied by the rest; it is spelled out so that it can be used on its own by a scan.
    """
    rank, value, at = F.col("status_rank"), F.col("sort_value"), F.col("effective_at")
    at_limit = F.lit(cursor.effective_at.astimezone(dt.timezone.utc).replace(tzinfo=None)
                     if cursor.effective_at.tzinfo else cursor.effective_at).cast("timestamp_ntz")
    further = value > cursor.sort_value if cursor.sort == "price-low" else value < cursor.sort_value
    same_rank = rank == cursor.status_rank
    same_value = same_rank & (value == cursor.sort_value)
    return (rank >= cursor.status_rank) & (
        (rank > cursor.status_rank)
        | (same_rank & further)
        | (same_value & (at < at_limit))
        | (same_value & (at == at_limit) & (F.col("id") < cursor.id))
    )


def encode_cursor(cursor: Cursor) -> str:
    """O3: base64url without padding of the compact JSON form, version 3."""
    at = cursor.effective_at
    if at.tzinfo:
        at = at.astimezone(dt.timezone.utc).replace(tzinfo=None)
    body = {
        "v": 3, "s": cursor.sort, "r": cursor.status_rank, "k": cursor.sort_value,
        "t": at.isoformat(timespec="milliseconds") + "Z", "i": cursor.id,
    }
    text = json.dumps(body, ensure_ascii=False, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(text: str, sort: str | None = None) -> Cursor:
    """O3: strict inverse; anything out of bounds raises InvalidCursor."""
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,512}", text or ""):
        raise InvalidCursor("not base64url")
    try:
        body = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode())
        at = dt.datetime.fromisoformat(body["t"].replace("Z", "+00:00"))
    except (ValueError, KeyError, TypeError, AttributeError) as exc:
        raise InvalidCursor("unreadable") from exc
    whole = all(isinstance(body.get(k), int) and not isinstance(body.get(k), bool) for k in ("v", "r", "k"))
    if not (whole and body["v"] == 3 and body.get("s") in FEED_SORTS and 0 <= body["r"] <= 2 and at.tzinfo
            and isinstance(body.get("i"), str) and 1 <= len(body["i"]) <= 128):
        raise InvalidCursor("out of bounds")
    if sort is not None and body["s"] != sort:
        raise InvalidCursor("other order")
    return Cursor(body["s"], body["r"], body["k"], at.astimezone(dt.timezone.utc).replace(tzinfo=None), body["i"])


def cursor_column(sort: str) -> Column:
    """O3 as a column over ranked rows."""
    body = F.to_json(F.struct(
        F.lit(3).alias("v"), F.lit(sort).alias("s"), F.col("status_rank").alias("r"), F.col("sort_value").alias("k"),
        iso_millis(F.col("effective_at")).alias("t"), F.col("id").alias("i")))
    return F.rtrim(F.translate(F.base64(F.encode(body, "UTF-8")), "+/=\r\n", "-_"))


def decode_cursor_column(c: Column) -> Column:
    """O3 as a column: struct of the cursor fields, null when malformed."""
    padded = F.rpad(F.translate(c, "-_", "+/"), (F.ceil(F.length(c) / 4) * 4).cast("int"), F.lit("="))
    shaped = c.rlike("^[A-Za-z0-9_-]+$") & (F.length(c) <= 512)
    body = F.from_json(F.when(shaped, F.try_to_binary(padded, F.lit("base64")).cast("string")),
                       "v int, s string, r int, k bigint, t string, i string")

    def checked(b: Column) -> Column:
        ok = ((b["v"] == 3) & b["s"].isin(*FEED_SORTS) & b["r"].between(0, 2) & b["k"].isNotNull()
              & parse_iso(b["t"]).isNotNull() & F.length(b["i"]).between(1, 128))
        return F.when(ok, F.struct(b["s"].alias("sort"), b["r"].alias("status_rank"), b["k"].alias("sort_value"),
                                   parse_iso(b["t"]).alias("effective_at"), b["i"].alias("id")))

    return let(body, checked)


def feed_page(filtered: DataFrame, sort: str = "newest", limit: int = 24, cursor: Cursor | None = None) -> DataFrame:
    """O1/O2: keys of one page plus one more row, with their place. Only key columns are sorted."""
    if cursor is not None and cursor.sort != sort:
        raise InvalidCursor("other order")
    keys = ranked(filtered, sort).select("id", "status_rank", "sort_value", "effective_at")
    if cursor is not None:
        keys = keys.filter(after_cursor(cursor))
    return keys.orderBy(*sort_order(sort)).limit(limit + 1)


def read_page(page: DataFrame, listings: DataFrame, moderation: DataFrame | None = None) -> DataFrame:
    """Full rows of a page in page order; a key without a row is an error.

    The at most 51 keys pass through the driver, so the ranking behind them runs once, and they reach the wide scans
    as a pushed-down IN filter; nothing wide is shuffled.
    """
    keys = page.take(MAX_PAGE + 2)
    if len(keys) > MAX_PAGE + 1:
        raise ValueError("a page has at most 51 rows")
    ids = [k["id"] for k in keys]
    page = page.sparkSession.createDataFrame(keys, page.schema)
    rows = listings.filter(F.col("id").isin(ids))
    joined = page.join(rows, "id", "left")
    checked = joined.withColumn("source_url", F.when(
        F.col("source_url").isNull(), F.raise_error(F.lit("ranked listing disappeared before it was read"))
    ).otherwise(F.col("source_url")))
    if moderation is not None:
        marks = moderation.select(F.col("listing_id").alias("id"), "seller_name_override").filter(F.col("id").isin(ids))
        checked = checked.join(marks, "id", "left")
    return checked


@dataclass(frozen=True)
class Page:
    items: list = field(default_factory=list)
    next_cursor: str | None = None
    has_next_page: bool = False


def get_feed(visible: DataFrame, listings: DataFrame, images: DataFrame, moderation: DataFrame, request: FeedInput,
             **dto_options) -> Page:
    """One page as the service returns it. The driver sees at most 51 keys and 50 rows."""
    from lapak.operators.dto import to_listing_dto

    cursor = decode_cursor(request.cursor, request.sort) if request.cursor else None
    filtered = apply_feed_filters(visible, **request.filters())
    keys = feed_page(filtered, request.sort, request.limit, cursor).take(request.limit + 1)
    shown = keys[: request.limit]
    if not shown:
        return Page()
    spark = visible.sparkSession
    page = spark.createDataFrame([(r["id"], i) for i, r in enumerate(shown)], "id string, place int")
    # At most 50 keys, as a filter that reaches the wide scans.
    here = lambda df, key: df.filter(F.col(key).isin([r["id"] for r in shown]))
    dto = to_listing_dto(here(listings, "id"), here(images, "listing_id"), here(moderation, "listing_id"),
                         **dto_options)
    items = F.broadcast(page).join(dto, "id", "left").orderBy("place").drop("place").take(request.limit)
    if any(item["source_url"] is None for item in items):
        raise RuntimeError("ranked listing disappeared before it was read")
    more = len(keys) > request.limit
    last = shown[-1]
    token = encode_cursor(Cursor(request.sort, last["status_rank"], last["sort_value"], last["effective_at"],
                                 last["id"])) if more else None
    return Page(items, token, more)


def assign_pages(filtered: DataFrame, sort: str = "newest", limit: int = 24) -> DataFrame:
    """Rank and page number of every row of one order, from one distributed sort."""
    keys = ranked(filtered, sort).select("id", "status_rank", "sort_value", "effective_at")
    return assign_rank(keys, sort_order(sort), "rank").withColumn("page", F.floor(F.col("rank") / limit))
