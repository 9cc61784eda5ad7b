"""URL canonical forms, safety checks, redaction and builders."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, functions as F

from lapak.functions.once import let
from lapak.functions.text import or_blank, strip

# Query keys whose values are secrets, and words that mark a secret field.
SENSITIVE_QUERY_KEYS = (
    "access_token", "api_key", "apikey", "key", "password", "passphrase", "pwd", "secret", "sslpassword", "token",
)
SENSITIVE_FIELD_WORDS = ("password", "secret", "token", "apikey", "api_key")
DATABASE_URL_FIELDS = ("databaseurl", "database_url", "scraperdatabaseurl", "scraper_database_url")

# Hosts of the platforms and of their image servers.
REDDIT_HOSTS = ("reddit.com", "www.reddit.com", "old.reddit.com", "redd.it", "www.redd.it")
MARKETPLACE_HOSTS = ("facebook.com", "www.facebook.com", "m.facebook.com")
GROUP_HOSTS = ("facebook.com", "www.facebook.com")
REDDIT_MEDIA_HOSTS = ("i.redd.it", "preview.redd.it", "external-preview.redd.it")
INSTAGRAM_MEDIA_DOMAINS = ("cdninstagram.com", "fbcdn.net")
FACEBOOK_MEDIA_DOMAINS = ("fbcdn.net",)

DEFAULT_MEDIA_ORIGIN = "https://media.example.com"
MEDIA_FOLDERS = (
    ("instagram", "instagram"), ("reddit", "reddit"), ("facebook_group", "facebook-groups"), ("facebook", "facebook"),
)

_SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


# Names that HTML reads without a semicolon, longest first; only they may be followed by more letters.
_BARE_NAMES = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_NAME = r"^[^\t\n\f <&#;]{1,32}"
_NUMBER = r"^#(?:[xX]([0-9a-fA-F]+)|([0-9]+))"


def html_unescape(text: Column, closed: bool = False) -> Column:
    """Text with named and numeric HTML references replaced, by the rules of HTML 5.

    The table of names is a constant of the plan. What is no reference stays as it is. With ``closed`` only what ends in
    a semicolon is a reference; HTML 5 also reads some names and all numbers without one.
    """
    end = ";" if closed else ";?"
    names = F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string, string>")
    windows = F.from_json(F.lit(json.dumps({str(n): bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n))
                                            for n in range(0x80, 0xA0)})), "map<string, string>")
    behind = lambda piece, part: F.substr(piece, F.length(part) + 1)

    def sign(piece: Column) -> Column:
        digits = F.regexp_replace(F.concat(F.regexp_extract(piece, _NUMBER + end, 1), F.regexp_extract(piece, _NUMBER + end, 2)), "^0+(?=.)", "")
        base = F.when(F.regexp_extract(piece, _NUMBER + end, 1) != "", F.conv(digits, 16, 10)).otherwise(digits)
        number = F.when(F.length(digits) <= 7, base.try_cast("int")).otherwise(F.lit(0x110000))
        return let(number, lambda n: F.when(
            (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd")).when(
            n.between(0x80, 0x9F), F.try_element_at(windows, n.cast("string"))).when(
            n.between(1, 8) | n.isin(11, 127) | n.between(14, 31) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE),
            F.lit("")).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))

    def read(piece: Column) -> Column:
        number, name = (F.regexp_extract(piece, p + end, 0) for p in (_NUMBER, _NAME))
        bare = F.lit("") if closed else F.regexp_extract(piece, f"^(?:{_BARE_NAMES})", 0)
        # A look into the table passes over all its names, so only what may be one gets that far.
        whole = F.when(name.rlike("^[A-Za-z0-9]+;?$"), F.try_element_at(names, name))
        # The four names that make up nearly all references need no table.
        usual = F.when(F.lit(False), F.lit(""))
        for word, char in (("amp;", "&"), ("lt;", "<"), ("gt;", ">"), ("quot;", '"')):
            usual = usual.when(piece.startswith(word), F.concat(F.lit(char), F.substr(piece, F.lit(len(word) + 1))))
        return (usual.when(number != "", F.concat(sign(piece), behind(piece, number)))
                .when(whole.isNotNull(), F.concat(whole, behind(piece, name)))
                .when(bare != "", F.concat(F.try_element_at(names, bare), behind(piece, bare)))
                .otherwise(F.concat(F.lit("&"), piece)))

    def decoded(whole: Column) -> Column:
        every = let(F.split(whole, "&"), lambda p: F.concat(
            F.get(p, 0), F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), read), "")))
        return F.when(F.contains(whole, F.lit("&")), every).otherwise(whole)

    return let(text, decoded)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 2)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 3)


def url_host(url: Column) -> Column:
    """Host name without credentials and port, lower case."""
    return F.lower(F.regexp_extract(url_netloc(url), r"^(?:.*@)?([^:@]*)(?::[^@]*)?$", 1))


def has_credentials(url: Column) -> Column:
    """A non-empty user name or password in the authority part."""
    return url_netloc(url).rlike(r"^[^@]*[^@:][^@]*@") | url_netloc(url).rlike(r"@.*@")


def canonical_url(url: Column) -> Column:
    """lower scheme and host, keep the path, drop query and fragment; relative URLs lose only the tail."""
    raw = strip(or_blank(url))
    full = F.concat(url_scheme(raw), F.lit("://"), F.lower(url_netloc(raw)), url_path(raw))
    return F.when(url_netloc(raw) != "", full).otherwise(F.regexp_replace(raw, r"(?s)[?#].*$", ""))


def reddit_url(url: Column) -> Column:
    """post URL on a known host, always with a closing slash; else empty."""
    raw = strip(or_blank(url))
    known = url_scheme(raw).isin("http", "https") & url_host(raw).isin(*REDDIT_HOSTS)
    path = url_path(raw)
    closed = F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    return F.when(known, F.concat(url_scheme(raw), F.lit("://"), url_netloc(raw), closed)).otherwise(F.lit(""))


def reddit_id(url: Column, atom_id: Column | None = None) -> Column:
    """post id from the URL, else the tail of the feed id."""
    from_url = F.nullif(F.regexp_extract(or_blank(url), r"(?i)/comments/([a-z0-9]+)/", 1), F.lit(""))
    if atom_id is None:
        return from_url
    tail = F.nullif(F.regexp_extract(or_blank(atom_id), r"(?i)(?:t3_)?([a-z0-9]+)$", 1), F.lit(""))
    return F.coalesce(from_url, tail)


# An HTTPS URL with a host and no user name or password; and a URL on the board's own image servers.
_PLAIN_HTTPS = r"(?i)^https://:?@?[^/?#@:]+(?::[^/?#@]*)?(?:[/?#]|$)"
_OWN_IMAGE = r"(?is)^https://:?@?(?:preview|i)\.redd\.it\.*(?::[^/?#]*)?(?=[/?#]|$)([^?#]*).*$"


def reddit_image_url(url: Column, unescaped: bool = False) -> Column:
    """previews become the original image; anything but a credential-free HTTPS URL becomes empty.

    ``unescaped`` says that HTML entities were already resolved, which keeps the expression on the JVM.
    """
    return _original_image(_without_tail(or_blank(url if unescaped else html_unescape(url))))


def _without_tail(url: Column) -> Column:
    return F.regexp_replace(url, r"[).,\]]+$", "")


def _original_image(url: Column) -> Column:
    return F.when(url.rlike(_PLAIN_HTTPS), F.regexp_replace(url, _OWN_IMAGE, r"https://i.redd.it$1")).otherwise(F.lit(""))


def is_reddit_image(url: Column) -> Column:
    low = F.lower(url)
    return low.contains("i.redd.it/") | low.contains("preview.redd.it/") | low.rlike(r"\.(?:jpg|jpeg|png|webp)(?:\?|$)")


def unique_image_urls(urls: Column) -> Column:
    """canonical image URLs in first-seen order. Entities must be resolved already."""
    canonical = F.transform(F.transform(urls, lambda u: _without_tail(or_blank(u))), _original_image)
    return F.array_distinct(F.filter(canonical, lambda u: (u != "") & is_reddit_image(u)))


def marketplace_url(item_id: Column, url: Column) -> Column:
    """from a numeric id, else from a known item path; else empty."""
    raw = or_blank(url)
    known = (
        url_scheme(raw).isin("http", "https")
        & url_host(raw).isin(*MARKETPLACE_HOSTS)
        & url_path(raw).rlike(r"^/marketplace/item/[0-9]+/?$")
    )
    return (
        F.when(or_blank(item_id).rlike("^[0-9]+$"),
               F.concat(F.lit("https://www.facebook.com/marketplace/item/"), item_id, F.lit("/")))
        .when(known, F.concat(F.lit("https://www.facebook.com"), url_path(raw)))
        .otherwise(F.lit(""))
    )


def group_permalink(url: Column) -> Column:
    """canonical group post URL; else empty."""
    raw = or_blank(url)
    known = (url_scheme(raw) == "https") & url_host(raw).isin(*GROUP_HOSTS)
    path = F.regexp_replace(url_path(raw), "/+$", "")
    return F.when(known, F.concat(F.lit("https://www.facebook.com"), path, F.lit("/"))).otherwise(F.lit(""))


def group_permalink_fallback(group_url: Column, post_id: Column) -> Column:
    route = F.regexp_replace(F.btrim(url_path(group_url), F.lit("/")), "^[^/]*/", "")
    return F.concat(F.lit("https://www.facebook.com/groups/"), route, F.lit("/posts/"), post_id, F.lit("/"))


def is_safe_https_url(url: Column) -> Column:
    """absolute HTTPS URL with a host and without credentials."""
    return F.btrim(or_blank(url)).rlike(r"(?i)^https://(?::?@)?[^\s@:<>^|%\\/?#]+(?::[0-9]*)?(?:[/?#]|$)")


def is_safe_cached_media_url(url: Column, platform: Column, origin: str = DEFAULT_MEDIA_ORIGIN,
                             prefix: str = "production") -> Column:
    """cached media must lie below the folder of its own platform on the media origin.

    Plain prefix tests; only the check for dot segments needs a pattern.
    """
    folder = F.lit(None).cast("string")
    for name, path in MEDIA_FOLDERS:
        folder = F.when(platform == name, F.lit(f"/{prefix}/{path}/")).otherwise(folder)
    raw = F.btrim(or_blank(url))
    same_origin = F.lower(F.left(raw, F.lit(len(origin)))) == origin.lower()
    inside = F.substring(raw, len(origin) + 1, 2**31 - 1).startswith(folder)
    return F.coalesce(same_origin & inside & ~raw.rlike(r"(?i)^[^?#]*/(?:\.|%2e){1,2}(?:[/?#]|$)"), F.lit(False))


def allowed_media_host(url: Column, platform: Column) -> Column:
    """HTTPS, no credentials, and a host on the list of the platform."""
    host = F.regexp_replace(url_host(or_blank(url)), r"\.+$", "")

    def below(domains):
        test = F.lit(False)
        for domain in domains:
            test = test | (host == domain) | host.endswith("." + domain)
        return test

    listed = (
        F.when(platform == "instagram", below(INSTAGRAM_MEDIA_DOMAINS))
        .when(platform.isin("facebook", "facebook_group"), below(FACEBOOK_MEDIA_DOMAINS))
        .when(platform == "reddit", host.isin(*REDDIT_MEDIA_HOSTS))
        .otherwise(F.lit(False))
    )
    secure = (url_scheme(or_blank(url)) == "https") & (host != "") & ~has_credentials(or_blank(url))
    return secure & listed


def quote_plus(c: Column) -> Column:
    """Form encoding: blanks become plus signs."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def quote_path(c: Column) -> Column:
    """Path encoding: blanks become %20."""
    return F.replace(quote_plus(c), F.lit("+"), F.lit("%20"))


def unquote_plus(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def redact_url(url: Column) -> Column:
    """hide the password, sensitive query values and the fragment; an innocent URL stays byte for byte."""
    raw = url
    base = F.regexp_extract(raw, r"^([^?#]*)", 1)
    query = F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(raw, r"^[^#]*#(?s:(.*))$", 1)
    netloc = url_netloc(raw)
    userinfo = F.regexp_extract(netloc, r"^(.*)@", 1)
    has_password = netloc.rlike("^[^@]*:.*@")

    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: unquote_plus(F.regexp_extract(p, "^([^=]*)", 1))
    value = lambda p: unquote_plus(F.regexp_extract(p, "^[^=]*=(?s:(.*))$", 1))
    secret = lambda p: F.lower(name(p)).isin(*SENSITIVE_QUERY_KEYS)
    hidden = F.array_join(
        F.transform(pairs, lambda p: F.concat(
            quote_plus(name(p)), F.lit("="), F.when(secret(p), F.lit("%2A%2A%2A")).otherwise(quote_plus(value(p))))),
        "&",
    )
    has_secret = F.exists(pairs, secret)
    new_query = F.when(has_secret, hidden).otherwise(query)

    user = F.regexp_extract(userinfo, "^([^:]*)", 1)
    host = F.lower(F.regexp_extract(netloc, r"@([^@:]*|\[[^\]]*\])(?::[0-9]*)?$", 1))
    port = F.regexp_extract(netloc, r"@[^@]*(:[0-9]+)$", 1)
    safe_netloc = F.concat(F.when(user != "", F.concat(user, F.lit(":***@"))).otherwise(F.lit("")), host, port)
    new_base = F.when(has_password, F.concat(url_scheme(raw), F.lit("://"), safe_netloc, url_path(raw))).otherwise(base)

    touched = has_password | has_secret | (fragment != "")
    rebuilt = F.concat(
        new_base,
        F.when(new_query != "", F.concat(F.lit("?"), new_query)).otherwise(F.lit("")),
        F.when(fragment != "", F.lit("#***")).otherwise(F.lit("")),
    )
    return F.when(touched, rebuilt).otherwise(raw)


def storage_key(platform: Column, content_hash: Column, extension: Column, prefix: str = "production") -> Column:
    """content-addressed object key."""
    folder = F.when(platform == "facebook_group", F.lit("facebook-groups")).otherwise(platform)
    return F.concat_ws("/", F.lit(prefix), folder, F.left(content_hash, F.lit(2)),
                       F.concat(content_hash, F.lit("."), extension))


def public_media_url(key: Column, origin: str = DEFAULT_MEDIA_ORIGIN) -> Column:
    return F.concat(F.lit(origin + "/"), F.array_join(F.transform(F.split(key, "/"), quote_path), "/"))


# URL builders -------------------------------------------------------------------------------------------------

def query_string(*pairs) -> Column:
    """name/value pairs -> encoded query string; null or blank values are left out."""
    parts = [
        F.when(value.isNotNull() & (value.cast("string") != ""),
               F.concat(F.lit(name + "="), quote_plus(value.cast("string"))))
        for name, value in pairs
    ]
    return F.concat_ws("&", *parts)


def repeated_parameter(name: str, values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit(name + "="), quote_plus(v))), "&")


def feed_query(platforms, statuses, locations, conditions, min_price, max_price, sort) -> Column:
    """Feed URL parameters from filters; the default order is not written."""
    parts = [
        repeated_parameter("platform", platforms), repeated_parameter("status", statuses),
        repeated_parameter("location", locations), repeated_parameter("condition", conditions),
        query_string(("minPrice", min_price), ("maxPrice", max_price),
                     ("sort", F.when(sort != "newest", sort))),
    ]
    return F.concat_ws("&", *[F.nullif(p, F.lit("")) for p in parts])


def marketplace_search_url(location, sort_by, query, category_id, exact, category_slug, optional=()) -> Column:
    """Search URL of a source target; a category page carries no search words."""
    by_category = or_blank(category_slug) != ""
    words = F.concat_ws(
        "&", F.concat(F.lit("query="), quote_plus(or_blank(query))),
        F.concat(F.lit("category_id="), quote_plus(or_blank(category_id))),
        F.concat(F.lit("exact="), F.when(exact, F.lit("true")).otherwise(F.lit("false"))),
    )
    tail = F.nullif(query_string(*optional), F.lit("")) if optional else F.lit(None).cast("string")
    params = F.concat_ws("&", F.concat(F.lit("sortBy="), quote_plus(sort_by)), F.when(~by_category, words), tail)
    home = F.concat(F.lit("https://www.facebook.com/marketplace/"), location)
    return F.when(by_category, F.concat(home, F.lit("/"), category_slug, F.lit("/?"), params)) \
        .otherwise(F.concat(home, F.lit("/search?"), params))


def post_feed_url(url: Column) -> Column:
    """Feed of one post; empty when the URL is not a post."""
    canonical = reddit_url(url)
    path = url_path(canonical)
    return F.when(path.contains("/comments/"), F.concat(F.lit("https://www.reddit.com"), path, F.lit(".rss"))) \
        .otherwise(F.lit(""))


def search_feed_url(board: Column, flair: Column, limit: Column) -> Column:
    """Newest posts of a board with one flair."""
    words = F.concat(F.lit('flair:"'), flair, F.lit('"'))
    return F.concat(
        F.lit("https://www.reddit.com/r/"), board, F.lit("/search.rss?"),
        query_string(("q", words), ("restrict_sr", F.lit("1")), ("sort", F.lit("new")), ("limit", limit)))
