"""Text cleaning, keyword and label rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Characters that count as white space when a rule strips or collapses "any white space".
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WEB_SPACES = "".join(c for c in SPACES if c not in "\x1c\x1d\x1e\x1f\x85") + "\ufeff"
SPACE_CLASS = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
LINE_BREAK = r"[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# Words that mark a listing as sold.
SOLD_WORDS = ("sold\\s*out", "soldout", "sold", "terjual", "laku", "booked")
SOLD_LABELS = ("habis", "sold", "sold out", "terjual")

# Short keywords that only match as whole words.
WHOLE_WORD_KEYWORDS = (
    "pc", "gpu", "vga", "rtx", "gtx", "ram", "ssd", "hdd", "psu", "oppo", "vivo", "redmi", "realme",
)
# Default keyword lists of the relevance filter.
POSITIVE_KEYWORDS = (
    "vga", "gpu", "rtx", "gtx", "radeon", "geforce", "nvidia", "amd", "rx 580", "rx580", "pc", "komputer", "laptop",
    "monitor", "keyboard", "mouse", "gaming", "ram", "ssd", "hdd", "processor", "prosesor", "intel", "ryzen", "core i",
    "motherboard", "mainboard", "psu", "playstation", "ps4", "ps5", "xbox", "nintendo", "steam deck",
)
BLOCKED_KEYWORDS = (
    "yamaha", "vega r", "vega zr", "motor vega", "kampas rem", "sparepart motor", "iphone", "ipad", "oppo", "vivo",
    "xiaomi", "redmi", "realme", "samsung galaxy", "android", "indihome", "wifi murah", "paket wifi", "mesin cuci",
    "kulkas", "lemari es", "smart tv", "tv led", "cctv", "kamera", "printer", "ac split", "remote tv", "kabel vga",
    "converter vga", "hdmi to vga",
)
# Phrases of a login wall.
LOGIN_PHRASES = (
    "masuk ke facebook", "log in to facebook", "email atau nomor telepon", "kata sandi", "create new account",
    "buat akun baru",
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def web_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WEB_SPACES))


def blank_to_null(c: Column) -> Column:
    """stripped text, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(or_blank(c), f"{SPACE_CLASS}+", " "))


def normalize_name(c: Column) -> Column:
    """F1 for sellers and content: case and white space do not count. Null stays null."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


normalize_seller_name = normalize_name
normalize_listing_content = normalize_name

SQL_FUNCTIONS = {
    "normalize_seller_name": r"lower(trim(regexp_replace(x, '\\s+', ' ')))",
    "normalize_listing_content": r"lower(trim(regexp_replace(x, '\\s+', ' ')))",
}


def register_sql_functions(spark) -> None:
    """H3: the two normalizers as SQL functions that Catalyst inlines."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")


def clean_text(c: Column) -> Column:
    """no-break spaces, blank runs and long gaps between paragraphs."""
    spaced = F.regexp_replace(F.translate(or_blank(c), "\xa0", " "), r"[ \t]+", " ")
    return strip(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))


def lines(c: Column) -> Column:
    """Stripped non-blank lines."""
    return F.filter(F.transform(F.split(c, LINE_BREAK), strip), lambda x: x != "")


def compact_lines(c: Column) -> Column:
    return lines(clean_text(c))


def trim_value(c: Column) -> Column:
    return F.btrim(normalize_spaces(c), F.lit(" :;,.|-"))


def slugify(c: Column, fallback: str = "marketplace") -> Column:
    """F27."""
    slug = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", F.lit(fallback)).otherwise(slug)


def seller_name_clean(c: Column) -> Column:
    """F45."""
    return blank_to_null(F.left(normalize_spaces(F.replace(c, F.lit("\x00"), F.lit(""))), F.lit(160)))


def is_low_value_title(c: Column) -> Column:
    return ~or_blank(c).rlike("[A-Za-z0-9]")


def title_from_alt(alt: Column) -> Column:
    spaced = normalize_spaces(alt)
    return F.when(spaced.contains(" di "), trim_value(F.regexp_extract(spaced, r"^(.*) di ", 1))).otherwise(spaced)


def listing_title(title: Column, alt: Column) -> Column:
    """a title without letters or digits gives way to the image text."""
    fallback = F.coalesce(
        F.nullif(title_from_alt(alt), F.lit("")), F.nullif(alt, F.lit("")), F.lit("Facebook Marketplace listing")
    )
    return F.when(is_low_value_title(title), fallback).otherwise(title)


def has_top_sold_marker(description: Column) -> Column:
    """a sold word in the first five non-blank lines."""
    top = F.array_join(F.slice(lines(or_blank(description)), 1, 5), "\n")
    return top.rlike(r"(?iU)\b(" + "|".join(SOLD_WORDS) + r")\b")


def keyword_matches(text: Column, keyword: str) -> Column:
    """short keywords need word boundaries, others are plain substrings."""
    word = keyword.lower().strip()
    if not word:
        return F.lit(False)
    if word in WHOLE_WORD_KEYWORDS:
        return F.lower(text).rlike(rf"(?U)\b{re.escape(word)}\b")
    return F.lower(text).contains(word)


def matched_keywords(text: Column, keywords) -> Column:
    """The keywords found in the text, in list order. The text is lowered once."""
    hits = [F.when(keyword_matches(text, k), F.lit(k)) for k in keywords]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def looks_login_blocked(text: Column) -> Column:
    """text of a login page."""
    return F.lower(or_blank(text)).rlike("|".join(LOGIN_PHRASES))


def looks_login_wall(url: Column, text: Column) -> Column:
    flat = normalize_spaces(F.lower(or_blank(text)))
    return F.lower(or_blank(url)).rlike("/login|/checkpoint") | flat.rlike("log in to facebook|masuk ke facebook")


def unique_values(values: Column, limit: int = 8) -> Column:
    """Trimmed values, first spelling wins whatever the case, at most ``limit``."""
    cleaned = F.filter(F.transform(values, trim_value), lambda x: x != "")
    return F.slice(distinct_ignoring_case(cleaned), 1, limit)


def distinct_ignoring_case(values: Column) -> Column:
    """Ordered distinct by lower case: keep an item when no earlier item equals it."""
    lowered = F.transform(values, F.lower)
    return F.filter(values, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def unique_prefix(values: Column, limit: int) -> Column:
    """ordered distinct non-blank prefix."""
    return F.slice(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))), 1, limit)


def is_missing(c: Column, kind: str = "text") -> Column:
    """null, empty text or empty array."""
    if kind == "array":
        return c.isNull() | (F.size(c) == 0)
    if kind == "text":
        return c.isNull() | (c == "")
    return c.isNull()


def lenient_integer(c: Column) -> Column:
    """integer text (optional sign, outer blanks) or null; 'true'/'false' are not integers."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def lenient_boolean(c: Column) -> Column:
    """only real booleans survive."""
    return F.when(c.isin("true", "false"), c == "true")


def sanitize_facet_text(c: Column, limit: int) -> Column:
    """F12."""
    text = web_trim(c)
    return F.when((text != "") & (F.length(text) <= limit) & ~text.rlike(r"[\r\n]"), text)


def sanitize_public_location(c: Column) -> Column:
    """drop contact data, links and oversized or multi-line text."""
    text = web_trim(c)
    unsafe = text.rlike(r"[\r\n]") | text.rlike(r"(?i)https?://|www\.|@") | text.rlike(r"[0-9]{6,}")
    return F.when((text != "") & (F.length(text) <= 80) & ~unsafe, text)


# Words that show a "location" is really sales talk.
_NOT_A_PLACE = (
    "harga", "price", "link", "oren", "cod", "ongkir", "kirim", "ready", "stok", "stock", "bekas", "second", "nego",
    "wa", "dm",
)
PLAUSIBLE_CONDITION = (
    r"(?i)^(?:Baru(?:\s*/\s*BNIB)?|BNIB|Like New|Second|Bekas(?:\s*-\s*(?:baik|normal|minus))?)$"
)


def plausible_location(c: Column) -> Column:
    """P18 for places."""
    unlike = c.rlike(r"(?i)[0-9]|%|https?:|www\.|@") | c.rlike(r"(?i)\b(?:" + "|".join(_NOT_A_PLACE) + r")\b")
    return (F.length(c) <= 48) & ~unlike


def plausible_condition(c: Column) -> Column:
    """P18 for conditions."""
    return (F.length(c) <= 32) & c.rlike(PLAUSIBLE_CONDITION)


def escape_like(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def model_json(content: Column) -> Column:
    """the JSON object inside a model answer as text, null when there is none.

    A fenced answer loses its fence; text that still does not parse is cut to its outermost braces.
    """
    text = strip(or_blank(content))
    body = F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1)).otherwise(text)
    unfenced = strip(F.regexp_replace(body, r"(?s)```(?!.*```).*$", ""))
    candidate = F.when(text.startswith("```"), unfenced).otherwise(text)
    braces = F.regexp_extract(candidate, r"(?s)\{.*\}", 0)
    whole = F.when(F.try_parse_json(candidate).isNotNull(), candidate)
    cut = F.when((braces != "") & F.try_parse_json(braces).isNotNull(), braces)
    chosen = F.coalesce(whole, cut)
    return F.when(F.schema_of_variant(F.try_parse_json(chosen)).startswith("OBJECT"), chosen)
