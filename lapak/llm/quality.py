"""Quality rules: base counts of a document, then how far its histograms lie from those of its language.

The reference of a language is summed over all its documents that pass the base rules. A document is compared by the
Jensen-Shannon distance (base 2, 0 to 1) of its character classes and of its common words; short documents, whose
histograms say little, are not compared. Characters are many more than words: with ``short`` every document that passes
the base rules is compared by them, and the guard holds for words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapak.functions.once import computed, let
from lapak.llm.batches import written
from lapak.llm.registry import query, table

# Frequent function words per language.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem",
           "nicht", "ein", "eine", "als"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "for", "are", "with", "as", "be", "by", "at",
           "this", "from", "or"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su",
           "para", "es", "al"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par",
           "plus", "pas", "au"),
}
WIDTH = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
GUARD_WORDS = 100
GUARD_CHARS = 500
MAX_CHAR_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.31
SPACE = r"[\x20\x09-\x0D]"


def _only(text: Column, kept: str) -> Column:
    """Number of characters of a class."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def features(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Base counts and histograms of each document; everything stays inside its row. ``whole`` adds the row as _doc.

    A window of eight words is known by a 64-bit hash; positions are compared only in documents where a hash repeats.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    given = [F.struct(*docs.columns).alias("_doc")] if whole else []
    rows = computed(docs.select("doc_id", "lang", text.alias("_text"), *given),
                    _words=F.array_remove(F.split("_text", f"{SPACE}+"), ""),
                    _lines=F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    windows = F.transform(F.sequence(F.lit(1), F.size("_words") - WIDTH + 1),
                          lambda i: F.xxhash64(F.slice("_words", i, F.lit(WIDTH))))
    known = sorted({w for words in COMMON_WORDS.values() for w in words})
    rows = computed(
        rows, n_words=F.size("_words").cast("long"), word_chars=F.length(F.array_join("_words", "")).cast("long"),
        n_chars=F.length("_text").cast("long"), n_symbols=F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        _upper=_only(F.col("_text"), "A-Z").cast("long"), _digit=_only(F.col("_text"), "0-9").cast("long"),
        _mark=_only(F.col("_text"), r".,;:!?'\"()\-").cast("long"),
        _other=_only(F.col("_text"), r"\x{80}-\x{10FFFF}").cast("long"),
        _common=F.filter("_words", lambda w: w.isin(known)),
        _hashes=F.when(F.size("_words") >= WIDTH, windows).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    rows = computed(rows, _sorted=F.when(again, F.sort_array(
        F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_sorted", lambda x, i: F.coalesce(F.get("_sorted", i - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False)))
    rows = computed(rows, _at=F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(WIDTH), F.coalesce(F.get("_at", i + 1) - p, F.lit(WIDTH)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    space = F.col("n_chars") - F.col("word_chars")
    named = F.col("_upper") + F.col("_digit") + F.col("_mark") + F.col("_other") + F.col("n_symbols") + space
    hits = F.lit(None).cast("array<bigint>")
    for lang, words in COMMON_WORDS.items():
        counts = F.transform(F.array(*map(F.lit, words)), lambda c: F.size(
            F.filter("_common", lambda w: w == c)).cast("long"))
        hits = F.when(F.col("lang") == lang, counts).otherwise(hits)
    rows = computed(rows, n_repeat_words=F.coalesce(covered, F.lit(0).cast("long")), _hits=hits)
    return rows.select(
        *(["_doc"] if whole else []), "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "n_chars", F.array(F.col("n_chars") - named, "_upper", "_digit", "_mark", "_other", "n_symbols", space).alias("chars"),
        F.concat("_hits", F.array(F.col("n_words") - F.aggregate("_hits", F.lit(0).cast("long"), lambda a, x: a + x))
                 ).alias("words"))


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of whole numbers; null if either is empty or null."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    share = lambda a: let(total(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    terms = F.zip_with(share(counts), share(reference), lambda p, q: let(
        (p + q) / 2, lambda m: (part(p, m) + part(q, m)) / 2))
    total_of = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return let(total_of, lambda s: F.sqrt(F.when(s < 0, 0.0).otherwise(s)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _judged(docs: DataFrame, whole: bool, short: bool = False) -> DataFrame:
    found = written(features(docs, whole).withColumn("base_failed", base_failed()), "quality")
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(7)]
    sums += [F.sum(F.get("words", F.lit(i))).alias(f"w{i}") for i in range(max(map(len, COMMON_WORDS.values())) + 1)]
    good = found.filter(F.col("lang").isin(*COMMON_WORDS) & ~F.col("base_failed"))
    wide = good.groupBy("lang").agg(*sums)
    reference = wide.select(
        F.col("lang").alias("_lang"), F.array(*[f"c{i}" for i in range(7)]).alias("_chars"),
        F.filter(F.array(*[c for c in wide.columns if c[0] == "w"]), lambda x: x.isNotNull()).alias("_words"))
    # At most one row per language of COMMON_WORDS.
    rows = found.join(F.broadcast(reference), F.col("lang") == F.col("_lang"), "left")
    long_enough = (F.col("n_words") >= GUARD_WORDS) & (F.col("n_chars") >= GUARD_CHARS)
    on_chars = ~F.col("base_failed") | long_enough if short else long_enough
    rows = rows.withColumns({
        "char_distance": F.round(F.when(on_chars, js_distance(F.col("chars"), F.col("_chars"))), 6),
        "word_distance": F.round(F.when(long_enough, js_distance(F.col("words"), F.col("_words"))), 6)})
    far = (F.coalesce(F.col("char_distance") > MAX_CHAR_DISTANCE, F.lit(False))
           | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False)))
    return rows.withColumn("kept", ~F.col("base_failed") & ~far)


def judge(docs: DataFrame, short: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_distance, word_distance (six decimals; null where not compared).

    Every text that passes the base rules is compared on its characters; on words only from 100 words and 500 characters
    on, as shorter prose strays too far. ``short=False`` asks for that length on both. A null text has no words and fails
    the base rules. A document of a language without reference is judged by the base
    rules alone. Repeated rows are judged each by itself; an empty table gives no rows.
    """
    return _judged(docs, False, short).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "char_distance", "word_distance")


def keep_good(docs: DataFrame, short: bool = True) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns."""
    return _judged(docs, True, short).filter("kept").select("_doc.*")


def _sql(short: bool = False) -> str:
    """The same rules in SQL, histograms as rows."""
    words = ", ".join(f"('{lang}', {i + 1}, '{w}')" for lang, every in COMMON_WORDS.items() for i, w in enumerate(every))
    guard = f"n_words >= {GUARD_WORDS} AND n_chars >= {GUARD_CHARS}"
    on_chars = f"NOT base_failed OR {guard}" if short else guard
    space, only = r"[\x20\t\n\x0B\x0C\r]", lambda kept: f"length(regexp_replace(text, '[^{kept}]', '', 'g'))"
    return rf"""
WITH common(lang, bin, w) AS (VALUES {words}), doc AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS ws
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WIDTH - 1}], ' ') AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS i FROM doc)
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM win),
    range({WIDTH}) AS r(d) WHERE c > 1 GROUP BY doc_id
), line AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM doc)
  WHERE regexp_matches(line, '[^\x20\t\n\x0B\x0C\r]') GROUP BY doc_id
), base AS (
  SELECT d.doc_id, lang, text, ws, length(text) AS n_chars, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    {only('#*$%&|<>')} AS n_symbols, coalesce(line.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    len(ws) < {MIN_WORDS} OR 100 * coalesce(covered.n, 0) > {MAX_REPEAT_PERCENT} * len(ws) AS base_failed
  FROM doc d LEFT JOIN covered USING (doc_id) LEFT JOIN line USING (doc_id)
), split AS (
  SELECT *, n_chars - word_chars AS space, {only('A-Z')} AS upper, {only('0-9')} AS digit,
    {only(".,;:!?''" + '"' + "()-")} AS mark, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS other FROM base
), hist AS (
  SELECT doc_id, lang, base_failed, 'c' AS kind, bin, c FROM (SELECT *, unnest(range(7)) AS bin, unnest([
    n_chars - (upper + digit + mark + other + n_symbols + space), upper, digit, mark, other, n_symbols, space]) AS c FROM split)
  UNION ALL SELECT doc_id, lang, base_failed, 'w', bin, coalesce(c, 0) FROM (SELECT * FROM base JOIN common USING (lang))
    LEFT JOIN (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS w FROM doc) GROUP BY 1, 2) USING (doc_id, w)
  UNION ALL SELECT doc_id, lang, base_failed, 'w', 0, n_words - coalesce(c, 0) FROM base LEFT JOIN (
    SELECT doc_id, count(*) AS c FROM (SELECT doc_id, lang, unnest(ws) AS w FROM doc) JOIN common USING (lang, w) GROUP BY 1)
    USING (doc_id) WHERE lang IN (SELECT lang FROM common)
), reference AS (
  SELECT lang, kind, bin, sum(c) AS r FROM hist WHERE NOT base_failed AND lang IN (SELECT lang FROM common) GROUP BY ALL
), shares AS (
  SELECT doc_id, kind, c / sum(c) OVER (PARTITION BY doc_id, kind) AS p, r / sum(r) OVER (PARTITION BY doc_id, kind) AS q
  FROM hist JOIN reference USING (lang, kind, bin)
), distance AS (
  SELECT doc_id, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS d FROM shares GROUP BY doc_id, kind
), far AS (
  SELECT b.*, CASE WHEN {on_chars} THEN round(c.d, 6) END AS char_distance,
    CASE WHEN {guard} THEN round(w.d, 6) END AS word_distance
  FROM base b LEFT JOIN distance c ON c.doc_id = b.doc_id AND c.kind = 'c'
  LEFT JOIN distance w ON w.doc_id = b.doc_id AND w.kind = 'w'
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(char_distance > {MAX_CHAR_DISTANCE}, FALSE) AND NOT coalesce(word_distance > {MAX_WORD_DISTANCE}, FALSE)
    AS kept, char_distance, word_distance FROM far"""


@query("op5_quality_rules", _sql(short=True))
def _(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))


@query("op5_quality_rules_short", _sql(short=True))
def _(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), short=True)
