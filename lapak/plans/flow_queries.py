"""Change detection, review, relevance, quality and run reports: T1, T2, T6, W5-W8, N9-N13, J12, P12, A6-A12, A16,
A17, A20, A22, U8, X18, X19, SRC2, SNK7, SNK8."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lapak.functions import values
from lapak.operators import changes, contract, quality, relevance, review, runs
from lapak.plans.registry import query
from lapak.plans.views import AS_OF, SQL_VIEWS
from lapak.session import scratch_path
from lapak.streaming.jobs import feed_revision

# Changes -----------------------------------------------------------------------------------------------------------

SQL_VIEWS["v_changes"] = """
    SELECT o.*, CASE WHEN coalesce(o.prev, s.fingerprint) IS NULL THEN 'new' WHEN coalesce(o.prev, s.fingerprint) = o.fingerprint
        THEN 'unchanged' ELSE 'changed' END AS change
    FROM (SELECT *, lag(fingerprint) OVER (PARTITION BY candidate_key ORDER BY seq) AS prev FROM v_obs) o
    LEFT JOIN v_state s ON s.candidate_key = o.candidate_key"""
SQL_VIEWS["v_enqueued"] = """
    SELECT c.seq, c.candidate_key, c.source_id, c.fingerprint, c.observed_at, c.payload_json, c.change, v.status AS stored,
           CASE WHEN c.change = 'unchanged' OR v.status = 'leased' THEN 0 WHEN v.status = 'pending' AND c.seq = min(CASE WHEN
               c.change <> 'unchanged' THEN c.seq END) OVER (PARTITION BY c.candidate_key) THEN 0 ELSE 1 END AS enqueued
    FROM v_changes c LEFT JOIN v_versions v ON v.candidate_key = c.candidate_key AND v.fingerprint = c.fingerprint"""


@query("w5_classify_changes", "SELECT seq, candidate_key, fingerprint, change FROM v_changes")
def _(t):
    return changes.classify_changes(t.obs, t.state).select("seq", "candidate_key", "fingerprint", "change")


@query("w5_classify_changes_small_segments", "SELECT seq, candidate_key, fingerprint, change FROM v_changes")
def _(t):
    return changes.classify_changes(t.obs, t.state, segment_size=97).select("seq", "candidate_key", "fingerprint", "change")


@query("t1_next_state", """
    SELECT coalesce(s.candidate_key, o.candidate_key) AS candidate_key, coalesce(o.source_id, s.source_id) AS source_id,
           coalesce(o.fingerprint, s.fingerprint) AS fingerprint, coalesce(s.first_seen_at, o.first_at) AS first_seen_at,
           coalesce(o.last_at, s.last_seen_at) AS last_seen_at, coalesce(s.seen_count, 0) + coalesce(o.n, 0) AS seen_count
    FROM v_state s FULL OUTER JOIN (SELECT candidate_key, arg_max(source_id, seq) AS source_id, arg_max(fingerprint, seq) AS fingerprint,
        arg_min(observed_at, seq) AS first_at, arg_max(observed_at, seq) AS last_at, count(*) AS n FROM v_obs GROUP BY 1) o
        ON o.candidate_key = s.candidate_key""")
def _(t):
    return changes.next_state(t.obs, t.state).select(
        "candidate_key", "source_id", "fingerprint", "first_seen_at", "last_seen_at", "seen_count")


@query("t1_enqueued_versions", "SELECT seq, candidate_key, fingerprint, change, enqueued FROM v_enqueued")
def _(t):
    seen = changes.classify_changes(t.obs, t.state)
    return changes.enqueued_versions(seen, t.versions).select("seq", "candidate_key", "fingerprint", "change", "enqueued")


@query("a16_enqueue_summary", """
    SELECT source_id, count(*) AS received, count(*) FILTER (WHERE change = 'new') AS new, count(*) FILTER (WHERE change = 'changed')
        AS changed, count(*) FILTER (WHERE change = 'unchanged') AS unchanged, CAST(sum(enqueued) AS BIGINT) AS enqueued
    FROM v_enqueued GROUP BY 1""")
def _(t):
    seen = changes.classify_changes(t.obs, t.state)
    return changes.enqueue_summary(changes.enqueued_versions(seen, t.versions))


NEXT_QUEUE_SQL = """
    WITH per_version AS (
        SELECT candidate_key, fingerprint, max(seq) FILTER (WHERE change <> 'unchanged') AS moved_seq,
               arg_max(observed_at, seq) FILTER (WHERE enqueued = 1) AS entered_at, arg_max(payload_json, seq) AS payload,
               count(*) FILTER (WHERE change = 'unchanged') AS quiet FROM v_enqueued GROUP BY 1, 2),
    merged AS (
        SELECT coalesce(v.candidate_key, p.candidate_key) AS candidate_key, coalesce(v.fingerprint, p.fingerprint) AS fingerprint,
               v.status AS stored, v.attempts, v.enqueued_at, v.payload_json, v.done_at, p.moved_seq, p.entered_at, p.payload, p.quiet
        FROM v_versions v FULL OUTER JOIN per_version p ON p.candidate_key = v.candidate_key AND p.fingerprint = v.fingerprint),
    moves AS (SELECT candidate_key, fingerprint, seq, observed_at FROM v_enqueued WHERE change <> 'unchanged'),
    keyed AS (SELECT m.*, k.current_fp, (SELECT arg_min(x.observed_at, x.seq) FROM moves x WHERE x.candidate_key = m.candidate_key
                  AND x.seq > coalesce(m.moved_seq, -1)) AS closed_at
              FROM merged m LEFT JOIN (SELECT candidate_key, arg_max(fingerprint, seq) AS current_fp FROM moves GROUP BY 1) k
              ON k.candidate_key = m.candidate_key)
    SELECT candidate_key, fingerprint,
           CASE WHEN entered_at IS NOT NULL AND current_fp = fingerprint THEN 'pending'
                WHEN current_fp IS NOT NULL AND current_fp <> fingerprint AND (entered_at IS NOT NULL OR stored = 'pending') THEN 'done'
                ELSE stored END AS status,
           CASE WHEN entered_at IS NOT NULL THEN 0 ELSE attempts END AS attempts, coalesce(entered_at, enqueued_at) AS enqueued_at,
           CASE WHEN entered_at IS NOT NULL AND current_fp = fingerprint THEN NULL
                WHEN current_fp IS NOT NULL AND current_fp <> fingerprint AND (entered_at IS NOT NULL OR stored = 'pending') THEN closed_at
                ELSE done_at END AS done_at,
           CASE WHEN entered_at IS NOT NULL OR (stored = 'pending' AND quiet > 0) THEN payload ELSE payload_json END AS payload_json
    FROM keyed WHERE stored IS NOT NULL OR moved_seq IS NOT NULL"""


@query("t2_next_queue", NEXT_QUEUE_SQL)
def _(t):
    _, _, after = changes.detect_changes(t.obs, t.state, t.versions)
    return after.select("candidate_key", "fingerprint", "status", "attempts", "enqueued_at", "done_at", "payload_json")


# Review ------------------------------------------------------------------------------------------------------------

# Listings as candidates in batches of five by number; results derived from them with planted faults.
SQL_VIEWS["v_items"] = """
    SELECT seq // 5 AS batch, seq, upper(platform) AS platform, CASE WHEN seq % 211 = 0 THEN 'same' ELSE external_id END AS external_id,
           title, description, seller_name, upper(status) AS status, platform = 'facebook_group' AS in_group, source_url FROM v_listings"""
SQL_VIEWS["v_answers"] = """
    SELECT seq // 5 AS batch, seq, CASE WHEN seq % 197 = 0 THEN 'other' WHEN seq % 211 = 0 THEN 'same' ELSE external_id END AS external_id,
           seq % 29 <> 0 AS is_listing,
           CASE WHEN seq % 29 = 0 AND seq % 4 = 0 THEN ' out_of_scope ' WHEN seq % 29 = 0 AND seq % 3 = 0 THEN 'MARKETPLACE_STORE_OR_PROMOTION'
                WHEN seq % 29 = 0 AND seq % 7 = 0 THEN 'SPAM' WHEN seq % 29 = 0 AND seq % 11 = 0 THEN '' WHEN seq % 29 = 0 THEN 'NOT_A_LISTING' END
                AS rejection_reason,
           CASE WHEN seq % 31 = 0 THEN external_id WHEN seq % 37 = 0 THEN ' ' ELSE concat(' ', title) END AS title,
           CASE WHEN seq % 41 = 0 THEN '999999999999' ELSE CAST(price AS VARCHAR) END AS price, location_texts, condition_text,
           CASE WHEN seq % 5 = 0 THEN 'gone' ELSE 'sold' END AS status, category, brand
    FROM v_listings WHERE brand IS NOT NULL OR price IS NOT NULL"""


def items(t):
    facts = F.when(F.col("platform") == "facebook_group", F.create_map(F.lit("sourceType"), F.lit("facebook_group"))).otherwise(
        F.create_map(F.lit("kind"), F.col("status")))
    return t.listings.select(
        F.expr("seq div 5").alias("batch"), "seq", F.upper("platform").alias("platform"),
        F.expr("CASE WHEN seq % 211 = 0 THEN 'same' ELSE external_id END").alias("external_id"), "title", "description",
        "seller_name", F.upper("status").alias("status"), "source_url", facts.alias("source_facts"),
        "posted_at", "first_fetched_at", "last_fetched_at")


def answers(t):
    return t.listings.filter("brand is not null or price is not null").selectExpr(
        "seq div 5 AS batch",
        "CASE WHEN seq % 197 = 0 THEN 'other' WHEN seq % 211 = 0 THEN 'same' ELSE external_id END AS external_id",
        "seq % 29 <> 0 AS is_listing",
        "CASE WHEN seq % 29 = 0 AND seq % 4 = 0 THEN ' out_of_scope ' WHEN seq % 29 = 0 AND seq % 3 = 0 "
        "THEN 'MARKETPLACE_STORE_OR_PROMOTION' WHEN seq % 29 = 0 AND seq % 7 = 0 THEN 'SPAM' WHEN seq % 29 = 0 AND seq % 11 = 0 THEN '' "
        "WHEN seq % 29 = 0 THEN 'NOT_A_LISTING' END AS rejection_reason",
        "CASE WHEN seq % 31 = 0 THEN external_id WHEN seq % 37 = 0 THEN ' ' ELSE concat(' ', title) END AS title",
        "CASE WHEN seq % 41 = 0 THEN '999999999999' ELSE CAST(price AS STRING) END AS price", "location_texts", "condition_text",
        "CASE WHEN seq % 5 = 0 THEN 'gone' ELSE 'sold' END AS status", "category", "brand")


@query("n9_pack_review_batches", """
    SELECT CAST(floor(rn / 5) AS BIGINT) AS batch, CAST(count(*) AS INTEGER) AS n_items, md5(concat('[', string_agg(concat('{"platform":"', platform,
        '","externalId":"', external_id, '","title":"', title, '","description":"', replace(description, chr(10), '\\n'),
        '","sourceFacts":{"kind":"', status, '"}}'), ',' ORDER BY rn), ']')) AS request
    FROM (SELECT *, row_number() OVER (ORDER BY coalesce(posted_at, first_fetched_at) DESC, id) - 1 AS rn FROM v_listings) x GROUP BY 1""")
def _(t):
    rows = t.listings.withColumn("source_facts", F.create_map(F.lit("kind"), F.col("status")))
    packed = review.pack_review_batches(rows, [values.effective_at().desc(), F.col("id")], 5)
    return packed.select("batch", "n_items", F.md5("request").alias("request"))


@query("j12_match_results", """
    SELECT coalesce(i.batch, a.batch) AS batch, coalesce(i.external_id, a.external_id) AS external_id, i.batch IS NOT NULL AS listed,
           a.batch IS NOT NULL AS answered FROM v_items i FULL OUTER JOIN v_answers a ON a.batch = i.batch AND a.external_id = i.external_id""")
def _(t):
    return review.match_results(items(t), answers(t)).select(
        "batch", "external_id", F.coalesce("_listed", F.lit(False)).alias("listed"),
        F.coalesce("_answered", F.lit(False)).alias("answered"))


SQL_VIEWS["v_checks"] = """
    SELECT batch, CASE WHEN NOT ok THEN 'not exactly one result for every listing' WHEN scope THEN 'OUT_OF_SCOPE is valid only for group items'
        WHEN market THEN 'marketplace reason on another platform' WHEN bare THEN 'invalid Instagram title' END AS error
    FROM (SELECT coalesce(i.batch, a.batch) AS batch,
                 bool_and(i.batch IS NOT NULL AND a.batch IS NOT NULL AND coalesce(i.copies, 1) = 1 AND coalesce(a.copies, 1) = 1) AS ok,
                 coalesce(bool_or(NOT a.is_listing AND upper(trim(a.rejection_reason)) = 'OUT_OF_SCOPE' AND NOT coalesce(i.in_group, FALSE)), FALSE) AS scope,
                 coalesce(bool_or(NOT a.is_listing AND starts_with(upper(trim(a.rejection_reason)), 'MARKETPLACE') AND i.platform <> 'FACEBOOK'), FALSE) AS market,
                 coalesce(bool_or(a.is_listing AND i.platform = 'INSTAGRAM' AND (trim(a.title) = '' OR trim(a.title) = i.external_id)), FALSE) AS bare
          FROM (SELECT *, count(*) OVER (PARTITION BY batch, external_id) AS copies FROM v_items) i
          FULL OUTER JOIN (SELECT *, count(*) OVER (PARTITION BY batch, external_id) AS copies FROM v_answers) a
               ON a.batch = i.batch AND a.external_id = i.external_id GROUP BY 1) x"""


@query("n10_validate_review", "SELECT batch, error IS NULL AS valid, error FROM v_checks")
def _(t):
    return review.validate_review(items(t), answers(t))


_PAIRS = """SELECT i.*, a.is_listing, upper(trim(coalesce(nullif(a.rejection_reason, ''), 'OTHER'))) AS reason, trim(a.title) AS a_title,
        a.price AS a_price, a.location_texts AS a_places, a.condition_text AS a_condition, a.status AS a_status, a.category AS a_category, a.brand AS a_brand
    FROM v_items i JOIN v_answers a ON a.batch = i.batch AND a.external_id = i.external_id"""
_ACCEPTED = f"""SELECT batch, seq, coalesce(nullif(a_title, ''), title) AS title,
        CASE WHEN CAST(a_price AS BIGINT) BETWEEN 10000 AND 200000000 THEN CAST(a_price AS INTEGER) END AS price,
        array_to_string(a_places, '|') AS location_texts, CASE WHEN a_condition <> 'mulus' THEN a_condition END AS condition_text,
        CASE WHEN in_group THEN 'AVAILABLE' WHEN platform IN ('FACEBOOK', 'REDDIT') AND status IN ('AVAILABLE', 'SOLD') THEN status
             WHEN a_status = 'sold' THEN 'SOLD' ELSE 'UNKNOWN' END AS status, a_category AS category, a_brand AS brand, trim(seller_name) AS seller_name
    FROM ({_PAIRS}) p WHERE is_listing"""
_REJECTED = f"""SELECT batch, seq, title, CASE WHEN reason IN ('NOT_A_LISTING', 'OUT_OF_SCOPE', 'MARKETPLACE_STORE_OR_PROMOTION',
        'MARKETPLACE_CONTACT_OR_STORE_INFO', 'WANTED_OR_SERVICE', 'OTHER') THEN reason ELSE 'OTHER' END AS reason_code
    FROM ({_PAIRS}) p WHERE NOT is_listing"""


@query("n11_merge_accepted", _ACCEPTED)
def _(t):
    yes, _ = review.merge_results(items(t).withColumns(
        {c: F.lit(None).cast("string") for c in ("price", "condition_text", "category", "brand")}).withColumn(
        "location_texts", F.array().cast("array<string>")), answers(t))
    return yes.select("batch", "seq", "title", "price", F.array_join("location_texts", "|").alias("location_texts"),
                      "condition_text", "status", "category", "brand", "seller_name")


@query("n11_merge_rejected", _REJECTED)
def _(t):
    return review.merge_results(items(t), answers(t))[1].select("batch", "seq", "title", "reason_code")


@query("n12_route_batches", f"""
    WITH broken AS (SELECT batch FROM v_checks WHERE error IS NOT NULL UNION SELECT batch FROM v_items WHERE seq % 83 = 0)
    SELECT 'accepted' AS route, batch, seq FROM ({_ACCEPTED}) a WHERE batch NOT IN (SELECT batch FROM broken)
    UNION ALL SELECT 'rejected', batch, seq FROM ({_REJECTED}) r WHERE batch NOT IN (SELECT batch FROM broken)
    UNION ALL SELECT 'retry', batch, seq FROM v_items WHERE batch IN (SELECT batch FROM broken)""")
def _(t):
    rows = items(t)
    yes, no = review.merge_results(rows, answers(t))
    checks = review.validate_review(rows, answers(t))
    text = {c: F.lit(None).cast("string") for c in ("condition_text", "category", "brand", "price")}
    raw = rows.withColumns(text).withColumns({
        "location_texts": F.array().cast("array<string>"), "description": F.when(F.col("seq") % 83 != 0, F.col("description")),
        "images": F.lit(None).cast("array<struct<source_url:string,position:string,alt_text:string>>"),
        **{c: values.iso_millis(F.col(c)) for c in ("posted_at", "first_fetched_at", "last_fetched_at")}})
    _, invalid = contract.validate_contract(raw)
    accepted, rejected, retry = review.route_batches(yes, no, rows, checks, invalid)
    shaped = [df.select(F.lit(name).alias("route"), "batch", "seq") for name, df in (
        ("accepted", accepted), ("rejected", rejected), ("retry", retry))]
    return shaped[0].union(shaped[1]).union(shaped[2])


def _measured(request: str) -> str:
    """A plain function in the place where users put a model: measures of each listing of a request."""
    return json.dumps([{"external_id": i["externalId"], "is_long": len(i["description"]) > 40, "title": i["title"].upper(),
                        "n_words": len(i["description"].split())} for i in json.loads(request)])


@query("n13_enrich", r"""
    SELECT external_id, length(description) > 40 AS is_long, upper(title) AS title,
           len(regexp_extract_all(description, '\S+')) AS n_words FROM v_listings""")
def _(t):
    rows = t.listings.withColumn("source_facts", F.create_map(F.lit("kind"), F.col("status")))
    packed = review.pack_review_batches(rows, [F.col("id")], 20)
    return review.enrich(packed, _measured, "external_id string, is_long boolean, title string, n_words bigint").drop("batch")


# Relevance ---------------------------------------------------------------------------------------------------------

SQL_VIEWS["v_cards"] = """
    SELECT doc_id AS seq, source AS target_id, CAST(doc_id AS VARCHAR) AS item_id, text AS title,
           lower(concat(text, ' ', coalesce(lang, ''))) AS body FROM documents"""
_POSITIVE = ("le", "ram", "la", "the", "und")
_BLOCKED = ("que ", "http", "sch", "gpu")


def _hits_sql(words) -> str:
    from lapak.functions.text import WHOLE_WORD_KEYWORDS

    tests = [f"CASE WHEN regexp_matches(body, '\\b{w}\\b') THEN '{w}' END" if w in WHOLE_WORD_KEYWORDS
             else f"CASE WHEN contains(body, '{w.strip()}') THEN '{w}' END" for w in words]
    return f"[x for x in [{', '.join(tests)}] if x IS NOT NULL]"


_own_sql = ("trim(w) <> '' AND CASE WHEN lower(trim(w)) IN ('pc', 'gpu') THEN regexp_matches(body, concat('\\b', lower(trim(w)), '\\b')) "
            "ELSE contains(body, lower(trim(w))) END")


SQL_VIEWS["v_judged"] = f"""
    SELECT seq, target_id, item_id, title, good, bad, CASE WHEN len(bad) > 0 THEN 'blocked' WHEN len(good) > 0 THEN 'matched'
           ELSE 'skipped' END AS outcome FROM (SELECT *, {_hits_sql(_POSITIVE)} AS good, {_hits_sql(_BLOCKED)} AS bad FROM v_cards) x"""


def cards(t):
    return t.table("documents").select(
        F.col("doc_id").alias("seq"), F.col("source").alias("target_id"), F.col("doc_id").cast("string").alias("item_id"),
        F.col("text").alias("title"), F.col("text").alias("raw_text"), F.col("lang").alias("image_alt"))


_HIT_LIST = """SELECT target_id, list(word ORDER BY seq, place) AS words FROM (
        SELECT target_id, word, min(seq) AS seq, arg_min(place, seq) AS place FROM (
            SELECT target_id, seq, unnest({col}) AS word, unnest(range(1, len({col}) + 1)) AS place FROM v_judged WHERE outcome = '{outcome}') a
        GROUP BY 1, 2) b GROUP BY 1"""
_METRICS = f"""SELECT c.*, coalesce(array_to_string(g.words, '|'), '') AS matched_keywords, coalesce(array_to_string(b.words, '|'), '')
        AS blocked_keywords FROM (SELECT target_id, count(*) AS candidates, count(*) FILTER (WHERE outcome = 'matched') AS matched,
        count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'blocked') AS blocked FROM v_judged GROUP BY 1) c
    LEFT JOIN ({_HIT_LIST.format(col='good', outcome='matched')}) g ON g.target_id = c.target_id
    LEFT JOIN ({_HIT_LIST.format(col='bad', outcome='blocked')}) b ON b.target_id = c.target_id"""
_CHOSEN = """SELECT target_id, item_id, title, seq, row_number() OVER (PARTITION BY target_id ORDER BY seq) AS place FROM v_judged
    WHERE outcome = 'matched' QUALIFY place <= 4"""


@query("p12_relevance_selected", f"SELECT target_id, item_id, place FROM ({_CHOSEN}) x")
def _(t):
    return relevance.relevance_filter(cards(t), _POSITIVE, _BLOCKED, 4)[0].select(
        "target_id", "item_id", F.col("place").cast("bigint").alias("place"))


@query("p12_relevance_metrics", _METRICS)
def _(t):
    metrics = relevance.relevance_filter(cards(t), _POSITIVE, _BLOCKED, 4)[1]
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)
    return metrics.select("target_id", "candidates", "matched", "skipped", "blocked", joined("matched_keywords"),
                          joined("blocked_keywords"))


@query("a20_calibration", f"""
    SELECT m.target_id, m.candidates, m.matched, coalesce(s.selected, 0) AS selected, m.skipped, m.blocked, m.matched_keywords,
           m.blocked_keywords, coalesce(s.titles, '') AS sample_titles, coalesce(s.ids, '') AS sample_ids
    FROM ({_METRICS}) m LEFT JOIN (SELECT target_id, count(*) AS selected, string_agg(title, '|' ORDER BY place) FILTER (WHERE place <= 3) AS titles,
        string_agg(item_id, '|' ORDER BY place) FILTER (WHERE place <= 3) AS ids FROM ({_CHOSEN}) x GROUP BY 1) s ON s.target_id = m.target_id""")
def _(t):
    report = relevance.calibration(*relevance.relevance_filter(cards(t), _POSITIVE, _BLOCKED, 4), samples=3)
    joined = [F.array_join(c, "|").alias(c) for c in ("matched_keywords", "blocked_keywords", "sample_titles", "sample_ids")]
    return report.select("target_id", "candidates", "matched", "selected", "skipped", "blocked", *joined)


# Targets with words, limit and bypass of their own; some targets have no card, some cards no target.
SQL_VIEWS["v_targets"] = """
    SELECT concat('src', n_nationkey) AS target_id, [lower(left(n_name, 2)), 'PC', ' ou '] AS positive_keywords,
           CASE WHEN n_nationkey % 4 = 0 THEN [lower(right(n_name, 3)), 'gpu', ''] END AS blocked_keywords,
           CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey % 8 END AS card_limit, n_nationkey % 6 = 5 AS bypass FROM nation WHERE n_nationkey <> 3"""
SQL_VIEWS["v_target_judged"] = f"""
    SELECT seq, target_id, item_id, title, coalesce(bypass, FALSE) AS bypass, greatest(1, least(100, coalesce(card_limit, 15))) AS card_limit,
           CASE WHEN bypass THEN [] ELSE good END AS good, CASE WHEN bypass THEN [] ELSE bad END AS bad,
           CASE WHEN bypass THEN 'bypassed' WHEN len(bad) > 0 THEN 'blocked' WHEN len(good) > 0 THEN 'matched' ELSE 'skipped' END AS outcome
    FROM (SELECT c.*, t.bypass, t.card_limit,
                 list_concat({_hits_sql(_POSITIVE)}, [w for w in coalesce(t.positive_keywords, []) if {_own_sql} and w not in ('le', 'la', 'ram', 'the', 'und')]) AS good,
                 list_concat({_hits_sql(_BLOCKED)}, [w for w in coalesce(t.blocked_keywords, []) if {_own_sql} and w not in ('sch', 'gpu')]) AS bad
          FROM v_cards c LEFT JOIN v_targets t ON t.target_id = c.target_id) x"""
_TARGET_HITS, _TARGET_COUNTS = _HIT_LIST.replace("v_judged", "v_target_judged"), """
    SELECT target_id, count(*) AS candidates, count(*) FILTER (WHERE outcome = 'matched') AS matched, count(*) FILTER (WHERE outcome = 'skipped')
        AS skipped, count(*) FILTER (WHERE outcome = 'blocked') AS blocked FROM v_target_judged GROUP BY 1"""
_TARGET_METRICS = f"""SELECT coalesce(c.target_id, t.target_id) AS target_id, coalesce(candidates, 0) AS candidates,
        CASE WHEN t.bypass THEN least(coalesce(candidates, 0), greatest(1, least(100, coalesce(t.card_limit, 15)))) ELSE coalesce(matched, 0) END AS matched,
        coalesce(skipped, 0) AS skipped, coalesce(blocked, 0) AS blocked, coalesce(array_to_string(g.words[:20], '|'), '') AS matched_keywords,
        coalesce(array_to_string(b.words[:20], '|'), '') AS blocked_keywords
    FROM ({_TARGET_COUNTS}) c FULL OUTER JOIN v_targets t ON t.target_id = c.target_id
    LEFT JOIN ({_TARGET_HITS.format(col='good', outcome='matched')}) g ON g.target_id = c.target_id
    LEFT JOIN ({_TARGET_HITS.format(col='bad', outcome='blocked')}) b ON b.target_id = c.target_id"""
_TARGET_CHOSEN = """SELECT target_id, item_id, title, seq, row_number() OVER (PARTITION BY target_id ORDER BY seq) AS place, card_limit
    FROM v_target_judged WHERE outcome IN ('matched', 'bypassed') QUALIFY place <= card_limit"""


def targets(t):
    name = F.lower("n_name")
    key = F.col("n_nationkey").cast("int")
    rows = t.table("nation").filter("n_nationkey <> 3").select(
        F.concat(F.lit("src"), key.cast("string")).alias("target_id"),
        F.array(F.left(name, F.lit(2)), F.lit("PC"), F.lit(" ou ")).alias("positive_keywords"),
        F.when(key % 4 == 0, F.array(F.right(name, F.lit(3)), F.lit("gpu"), F.lit(""))).alias("blocked_keywords"),
        F.when(key % 5 > 0, key % 8).alias("card_limit"), (key % 6 == 5).alias("bypass"))
    return relevance.prepared_targets(rows)


def _by_target(t):
    return relevance.relevance_filter(cards(t), _POSITIVE, _BLOCKED, targets=targets(t))


@query("p12_target_selected", f"SELECT target_id, item_id, place FROM ({_TARGET_CHOSEN}) x")
def _(t):
    return _by_target(t)[0].select("target_id", "item_id", F.col("place").cast("bigint").alias("place"))


@query("p12_target_metrics", _TARGET_METRICS)
def _(t):
    joined = lambda c: F.array_join(c, "|").alias(c)
    return _by_target(t)[1].select("target_id", "candidates", "matched", "skipped", "blocked", joined("matched_keywords"),
                                   joined("blocked_keywords"))


@query("a20_target_calibration", f"""
    SELECT m.target_id, m.candidates, m.matched, coalesce(s.selected, 0) AS selected, m.skipped, m.blocked, m.matched_keywords,
           m.blocked_keywords, coalesce(s.titles, '') AS sample_titles, coalesce(s.ids, '') AS sample_ids
    FROM ({_TARGET_METRICS}) m LEFT JOIN (SELECT target_id, count(*) AS selected, string_agg(title, '|' ORDER BY place) FILTER (WHERE place <= 5) AS titles,
        string_agg(item_id, '|' ORDER BY place) FILTER (WHERE place <= 5) AS ids FROM ({_TARGET_CHOSEN}) x GROUP BY 1) s ON s.target_id = m.target_id""")
def _(t):
    report = relevance.calibration(*_by_target(t))
    joined = [F.array_join(c, "|").alias(c) for c in ("matched_keywords", "blocked_keywords", "sample_titles", "sample_ids")]
    return report.select("target_id", "candidates", "matched", "selected", "skipped", "blocked", *joined)


@query("u8_pooled_cards", f"""
    SELECT title AS identity, min(seq) AS seq FROM ({_CHOSEN}) x GROUP BY 1""")
def _(t):
    selected, metrics = relevance.relevance_filter(cards(t), _POSITIVE, _BLOCKED, 4)
    return relevance.pool_cards(selected.withColumn("identity", F.col("title")), metrics)[0].select("identity", "seq")


@query("u8_pool_outcome", f"""
    SELECT (SELECT count(*) FROM documents) AS candidates, (SELECT count(DISTINCT title) FROM ({_CHOSEN}) x) AS cards, 'cards' AS outcome""")
def _(t):
    selected, metrics = relevance.relevance_filter(cards(t), _POSITIVE, _BLOCKED, 4)
    return relevance.pool_cards(selected.withColumn("identity", F.col("title")), metrics)[1]


# Quality -----------------------------------------------------------------------------------------------------------

SQL_VIEWS["v_scanned"] = """
    SELECT l.*, coalesce(i.n, 0) AS image_count FROM v_listings l
    LEFT JOIN (SELECT listing_id, count(*) AS n FROM v_images GROUP BY 1) i ON i.listing_id = l.id"""
_UNSURE = {
    "price": "price IS NULL", "category": "category IS NULL OR category = ''", "brand": "brand IS NULL OR brand = ''",
    "locationTexts": "len(location_texts) = 0", "conditionText": "condition_text IS NULL OR condition_text = ''",
    "postedAt": "posted_at IS NULL", "status": "status = 'unknown'", "images": "image_count <= 0",
}
_REASONS = {
    "missing_condition": "trim(coalesce(condition_text, '')) = ''",
    "ambiguous_condition": "lower(trim(condition_text)) IN ('bekas', 'like new', 'mulus', 'normal', 'second', 'used')",
    "missing_location": "len(location_texts) = 0", "multiple_locations": "len(location_texts) > 1",
    "unknown_sold_status": "status = 'unknown'",
    "sold_status_conflict": "status = 'available' AND regexp_matches(description, '(?i)\\b(sold\\s*out|soldout|sold|terjual|laku|booked)\\b')",
}


def scanned(t):
    return quality.scan_listings(t.listings, t.images)


@query("a6_quality_counts", "SELECT 'low_confidence' AS kind, field, count(*) AS count FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field FROM v_scanned WHERE {c}" for f, c in _UNSURE.items()) + ") x GROUP BY 2")
def _(t):
    return quality.quality_counts(scanned(t))


@query("a7_coverage", "SELECT scope, total, field, coverage, coverage < 0.8 AS below_target FROM (" + " UNION ALL ".join(
    f"SELECT coalesce(platform, '(all)') AS scope, count(*) AS total, '{f}' AS field, "
    f"round_even(count(*) FILTER (WHERE NOT coalesce({c}, FALSE)) / count(*), 4) AS coverage FROM v_scanned GROUP BY GROUPING SETS ((), (platform))"
    for f, c in _UNSURE.items()) + ") x")
def _(t):
    return quality.coverage(scanned(t))


_REASON_LIST = "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in _REASONS.items()) + ")"


@query("a8_manual_review_items", f"SELECT id, reasons FROM (SELECT id, {_REASON_LIST} AS reasons FROM v_scanned) x WHERE reasons <> ''")
def _(t):
    return quality.manual_review(scanned(t))[0].select("id", F.array_join("reasons", "|").alias("reasons"))


@query("a8_manual_review_counts", "SELECT reason, count(*) AS count FROM (" + " UNION ALL ".join(
    f"SELECT '{r}' AS reason FROM v_scanned WHERE {c}" for r, c in _REASONS.items()) + ") x GROUP BY 1")
def _(t):
    return quality.manual_review(scanned(t))[1]


@query("a6_attention_items", "SELECT id, uncertain FROM (SELECT id, concat_ws('|', " + ", ".join(
    f"CASE WHEN {c} THEN '{f}' END" for f, c in _UNSURE.items()) + ") AS uncertain FROM v_scanned) x WHERE uncertain <> ''")
def _(t):
    return quality.attention_items(scanned(t)).select("id", F.array_join("uncertain", "|").alias("uncertain"))


@query("snk7_write_reports", f"""
    SELECT 'items' AS report, DATE '2024-01-20' AS report_date, count(*) AS rows FROM (SELECT {_REASON_LIST} AS r FROM v_scanned) x WHERE r <> ''
    UNION ALL SELECT 'coverage', DATE '2024-01-20', (count(DISTINCT platform) + 1) * 8 FROM v_scanned""")
def _(t):
    from lapak.sources.tables import write_reports

    base = scratch_path(t.spark, "reports")
    report, review_items = quality.coverage(scanned(t)), quality.manual_review(scanned(t))[0]
    for _ in range(2):  # the second run of a day replaces the first
        paths = write_reports(report, review_items, base, AS_OF[:10])
    back = [t.spark.read.json(p).groupBy("report_date").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("report"), F.to_date("report_date").alias("report_date"), "rows")
        for name, p in zip(("coverage", "items"), paths)]
    return back[0].union(back[1])


# Run logs ----------------------------------------------------------------------------------------------------------

@query("src2_scan_run_logs", """
    SELECT line, source, status, ok, log_time, logged_time FROM v_runlog
    WHERE logged_time IS NULL OR logged_time >= TIMESTAMP '2024-01-10 00:00:00'""")
def _(t):
    from lapak.sources.runlogs import parse_run_log_lines

    return parse_run_log_lines(t.run_log_lines, "2024-01-10 00:00:00").select(
        "line", "source", "status", "ok", "log_time", "logged_time")


@query("snk8_append_run_log", """
    SELECT status, count(*) AS count, '***' AS api_token FROM events e JOIN (SELECT event_id, CASE event_type WHEN 'error' THEN 'failed'
        WHEN 'click' THEN 'no_new_data' ELSE 'success' END AS status FROM events) s ON s.event_id = e.event_id GROUP BY 1""")
def _(t):
    from lapak.sources.runlogs import append_run_log

    path = scratch_path(t.spark, "runlog")
    rows = t.table("events").selectExpr(
        "'orchestrator' AS source", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'no_new_data' ELSE 'success' END AS status",
        "concat('t', props) AS api_token")
    half = F.col("status") == "success"
    append_run_log(rows.filter(half), path, "2024-01-01T00:00:00Z")
    append_run_log(rows.filter(~half), path, "2024-01-02T00:00:00Z")
    raw = t.spark.read.schema("status string, api_token string").json(path)
    return raw.groupBy("status", "api_token").agg(F.count(F.lit(1)).alias("count"))


@query("snk8_run_log_round_trip", """
    SELECT status, log_time, count(*) AS count FROM (
        SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'no_new_data' ELSE 'success' END AS status,
               CASE WHEN event_type IN ('error', 'click') THEN '2024-01-02T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS log_time
        FROM events) x GROUP BY 1, 2""")
def _(t):
    from lapak.sources.runlogs import append_run_log, scan_run_logs

    path = scratch_path(t.spark, "runlog")
    rows = t.table("events").selectExpr(
        "'orchestrator' AS source",
        "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'no_new_data' ELSE 'success' END AS status",
        "concat('t', props) AS api_token")
    for at, test in (("2024-01-01T00:00:00Z", "status = 'success'"), ("2024-01-02T00:00:00Z", "status <> 'success'")):
        append_run_log(rows.filter(test), path, at)
    return scan_run_logs(t.spark, path).groupBy("status", "log_time").agg(F.count(F.lit(1)).alias("count"))


@query("x19_connector_records", """
    SELECT line, connector, connector_status AS status, ok, validated FROM v_runlog WHERE source = 'orchestrator'""")
def _(t):
    return runs.connector_records(t.run_log).select("line", "connector", "status", "ok", "validated")


@query("x18_explode_candidates", """
    SELECT o_orderkey AS run_id, 'facebook' AS connector, concat('c', o_orderkey) AS external_id FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, 'facebook', concat('l', o_orderkey) FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT o_orderkey, 'reddit', concat('r', o_orderkey) FROM orders""")
def _(t):
    one = "array(named_struct('external_id', concat('{p}', CAST(o_orderkey AS STRING))))"
    none = "CAST(NULL AS ARRAY<STRUCT<external_id: STRING>>)"
    text = F.to_json(F.struct(F.expr(
        f"array(named_struct('connector', 'facebook', 'candidates', CASE WHEN o_orderstatus = 'F' THEN {one.format(p='c')} "
        f"WHEN o_orderstatus = 'O' THEN slice({one.format(p='c')}, 1, 0) ELSE {none} END, 'listings', {one.format(p='l')}), "
        f"named_struct('connector', 'reddit', 'candidates', {none}, 'listings', {one.format(p='r')}))").alias("connectors")))
    schema = "connectors array<struct<connector:string,candidates:array<struct<external_id:string>>,listings:array<struct<external_id:string>>>>"
    parsed = t.table("orders").select(F.col("o_orderkey").alias("run_id"), F.from_json(text, schema).alias("j")).select(
        "run_id", "j.connectors")
    return runs.explode_candidates(parsed)


@query("a9_status_counts", """
    SELECT '(scheduler)' AS connector, status, count(*) AS count FROM v_runlog WHERE source = 'scheduler' GROUP BY 2
    UNION ALL SELECT connector, connector_status, count(*) FROM v_runlog WHERE source = 'orchestrator' GROUP BY 1, 2""")
def _(t):
    return runs.status_counts(t.run_log)


_TOTALS = """SELECT CAST(sum(requested) AS BIGINT) AS requested, CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(updated) AS BIGINT) AS updated,
    CAST(sum(duplicates) AS BIGINT) AS duplicates FROM v_runlog WHERE source = 'orchestrator'"""


@query("a10_storage_totals", f"SELECT *, 0 AS \"imagesDeleted\" FROM ({_TOTALS}) x")
def _(t):
    return runs.storage_totals(t.run_log).select("requested", "inserted", "updated", "duplicates",
                                                 F.col("imagesDeleted").cast("int").alias("imagesDeleted"))


@query("a11_yield_summary", f"""
    SELECT requested AS requested_listings, inserted AS new_listings_inserted, updated AS existing_listings_updated, duplicates AS duplicate_inputs,
           inserted + updated AS useful_writes, round_even(inserted / n, 2) AS new_per_successful_run, round_even(inserted / requested, 4) AS inserted_share
    FROM ({_TOTALS}) x, (SELECT count(*) AS n FROM v_runlog WHERE source = 'scheduler' AND status = 'success') y""")
def _(t):
    return runs.yield_summary(t.run_log)


SQL_VIEWS["v_latest"] = """
    SELECT connector, connector_status AS status, line, log_time FROM v_runlog WHERE source = 'orchestrator'
    QUALIFY row_number() OVER (PARTITION BY connector ORDER BY log_time DESC, line DESC) = 1"""


@query("w6_latest_connector_status", "SELECT connector, status, line, log_time FROM v_latest")
def _(t):
    return runs.latest_connector_status(t.run_log).select("connector", "status", "line", "log_time")


@query("w7_latest_degraded", """
    SELECT part, line, name, status FROM (
        SELECT 0 AS part, line, log_time, job_id AS name, status FROM v_runlog WHERE source = 'scheduler' AND (status IN ('degraded', 'failed') OR NOT ok)
        UNION ALL SELECT 1, line, log_time, connector, connector_status FROM v_runlog WHERE source = 'orchestrator'
            AND (connector_status IN ('degraded', 'failed') OR NOT ok)) x ORDER BY part DESC, log_time DESC, line DESC LIMIT 5""")
def _(t):
    return runs.latest_degraded(t.run_log).select("part", "line", "name", "status")


@query("a12_readiness", """
    SELECT seen = 3 AS all_connectors_observed, healthy = 3 AS latest_connectors_ready, (SELECT sum(inserted) + sum(updated) > 0 FROM v_runlog
        WHERE source = 'orchestrator') AS has_storage_writes, bad AS degraded_events, FALSE AS ready
    FROM (SELECT count(*) AS seen, count(*) FILTER (WHERE status IN ('success', 'no_new_data', 'cooldown_skip')) AS healthy FROM v_latest) a,
         (SELECT count(*) AS bad FROM v_runlog WHERE NOT ok) b""")
def _(t):
    return runs.readiness(t.run_log)


@query("a17_run_summary", """
    SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS connectors, count(*) FILTER (WHERE event_type <> 'error') AS succeeded,
           count(*) FILTER (WHERE event_type = 'error') AS failed, CAST(sum(floor(value)) AS BIGINT) AS listings,
           CAST(sum(event_id % 4) AS BIGINT) AS validation_errors,
           CAST(floor((epoch_us(max(ts)) + 1500000 - epoch_us(min(ts))) / 1000) AS BIGINT) AS duration_ms FROM events GROUP BY 1""")
def _(t):
    records = t.table("events").selectExpr(
        "CAST(user_id AS STRING) AS run_id", "ts AS started_at", "timestampadd(MICROSECOND, 1500000, ts) AS finished_at",
        "event_type <> 'error' AS ok", "CAST(floor(value) AS BIGINT) AS validated", "event_id % 4 AS validation_errors")
    return runs.run_summary(records)


_STREAKS = """
    SELECT seq, job_id, streak, CASE WHEN streak = 0 THEN 180 WHEN streak = 1 THEN 300 WHEN streak = 2 THEN 900 ELSE 1800 END AS delay_seconds FROM (
        SELECT seq, job_id, CAST(sum(bad) OVER (PARTITION BY job_id, island ORDER BY seq) AS BIGINT) AS streak FROM (
            SELECT *, sum(1 - bad) OVER (PARTITION BY job_id ORDER BY seq) AS island FROM (
                SELECT event_id AS seq, concat('job-', user_id % 3) AS job_id, CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END AS bad
                FROM events) a) b) c"""


def run_rows(t):
    return t.table("events").selectExpr(
        "event_id AS seq", "concat('job-', CAST(user_id % 3 AS STRING)) AS job_id",
        "CASE WHEN event_type IN ('error', 'click') THEN 'degraded' ELSE 'success' END AS status")


@query("w8_failure_streaks", _STREAKS)
def _(t):
    return runs.failure_streaks(run_rows(t)).select("seq", "job_id", "streak", "delay_seconds")


@query("a22_event_buckets", """
    SELECT event_type AS name, CASE WHEN p < 500000 THEN '<500k' WHEN p < 1500000 THEN '500k-1.5m' WHEN p < 5000000 THEN '1.5m-5m'
        WHEN p < 15000000 THEN '5m-15m' ELSE '15m+' END AS bucket, count(*) AS count
    FROM (SELECT event_type, floor(value * 100000) AS p FROM events) x GROUP BY 1, 2""")
def _(t):
    rows = t.table("events").select(F.col("event_type").alias("name"), values.price_bucket(F.floor(F.col("value") * 100_000)).alias("bucket"))
    return rows.groupBy("name", "bucket").agg(F.count(F.lit(1)).alias("count"))


@query("t6_feed_revision", """
    SELECT seq, revision, total_count, CASE WHEN revision <> base.r THEN greatest(0, total_count - base.n) ELSE 0 END AS unseen FROM (
        SELECT *, coalesce(last_value(CASE WHEN ack THEN {'r': revision, 'n': total_count} END IGNORE NULLS) OVER (ORDER BY seq),
                           first_value({'r': revision, 'n': total_count}) OVER (ORDER BY seq)) AS base FROM (
            SELECT event_id AS seq, concat('r', event_type) AS revision, CAST(floor(value) AS BIGINT) AS total_count, event_type = 'signup' AS ack
            FROM events) a) b""")
def _(t):
    history = t.table("events").selectExpr(
        "event_id AS seq", "concat('r', event_type) AS revision", "CAST(floor(value) AS BIGINT) AS total_count")
    confirmed = t.table("events").filter("event_type = 'signup'").select(F.col("event_id").alias("seq"))
    return feed_revision(history, confirmed)
