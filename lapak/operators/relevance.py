"""Relevance of search cards and calibration of search targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapak.functions.once import computed
from lapak.functions.text import (
    BLOCKED_KEYWORDS, POSITIVE_KEYWORDS, WHOLE_WORD_KEYWORDS, matched_keywords, or_blank, strip,
)
from lapak.operators.ordering import dedupe_first


DEFAULT_LIMIT, MAX_LIMIT = 15, 100


def prepared_targets(targets: DataFrame, limit: int | None = None, bypass: bool = False) -> DataFrame:
    """Targets with defaults filled in: target_id, own words as (keyword, word, whole), card_limit (1 to 100), bypass.

    ``targets``: target_id and any of positive_keywords, blocked_keywords (arrays), card_limit, bypass. ``limit`` and
    ``bypass`` of a run go before those of a target.
    """
    def words(name: str) -> Column:
        if name not in targets.columns:
            return F.array().cast("array<struct<keyword: string, word: string, whole: boolean>>")
        own = F.coalesce(name, F.array().cast("array<string>"))
        word = lambda w: F.lower(strip(w))
        return F.filter(F.transform(own, lambda w: F.struct(
            w.alias("keyword"), word(w).alias("word"), word(w).isin(*WHOLE_WORD_KEYWORDS).alias("whole"))), lambda w: w["word"] != "")

    given = F.col("card_limit") if "card_limit" in targets.columns else F.lit(None)
    asked = F.lit(limit) if limit is not None else F.coalesce(given.cast("int"), F.lit(DEFAULT_LIMIT))
    skips = F.coalesce("bypass", F.lit(False)) if "bypass" in targets.columns and not bypass else F.lit(bypass)
    return targets.select("target_id", words("positive_keywords").alias("own_positive"), words("blocked_keywords").alias("own_blocked"),
                          F.greatest(F.lit(1), F.least(F.lit(MAX_LIMIT), asked)).alias("card_limit"), skips.alias("bypass"))


def classify_cards(cards: DataFrame, positive=POSITIVE_KEYWORDS, blocked=BLOCKED_KEYWORDS,
                   targets: DataFrame | None = None) -> DataFrame:
    """Outcome per card: a blocked keyword wins over a positive one; neither means skipped.

    With ``targets`` (see ``prepared_targets``) the words of the card's target are looked for behind those of all, and
    a target that bypasses the filter gives the outcome ``bypassed`` and no keywords. A card without a target row has
    the words of all only. Targets are one narrow row each; whether they are broadcast is left to Spark's size check.
    """
    text = F.concat_ws(" ", or_blank(F.col("raw_text")), or_blank(F.col("image_alt")))
    # Lowering and matching a whole text happens once, whatever is asked of the result.
    lowered = computed(cards, _text=F.lower(text))
    if targets is None:
        rows = computed(lowered, blocked_hits=matched_keywords(F.col("_text"), blocked),
                        positive_hits=matched_keywords(F.col("_text"), positive)).drop("_text")
        passes = F.lit(False)
    else:
        whole = F.regexp_extract_all("_text", F.lit(rf"(?U)\b({'|'.join(WHOLE_WORD_KEYWORDS)})\b"), 1)
        joined = computed(lowered.join(targets, "target_id", "left"), _whole=whole)
        passes = F.coalesce("bypass", F.lit(False))

        def hits(common, own: str) -> Column:
            found = F.filter(F.coalesce(own, F.array().cast(dict(targets.dtypes)[own])), lambda w: F.when(
                w["whole"], F.array_contains("_whole", w["word"])).otherwise(F.contains("_text", w["word"])))
            every = F.array_distinct(F.concat(matched_keywords(F.col("_text"), common), F.transform(found, lambda w: w["keyword"])))
            return F.when(passes, F.array().cast("array<string>")).otherwise(every)

        rows = computed(joined, blocked_hits=hits(blocked, "own_blocked"), positive_hits=hits(positive, "own_positive")).drop(
            "_text", "_whole", "own_blocked", "own_positive").withColumn("card_limit", F.coalesce("card_limit", F.lit(DEFAULT_LIMIT)))
    outcome = (
        F.when(passes, F.lit("bypassed"))
        .when(F.size("blocked_hits") > 0, F.lit("blocked"))
        .when(F.size("positive_hits") > 0, F.lit("matched"))
        .otherwise(F.lit("skipped"))
    )
    return rows.withColumn("outcome", outcome)


def select_first(rows: DataFrame, key: str, seq: str, limit: int) -> DataFrame:
    """First ``limit`` rows per key in arrival order.

    The row_number bound reaches Spark's group limit, which keeps at most ``limit`` rows per key and task before the
    shuffle.
    """
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    return rows.withColumn("place", place).filter(F.col("place") <= limit)


def target_metrics(classified: DataFrame, hit_limit: int = 20) -> DataFrame:
    """Counts per outcome and the first distinct keywords per target, from one pass over the texts.

    Every card gives one counting entry and one entry per keyword of its outcome. They combine per (target, outcome,
    keyword) before the shuffle; keywords come from the lists of all and of the target, which bound what is collected.
    """
    hits = F.when(F.col("outcome") == "blocked", F.col("blocked_hits")).when(
        F.col("outcome") == "matched", F.col("positive_hits")).otherwise(F.array().cast("array<string>"))
    entries = F.concat(F.array(F.lit(None).cast("string")), hits)
    each = classified.select("target_id", "seq", "outcome", F.posexplode(entries).alias("pos", "keyword"))
    combined = each.groupBy("target_id", "outcome", "keyword").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "pos")).alias("at"))
    card = F.col("keyword").isNull()
    zero = F.lit(0).cast("bigint")
    count = lambda o: F.coalesce(F.sum(F.when(card & (F.col("outcome") == o), F.col("n"))), zero).alias(o)
    words = lambda o: F.slice(F.transform(F.sort_array(F.collect_list(
        F.when(~card & (F.col("outcome") == o), F.struct("at", "keyword")))), lambda x: x["keyword"]), 1, hit_limit)
    return combined.groupBy("target_id").agg(
        F.sum(F.when(card, F.col("n"))).alias("candidates"), count("matched"), count("skipped"), count("blocked"),
        words("matched").alias("matched_keywords"), words("blocked").alias("blocked_keywords"))


def relevance_filter(cards: DataFrame, positive=POSITIVE_KEYWORDS, blocked=BLOCKED_KEYWORDS, limit: int = DEFAULT_LIMIT,
                     targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected cards with their place, metrics per target). Cards carry target_id and arrival number seq.

    With ``targets`` (see ``prepared_targets``) each target has its own words, limit and bypass, and every target has
    metrics, also one without cards; ``limit`` is not used then.
    """
    classified = classify_cards(cards, positive, blocked, targets)
    if targets is None:
        selected = select_first(classified.filter(F.col("outcome") == "matched"), "target_id", "seq", limit)
        return selected, target_metrics(classified)
    # The literal bound is what Spark can push below the shuffle; the target's own limit follows.
    chosen = select_first(classified.filter(F.col("outcome").isin("matched", "bypassed")), "target_id", "seq", MAX_LIMIT)
    selected = chosen.filter(F.col("place") <= F.col("card_limit")).drop("card_limit", "bypass")
    counted = target_metrics(classified).join(targets.select("target_id", "card_limit", "bypass"), "target_id", "full_outer")
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    passed = F.least(F.coalesce("candidates", zero), F.col("card_limit").cast("bigint"))
    return selected, counted.select(
        "target_id", F.coalesce("candidates", zero).alias("candidates"),
        F.when(F.col("bypass"), passed).otherwise(F.coalesce("matched", zero)).alias("matched"),
        F.coalesce("skipped", zero).alias("skipped"), F.coalesce("blocked", zero).alias("blocked"),
        F.coalesce("matched_keywords", none).alias("matched_keywords"), F.coalesce("blocked_keywords", none).alias("blocked_keywords"))


def calibration(selected: DataFrame, metrics: DataFrame, samples: int = 5) -> DataFrame:
    """Per target the counts, keywords and the first five selected titles and ids."""
    first = selected.filter(F.col("place") <= samples).groupBy("target_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "title", "item_id"))).alias("_s"))
    chosen = selected.groupBy("target_id").agg(F.count(F.lit(1)).alias("selected"))
    empty = F.array().cast("array<string>")
    return metrics.join(chosen, "target_id", "left").join(first, "target_id", "left").select(
        "target_id", "candidates", "matched", F.coalesce("selected", F.lit(0).cast("bigint")).alias("selected"),
        "skipped", "blocked", F.coalesce("matched_keywords", empty).alias("matched_keywords"),
        F.coalesce("blocked_keywords", empty).alias("blocked_keywords"),
        F.coalesce(F.transform("_s", lambda x: x["title"]), empty).alias("sample_titles"),
        F.coalesce(F.transform("_s", lambda x: x["item_id"]), empty).alias("sample_ids"))


def pool_cards(selected: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U8: (pooled cards of all targets, first one per identity; one-row outcome).

    Outcome: cards, no_relevant (there were candidates) or no_candidates.
    """
    pooled = dedupe_first(selected, "identity", "seq")
    seen = metrics.agg(F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"))
    chosen = pooled.agg(F.count(F.lit(1)).alias("n"))
    outcome = seen.select("candidates", chosen.scalar().alias("cards")).withColumn(
        "outcome", F.when(F.col("cards") > 0, F.lit("cards")).when(F.col("candidates") > 0, F.lit("no_relevant"))
        .otherwise(F.lit("no_candidates")))
    return pooled, outcome


