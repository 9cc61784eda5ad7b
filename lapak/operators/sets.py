"""Unions, seen-set filters and set differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lapak.functions.text import blank_to_null
from lapak.functions.urls import reddit_id, reddit_url
from lapak.operators.ordering import dedupe_first, dedupe_last, dedupe_summary


def union_connectors(outputs: list[DataFrame]) -> DataFrame:
    """All connector outputs; a missing column becomes null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outputs)


def new_listings(rows: DataFrame, seen_ids: DataFrame, seen_urls: DataFrame) -> DataFrame:
    """Rows whose external id and URL are both unseen; a blank value never counts as seen."""
    ids = seen_ids.select(F.nullif("value", F.lit("")).alias("external_id")).filter("external_id is not null").distinct()
    urls = seen_urls.select(F.nullif("value", F.lit("")).alias("source_url")).filter("source_url is not null").distinct()
    return rows.join(ids, "external_id", "left_anti").join(urls, "source_url", "left_anti")


def needs_detail(rows: DataFrame, seen_ids: DataFrame, seen_urls: DataFrame, scope: str = "new") -> DataFrame:
    """Rows whose detail page should be read; scope 'all' asks for every row."""
    return rows if scope == "all" else new_listings(rows, seen_ids, seen_urls)


def dedupe_batch(rows: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(last row per source URL, counts); a blank URL is an error."""
    url = blank_to_null(F.col("source_url"))
    keyed = rows.withColumn("source_url", F.when(
        url.isNull(), F.raise_error(F.lit("cannot write a listing without source_url"))).otherwise(url))
    return dedupe_last(keyed, "source_url", seq), dedupe_summary(keyed, "source_url")


def post_identity():
    """Post id, else canonical URL, else feed id."""
    return F.coalesce(reddit_id(F.col("url"), F.col("atom_id")), F.nullif(reddit_url(F.col("url")), F.lit("")),
                      F.col("atom_id"), F.lit(""))


def dedupe_posts(posts: DataFrame, seq: str = "seq") -> DataFrame:
    """U4: first post per identity; posts without identity all stay."""
    return dedupe_first(posts.withColumn("identity", post_identity()), "identity", seq, keep_blank=True)


def missing_members(required: DataFrame, observed: DataFrame, column: str) -> DataFrame:
    """Required values that were never observed."""
    return required.select(column).join(observed.select(column), column, "left_anti")

