"""Distributed ranks, batches, bounded lists and hot-key-safe running values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapak.session import cut_lineage

SEGMENT = 1_000_000
MAX_SEGMENTS = 1000


def assign_rank(rows: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Zero-based global rank without a global window.

    Spark sorts by range, which also splits runs of equal leading values as long as ``order`` ends in a unique
    column. The row number inside a partition plus the size of the earlier partitions is the rank. The sorted rows
    are checkpointed, so a lost executor cannot renumber them.
    """
    sorted_rows = cut_lineage(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # One row per sort partition, so the window without key and the broadcast stay small whatever the table size.
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        sorted_rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + inside)
        .drop("_at", "_part", "_before")
    )


def segmented(rows: DataFrame, seq: str, size: int = SEGMENT, out: str = "_seg") -> DataFrame:
    """Cut all rows by arrival number into segments of about ``size`` rows each, however the numbers are spread.

    The cuts are quantiles of the numbers themselves, found in one pass over that column, so sparse and bursty numbers
    give even segments, and a key with a third of all rows becomes many bounded groups. At most ``MAX_SEGMENTS`` cuts
    reach the driver and go into the plan; beyond, segments grow and their sorts spill.
    """
    place = [k / MAX_SEGMENTS for k in range(1, MAX_SEGMENTS)]
    count, cuts = rows.agg(F.count(F.lit(1)), F.percentile_approx(F.col(seq).cast("double"), place, 10 * MAX_SEGMENTS)).first()
    step = max(1, int(MAX_SEGMENTS * size / max(count, 1)))
    kept = sorted(set((cuts or [])[step - 1::step]))
    if not kept:
        return rows.withColumn(out, F.lit(0))
    from pyspark.ml.feature import Bucketizer

    cutter = Bucketizer(splits=[-math.inf, *kept, math.inf], inputCol="_number", outputCol=out, handleInvalid="keep")
    return cutter.transform(rows.withColumn("_number", F.col(seq).cast("double"))).drop("_number")


def lag_by_key(rows: DataFrame, key: str, seq: str, value: str, out: str, segment_size: int = SEGMENT,
               ahead: tuple[str, str] | None = None) -> DataFrame:
    """Previous value of a key in arrival order, safe for a key that owns a large share of all rows.

    Inside a segment a window gives the previous value. Only the first row of a segment needs the last value of an
    earlier one, which comes from a summary with one row per key and segment. ``ahead`` names a column and the result
    for its next value, which the same pass gives.
    """
    keyed = segmented(rows, seq, segment_size)
    ordered, above = Window.partitionBy(key, "_seg").orderBy(seq), Window.partitionBy(key).orderBy("_seg")
    # Wrapping the value keeps "previous value is null" apart from "no previous row".
    wrap = lambda c: F.struct(F.col(c).alias("v"))
    sides = {"_near": F.lag(wrap(value)).over(ordered)}
    ends = [F.max_by(wrap(value), F.col(seq)).alias("_last")]
    far = [F.lag("_last").over(above).alias("_far")]
    if ahead:
        sides["_near_next"] = F.lead(wrap(ahead[0])).over(ordered)
        ends.append(F.min_by(wrap(ahead[0]), F.col(seq)).alias("_first"))
        far.append(F.lead("_first").over(above).alias("_far_next"))
    within = keyed.withColumns(sides)
    between = keyed.groupBy(key, "_seg").agg(*ends).select(key, "_seg", *far)
    joined = within.join(between, [key, "_seg"], "left")
    previous = F.coalesce("_near", "_far")
    found = joined.withColumn(out, previous["v"]).withColumn(out + "_exists", previous.isNotNull())
    if ahead:
        found = found.withColumn(ahead[1], F.coalesce("_near_next", "_far_next")["v"])
    return found.drop("_seg", "_near", "_far", "_near_next", "_far_next")


def running_since_reset(rows: DataFrame, key: str, seq: str, reset: Column, counted: Column, out: str,
                        segment_size: int = SEGMENT) -> DataFrame:
    """Per row: number of ``counted`` rows of the key since its latest ``reset`` row, in arrival order.

    Works on segments like ``lag_by_key``: counts inside a segment, plus the carry of the segments before it.
    """
    base = segmented(rows, seq, segment_size).withColumn("_reset", reset).withColumn(
        "_counted", counted.cast("bigint"))
    upto = Window.partitionBy(key, "_seg").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    inside = base.withColumn("_c", F.sum("_counted").over(upto))
    inside = inside.withColumn("_mark", F.max(F.when(F.col("_reset"), F.col("_c"))).over(upto))
    summary = inside.groupBy(key, "_seg").agg(F.sum("_counted").alias("_n"), F.max("_mark").alias("_m"))
    earlier = Window.partitionBy(key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    placed = summary.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    carry = placed.select(key, "_seg", "_base", F.coalesce(
        F.max(F.col("_base") + F.col("_m")).over(earlier), F.lit(0)).alias("_last_mark"))
    total = F.col("_base") + F.col("_c")
    since = total - F.coalesce(F.col("_base") + F.col("_mark"), F.col("_last_mark"))
    return (
        inside.join(carry, [key, "_seg"])
        .withColumn(out, since)
        .drop("_seg", "_reset", "_counted", "_c", "_mark", "_base", "_last_mark")
    )


def dedupe_last(rows: DataFrame, key, seq: str) -> DataFrame:
    """The latest row per key. Spark keeps one row per key and task before the shuffle (group limit), so a key
    with very many copies never meets in one task."""
    return _nth(rows, key, F.col(seq).desc())


def dedupe_first(rows: DataFrame, key, seq: str, keep_blank: bool = False) -> DataFrame:
    """The earliest row per key. Rows with a blank key are dropped, or all kept with ``keep_blank``."""
    k = key if isinstance(key, Column) else F.col(key)
    blank = F.coalesce(k, F.lit("")) == ""
    if not keep_blank:
        return _nth(rows.filter(~blank), key, F.col(seq).asc())
    # A blank row forms a group of its own, so blanks neither merge nor gather in one task.
    return _nth(rows, [k, F.when(blank, F.col(seq))], F.col(seq).asc())


def _nth(rows: DataFrame, key, order: Column) -> DataFrame:
    keys = key if isinstance(key, (list, tuple)) else [key]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def dedupe_summary(rows: DataFrame, key: str) -> DataFrame:
    """Requested, deduplicated and duplicate counts of a batch; counts combine before the shuffle."""
    per_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("requested"),
        F.count(F.lit(1)).alias("deduplicated"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )


def first_seen_order(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Last row per key together with the arrival number of its first one."""
    first = rows.groupBy(key).agg(F.min(seq).alias("first_seq"))
    return dedupe_last(rows, key, seq).join(first, key)


def latest_per(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest record per key as one partial aggregation."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(
        F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(key, *[f"_r.{c}" for c in others])


def recent_ids(seen: DataFrame, limit: int = 500, value: str = "value", at: str = "seen_at") -> DataFrame:
    """Newest distinct values, newest first; ties by value."""
    newest = seen.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(value).agg(F.max(at).alias(at))
    return newest.orderBy(F.col(at).desc(), F.col(value)).limit(limit)


def merge_seen(seen: DataFrame, fresh: DataFrame, limit: int = 500) -> DataFrame:
    """New identifiers before old ones, bounded."""
    return recent_ids(seen.unionByName(fresh), limit)


def miss_list(misses: DataFrame, limit: int = 1000) -> DataFrame:
    """The bounded list of lookups to skip, latest retry first."""
    return misses.orderBy(F.col("retry_at").desc(), "external_id").limit(limit)


def id_scan(rows: DataFrame, after_id: str = "", limit: int = 25, key: str = "id") -> DataFrame:
    """Next rows in id order behind ``after_id``; the bound reaches the scan."""
    return rows.filter(F.col(key) > after_id).orderBy(key).limit(limit)


def pack_batches(rows: DataFrame, order: list[Column], size: int, item: Column) -> DataFrame:
    """Fixed-size batches of text items in a global order; a batch holds at most ``size`` rows, so collecting it is
    bounded."""
    placed = assign_rank(rows, order, "_rank").select(
        F.floor(F.col("_rank") / size).alias("batch"), "_rank", item.alias("_item"))
    grouped = placed.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("_rank", "_item"))).alias("_all"))
    return grouped.select("batch", F.transform("_all", lambda x: x["_item"]).alias("items"))
