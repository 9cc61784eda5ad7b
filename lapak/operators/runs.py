"""Run logs: connector records, counts, yield, readiness, failure streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapak.functions.text import or_blank
from lapak.operators.ordering import latest_per, running_since_reset
from lapak.schemas import STORAGE_COUNTERS

# States of the run report.
DEGRADED = ("degraded", "failed", "rate_limited", "login_blocked", "blocked_or_empty")
HEALTHY = ("success", "no_new_data", "cooldown_skip")
REQUIRED_CONNECTORS = ("reddit", "instagram", "facebook")


def explode_candidates(runs: DataFrame) -> DataFrame:
    """One row per candidate of a run's connectors; a connector without a candidate list gives its listings.

    ``runs``: run_id, connectors array<struct<connector, candidates array<struct>, listings array<struct>>>.
    """
    each = runs.select("run_id", F.explode("connectors").alias("_c"))
    records = F.coalesce("_c.candidates", "_c.listings")
    return each.select("run_id", F.col("_c.connector").alias("connector"), F.explode(records).alias("_r")).filter(
        F.col("_r").isNotNull()).select("run_id", "connector", "_r.*")


def _split(logs: DataFrame):
    return (logs.filter(F.col("source") == "scheduler"), logs.filter(F.col("source") == "orchestrator"))


def summary_source(logs: DataFrame) -> DataFrame:
    """Records that carry connectors and storage: orchestrator records, or scheduler summaries when there are none.

    The choice is one EXISTS test inside the plan; no second job decides it.
    """
    any_orchestrator = logs.filter(F.col("source") == "orchestrator").select("source").exists()
    direct = F.col("source") == "orchestrator"
    chosen = logs.filter(direct | ((F.col("source") == "scheduler") & ~any_orchestrator))
    pick = lambda name: F.when(direct, F.col(name)).otherwise(F.col(f"summary.{name}")).alias(name)
    return chosen.select("log_time", "logged_at", "file_name", "line", pick("connectors"), pick("storage"))


def connector_records(logs: DataFrame) -> DataFrame:
    """One row per connector entry, with log time, file and its place."""
    rows = summary_source(logs).select(
        "log_time", "logged_at", "file_name", "line", F.posexplode("connectors").alias("place", "_c"))
    return rows.filter(F.col("_c").isNotNull()).select("log_time", "logged_at", "file_name", "line", "place", "_c.*")


def status_counts(logs: DataFrame) -> DataFrame:
    """Scheduler records by status and connector records by connector and status."""
    named = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    scheduler, _ = _split(logs)
    runs = scheduler.select(F.lit("(scheduler)").alias("connector"), named("status").alias("status"))
    parts = connector_records(logs).select(named("connector").alias("connector"), named("status").alias("status"))
    return runs.union(parts).groupBy("connector", "status").agg(F.count(F.lit(1)).alias("count"))


def run_totals(logs: DataFrame) -> DataFrame:
    """One row with everything the run report counts, from one pass over the log.

    Each figure is counted for orchestrator records and for scheduler summaries side by side; the first set is taken
    when there is any orchestrator record.
    """
    zero = F.lit(0).cast("bigint")
    scheduler, orchestrator = F.col("source") == "scheduler", F.col("source") == "orchestrator"
    sides = {"o": (orchestrator, "connectors", "storage"), "s": (scheduler, "summary.connectors", "summary.storage")}
    counts = [F.count_if(orchestrator).alias("_any"), F.count_if(scheduler & (F.col("status") == "success")).alias("runs_ok"),
              F.count_if(scheduler & _is_bad(F.col("status"), F.col("ok"))).alias("_bad_runs")]
    for side, (test, connectors, storage) in sides.items():
        matching = lambda rule: F.sum(F.when(test, F.coalesce(F.size(F.filter(F.col(connectors), rule)), F.lit(0))))  # noqa: E731, B023
        counts += [F.sum(F.when(test, F.coalesce(F.col(f"{storage}.summary.{c}"), zero))).alias(f"{side}_{c}")
                   for c in STORAGE_COUNTERS]
        counts += [matching(lambda c: c["status"] == "success").alias(f"{side}_parts_ok"),
                   matching(lambda c: c.isNotNull() & _is_bad(c["status"], c["ok"])).alias(f"{side}_bad")]
    pick = lambda name: F.coalesce(F.when(F.col("_any") > 0, F.col(f"o_{name}")).otherwise(F.col(f"s_{name}")), zero)
    return logs.agg(*counts).select(
        *[pick(c).alias(c) for c in STORAGE_COUNTERS], "runs_ok", pick("parts_ok").alias("parts_ok"),
        (F.col("_bad_runs") + pick("bad")).alias("degraded_events"))


def _is_bad(status, ok):
    return F.coalesce(status.isin(*DEGRADED), F.lit(False)) | F.coalesce(~ok, F.lit(False))


def storage_totals(logs: DataFrame) -> DataFrame:
    """A10: one row with the sums of the seven write counters."""
    return run_totals(logs).select(*STORAGE_COUNTERS)


def yield_summary(logs: DataFrame) -> DataFrame:
    """Writes per successful run; the denominator falls back to connector runs, then to one."""
    denominator = F.coalesce(F.nullif("runs_ok", F.lit(0)), F.nullif("parts_ok", F.lit(0)), F.lit(1))
    share = F.when(F.col("requested") > 0, F.bround(F.col("inserted") / F.col("requested"), 4)).otherwise(F.lit(0.0))
    return run_totals(logs).select(
        F.col("requested").alias("requested_listings"), F.col("inserted").alias("new_listings_inserted"),
        F.col("updated").alias("existing_listings_updated"), F.col("duplicates").alias("duplicate_inputs"),
        (F.col("inserted") + F.col("updated")).alias("useful_writes"),
        F.bround(F.col("inserted") / denominator, 2).alias("new_per_successful_run"), share.alias("inserted_share"))


def latest_connector_status(logs: DataFrame) -> DataFrame:
    """The last record per connector in log order; equal times go by file and line."""
    rows = connector_records(logs).filter(or_blank(F.col("connector")) != "")
    return latest_per(rows, "connector", ["log_time", "file_name", "line", "place"])


def degraded_events(logs: DataFrame) -> DataFrame:
    """Scheduler and connector records in a bad state; scheduler records count as earlier (``part``)."""
    bad = _is_bad(F.col("status"), F.col("ok"))
    scheduler, _ = _split(logs)
    runs = scheduler.filter(bad).select(
        F.lit(0).alias("part"), "log_time", "file_name", "line", F.lit(0).alias("place"),
        F.coalesce("job_id", "source").alias("name"), "status")
    parts = connector_records(logs).filter(bad).select(
        F.lit(1).alias("part"), "log_time", "file_name", "line", "place", F.col("connector").alias("name"), "status")
    return runs.union(parts)


def latest_degraded(logs: DataFrame, limit: int = 5) -> DataFrame:
    """The last five bad records, oldest of them first."""
    order = ["part", "log_time", "file_name", "line", "place"]
    last = degraded_events(logs).orderBy(*[F.col(c).desc() for c in order]).limit(limit)
    return last.orderBy(*order)


def readiness(logs: DataFrame, required=REQUIRED_CONNECTORS) -> DataFrame:
    """One row; ready when every required connector was seen, is healthy now, something was written and no bad
    record exists."""
    latest = latest_connector_status(logs)
    wanted = F.col("connector").isin(*required)
    healthy = or_blank(F.col("status")).isin(*HEALTHY)
    state = latest.agg(
        (F.count_if(wanted) == len(required)).alias("all_connectors_observed"),
        (F.count_if(wanted & healthy) == len(required)).alias("latest_connectors_ready"))
    totals = run_totals(logs).select(F.struct(
        (F.col("inserted") + F.col("updated") > 0).alias("written"), "degraded_events").alias("t")).scalar()
    rows = state.withColumn("_t", totals).select(
        "all_connectors_observed", "latest_connectors_ready", F.col("_t.written").alias("has_storage_writes"),
        F.col("_t.degraded_events").alias("degraded_events"))
    return rows.withColumn("ready", F.col("all_connectors_observed") & F.col("latest_connectors_ready")
                           & F.col("has_storage_writes") & (F.col("degraded_events") == 0))


def run_summary(records: DataFrame) -> DataFrame:
    """Per run the connectors that succeeded or failed, listings, contract errors and duration.

    ``records``: run_id, started_at, finished_at and one row per connector with ok, validated, validation_errors.
    """
    span = F.timestamp_diff("MICROSECOND", F.min("started_at"), F.max("finished_at"))
    zero = F.lit(0).cast("bigint")
    return records.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("connectors"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum("validated"), zero).alias("listings"),
        F.coalesce(F.sum("validation_errors"), zero).alias("validation_errors"),
        F.floor(span / 1000).alias("duration_ms"))


def failure_streaks(runs: DataFrame, backoff=(300, 900, 1800), cadence_seconds: int = 180,
                    key: str = "job_id", seq: str = "seq") -> DataFrame:
    """Length of the failure streak at every run and the delay until the next one.

    A streak counts degraded runs since the last run in any other state; the delay grows along ``backoff`` and stays
    at its last step; without steps it is always the cadence. Jobs are split into segments, so a job with very many runs is no bottleneck.
    """
    bad = F.col("status") == "degraded"
    counted = running_since_reset(runs, key, seq, reset=~bad, counted=bad, out="streak")
    if not backoff:
        return counted.withColumn("delay_seconds", F.lit(cadence_seconds))
    steps = F.array(*[F.lit(int(s)) for s in backoff])
    delay = F.when(F.col("streak") > 0, F.element_at(steps, F.least(F.col("streak"), F.lit(len(backoff))).cast("int")))
    return counted.withColumn("delay_seconds", F.coalesce(delay, F.lit(cadence_seconds)))
