"""Operational alerts: what workers, capacity and audits report, as coded rows with a severity and a recommendation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code, severity, recommendation.
ALERTS = (
    ("artifact_records_missing", "warning", "run_output_audit"),
    ("event_spool_backlog", "warning", "replay_spool_backlog"),
    ("fallback_usage", "warning", "review_fallback_usage"),
    ("log_spool_backlog", "warning", "replay_spool_backlog"),
    ("manifest_integrity_attention", "warning", "rerun_manifest_integrity"),
    ("migration_drift", "error", "apply_pending_migrations"),
    ("output_audit_not_reported", "warning", "run_output_audit"),
    ("shard_update_spool_backlog", "warning", "replay_spool_backlog"),
    ("stage_failures", "error", "investigate_stage_failures"),
    ("stale_shard_lease", "warning", "reclaim_stale_leases"),
    ("stale_worker_heartbeat", "warning", "restore_worker_heartbeat"),
    ("throughput_samples_insufficient", "warning", "collect_more_throughput_samples"),
    ("worker_capacity_exhausted", "warning", "add_worker_capacity"),
    ("worker_resource_pressure", "warning", "relieve_worker_resource_pressure"),
)
ENOUGH_SAMPLES = 10


def _count(column: Column) -> Column:
    """Null and negative counts are 0."""
    return F.greatest(F.coalesce(column.cast("long"), F.lit(0)), F.lit(0))


def _yes(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def worker_facts(workers: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Per scope the workers that are stale or under pressure, and what lies in their spools.

    workers: scope, stale, constrained, events, logs, updates (each array<long>: pending, failed, dropped; null: none).
    """
    held = lambda name: F.coalesce(F.sum(F.aggregate(F.col(name), F.lit(0).cast("long"), lambda acc, x: acc + _count(x))), F.lit(0))
    return workers.groupBy(*scope).agg(
        F.count_if(_yes("stale")).alias("stale_workers"), F.count_if(_yes("constrained")).alias("constrained_workers"),
        held("events").alias("event_spool"), held("logs").alias("log_spool"), held("updates").alias("update_spool"),
    )


def active_alerts(facts: DataFrame, scope: Sequence[str]) -> DataFrame:
    """scope, code, severity, recommendation, count: the alerts that hold, from one row of facts per scope.

    facts: scope; migrated, current (boolean), drifted; the columns of `worker_facts`; capacity_known, queue, slots,
    stale_leases, sample_pages, confidence; audit_known, stage_failures, fallbacks, manifests_open, declared, missing,
    completed, output_reported. Nothing is told of capacity or audit unless it is known; a null count is 0, a database
    of unknown state drifts by one. Several rows of a scope are told separately; no rows give none.
    """
    n = {c: _count(F.col(c)) for c in (
        "drifted", "stale_workers", "constrained_workers", "event_spool", "log_spool", "update_spool", "queue", "slots", "stale_leases",
        "sample_pages", "stage_failures", "fallbacks", "manifests_open", "declared", "missing", "completed",
    )}
    settled = _yes("migrated") & _yes("current")
    if_capacity = lambda holds, count: F.when(_yes("capacity_known") & holds, count)
    if_audit = lambda holds, count: F.when(_yes("audit_known") & holds, count)
    evidence = n["declared"] + n["missing"] + n["completed"]
    counts = {
        "migration_drift": F.greatest(n["drifted"], F.when(settled, 0).otherwise(1)),
        "stale_worker_heartbeat": n["stale_workers"], "worker_resource_pressure": n["constrained_workers"], "event_spool_backlog": n["event_spool"],
        "log_spool_backlog": n["log_spool"], "shard_update_spool_backlog": n["update_spool"],
        "worker_capacity_exhausted": if_capacity(n["slots"] == 0, n["queue"]), "stale_shard_lease": if_capacity(F.lit(True), n["stale_leases"]),
        "throughput_samples_insufficient": if_capacity((n["queue"] > 0) & (F.col("confidence") == "none"), F.greatest(ENOUGH_SAMPLES - n["sample_pages"], F.lit(1))),
        "stage_failures": if_audit(F.lit(True), n["stage_failures"]), "fallback_usage": if_audit(F.lit(True), n["fallbacks"]),
        "manifest_integrity_attention": if_audit(F.lit(True), n["manifests_open"]), "artifact_records_missing": if_audit(F.lit(True), n["missing"]),
        "output_audit_not_reported": if_audit((evidence > 0) & ~_yes("output_reported"), F.lit(1)),
    }
    rows = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.lit(r).alias("recommendation"), counts[c].cast("long").alias("count")) for c, s, r in ALERTS))
    return facts.select(*scope, F.inline(F.filter(rows, lambda a: F.coalesce(a["count"], F.lit(0)) > 0)))
