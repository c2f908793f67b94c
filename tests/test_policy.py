"""Decisions and repairs on the cases that tell their rules apart."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sheaf.functions import model_output as M
from sheaf.functions import values as V
from sheaf.operators import alerts as A
from sheaf.operators import policy as P
from sheaf.sources import scratch


def test_certification(spark):
    profiles = spark.createDataFrame(
        [
            (1, "off", None, None, None, None, None), (2, "verified", "contract_only", "r", True, "r", False), (3, "verified", "verified", None, False, None, None),
            (4, "verified", "verified", None, True, None, None), (5, "certified", "verified", "r", True, "r", False), (6, "certified", "certified", "r", None, "x", None),
            (7, "certified", "certified", "r", None, "r", False), (8, "certified", "certified", "r", None, "r", False), (9, "certified", "certified", "r", None, "r", False), (10, "verified", "certified", "", None, None, None),
        ],
        "profile_id int, enforcement string, status string, revision string, risk_accepted boolean, build_revision string, build_dirty boolean",
    )
    candidates = spark.createDataFrame([(6, "r", False), (7, "r", False), (7, "r", False), (8, "q", False), (8, "r", False)], "profile_id int, revision string, dirty boolean")
    got = {r["profile_id"]: (r["decision"], r["affected"]) for r in P.certification(profiles, candidates).collect()}
    assert got == {
        1: ("allowed", 0), 2: ("mismatch", 0), 3: ("risk_acceptance_required", 0), 4: ("allowed", 0), 5: ("mismatch", 0), 6: ("missing", 0),
        7: ("allowed", 0), 8: ("mismatch", 1), 9: ("missing", 0), 10: ("missing", 0),
    }


def test_resume(spark):
    cases = [((True, False, True, True, 5, True), "snapshot_mismatch"), ((True, True, False, True, 5, True), "path_mismatch"), ((True, True, True, False, 5, True), "artifacts_incomplete"), ((True, True, True, True, None, True), "done"), ((False, False, False, False, 5, True), "sidecar_missing"), ((False, False, False, False, 5, False), "done"), ((False, False, False, False, 0, False), "empty_markdown"), ((False, False, False, False, None, False), "new")]
    for values, want in cases:
        columns = [F.lit(v) if v is not None else F.lit(None).cast("int") for v in values]
        assert spark.range(1).select(P.resume_decision(*columns)).first()[0] == want


def test_execution_limit(spark):
    limit = lambda c, r, *s: spark.range(1).select(P.execution_limit(F.lit(c), F.array(*map(F.lit, r)).cast("array<string>"), *map(F.lit, s))).first()[0]
    assert tuple(limit(True, ["memory"], 5)) == (True, 1, "memory") and tuple(limit(True, [], 5)) == (True, 1, "resource_pressure")
    assert tuple(limit(False, [], 0, -1, 7)) == (False, 7, "ready") and tuple(limit(False, [], 0)) == (False, 1, "ready")


def test_preflight(spark):
    jobs = spark.createDataFrame(
        [(1, "/d/x", "/out", "/m", None, None, None, None), (2, "/data", "/out", None, None, None, None, None), (3, "/d", "/out", None, ["b"], 9, False, "gate"), (4, "/d/", "/out/a", None, ["a", "z"], 1, False, None), (5, None, None, None, [], 1, True, None)],
        "job_id int, input_dir string, output_dir string, manifest_root string, allowed array<string>, profile_id int, has_key boolean, gate string",
    )
    workers = spark.createDataFrame(
        [
            ("a", "online", False, False, "1", False, 0, 0, [("/d/", True, True), ("/out", True, True), ("/d", True, False)]),
            ("b", "busy", None, None, "2", True, 4, 1, [("/d", True, None), ("/out", True, False), ("/m", True, True)]),
            ("c", "online", True, False, "3", True, 4, 1, [("/", True, True)]), ("d", "offline", False, False, "3", True, 4, 1, [("/", True, True)]), ("e", "idle", False, False, "3", True, 4, 1, None),
        ],
        "server_id string, status string, stale boolean, archived boolean, version string, constrained boolean, event_backlog int, update_backlog int, paths array<struct<path: string, readable: boolean, writable: boolean>>",
    )
    profiles = spark.createDataFrame([(1, True, False, True)], "profile_id int, requires_key boolean, has_key boolean, key_saved boolean")
    got = {r["job_id"]: tuple(r)[1:] for r in P.preflight(jobs, workers, profiles).collect()}
    mixed = "mixed_worker_versions:warning,resource_constrained_workers:warning,worker_event_spool_backlog:warning,worker_pending_shard_update_backlog:warning"
    assert got == {
        1: (False, 5, 2, 1, "output_path_not_writable:error,manifest_root_not_writable:error," + mixed), 2: (False, 5, 0, 0, "no_eligible_workers:error"),
        3: (False, 1, 1, 0, "output_path_not_writable:error," + mixed.split(",", 1)[1] + ",unknown_model_profile:error,gate:error"),
        4: (False, 1, 1, 1, "model_profile_missing_api_key:error"), 5: (False, 5, 0, 0, "no_eligible_workers:error,model_profile_saved_api_key:warning"),
    }
    calm = spark.createDataFrame([(1, "/d", "/d", None, ["a"], None, None, "gate")], jobs.schema)
    issues = lambda **s: P.preflight(calm, workers, profiles, **s).first()["issues"]
    assert issues() == "" and issues(dialect="sqlite", migrations="missing") == "database_not_postgres:warning"
    assert issues(migrations="not_current", has_token=False, detail_limit=100_001) == "database_migration_not_current:error,control_api_auth_disabled:warning,high_detail_row_limits:warning"


JOBS = "job_id int, input_dir string, output_dir string, manifest_root string, allowed array<string>, profile_id int, has_key boolean, gate string"
WORKERS = "server_id string, status string, stale boolean, archived boolean, version string, constrained boolean, event_backlog int, update_backlog int, paths array<struct<path: string, readable: boolean, writable: boolean>>"
PROFILES = "profile_id int, requires_key boolean, has_key boolean, key_saved boolean"


def most_joined(node) -> int:
    """Rows of the largest join of a plan that has run."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return most_joined(node.executedPlan())
    if "QueryStage" in name:
        return most_joined(node.plan())
    rows = node.metrics().get("numOutputRows") if "Join" in name else None
    children = node.children()
    return max([rows.get().value() if rows is not None and rows.isDefined() else 0, *(most_joined(children.apply(k)) for k in range(children.size()))])


def test_preflight_joins_kinds_of_jobs_not_jobs(spark):
    jobs = spark.range(2000).select(
        F.col("id").cast("int").alias("job_id"), F.concat(F.lit("/in/n/"), F.col("id")).alias("input_dir"), F.concat(F.lit("/out/"), F.col("id")).alias("output_dir"), F.lit(None).cast("string").alias("manifest_root"),
        F.when(F.col("id") % 100 == 7, F.array(F.lit("3"), F.lit("x"))).alias("allowed"), F.lit(None).cast("int").alias("profile_id"), F.lit(False).alias("has_key"), F.lit(None).cast("string").alias("gate"),
    )
    workers = spark.createDataFrame([(str(k), "idle", False, False, "1", False, 0, 0, [("/in/", True, False), ("/in/n", True, False), ("/out", True, k != 5)]) for k in range(300)], WORKERS)
    told = P.preflight(jobs, workers, spark.createDataFrame([], PROFILES))
    rows = told.collect()
    blocked = (False, 300, 300, 300, "output_path_not_writable:error")
    assert len(rows) == 2000 and all(tuple(r)[1:] == ((True, 1, 1, 1, "") if r["job_id"] % 100 == 7 else blocked) for r in rows)
    assert 0 < most_joined(told._jdf.queryExecution().executedPlan()) <= 4000  # pairs of jobs and workers: 594 000


@pytest.mark.parametrize("limit", [scratch.BROADCAST_BYTES, -1])
def test_preflight_by_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", limit)
    draw = random.Random(5)
    folders = [None, "", "/", "//", "/a", "/a/", "/a/b", "/a/b//", "/a//b", "/ab", "a", "a/b", ".", "./a"]
    flag = lambda: draw.choice([True, True, False, None])
    pick = lambda *of: draw.choice(of)
    jobs = [
        (k, pick(*folders, "/a/b/c", "/a/b/d/"), pick(*folders, "/a/o"), pick(*folders), pick(None, None, [], [None], ["1", "1", None, "z"], [str(draw.randrange(12)) for _ in range(3)]), pick(None, 1, 2), flag(), pick(None, "gate"))
        for k in range(150)
    ]
    workers = [
        (str(k), pick("idle", "online", "busy", "offline", None, "idle"), pick(False, False, True, None), pick(False, False, True, None), pick(None, "", "1", "2"), flag(), pick(None, 0, 1), pick(None, 0, 1),
         pick(None, *[[(draw.choice(folders), flag(), flag()) for _ in range(n)] for n in (0, 1, 2, 3, 4, 4, 5)]))
        for k in range(12)
    ]

    def bare(path):
        return path and (path.rstrip("/") or "/")

    def holds(folder, path):
        path = bare(path)
        return bool(folder is not None and path) and bare(folder) in {"/", path, *(path[:k] for k in range(1, len(path)) if path[k] == "/")}

    def want(job):
        _, input_dir, output_dir, manifest, allowed, profile, has_key, gate = job
        mine = [w for w in workers if not allowed or w[0] in allowed]
        fit = [w for w in mine if not w[2] and not w[3] and (w[1] or "offline") != "offline" and any(r and holds(p, input_dir) for p, r, _ in w[8] or [])]
        writes = lambda w, path: any(r and x and holds(p, path) for p, r, x in w[8] or [])
        found = {
            "no_eligible_workers:error": not fit, "output_path_not_writable:error": any(not writes(w, output_dir) for w in fit),
            "manifest_root_not_writable:error": manifest is not None and any(not writes(w, manifest) for w in fit), "mixed_worker_versions:warning": len({w[4] or "" for w in fit}) > 1,
            "resource_constrained_workers:warning": any(w[5] for w in fit), "worker_event_spool_backlog:warning": any(w[6] for w in fit), "worker_pending_shard_update_backlog:warning": any(w[7] for w in fit),
            "unknown_model_profile:error": profile == 2, "model_profile_missing_api_key:error": profile == 1 and not has_key, "model_profile_saved_api_key:warning": profile == 1 and has_key, f"{gate}:error": profile and gate,
        }
        issues = list(itertools.compress(found, found.values()))
        return not any(i.endswith(":error") for i in issues), len(mine), len(fit), sum(w[1] in ("online", "idle") for w in fit), ",".join(issues)

    got = P.preflight(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(workers, WORKERS), spark.createDataFrame([(1, True, False, True)], PROFILES)).collect()
    assert {r["job_id"]: tuple(r)[1:] for r in got} == {job[0]: want(job) for job in jobs} and len(got) == 150


def test_alerts(spark):
    columns = "migrated boolean, current boolean, drifted int, stale_workers int, constrained_workers int, event_spool int, log_spool int, update_spool int, capacity_known boolean, queue int, slots int, stale_leases int, sample_pages int, confidence string, audit_known boolean, stage_failures int, fallbacks int, manifests_open int, declared int, missing int, completed int, output_reported boolean"
    quiet = dict.fromkeys((c.split()[0] for c in columns.split(", ")), None) | {"migrated": True, "current": True}
    cases = [
        quiet, quiet | {"current": None}, quiet | {"queue": 3, "stale_leases": 2, "stage_failures": 1},
        quiet | {"capacity_known": True, "queue": 3, "sample_pages": 12, "confidence": "none", "stale_leases": 2, "drifted": 4},
        quiet | {"audit_known": True, "stage_failures": -1, "fallbacks": 2, "completed": 1, "missing": 5}, quiet | {"audit_known": True, "completed": 1, "output_reported": True},
    ]
    facts = spark.createDataFrame([(k, *c.values()) for k, c in enumerate(cases)], "id int, " + columns)
    got = {}
    for r in A.active_alerts(facts, ["id"]).collect():
        got.setdefault(r["id"], {})[r["code"]] = r["count"]
    assert got == {
        1: {"migration_drift": 1}, 3: {"migration_drift": 4, "worker_capacity_exhausted": 3, "stale_shard_lease": 2, "throughput_samples_insufficient": 1},
        4: {"fallback_usage": 2, "artifact_records_missing": 5, "output_audit_not_reported": 1},
    }
    workers = spark.createDataFrame([(1, True, None, [2, -1, None], None, []), (1, None, True, [1], [3], None)], "id int, stale boolean, constrained boolean, events array<long>, logs array<long>, updates array<long>")
    assert tuple(A.worker_facts(workers, ["id"]).first()) == (1, 1, 1, 3, 3, 0)


def test_bundles_and_roots(spark):
    keys = F.array(*map(F.lit, ("b/s/s.md", "b/s/pages/1.json", "other/s_layout.pdf")))
    complete = lambda *kinds: spark.range(1).select(P.bundle_complete(keys, F.lit("b/s"), F.lit("s"), F.array(*map(F.lit, kinds)))).first()[0]
    assert complete("markdown", "page_json") and not complete("layout_pdf") and not complete("image")
    inputs = spark.createDataFrame([(1, "/r/a/b.pdf", "a/b.pdf"), (1, "/r/c.pdf", "c.pdf"), (2, "/r/a.pdf", "a.pdf"), (2, "/s/a.pdf", "a.pdf"), (3, "/x.pdf", "y.pdf")], "job_id int, input_path string, relative_path string")
    assert {r["job_id"]: r["root"] for r in P.manifest_root(inputs).collect()} == {1: "/r", 2: None, 3: None}


def test_model_answers(spark):
    one = '{"bbox": [1,2,3,4], "category": "Text", "text": "a"}'
    two = '{"bbox": [5,6,7,8], "category": "Title", "text": "b"}'
    get = lambda t: spark.createDataFrame([(t,)], "t string").select(M.parsed_cells(F.col("t"))).first()[0]
    assert [c["text"] for c in get(f"[{one}, {two}]")] == ["a", "b"] and [c["text"] for c in get(f"{one} {two}")][:1] == ["a"]
    assert [c["text"] for c in get('[{"bbox":[1,2,3,4],"category":"Text","text":"a"},{"bbox":[5,6,7,8],"category":"Ti')] == ["a"]
    assert [c["text"] for c in get(f"[{one}, {one}, {two}]")] == ["a", "b"]
    assert get("nothing at all") == []
    cells = [([1.0, 2.0, 3.0, 4.0], "Text", "a"), ([1.0, 2.0, 3.0], "Text", "b"), ([1.0], "Text", "c"), (None, "Text", "d"), (None, None, "e")]
    frame = spark.createDataFrame([(cells,)], f"c array<{M.CELL}>")
    assert [(c["bbox"], c["text"]) for c in frame.select(M.usable_cells(F.col("c"))).first()[0]] == [([1.0, 2.0, 3.0, 4.0], "a"), (None, "b"), (None, "d")]


def test_values(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(V.whole_number(F.lit(x))) for x in (" 7 ", "-3", "2.7", "x")] == [7, 0, 0, 0]
    assert one(V.half_width(F.lit("ＡＢ１！　x"))) == "AB1! x" and one(V.split_list(F.lit("a, b;a\n、c"))) == ["a", "b", "c"]
    assert one(V.redacted(F.create_map(F.lit("API_KEY"), F.lit("x"), F.lit("name"), F.lit("y")))) == {"API_KEY": "[redacted]", "name": "y"}
    assert one(V.has_suffix(F.lit("a.TAR.gz"), "tar.gz")) is True and one(V.label_code(F.lit("E2-name"))) == "E2"
    cells = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(t).alias("text")) for c, t in (("Title", "t"), ("Text", "x"), ("Text", "**Abstract**: y"), ("Text", "z"))))
    assert [r["text"] for r in one(V.trimmed_front(cells))] == ["t", "**Abstract**: y", "z"]
