"""Run ledgers: planned against attempted runs, times, artifacts, metrics and reported claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import ledger as L
from auditloom.functions.text import norm
from auditloom.operators.findings import finding, union


def planned_runs(planned: DataFrame, attempts: DataFrame, fields: list[str]) -> DataFrame:
    """Runs never attempted, attempts of no planned run, and attempts whose fields differ from their plan."""
    done = attempts.select("run_id").distinct()
    known = planned.select("run_id").distinct()
    j = attempts.alias("a").join(planned.alias("p"), "run_id")
    bad = F.filter(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"p.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    off = j.select("run_id", F.col("a.attempt_id").alias("attempt_id"), F.explode(bad).alias("field"))
    return union([
        finding(planned.join(done, "run_id", "left_anti"), "error", "never_attempted", F.col("run_id"), F.lit("a planned run has no attempt")),
        finding(attempts.join(known, "run_id", "left_anti"), "error", "unplanned", F.col("attempt_id"), F.concat(F.lit("no planned run "), F.coalesce("run_id", F.lit("")))),
        finding(off, "error", "differs_from_plan", F.col("attempt_id"), F.concat(F.lit("field "), F.col("field"))),
    ])


def missing_cells(attempts: DataFrame, unit: str, condition: str, declared: list[str]) -> DataFrame:
    """unit, condition of the declared conditions that a unit was never run under; every unit is expanded by the declared list, without a join."""
    done = attempts.select(unit, condition).distinct()
    planned = done.select(unit).distinct().select(unit, F.explode(F.array(*[F.lit(x) for x in declared])).alias(condition))
    return planned.join(done, [unit, condition], "left_anti")


def attempt_times(attempts: DataFrame, started: str = "started_at", finished: str = "finished_at", seconds: str = "runtime_seconds") -> DataFrame:
    """Times without zone, ends before starts, and runtimes off by more than the displayed digits allow."""
    s, f = L.iso_time(F.col(started)), L.iso_time(F.col(finished))
    span = F.unix_micros(f) / 1e6 - F.unix_micros(s) / 1e6
    # half a tick of either display, and the last bit of the numbers
    allowed = L.half_resolution(F.col(started)) + L.half_resolution(F.col(finished)) + F.abs(span) * 2.3e-16 + 1e-6
    a = attempts.withColumn("_s", s).withColumn("_f", f).withColumn("_span", span).withColumn("_ok", allowed)
    e = F.col("attempt_id")
    return union([
        finding(a.where("_s is null or _f is null"), "error", "time_without_zone", e, F.lit("a time can't be read or names no zone")),
        finding(a.where("_f < _s"), "error", "ends_before_start", e, F.lit("the attempt ends before it starts")),
        finding(a.where((F.col("_f") >= F.col("_s")) & (F.abs(F.col(seconds) - F.col("_span")) > F.col("_ok"))), "error", "runtime", e, F.lit("the runtime isn't the time between start and end")),
    ])


def reused_paths(paths: DataFrame) -> DataFrame:
    """paths(path, run_id, attempt_id, role): an artifact path that more than one attempt or role claims."""
    g = paths.where(norm("path") != "").groupBy(F.trim("path").alias("path")).agg(F.countDistinct("run_id", "attempt_id", "role").alias("owners")).where("owners > 1")
    return finding(g, "error", "path_reused", F.col("path"), F.concat(F.col("owners").cast("string"), F.lit(" owners")))


def metric_records(metrics: DataFrame, required: list[str]) -> DataFrame:
    """metrics(run_id, attempt_id, metrics map<string,double>): missing, unexpected and non-finite values, and repeated records."""
    need = F.array(*[F.lit(r) for r in required])
    names = F.map_keys("metrics")
    e = F.concat_ws("/", "run_id", "attempt_id")
    each = metrics.select("run_id", "attempt_id", F.explode("metrics").alias("name", "value"))
    return union([
        finding(metrics.select("run_id", "attempt_id", F.explode(F.array_except(need, names)).alias("m")), "error", "metric_missing", e, F.col("m")),
        finding(metrics.select("run_id", "attempt_id", F.explode(F.array_except(names, need)).alias("m")), "error", "metric_unexpected", e, F.col("m")),
        finding(each.where("value is null or isnan(value) or abs(value) = double('infinity')"), "error", "metric_not_finite", e, F.col("name")),
        finding(metrics.groupBy("run_id", "attempt_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "error", "metric_repeated", e, F.col("k").cast("string")),
    ])


def scope_population(units: DataFrame, expected: DataFrame) -> DataFrame:
    """units(scope_id, unit_id) against expected(scope_id, unit_count): totals as multisets and repeated units."""
    got = units.groupBy("scope_id").agg(F.count(F.lit(1)).alias("n"))
    j = expected.join(got, "scope_id", "full_outer")
    twice = units.groupBy("scope_id", "unit_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return union([
        finding(j.where(~F.col("unit_count").eqNullSafe(F.col("n"))), "error", "population", F.col("scope_id"), F.concat(F.lit("expected "), F.coalesce(F.col("unit_count").cast("string"), F.lit("none")), F.lit(", found "), F.coalesce(F.col("n").cast("string"), F.lit("none")))),
        finding(twice, "warning", "unit_repeated", F.concat_ws("/", "scope_id", "unit_id"), F.col("k").cast("string")),
    ])


# fixed values: parts of variable names that tell of credentials
SECRET = r"(?i)(secret|token|password|passwd|api[_-]?key|credential|private[_-]?key|auth)"


def environment(records: DataFrame, required: list[str]) -> DataFrame:
    """records(attempt_id, environment map<string,string>): required entries, and names that look like credentials."""
    names = F.map_keys("environment")
    return union([
        finding(records.select("attempt_id", F.explode(F.array_except(F.array(*[F.lit(r) for r in required]), names)).alias("m")), "error", "environment_missing", F.col("attempt_id"), F.col("m")),
        finding(records.select("attempt_id", F.explode(F.filter(names, lambda n: n.rlike(SECRET))).alias("m")), "error", "credential", F.col("attempt_id"), F.col("m")),
    ])


def interval_of(value: Column, kind: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """The accepted interval of a reported value: exact, absolute (tolerance a), relative (a), reported (low a, high b) or multiplier (variation a times b)."""
    half = F.when(kind == "exact", F.lit(0.0)).when(kind == "absolute", a).when(kind == "relative", F.abs(value) * a).when(kind == "multiplier", a * b)
    return F.when(kind == "reported", a).otherwise(value - half), F.when(kind == "reported", b).otherwise(value + half)


def reconcile_claims(claims: DataFrame, metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """claim_id, state (reproduced, not_reproduced, not_assessed), runs, of claims(claim_id, metric, value, rule, a, b).

    Only metrics of successful target runs with the claim's metric name count: metrics(run_id, claim_id, metric, value),
    runs(run_id, exit_code, run_kind).
    """
    ok = runs.where("exit_code = 0 and run_kind = 'target'").select("run_id").distinct()
    m = metrics.join(ok, "run_id", "left_semi").select("claim_id", F.lower(norm("metric")).alias("mm"), F.col("value").alias("observed"))
    low, high = interval_of(F.col("value"), F.lower(norm("rule")), F.col("a"), F.col("b"))
    j = claims.withColumn("_low", low).withColumn("_high", high).join(m, "claim_id", "left").withColumn("_hit", F.when(F.lower(norm("metric")) == F.col("mm"), (F.col("observed") >= F.col("_low")) & (F.col("observed") <= F.col("_high"))))
    g = j.groupBy("claim_id").agg(F.count("_hit").alias("runs"), F.min("_hit").alias("every"))
    return g.select("claim_id", F.when(F.col("runs") == 0, "not_assessed").when(F.col("every"), "reproduced").otherwise("not_reproduced").alias("state"), "runs")


def release_gate(claims: DataFrame, assessed: DataFrame) -> DataFrame:
    """Claims without an assessment: the release waits for them."""
    return finding(claims.select("claim_id").distinct().join(assessed.where("state <> 'not_assessed'").select("claim_id"), "claim_id", "left_anti"), "error", "not_assessed", F.col("claim_id"), F.lit("the claim has no assessment"))


def run_summary(attempts: DataFrame) -> DataFrame:
    """One row of counts over all attempts."""
    n = lambda c: F.count(F.when(c, 1))
    return attempts.agg(F.count(F.lit(1)).alias("attempts"), F.countDistinct("run_id").alias("runs"), n(F.col("status") == "completed").alias("completed"), n(F.col("status") == "failed").alias("failed"), n(F.coalesce(F.col("exit_code") != 0, F.lit(False))).alias("nonzero_exit"))


def stale_from(milestones: DataFrame, group: str, position: str, valid: str) -> DataFrame:
    """group, first_invalid, stale: everything from the first invalid milestone on has to be done again."""
    first = F.min(F.when(~F.coalesce(F.col(valid), F.lit(False)), F.col(position)))
    g = milestones.groupBy(group).agg(first.alias("first_invalid"), F.max(position).alias("_last"))
    return g.select(group, "first_invalid", F.coalesce(F.col("_last") - F.col("first_invalid") + 1, F.lit(0)).alias("stale"))
