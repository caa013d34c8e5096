"""Runs, claims and evidence: merges, coverage, lineage and checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import dropped, shuffles_dropped, written

#: The signatures whose values may conflict, and other names of them.
SIGNATURES = "q_mean q_std q5 q95 q_median baseflow_index runoff_ratio stream_elas high_q_freq high_q_dur low_q_freq low_q_dur zero_q_freq flow_variability hfd_mean half_flow_date_std slope_fdc slope_fdc_sawicz2011".split()
METRIC_ALIASES = {"bfi": "baseflow_index", "base_flow_index": "baseflow_index", "bfi_mean": "baseflow_index", "rr": "runoff_ratio", "runoff_coefficient": "runoff_ratio"}


def span_problems(spans: DataFrame, runs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Evidence spans (claim_id, source_id, metric_ref) to what keeps them from resolving, NULL if nothing does.

    runs: run_id, hollow (error or no real output). outputs: run_id, path.
    """
    r = runs.select(F.col("run_id").alias("source_id"), F.col("hollow"), F.lit(True).alias("_run"))
    o = outputs.select(F.col("run_id").alias("source_id"), F.col("path").alias("metric_ref"), F.lit(True).alias("_path")).distinct()
    met = spans.join(r, "source_id", "left").join(o, ["source_id", "metric_ref"], "left")
    problem = F.when(F.coalesce("source_id", F.lit("")) == "", "no_id").when(F.col("_run").isNull(), "run_absent").when(F.col("hollow"), "hollow_run").when(F.col("metric_ref").isNotNull() & F.col("_path").isNull(), "metric_absent")
    return met.withColumn("problem", problem).drop("_run", "_path", "hollow")


def stale_evidence(versions: DataFrame, spans: DataFrame, current: DataFrame) -> DataFrame:
    """Claims whose stored fingerprints (claim_id, source_id, digest), spans and current digests do not agree."""
    v = versions.select("claim_id", "source_id", "digest", F.lit(True).alias("_v"))
    s = spans.select("claim_id", "source_id").distinct().withColumn("_s", F.lit(True))
    met = v.join(s, ["claim_id", "source_id"], "full").join(current.select("source_id", F.col("digest").alias("now")), "source_id", "left")
    reason = F.when(F.col("_v").isNull(), "no_version").when(F.col("_s").isNull(), "no_span").when(F.col("now").isNull(), "source_missing").when(F.col("now") != F.col("digest"), "changed")
    return met.withColumn("reason", reason).where("reason IS NOT NULL").select("claim_id", "source_id", "reason")


def scope_overreach(answers: DataFrame, scopes: DataFrame) -> DataFrame:
    """Gauge numbers in a text that no claim of its session covers; sessions without scopes are skipped."""
    named = answers.select("session_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b(\d{8,15})\b"), F.lit(1))).alias("gauge_id")).distinct()
    return named.join(scopes.select("session_id").distinct(), "session_id", "left_semi").join(scopes, ["session_id", "gauge_id"], "left_anti")


def canonical_metric(name: Column) -> Column:
    """One name for each metric: lower case, other signs than letters and digits as `_`, aliases resolved."""
    key = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in METRIC_ALIASES.items() for x in pair]), key), key)


def metric_conflicts(metrics: DataFrame, tolerance: float = 0.01, only: list[str] | None = SIGNATURES) -> DataFrame:
    """(metric, feature, period, tool, method, ts, run_id, value): of the latest run of each tool and method, groups whose
    spread exceeds the tolerance of the larger magnitude; periods must be known. Metrics go by their canonical names; of
    others than `only` (None: any) two values are no conflict."""
    metrics = metrics.withColumn("metric", canonical_metric(F.col("metric")))
    metrics = metrics if only is None else metrics.where(F.col("metric").isin(only))
    w = Window.partitionBy("metric", "feature", "period", "tool", "method").orderBy(F.desc("ts"), F.desc("run_id"))
    last = metrics.where("period IS NOT NULL AND value IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    g = last.groupBy("metric", "feature", "period").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))
    return g.where((F.col("n") > 1) & (F.col("high") - F.col("low") > tolerance * F.greatest(F.abs("low"), F.abs("high"))))


def runs_of_gauge(runs: DataFrame, most: int = 50) -> DataFrame:
    """(study, gauge_id, run_id, ts): for each gauge and study the number of runs, the newest ones (a report's length) and
    whether there are more."""
    w = Window.partitionBy("gauge_id", "study")
    ranked = runs.distinct().withColumn("i", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("run_id")))).withColumn("n", F.count(F.lit(1)).over(w))
    newest = F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= most, F.struct("i", "run_id")))), lambda x: x["run_id"])
    return ranked.groupBy("gauge_id", "study").agg(F.max("n").alias("n_runs"), newest.alias("newest"), (F.max("n") > most).alias("truncated"))


def studies_of_gauge(runs: DataFrame, bound: DataFrame, most: int = 50, runs_most: int = 50) -> DataFrame:
    """Studies bound to a gauge (gauge_id, study), or with runs that name it: bound flag, number of runs, the newest, rank.

    Of each gauge the first `most` studies are listed, bound ones first, then by number of runs and name; n_studies and
    studies_truncated tell of all.
    """
    own = bound.select("gauge_id", "study").distinct().withColumn("bound_to_gauge", F.lit(True))
    met = runs_of_gauge(runs, runs_most).join(own, ["gauge_id", "study"], "full").fillna(False, ["bound_to_gauge", "truncated"]).fillna(0, ["n_runs"])
    w = Window.partitionBy("gauge_id")
    ranked = met.withColumn("rank", F.row_number().over(w.orderBy(F.desc("bound_to_gauge"), F.desc("n_runs"), "study"))).withColumn("n_studies", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("rank") <= most).withColumn("studies_truncated", F.col("n_studies") > most)


def edge_states(runs: DataFrame) -> DataFrame:
    """(run_id, parents, input_refs, parent_unresolved, acquires, has_record) to what each run says of its own inputs.

    declared: it lists parents, or refers to another run of the log; declared_unresolved: it says that it could not name
    its parent; acquisition_root: it fetched outside data; undeclared: none of these; no_record: it has no record.
    """
    ids = runs.select(F.col("run_id").alias("ref")).distinct()
    named = runs.select("run_id", F.explode("input_refs").alias("ref")).where("ref <> run_id").join(ids, "ref", "left_semi").select("run_id").distinct().withColumn("_refers", F.lit(True))
    declared = (F.coalesce(F.size("parents"), F.lit(0)) > 0) | F.coalesce("_refers", F.lit(False))
    state = F.when(~F.col("has_record"), "no_record").when(declared, "declared").when(F.col("parent_unresolved").isNotNull(), "declared_unresolved").when(F.col("acquires"), "acquisition_root").otherwise("undeclared")
    return runs.join(named, "run_id", "left").select("run_id", state.alias("state"))


def ledger_listing(claims: DataFrame) -> DataFrame:
    """Claims by session and status, with how many are stale or lack an approval."""
    return claims.groupBy("session_id", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if("stale").alias("stale"), F.count_if(F.col("approval").isNull()).alias("unapproved"))


def experiment_table(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(feature, run_id, metric, value) to one row a feature with its status and missing metrics."""
    out = metrics.groupBy("feature").pivot("metric", names).agg(F.first("value"))
    run = metrics.groupBy("feature").agg(F.max("run_id").alias("run_id"))
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))
    met = out.join(run, "feature").withColumn("missing", missing)
    return met.withColumn("status", F.when(F.col("run_id").isNull(), "no_run_id").when(F.size("missing") > 0, "partial").otherwise("ok"))


def experiment_summary(table: DataFrame, names: list[str]) -> DataFrame:
    """Mean, least, greatest and number of each metric over rows that are ok, to 4 decimals."""
    long = table.where("status = 'ok'").unpivot(["feature"], names, "metric", "value")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.min("value"), 4).alias("min"), F.round(F.max("value"), 4).alias("max"), F.count("value").alias("n"))


def merge_shards(slots: DataFrame) -> DataFrame:
    """(session_id, slot, shard_id, mtime, value): the newest shard's value of each slot, and how many shards lost."""
    newest = F.max(F.struct("mtime", "shard_id", "value")).alias("x")
    g = slots.groupBy("session_id", "slot").agg(newest, F.count(F.lit(1)).alias("n"))
    return g.select("session_id", "slot", "x.shard_id", "x.value", (F.col("n") - 1).alias("n_overridden"))


def shard_conflicts(slots: DataFrame) -> DataFrame:
    """A row for each value that a later shard's replaced: session_id, slot, shard_id, replaced_by."""
    w = Window.partitionBy("session_id", "slot").orderBy("mtime", "shard_id")
    return slots.withColumn("replaced_by", F.lead("shard_id").over(w)).where("replaced_by IS NOT NULL").select("session_id", "slot", "shard_id", "replaced_by")


def union_of_items(items: DataFrame) -> DataFrame:
    """(session_id, shard_id, mtime, place, kind, item) of notes and citations: each session's different items of a kind, in
    the order in which its shards brought them (position from 1)."""
    first = items.groupBy("session_id", "kind", "item").agg(F.min(F.struct("mtime", "shard_id", "place")).alias("at"))
    w = Window.partitionBy("session_id", "kind").orderBy("at", "item")
    return first.select("session_id", "kind", "item", F.row_number().over(w).alias("position"))


def holm(tests: DataFrame, family: str = "family") -> DataFrame:
    """Step-down adjusted p of each test in its family (Holm 1979); ties by test_id."""
    w = Window.partitionBy(family)
    rank = F.row_number().over(w.orderBy("p", "test_id"))
    raw = tests.withColumn("_f", (F.count(F.lit(1)).over(w) - rank + 1) * F.col("p"))
    return raw.withColumn("p_holm", F.least(F.lit(1.0), F.max("_f").over(w.orderBy("p", "test_id").rowsBetween(Window.unboundedPreceding, 0)))).drop("_f")


def hydrograph_frames(steps: DataFrame, most: int, key: str = "event_id") -> DataFrame:
    """(time_hr, discharge) to at most `most` frames: all steps if there are no more, else evenly spaced ones (one less than
    `most`, 3 at least, their places rounded down) with first, peak and last, cut to the first `most` of them. Each frame
    lasts to the next step, the last a quarter of an hour."""
    w = Window.partitionBy(key).orderBy("time_hr")
    rows = steps.withColumn("i", F.row_number().over(w) - 1).withColumn("until", F.coalesce(F.lead("time_hr").over(w), F.col("time_hr") + 0.25))
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max_by("i", F.struct(F.col("discharge"), -F.col("i"))).alias("peak"))
    some, last = max(3, most - 1), F.col("n").cast("int") - 1
    even = F.transform(F.sequence(F.lit(0), F.lit(some - 1)), lambda i: F.when(i == some - 1, last).otherwise(F.floor(i * (last / F.lit(some - 1))).cast("int")))
    spread = F.slice(F.array_sort(F.array_distinct(F.concat(even, F.array(F.lit(0), F.col("peak").cast("int"), last)))), 1, most)
    picks = F.when(F.col("n") <= most, F.sequence(F.lit(0), last)).otherwise(spread)
    return rows.join(g.select(key, F.explode(picks).alias("i")), [key, "i"]).select(key, "i", "time_hr", "until", "discharge")


def hydrograph_ordinates(events: DataFrame, step_hr: float = 0.25, key: str = "event_id") -> DataFrame:
    """(time_to_peak_hr, peak_cms, base_time_hr) to key, i, time_hr, discharge: a linear rise to the peak and fall to the base
    time, at every step and at the base time."""
    n = F.ceil(F.col("base_time_hr") / step_hr).cast("int")
    each = events.withColumn("i", F.explode(F.sequence(F.lit(0), n))).withColumn("time_hr", F.least(F.col("i") * step_hr, F.col("base_time_hr")))
    t, tp, tb = F.col("time_hr"), F.col("time_to_peak_hr"), F.col("base_time_hr")
    return each.select(key, "i", "time_hr", (F.col("peak_cms") * F.when(t <= tp, t / tp).otherwise((tb - t) / (tb - tp))).alias("discharge"))


#: Superscript digits, and what they stand for.
SUPERSCRIPTS, PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻−", "0123456789--"


def printed_number(shown: Column) -> tuple[Column, Column]:
    """The value of a printed number and the unit of its last place, NULL for what is no number: 1,234.5, 42%, -3e-2,
    3.2×10⁻³ (also with x, * or a middle dot, with or without ^) and powers such as 10^6, which are exact to 1."""
    text = F.regexp_replace(F.regexp_replace(F.trim(shown), "−", "-"), "[, ]", "")
    text = F.regexp_replace(text, "%+$", "")
    power = F.regexp_extract_all(text, F.lit(r"^(-?[0-9.]+)\^(-?[0-9]+)$"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"^(-?[0-9.]+)\^(-?[0-9]+)$"), F.lit(2))
    tens = r"[×x*·]10\^?([-⁻]?[0-9⁰¹²³⁴⁵⁶⁷⁸⁹]+)$"
    ten = F.coalesce(F.translate(F.regexp_extract(text, tens, 1), SUPERSCRIPTS, PLAIN).try_cast("int"), F.lit(0))
    rest = F.regexp_replace(text, tens, "")
    e = F.coalesce(F.regexp_extract(rest, "[eE]([-+]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    mantissa = F.regexp_replace(rest, "[eE][-+]?[0-9]+$", "")
    good = mantissa.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    places = F.length(F.regexp_extract(mantissa, r"\.([0-9]*)$", 1))
    scale = lambda n: F.pow(F.lit(10.0), n)
    is_power = F.size(power[0]) > 0
    base, by = F.get(power[0], F.lit(0)).try_cast("double"), F.get(power[1], F.lit(0)).try_cast("double")
    value = F.when(is_power, F.when(~((base == 0) & (by < 0)), F.pow(base, by))).when(good, rest.try_cast("double") * scale(ten))
    return value, F.when(is_power, 1.0).when(good, scale(ten + e - places))


def values_match(shown: Column, stored: Column) -> Column:
    """Whether a printed number is the stored one within half a unit of its last place; percent signs may stand for
    fractions. What is no number matches nothing."""
    number, unit = printed_number(shown)
    half = 0.5 * unit + 1e-9
    near = lambda a: F.abs(a - stored) <= half
    percent = F.endswith(F.rtrim(shown), F.lit("%"))
    return F.coalesce(F.when(percent, near(number) | (F.abs(number / 100 - stored) <= half / 100)).otherwise(near(number)), F.lit(False))


def check_marked_numbers(markers: DataFrame, outputs: DataFrame) -> DataFrame:
    """(answer_id, shown, run_id, path) against outputs (run_id, path, value): verdict of each marked number."""
    met = markers.join(outputs, ["run_id", "path"], "left")
    return met.withColumn("verdict", F.when(F.col("value").isNull(), "unresolved").when(values_match(F.col("shown"), F.col("value")), "match").otherwise("mismatch"))


def citation_coverage(numbers: DataFrame) -> DataFrame:
    """(answer_id, counted, marker) of the numbers in answers: how many count, how many of them are cited, and the share."""
    counted, cited = F.count_if("counted"), F.count_if(F.col("counted") & F.col("marker").isNotNull())
    return numbers.groupBy("answer_id").agg(counted.alias("counted"), cited.alias("cited"), F.try_divide(cited, counted).alias("coverage"))


def stale_claims_cited(markers: DataFrame, claims: DataFrame) -> DataFrame:
    """Claim markers whose claim is stale, retracted or unknown."""
    met = markers.where("kind = 'claim'").join(claims.select(F.col("claim_id").alias("id"), "status"), "id", "left")
    problem = F.when(F.col("status").isNull(), "unknown_claim").when(F.col("status").isin("stale", "retracted"), F.col("status"))
    return met.withColumn("problem", problem).where("problem IS NOT NULL").select("answer_id", "id", "problem")


def report_verdict(issues: DataFrame, sessions: DataFrame) -> DataFrame:
    """flagged with an error, advisory with any issue, clean with none."""
    g = issues.groupBy("session_id").agg(F.bool_or(F.col("severity") == "error").alias("bad"), F.count(F.lit(1)).alias("n"))
    return sessions.join(g, "session_id", "left").select("session_id", F.when(F.col("bad"), "flagged").when(F.col("n") > 0, "advisory").otherwise("clean").alias("verdict"))


def assumption_violations(assumptions: DataFrame, claims: DataFrame) -> DataFrame:
    """High-risk assumptions (session_id, assumption_id, risk, validated) not validated in sessions with supported claims
    (session_id, status), with the number of these."""
    held = claims.where("status IN ('supported', 'weakly_supported')").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_supported"))
    return assumptions.where("risk = 'high' AND NOT coalesce(validated, false)").join(held, "session_id").select("session_id", "assumption_id", "n_supported")


def lineage(edges: DataFrame, starts: DataFrame, depth: int = 8, most: int = 10_000, down: bool = False) -> DataFrame:
    """(child, parent) edges walked up (or down) from the starts: start, run_id, the least number of steps, and whether the
    start's walk stopped before the end of the graph: at depth, or after the step that brought it over `most` runs. Cycles
    are cut.

    Where starts are many, the reach of all runs doubles each round: what lies r steps away exactly is joined with what its
    runs reach in r steps, so depth 8 takes three rounds. A walk that is over its limit joins no further, which loses no
    other walk anything: one that passes through it is over its own limit by then. Where starts are a small part of the
    runs, a walk from these alone takes a step a round. Rounds are written tables, made while the DataFrame is built.
    """
    here, there = ("parent", "child") if down else ("child", "parent")
    steps_of = written(edges.select(F.col(here).alias("run_id"), F.col(there).alias("next")).where("next IS NOT NULL AND run_id IS NOT NULL").distinct(), "edges")
    starts = starts.select("start").where("start IS NOT NULL").distinct()
    runs = steps_of.select("run_id").union(steps_of.select("next")).union(starts).distinct()
    with shuffles_dropped(edges.sparkSession):
        few = starts.count() * FEW_STARTS < runs.count()
    if few:
        reach, closed = _reach_by_steps(steps_of, starts, depth, most)
    else:
        reach, closed = _reach_by_doubling(steps_of, runs.select(F.col("run_id").alias("start")), depth, most)
        reach, closed = reach.join(starts, "start", "left_semi"), closed.join(starts, "start", "left_semi")
    edge = reach.where(F.col("steps") == depth).join(steps_of, "run_id").select("start", F.col("next").alias("run_id")).join(reach, ["start", "run_id"], "left_anti")
    open_ = closed.select("start").unionByName(edge.select("start")).distinct().withColumn("_open", F.lit(True))
    return reach.join(open_, "start", "left").select("start", "run_id", "steps", F.coalesce("_open", F.lit(False)).alias("stopped"))


#: Walks are made for all runs at once unless the starts are under one in so many of them.
FEW_STARTS = 8


def _over(reach: DataFrame, most: int) -> DataFrame:
    """Starts with more than `most` runs, and the first step after which they have."""
    counts = reach.groupBy("start", "steps").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("start").orderBy("steps"))
    return counts.withColumn("upto", upto).where(F.col("upto") > most).groupBy("start").agg(F.min("steps").alias("last"))


def _cut(reach: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The reach without what lies beyond the step that was one too many, and the starts that are closed by it, if any."""
    with shuffles_dropped(reach.sparkSession):
        if reach.groupBy("start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).isEmpty():
            return reach, None
    over = written(_over(reach, most), "closed")
    kept = reach.join(over, "start", "left").where(F.col("last").isNull() | (F.col("steps") <= F.col("last"))).drop("last")
    return written(kept, "walk"), over.select("start")


def _reach_by_doubling(steps_of: DataFrame, runs: DataFrame, depth: int, most: int) -> tuple[DataFrame, DataFrame]:
    own = runs.select("start", F.col("start").alias("run_id"), F.lit(0).alias("steps"))
    closed = runs.where("false")
    if depth < 1 or most < 1:
        return own, closed if depth < 1 else runs
    first = steps_of.where("run_id <> next").select(F.col("run_id").alias("start"), F.col("next").alias("run_id"), F.lit(1).alias("steps"))
    reach, over = _cut(written(own.unionByName(first), "walk"), most)
    closed, far = closed if over is None else over, 1
    while far < depth:
        more = min(far, depth - far)
        edge = reach.where(F.col("steps") == far)
        edge = edge if over is None else edge.join(closed, "start", "left_anti")
        if edge.isEmpty():
            break
        ahead = reach.where((F.col("steps") > 0) & (F.col("steps") <= more)).select(F.col("start").alias("run_id"), F.col("run_id").alias("next"), F.col("steps").alias("on"))
        found = edge.join(ahead, "run_id").select("start", F.col("next").alias("run_id"), (F.col("on") + far).alias("steps"))
        met = reach.unionByName(found).groupBy("start", "run_id").agg(F.min("steps").alias("steps"))
        far, last = far + more, reach
        reach, over = _cut(written(met, "walk"), most)
        dropped(last)
        closed = closed if over is None else over
    return reach, closed


def _reach_by_steps(steps_of: DataFrame, starts: DataFrame, depth: int, most: int) -> tuple[DataFrame, DataFrame]:
    """A step a round. The number of runs met so far goes along with each start, so that only the new ones are counted."""
    frontier = reach = written(starts.select("start", F.col("start").alias("run_id"), F.lit(0).alias("steps")), "walk")
    met = written(starts.select("start", F.lit(1).cast("long").alias("n")), "met")
    for step in range(1, depth + 1):
        going = met.where(F.col("n") <= most).select("start")
        ahead = frontier.join(going, "start", "left_semi").join(steps_of, "run_id").select("start", F.col("next").alias("run_id")).distinct()
        frontier = written(ahead.join(reach, ["start", "run_id"], "left_anti").withColumn("steps", F.lit(step)), "walk")
        if frontier.isEmpty():
            break
        reach = reach.unionByName(frontier)
        new = frontier.groupBy("start").agg(F.count(F.lit(1)).alias("more"))
        met = written(met.join(new, "start", "left").select("start", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "met")
    return reach, met.where(F.col("n") > most).select("start")


def lineage_states(walk: DataFrame, runs: DataFrame) -> DataFrame:
    """What each start of an upward walk rests on, of runs (run_id, has_record, acquires, parent_unresolved, n_parents, basis).

    observed: the walk meets a run that fetched outside data; unknown: it stopped early, or meets a run that is not in the
    log, has no record or could not name its parent; declared_unobserved: it has several runs, and those without parents
    say so (basis); undeclared: all others.
    """
    met = walk.join(runs.withColumn("_there", F.lit(True)), "run_id", "left")
    there = F.coalesce("_there", F.lit(False)) & F.coalesce("has_record", F.lit(False))
    doubt = F.bool_or(~there | F.col("parent_unresolved").isNotNull() | F.col("stopped"))
    end = there & (F.col("n_parents") == 0)
    g = met.groupBy("start").agg(F.bool_or(there & F.col("acquires")).alias("seen"), doubt.alias("doubt"), F.count(F.lit(1)).alias("walked"), F.count_if(end).alias("ends"), F.count_if(end & F.col("basis")).alias("based"))
    state = F.when(F.col("seen"), "observed").when(F.col("doubt"), "unknown").when((F.col("walked") > 1) & (F.col("ends") > 0) & (F.col("ends") == F.col("based")), "declared_unobserved").otherwise("undeclared")
    return g.select("start", state.alias("state"), "walked")


def series_digest(series: DataFrame, key: str = "site_id") -> DataFrame:
    """`sha256:` and the SHA-256 of a site's lines `YYYY-MM-DD<TAB>repr(value)<LF>` in date order; a missing value is `nan`.

    Python's repr of a float is made from a column at a time; the lines of a site are joined in Spark and hashed there.
    """

    @F.pandas_udf("string")
    def text(value: pd.Series) -> pd.Series:
        return value.map(repr)

    line = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("\t"), text(F.coalesce(F.col("value").cast("double"), F.lit(float("nan")))), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct("date", line.alias("line"))))
    g = series.groupBy(key).agg(lines.alias("s"))
    return g.select(key, F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.col("s.line"), ""), 256)).alias("digest"))


def verified_series(series: DataFrame, recorded: DataFrame, key: str = "site_id") -> DataFrame:
    """Days of the sites whose digest is the recorded one (site_id, digest); others are refused, with their verdict alone.

    Gives site_id, date, value, verdict: verified, mismatch (no days), or unrecorded (no days).
    """
    own = series_digest(series, key).join(recorded.select(key, F.col("digest").alias("_then")), key, "left")
    verdict = own.select(key, F.when(F.col("_then").isNull(), "unrecorded").when(F.col("_then") == F.col("digest"), "verified").otherwise("mismatch").alias("verdict"))
    good = series.select(key, "date", "value").join(verdict.where("verdict = 'verified'"), key)
    return good.unionByName(verdict.where("verdict <> 'verified'").select(key, F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("value"), "verdict"))


def search_results(results: DataFrame, text: str) -> DataFrame:
    """Rows (session_id, slot, data, notes) whose JSON or notes contain the text."""
    q = F.lit(text.lower())
    return results.where(F.contains(F.lower(F.coalesce("data", F.lit(""))), q) | F.contains(F.lower(F.coalesce("notes", F.lit(""))), q))


def compare_sessions(results: DataFrame, sessions: list[str]) -> DataFrame:
    """Slots side by side, one column a session."""
    return results.groupBy("slot").pivot("session_id", sessions).agg(F.max("data"))
