"""Evaluation rollups: stability of repeated runs, fail-closed ratios, acceptance, paired studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvigil.operators.cells import ratio, rules

# ---------------------------------------------------------------- stability


def modal(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The most common value of a column in each group; of tied ones the smallest."""
    n = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(f"modal_{column}"))


def with_modes(runs: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    for c in columns:
        runs = runs.join(modal(runs, by, c), by)
    return runs


def stability(runs: DataFrame, by: list[str]) -> DataFrame:
    """Agreement of each input's runs with its most common plan and values, and rates of outcomes:
    failures and fallbacks of all runs, repairs of those that were tried, transmissions counted."""
    r = with_modes(runs, by, ["plan", "run_values"])
    n = F.count("run_id")
    return r.groupBy(*by).agg(
        n.alias("runs"), F.count_distinct("plan").alias("plans"), F.count_distinct("run_values").alias("value_sets"),
        ratio(F.count_if(F.col("plan") == F.col("modal_plan")), n).alias("plan_agreement"), ratio(F.count_if(F.col("run_values") == F.col("modal_run_values")), n).alias("value_agreement"),
        ratio(F.count_if(~F.col("schema_ok")), n).alias("schema_failure_rate"), ratio(F.count_if("repaired"), F.count_if("repair_tried")).alias("repair_success_rate"), ratio(F.count_if("fell_back"), n).alias("fallback_rate"),
        F.count_if("transmitted").alias("transmissions"), F.count_if((F.col("plan") != F.col("modal_plan")) | (F.col("run_values") != F.col("modal_run_values"))).alias("unstable_runs"))


def reference_run(runs: DataFrame, by: list[str]) -> DataFrame:
    """The smallest run that has both the common plan and the common values, else one for each."""
    r = with_modes(runs, by, ["plan", "run_values"])
    p, v = F.col("plan") == F.col("modal_plan"), F.col("run_values") == F.col("modal_run_values")
    out = r.groupBy(*by).agg(F.min(F.when(p & v, F.col("run_id"))).alias("both"), F.min(F.when(p, F.col("run_id"))).alias("p"), F.min(F.when(v, F.col("run_id"))).alias("v"))
    return out.select(*by, F.coalesce("both", "p").alias("plan_run"), F.coalesce("both", "v").alias("value_run"))


def unstable_examples(runs: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """The first runs of each input that differ from its reference, and in what."""
    r = with_modes(runs, by, ["plan", "run_values"])
    changed = rules(("conversion_plan", F.col("plan") != F.col("modal_plan")), ("confirmed_values", F.col("run_values") != F.col("modal_run_values")))
    r = r.withColumn("changed", F.concat_ws(",", changed)).filter("changed <> ''")
    return r.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("run_id"))).filter(F.col("place") <= most).select(*by, "run_id", "place", "changed")


def threshold_failures(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> Column:
    """Names of metrics beyond their limit: at least ('>=') or at most ('<=') a value; null fails."""
    return rules(*[(m, ~(F.col(m) >= v if way == ">=" else F.col(m) <= v)) for m, (way, v) in limits.items()])


def check_outcomes(runs: DataFrame) -> DataFrame:
    """Runs whose outcome flags contradict each other."""
    ok, tried, repaired, fell = (F.col(c) for c in ("schema_ok", "repair_tried", "repaired", "fell_back"))
    bad = rules(
        ("repair was not tried", repaired & ~tried), ("repair without failure", ok & (tried | repaired)), ("fallback without failure", ok & fell), ("repair and fallback", ~ok & repaired & fell),
        ("failure without repair or fallback", ~ok & ~repaired & ~fell))
    return runs.select("run_id", F.concat_ws("; ", bad).alias("violations")).filter("violations <> ''")


# ---------------------------------------------------------------- fail-closed folds


def fold(status: Column) -> Column:
    """fail over unknown over pass; nothing at all is unknown."""
    return F.when(F.bool_or(status == "fail"), "fail").when(F.coalesce(F.bool_and(F.coalesce(status == "pass", F.lit(False))), F.lit(False)), "pass").otherwise("unknown")


def fold_status(df: DataFrame, by: list[str], column: str = "status") -> DataFrame:
    return df.groupBy(*by).agg(fold(F.col(column)).alias(column))


def ratio_rollup(cases: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Summed matched over total; unknown if a case is invalid, contradicts itself, or nothing counts."""
    reached = F.try_divide("matched", "total") >= threshold  # the ratio itself is compared, as rounded
    own = F.when(reached, "pass").otherwise("fail")
    invalid = F.coalesce((F.col("matched") < 0) | (F.col("total") <= 0) | (F.col("matched") > F.col("total")) | (F.col("status") != own), F.lit(True))
    out = cases.groupBy(*by).agg(F.sum("matched").alias("matched"), F.sum("total").alias("total"), F.bool_or(invalid).alias("invalid"), F.count_if(F.col("status") == "fail").alias("failing"))
    status = F.when(F.col("invalid") | (F.col("total") == 0), "unknown").when(reached, "pass").otherwise("fail")
    return out.select(*by, "matched", "total", "failing", F.when(status != "unknown", F.col("matched") / F.col("total")).alias("ratio"), status.alias("status"))


def risk_rollup(cases: DataFrame, by: list[str]) -> DataFrame:
    """Targets, covered, missed and confirmed by machine; unknown where covered + missed is not targets."""
    sums = cases.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("targets", "covered", "missed", "auto")], F.bool_or(F.coalesce(F.col("covered") + F.col("missed") != F.col("targets"), F.lit(True))).alias("broken"))
    return sums.withColumn("status", F.when(F.col("broken"), "unknown").when((F.col("missed") == 0) & (F.col("auto") == 0), "pass").otherwise("fail")).drop("broken")


def zero_limit_rollup(cases: DataFrame, by: list[str]) -> DataFrame:
    """Actions that must never happen: none passes, any fails, an unreported count is unknown."""
    out = cases.groupBy(*by).agg(F.sum("forbidden").alias("forbidden"), F.bool_or(F.col("forbidden").isNull()).alias("gap"))
    return out.select(*by, "forbidden", F.when(F.col("forbidden") > 0, "fail").when(F.col("gap"), "unknown").otherwise("pass").alias("status"))


def perf_rollup(observations: DataFrame, approved: DataFrame) -> DataFrame:
    """Each dimension's largest value against its one, approved, inclusive limit."""
    o = observations.groupBy("dimension").agg(F.count("value").alias("observations"), F.max("value").alias("largest"), F.count_distinct("limit").alias("limits"), F.max("limit").alias("limit"))
    j = o.join(approved.select("dimension", F.col("limit").alias("approved")), "dimension", "left")
    bad = (F.col("limits") != 1) | F.col("approved").isNull() | (F.col("limit") != F.col("approved"))
    return j.select("dimension", "observations", "largest", "limit", F.when(bad, "unknown").when(F.col("largest") <= F.col("limit"), "pass").otherwise("fail").alias("status"))


def completeness(cases: DataFrame, required: DataFrame) -> DataFrame:
    """One row: cases, distinct ids, categories that are missing and that nobody asked for."""
    n = cases.agg(F.count("case_id").alias("cases"), F.count_distinct("case_id").alias("ids"))
    seen = cases.select("category").distinct()
    missing = required.join(seen, "category", "left_anti").agg(F.array_join(F.array_sort(F.collect_list("category")), ",").alias("missing"))
    extra = seen.join(required, "category", "left_anti").agg(F.array_join(F.array_sort(F.collect_list("category")), ",").alias("extra"))
    return n.crossJoin(missing).crossJoin(extra).withColumn("complete", (F.col("cases") == F.col("ids")) & (F.col("missing") == "") & (F.col("extra") == ""))


def acceptance(cases: DataFrame, by: list[str]) -> DataFrame:
    """Accepted and failing cases of each group."""
    passed = F.col("status") == "pass"
    return cases.groupBy(*by).agg(F.count("case_id").alias("cases"), F.count_if(passed).alias("accepted"), F.count_if(~passed).alias("failing"))


def failing_cases(cases: DataFrame, by: list[str]) -> DataFrame:
    """The failing cases of each group, one a row: a group may have any number of them."""
    return cases.filter("status <> 'pass'").select(*by, "case_id")


def by_mode(results: DataFrame) -> DataFrame:
    return results.groupBy("mode").agg(F.count("case_id").alias("results"), F.array_join(F.sort_array(F.collect_set("scenario")), ",").alias("scenarios"), F.count_distinct("sample").alias("samples"))


def status_counts(df: DataFrame, by: list[str], statuses: list[str]) -> DataFrame:
    """A column for each status, 0 where a group has none."""
    return df.groupBy(*by).pivot("status", statuses).count().fillna(0, statuses)


def effective_items(items: DataFrame, dims: DataFrame) -> DataFrame:
    """Items that pass become fail or unknown where a dimension that they need does not pass."""
    need = items.select("item_id", F.explode_outer("dims").alias("dim")).join(dims.select("dim", F.col("status").alias("dim_status")), "dim", "left")
    state = need.groupBy("item_id").agg(F.when(F.count("dim") == 0, "pass").otherwise(fold(F.coalesce("dim_status", F.lit("unknown")))).alias("dims_status"))
    return items.join(state, "item_id").select("item_id", F.when(F.col("status") == "pass", F.col("dims_status")).otherwise(F.col("status")).alias("status"))


def acceptance_matrix(metrics: DataFrame, targets: list[tuple[str, str, float]]) -> DataFrame:
    """One row of metrics against (metric, way, target): observed, and pass, fail or unknown."""
    wide = F.array(*[F.struct(F.lit(m).alias("criterion"), F.col(m).cast("double").alias("observed"), F.lit(w).alias("way"), F.lit(t).alias("target")) for m, w, t in targets])
    c = metrics.select(F.explode(wide).alias("c")).select("c.*")
    met = F.when(F.col("way") == ">=", F.col("observed") >= F.col("target")).when(F.col("way") == "<=", F.col("observed") <= F.col("target"))
    return c.select("criterion", "observed", "target", F.when(met.isNull(), "unknown").when(met, "pass").otherwise("fail").alias("status"))


def criteria_rollup(criteria: DataFrame, reported: DataFrame) -> DataFrame:
    """Criteria with a reported status that contradicts what was observed."""
    j = criteria.join(reported.select("criterion", F.col("status").alias("reported")), "criterion", "left")
    return j.withColumn("contradicts", ~F.col("status").eqNullSafe(F.col("reported")))


def follow_ups(results: DataFrame, most: int = 5) -> DataFrame:
    """The most common reasons of failure, each with its first cases: what to look at next."""
    bad = results.filter("status <> 'pass'").groupBy("reason").agg(F.count("case_id").alias("cases"), F.min("case_id").alias("first_case"))
    return bad.orderBy(F.desc("cases"), "reason").limit(most)


def harness_summary(results: DataFrame) -> DataFrame:
    """One row: completed and failed results, categories seen, and the decision, pass only if all pass."""
    return results.agg(
        F.count_if(F.col("status") == "pass").alias("completed"), F.count_if(F.col("status") != "pass").alias("failed"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"),
        F.when(fold(F.col("status")) == "pass", "pass").otherwise("fail").alias("decision"))


def acceptance_report(items: DataFrame) -> DataFrame:
    """Decisions with their items, and the overall one in a last row."""
    per = items.groupBy(F.col("status").alias("decision")).agg(F.count("item_id").alias("items"))
    return per.unionByName(items.agg(F.concat(F.lit("overall "), fold(F.col("status"))).alias("decision"), F.count("item_id").alias("items")))


def reduction(df: DataFrame, by: list[str], target: float) -> DataFrame:
    """Correction time saved against the baseline, and whether it reaches the target."""
    out = df.groupBy(*by).agg(F.sum("baseline").alias("baseline"), F.sum("assisted").alias("assisted"))
    rate = F.try_divide(F.col("baseline") - F.col("assisted"), F.col("baseline"))
    return out.withColumn("reduction", rate).withColumn("met", F.coalesce(rate >= target, F.lit(False)))


# ---------------------------------------------------------------- paired study

PAIR = ["participant", "case_id"]


def reporting_run(runs: DataFrame) -> DataFrame:
    """The run of each participant, case and arm that counts: the included one, else the last attempt."""
    return runs.groupBy(*PAIR, "arm").agg(F.coalesce(F.min_by("run_id", F.when(F.col("included"), F.col("attempt"))), F.max_by("run_id", "attempt")).alias("run_id"))


def pair_arms(runs: DataFrame, arms: tuple[str, str], completed: DataFrame | None = None, approved: str = "approved") -> DataFrame:
    """One row a participant and case that has a run: what both arms reported, and whether the pair counts.

    ``runs(participant, case_id, arm, run_id, attempt, included, outcome, checklist, seconds)``. An arm
    reports its included run, else its last attempt. A pair is ``calculable`` if each arm has exactly one
    included run, both approved with a complete checklist, in positive time (``seconds`` is less pauses); it is
    ``eligible`` if besides its participant is in ``completed(participant)``. ``reduction_percent`` is what the
    second arm saves of the first one's time. Nulls never count.
    """
    no = F.lit(False)
    run = F.struct("run_id", "outcome", "checklist", "seconds", F.coalesce("included", no).alias("included"))
    named = dict(zip("ab", arms, strict=True))
    parts = []
    for p, arm in named.items():
        mine = F.col("arm") == arm
        parts += [F.count_if(mine & F.coalesce("included", no)).alias(f"_{p}_n"), F.count_if(mine).alias(f"_{p}_all")]
        parts.append(F.max_by(run, F.when(mine, F.struct(F.coalesce("included", no), "attempt", "run_id"))).alias(f"_{p}"))
    g = runs.groupBy(*PAIR).agg(*parts)
    good = [F.coalesce((F.col(f"_{p}_n") == 1) & (F.col(f"_{p}.outcome") == approved) & F.col(f"_{p}.checklist") & (F.col(f"_{p}.seconds") > 0), no) for p in named]
    g = g.withColumn("calculable", good[0] & good[1])
    if completed is None:
        g = g.withColumn("eligible", F.col("calculable"))
    else:
        done = completed.select("participant").distinct().withColumn("_done", F.lit(True))
        g = g.join(done, "participant", "left").withColumn("eligible", F.col("calculable") & F.coalesce("_done", no))
    seconds = [F.when(F.col("calculable"), F.col(f"_{p}.seconds")) for p in named]
    return g.select(
        *PAIR, "calculable", "eligible", seconds[0].alias("a_seconds"), seconds[1].alias("b_seconds"),
        F.col("_a.outcome").alias("a_outcome"), F.col("_b.outcome").alias("b_outcome"),
        F.when(F.col("_a_all") > 0, F.col("_a_n") > 0).alias("a_included"), F.when(F.col("_b_all") > 0, F.col("_b_n") > 0).alias("b_included"),
        (100 * (seconds[0] - seconds[1]) / seconds[0]).alias("reduction_percent"),
    )


def paired_median(pairs: DataFrame, target_percent: int = 30) -> DataFrame:
    """The median of the eligible pairs' reductions and whether it reaches the target.

    The decision is exact: each pair is held against the target as whole numbers, and only where an even
    number of pairs splits in half are the two middle fractions added, over their common denominator.
    """
    a, b = (F.col(c).cast("decimal(18,0)") for c in ("a_seconds", "b_seconds"))
    e = pairs.filter("eligible").select(F.struct(a.alias("a"), b.alias("b")).alias("p"), "reduction_percent", (100 * (a - b) >= target_percent * a).alias("over"))
    m = e.agg(
        F.count(F.lit(1)).alias("pairs"), F.median("reduction_percent").alias("reduction_percent"), F.count_if("over").alias("n_over"),
        F.max_by("p", F.when(~F.col("over"), F.col("reduction_percent"))).alias("low"), F.min_by("p", F.when(F.col("over"), F.col("reduction_percent"))).alias("high"),
    )
    saved = (F.col("low.a") - F.col("low.b")) * F.col("high.a") + (F.col("high.a") - F.col("high.b")) * F.col("low.a")
    half = 50 * saved >= target_percent * (F.col("low.a") * F.col("high.a"))
    twice = 2 * F.col("n_over")
    met = (F.col("pairs") > 0) & ((twice > F.col("pairs")) | ((twice == F.col("pairs")) & half))
    return m.select("pairs", "reduction_percent", F.coalesce(met, F.lit(False)).alias("met"))


def missing_runs(participants: DataFrame, cases: DataFrame, arms: DataFrame, runs: DataFrame) -> DataFrame:
    """The participant, case and arm combinations that were asked for and not recorded. The grid is
    what the study plans: as many rows as it has runs to come."""
    grid = participants.join(cases, F.lit(True)).join(arms, F.lit(True))
    return grid.join(runs, [*PAIR, "arm"], "left_anti")


def arm_metrics(runs: DataFrame) -> DataFrame:
    """Runs, complete ones and seconds of each arm, and of all in a last row."""
    return runs.rollup("arm").agg(F.count("run_id").alias("runs"), F.count_if("complete").alias("complete"), F.sum("seconds").alias("seconds")).withColumn("arm", F.coalesce("arm", F.lit("all")))


def attempt_order(runs: DataFrame) -> DataFrame:
    """Attempts that do not count from 1 without gaps, or end after the next begins."""
    w = Window.partitionBy(*PAIR, "arm").orderBy("attempt", "run_id")
    bad = rules(("attempt numbers have a gap", F.col("attempt") != F.row_number().over(w)), ("attempts overlap", F.coalesce(F.lag("ended").over(w) > F.col("started"), F.lit(False))))
    return runs.select("run_id", F.concat_ws("; ", bad).alias("violations")).filter("violations <> ''")


def overlaps(runs: DataFrame) -> DataFrame:
    """Runs that begin before an earlier run of their participant has ended."""
    w = Window.partitionBy("participant").orderBy("started", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("before", F.max("ended").over(w)).filter("before > started").select("run_id", "participant")


def arm_order(runs: DataFrame, orders: DataFrame) -> DataFrame:
    """Participants whose runs do not follow the order declared for them: (participant, problem).

    ``orders(participant, first, second)``: all timed activity of the first arm must end before the second
    begins; a tie is in order, a second arm without a first is not, nor is activity without an order.
    """
    j = runs.join(orders, "participant", "left")
    of = lambda c: F.coalesce(F.col("arm") == F.col(c), F.lit(False))
    g = j.groupBy("participant").agg(
        F.bool_or(F.col("first").isNotNull()).alias("ordered"), F.max(F.when(of("first"), F.greatest("started", "ended"))).alias("until"), F.min(F.when(of("second"), F.col("started"))).alias("since"))
    late = F.col("since").isNotNull() & F.coalesce(F.col("until") > F.col("since"), F.lit(True))
    problem = F.when(~F.coalesce("ordered", F.lit(False)), "no order").when(late, "order")
    return g.select("participant", problem.alias("problem")).filter("problem IS NOT NULL")


def revision_differences(runs: DataFrame, arms: tuple[str, str], fields: list[str]) -> DataFrame:
    """Pairs of included runs that were not made with the same revisions: (participant, case_id, differs)."""
    one = [F.struct(F.count_if(mine).alias("n"), *[F.min(F.when(mine, F.col(f))).alias(f) for f in fields]).alias(p) for p, arm in zip("ab", arms, strict=True) for mine in [(F.col("arm") == arm) & F.coalesce("included", F.lit(False))]]
    g = runs.groupBy(*PAIR).agg(*one).filter("a.n = 1 AND b.n = 1")
    differs = rules(*[(f, ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))) for f in fields])
    return g.select(*PAIR, F.concat_ws("; ", differs).alias("differs")).filter("differs <> ''")


def check_runs(runs: DataFrame, outcomes: list[str]) -> DataFrame:
    """Study runs whose own fields are wrong, or whose arm has not exactly one included run; an outcome must
    be one of ``outcomes``."""
    w = Window.partitionBy(*PAIR, "arm")
    bad = rules(
        ("timing", ~(F.col("ended") > F.col("started"))), ("pause", ~(F.col("pause") < F.unix_timestamp("ended") - F.unix_timestamp("started"))),
        ("included runs", F.count_if("included").over(w) != 1), ("outcome", F.coalesce(~F.col("outcome").isin(*outcomes), F.lit(True))))
    return runs.select("run_id", F.concat_ws("; ", bad).alias("violations")).filter("violations <> ''")


def check_participants(participants: DataFrame, runs: DataFrame) -> DataFrame:
    """Participants whose times are out of order: approval before consent before practice before the first
    run, nothing after leaving. A tie is out of order, except that practice and runs may end, but not begin, at
    the moment of leaving. What is missing is out of order too, but for ``withdrawn``.

    ``participants(participant, approved, consented, practised, withdrawn)``, ``runs(participant, started, ended)``.
    """
    g = runs.groupBy("participant").agg(F.min("started").alias("first"), F.max("started").alias("begun"), F.max("ended").alias("last"))
    j = participants.join(g, "participant", "left")
    before = lambda a, b: F.coalesce(F.col(a) < F.col(b), F.lit(False))
    active = F.col("first").isNotNull()
    gone = F.coalesce((F.col("begun") >= F.col("withdrawn")) | (F.col("last") > F.col("withdrawn")), F.lit(False))
    bad = rules(
        ("approval after a run", active & ~before("approved", "first")), ("consent after a run", active & ~before("consented", "first")), ("practice after a run", active & ~before("practised", "first")),
        ("consent before approval", F.col("consented").isNotNull() & ~before("approved", "consented")), ("practice before consent", F.col("practised").isNotNull() & ~before("consented", "practised")),
        ("consent after leaving", F.col("withdrawn").isNotNull() & F.coalesce(F.col("consented") >= F.col("withdrawn"), F.lit(False))), ("practice after leaving", F.coalesce(F.col("practised") > F.col("withdrawn"), F.lit(False))),
        ("a run after leaving", gone))
    return j.select("participant", F.concat_ws("; ", bad).alias("violations")).filter("violations <> ''")


def positional_match(expected: DataFrame, actual: DataFrame, by: list[str]) -> DataFrame:
    """Share of expected items at their own place, and whether all occur in order: (by..., pos, item)."""
    at = expected.join(actual.select(*by, "pos", F.col("item").alias("there")), [*by, "pos"], "left").groupBy(*by).agg(ratio(F.count_if(F.coalesce(F.col("item") == F.col("there"), F.lit(False))), F.count("pos")).alias("rate"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("wanted"))
    seq = actual.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("found"))
    step = lambda acc, x: F.when(F.get(F.col("wanted"), acc) == x, acc + 1).otherwise(acc)
    j = at.join(seq, by, "left")
    return j.select(*by, "rate", (F.coalesce(F.aggregate("found", F.lit(0), step), F.lit(0)) == F.size("wanted")).alias("in_order"))
