"""Queries on repeated runs, acceptance rollups and paired studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from docvigil.operators import rollups as R
from docvigil.plans.registry import query, select
from docvigil.plans.views import duck, view, with_views


def _sql(spark, sf_dir, views, text):
    return select(spark, sf_dir, f"{with_views('spark', *views)} {text}" if views else text)


_MODAL = """, mp AS (SELECT input_id, plan AS mplan FROM (SELECT input_id, plan, row_number() OVER (PARTITION BY input_id ORDER BY count(*) DESC, plan) AS r FROM runs GROUP BY ALL) WHERE r = 1),
    mv AS (SELECT input_id, run_values AS mval FROM (SELECT input_id, run_values, row_number() OVER (PARTITION BY input_id ORDER BY count(*) DESC, run_values) AS r FROM runs GROUP BY ALL) WHERE r = 1),
    r AS (SELECT * FROM runs JOIN mp USING (input_id) JOIN mv USING (input_id))"""
_MODAL = _MODAL.replace("FROM (SELECT input_id, plan, row_number() OVER (PARTITION BY input_id ORDER BY count(*) DESC, plan) AS r FROM runs GROUP BY ALL)", "FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY n DESC, plan) AS r FROM (SELECT input_id, plan, count(*) AS n FROM runs GROUP BY ALL))")
_MODAL = _MODAL.replace("FROM (SELECT input_id, run_values, row_number() OVER (PARTITION BY input_id ORDER BY count(*) DESC, run_values) AS r FROM runs GROUP BY ALL)", "FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY n DESC, run_values) AS r FROM (SELECT input_id, run_values, count(*) AS n FROM runs GROUP BY ALL))")


@query("t2_modal", duck("runs") + _MODAL + " SELECT input_id, mplan AS modal_plan FROM mp")
def t2(spark, sf_dir):
    return R.modal(view(spark, sf_dir, "runs"), ["input_id"], "plan")


_STABILITY = """SELECT input_id, count(*) AS runs, count(DISTINCT plan) AS plans, count(DISTINCT run_values) AS value_sets, count_if(plan = mplan)::DOUBLE / count(*) AS plan_agreement, count_if(run_values = mval)::DOUBLE / count(*) AS value_agreement, count_if(NOT schema_ok)::DOUBLE / count(*) AS schema_failure_rate,
    CASE WHEN count_if(repair_tried) = 0 THEN 0 ELSE count_if(repaired)::DOUBLE / count_if(repair_tried) END AS repair_success_rate, count_if(fell_back)::DOUBLE / count(*) AS fallback_rate, count_if(transmitted) AS transmissions, count_if(plan <> mplan OR run_values <> mval) AS unstable_runs FROM r GROUP BY input_id"""


@query("a2_stability", duck("runs") + _MODAL + _STABILITY)
def a2(spark, sf_dir):
    return R.stability(view(spark, sf_dir, "runs"), ["input_id"])


@query("a3_reference_run", duck("runs") + _MODAL + """ SELECT input_id, coalesce(min(CASE WHEN plan = mplan AND run_values = mval THEN run_id END), min(CASE WHEN plan = mplan THEN run_id END)) AS plan_run,
    coalesce(min(CASE WHEN plan = mplan AND run_values = mval THEN run_id END), min(CASE WHEN run_values = mval THEN run_id END)) AS value_run FROM r GROUP BY input_id""")
def a3(spark, sf_dir):
    return R.reference_run(view(spark, sf_dir, "runs"), ["input_id"])


@query("a4_threshold_failures", duck("runs") + _MODAL + f", s AS ({_STABILITY}) SELECT input_id, concat_ws('|', CASE WHEN plan_agreement < 0.4 THEN 'plan_agreement' END, CASE WHEN value_agreement < 0.6 THEN 'value_agreement' END, CASE WHEN fallback_rate > 0.05 THEN 'fallback_rate' END) AS failures FROM s")
def a4(spark, sf_dir):
    s = R.stability(view(spark, sf_dir, "runs"), ["input_id"])
    return s.select("input_id", F.concat_ws("|", R.threshold_failures(s, {"plan_agreement": (">=", 0.4), "value_agreement": (">=", 0.6), "fallback_rate": ("<=", 0.05)})).alias("failures"))


@query("t3_unstable_examples", duck("runs") + _MODAL + """, c AS (SELECT input_id, run_id, concat_ws(',', CASE WHEN plan <> mplan THEN 'conversion_plan' END, CASE WHEN run_values <> mval THEN 'confirmed_values' END) AS changed FROM r)
    SELECT input_id, run_id, place, changed FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY run_id) AS place FROM c WHERE changed <> '') WHERE place <= 3""")
def t3(spark, sf_dir):
    return R.unstable_examples(view(spark, sf_dir, "runs"), ["input_id"])


@query("d6_check_outcomes", duck("runs") + """, v AS (SELECT run_id, concat_ws('; ', CASE WHEN repaired AND NOT repair_tried THEN 'repair was not tried' END, CASE WHEN schema_ok AND (repair_tried OR repaired) THEN 'repair without failure' END, CASE WHEN schema_ok AND fell_back THEN 'fallback without failure' END, CASE WHEN NOT schema_ok AND repaired AND fell_back THEN 'repair and fallback' END, CASE WHEN NOT schema_ok AND NOT repaired AND NOT fell_back THEN 'failure without repair or fallback' END) AS violations FROM runs) SELECT * FROM v WHERE violations <> ''""")
def d6(spark, sf_dir):
    return R.check_outcomes(view(spark, sf_dir, "runs"))


# ---------------------------------------------------------------- folds

_STATUS = "SELECT event_id AS case_id, user_id, event_type AS category, props, value, CASE WHEN event_id % 71 = 0 THEN 'fail' WHEN event_id % 43 = 0 THEN 'unknown' WHEN event_id % 501 = 0 THEN NULL ELSE 'pass' END AS status, CASE WHEN event_id % 2 = 0 THEN 'slow' ELSE 'wrong' END AS reason FROM events"
_FOLD = "CASE WHEN bool_or(coalesce(status = 'fail', false)) THEN 'fail' WHEN bool_and(coalesce(status = 'pass', false)) THEN 'pass' ELSE 'unknown' END"


@query("a5_fold_status", f"SELECT user_id, {_FOLD} AS status FROM ({_STATUS}) GROUP BY user_id")
def a5(spark, sf_dir):
    return R.fold_status(_sql(spark, sf_dir, (), _STATUS), ["user_id"])


_RATIOS = "SELECT user_id, event_id, CAST(floor(value * 10) AS BIGINT) % 90 + 10 AS matched, CAST(100 AS BIGINT) AS total, CASE WHEN (CAST(floor(value * 10) AS BIGINT) % 90 + 10 >= 50) <> (event_id % 1009 = 0) THEN 'pass' ELSE 'fail' END AS status FROM events"


@query("a7_ratio_rollup", f"""WITH c AS ({_RATIOS}), g AS (SELECT user_id, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(total) AS BIGINT) AS total, count_if(status = 'fail') AS failing, bool_or(status <> CASE WHEN matched / total >= 0.5 THEN 'pass' ELSE 'fail' END) AS invalid FROM c GROUP BY user_id)
    SELECT user_id, matched, total, failing, CASE WHEN NOT invalid THEN matched::DOUBLE / total END AS ratio, CASE WHEN invalid THEN 'unknown' WHEN matched / total >= 0.5 THEN 'pass' ELSE 'fail' END AS status FROM g""")
def a7(spark, sf_dir):
    return R.ratio_rollup(_sql(spark, sf_dir, (), _RATIOS), ["user_id"], 0.5)


_RISK = "SELECT user_id, CAST(5 AS BIGINT) AS targets, CASE WHEN event_id % 207 = 0 THEN CAST(4 AS BIGINT) ELSE CAST(5 AS BIGINT) END AS covered, CASE WHEN event_id % 414 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS missed, CASE WHEN event_id % 111 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS auto FROM events"


@query("a8_risk_rollup", f"""SELECT user_id, CAST(sum(targets) AS BIGINT) AS targets, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(auto) AS BIGINT) AS auto,
    CASE WHEN bool_or(covered + missed <> targets) THEN 'unknown' WHEN sum(missed) = 0 AND sum(auto) = 0 THEN 'pass' ELSE 'fail' END AS status FROM ({_RISK}) GROUP BY user_id""")
def a8(spark, sf_dir):
    return R.risk_rollup(_sql(spark, sf_dir, (), _RISK), ["user_id"])


_FORBIDDEN = "SELECT user_id, CASE WHEN event_id % 301 = 0 THEN NULL WHEN event_id % 173 = 0 THEN CAST(2 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS forbidden FROM events"


@query("a9_zero_limit_rollup", f"SELECT user_id, CAST(sum(forbidden) AS BIGINT) AS forbidden, CASE WHEN sum(forbidden) > 0 THEN 'fail' WHEN bool_or(forbidden IS NULL) THEN 'unknown' ELSE 'pass' END AS status FROM ({_FORBIDDEN}) GROUP BY user_id")
def a9(spark, sf_dir):
    return R.zero_limit_rollup(_sql(spark, sf_dir, (), _FORBIDDEN), ["user_id"])


_PERF = """SELECT CONCAT(event_type, '-', CAST(user_id % 10 AS STRING)) AS dimension, value, CASE WHEN event_id % 1999 = 7 THEN 600.0 ELSE 500.0 END AS "limit" FROM events"""


@query("a10_perf_rollup", f"""WITH o AS ({_PERF}), g AS (SELECT dimension, count(value) AS observations, max(value) AS largest, count(DISTINCT "limit") AS limits, max("limit")::DOUBLE AS "limit" FROM o GROUP BY dimension)
    SELECT dimension, observations, largest, "limit", CASE WHEN limits <> 1 OR dimension LIKE '%-9' OR "limit" <> 500 THEN 'unknown' WHEN largest <= "limit" THEN 'pass' ELSE 'fail' END AS status FROM g""")
def a10(spark, sf_dir):
    o = _sql(spark, sf_dir, (), _PERF.replace('"limit"', "`limit`")).withColumn("limit", F.col("limit").cast("double"))
    approved = o.filter("NOT dimension LIKE '%-9'").select("dimension", F.lit(500.0).alias("limit")).distinct()
    return R.perf_rollup(o, approved)


@query("a11_completeness", """SELECT count(*) AS cases, count(DISTINCT case_id) AS ids, 'audit' AS missing, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT event_type AS c FROM events WHERE event_type NOT IN ('click', 'view'))) AS extra, false AS complete FROM (SELECT event_id % 9000 AS case_id FROM events)""")
def a11(spark, sf_dir):
    cases = _sql(spark, sf_dir, (), "SELECT event_id % 9000 AS case_id, event_type AS category FROM events")
    required = cases.sparkSession.createDataFrame([("click",), ("view",), ("audit",)], "category string")
    return R.completeness(cases, required)


@query("a12_acceptance", f"SELECT user_id, count(*) AS cases, count_if(status = 'pass') AS accepted, count_if(status <> 'pass') AS failing FROM ({_STATUS}) GROUP BY user_id")
def a12(spark, sf_dir):
    return R.acceptance(_sql(spark, sf_dir, (), _STATUS), ["user_id"])


@query("a12_failing_cases", f"SELECT user_id, case_id FROM ({_STATUS}) WHERE status <> 'pass'")
def a12_failing(spark, sf_dir):
    return R.failing_cases(_sql(spark, sf_dir, (), _STATUS), ["user_id"])


@query("a13_by_mode", "SELECT event_type AS mode, count(*) AS results, string_agg(DISTINCT 's' || (user_id % 7), ',' ORDER BY 's' || (user_id % 7)) AS scenarios, count(DISTINCT user_id) AS samples FROM events GROUP BY event_type")
def a13(spark, sf_dir):
    return R.by_mode(_sql(spark, sf_dir, (), "SELECT event_type AS mode, event_id AS case_id, CONCAT('s', CAST(user_id % 7 AS STRING)) AS scenario, user_id AS sample FROM events"))


@query("a14_status_counts", f"SELECT user_id, count_if(status = 'pass') AS pass, count_if(status = 'fail') AS fail, count_if(status = 'unknown') AS unknown, count_if(status = 'skipped') AS skipped FROM ({_STATUS}) GROUP BY user_id")
def a14(spark, sf_dir):
    return R.status_counts(_sql(spark, sf_dir, (), _STATUS), ["user_id"], ["pass", "fail", "unknown", "skipped"])


@query("j29_effective_items", f"""WITH s AS ({_STATUS}), d AS (SELECT user_id AS dim, {_FOLD} AS status FROM s WHERE user_id % 17 <> 0 GROUP BY user_id),
    n AS (SELECT case_id, unnest(CASE WHEN case_id % 5 = 0 THEN [NULL] ELSE [user_id, user_id + 1] END) AS dim FROM s),
    f AS (SELECT case_id, CASE WHEN count(n.dim) = 0 THEN 'pass' WHEN bool_or(coalesce(d.status, 'unknown') = 'fail') THEN 'fail' WHEN bool_and(coalesce(d.status, 'unknown') = 'pass') THEN 'pass' ELSE 'unknown' END AS st FROM n LEFT JOIN d ON n.dim = d.dim GROUP BY case_id)
    SELECT case_id AS item_id, CASE WHEN status = 'pass' THEN st ELSE status END AS status FROM s JOIN f USING (case_id)""")
def j29(spark, sf_dir):
    s = _sql(spark, sf_dir, (), _STATUS)
    dims = R.fold_status(s.filter("user_id % 17 <> 0"), ["user_id"]).withColumnRenamed("user_id", "dim")
    items = s.select(F.col("case_id").alias("item_id"), "status", F.when(F.col("case_id") % 5 != 0, F.array(F.col("user_id"), F.col("user_id") + 1)).alias("dims"))
    return R.effective_items(items, dims)


_SUMMARY = f"SELECT count_if(status = 'pass')::DOUBLE / count(*) AS pass_rate, count_if(status = 'fail')::DOUBLE AS fails, count(DISTINCT user_id)::DOUBLE AS users, NULL::DOUBLE AS unmeasured FROM ({_STATUS})"
_TARGETS = [("pass_rate", ">=", 0.9), ("fails", "<=", 0.0), ("users", ">=", 10.0), ("unmeasured", ">=", 0.3)]
_MATRIX = f"""WITH m AS ({_SUMMARY}), x AS (SELECT 'pass_rate' AS criterion, pass_rate AS observed, 0.9 AS target, pass_rate >= 0.9 AS met FROM m UNION ALL SELECT 'fails', fails, 0, fails <= 0 FROM m UNION ALL SELECT 'users', users, 10, users >= 10 FROM m UNION ALL SELECT 'unmeasured', NULL, 0.3, NULL FROM m),
    y AS (SELECT criterion, observed, target::DOUBLE AS target, CASE WHEN met IS NULL THEN 'unknown' WHEN met THEN 'pass' ELSE 'fail' END AS status FROM x)"""


def _matrix(spark, sf_dir):
    s = _sql(spark, sf_dir, (), _STATUS)
    m = s.agg((F.count_if(F.col("status") == "pass") / F.count(F.lit(1))).alias("pass_rate"), F.count_if(F.col("status") == "fail").alias("fails"), F.count_distinct("user_id").alias("users"), F.max(F.lit(None).cast("double")).alias("unmeasured"))
    return R.acceptance_matrix(m, _TARGETS)


@query("a30_acceptance_matrix", _MATRIX + " SELECT * FROM y")
def a30(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query("a31_criteria_rollup", _MATRIX + " SELECT *, 'pass' AS reported, status <> 'pass' AS contradicts FROM y")
def a31(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return R.criteria_rollup(m, m.select("criterion", F.lit("pass").alias("status")))


@query("a32_follow_ups", f"SELECT reason, count(*) AS cases, min(case_id) AS first_case FROM (SELECT case_id, status, concat(reason, '-', user_id % 4) AS reason FROM ({_STATUS})) WHERE status <> 'pass' GROUP BY reason ORDER BY cases DESC, reason LIMIT 5")
def a32(spark, sf_dir):
    s = _sql(spark, sf_dir, (), _STATUS).withColumn("reason", F.concat("reason", F.lit("-"), (F.col("user_id") % 4).cast("string")))
    return R.follow_ups(s)


@query("a33_harness_summary", f"SELECT count_if(status = 'pass') AS completed, count_if(status <> 'pass') AS failed, (SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM events) AS categories, CASE WHEN {_FOLD} = 'pass' THEN 'pass' ELSE 'fail' END AS decision FROM ({_STATUS})")
def a33(spark, sf_dir):
    return R.harness_summary(_sql(spark, sf_dir, (), _STATUS))


@query("a33_acceptance_report", f"SELECT status AS decision, count(*) AS items FROM ({_STATUS}) GROUP BY status UNION ALL SELECT 'overall ' || {_FOLD}, count(*) FROM ({_STATUS})")
def a33b(spark, sf_dir):
    return R.acceptance_report(_sql(spark, sf_dir, (), _STATUS).withColumnRenamed("case_id", "item_id"))


_SAVED = "SELECT l_suppkey, CAST(floor(l_quantity * 10) AS BIGINT) AS baseline, CAST(floor(l_quantity * (l_linenumber % 7 + 2)) AS BIGINT) AS assisted FROM lineitem"


@query("a17_reduction", f"WITH g AS (SELECT l_suppkey, CAST(sum(baseline) AS BIGINT) AS baseline, CAST(sum(assisted) AS BIGINT) AS assisted FROM ({_SAVED}) GROUP BY l_suppkey) SELECT *, (baseline - assisted)::DOUBLE / baseline AS reduction, (baseline - assisted)::DOUBLE / baseline >= 0.4 AS met FROM g")
def a17(spark, sf_dir):
    return R.reduction(_sql(spark, sf_dir, (), _SAVED), ["l_suppkey"], 0.4)


# ---------------------------------------------------------------- paired study

#: Runs of the study with what decides whether they count.
_PAIR_RUNS = """SELECT run_id, participant, case_id, arm, attempt, run_id % 8 < 5 AS included, CASE WHEN outcome = 'P' THEN 'blocked' ELSE 'approved' END AS outcome,
    complete AS checklist, CASE WHEN run_id % 53 = 0 THEN CAST(0 AS BIGINT) ELSE seconds END AS seconds FROM study"""
_COMPLETED = "SELECT DISTINCT o_custkey AS participant FROM orders WHERE o_custkey % 7 <> 0"
_PAIRED = f""", r AS ({_PAIR_RUNS}), w AS (SELECT *, count_if(included) OVER (PARTITION BY participant, case_id, arm) AS n, row_number() OVER (PARTITION BY participant, case_id, arm ORDER BY included DESC, attempt DESC, run_id DESC) AS nth FROM r),
    one AS (SELECT * FROM w WHERE nth = 1), k AS (SELECT DISTINCT participant, case_id FROM r),
    j AS (SELECT k.*, m.outcome AS a_outcome, s.outcome AS b_outcome, m.n > 0 AS a_included, s.n > 0 AS b_included, m.seconds AS a, s.seconds AS b,
        coalesce(m.n = 1 AND s.n = 1 AND m.outcome = 'approved' AND s.outcome = 'approved' AND m.checklist AND s.checklist AND m.seconds > 0 AND s.seconds > 0, false) AS calculable
        FROM k LEFT JOIN one m ON m.participant = k.participant AND m.case_id = k.case_id AND m.arm = 'manual' LEFT JOIN one s ON s.participant = k.participant AND s.case_id = k.case_id AND s.arm = 'assisted'),
    p AS (SELECT participant, case_id, calculable, calculable AND participant IN ({_COMPLETED}) AS eligible, CASE WHEN calculable THEN a END AS a_seconds, CASE WHEN calculable THEN b END AS b_seconds,
        a_outcome, b_outcome, a_included, b_included, CASE WHEN calculable THEN 100 * (a - b)::DOUBLE / a END AS reduction_percent FROM j)""".replace("count_if(included) OVER", "sum(CASE WHEN included THEN 1 ELSE 0 END) OVER")


def _pairs(spark, sf_dir):
    return R.pair_arms(_sql(spark, sf_dir, ("study",), _PAIR_RUNS), ("manual", "assisted"), _sql(spark, sf_dir, (), _COMPLETED))


@query("j25_pair_arms", duck("study") + _PAIRED + " SELECT * FROM p")
def j25(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("a16_paired_median", duck("study") + _PAIRED + " SELECT count(*) AS pairs, median(reduction_percent) AS reduction_percent, coalesce(median(reduction_percent) >= 30, false) AS met FROM p WHERE eligible")
def a16(spark, sf_dir):
    return R.paired_median(_pairs(spark, sf_dir))


@query("j26_missing_runs", duck("study") + ", g AS (SELECT * FROM (SELECT DISTINCT participant FROM study) CROSS JOIN (SELECT DISTINCT case_id FROM study) CROSS JOIN (SELECT DISTINCT arm FROM study)) SELECT participant, case_id, arm FROM g EXCEPT SELECT participant, case_id, arm FROM study")
def j26(spark, sf_dir):
    s = view(spark, sf_dir, "study")
    return R.missing_runs(s.select("participant").distinct(), s.select("case_id").distinct(), s.select("arm").distinct(), s)


@query("a15_arm_metrics", duck("study") + " SELECT arm, count(*) AS runs, count_if(complete) AS complete, CAST(sum(seconds) AS BIGINT) AS seconds FROM study GROUP BY arm UNION ALL SELECT 'all', count(*), count_if(complete), CAST(sum(seconds) AS BIGINT) FROM study")
def a15(spark, sf_dir):
    return R.arm_metrics(view(spark, sf_dir, "study"))


@query("w13_reporting_run", duck("study") + " SELECT participant, case_id, arm, coalesce(arg_min(run_id, attempt) FILTER (WHERE run_id % 4 = 0), arg_max(run_id, attempt)) AS run_id FROM study GROUP BY ALL")
def w13(spark, sf_dir):
    return R.reporting_run(view(spark, sf_dir, "study").withColumn("included", F.col("run_id") % 4 == 0))


#: Runs with times: a run takes so many days that some overlap.
_TIMED = "SELECT run_id, participant, case_id, arm, attempt + CASE WHEN run_id % 101 = 0 THEN 1 ELSE 0 END AS attempt, started_at AS started, started_at + INTERVAL '20' DAY AS ended, run_id % 4 = 0 AS included, CAST(CASE WHEN run_id % 37 = 0 THEN 1728000 ELSE 60 END AS BIGINT) AS pause, outcome FROM study"


def _timed(spark, sf_dir):
    return _sql(spark, sf_dir, ("study",), _TIMED)


@query("w10_attempt_order", duck("study") + f""", t AS ({_TIMED}), v AS (SELECT run_id, concat_ws('; ', CASE WHEN attempt <> row_number() OVER w THEN 'attempt numbers have a gap' END, CASE WHEN lag(ended) OVER w > started THEN 'attempts overlap' END) AS violations FROM t
    WINDOW w AS (PARTITION BY participant, case_id, arm ORDER BY attempt, run_id)) SELECT * FROM v WHERE violations <> ''""")
def w10(spark, sf_dir):
    return R.attempt_order(_timed(spark, sf_dir))


@query("w11_overlaps", duck("study") + f", t AS ({_TIMED}), o AS (SELECT *, max(ended) OVER (PARTITION BY participant ORDER BY started, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t) SELECT run_id, participant FROM o WHERE b > started")
def w11(spark, sf_dir):
    return R.overlaps(_timed(spark, sf_dir))


_ORDERS = "SELECT DISTINCT o_custkey AS participant, CASE WHEN o_custkey % 3 = 0 THEN 'assisted' ELSE 'manual' END AS first, CASE WHEN o_custkey % 3 = 0 THEN 'manual' ELSE 'assisted' END AS second FROM orders WHERE o_custkey % 5 <> 0"


@query("w12_arm_order", duck("study") + f""", t AS ({_TIMED}), o AS ({_ORDERS}), g AS (SELECT t.participant, max(o.first) AS ordered, max(CASE WHEN arm = first THEN ended END) AS until, min(CASE WHEN arm = second THEN started END) AS since FROM t LEFT JOIN o ON t.participant = o.participant GROUP BY t.participant),
    p AS (SELECT participant, CASE WHEN ordered IS NULL THEN 'no order' WHEN since IS NOT NULL AND (until IS NULL OR until > since) THEN 'order' END AS problem FROM g) SELECT * FROM p WHERE problem IS NOT NULL""")
def w12(spark, sf_dir):
    return R.arm_order(_timed(spark, sf_dir), _sql(spark, sf_dir, (), _ORDERS))


_REVISED = "SELECT run_id, participant, case_id, arm, run_id % 8 < 5 AS included, participant % 4 + CASE WHEN run_id % 6 = 0 THEN 1 ELSE 0 END AS task, CASE WHEN run_id % 10 = 1 THEN NULL ELSE 'c1' END AS checklist FROM study"


@query("w12_revisions", duck("study") + f""", r AS ({_REVISED}), i AS (SELECT * FROM r WHERE included QUALIFY count(*) OVER (PARTITION BY participant, case_id, arm) = 1),
    v AS (SELECT m.participant, m.case_id, concat_ws('; ', CASE WHEN m.task IS DISTINCT FROM s.task THEN 'task' END, CASE WHEN m.checklist IS DISTINCT FROM s.checklist THEN 'checklist' END) AS differs
        FROM i m JOIN i s ON m.participant = s.participant AND m.case_id = s.case_id AND m.arm = 'manual' AND s.arm = 'assisted') SELECT * FROM v WHERE differs <> ''""")
def w12_revisions(spark, sf_dir):
    return R.revision_differences(_sql(spark, sf_dir, ("study",), _REVISED), ("manual", "assisted"), ["task", "checklist"])


@query("d13_check_runs", duck("study") + f""", t AS ({_TIMED}), v AS (SELECT run_id, concat_ws('; ', CASE WHEN NOT pause < 1728000 THEN 'pause' END, CASE WHEN sum(CASE WHEN included THEN 1 ELSE 0 END) OVER (PARTITION BY participant, case_id, arm) <> 1 THEN 'included runs' END, CASE WHEN outcome NOT IN ('F', 'O') THEN 'outcome' END) AS violations FROM t) SELECT * FROM v WHERE violations <> ''""")
def d13(spark, sf_dir):
    return R.check_runs(_timed(spark, sf_dir), ["F", "O"])


#: Participants; the second customer in seven consents at the very start of the first run, which is too late.
_PEOPLE = """SELECT o_custkey AS participant, CASE WHEN o_custkey % 6 = 0 THEN TIMESTAMP '1990-06-01 00:00:00' ELSE TIMESTAMP '1990-01-01 00:00:00' END AS approved,
    CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_custkey % 7 = 1 THEN min(o_orderdate) ELSE TIMESTAMP '1990-06-01 00:00:00' END AS consented,
    CASE WHEN o_custkey % 4 = 0 THEN TIMESTAMP '1996-01-01 00:00:00' WHEN o_custkey % 13 = 0 THEN TIMESTAMP '1990-06-01 00:00:00' ELSE TIMESTAMP '1990-07-01 00:00:00' END AS practised,
    CASE WHEN o_custkey % 5 = 0 THEN TIMESTAMP '1998-01-01 00:00:00' WHEN o_custkey % 17 = 0 THEN max(o_orderdate) + INTERVAL '20' DAY END AS withdrawn FROM orders GROUP BY o_custkey"""


@query("d20_check_participants", duck("study") + f""", t AS ({_TIMED}), g AS (SELECT participant, min(started) AS f, max(started) AS b, max(ended) AS l FROM t GROUP BY participant), v AS (SELECT participant, concat_ws('; ', CASE WHEN approved >= f THEN 'approval after a run' END,
    CASE WHEN coalesce(consented >= f, true) THEN 'consent after a run' END, CASE WHEN practised >= f THEN 'practice after a run' END, CASE WHEN consented <= approved THEN 'consent before approval' END, CASE WHEN coalesce(practised <= consented, true) THEN 'practice before consent' END,
    CASE WHEN consented >= withdrawn THEN 'consent after leaving' END, CASE WHEN practised > withdrawn THEN 'practice after leaving' END, CASE WHEN b >= withdrawn OR l > withdrawn THEN 'a run after leaving' END) AS violations FROM ({_PEOPLE}) JOIN g USING (participant)) SELECT * FROM v WHERE violations <> ''""")
def d20(spark, sf_dir):
    return R.check_participants(_sql(spark, sf_dir, (), _PEOPLE), _timed(spark, sf_dir))


_SEQ = "SELECT conv_id, CAST(turn AS INT) AS pos, CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN 'changed' ELSE text END AS item FROM conversations"
_WANTED = "SELECT conv_id, CAST(turn AS INT) AS pos, text AS item FROM conversations"


@query("w14_positional_match", f"""WITH a AS ({_SEQ}), e AS ({_WANTED})
    SELECT conv_id, avg(CASE WHEN a.item = e.item THEN 1.0 ELSE 0.0 END) AS rate, bool_and(coalesce(a.item = e.item, false)) AS in_order FROM e LEFT JOIN a USING (conv_id, pos) GROUP BY conv_id""")
def w14(spark, sf_dir):
    return R.positional_match(_sql(spark, sf_dir, (), _WANTED), _sql(spark, sf_dir, (), _SEQ), ["conv_id"])
