"""Queries on expected and extracted cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from docvigil.operators import cells as C
from docvigil.operators.fixpoint import written
from docvigil.plans.registry import query, select
from docvigil.plans.views import duck, view, with_views

_SAME = "trim(regexp_replace(c.text, '\\s+', ' ', 'g')) = trim(regexp_replace(a.text, '\\s+', ' ', 'g'))"
_MATCHED = f""", matched AS (
    SELECT c.*, a.case_id IS NOT NULL AS present, coalesce({_SAME}, false) AS text_match, c.l_suppkey % 8 <> 1 AS sourced,
           coalesce(c.l_suppkey % 8 <> 1 AND a.source_page = c.source_page AND a.source_x = c.source_x, false) AS source_match, coalesce(a.auto_confirmed AND c.requires_review, false) AS false_auto
    FROM cells c LEFT JOIN actual a USING (case_id, table_id, cell_id))"""
_METRICS = """count(*) AS expected_tables, CAST(sum(n) AS BIGINT) AS expected_cells, avg(CASE WHEN p THEN 1.0 ELSE 0.0 END) AS table_rate,
    CAST(sum(t) AS DOUBLE) / sum(n) AS cell_rate, CAST(sum(s) AS DOUBLE) / sum(q) AS source_rate, CAST(sum(f) AS BIGINT) AS false_auto"""


def _matched(spark, sf_dir):
    unsourced = F.col("l_suppkey") % 8 == 1  # some expected cells name no source
    expected = view(spark, sf_dir, "cells").withColumn("source_page", F.when(~unsourced, F.col("source_page")))
    return C.match_cells(expected, view(spark, sf_dir, "actual"))


@query("j1_match_cells", duck("actual") + _MATCHED + " SELECT case_id, table_id, cell_id, present, text_match, sourced, source_match, false_auto FROM matched")
def j1(spark, sf_dir):
    return _matched(spark, sf_dir).select("case_id", "table_id", "cell_id", "present", "text_match", "sourced", "source_match", "false_auto")


_TABLES = ", tables AS (SELECT {by} case_id, table_id, bool_or(present) AS p, count(*) AS n, count_if(text_match) AS t, count_if(sourced) AS q, count_if(source_match) AS s, count_if(false_auto) AS f FROM matched GROUP BY ALL)"


@query("a1_eval_metrics", duck("actual") + _MATCHED + _TABLES.format(by="") + f" SELECT {_METRICS} FROM tables")
def a1(spark, sf_dir):
    return C.eval_metrics(_matched(spark, sf_dir))


@query("a1_eval_metrics_by_group", duck("actual") + _MATCHED + _TABLES.format(by="l_returnflag,") + f" SELECT l_returnflag, {_METRICS} FROM tables GROUP BY l_returnflag")
def a1_by(spark, sf_dir):
    return C.eval_metrics(_matched(spark, sf_dir), ("l_returnflag",))


@query("j2_table_consistency", duck("actual") + f"""
    SELECT case_id, table_id, count_if(a.text IS NULL) AS missing, count_if(c.text IS NULL) AS extra, count_if(a.text IS NOT NULL AND c.text IS NOT NULL AND NOT {_SAME}) AS changed,
           count_if(a.text IS NULL) + count_if(c.text IS NULL) + count_if(a.text IS NOT NULL AND c.text IS NOT NULL AND NOT {_SAME}) = 0 AS consistent
    FROM (SELECT * FROM cells WHERE l_partkey % 19 <> 0) c FULL JOIN actual a USING (case_id, table_id, cell_id) GROUP BY case_id, table_id""")
def j2(spark, sf_dir):
    return C.table_consistency(view(spark, sf_dir, "cells").filter("l_partkey % 19 <> 0"), view(spark, sf_dir, "actual"))


_SIDE = """CONCAT(CAST(case_id AS STRING), '-', cell_id) AS item_id, CASE WHEN l_partkey % 3 = 0 THEN 'Lot No' ELSE 'colour' END AS label_id, 'f1' AS fixture_id, CONCAT('doc ', CAST(case_id AS STRING)) AS document_id,"""
_ITEMS = f"""SELECT {_SIDE} CASE WHEN case_id % 2 = 0 THEN 'b' END AS block_id, text AS value, CASE WHEN l_partkey % 5 = 0 THEN CAST(l_suppkey AS DOUBLE) END AS number, source_page AS page, source_x AS x, CASE l_partkey % 11 WHEN 0 THEN 'high' WHEN 1 THEN 'unknown' WHEN 3 THEN 'medium' ELSE 'low' END AS risk,
    CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE l_suppkey % 9 = 0 END AS requires_review, CASE WHEN l_partkey % 4 <> 0 THEN 'words' END AS extractor, 'pdf' AS kind FROM cells"""
_FOUND = f"""SELECT {_SIDE} CASE WHEN l_suppkey % 7 = 0 THEN 'c' ELSE 'b' END AS block_id, text AS value, CASE WHEN l_suppkey % 23 = 0 THEN l_suppkey + 1 ELSE CAST(l_suppkey AS DOUBLE) END AS number, source_page AS page, source_x AS x, CASE WHEN l_suppkey % 31 = 0 THEN 'critical' END AS risk,
    false AS requires_review, CASE WHEN l_suppkey % 6 = 0 THEN 'local-llm' ELSE 'words' END AS extractor, CASE WHEN l_suppkey % 10 = 0 THEN 'scanned_pdf' ELSE 'pdf' END AS kind, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(0.7 + (l_suppkey % 5) * 0.1 AS DOUBLE) END AS confidence, CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE auto_confirmed END AS auto_confirmed FROM actual"""


@query("j3_validate_items", duck("actual") + f""", e AS ({_ITEMS}), a AS ({_FOUND}), j AS (
    SELECT e.*, coalesce(e.label_id = a.label_id, false) AS lab, coalesce(e.fixture_id = a.fixture_id, false) AS fix, coalesce(e.document_id = a.document_id, false) AS doc, coalesce(e.block_id = a.block_id, false) AS blo, coalesce(trim(e.value) = trim(a.value), false) AS val, e.number IS NOT NULL AS num, coalesce(e.number = a.number, false) AS nu,
           coalesce(e.page = a.page AND e.x = a.x, false) AS pr, coalesce(e.risk = 'high', false) OR coalesce(a.risk = 'critical', false) AS high, coalesce(e.requires_review, false) AS explicit, NOT coalesce(a.confidence >= 0.8 AND a.confidence <= 1, false) AS unsure, a.auto_confirmed AS auto,
           coalesce(a.kind, '') = 'scanned_pdf' AS ocr, e.extractor IS NOT NULL AND NOT coalesce(e.extractor = a.extractor, false) AS mis, coalesce(a.extractor = 'local-llm', false) AS llm FROM e LEFT JOIN a USING (item_id)),
    k AS (SELECT *, explicit OR high OR num OR label_id = 'Lot No' AS imp FROM j), m AS (SELECT *, imp OR unsure OR ocr OR mis OR NOT pr AS review FROM k),
    f AS (SELECT item_id, review, concat_ws('|', CASE WHEN NOT lab OR NOT fix OR NOT doc OR (block_id IS NOT NULL AND NOT blo) OR (NOT imp AND NOT blo) THEN 'scope_binding' END, CASE WHEN CASE WHEN num THEN NOT nu ELSE NOT val END THEN 'value_non_modification' END, CASE WHEN NOT pr THEN 'provenance' END, CASE WHEN num AND NOT nu THEN 'numeric' END,
        CASE WHEN auto IS NULL OR (review AND auto) OR requires_review IS NULL OR risk = 'unknown' THEN 'risk_gate' END) AS failed, concat_ws('|', CASE WHEN unsure THEN 'item confidence requires human review' END, CASE WHEN ocr THEN 'ocr-derived item requires human review' END, CASE WHEN mis THEN 'extraction engine mismatch requires human review' END,
        CASE WHEN NOT pr THEN 'item source requires human review' END, CASE WHEN imp AND llm THEN 'llm-involved important item requires human review' END, CASE WHEN review THEN 'item requires human review' END) AS warned FROM m)
    SELECT item_id, CASE WHEN failed <> '' THEN 'block_auto_confirm' WHEN review THEN 'requires_review' ELSE 'pass' END AS status, failed, warned, failed = '' AND NOT review AS auto_confirm_allowed FROM f""")
def j3(spark, sf_dir):
    e, a = (select(spark, sf_dir, with_views("spark", "actual") + " " + q) for q in (_ITEMS, _FOUND))
    return C.validate_items(e, a).select("item_id", "status", F.concat_ws("|", "failed_rules").alias("failed"), F.concat_ws("|", "warnings").alias("warned"), "auto_confirm_allowed")


_TABLE_META = "SELECT DISTINCT case_id, table_id, CASE WHEN case_id % 2 = 0 THEN 'ocr' END AS engine, CASE WHEN case_id % 5 = 0 THEN 'llm' ELSE 'pdf' END AS source_kind FROM cells"
_CELL_META = "SELECT case_id, table_id, cell_id, CASE WHEN l_partkey % 3 = 0 THEN 'native' END AS engine, CASE WHEN l_partkey % 4 = 0 THEN 'xlsx' END AS source_kind FROM cells"


@query("j4_inherit_conditions", duck("cells") + f", t AS ({_TABLE_META}), c AS ({_CELL_META}) SELECT case_id, table_id, cell_id, coalesce(c.engine, t.engine) AS engine, coalesce(c.source_kind, t.source_kind) AS source_kind FROM c LEFT JOIN t USING (case_id, table_id)")
def j4(spark, sf_dir):
    t, c = (select(spark, sf_dir, with_views("spark", "cells") + " " + q) for q in (_TABLE_META, _CELL_META))
    return C.inherit_conditions(t, c, ["case_id", "table_id"], ["engine", "source_kind"])


_MODES = """SELECT mode, case_id, cell_id, CONCAT(CAST(case_id AS STRING), '/', cell_id) AS label, l_partkey % m <> 0 AS text_match, l_suppkey % m <> 0 AS source_match, l_partkey % m = 1 AND l_suppkey % 5 = 0 AS false_auto,
    l_discount >= 0.01 * m AS requires_review FROM cells CROSS JOIN (SELECT 'rules' AS mode, 3 AS m UNION ALL SELECT 'standard', 5 UNION ALL SELECT 'thorough', 7) k"""


@query("a6_mode_metrics", duck("cells") + f""", m AS ({_MODES}), w AS (SELECT DISTINCT mode, label FROM (SELECT mode, label FROM m WHERE false_auto UNION ALL SELECT mode, label FROM m WHERE case_id % 50 = 0))
    SELECT r.*, coalesce(false_auto_labels, 0) AS false_auto_labels FROM (SELECT mode, count(*) AS cells, count_if(text_match)::DOUBLE / count(*) AS cell_rate, count_if(source_match)::DOUBLE / count(*) AS source_rate, count_if(requires_review) AS reviews FROM m GROUP BY mode) r
    LEFT JOIN (SELECT mode, count(*) AS false_auto_labels FROM w GROUP BY mode) USING (mode)""")
def a6(spark, sf_dir):
    m = select(spark, sf_dir, with_views("spark", "cells") + " " + _MODES)
    return C.mode_metrics(m, m.filter("case_id % 50 = 0").select("mode", "label"))


@query("j24_mode_diff", duck("cells") + f""", m AS ({_MODES}), k AS (SELECT mode, label FROM m WHERE requires_review OR NOT text_match), b AS (SELECT label FROM k WHERE mode = 'rules')
    SELECT mode, count_if(b.label IS NULL) AS added, (SELECT count(*) FROM b) - count_if(b.label IS NOT NULL) AS removed FROM k LEFT JOIN b USING (label) WHERE mode <> 'rules' GROUP BY mode""")
def j24(spark, sf_dir):
    m = select(spark, sf_dir, with_views("spark", "cells") + " " + _MODES)
    return C.mode_diff(m.filter("requires_review OR NOT text_match").select("mode", F.col("label").alias("key")), "rules")


@query("d9_check_reported", """WITH c AS (SELECT l_suppkey AS k, sum(l_quantity) AS total, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)
    SELECT k, concat_ws('|', CASE WHEN k % 4 = 0 THEN 'total' END, CASE WHEN k % 6 = 0 OR k % 4 = 0 AND k % 9 = 0 THEN 'n' END) AS differs FROM c WHERE k % 4 = 0 OR k % 6 = 0""")
def d9(spark, sf_dir):
    c = select(spark, sf_dir, "SELECT l_suppkey AS k, sum(l_quantity) AS total, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_suppkey")
    r = c.select("k", (F.col("total") + F.when(F.col("k") % 4 == 0, 1).otherwise(0)).alias("total"), (F.col("n") + F.when((F.col("k") % 6 == 0) | (F.col("k") % 36 == 0), 0.5).otherwise(0)).alias("n"))
    return C.check_reported(r, c, ["k"], ["total", "n"]).select("k", F.concat_ws("|", "differs").alias("differs"))


#: Three extractors of a document's table: rank 2 loses cells, rank 3 changes texts.
_EXTRACTED = """SELECT CAST(case_id % 2000 AS STRING) AS doc, e.extractor, e.rank, CAST(case_id % 4 AS INT) AS table_no, CAST(case_id % 4 AS INT) + CASE WHEN e.rank = 2 AND case_id % 2000 % 41 = 0 THEN 1 ELSE 0 END AS page, CAST(case_id AS INT) AS row, CAST(cell_id AS INT) AS col, CONCAT(CASE WHEN e.rank = 3 AND l_partkey % 97 = 0 THEN 'x' ELSE '' END, text) AS text,
    e.rank <> 2 OR case_id % 2000 % 7 <> 0 AS boxed FROM cells CROSS JOIN (SELECT 'lattice' AS extractor, 1 AS rank UNION ALL SELECT 'stream', 2 UNION ALL SELECT 'words', 3) e WHERE NOT (e.rank = 2 AND l_partkey % 89 = 0) AND NOT (e.rank = 1 AND case_id % 2000 % 53 = 0)"""


@query("a22_table_shape", duck("cells") + f""", x AS ({_EXTRACTED}), r AS (SELECT doc, extractor, table_no, row, count(*) AS w, count_if(NOT boxed) AS u FROM x GROUP BY ALL)
    SELECT doc, extractor, table_no, count(*) AS n_rows, min(w) AS narrowest, max(w) AS widest, min(w) = max(w) AS rectangular, sum(u) = 0 AS complete_boxes FROM r GROUP BY ALL""")
def a22(spark, sf_dir):
    x = select(spark, sf_dir, with_views("spark", "cells") + " " + _EXTRACTED)
    return C.table_shape(x, ["doc", "extractor", "table_no"])


#: The extractors that ran on each document; the third was not always there.
_RAN = "SELECT DISTINCT CAST(case_id % 2000 AS STRING) AS doc, e.extractor, e.rank, CASE WHEN e.rank = 3 AND case_id % 2000 % 31 = 0 THEN 'not-installed' ELSE 'ok' END AS status FROM cells CROSS JOIN (SELECT 'lattice' AS extractor, 1 AS rank UNION ALL SELECT 'stream', 2 UNION ALL SELECT 'words', 3) e"

_APART = f""", x AS ({_EXTRACTED}), e AS ({_RAN}), w AS (SELECT doc, extractor, rank, table_no, row, min(page) AS page, count(*) AS width, list(text ORDER BY col) AS texts, bool_and(boxed) AS boxed FROM x GROUP BY ALL),
    t AS (SELECT doc, extractor, rank, table_no, min(page) AS page, bool_and(boxed) AS boxed, list(width ORDER BY row) AS s, list(texts ORDER BY row) AS b FROM w WHERE (doc, extractor) IN (SELECT (doc, extractor) FROM e WHERE status = 'ok') GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc, extractor ORDER BY table_no) AS place FROM t), n AS (SELECT e.doc, e.extractor, e.rank, count(t.doc) AS n FROM e LEFT JOIN t USING (doc, extractor) WHERE e.status = 'ok' GROUP BY ALL),
    apart AS (SELECT l.doc, l.extractor AS "left", r.extractor AS "right", 'candidate-table-count' AS kind, 1 AS tables FROM n l JOIN n r ON l.doc = r.doc AND l.rank < r.rank AND l.n <> r.n
    UNION ALL SELECT l.doc, l.extractor, r.extractor, 'candidate-page', count(*) FROM p l JOIN p r ON l.doc = r.doc AND l.place = r.place AND l.rank < r.rank AND l.page <> r.page GROUP BY ALL
    UNION ALL SELECT l.doc, l.extractor, r.extractor, CASE WHEN l.s <> r.s THEN 'candidate-shape' ELSE 'candidate-text' END, count(*) FROM p l JOIN p r ON l.doc = r.doc AND l.place = r.place AND l.rank < r.rank AND (l.s <> r.s OR l.b <> r.b) GROUP BY ALL),
    own AS (SELECT doc, extractor, 'missing-table' AS kind, 1 AS tables FROM n WHERE n = 0 UNION ALL SELECT doc, extractor, 'row-count', 1 FROM p WHERE place = 1 AND len(s) <> 8 UNION ALL SELECT doc, extractor, 'column-count', 1 FROM p WHERE place = 1 AND len(list_filter(s, lambda v: v <> 4)) > 0 UNION ALL SELECT doc, extractor, 'cell-boundary', count(*) FROM p WHERE NOT boxed GROUP BY ALL)"""


def _candidates(spark, sf_dir):
    x, e = (select(spark, sf_dir, with_views("spark", "cells") + " " + q) for q in (_EXTRACTED, _RAN))
    return C.candidate_tables(x), written(e)


@query("j15_compare_candidates", duck("cells") + _APART + ' SELECT doc, "left", "right", kind, CAST(tables AS BIGINT) AS tables FROM apart')
def j15(spark, sf_dir):
    return C.compare_candidates(*_candidates(spark, sf_dir))


@query("d15_check_candidates", duck("cells") + _APART + " SELECT doc, extractor, kind, CAST(tables AS BIGINT) AS tables FROM own")
def d15a(spark, sf_dir):
    return C.check_candidates(*_candidates(spark, sf_dir), expected=(8, 4))


_PICKED = _APART + """, picked AS (SELECT d.doc, s.selected FROM (SELECT DISTINCT doc FROM e) d LEFT JOIN (SELECT n.doc, arg_min(extractor, rank) AS selected FROM n WHERE (n.doc, n.extractor) NOT IN (SELECT (doc, extractor) FROM own WHERE kind IN ('missing-table', 'cell-boundary'))
    AND NOT EXISTS (SELECT 1 FROM apart p WHERE p.doc = n.doc AND n.extractor IN (p."left", p."right")) GROUP BY n.doc) s USING (doc))"""


@query("t1_select_candidate", duck("cells") + _PICKED + " SELECT * FROM picked")
def t1(spark, sf_dir):
    x, e = _candidates(spark, sf_dir)
    return C.select_candidate(e, C.check_candidates(x, e), C.compare_candidates(x, e))


@query("d15_table_warnings", duck("cells") + _PICKED + """, v AS (SELECT doc, concat_ws('; ', CASE WHEN selected IS NULL THEN 'no table selected' END, CASE WHEN doc IN (SELECT doc FROM apart) OR doc IN (SELECT doc FROM own WHERE kind IN ('missing-table', 'cell-boundary')) THEN 'candidates disagreed' END, CASE WHEN (SELECT bool_or(status <> 'ok') FROM e WHERE e.doc = picked.doc) THEN 'candidate unavailable: words' END) AS warnings FROM picked)
    SELECT * FROM v WHERE warnings <> ''""")
def d15(spark, sf_dir):
    x, e = _candidates(spark, sf_dir)
    own, pairs = C.check_candidates(x, e), C.compare_candidates(x, e)
    return C.table_warnings(e, own, pairs, C.select_candidate(e, own, pairs))


@query("a19_extractor_summary", """SELECT doc_id AS doc, source AS extractor, count(*) AS fragments, count_if(trim(text) <> '') AS with_text, CASE WHEN count_if(trim(text) <> '') > 0 THEN 'ok' ELSE 'no-text' END AS status
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY ALL""")
def a19(spark, sf_dir):
    docs = select(spark, sf_dir, "SELECT doc_id, source, text FROM documents")
    return C.extractor_summary(docs.select(F.col("doc_id").alias("doc"), F.col("source").alias("extractor"), F.explode(F.split("text", "\n")).alias("text")))


_OCR = ", regions AS (SELECT doc_id AS doc, page, text, CASE WHEN idx % 17 = 3 THEN NULL ELSE least(1, confidence + 0.25) END AS confidence FROM blocks WHERE doc_id % 9 <> 0), pages_ AS (SELECT DISTINCT doc_id AS doc, page FROM blocks)"
_STATUS = _OCR + """, st AS (SELECT p.doc, p.page, count(r.doc) AS regions, count_if(r.doc IS NOT NULL AND (confidence IS NULL OR confidence < 0.8)) AS low_regions FROM pages_ p LEFT JOIN (SELECT * FROM regions WHERE trim(text) <> '') r ON p.doc = r.doc AND p.page = r.page GROUP BY ALL),
    st2 AS (SELECT *, CASE WHEN regions = 0 THEN 'no-text' WHEN low_regions > 0 THEN 'low-confidence' ELSE 'ok' END AS status FROM st)"""


def _ocr(spark, sf_dir):
    b = view(spark, sf_dir, "blocks")
    regions = b.filter("doc_id % 9 <> 0").select(F.col("doc_id").alias("doc"), "page", "text", F.when(F.col("idx") % 17 != 3, F.least(F.lit(1.0), F.col("confidence") + 0.25)).alias("confidence"))
    return C.ocr_pages(regions, b.select(F.col("doc_id").alias("doc"), "page").distinct())


@query("a18_ocr_page_status", duck("blocks") + _STATUS + " SELECT * FROM st2")
def a18(spark, sf_dir):
    return _ocr(spark, sf_dir)


@query("a18_ocr_engine_status", duck("blocks") + _STATUS + """ SELECT doc, count(*) AS pages, CAST(sum(regions) AS BIGINT) AS regions, CAST(sum(low_regions) AS BIGINT) AS low_regions, CASE WHEN bool_and(status = 'no-text') THEN 'no-text' WHEN bool_or(status = 'low-confidence') THEN 'low-confidence' ELSE 'ok' END AS engine_status FROM st2 GROUP BY doc""")
def a18b(spark, sf_dir):
    return C.ocr_engines(_ocr(spark, sf_dir))


_KEYS = duck("actual") + ", e AS (SELECT case_id, cell_id FROM cells WHERE l_partkey % 23 <> 0), a AS (SELECT case_id, cell_id FROM actual)"


def _keys(spark, sf_dir):
    return view(spark, sf_dir, "cells").filter("l_partkey % 23 <> 0").select("case_id", "cell_id"), view(spark, sf_dir, "actual").select("case_id", "cell_id")


@query("u2_same_set", _KEYS + ", l AS (SELECT * FROM e EXCEPT SELECT * FROM a), r AS (SELECT * FROM a EXCEPT SELECT * FROM e) SELECT (SELECT count(*) FROM l) AS only_left, (SELECT count(*) FROM r) AS only_right, (SELECT count(*) FROM l) + (SELECT count(*) FROM r) = 0 AS same")
def u2(spark, sf_dir):
    return C.same_set(*_keys(spark, sf_dir))


@query("u3_union_labels", _KEYS + " SELECT * FROM e UNION SELECT * FROM a")
def u3(spark, sf_dir):
    return C.union_labels(*_keys(spark, sf_dir))


@query("u4_common", _KEYS + " SELECT * FROM e INTERSECT SELECT * FROM a")
def u4(spark, sf_dir):
    return C.common(*_keys(spark, sf_dir))


@query("u5_delta", _KEYS + " SELECT *, 'removed' AS change FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'added' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)")
def u5(spark, sf_dir):
    return C.delta(*_keys(spark, sf_dir))


@query("u6_distinct_warnings", """SELECT user_id, array_to_string(list(event_type ORDER BY first), '|') AS event_type FROM (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL) GROUP BY user_id""")
def u6(spark, sf_dir):
    e = select(spark, sf_dir, "SELECT user_id, ts, event_id, event_type FROM events")
    return C.distinct_warnings(e, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", F.concat_ws("|", "event_type").alias("event_type"))


@query("w9_duplicates", "SELECT event_id, user_id, event_type, n, place FROM (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS place FROM events WINDOW w AS (PARTITION BY user_id, event_type)) WHERE n > 1")
def w9(spark, sf_dir):
    e = select(spark, sf_dir, "SELECT event_id, user_id, event_type, ts FROM events")
    return C.duplicates(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")
