"""Queries on categories, warnings, parameters, samples, artifacts and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from docvigil.functions import categories as K
from docvigil.operators import checks as H
from docvigil.operators import parameters as P
from docvigil.plans.registry import query, select
from docvigil.plans.views import duck, view, with_views


def _sql(spark, sf_dir, views, text):
    return select(spark, sf_dir, f"{with_views('spark', *views)} {text}" if views else text)


_NAMES = "SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'Lot No' WHEN 1 THEN 'approvedBy' WHEN 2 THEN 'main_expiry_date' WHEN 3 THEN 'first-Operator ' WHEN 4 THEN 'dock_timestamp' WHEN 5 THEN 'colour' WHEN 6 THEN 'Judgment' WHEN 7 THEN 'targetYield' WHEN 8 THEN 'pack date' ELSE 'plain-name' END AS n FROM part"


@query("p3_norm_category", "SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'lot_number' WHEN 1 THEN 'person' WHEN 2 THEN 'date_time' WHEN 3 THEN 'person' WHEN 4 THEN 'date_time' WHEN 5 THEN 'colour' WHEN 6 THEN 'judgment' WHEN 7 THEN 'numeric_value' WHEN 8 THEN 'date_time' ELSE 'plain_name' END AS category FROM part")
def p3(spark, sf_dir):
    return _sql(spark, sf_dir, (), _NAMES).select("p_partkey", K.norm_category(F.col("n")).alias("category"))


@query("p4_type_category", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'numeric_value' WHEN 1 THEN 'date_time' WHEN 2 THEN '' WHEN 3 THEN 'numeric_value' ELSE '' END AS category FROM part")
def p4(spark, sf_dir):
    t = F.expr("CASE p_partkey % 5 WHEN 0 THEN ' Integer' WHEN 1 THEN 'DateTime' WHEN 2 THEN 'string' WHEN 3 THEN 'decimal' END")
    return _sql(spark, sf_dir, (), "SELECT p_partkey FROM part").select("p_partkey", K.type_category(t).alias("category"))


_EXTRACTORS = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Scanned PDF' WHEN 1 THEN 'pdf' WHEN 2 THEN 'my-ocr' END AS kind, CASE p_size % 5 WHEN 0 THEN 'Tesseract 5' WHEN 1 THEN 'local-LLM' WHEN 2 THEN 'words' WHEN 3 THEN 'gpt' END AS extractor, p_partkey % 11 = 0 AS llm FROM part"


@query("p14_extractor_kind", f"SELECT p_partkey, p_partkey % 4 IN (0, 2) OR coalesce(extractor, '') LIKE 'Tess%' AS ocr, llm OR coalesce(extractor, '') IN ('local-LLM', 'gpt') AS llm FROM ({_EXTRACTORS})")
def p14(spark, sf_dir):
    return _sql(spark, sf_dir, (), _EXTRACTORS).select("p_partkey", K.ocr_derived(F.col("kind"), F.col("extractor")).alias("ocr"), K.llm_involved(F.col("llm"), F.col("extractor")).alias("llm"))


@query("p21_high_risk", "SELECT p_partkey, p_partkey % 7 = 0 OR p_size % 10 < 2 OR p_partkey % 9 = 0 AS high FROM part")
def p21(spark, sf_dir):
    warnings = F.when(F.col("p_partkey") % 9 == 0, F.array(F.lit("note"), F.lit("High-Risk value"))).otherwise(F.array(F.lit("note")))
    level = F.when(F.col("p_size") % 10 == 0, "high").when(F.col("p_size") % 10 == 1, "critical").when(F.col("p_size") % 10 == 2, "low")
    return _sql(spark, sf_dir, (), "SELECT p_partkey, p_size FROM part").select("p_partkey", K.is_high_risk(F.col("p_partkey") % 7 == 0, level, warnings).alias("high"))


#: Warnings by place, each with the code, severity and remedy that it has.
_WARNINGS = [
    ("blocks[7].low confidence", "DOCUMENT_LOW_CONFIDENCE", "warning", "Compare the extracted value with the source document before approval."),
    ("page 3: blocks[12].text empty; block marked requires_review", "DOCUMENT_TEXT_EMPTY", "error", "Compare with the source and supply the missing text before approval."),
    ("blocks[1].strange", "UNCLASSIFIED_WARNING", "warning", "Review the warning and source evidence before approval."),
    ("LLM conversion plan fallback: llm_fallback_missing_model", "LLM_FALLBACK_MISSING_MODEL", "warning", "Configure the required local LLM model or review the deterministic result."),
    ("LLM conversion plan fallback: unknown", "UNCLASSIFIED_WARNING", "warning", "Review the warning and source evidence before approval."),
    ("LLM conversion blocked: configured API key is not trusted", "LLM_CONFIGURATION_CREDENTIAL_REJECTED", "error", "Replace the placeholder API key with a trusted credential before retrying."),
    ("OCR conversion setting is not implemented in the local PoC API", "CONVERSION_SETTING_UNSUPPORTED", "warning", "Disable the unsupported setting or use a supported conversion path."),
    ("llm_fallback_missing_model", "UNCLASSIFIED_WARNING", "warning", "Review the warning and source evidence before approval."),
]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _lit_array(values: list[str]):
    return F.array(*[F.lit(v) for v in values])


@query("p15_classify_warnings", duck("blocks") + f""", w AS (SELECT block_id, unnest([0, 1]) AS place, unnest([idx % 8, (idx * 3 + 1) % 8]) AS k FROM blocks)
    SELECT block_id, place, {_sql_list([w[0] for w in _WARNINGS])}[k + 1] AS message, {_sql_list([w[1] for w in _WARNINGS])}[k + 1] AS code, {_sql_list([w[2] for w in _WARNINGS])}[k + 1] AS severity, {_sql_list([w[3] for w in _WARNINGS])}[k + 1] AS remediation FROM w""")
def p15(spark, sf_dir):
    said = _lit_array([w[0] for w in _WARNINGS])
    b = view(spark, sf_dir, "blocks").withColumn("warnings", F.array(F.get(said, F.col("idx") % 8), F.get(said, (F.col("idx") * 3 + 1) % 8)))
    return P.classify_warnings(b, "block_id", "warnings")


#: Parameters with ~ for an event's type, what is left of them without secrets, and what carries content,
#: as ``path: reason``. Worked out by hand.
_PARAMS = [
    ('{"apiKey":"~","k":1}', '{"apiKey":"[REDACTED]","k":1}', ""),
    ('{"outer":{"password":"open ~ now","deep":{"clientSecret":{"v":"~"}}},"n":1.5}', '{"outer":{"password":"[REDACTED]","deep":{"clientSecret":"[REDACTED]"}},"n":1.5}', ""),
    ('{"outer":{"token":["~","bb"]},"list":[{"note":"~"},{"session":7}]}', '{"outer":{"token":"[REDACTED]"},"list":[{"note":"~"},{"session":"[REDACTED]"}]}', ""),
    ('{"url":"https://me:pw@~.org/x","plain":"https://~.org/x?a=1"}', '{"url":"[REDACTED]","plain":"https://~.org/x?a=1"}', ""),
    ('{"note":"token=abc 123&mode=~","max_tokens":5}', '{"note":"token=[REDACTED]&mode=~","max_tokens":5}', ""),
    ('{"prompt":"words ~","content_type":"t"}', '{"prompt":"words ~","content_type":"t"}', "prompt: content-bearing name"),
    ('password: hunter2 ~, rest', 'password: [REDACTED]', ": no JSON object"),
    ('{"headers":[["Authorization","Digest ~"],["Accept","~"]],"options":[{"name":"api-key","value":"~"},{"name":"mode","value":"~"}]}', '{"headers":[["Authorization","[REDACTED]"],["Accept","~"]],"options":[{"name":"api-key","value":"[REDACTED]"},{"name":"mode","value":"~"}]}', ""),
    ('{"metadata_json":"{\\"auth\\":{\\"u\\":1},\\"kind\\":\\"~\\"}"}', '{"metadata_json":"{\\"auth\\":\\"[REDACTED]\\",\\"kind\\":\\"~\\"}"}', ""),
    ('{"json_schema":{"schema":{"properties":{"password":{"type":"string"},"body":{"enum":["open","~ x"]}}}}}', '{"json_schema":{"schema":{"properties":{"password":{"type":"string"},"body":{"enum":["open","~ x"]}}}}}', "json_schema.schema.properties.body.enum: schema literal"),
    ('[{"secret":"~"},"plain"]', '[{"secret":"[REDACTED]"},"plain"]', ": no JSON object"),
    ('{"a":{"request":{"messages":[{"role":"u"}]},"message_count":2,"raw_output":"~"},"q":"mode=~&text=hello"}', '{"a":{"request":{"messages":[{"role":"u"}]},"message_count":2,"raw_output":"~"},"q":"mode=~&text=hello"}', "a.request.messages: content-bearing name|a.raw_output: content-bearing name|q: content in a query"),
    ('{"a":"{broken, secret ~"}', '{"a":"[REDACTED]"}', ""),
    ('{"a":"sk-~1234","b":"Bearer ~","c":"%70assword%3D~"}', '{"a":"[REDACTED]","b":"Bearer [REDACTED]","c":"[REDACTED]"}', ""),
]


def _params(spark, sf_dir):
    e = _sql(spark, sf_dir, (), "SELECT event_id, event_type FROM events")
    return e.select("event_id", F.replace(F.get(_lit_array([p[0] for p in _PARAMS]), (F.col("event_id") % len(_PARAMS)).cast("int")), F.lit("~"), F.col("event_type")).alias("p"))


@query("p17_redact_params", f"SELECT event_id, replace({_sql_list([p[1] for p in _PARAMS])}[event_id % {len(_PARAMS)} + 1], '~', event_type) AS parameters FROM events")
def p17(spark, sf_dir):
    return P.redact_params(_params(spark, sf_dir), "event_id", "p")


_CONTENT_SQL = f"SELECT event_id, unnest(string_split({_sql_list([p[2] for p in _PARAMS])}[event_id % {len(_PARAMS)} + 1], '|')) AS f FROM events"


@query("p18_reject_content", f"WITH c AS ({_CONTENT_SQL}) SELECT event_id, string_split(f, ': ')[1] AS name, string_split(f, ': ')[2] AS reason FROM c WHERE f <> ''")
def p18(spark, sf_dir):
    return P.reject_content(_params(spark, sf_dir), "event_id", "p")


_LINEAGE = "SELECT doc_id, text, upper(source) AS out, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE 'm1' END AS model, 'p' AS prompt_id, CASE WHEN doc_id % 13 <> 0 THEN 'v2' END AS prompt_version, 'ir1' AS ir_version, CASE WHEN doc_id % 7 = 0 THEN '{{\"text\":\"x\"}}' WHEN doc_id % 5 = 0 THEN NULL ELSE '{{\"a\":{{\"token\":\"x\"}}}}' END AS p FROM documents".replace("{{", "{").replace("}}", "}")


@query("p22_audit_record", f"""WITH d AS ({_LINEAGE}), v AS (SELECT *, concat_ws('; ', CASE WHEN trim(model) = '' THEN 'model is required' END, CASE WHEN prompt_version IS NULL THEN 'prompt_version is required' END, CASE WHEN doc_id % 7 = 0 THEN 'parameters carry content' END) AS problem FROM d)
    SELECT doc_id, sha256(text) AS source_sha256, sha256(out) AS output_sha256, CAST(length(text) AS INT) AS source_chars, CAST(length(out) AS INT) AS output_chars, model, prompt_id, prompt_version, ir_version, CASE WHEN problem = '' THEN CASE WHEN doc_id % 5 = 0 THEN '{{}}' ELSE '{{"a":{{"token":"[REDACTED]"}}}}' END END AS parameters, problem FROM v""")
def p22(spark, sf_dir):
    return P.audit_record(_sql(spark, sf_dir, (), _LINEAGE), "doc_id", "text", "out", "p")


_SAMPLES = "SELECT o_orderkey AS sample_id, CONCAT('m', CAST(o_custkey % 40 AS STRING)) AS mode, o_custkey AS fixture_id, o_orderkey % 7 = 0 AS placeholder FROM orders WHERE o_custkey % 40 <> 5 AND (o_custkey % 40 <> 6 OR o_orderkey % 7 = 0)"


@query("j30_link_samples", f"""WITH s AS ({_SAMPLES}), r AS (SELECT DISTINCT 'm' || (o_custkey % 41) AS mode FROM orders), u AS (SELECT mode, min(sample_id) AS m, count(*) AS n FROM s WHERE NOT placeholder AND fixture_id % 3 <> 0 GROUP BY mode), p AS (SELECT mode, min(sample_id) AS m FROM s WHERE placeholder GROUP BY mode)
    SELECT r.mode, coalesce(u.m, p.m) AS sample_id, coalesce(u.n, 0) AS usable, CASE WHEN u.m IS NOT NULL THEN 'linked' WHEN p.m IS NOT NULL THEN 'placeholder' ELSE 'missing' END AS state FROM r LEFT JOIN u USING (mode) LEFT JOIN p USING (mode)""")
def j30(spark, sf_dir):
    r = _sql(spark, sf_dir, (), "SELECT DISTINCT CONCAT('m', CAST(o_custkey % 41 AS STRING)) AS mode FROM orders")
    f = _sql(spark, sf_dir, (), "SELECT c_custkey AS fixture_id, c_custkey % 3 <> 0 AS usable FROM customer")
    return H.link_samples(r, _sql(spark, sf_dir, (), _SAMPLES), f)


_GRID = "SELECT l_orderkey AS case_id, CONCAT(chr(CAST(65 + l_linenumber AS INT)), CAST(l_partkey AS STRING)) AS ref, max(CAST(l_suppkey AS STRING)) AS value, max(CASE WHEN l_partkey % 5 = 0 THEN 'text' ELSE 'number' END) AS value_type FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey"


@query("j31_match_grid", f"""WITH e AS ({_GRID}), a AS (SELECT case_id, ref, CASE WHEN value LIKE '%7' THEN value || '0' ELSE value END AS value, CASE WHEN value LIKE '%3' THEN 'text' ELSE value_type END AS value_type, CASE WHEN value LIKE '%1' THEN 'source: p1' END AS comment FROM e WHERE NOT value LIKE '%9')
    SELECT case_id, count(*) AS cells, count_if(coalesce(e.value = a.value AND e.value_type = a.value_type, false)) AS matched, count_if(coalesce(e.value = a.value AND e.value_type = a.value_type, false))::DOUBLE / count(*) AS rate, count_if(coalesce(contains(comment, 'source'), false)) AS sourced, count(DISTINCT regexp_extract(ref, '(\\d+)', 1)) AS rows, count(DISTINCT regexp_extract(ref, '([A-Z]+)', 1)) AS columns
    FROM e LEFT JOIN a USING (case_id, ref) GROUP BY case_id""")
def j31(spark, sf_dir):
    e = _sql(spark, sf_dir, (), _GRID)
    a = e.filter("NOT value LIKE '%9'").selectExpr("case_id", "ref", "CASE WHEN value LIKE '%7' THEN concat(value, '0') ELSE value END AS value", "CASE WHEN value LIKE '%3' THEN 'text' ELSE value_type END AS value_type", "CASE WHEN value LIKE '%1' THEN 'source: p1' END AS comment")
    return H.match_grid(e, a, ["case_id"])


@query("j32_match_blocks", duck("blocks") + """ SELECT doc_id, count(*) AS blocks, count_if(idx % 5 <> 1 AND idx % 8 <> 7 AND trim(text) <> '')::DOUBLE / count(*) AS body_rate, count_if(idx % 3 <> 0 AND idx % 8 <> 7)::DOUBLE / count(*) AS link_rate,
    CASE WHEN count_if(confidence < 0.8) = 0 THEN 0 ELSE count_if(confidence < 0.8 AND idx % 2 = 0 AND idx % 8 <> 7)::DOUBLE / count_if(confidence < 0.8) END AS guard_rate FROM blocks GROUP BY doc_id""")
def j32(spark, sf_dir):
    e = view(spark, sf_dir, "blocks").select("doc_id", F.col("idx").alias("pos"), "text", F.col("page").alias("link"), (F.col("confidence") < 0.8).alias("guard"))
    a = e.filter("pos % 8 <> 7").selectExpr("doc_id", "pos", "CASE WHEN pos % 5 = 1 THEN concat(text, '!') ELSE text END AS text", "CASE WHEN pos % 3 = 0 THEN 0 ELSE link END AS link", "pos % 2 = 0 AS guard")
    return H.match_blocks(e, a, ["doc_id"])


_WARNED = "SELECT user_id AS case_id, CONCAT(event_type, ' ', CAST(event_id % 9 AS STRING)) AS warning FROM events"


@query("j33_warning_diff", f"WITH w AS ({_WARNED}), e AS (SELECT * FROM w WHERE case_id % 4 <> 0), a AS (SELECT * FROM w WHERE case_id % 5 <> 0 AND NOT warning LIKE '%3') SELECT case_id, warning, 'missing' AS kind FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT case_id, warning, 'unexpected' FROM (SELECT * FROM a EXCEPT SELECT * FROM e) WHERE NOT warning LIKE 'click%'")
def j33(spark, sf_dir):
    w = _sql(spark, sf_dir, (), _WARNED)
    return H.warning_diff(w.filter("case_id % 4 <> 0"), w.filter("case_id % 5 <> 0 AND NOT warning LIKE '%3'"), ["click"])


_MERGES = "SELECT l_orderkey AS block_id, CONCAT(CAST(l_orderkey AS STRING), '/', CAST(l_partkey AS STRING), '/', CAST(l_suppkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS merge_id, CAST(min(l_linenumber) AS INT) AS r1, CAST(min(l_partkey % 4) AS INT) AS c1, CAST(min(l_linenumber) AS INT) + 1 AS r2, CAST(min(l_partkey % 4) AS INT) + CAST(min(l_suppkey % 3) AS INT) AS c2 FROM lineitem WHERE l_suppkey % 5 = 0 GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber"
_MERGE_CELLS = "SELECT DISTINCT l_orderkey AS block_id, CAST(l_linenumber AS INT) AS row, CAST(l_partkey % 6 AS INT) AS col, CASE WHEN l_orderkey % 2 = 0 THEN 'v' ELSE ' ' END AS text FROM lineitem"
_MERGE_BLOCKS = "SELECT DISTINCT l_orderkey AS block_id, 8 AS n_rows, 5 AS n_cols FROM lineitem WHERE l_orderkey % 9 <> 0"


@query("j36_check_merges", f"""WITH m AS ({_MERGES}), c AS ({_MERGE_CELLS}), v AS (SELECT merge_id, concat_ws('; ', CASE WHEN block_id % 9 = 0 THEN 'unknown block' END, CASE WHEN block_id % 9 <> 0 AND (r2 >= 8 OR c2 >= 5) THEN 'outside table' END,
    CASE WHEN EXISTS (SELECT 1 FROM m o WHERE o.block_id = m.block_id AND o.merge_id <> m.merge_id AND o.r1 <= m.r2 AND m.r1 <= o.r2 AND o.c1 <= m.c2 AND m.c1 <= o.c2) THEN 'overlap' END,
    CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.block_id = m.block_id AND trim(c.text) <> '' AND c.row BETWEEN m.r1 AND m.r2 AND c.col BETWEEN m.c1 AND m.c2 AND NOT (c.row = m.r1 AND c.col = m.c1)) THEN 'value lost' END) AS violations FROM m) SELECT * FROM v WHERE violations <> ''""")
def j36(spark, sf_dir):
    return H.check_merges(_sql(spark, sf_dir, (), _MERGES), _sql(spark, sf_dir, (), _MERGE_CELLS), _sql(spark, sf_dir, (), _MERGE_BLOCKS))


_NOTES = "SELECT l_orderkey * 10 + l_linenumber AS annotation_id, l_orderkey AS block_id, CASE WHEN l_partkey % 8 = 0 THEN ' ' WHEN l_partkey % 8 = 1 THEN NULL ELSE 'seen' END AS text FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber) x"
_NOTED = "SELECT o_orderkey AS block_id FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0"


@query("j36_check_annotations", f"""WITH b AS (SELECT block_id, count(*) AS n FROM ({_NOTED}) GROUP BY block_id), v AS (SELECT annotation_id, concat_ws('; ', CASE WHEN n IS NULL THEN 'unknown block' END, CASE WHEN n > 1 THEN 'repeated block' END, CASE WHEN coalesce(trim(text), '') = '' THEN 'no text' END) AS violations FROM ({_NOTES}) a LEFT JOIN b USING (block_id)) SELECT * FROM v WHERE violations <> ''""")
def j36_annotations(spark, sf_dir):
    return H.check_annotations(_sql(spark, sf_dir, (), _NOTES), _sql(spark, sf_dir, (), _NOTED))


_PLANS = """SELECT o_orderkey AS run_id, CASE o_orderkey % 6 WHEN 0 THEN '{"operations":[{"action":"copy"}],"external":false}' WHEN 1 THEN '{"operations":[{"action":"send"}],"external":false}' WHEN 2 THEN '{"operations":[],"external":true}' WHEN 3 THEN '{"operations":[{"action":"map"}],"external":false,"x":1}' WHEN 4 THEN 'no plan' ELSE '{"external":false}' END AS plan FROM orders"""


@query("d7_check_plans", "SELECT o_orderkey AS run_id, CASE o_orderkey % 6 WHEN 1 THEN 'action' WHEN 2 THEN 'external' WHEN 3 THEN 'keys' WHEN 4 THEN 'keys; external' ELSE 'keys' END AS violations FROM orders WHERE o_orderkey % 6 <> 0")
def d7(spark, sf_dir):
    return H.check_plans(_sql(spark, sf_dir, (), _PLANS), "plan", ["copy", "map"])


_MARKED = "SELECT block_id AS id, block_id, CONCAT('l', CAST(idx % 6 AS STRING)) AS label_id, CASE WHEN idx % 7 = 0 THEN 'low' ELSE 'high' END AS risk_level, idx % 5 <> 0 AS requires_review, CASE WHEN idx % 8 <> 0 THEN 'v' END AS value, CASE WHEN doc_id % 9 = 0 THEN CONCAT(text, '.') ELSE text END AS text FROM blocks"


@query("d8_check_labels", duck("blocks") + ", v AS (SELECT block_id AS id, concat_ws('; ', CASE WHEN idx % 6 IN (0, 5) THEN 'taxonomy' END, CASE WHEN idx % 7 = 0 THEN 'risk' END, CASE WHEN idx % 5 = 0 THEN 'review' END, CASE WHEN idx % 8 = 0 THEN 'value' END, CASE WHEN doc_id % 9 = 0 THEN 'text' END) AS violations FROM blocks) SELECT * FROM v WHERE violations <> ''")
def d8(spark, sf_dir):
    taxonomy = spark.createDataFrame([("l0",), ("l0",), ("l1",), ("l2",), ("l3",), ("l4",)], "label_id string")
    return H.check_labels(_sql(spark, sf_dir, ("blocks",), _MARKED), taxonomy, view(spark, sf_dir, "blocks"))


@query("d10_review_conditions", f"""WITH e AS ({_EXTRACTORS}), n AS ({_NAMES}), j AS (SELECT p.p_partkey, n.n, e.kind, e.extractor, e.llm, p.p_size FROM part p JOIN e USING (p_partkey) JOIN n USING (p_partkey)),
    k AS (SELECT *, p_partkey % 10 NOT IN (5, 9) OR p_size % 10 = 0 AS important, p_partkey % 4 IN (0, 2) OR coalesce(extractor, '') LIKE 'Tess%' AS ocr, p_partkey % 3 = 0 AND coalesce(extractor, '') <> 'words' AS other, llm OR coalesce(extractor, '') IN ('local-LLM', 'gpt') AS l FROM j)
    SELECT p_partkey AS item_id, CASE p_partkey % 10 WHEN 0 THEN 'lot_number' WHEN 1 THEN 'person' WHEN 2 THEN 'date_time' WHEN 3 THEN 'person' WHEN 4 THEN 'date_time' WHEN 5 THEN 'colour' WHEN 6 THEN 'judgment' WHEN 7 THEN 'numeric_value' WHEN 8 THEN 'date_time' ELSE 'plain_name' END AS category, important OR ocr OR other AS review,
    concat_ws('; ', CASE WHEN ocr THEN 'ocr-derived item requires human review' END, CASE WHEN other THEN 'extraction engine mismatch requires human review' END, CASE WHEN important AND l THEN 'llm-involved important item requires human review' END) AS conditions FROM k""")
def d10(spark, sf_dir):
    j = _sql(spark, sf_dir, (), _EXTRACTORS).join(_sql(spark, sf_dir, (), _NAMES), "p_partkey").join(_sql(spark, sf_dir, (), "SELECT p_partkey, p_size FROM part"), "p_partkey")
    items = j.select(F.col("p_partkey").alias("item_id"), F.col("n").alias("label"), F.lit("string").alias("value_type"), F.lit(False).alias("flag"), F.when(F.col("p_size") % 10 == 0, "high").alias("risk"), F.lit(None).cast("array<string>").alias("warnings"), "kind", "extractor", "llm", F.when(F.col("p_partkey") % 3 == 0, "words").alias("expected_extractor"))
    return H.review_conditions(items)


_AUDITS = "SELECT doc_id AS case_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE CONCAT('a', CAST(doc_id AS STRING)) END AS audit_id, CASE WHEN doc_id % 12 <> 0 THEN 1 END AS schema_version, 1 AS prompt_version, CASE WHEN doc_id % 14 = 0 THEN 'x' ELSE CAST(n_chars AS STRING) END AS sha, n_chars + CASE WHEN doc_id % 15 = 0 THEN 1 ELSE 0 END AS blocks FROM documents"


@query("d16_check_audits", "WITH v AS (SELECT doc_id AS case_id, concat_ws('; ', CASE WHEN doc_id % 10 = 0 THEN 'audit id' END, CASE WHEN doc_id % 12 = 0 THEN 'lineage' END, CASE WHEN doc_id % 14 = 0 OR doc_id % 20 = 3 THEN 'hash' END, CASE WHEN doc_id % 15 = 0 OR doc_id % 20 = 3 THEN 'count' END) AS violations FROM documents) SELECT * FROM v WHERE violations <> ''")
def d16(spark, sf_dir):
    results = _sql(spark, sf_dir, (), "SELECT doc_id AS case_id, CAST(n_chars AS STRING) AS sha, n_chars AS blocks FROM documents WHERE doc_id % 20 <> 3")
    return H.check_audits(_sql(spark, sf_dir, (), _AUDITS), results)


@query("d17_check_boundary", "WITH v AS (SELECT doc_id AS case_id, concat_ws('; ', CASE WHEN doc_id % 6 = 0 THEN 'blocks' END, CASE WHEN doc_id % 8 = 0 THEN 'setting' END, CASE WHEN doc_id % 9 = 0 THEN 'audited' END) AS differs FROM documents) SELECT * FROM v WHERE differs <> ''")
def d17(spark, sf_dir):
    e = _sql(spark, sf_dir, (), "SELECT doc_id AS case_id, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS blocks, source AS setting, doc_id % 5 = 0 AS audited FROM documents")
    k = F.col("case_id")
    return H.check_boundary(e, e.withColumns({"blocks": F.when(k % 6 == 0, F.coalesce("blocks", F.lit(0)) + 1).otherwise(F.col("blocks")), "setting": F.when(k % 8 != 0, F.col("setting")), "audited": F.when(k % 9 == 0, ~F.col("audited")).otherwise(F.col("audited"))}))


@query("d19_scenario_failures", "SELECT event_id AS case_id, CASE WHEN event_id % 21 = 0 THEN 'structured output' ELSE 'scenario' END AS failure FROM events WHERE event_id % 21 = 0 OR event_type = 'error'")
def d19(spark, sf_dir):
    return H.scenario_failures(_sql(spark, sf_dir, (), "SELECT event_id AS case_id, CASE WHEN event_id % 42 = 0 THEN NULL ELSE event_id % 21 <> 0 END AS schema_ok, event_type AS status, CASE WHEN event_type = 'error' THEN 'view' ELSE event_type END AS expected FROM events"))


#: Sheets of orders: some high, some wide, cells in disorder, blank or without a place.
_SHEETS = """SELECT l_orderkey AS sheet, CAST(l_partkey AS BIGINT) * 10000 + l_suppkey AS nth, CAST(CASE WHEN l_orderkey % 50 = 0 THEN 2000 ELSE 1 END * CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_linenumber + 1 END AS INT) AS row, CAST((l_suppkey % 6 + 1) * CASE WHEN l_orderkey % 70 = 0 THEN 100 ELSE 1 END AS INT) AS col,
    CASE WHEN l_partkey % 17 = 0 THEN '' ELSE CAST(l_partkey * 1000 + l_linenumber AS STRING) END AS value FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey) l"""


@query("a29_sheet_grid", f"""WITH c AS (SELECT * FROM ({_SHEETS}) WHERE value <> ''), p AS (SELECT sheet, row, col, arg_max(value, nth) AS value FROM c WHERE row IS NOT NULL GROUP BY ALL), s AS (SELECT sheet, max(row) AS h, max(col) AS w, count(DISTINCT row) AS n FROM p GROUP BY sheet),
    g AS (SELECT sheet, r AS row FROM (SELECT sheet, unnest(range(1, h + 1)) AS r FROM s WHERE h <= 1024 AND w <= 256) UNION ALL SELECT DISTINCT p.sheet, p.row FROM p JOIN s USING (sheet) WHERE NOT (h <= 1024 AND w <= 256)),
    m AS (SELECT g.sheet, g.row, k AS col FROM g JOIN (SELECT sheet, unnest(range(1, w + 1)) AS k FROM s WHERE w <= 256) USING (sheet) UNION ALL SELECT p.sheet, p.row, p.col FROM p JOIN s USING (sheet) WHERE w > 256),
    o AS (SELECT m.sheet, m.row, string_agg(coalesce(p.value, ''), '|' ORDER BY m.col) AS cells FROM m LEFT JOIN p ON p.sheet = m.sheet AND p.row = m.row AND p.col = m.col GROUP BY ALL)
    SELECT sheet, row_number() OVER (PARTITION BY sheet ORDER BY row) AS place, cells FROM o UNION ALL SELECT c.sheet, coalesce(CASE WHEN h <= 1024 AND w <= 256 THEN h ELSE n END, 0) + row_number() OVER (PARTITION BY c.sheet ORDER BY nth), value FROM c LEFT JOIN s ON s.sheet = c.sheet WHERE c.row IS NULL""")
def a29(spark, sf_dir):
    return H.sheet_grid(_sql(spark, sf_dir, (), _SHEETS)).select("sheet", "place", F.array_join("cells", "|").alias("cells"))
