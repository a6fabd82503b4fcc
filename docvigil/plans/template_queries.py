"""Queries on template versions, anchors, scores, fields and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from docvigil.operators import templates as T
from docvigil.operators.fixpoint import written
from docvigil.plans.registry import query, select
from docvigil.plans.views import duck, view, with_views


def _sql(spark, sf_dir, views, text):
    return select(spark, sf_dir, f"{with_views('spark', *views)} {text}" if views else text)


def _versions(spark, sf_dir):
    return view(spark, sf_dir, "versions").select("template_id", F.struct("major", "minor", "patch").alias("version"), "active", "valid_from", "valid_until", F.col("document_type").alias("content"))


_DOCS = "SELECT o_orderkey AS doc, CONCAT('Brand#', CAST(o_custkey % 30 AS STRING)) AS template_id, CAST(o_orderkey % 90 AS INT) AS as_of FROM orders"


@query("j16_effective_version", duck("versions") + f""", d AS ({_DOCS}), b AS (SELECT d.doc, max((major, minor, patch)) AS v FROM d JOIN versions t ON t.template_id = d.template_id AND t.active AND t.valid_from <= d.as_of AND (t.valid_until IS NULL OR d.as_of < t.valid_until) GROUP BY d.doc)
    SELECT doc, template_id, concat_ws('.', v[1], v[2], v[3]) AS version FROM d LEFT JOIN b USING (doc)""".replace("concat_ws('.', v[1], v[2], v[3])", "CASE WHEN v IS NOT NULL THEN concat_ws('.', v.major, v.minor, v.patch) END").replace("max((major, minor, patch))", "max({'major': major, 'minor': minor, 'patch': patch})"))
def j16(spark, sf_dir):
    out = T.effective_version(_sql(spark, sf_dir, (), _DOCS), _versions(spark, sf_dir))
    return out.select("doc", "template_id", F.when(F.col("version").isNotNull(), F.concat_ws(".", *[F.col(f"version.{c}").cast("string") for c in ("major", "minor", "patch")])).alias("version"))


@query("j16_asked_version", duck("versions") + f""", d AS (SELECT *, CASE WHEN doc % 3 = 0 THEN doc % 2500 END AS patch FROM ({_DOCS})), b AS (SELECT d.doc, max(CASE WHEN t.active AND t.valid_from <= d.as_of AND (t.valid_until IS NULL OR d.as_of < t.valid_until) THEN CAST(t.major AS BIGINT) * 1000000000 + t.minor * 10000000 + t.patch END) AS v, bool_or(t.patch = d.patch) AS there FROM d JOIN versions t ON t.template_id = d.template_id GROUP BY d.doc)
    SELECT doc, template_id, CASE WHEN d.patch IS NULL THEN v % 10000000 WHEN there THEN d.patch END AS patch FROM d LEFT JOIN b USING (doc)""")
def j16_asked(spark, sf_dir):
    """Every third document asks for one version, whatever its state."""
    v = _versions(spark, sf_dir)
    names = v.select(F.col("version.patch").alias("p"), F.col("version").alias("asked"))  # a patch number is one version's
    docs = _sql(spark, sf_dir, (), _DOCS)
    asking = docs.filter("doc % 3 = 0").withColumn("p", F.col("doc") % 2500)
    names = written(names.join(asking.select("p").distinct(), "p", "left_semi"))
    unknown = F.struct(F.lit(-1).alias("major"), F.lit(-1).alias("minor"), F.col("p").alias("patch")).cast(dict(v.dtypes)["version"])
    asking = asking.join(names, "p", "left").withColumn("asked", F.coalesce("asked", unknown)).drop("p")
    docs = asking.unionByName(docs.filter("doc % 3 <> 0").withColumn("asked", F.lit(None).cast(dict(v.dtypes)["version"])))
    return T.effective_version(docs, v).select("doc", "template_id", F.col("version.patch").alias("patch"))


@query("t6_latest_templates", duck("versions") + " SELECT template_id, concat_ws('.', arg_max(major, (major, minor, patch)), arg_max(minor, (major, minor, patch)), arg_max(patch, (major, minor, patch))) AS version, count(*) AS versions, arg_max(document_type, (major, minor, patch)) AS content FROM versions GROUP BY template_id")
def t6(spark, sf_dir):
    return T.latest_templates(_versions(spark, sf_dir)).select("template_id", F.concat_ws(".", *[F.col(f"version.{c}").cast("string") for c in ("major", "minor", "patch")]).alias("version"), "versions", "content")


@query("j17_template_snapshot", """WITH v AS (SELECT p_brand AS template_id, p_partkey AS version, p_type AS content FROM part), l AS (SELECT template_id, max(version) AS latest FROM v GROUP BY 1),
    j AS (SELECT p_partkey AS job_id, p_brand AS template_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS pinned FROM part) SELECT job_id, j.template_id, coalesce(pinned, latest) AS version, content FROM j JOIN l USING (template_id) LEFT JOIN v ON v.template_id = j.template_id AND v.version = coalesce(pinned, latest)""")
def j17(spark, sf_dir):
    v = _sql(spark, sf_dir, (), "SELECT p_brand AS template_id, p_partkey AS version, p_type AS content FROM part")
    jobs = _sql(spark, sf_dir, (), "SELECT p_partkey AS job_id, p_brand AS template_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS pinned FROM part")
    return T.template_snapshot(jobs, v)


#: Anchors of two templates: (template, anchor, kind, mode, text, page, block types).
_ANCHORS = [
    ("t1", "a1", "label", "contains", "THE", None, None), ("t1", "a2", "heading", "contains", " was ", 1, ["heading"]), ("t1", "a3", "label", "exact", "De.", None, ["heading", "paragraph"]), ("t1", "a4", "label", "contains", "an", 2, None),
    ("t2", "a1", "label", "contains", "STRASSE", None, None), ("t2", "a2", "label", "contains", "que", 1, ["paragraph"]), ("t2", "a3", "table_header", "normalized", " THE ", None, None), ("t2", "a4", "label", "normalized", "de.", None, None),
]
_ANCHOR_SCHEMA = "template_id string, anchor_id string, kind string, mode string, text string, page int, block_types array<string>"
_F = "replace(lower(trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g'))), 'ß', 'ss')"
_HITS = f""", f AS (SELECT *, {_F} AS t FROM blocks), hits AS (SELECT doc_id, 't1' AS template_id, 'a1' AS anchor_id, block_id, page, y, x FROM f WHERE contains(t, 'the') UNION ALL SELECT doc_id, 't1', 'a2', block_id, page, y, x FROM f WHERE page = 1 AND type = 'heading' AND contains(t, 'was')
    UNION ALL SELECT doc_id, 't1', 'a3', block_id, page, y, x FROM f WHERE type <> 'table' AND text = 'De.' UNION ALL SELECT doc_id, 't1', 'a4', block_id, page, y, x FROM f WHERE page = 2 AND contains(t, 'an') UNION ALL SELECT doc_id, 't2', 'a1', block_id, page, y, x FROM f WHERE contains(t, 'strasse')
    UNION ALL SELECT doc_id, 't2', 'a2', block_id, page, y, x FROM f WHERE page = 1 AND type = 'paragraph' AND contains(t, 'que') UNION ALL SELECT doc_id, 't2', 'a3', block_id, page, y, x FROM f WHERE type = 'table' AND len(list_filter(string_split(lower(text), '|'), lambda c: trim(c) = 'the')) > 0 UNION ALL SELECT doc_id, 't2', 'a4', block_id, page, y, x FROM f WHERE t = 'de.')"""
_ROLES = "r(template_id, anchor_id, required, scope_page) AS (VALUES ('t1', 'a1', true, NULL), ('t1', 'a2', true, 1), ('t1', 'a3', false, NULL), ('t1', 'a4', true, 2), ('t2', 'a1', false, NULL), ('t2', 'a2', true, 1), ('t2', 'a3', true, NULL), ('t2', 'a4', false, NULL))"


def _hits(spark, sf_dir):
    return T.match_anchors(view(spark, sf_dir, "blocks"), spark.createDataFrame(_ANCHORS, _ANCHOR_SCHEMA))


@query("j6_match_anchors", duck("blocks") + _HITS + " SELECT * FROM hits")
def j6(spark, sf_dir):
    return _hits(spark, sf_dir)


def _roles(spark):
    anchors = spark.createDataFrame(_ANCHORS, _ANCHOR_SCHEMA)
    fields = spark.createDataFrame([("t1", "a1", True), ("t1", "a3", False), ("t1", "a4", True), ("t2", "a2", True), ("t2", "a4", False), ("t2", "a2", False)], "template_id string, anchor_id string, required boolean")
    return T.anchor_roles(anchors, fields, spark.createDataFrame([("t2", "a3")], "template_id string, anchor_id string"))


_PART_ANCHORS = "SELECT DISTINCT p_brand AS template_id, CAST(p_partkey % 30 AS STRING) AS anchor_id, CASE WHEN p_partkey % 30 % 4 = 0 THEN 'heading' WHEN p_partkey % 30 % 11 = 0 THEN 'table_header' ELSE 'label' END AS kind, CASE WHEN p_partkey % 30 % 5 = 0 THEN 1 END AS page FROM part"
_PART_FIELDS = "SELECT p_brand AS template_id, CAST(p_partkey % 90 AS STRING) AS anchor_id, p_size % 6 = 0 AS required FROM part WHERE p_partkey % 5 <> 0"
_PART_TABLES = "SELECT DISTINCT p_brand AS template_id, CAST(p_partkey % 30 AS STRING) AS anchor_id FROM part WHERE p_partkey % 30 % 13 = 0"


@query("a24_anchor_roles", f"""WITH a AS ({_PART_ANCHORS}), f AS ({_PART_FIELDS}), t AS ({_PART_TABLES}), n AS (SELECT DISTINCT template_id, anchor_id FROM (SELECT template_id, anchor_id FROM f WHERE required UNION ALL SELECT * FROM t)), m AS (SELECT DISTINCT template_id, anchor_id FROM f WHERE NOT required)
    SELECT template_id, anchor_id, CASE WHEN (template_id, anchor_id) IN (SELECT (template_id, anchor_id) FROM n) THEN true WHEN (template_id, anchor_id) IN (SELECT (template_id, anchor_id) FROM m) THEN false ELSE kind IN ('heading', 'table_header') END AS required, page AS scope_page FROM a""")
def a24(spark, sf_dir):
    return T.anchor_roles(*[_sql(spark, sf_dir, (), q) for q in (_PART_ANCHORS, _PART_FIELDS, _PART_TABLES)])


_SCORES = (duck("blocks") + _HITS + f""", {_ROLES}, d AS (SELECT doc_id, max(page) AS pages FROM blocks GROUP BY doc_id), j AS (SELECT d.doc_id, d.pages, r.*, EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = d.doc_id AND h.template_id = r.template_id AND h.anchor_id = r.anchor_id) AS hit FROM d CROSS JOIN r),
    g AS (SELECT doc_id, template_id, coalesce(avg(CASE WHEN required OR hit THEN CASE WHEN hit THEN 1.0 ELSE 0.0 END END), 0) AS anchors, bool_or(required AND NOT hit) AS lacks, count_if(hit) AS matched, max(pages) AS pages FROM j GROUP BY doc_id, template_id),
    s AS (SELECT *, CASE WHEN template_id = 't1' AND pages < 2 THEN 0.5 ELSE 1 END AS ps, doc_id % 17 = 0 AS bare, CASE WHEN template_id = 't1' THEN 1 WHEN doc_id % 3 = 0 THEN 0.25 ELSE 1 END AS tables FROM g),
    x AS (SELECT *, 0.6 * anchors + 0.2 * CASE WHEN bare THEN 0 ELSE ps END + 0.2 * tables AS raw, lacks OR bare OR ps < 1 AS closed FROM s), y AS (SELECT *, round(CASE WHEN closed THEN least(raw, 0.79) WHEN template_id = 't2' AND doc_id % 3 = 0 THEN least(raw, 0.94) ELSE raw END, 6)::DOUBLE AS score FROM x)
    SELECT doc_id, template_id, score, CASE WHEN score >= 0.95 THEN 'known' WHEN score >= 0.8 THEN 'candidate' ELSE 'unknown' END AS class, matched FROM y""")


@query("a23_score_templates", _SCORES)
def a23(spark, sf_dir):
    return _scored(spark, sf_dir, True)


def _scored(spark, sf_dir, every):
    b = view(spark, sf_dir, "blocks")
    docs = b.select("doc_id").distinct()
    third = F.col("doc_id") % 3 == 0
    tables = docs.filter("doc_id % 5 <> 0" if not every else "true").select("doc_id", F.lit("t2").alias("template_id"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("table_id"))
    tables = tables.withColumn("share", F.when(~third, 1.0).when(F.col("table_id") == "x", 0.5))
    return T.score_templates(docs, _roles(spark), _hits(spark, sf_dir), b.filter("doc_id % 17 <> 0").select("doc_id", "page").distinct(), tables, every)


@query("a23_matched_templates", _SCORES.replace("WHEN doc_id % 3 = 0 THEN 0.25 ELSE 1 END AS tables", "WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 3 = 0 THEN 0.25 ELSE 1 END AS tables").replace("template_id = 't2' AND doc_id % 3 = 0 THEN least", "template_id = 't2' AND doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN least") + " WHERE matched > 0 OR (template_id = 't2' AND doc_id % 5 <> 0)")
def a23_matched(spark, sf_dir):
    return _scored(spark, sf_dir, False)


#: Cells of tables: an order's lines, with a header row of column names.
_GRID = """SELECT l_orderkey AS doc_id, 0 AS table_no, 0 AS row, h.c AS col, h.t AS text FROM (SELECT DISTINCT l_orderkey FROM lineitem) o CROSS JOIN (SELECT 0 AS c, 'Part_No' AS t UNION ALL SELECT 1, 'QTY' UNION ALL SELECT 2, 'Ship' UNION ALL SELECT 3, ' ' UNION ALL SELECT 4, '-Date') h WHERE NOT (l_orderkey % 5 = 0 AND h.c = 4)
    UNION ALL SELECT case_id, 0, CAST(cell_id AS INT), c.c, CASE WHEN c.c = 0 AND l_partkey % 4 <> 0 THEN CAST(l_partkey AS STRING) WHEN c.c = 1 THEN CAST(l_suppkey AS STRING) WHEN c.c = 4 THEN text ELSE ' ' END FROM cells CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) c"""


@query("j10_column_score", duck("cells") + " SELECT DISTINCT l_orderkey AS doc_id, 0 AS table_no, 't' AS template_id, CASE WHEN l_orderkey % 5 = 0 THEN 2 ELSE 3 END / 4.0::DOUBLE AS share, 0 AS header_row FROM lineitem")
def j10(spark, sf_dir):
    t = spark.createDataFrame([("t", ["part no", "Qty", "ship date", "colour"])], "template_id string, columns array<string>")
    return T.column_score(_sql(spark, sf_dir, ("cells",), _GRID), t)


@query("j9_table_lookup", duck("cells") + f", g AS ({_GRID}) SELECT doc_id, 0 AS table_no, 't' AS template_id, 'part' AS field_id, arg_min(text, row) AS value FROM g WHERE col = 0 AND row > 0 AND trim(text) <> '' GROUP BY doc_id UNION ALL SELECT doc_id, 0, 't', 'day', arg_min(text, row) FROM g WHERE col = 4 AND row > 0 AND doc_id % 5 <> 0 GROUP BY doc_id")
def j9(spark, sf_dir):
    f = spark.createDataFrame([("t", "part", "part no"), ("t", "day", "Ship Date")], "template_id string, field_id string, label string")
    return T.table_lookup(_sql(spark, sf_dir, ("cells",), _GRID), f)


_LABELLED = "SELECT p_partkey AS doc_id, CAST(p_partkey AS STRING) AS block_id, CASE p_partkey % 4 WHEN 0 THEN CONCAT('Type: ', p_type, ' NAME : ', p_name, ' Size (mm): ', CAST(p_size AS STRING)) WHEN 1 THEN CONCAT('Name:', p_name) WHEN 2 THEN CONCAT('subtype: no, type: ', p_type) ELSE CONCAT('Type ', p_type, ' Name: ') END AS text FROM part"


@query("j8_label_values", """SELECT p_partkey AS doc_id, CAST(p_partkey AS VARCHAR) AS block_id, 't' AS template_id, 'type' AS field_id, p_type AS value FROM part WHERE p_partkey % 4 IN (0, 2) UNION ALL SELECT p_partkey, CAST(p_partkey AS VARCHAR), 't', 'name', p_name FROM part WHERE p_partkey % 4 IN (0, 1)
    UNION ALL SELECT p_partkey, CAST(p_partkey AS VARCHAR), 't', 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 4 = 0""")
def j8_labels(spark, sf_dir):
    f = spark.createDataFrame([("t", "type", "Type"), ("t", "name", "name"), ("t", "size", " Size (mm)")], "template_id string, field_id string, label string")
    return T.label_values(_sql(spark, sf_dir, (), _LABELLED), f)


_CANDIDATES = "SELECT doc_id, CONCAT('f', CAST(idx % 3 AS STRING)) AS field_id, CASE WHEN idx % 7 = 0 THEN 'same_block' WHEN idx % 5 = 0 THEN 'table_cell' WHEN idx % 2 = 0 THEN 'right' ELSE 'below' END AS rule, page, y, x, block_id, text AS value FROM blocks"


@query("t7_best_value", duck("blocks") + f""", c AS ({_CANDIDATES}), s AS (SELECT *, CASE rule WHEN 'same_block' THEN 0.98 WHEN 'below' THEN 0.95 WHEN 'right' THEN 0.94 ELSE 0.90 END::DOUBLE AS confidence FROM c)
    SELECT doc_id, field_id, rule, block_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY confidence DESC, page, y, x, block_id) AS r FROM s) WHERE r = 1""")
def t7(spark, sf_dir):
    return T.best_value(_sql(spark, sf_dir, ("blocks",), _CANDIDATES)).select("doc_id", "field_id", "rule", "block_id", "confidence")


#: Field values of orders.
_VALUES = """SELECT o_orderkey AS doc_id, 'total' AS field_id, CASE WHEN o_orderkey % 19 = 0 THEN 'n/a' WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS value FROM orders
    UNION ALL SELECT o_orderkey, 'status', CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE o_orderstatus END FROM orders UNION ALL SELECT o_orderkey, 'day', CASE WHEN o_orderkey % 31 = 0 THEN '1999-02-30' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END FROM orders"""


@query("d1_check_rules", f"""WITH v AS ({_VALUES}), n AS (SELECT *, try_cast(value AS DOUBLE) AS num FROM v)
    SELECT doc_id, field_id, 'r1' AS rule_id, 'required' AS rule_type FROM n WHERE coalesce(trim(value), '') = '' UNION ALL SELECT doc_id, field_id, 'r2', 'type' FROM n WHERE field_id = 'total' AND value IS NOT NULL AND num IS NULL
    UNION ALL SELECT doc_id, field_id, 'r3', 'range' FROM n WHERE field_id = 'total' AND value IS NOT NULL AND (num IS NULL OR num < 1000 OR num > 300000) UNION ALL SELECT doc_id, field_id, 'r4', 'allowed' FROM n WHERE field_id = 'status' AND trim(value) <> '' AND value NOT IN ('F', 'O')
    UNION ALL SELECT doc_id, field_id, 'r5', 'type' FROM n WHERE field_id = 'day' AND try_cast(value AS DATE) IS NULL
    UNION ALL SELECT a.doc_id, a.field_id, 'r6', 'cross_field' FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.field_id = 'total' AND b.field_id = 'status' WHERE a.num IS NULL UNION ALL SELECT doc_id, field_id, 'r7', 'cross_field' FROM n WHERE field_id = 'day'""")
def d1(spark, sf_dir):
    rows = [(f, "r1", "required", None, None, None, None, None, None) for f in ("total", "status", "day")]
    rows += [("total", "r2", "type", "number", None, None, None, None, None), ("total", "r3", "range", None, 1000.0, 300000.0, None, None, None), ("status", "r4", "allowed", None, None, None, ["F", "O"], None, None), ("day", "r5", "type", "date", None, None, None, None, None)]
    rows += [("total", "r6", "cross_field", "string", None, None, None, "total", "greater_than_or_equal"), ("day", "r7", "cross_field", "date", None, None, None, "none", "after")]
    table = spark.createDataFrame(rows, "field_id string, rule_id string, rule_type string, expected_type string, minimum double, maximum double, allowed array<string>, related string, operator string")
    return T.check_rules(_sql(spark, sf_dir, (), _VALUES), table)


_FIELDS = "SELECT p_brand AS template_id, CAST(p_partkey % 60 AS STRING) AS field_id, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'odd' WHEN p_partkey % 4 = 0 THEN 'high' WHEN p_partkey % 4 = 2 THEN 'mid' ELSE 'low' END AS risk_level FROM part"
_LEVELS = "SELECT DISTINCT p_brand AS template_id, l AS level, l = 'Mid' AS review FROM part CROSS JOIN (SELECT 'High' AS l UNION ALL SELECT 'low' UNION ALL SELECT 'Mid') k WHERE p_brand <> 'Brand#2'"


@query("d2_risk_policy", f"""WITH f AS ({_FIELDS}), s AS (SELECT template_id, field_id, CASE WHEN template_id = 'Brand#2' THEN CASE WHEN risk_level = 'high' THEN 'review' ELSE 'free' END WHEN risk_level IS NULL THEN 'missing' WHEN risk_level = 'odd' THEN 'undeclared' WHEN risk_level IN ('high', 'mid') THEN 'review' ELSE 'free' END AS policy FROM f)
    SELECT *, policy <> 'free' AS requires_review FROM s""")
def d2(spark, sf_dir):
    return T.risk_policy(_sql(spark, sf_dir, (), _FIELDS), _sql(spark, sf_dir, (), _LEVELS))


_MAPPING = "SELECT DISTINCT p_brand AS template_id, CAST(p_partkey % 61 AS STRING) AS field_id FROM part WHERE p_partkey % 4 <> 0"


@query("d3_check_templates", f"""WITH f AS ({_FIELDS}), m AS ({_MAPPING}), e AS (SELECT template_id, 'repeated field' AS problem FROM f GROUP BY template_id, field_id HAVING count(*) > 1 UNION ALL SELECT template_id, 'undeclared risk level' FROM f WHERE coalesce(risk_level, 'odd') = 'odd' OR template_id = 'Brand#2' OR risk_level IN ('high', 'mid')
    UNION ALL SELECT template_id, 'unmapped field' FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.template_id = f.template_id AND m.field_id = f.field_id) UNION ALL SELECT template_id, 'mapping to nothing' FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE m.template_id = f.template_id AND m.field_id = f.field_id))
    SELECT template_id, problem, count(*) AS n FROM e GROUP BY ALL""")
def d3(spark, sf_dir):
    f = _sql(spark, sf_dir, (), _FIELDS)
    return T.check_templates(f, f, _sql(spark, sf_dir, (), _LEVELS), _sql(spark, sf_dir, (), _MAPPING))


_BODIES = """SELECT event_id, CONCAT('{"kind":"', event_type, '"', CASE WHEN event_id % 17 = 0 THEN '' ELSE CONCAT(',"size":', CAST(event_id % 100 AS STRING)) END, CASE WHEN event_id % 13 = 0 THEN ',"tags":[]' ELSE ',"tags":["a"]' END, CASE WHEN event_id % 29 = 0 THEN ',"odd":1' ELSE '' END, ',"ref":"', CASE WHEN event_id % 37 = 0 THEN 'R' ELSE 'r' END, CAST(user_id AS STRING), '"}') AS body FROM events"""


@query("d4_check_schema", f"""WITH b AS (SELECT e.event_id, e.event_type, e.user_id FROM events e), v AS (SELECT event_id, concat_ws('; ', CASE WHEN event_id % 17 = 0 THEN 'size is required' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'kind is not allowed' END, CASE WHEN event_id % 37 = 0 THEN 'ref has another form' END, CASE WHEN event_id % 17 <> 0 AND event_id % 100 < 5 THEN 'size is too small' END, CASE WHEN event_id % 17 <> 0 AND event_id % 100 > 95 THEN 'size is too large' END,
    CASE WHEN event_id % 17 <> 0 AND event_id % 100 <= 7 THEN 'size is not above its limit' END, CASE WHEN event_id % 13 = 0 THEN 'tags has too few items' END, CASE WHEN event_id % 29 = 0 THEN 'odd is another constant' END, CASE WHEN event_id % 29 = 0 THEN 'odd has another type' END, CASE WHEN event_type <> 'view' THEN 'kind is another constant' END) AS violations FROM b) SELECT * FROM v WHERE violations <> ''""")
def d4(spark, sf_dir):
    table = [("size", "required", None), ("kind", "enum", ["click", "view", "purchase"]), ("ref", "pattern", r"^r\d+$"), ("size", "minimum", 5), ("size", "maximum", 95), ("size", "above", 7), ("tags", "min_items", 1), ("odd", "const", 2), ("odd", "type", "string"), ("tags", "type", "array"), ("size", "type", "integer"), ("kind", "const", "view")]
    return T.check_schema(_sql(spark, sf_dir, (), _BODIES), "event_id", "body", table)


#: Whole definitions: a part is a field of its brand's template, with rules, sources and keys of its own.
_DEFINED = "SELECT p_brand AS template_id, CAST(p_partkey AS STRING) AS field_id, 'low' AS risk_level, CASE WHEN p_partkey % 3 = 0 THEN 'number' WHEN p_partkey % 3 = 1 THEN 'date' ELSE 'string' END AS value_type, p_partkey % 2 = 0 AS required, CONCAT('r', CAST(p_partkey + CASE WHEN p_partkey % 43 = 0 THEN 1 ELSE 0 END AS STRING)) AS rule_id, CASE WHEN p_partkey % 19 = 0 THEN 'a9' WHEN p_partkey % 2 = 0 THEN 'a1' ELSE 'a2' END AS anchor_id, CASE WHEN p_partkey % 4 = 0 THEN 'right' ELSE 'table_cell' END AS direction, CONCAT('k', CAST(p_partkey % 397 AS STRING)) AS output_key, p_partkey FROM part"
_RULES = "SELECT p_brand AS template_id, CONCAT('r', CAST(p_partkey AS STRING)) AS rule_id, CASE WHEN p_partkey % 31 = 0 THEN 'none' ELSE CAST(p_partkey AS STRING) END AS target, CASE p_partkey % 7 WHEN 0 THEN 'required' WHEN 1 THEN 'type' WHEN 2 THEN 'range' WHEN 3 THEN 'allowed' WHEN 4 THEN 'cross_field' WHEN 5 THEN 'shape' ELSE 'required' END AS rule_type, CASE WHEN p_partkey % 5 = 0 THEN 'string' ELSE 'date' END AS expected_type, CAST(CASE WHEN p_partkey % 11 = 0 THEN 9 END AS DOUBLE) AS minimum, CAST(CASE WHEN p_partkey % 13 <> 0 THEN 5 END AS DOUBLE) AS maximum, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '1' END AS value, CAST(p_partkey AS STRING) AS related, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'after' END AS operator, p_partkey FROM part"


@query("d3_check_definitions", f"""WITH f AS ({_DEFINED}), r AS ({_RULES}), j AS (SELECT r.*, f.value_type, f.required FROM r LEFT JOIN f ON r.template_id = f.template_id AND r.target = f.field_id), e AS (
    SELECT template_id, 'undeclared anchor' AS problem FROM f WHERE anchor_id = 'a9' UNION ALL SELECT template_id, 'anchor of no table' FROM f WHERE anchor_id = 'a2' AND direction = 'table_cell' UNION ALL SELECT template_id, 'repeated output key' FROM f GROUP BY template_id, output_key HAVING count(*) > 1
    UNION ALL SELECT template_id, 'undeclared rule' FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.template_id = f.template_id AND r.rule_id = f.rule_id) UNION ALL SELECT f.template_id, 'rule of another field' FROM f JOIN r ON r.template_id = f.template_id AND r.rule_id = f.rule_id WHERE r.target <> f.field_id
    UNION ALL SELECT template_id, 'rule that its field does not name' FROM r WHERE p_partkey % 31 <> 0 AND p_partkey % 43 = 0 UNION ALL SELECT template_id, 'rule of no field' FROM r WHERE p_partkey % 31 = 0
    UNION ALL SELECT template_id, 'required rule of an optional field' FROM j WHERE rule_type = 'required' AND NOT required UNION ALL SELECT template_id, 'rule of another type' FROM j WHERE rule_type = 'type' AND coalesce(expected_type <> value_type, true) UNION ALL SELECT template_id, 'range of no numbers' FROM j WHERE rule_type = 'range' AND value_type <> 'number'
    UNION ALL SELECT template_id, 'range without limits' FROM j WHERE rule_type = 'range' AND minimum IS NULL AND maximum IS NULL UNION ALL SELECT template_id, 'empty range' FROM j WHERE rule_type = 'range' AND minimum > maximum UNION ALL SELECT template_id, 'values of another type' FROM j WHERE rule_type = 'allowed' AND value_type = 'number' AND value = 'x'
    UNION ALL SELECT template_id, 'related to no other field' FROM r WHERE rule_type = 'cross_field' AND p_partkey % 31 <> 0 UNION ALL SELECT template_id, 'no operator' FROM r WHERE rule_type = 'cross_field' AND operator IS NULL UNION ALL SELECT r.template_id, 'operator of other types' FROM r JOIN f ON r.template_id = f.template_id AND r.related = f.field_id WHERE rule_type = 'cross_field' AND coalesce(CASE WHEN operator IS NOT NULL THEN NOT (f.value_type = 'date') OR r.p_partkey % 31 = 0 ELSE r.p_partkey % 31 = 0 END, false)
    UNION ALL SELECT template_id, 'unknown rule type' FROM r WHERE rule_type = 'shape') SELECT template_id, problem, count(*) AS n FROM e GROUP BY ALL""")
def d3_definitions(spark, sf_dir):
    f = _sql(spark, sf_dir, (), _DEFINED).withColumn("rule_ids", F.array("rule_id"))
    r = _sql(spark, sf_dir, (), _RULES).withColumn("allowed", F.array("value"))
    names = f.select("template_id").distinct()
    anchors = names.crossJoin(spark.createDataFrame([("a1", "table_header", ["table"]), ("a2", "heading", None)], "anchor_id string, kind string, block_types array<string>"))  # two rows a template
    levels = names.withColumn("level", F.lit("low"))
    return T.check_templates(f, f, levels, f.select("template_id", "field_id").distinct(), anchors, None, r)


_KEYS = "SELECT p_brand AS template_id, p_partkey AS field_id, CONCAT(CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE CONCAT('a.', CAST(p_partkey % 5 AS STRING)) END, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE CONCAT('.', CAST(p_size AS STRING)) END) AS output_key FROM part"


@query("w15_key_conflicts", f"""WITH f AS ({_KEYS}), k AS (SELECT template_id, output_key, min(field_id) AS m FROM f GROUP BY ALL) SELECT s.template_id, s.m AS a, l.m AS b, s.output_key AS a_key, l.output_key AS b_key FROM k s JOIN k l ON s.template_id = l.template_id AND l.output_key LIKE s.output_key || '.%'
    UNION ALL SELECT template_id, m, field_id, output_key, output_key FROM f JOIN k USING (template_id, output_key) WHERE field_id <> m""")
def w15(spark, sf_dir):
    return T.key_conflicts(_sql(spark, sf_dir, (), _KEYS))


@query("w15_key_classes", f"""WITH f AS ({_KEYS}), k AS (SELECT template_id, output_key, count(*) AS n FROM f GROUP BY ALL), c AS (SELECT s.template_id, s.output_key, s.n - 1 AS equal, coalesce((SELECT sum(o.n) FROM k o WHERE o.template_id = s.template_id AND s.output_key LIKE o.output_key || '.%'), 0)::BIGINT AS shorter,
    coalesce((SELECT sum(o.n) FROM k o WHERE o.template_id = s.template_id AND o.output_key LIKE s.output_key || '.%'), 0)::BIGINT AS longer FROM k s) SELECT * FROM c WHERE equal + shorter + longer > 0""")
def w15_classes(spark, sf_dir):
    return T.key_classes(_sql(spark, sf_dir, (), _KEYS))


#: Reviewed fields of orders: three numbers, two dates, a flag and a text.
_REVIEWED = """SELECT o_orderkey AS doc_id, k.k AS field_id, CASE WHEN k.k IN ('sent', 'paid') THEN 'date' WHEN k.k = 'open' THEN 'boolean' WHEN k.k = 'state' THEN 'string' ELSE 'number' END AS value_type,
    CASE k.k WHEN 'net' THEN CASE WHEN o_orderkey % 19 = 0 THEN 'n/a' ELSE CAST(o_custkey * 3 % 17 AS STRING) END WHEN 'tax' THEN CAST(o_custkey % 9 AS STRING) WHEN 'gross' THEN CONCAT('+', CAST(o_custkey * 5 % 23 AS STRING))
        WHEN 'sent' THEN CASE WHEN o_orderkey % 31 = 0 THEN '1999-02-30' ELSE CONCAT('1999-03-', LPAD(CAST(o_orderkey % 28 + 1 AS STRING), 2, '0')) END WHEN 'paid' THEN CONCAT('1999-03-', LPAD(CAST(o_custkey % 28 + 1 AS STRING), 2, '0'))
        WHEN 'open' THEN CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN ' No ' ELSE 'maybe' END WHEN 'state' THEN CASE o_custkey % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' ELSE 'maybe ' END END AS value
    FROM orders CROSS JOIN (SELECT 'net' AS k UNION ALL SELECT 'tax' UNION ALL SELECT 'gross' UNION ALL SELECT 'sent' UNION ALL SELECT 'paid' UNION ALL SELECT 'open' UNION ALL SELECT 'state') k WHERE NOT (o_orderkey % 13 = 0 AND k.k = 'gross')"""
#: Rules of each kind; what the reviewed fields need of each other runs from open over tax and net to gross.
_CROSS = [("net", "gross", "less_than_or_equal"), ("tax", "net", "not_equals"), ("tax", "net", "less_than"), ("sent", "paid", "before_or_equal"), ("paid", "tax", "equals"), ("open", "state", "equals"), ("state", "open", "not_equals"), ("open", "tax", "greater_than")]


@query("w16_cross_field", f"""WITH v AS ({_REVIEWED}), w AS (SELECT doc_id, max(CASE WHEN field_id = 'net' THEN try_cast(value AS DOUBLE) END) AS net, max(CASE WHEN field_id = 'tax' THEN value::DOUBLE END) AS tax, max(CASE WHEN field_id = 'gross' THEN value::DOUBLE END) AS gross,
    max(CASE WHEN field_id = 'sent' THEN try_cast(value AS DATE) END) AS sent, max(CASE WHEN field_id = 'paid' THEN value::DATE END) AS paid, max(CASE WHEN field_id = 'open' THEN trim(value) END) AS open, max(CASE WHEN field_id = 'state' THEN trim(value) END) AS state FROM v GROUP BY doc_id),
    o AS (SELECT doc_id, coalesce(net <= gross, false) AS net_ok, coalesce(tax < net, false) AS tax_ok, false AS paid_ok, false AS open_ok FROM w),
    s AS (SELECT doc_id, unnest(['gross', 'net', 'tax']) AS field_id, unnest([true, net_ok, net_ok AND tax_ok]) AS stays FROM o)
    SELECT v.doc_id, v.field_id, v.value, v.value_type FROM v JOIN s ON v.doc_id = s.doc_id AND v.field_id = s.field_id WHERE stays""")
def w16(spark, sf_dir):
    """Dates fall with ``paid`` (a date is never equal to a number), flags with ``open`` (never over a number)."""
    return T.cross_field(_sql(spark, sf_dir, (), _REVIEWED), spark.createDataFrame(_CROSS, "field_id string, related string, operator string"))


@query("w16_typed_equality", f"""WITH v AS ({_REVIEWED}), w AS (SELECT doc_id, max(CASE WHEN field_id = 'open' THEN lower(trim(value)) END) AS open, max(CASE WHEN field_id = 'state' THEN trim(value) END) AS state, max(CASE WHEN field_id = 'tax' THEN value::DOUBLE END) AS tax, max(CASE WHEN field_id = 'gross' THEN value::DOUBLE END) AS gross,
    max(CASE WHEN field_id = 'sent' THEN try_cast(value AS DATE) END) AS sent, max(CASE WHEN field_id = 'paid' THEN value::DATE END) AS paid FROM v GROUP BY doc_id),
    t AS (SELECT *, CASE open WHEN 'yes' THEN true WHEN 'no' THEN false END AS a, CASE lower(state) WHEN 'true' THEN true WHEN 'no' THEN false END AS b FROM w),
    s AS (SELECT doc_id, unnest(['open', 'tax', 'sent', 'state', 'gross', 'paid', 'net']) AS field_id, unnest([coalesce(CASE WHEN a IS NULL AND b IS NULL THEN open = state ELSE a = b END, false), coalesce(tax <> gross, false), coalesce(sent > paid, false), true, true, true, true]) AS stays FROM t)
    SELECT v.doc_id, v.field_id, v.value, v.value_type FROM v JOIN s ON v.doc_id = s.doc_id AND v.field_id = s.field_id WHERE stays""")
def w16_typed(spark, sf_dir):
    pairs = [("open", "state", "equals"), ("tax", "gross", " Not_Equals "), ("sent", "paid", "after")]
    return T.cross_field(_sql(spark, sf_dir, (), _REVIEWED), spark.createDataFrame(pairs, "field_id string, related string, operator string"))


#: Values with dotted keys; an order's day may stand under, at or above the key of its status.
_MAPPED = f"""SELECT doc_id, field_id, CASE field_id WHEN 'total' THEN 1 WHEN 'status' THEN 2 ELSE 3 END AS position, CASE field_id WHEN 'total' THEN 'out..sum.total' WHEN 'status' THEN 'out.state' ELSE CASE doc_id % 5 WHEN 0 THEN 'out.state.day' WHEN 1 THEN 'out' WHEN 2 THEN 'out.state' ELSE 'out.day' END END AS output_key,
    value, CASE WHEN coalesce(value, '') = '' THEN 'missing' WHEN value = 'n/a' THEN 'not a number' END AS warning FROM ({_VALUES}) v"""


@query("a25_map_fields", f"""WITH m AS ({_MAPPED}), g AS (SELECT doc_id, doc_id % 5 AS k, max(CASE WHEN field_id = 'total' AND warning IS NULL THEN value END) AS t, max(CASE WHEN field_id = 'status' AND warning IS NULL THEN value END) AS s, max(CASE WHEN field_id = 'day' AND warning IS NULL THEN value END) AS d,
    count_if(warning IS NULL) AS confirmed, coalesce(string_agg(field_id || ': ' || warning, '; ' ORDER BY field_id) FILTER (WHERE warning IS NOT NULL), '') AS review FROM m GROUP BY doc_id),
    n AS (SELECT *, concat_ws(',', CASE WHEN k > 2 THEN '"day":"' || d || '"' END, CASE WHEN k = 0 AND d IS NOT NULL THEN '"state":{{"day":"' || d || '"}}' WHEN k = 2 AND d IS NOT NULL THEN '"state":"' || d || '"' ELSE '"state":"' || s || '"' END, '"sum":{{"total":"' || t || '"}}') AS body FROM g)
    SELECT doc_id, CASE WHEN k = 1 AND d IS NOT NULL THEN '{{"out":"' || d || '"}}' WHEN body = '' THEN '{{}}' ELSE '{{"out":{{' || body || '}}}}' END AS output, confirmed, review FROM n""")
def a25(spark, sf_dir):
    return T.map_fields(_sql(spark, sf_dir, (), _MAPPED))
