"""Queries on fragments, lines, blocks and pages; blocks are lines of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docvigil.functions import geometry as G
from docvigil.functions import text as X
from docvigil.functions import values as V
from docvigil.operators import blocks as B
from docvigil.plans.registry import query, select
from docvigil.plans.views import duck, view, with_views


def n(column: str) -> str:
    """Normalised text in DuckDB."""
    return f"trim(regexp_replace({column}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


def _blocks(spark, sf_dir):
    return view(spark, sf_dir, "blocks")


# ---------------------------------------------------------------- expressions


@query("p1_normalised_text", duck("blocks") + f" SELECT block_id, {n('text')} AS norm, replace(lower({n('text')}), 'ß', 'ss') AS folded, contains({n('text')}, 'the') AS has FROM blocks")
def p1(spark, sf_dir):
    t = F.col("text")
    return _blocks(spark, sf_dir).select("block_id", X.norm(t).alias("norm"), X.fold(t).alias("folded"), X.norm_contains(t, F.lit(" the ")).alias("has"))


@query("p2_column_names", "SELECT p_partkey, lower(trim(regexp_replace(translate(concat(p_type, '_', p_name, '-No'), '_-', '  '), '\\s+', ' ', 'g'))) AS name FROM part")
def p2(spark, sf_dir):
    return select(spark, sf_dir, "SELECT p_partkey, p_type, p_name FROM part").select("p_partkey", X.norm_col(F.concat("p_type", F.lit("_"), "p_name", F.lit("-No"))).alias("name"))


_RAW = "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN -confidence WHEN doc_id % 5 = 0 THEN confidence * 100 ELSE confidence END"


@query("p5_confidence", duck("blocks") + f""", r AS (SELECT block_id, doc_id % 10 = 0 AS percent, {_RAW} AS c FROM blocks)
    SELECT block_id, CASE WHEN c IS NULL THEN 0.95 WHEN c < 0 THEN 0 WHEN percent THEN c / 100 ELSE c END::DOUBLE AS confidence, coalesce(c < 0, false) AS invalid FROM r""")
def p5(spark, sf_dir):
    value, bad = V.confidence(F.expr(_RAW), F.col("doc_id") % 10 == 0)
    return _blocks(spark, sf_dir).select("block_id", value.alias("confidence"), bad.alias("invalid"))


_GATED = f"SELECT block_id, idx, text, CASE WHEN idx % 12 <> 5 THEN x END AS x, {_RAW} AS confidence, CASE WHEN doc_id % 3 = 0 THEN 'engine' END AS engine, idx % 10 = 1 AS low_confidence, idx % 15 = 2 AS parser_review FROM blocks"


@query("p6_review_gate", duck("blocks") + f""", g AS ({_GATED}), w AS (SELECT *, 'blocks[' || idx || '].' AS b, '; block marked requires_review' AS m FROM g)
    SELECT block_id, concat_ws('|', CASE WHEN x IS NULL THEN b || 'bbox missing' || m END, CASE WHEN {n('text')} = '' THEN b || 'text empty' || m END, CASE WHEN confidence IS NULL AND engine IS NOT NULL THEN b || 'confidence missing' || m END, CASE WHEN confidence < 0 THEN b || 'confidence invalid' || m END, CASE WHEN low_confidence THEN b || 'low confidence' || m END, CASE WHEN parser_review THEN b || 'parser marked block requires_review' END) AS warnings,
    CASE WHEN x IS NULL OR {n('text')} = '' OR (confidence IS NULL AND engine IS NOT NULL) OR coalesce(confidence < 0, false) THEN 0 WHEN confidence IS NULL THEN 0.95 WHEN engine IS NOT NULL THEN confidence / 100 ELSE confidence END::DOUBLE AS confidence,
    x IS NULL OR {n('text')} = '' OR (confidence IS NULL AND engine IS NOT NULL) OR coalesce(confidence < 0, false) OR low_confidence OR parser_review AS requires_review FROM w""")
def p6(spark, sf_dir):
    g = select(spark, sf_dir, f"{with_views('spark', 'blocks')} {_GATED}")
    return B.review_gate(g).select("block_id", F.concat_ws("|", "warnings").alias("warnings"), "confidence", "requires_review")


@query("p7_clip_bbox", duck("blocks") + """, c AS (SELECT block_id, greatest(x - 100, 0) AS l, greatest(y - 90, 0) AS t, least(x - 100 + w, 300) AS r, least(y - 90 + h, 500) AS b FROM blocks)
    SELECT block_id, l AS x, t AS y, r - l AS w, b - t AS h FROM c WHERE r > l AND b > t""")
def p7(spark, sf_dir):
    box = G.box(F.col("x") - 100, F.col("y") - 90, F.col("w"), F.col("h"))
    return _blocks(spark, sf_dir).select("block_id", G.clip(box, F.lit(300.0), F.lit(500.0)).alias("c")).filter("c IS NOT NULL").selectExpr("block_id", "c.x AS x", "c.y AS y", "c.width AS w", "c.height AS h")


@query("p8_bbox_predicates", duck("blocks") + """ SELECT block_id, x >= 72 AND y >= 100 AND x + w <= 400 AND y + h <= 300 AS inside, y < 206 AND 194 < y + h AND abs(y - 194) <= 6 AS on_row, x < 172 AND 100 < x + w AS over_x, y < 300 AND 250 < y + h AS over_y,
    x < 0 OR y < 0 OR x + w > 500 OR y + h > 700 AS outside, w > 0 AS anchor FROM blocks""")
def p8(spark, sf_dir):
    b = G.box(*[F.col(c) for c in "xywh"])
    big = G.box(F.lit(72.0), F.lit(100.0), F.lit(328.0), F.lit(200.0))
    row = G.box(F.lit(0.0), F.lit(194.0), F.lit(10.0), F.lit(12.0))
    band = G.box(F.lit(100.0), F.lit(250.0), F.lit(72.0), F.lit(50.0))
    return _blocks(spark, sf_dir).select("block_id", G.contains(big, b).alias("inside"), G.share_row(b, row).alias("on_row"), G.overlap_x(b, band).alias("over_x"), G.overlap_y(b, band).alias("over_y"), G.outside(b, F.lit(500.0), F.lit(700.0)).alias("outside"), G.anchor_ok(F.col("page"), b).alias("anchor"))


@query("p9_flip_origin", duck("blocks") + " SELECT block_id, x, 842 - y - h AS y FROM blocks")
def p9(spark, sf_dir):
    return _blocks(spark, sf_dir).select("block_id", G.flip_origin(G.box(*[F.col(c) for c in "xywh"]), F.lit(842.0)).alias("f")).selectExpr("block_id", "f.x AS x", "f.y AS y")


_TYPED = """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 7 WHEN 0 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) WHEN 1 THEN CONCAT('1,', lpad(CAST(l_suppkey AS STRING), 3, '0')) WHEN 2 THEN CONCAT(CAST(l_suppkey AS STRING), ',1') WHEN 3 THEN CAST(CAST(l_shipdate AS DATE) AS STRING)
    WHEN 4 THEN CONCAT('1999-02-', CAST(20 + l_suppkey % 12 AS STRING)) WHEN 5 THEN CASE WHEN l_suppkey % 3 = 0 THEN ' Yes ' WHEN l_suppkey % 3 = 1 THEN 'false' ELSE 'maybe' END ELSE CONCAT('0', CAST(l_partkey AS STRING)) END AS v FROM lineitem"""


@query("p10_typed_parse", f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN regexp_matches(trim(v), '^[+-]?(\\d+|\\d{{1,3}}(,\\d{{3}})+)(\\.\\d+)?$') THEN try_cast(replace(trim(v), ',', '') AS DOUBLE) END AS num,
    CASE WHEN regexp_matches(trim(v), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN CAST(try_cast(trim(v) AS DATE) AS VARCHAR) END AS day, CASE WHEN lower(trim(v)) IN ('true', 'yes', '1') THEN true WHEN lower(trim(v)) IN ('false', 'no', '0') THEN false END AS flag FROM ({_TYPED})""")
def p10(spark, sf_dir):
    v = F.col("v")
    return select(spark, sf_dir, _TYPED).select("l_orderkey", "l_linenumber", "l_partkey", V.parse_number(v).alias("num"), V.parse_date(v).cast("string").alias("day"), V.parse_bool(v).alias("flag"))


@query("p11_cell_type", f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN trim(v) = '' THEN 'blank' WHEN regexp_matches(trim(v), '^-?(0|[1-9]\\d*)(\\.\\d+)?$') AND length(ltrim(regexp_replace(v, '[^0-9]', '', 'g'), '0')) <= 15 THEN 'number' ELSE 'text' END AS type FROM ({_TYPED})""")
def p11(spark, sf_dir):
    return select(spark, sf_dir, _TYPED).select("l_orderkey", "l_linenumber", "l_partkey", V.cell_type(F.col("v")).alias("type"))


_REF = "CONCAT(chr(CAST(65 + p_partkey % 26 AS INT)), CASE WHEN p_partkey % 3 = 0 THEN chr(CAST(65 + p_size % 26 AS INT)) ELSE '' END, CAST(p_size AS STRING))"


@query("p12_cell_ref", "SELECT p_partkey, p_size AS row, CASE WHEN p_partkey % 3 = 0 THEN 26 * (p_partkey % 26 + 1) + p_size % 26 + 1 ELSE p_partkey % 26 + 1 END AS col FROM part")
def p12(spark, sf_dir):
    row, column = V.cell_ref(F.expr(_REF))
    return select(spark, sf_dir, "SELECT p_partkey, p_size FROM part").select("p_partkey", row.alias("row"), column.cast("long").alias("col"))


@query("p13_split_table", duck("blocks") + r""", c AS (SELECT block_id, list_transform(CASE WHEN contains(text, chr(9)) THEN string_split(text, chr(9)) WHEN contains(text, '|') THEN string_split(regexp_replace(trim(text), '^\||\|$', '', 'g'), '|') WHEN contains(text, ',') THEN string_split(text, ',') ELSE regexp_split_to_array(trim(text), '\s{2,}') END, lambda x: trim(x)) AS cells FROM blocks)
    SELECT block_id, 0 AS row, len(cells) AS n, array_to_string(cells, '/') AS cells FROM c WHERE len(list_filter(cells, lambda x: x <> '')) > 0 AND NOT len(list_filter(cells, lambda x: NOT regexp_matches(x, '^:?-{3,}:?$'))) = 0""")
def p13(spark, sf_dir):
    rows = _blocks(spark, sf_dir).select("block_id", F.posexplode(X.split_table(F.col("text"))).alias("row", "cells"))
    return rows.select("block_id", "row", F.size("cells").cast("long").alias("n"), F.array_join("cells", "/").alias("cells"))


_FIELD = "CONCAT(p_type, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN ': ' ELSE ' : a:' END, p_name)"


@query("p20_split_field", f"SELECT p_partkey, CASE WHEN contains(f, ':') THEN trim(split_part(f, ':', 1)) ELSE '' END AS label, trim(CASE WHEN contains(f, ':') THEN substr(f, instr(f, ':') + 1) ELSE f END) AS value FROM (SELECT p_partkey, {_FIELD} AS f FROM part)")
def p20(spark, sf_dir):
    label, value = X.split_field(F.expr(_FIELD))
    return select(spark, sf_dir, "SELECT p_partkey, p_type, p_name FROM part").select("p_partkey", label.alias("label"), value.alias("value"))


# ---------------------------------------------------------------- assembly


@query("t4_reading_order", duck("blocks") + " SELECT block_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, x, block_id) AS place FROM blocks")
def t4(spark, sf_dir):
    return B.reading_order(_blocks(spark, sf_dir)).select("block_id", "place")


#: Words of lines as fragments: three of a visual line share a height.
def _fragments(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return b.select("doc_id", "page", (F.col("doc_id") * 100_000 + F.col("idx")).alias("fragment_id"), (F.col("x") + (F.col("idx") % 3) * 150).alias("x"), (F.col("y") - (F.col("idx") % 3) * 14 + (F.col("idx") % 2)).alias("y"), F.least(F.lit(140.0), F.col("w")).alias("w"), "h", "text", "idx",
                    F.when((F.col("doc_id") % 5 != 0) | (F.col("idx") % 4 != 1), F.floor(F.col("idx") / 3).cast("int")).alias("source_line"))


_FRAGMENTS = """, fragments AS (SELECT doc_id, page, doc_id * 100000 + idx AS fragment_id, x + (idx % 3) * 150 AS x, y - (idx % 3) * 14 + idx % 2 AS y, least(140.0, w) AS w, h, text, idx, CASE WHEN doc_id % 5 <> 0 OR idx % 4 <> 1 THEN CAST(floor(idx / 3) AS INT) END AS source_line FROM blocks),
    whole AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY source_line) AS line FROM fragments f WHERE NOT EXISTS (SELECT 1 FROM fragments g WHERE g.doc_id = f.doc_id AND g.page = f.page AND g.source_line IS NULL))"""


@query("w1_native_lines", duck("blocks") + _FRAGMENTS + " SELECT fragment_id, line, row_number() OVER (PARTITION BY doc_id, page, source_line ORDER BY x, fragment_id) AS place FROM whole")
def w1(spark, sf_dir):
    return B.native_lines(_fragments(spark, sf_dir)).select("fragment_id", "line", "place")


@query("w2_visual_lines")
def w2(spark, sf_dir):
    return B.visual_lines(_fragments(spark, sf_dir))


@query("w3_line_text", duck("blocks") + _FRAGMENTS + r""", g AS (SELECT *, x - lag(x + w) OVER o AS gap, lag(text) OVER o AS t FROM whole WINDOW o AS (PARTITION BY doc_id, page, line ORDER BY x, fragment_id))
    SELECT doc_id, page, line, string_agg(CASE WHEN gap > 0.15 * h AND NOT regexp_matches(t, '\s$') AND NOT regexp_matches(text, '^\s') THEN ' ' ELSE '' END || text, '' ORDER BY x, fragment_id) AS text FROM g GROUP BY ALL""")
def w3(spark, sf_dir):
    return B.line_text(B.native_lines(_fragments(spark, sf_dir)), ["doc_id", "page", "line"])


def _lines(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "page", "idx", "y", "h", "text", (F.col("type") == "table").alias("tabular"), (12 + (F.length("text") % 5 == 0).cast("int") * 4 + (F.col("idx") == 0).cast("int") * 4).cast("double").alias("size"))


@query("w4_table_groups", duck("blocks") + """, g AS (SELECT *, lag(type) OVER o = 'table' AND y - lag(y) OVER o - lag(h) OVER o BETWEEN -0.75 * h AND h AS j FROM blocks WINDOW o AS (PARTITION BY doc_id, page ORDER BY y, idx))
    SELECT doc_id, page, idx, CASE WHEN type = 'table' THEN CAST(sum(CASE WHEN type = 'table' AND NOT coalesce(j, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y, idx) AS BIGINT) END AS table_no FROM g""")
def w4(spark, sf_dir):
    return B.table_groups(_lines(spark, sf_dir)).select("doc_id", "page", "idx", "table_no")


@query("w5_headings", duck("blocks") + """, q AS (SELECT doc_id, page, idx, y + CASE WHEN idx % 50 >= 40 THEN 60 ELSE 0 END AS y, h, type = 'table' AS tabular, CAST(12 + CASE WHEN length(text) % 5 = 0 THEN 4 ELSE 0 END + CASE WHEN idx = 0 THEN 4 ELSE 0 END AS DOUBLE) AS size FROM blocks),
    r AS (SELECT *, sum(CASE WHEN y - pb <= 36 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY y) AS run FROM (SELECT *, lag(y + h) OVER (PARTITION BY doc_id, page ORDER BY y) AS pb FROM q)),
    t AS (SELECT *, row_number() OVER w - 1 AS before, max(size) OVER (PARTITION BY doc_id, page ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS largest FROM r WHERE NOT tabular WINDOW w AS (PARTITION BY doc_id, page ORDER BY y)),
    m AS (SELECT a.doc_id, a.page, a.idx, list(b.size ORDER BY b.size) AS s FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page AND a.run = b.run AND b.y > a.y WHERE a.before <= 2 GROUP BY ALL)
    SELECT t.doc_id, t.page, t.idx, coalesce(t.size >= 1.2 * m.s[len(m.s) // 2 + 1] AND (t.largest IS NULL OR t.largest <= m.s[len(m.s) // 2 + 1]), false) AS heading FROM t LEFT JOIN m USING (doc_id, page, idx)""")
def w5(spark, sf_dir):
    return B.headings(_lines(spark, sf_dir).withColumn("y", F.col("y") + F.when(F.col("idx") % 50 >= 40, 60).otherwise(0)))


_PAGES = """, pages_ AS (SELECT doc_id, p AS page, CAST(612 AS DOUBLE) AS width, CAST(700 AS DOUBLE) AS height, CASE WHEN doc_id % 8 = 0 THEN 'px' ELSE 'pt' END AS unit FROM (SELECT doc_id, max(page) AS m FROM blocks GROUP BY doc_id) CROSS JOIN (SELECT 1 AS p UNION ALL SELECT 2 UNION ALL SELECT 3) WHERE p <= m + 1 AND doc_id % 13 <> 0)"""


def _pages(spark, sf_dir):
    b = _blocks(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("m")).filter("doc_id % 13 <> 0")
    return b.select("doc_id", F.explode(F.sequence(F.lit(1), F.least(F.col("m") + 1, F.lit(3)))).alias("page"), F.lit(612.0).alias("width"), F.lit(700.0).alias("height"), F.when(F.col("doc_id") % 8 == 0, "px").otherwise("pt").alias("unit"))


@query("w6_blocks_from_lines", duck("blocks") + _PAGES + """, e AS (SELECT doc_id, page, y, x, text, confidence, false AS bare FROM blocks UNION ALL SELECT doc_id, page, 0, 0, '', 0, true FROM pages_ WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM blocks))
    SELECT doc_id, 'b' || row_number() OVER (PARTITION BY doc_id ORDER BY page, y, x, text) AS block_id, page, text, confidence, bare OR confidence < 0.8 AS requires_review FROM e""")
def w6(spark, sf_dir):
    return B.blocks_from_lines(_blocks(spark, sf_dir), _pages(spark, sf_dir))


@query("a20_bbox_union", duck("blocks") + """ SELECT doc_id, page, CASE WHEN doc_id % 6 <> 0 OR count(DISTINCT idx % 2) = 1 THEN min(x) END AS x, CASE WHEN doc_id % 6 <> 0 OR count(DISTINCT idx % 2) = 1 THEN min(y) END AS y,
    CASE WHEN doc_id % 6 <> 0 OR count(DISTINCT idx % 2) = 1 THEN max(x + w) - min(x) END AS w, CASE WHEN doc_id % 6 <> 0 OR count(DISTINCT idx % 2) = 1 THEN max(y + h) - min(y) END AS h FROM blocks GROUP BY doc_id, page""")
def a20(spark, sf_dir):
    b = _blocks(spark, sf_dir).withColumns({"unit": F.when((F.col("doc_id") % 6 == 0) & (F.col("idx") % 2 == 0), "px").otherwise("pt"), "origin": F.lit("top-left")})
    return B.bbox_union(b, ["doc_id", "page"])


_CHECKED = _PAGES + """, bad AS (SELECT b.doc_id, b.block_id, b.idx, concat_ws(', ', CASE WHEN p.page IS NULL THEN 'undeclared page' END, CASE WHEN p.unit = 'px' THEN 'unit mismatch' END, CASE WHEN b.x + b.w > 500 AND b.doc_id % 2 = 0 AND p.page IS NOT NULL AND b.x + b.w + 100 > p.width OR b.y + b.h > p.height THEN 'bbox outside page' END) AS errors
    FROM (SELECT doc_id, block_id, idx, page, y, h, text, confidence, w, x + CASE WHEN doc_id % 2 = 0 THEN 100 ELSE 0 END AS x FROM blocks) b LEFT JOIN pages_ p ON b.doc_id = p.doc_id AND b.page = p.page)"""


def _shifted(spark, sf_dir):
    return _blocks(spark, sf_dir).withColumn("x", F.col("x") + F.when(F.col("doc_id") % 2 == 0, 100.0).otherwise(0.0)).withColumns({"unit": F.lit("pt"), "low_confidence": F.col("confidence") < 0.8})


_CHECKED = _CHECKED.replace("b.x + b.w > 500 AND b.doc_id % 2 = 0 AND p.page IS NOT NULL AND b.x + b.w + 100 > p.width", "b.x + b.w > p.width")


@query("j5_check_blocks", duck("blocks") + _CHECKED + " SELECT doc_id, block_id, errors FROM bad WHERE errors <> ''")
def j5(spark, sf_dir):
    return B.check_blocks(_shifted(spark, sf_dir), _pages(spark, sf_dir)).select("doc_id", "block_id", F.concat_ws(", ", "errors").alias("errors"))


@query("a21_validate_ir", duck("blocks") + _CHECKED + f""", e AS (SELECT doc_id, string_agg(idx || ': ' || errors, '|' ORDER BY idx) AS errors FROM bad WHERE errors <> '' GROUP BY doc_id),
    r AS (SELECT doc_id, bool_or({n('text')} = '' OR confidence < 0.8) AS review FROM blocks GROUP BY doc_id)
    SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 13 = 0 THEN 'document has no pages' END, e.errors) AS errors, doc_id % 13 <> 0 AND e.errors IS NULL AS ok, review OR doc_id % 13 = 0 OR e.errors IS NOT NULL AS requires_review FROM r LEFT JOIN e USING (doc_id)""")
def a21(spark, sf_dir):
    docs = select(spark, sf_dir, "SELECT doc_id FROM documents")
    return B.validate_ir(docs, _pages(spark, sf_dir), _shifted(spark, sf_dir)).select("doc_id", F.concat_ws("|", "errors").alias("errors"), "ok", "requires_review")


@query("s3_adapt_v0", duck("blocks") + _PAGES + """ SELECT b.block_id, coalesce(p.page, f.m) AS page FROM (SELECT block_id, doc_id, page + CASE WHEN idx % 4 = 0 THEN 5 ELSE 0 END AS page FROM blocks) b LEFT JOIN pages_ p ON p.doc_id = b.doc_id AND p.page = b.page LEFT JOIN (SELECT doc_id, min(page) AS m FROM pages_ GROUP BY doc_id) f ON f.doc_id = b.doc_id""")
def s3(spark, sf_dir):
    b = _blocks(spark, sf_dir).withColumn("page", F.col("page") + F.when(F.col("idx") % 4 == 0, 5).otherwise(0))
    return B.adapt_v0(b, _pages(spark, sf_dir)).select("block_id", "page")


# ---------------------------------------------------------------- neighbours

_SIDES = ", placed AS (SELECT doc_id, page, block_id, idx, text, x + (idx % 2) * 500 AS x, y - (idx % 2) * 14 + (idx % 2) * 3 AS y, w, h FROM blocks), anchors AS (SELECT doc_id, page, block_id AS anchor_id, x, y, w, h FROM placed WHERE idx % 6 = 0)"


def _placed(spark, sf_dir):
    odd = F.col("idx") % 2
    p = _blocks(spark, sf_dir).withColumns({"x": F.col("x") + odd * 500, "y": F.col("y") - odd * 14 + odd * 3})
    return p, p.filter("idx % 6 = 0").withColumn("anchor_id", F.col("block_id"))


@query("j7_right_of", duck("blocks") + _SIDES + """ SELECT a.doc_id, a.anchor_id, arg_min(b.block_id, (b.x, b.y, b.block_id)) AS block_id FROM anchors a JOIN placed b ON a.doc_id = b.doc_id AND a.page = b.page AND b.block_id <> a.anchor_id AND b.x >= a.x + a.w AND b.y < a.y + a.h AND a.y < b.y + b.h AND abs(b.y - a.y) <= greatest(4, least(a.h, b.h) / 2) GROUP BY a.doc_id, a.anchor_id""")
def j7(spark, sf_dir):
    return B.right_of(*_placed(spark, sf_dir))


@query("j8_below", duck("blocks") + _SIDES + """, k AS (SELECT doc_id, a.anchor_id, CASE WHEN a.y % 3 = 0 THEN 'label' ELSE 'text' END AS kind, b.block_id, b.y, b.x, t.type IN ('paragraph', 'field') AS ok FROM anchors a JOIN placed b USING (doc_id, page) JOIN blocks t USING (doc_id, block_id)
    WHERE b.block_id <> a.anchor_id AND b.y > a.y AND (a.y % 3 <> 0 OR (b.x < a.x + a.w AND a.x < b.x + b.w))), o AS (SELECT *, row_number() OVER w AS place, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS stopped FROM k WINDOW w AS (PARTITION BY doc_id, anchor_id ORDER BY y, x, block_id))
    SELECT doc_id, anchor_id, block_id, place FROM o WHERE stopped = 0 AND (kind <> 'label' OR place = 1)""")
def j8(spark, sf_dir):
    p, a = _placed(spark, sf_dir)
    return B.below(p, a.withColumn("kind", F.when(F.col("y") % 3 == 0, "label").otherwise("text")))


_LABELS = """, lab AS (SELECT doc_id, page, block_id AS label_id, text, x - 1 AS x, y - 15 AS y, w + 300 AS w, h + 30 AS h FROM blocks WHERE idx % 5 = 0)"""


@query("j11_label_cells", duck("blocks") + _LABELS + f" SELECT l.doc_id, l.page, l.label_id, b.block_id FROM lab l JOIN blocks b ON l.doc_id = b.doc_id AND l.page = b.page AND b.x >= l.x AND b.y >= l.y AND b.x + b.w <= l.x + l.w AND b.y + b.h <= l.y + l.h WHERE {n('l.text')} <> '' AND contains({n('b.text')}, {n('l.text')})")
def j11(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    labels = b.filter("idx % 5 = 0").select("doc_id", "page", F.col("block_id").alias("label_id"), "text", (F.col("x") - 1).alias("x"), (F.col("y") - 15).alias("y"), (F.col("w") + 300).alias("w"), (F.col("h") + 30).alias("h"))
    return B.label_cells(labels, b)


@query("j12_assign_metadata")
def j12(spark, sf_dir):
    f = _fragments(spark, sf_dir)
    sources = f.filter("idx % 3 <> 1").select("doc_id", "page", "text", (F.col("fragment_id") + 1).alias("source_id"), (F.col("idx") % 2).alias("rank"), (F.col("x") + 3).alias("x"), "y")
    return B.assign_metadata(f, sources)


@query("j13_attach_rows", duck("blocks") + """, t AS (SELECT doc_id, page, text, 't' || idx AS table_id, doc_id % 3 = idx % 3 AS "foreign", row_number() OVER (PARTITION BY doc_id, page, text ORDER BY doc_id % 3 = idx % 3, 't' || idx) AS n FROM blocks WHERE idx % 4 <> 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, text ORDER BY idx) AS n FROM blocks) SELECT b.doc_id, b.block_id, t.table_id FROM b LEFT JOIN t USING (doc_id, page, text, n)""")
def j13(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    t = b.filter("idx % 4 <> 2").select("doc_id", "page", "text", F.concat(F.lit("t"), F.col("idx").cast("string")).alias("table_id"), (F.col("doc_id") % 3 == F.col("idx") % 3).alias("foreign"))
    return B.attach_rows(t, b)


@query("j14_merge_tables", duck("blocks") + f""", f AS (SELECT doc_id, page, {n('text')} AS k, doc_id * 100000 + idx AS fragment_id, row_number() OVER (PARTITION BY doc_id, page, {n('text')} ORDER BY idx) AS n FROM blocks),
    t AS (SELECT DISTINCT doc_id, page, {n("CASE WHEN idx % 10 = 0 THEN text || '+' ELSE text END")} AS k, CASE WHEN idx % 10 = 0 THEN 'new' ELSE 'old' END AS table_id, 1 AS n FROM blocks WHERE idx % 5 = 0)
    SELECT coalesce(f.doc_id, t.doc_id) AS doc_id, coalesce(f.page, t.page) AS page, fragment_id, table_id, CASE WHEN fragment_id IS NULL THEN 'added' WHEN table_id IS NULL AND coalesce(f.n, t.n) > 1 THEN 'stale' WHEN table_id IS NULL THEN 'kept' ELSE 'replaced' END AS fate
    FROM f FULL JOIN t ON f.doc_id = t.doc_id AND f.page = t.page AND f.k = t.k AND f.n = t.n""")
def j14(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    new = F.col("idx") % 10 == 0
    t = b.filter("idx % 5 = 0").select("doc_id", "page", F.when(new, F.concat("text", F.lit("+"))).otherwise(F.col("text")).alias("text"), F.when(new, "new").otherwise("old").alias("table_id"))
    return B.merge_tables(b.withColumn("fragment_id", F.col("doc_id") * 100_000 + F.col("idx")), t)


# ---------------------------------------------------------------- review


@query("a26_review_queue", duck("blocks") + """ SELECT doc_id, 'block' AS kind, block_id AS target FROM blocks WHERE confidence < 0.8 UNION ALL SELECT doc_id, 'field', 'f' || idx FROM blocks WHERE idx % 9 = 0 AND confidence < 0.9
    UNION ALL SELECT doc_id, 'table', 't' || idx FROM blocks WHERE type = 'table' AND idx % 2 = 0 UNION ALL SELECT DISTINCT doc_id, 'model_fallback', 'document' FROM blocks WHERE doc_id % 10 = 0""")
def a26(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    blocks = b.select("doc_id", "block_id", (F.col("confidence") < 0.8).alias("requires_review"))
    fields = b.filter("idx % 9 = 0").select("doc_id", F.concat(F.lit("f"), F.col("idx").cast("string")).alias("field_id"), (F.col("confidence") < 0.9).alias("requires_review"))
    tables = b.filter("type = 'table'").select("doc_id", F.concat(F.lit("t"), F.col("idx").cast("string")).alias("table_id"), (F.col("idx") % 2 == 0).alias("requires_review"))
    return B.review_queue(blocks, fields, tables, b.filter("doc_id % 10 = 0").select("doc_id").distinct())


@query("a27_ocr_boundary", duck("blocks") + f" SELECT doc_id, count(*) AS blocks, array_to_string(list(DISTINCT page ORDER BY page), ',') AS pages FROM blocks WHERE idx % 6 = 0 OR {n('text')} = '' GROUP BY doc_id")
def a27(spark, sf_dir):
    b = _blocks(spark, sf_dir).withColumn("text", F.when(F.col("idx") % 6 != 0, F.col("text")))
    return B.ocr_boundary(b).select("doc_id", "blocks", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("a28_doc_text", duck("blocks") + f" SELECT doc_id, 'document ' || doc_id || chr(10) || string_agg('[' || type || '] ' || {n('text')}, chr(10) ORDER BY page, y, x, block_id) AS text FROM blocks GROUP BY doc_id")
def a28(spark, sf_dir):
    return B.doc_text(_blocks(spark, sf_dir), F.concat(F.lit("document "), F.col("doc_id").cast("string")))


_COVERED = """SELECT doc_id, idx, block_id AS target, CONCAT(block_id, '#', CAST(k AS STRING)) AS item_id, doc_id % 4 <> 0 AS high_risk, doc_id % 17 = 0 AND k = 0 AS auto_confirmed, doc_id % 5 <> 0 AS converted
    FROM blocks CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) r WHERE idx % 14 <> 7 AND idx % 7 < 2 AND (k = 0 OR doc_id % 11 = 0)"""


@query("j23_high_risk_coverage", duck("blocks") + f""", t AS (SELECT DISTINCT block_id AS target FROM blocks WHERE idx % 7 = 0), i AS ({_COVERED}), d AS (SELECT item_id FROM i WHERE doc_id % 3 = 0),
    f AS (SELECT *, item_id IN (SELECT item_id FROM d) AS decided, row_number() OVER (PARTITION BY target ORDER BY item_id) AS r, count(*) OVER (PARTITION BY target) - 1 AS duplicates FROM i)
    SELECT t.target, CASE WHEN f.target IS NULL THEN 'missed' WHEN auto_confirmed OR (converted AND NOT decided) THEN 'auto_confirmed' WHEN decided THEN 'covered' ELSE 'undecided' END AS status, coalesce(duplicates, 0) AS duplicates FROM t LEFT JOIN f ON f.target = t.target AND f.r = 1
    UNION ALL SELECT target, 'unexpected', count(*) - 1 FROM i WHERE high_risk AND target NOT IN (SELECT target FROM t) GROUP BY target""")
def j23(spark, sf_dir):
    items = select(spark, sf_dir, f"{with_views('spark', 'blocks')} {_COVERED}")
    decisions = items.filter("doc_id % 3 < 2").select("item_id", F.when(F.col("doc_id") % 3 == 0, "approved").otherwise("opened").alias("decision"))
    targets = _blocks(spark, sf_dir).filter("idx % 7 = 0").select(F.col("block_id").alias("target")).distinct()
    return B.high_risk_coverage(targets, items, decisions)


@query("d5_check_ir", duck("blocks") + _CHECKED + """, e AS (SELECT doc_id, CASE WHEN idx % 9 = 8 THEN doc_id || '-0' ELSE block_id END AS block_id, errors FROM bad)
    SELECT doc_id, block_id, 'repeated block' AS error FROM e GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT DISTINCT doc_id, block_id, unnest(string_split(errors, ', ')) FROM e WHERE errors <> ''""".replace("SELECT doc_id, block_id, 'repeated block' AS error FROM e GROUP BY ALL HAVING count(*) > 1", "SELECT doc_id, block_id, 'repeated block' AS error FROM e GROUP BY doc_id, block_id HAVING count(*) > 1"))
def d5(spark, sf_dir):
    b = _shifted(spark, sf_dir)
    b = b.withColumn("block_id", F.when(F.col("idx") % 9 == 8, F.concat(F.col("doc_id").cast("string"), F.lit("-0"))).otherwise(F.col("block_id")))
    return B.check_ir(_pages(spark, sf_dir), b)
