"""Queries that write the given tables as files of the scanned formats and read these back."""

from __future__ import annotations

from pyspark.sql import functions as F

from docvigil.operators.fixpoint import new_folder
from docvigil.plans.registry import query, select
from docvigil.plans.views import duck, view
from docvigil.sources import readers as S
from docvigil.sources import sinks as K

_B = "named_struct('x', x, 'y', y, 'width', w, 'height', h, 'unit', 'pt', 'origin', 'top-left')"


def _parser_output(spark, sf_dir) -> str:
    """Blocks as converters write them: odd lines as regions, some without a page number."""
    path = new_folder(spark, "parser")
    b = view(spark, sf_dir, "blocks")
    item = F.struct("idx", F.expr(f"named_struct('text', text, 'kind', type, 'page_number', CASE WHEN idx % 5 <> 0 THEN page END, 'bbox', {_B}, 'confidence', confidence)").alias("b"))
    pages = b.groupBy("doc_id", "page").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("idx") % 2 == k, item))), lambda x: x["b"]).alias(n) for k, n in ((0, "fragments"), (1, "regions"))])
    page = F.struct("page", F.struct(F.when(F.col("doc_id") % 3 != 0, F.col("page")).alias("page_number"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit("pt").alias("unit"), "fragments", "regions").alias("p"))
    docs = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(page)), lambda x: x["p"]).alias("pages"))
    docs = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_path"), F.lit("pdf").alias("source_type"), "pages")
    docs.write.json(path)
    return path


_ORDERED = duck("blocks") + ", o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx % 2, idx) - 1 AS place FROM blocks)"


@query("s1_read_parser_output", _ORDERED + " SELECT 'doc-' || doc_id AS source_path, page, CAST(place AS INT) AS idx, text, type AS kind, x, y, w, h, confidence FROM o")
def s1(spark, sf_dir):
    return S.read_parser_output(spark, _parser_output(spark, sf_dir))[0]


@query("u1_all_blocks", _ORDERED + " SELECT 'doc-' || doc_id AS source_path, page, string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY place) AS lengths FROM o GROUP BY doc_id, page")
def u1(spark, sf_dir):
    raw = S.read_raw(spark, _parser_output(spark, sf_dir)).select("source_path", F.posexplode("pages").alias("p", "page"))
    return raw.select("source_path", (F.col("p") + 1).alias("page"), F.array_join(F.transform(S.all_blocks(F.col("page")), lambda b: F.length(b["text"]).cast("string")), ",").alias("lengths"))


@query("s2_parser_pages", duck("blocks") + """ SELECT 'doc-' || doc_id AS source_path, 'pdf' AS source_type, page, CAST(count(*) AS INT) AS blocks FROM blocks WHERE doc_id % 3 = 0 GROUP BY doc_id, page UNION ALL SELECT 'doc-' || doc_id, 'docx', 1, CAST(count(*) AS INT) FROM blocks WHERE doc_id % 3 = 1 GROUP BY doc_id
    UNION ALL SELECT 'doc-' || doc_id, 'xlsx', page, CAST(count(*) AS INT) FROM blocks WHERE doc_id % 3 = 2 GROUP BY doc_id, page""")
def s2(spark, sf_dir):
    path = new_folder(spark, "sources")
    b = view(spark, sf_dir, "blocks").withColumn("source_path", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    sheets = b.filter("doc_id % 3 = 2").groupBy("source_path", "page").agg(F.collect_list(F.struct(F.col("block_id").alias("ref"), F.col("text").alias("value"))).alias("cells")).groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("page", "cells"))).alias("s"))
    sheets.select("source_path", F.lit("xlsx").alias("source_type"), F.transform("s", lambda x: F.struct(x["page"].cast("string").alias("name"), x["cells"].alias("cells"))).alias("sheets")).write.json(path)
    b.filter("doc_id % 3 = 1").groupBy("source_path").agg(F.lit("docx").alias("source_type"), F.collect_list(F.struct("text", F.col("type").alias("kind"))).alias("blocks")).write.mode("append").json(path)
    pages = b.filter("doc_id % 3 = 0").groupBy("source_path", "page").agg(F.collect_list(F.struct("text")).alias("fragments")).groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct(F.col("page").alias("page_number"), "fragments"))).alias("pages"))
    pages.withColumn("source_type", F.lit("pdf")).write.mode("append").json(path)
    return S.parser_pages(S.read_raw(spark, path))


@query("s4_read_cases", duck("cells") + " SELECT CAST(case_id AS VARCHAR) AS case_id, table_id, cell_id, text, source_page, source_x, requires_review, auto_confirmed FROM cells WHERE case_id % 10 <> 0")
def s4(spark, sf_dir):
    """Every tenth case is written twice. Cells are grouped by the key that they were numbered in, where they are."""
    path = new_folder(spark, "cases")
    cell = F.struct(F.col("cell_id").alias("id"), "text", F.struct("source_page", F.col("source_x").alias("x")).alias("source"), "requires_review", "auto_confirmed")
    tables = view(spark, sf_dir, "cells").groupBy("case_id", "table_id").agg(F.collect_list(cell).alias("cells")).groupBy("case_id").agg(F.struct(F.collect_list(F.struct(F.col("table_id").alias("id"), "cells")).alias("tables")).alias("expected"))
    files = tables.select(F.col("case_id").cast("string").alias("case_id"), "expected", F.explode(F.sequence(F.lit(0), (F.col("case_id") % 10 == 0).cast("int"))).alias("copy")).drop("copy")
    files.write.option("compression", "gzip").json(path)
    return S.read_cases(spark, path)[0]


@query("s5_read_manifest", "WITH v AS (SELECT CAST(p_partkey % 1990 AS VARCHAR) AS id, CASE WHEN p_partkey % 8 = 0 THEN 'data/../x' WHEN p_partkey % 9 = 0 THEN 'tmp/x' ELSE 'data/' || p_partkey END AS path, concat_ws('; ', CASE WHEN count(*) OVER (PARTITION BY p_partkey % 1990) > 1 THEN 'duplicate id' END, CASE WHEN p_partkey % 5 = 0 THEN 'not public' END, CASE WHEN p_partkey % 6 = 0 THEN 'not safe' END, CASE WHEN p_partkey % 7 = 0 THEN 'not anonymised' END, CASE WHEN p_partkey % 8 = 0 OR p_partkey % 9 = 0 THEN 'outside root' END) AS reasons FROM part) SELECT * FROM v WHERE reasons <> ''")
def s5(spark, sf_dir):
    path = new_folder(spark, "manifest")
    p = select(spark, sf_dir, "SELECT p_partkey AS k FROM part")
    k = F.col("k")
    row = F.struct((k % 1990).cast("string").alias("id"), F.when(k % 8 == 0, "data/../x").when(k % 9 == 0, "tmp/x").otherwise(F.concat(F.lit("data/"), k.cast("string"))).alias("path"), (k % 5 != 0).alias("public"), F.when(k % 6 != 0, True).alias("safe"), (k % 7 != 0).alias("anonymised"))
    p.groupBy(F.floor(k / 500).alias("g")).agg(F.collect_list(row).alias("fixtures")).select("fixtures").write.json(path)
    return S.read_manifest(spark, path, "data/")[1]


@query("s6_read_ocr_tsv", duck("blocks") + " SELECT CAST(doc_id AS VARCHAR) AS doc, page, x, y, w, h, CASE WHEN idx % 4 <> 0 THEN CAST(floor(confidence * 100) AS DOUBLE) / 100 END AS confidence, trim(text) AS text FROM blocks WHERE trim(text) <> '' AND idx % 6 <> 5")
def s6(spark, sf_dir):
    path = new_folder(spark, "tsv")
    b = view(spark, sf_dir, "blocks")
    rows = b.select("doc_id", "page", F.when(F.col("idx") % 6 != 5, F.col("x").cast("string")).otherwise("wide").alias("left"), F.col("y").alias("top"), F.col("w").alias("width"), F.col("h").alias("height"), F.when(F.col("idx") % 4 == 0, -1).otherwise(F.floor(F.col("confidence") * 100)).alias("conf"), F.trim("text").alias("text"))
    rows.write.csv(path, sep="\t", header=True, escape='"')
    return S.read_ocr_tsv(spark, path)


@query("s7_read_entities", "SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CAST(o_custkey AS VARCHAR) AS document_id, o_orderstatus AS status, CAST(c_name AS VARCHAR) AS title FROM orders JOIN customer ON o_custkey = c_custkey")
def s7(spark, sf_dir):
    folder = new_folder(spark, "entities")
    select(spark, sf_dir, "SELECT CAST(o_orderkey AS STRING) AS job_id, CAST(o_custkey AS STRING) AS document_id, o_orderstatus AS status, 'fast' AS mode, CAST(o_orderkey AS STRING) AS idempotency_key, 1 AS attempts FROM orders").write.parquet(f"{folder}/jobs")
    select(spark, sf_dir, "SELECT CAST(c_custkey AS STRING) AS document_id, c_name AS title, 'pdf' AS source_type, '' AS created_at FROM customer").write.parquet(f"{folder}/documents")
    e = S.read_entities(spark, folder, ("jobs", "documents"))
    return e["jobs"].join(e["documents"], "document_id").select("job_id", "document_id", "status", "title")


@query("s9_write_report", """SELECT '{"amount":' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ',"key":' || o_orderkey || ',"note":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS line FROM orders""")
def s9(spark, sf_dir):
    path = new_folder(spark, "report")
    K.write_report(select(spark, sf_dir, "SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS note, o_orderkey AS key, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM orders"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("s10_export_grid", duck("blocks") + r""", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) + 3 AS row, list_transform(string_split(regexp_replace(trim(text), '^\||\|$', '', 'g'), '|'), lambda x: trim(x)) AS cells FROM blocks),
    v AS (SELECT doc_id, row, block_id, CASE WHEN type <> 'table' AND contains(text, ':') THEN trim(split_part(text, ':', 1)) ELSE '' END AS label, CASE WHEN type = 'table' THEN array_to_string(cells, ' | ') WHEN contains(text, ':') THEN trim(substr(text, instr(text, ':') + 1)) ELSE trim(text) END AS value FROM r)
    SELECT *, CASE WHEN trim(value) = '' THEN 'blank' WHEN regexp_matches(trim(value), '^-?(0|[1-9]\d*)(\.\d+)?$') AND length(ltrim(regexp_replace(value, '[^0-9]', '', 'g'), '0')) <= 15 THEN 'number' ELSE 'text' END AS value_type FROM v""")
def s10(spark, sf_dir):
    return K.export_grid(view(spark, sf_dir, "blocks"))
