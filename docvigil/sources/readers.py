"""Scans of files in the shapes that converters write; every schema is stated, none is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BBOX = "struct<x:double,y:double,width:double,height:double,unit:string,origin:string>"
FRAGMENT = f"struct<text:string,kind:string,page_number:int,bbox:{BBOX},extractor:string,engine:string,confidence:double,rows:array<array<string>>,source_line_index:int,font_size:double>"
PAGE = f"struct<page_number:int,width:double,height:double,unit:string,fragments:array<{FRAGMENT}>,regions:array<{FRAGMENT}>>"
PARSER_OUTPUT = f"source_path string, source_type string, extractor string, pages array<{PAGE}>, blocks array<struct<text:string,kind:string>>, sheets array<struct<name:string,cells:array<struct<ref:string,value:string>>>>, _corrupt string"
CELLS = "array<struct<id:string,text:string,source:struct<source_page:int,x:double>,requires_review:boolean,auto_confirmed:boolean>>"
CASES = f"case_id string, fixture_id string, expected struct<tables:array<struct<id:string,cells:{CELLS}>>>, actual struct<tables:array<struct<id:string,cells:{CELLS}>>>"
MANIFEST = "fixtures array<struct<id:string,path:string,public:boolean,safe:boolean,anonymised:boolean>>"

ENTITIES = {
    "documents": "document_id string, title string, source_type string, created_at string",
    "source_artifacts": "artifact_id string, document_id string, sha256 string, size string",
    "jobs": "job_id string, document_id string, status string, mode string, idempotency_key string, attempts int",
    "job_events": "event_id string, job_id string, sequence int, event_type string, payload string",
    "results": "result_id string, job_id string, document_id string, status string",
    "artifacts": "artifact_id string, job_id string, document_id string, name string, sha256 string",
    "review_items": "item_id string, job_id string, target string, risk_level string, state string",
    "review_decisions": "decision_id string, item_id string, actor string, role string, decision string",
    "audit_events": "event_id string, scope_type string, scope_id string, action string, actor string, sequence int, previous_hash string, event_hash string",
}


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """One row a parser output; a line that is no JSON keeps its text in ``_corrupt``."""
    return spark.read.schema(PARSER_OUTPUT).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def all_blocks(page: Column) -> Column:
    """A page's fragments, then its regions, in order."""
    none = F.array().cast(f"array<{FRAGMENT}>")
    return F.concat(F.coalesce(page["fragments"], none), F.coalesce(page["regions"], none))


def parser_blocks(raw: DataFrame) -> DataFrame:
    """Parser outputs as rows of blocks: (source_path, page, idx, text, kind, x, y, w, h, confidence).
    A block without a page number is on its page's, a page without one on its own place."""
    pages = raw.select("source_path", F.posexplode_outer("pages").alias("p", "page"))
    rows = pages.select("source_path", F.coalesce("page.page_number", F.col("p") + 1).alias("page"), F.posexplode_outer(all_blocks(F.col("page"))).alias("idx", "b")).filter("b IS NOT NULL")
    return rows.select("source_path", F.coalesce("b.page_number", "page").alias("page"), "idx", "b.text", F.coalesce("b.kind", F.lit("paragraph")).alias("kind"), "b.bbox.x", "b.bbox.y", F.col("b.bbox.width").alias("w"), F.col("b.bbox.height").alias("h"), "b.confidence")


def read_parser_output(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Blocks and pages of all outputs below ``path``."""
    raw = read_raw(spark, path)
    pages = raw.select("source_path", F.posexplode("pages").alias("p", "page")).select("source_path", F.coalesce("page.page_number", F.col("p") + 1).alias("page"), "page.width", "page.height", "page.unit")
    return parser_blocks(raw), pages


def parser_pages(raw: DataFrame) -> DataFrame:
    """Pages by source type: a word-processor's blocks make one page, each sheet one, else as given."""
    pdf = raw.filter("source_type NOT IN ('docx', 'xlsx')").select("source_path", "source_type", F.posexplode("pages").alias("p", "page")).select("source_path", "source_type", F.coalesce("page.page_number", F.col("p") + 1).alias("page"), F.size(all_blocks(F.col("page"))).alias("blocks"))
    docx = raw.filter("source_type = 'docx'").select("source_path", "source_type", F.lit(1).alias("page"), F.size("blocks").alias("blocks"))
    xlsx = raw.filter("source_type = 'xlsx'").select("source_path", "source_type", F.posexplode("sheets").alias("p", "s")).select("source_path", "source_type", (F.col("p") + 1).alias("page"), F.size("s.cells").alias("blocks"))
    return pdf.unionByName(docx).unionByName(xlsx)


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Expected cells, actual cells, and cases whose id repeats (left out of both)."""
    raw = spark.read.schema(CASES).json(path)
    n = raw.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("case_id")))

    def cells(side: str) -> DataFrame:
        t = n.filter("n = 1").select("case_id", F.explode(f"{side}.tables").alias("t")).select("case_id", F.col("t.id").alias("table_id"), F.explode("t.cells").alias("c"))
        return t.select("case_id", "table_id", F.col("c.id").alias("cell_id"), "c.text", "c.source.source_page", F.col("c.source.x").alias("source_x"), "c.requires_review", "c.auto_confirmed")

    return cells("expected"), cells("actual"), n.filter("n > 1").select("case_id").distinct()


def read_manifest(spark: SparkSession, path: str, root: str) -> tuple[DataFrame, DataFrame]:
    """Fixtures that the policy accepts, and the others with the reasons against them."""
    f = spark.read.schema(MANIFEST).json(path).select(F.explode("fixtures").alias("f")).select("f.*")
    repeated = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    checks = [("duplicate id", repeated), ("not public", ~F.coalesce("public", F.lit(False))), ("not safe", ~F.coalesce("safe", F.lit(False))), ("not anonymised", ~F.coalesce("anonymised", F.lit(False))), ("outside root", ~(F.col("path").startswith(root) & ~F.contains("path", F.lit(".."))))]
    f = f.withColumn("reasons", F.concat_ws("; ", *[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks]))
    return f.filter("reasons = ''").select("id", "path"), f.filter("reasons <> ''").select("id", "path", "reasons")


def read_ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Regions of tab-separated recognition output: blank text and unreadable geometry are skipped, a
    negative confidence is none."""
    raw = spark.read.schema("doc string, page string, left string, top string, width string, height string, conf string, text string").csv(path, sep="\t", header=True, quote='"', escape='"')
    n = {c: F.col(c).try_cast("double") for c in ("left", "top", "width", "height")}
    conf = F.col("conf").try_cast("double")
    rows = raw.select("doc", F.col("page").try_cast("int").alias("page"), n["left"].alias("x"), n["top"].alias("y"), n["width"].alias("w"), n["height"].alias("h"), F.when(conf >= 0, conf / 100).alias("confidence"), "text")
    return rows.filter((F.trim(F.coalesce("text", F.lit(""))) != "") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull())


def read_entities(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(ENTITIES)) -> dict[str, DataFrame]:
    return {n: spark.read.schema(ENTITIES[n]).parquet(f"{folder}/{n}") for n in names}
