"""Checks of evaluation inputs and artifacts: samples, grids, blocks, warnings, audits, merges, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docvigil.functions.categories import REVIEW_CATEGORIES, is_high_risk, llm_involved, norm_category, ocr_derived, type_category
from docvigil.functions.text import norm, same_text
from docvigil.operators.cells import ratio, rules


def link_samples(required: DataFrame, samples: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Each required mode's first sample with a usable fixture, else its first placeholder, else none."""
    usable = samples.join(fixtures.filter("usable").select("fixture_id"), "fixture_id", "left_semi")
    real = usable.filter("NOT placeholder").groupBy("mode").agg(F.min("sample_id").alias("real"), F.count("sample_id").alias("n"))
    spare = samples.filter("placeholder").groupBy("mode").agg(F.min("sample_id").alias("spare"))
    j = required.join(real, "mode", "left").join(spare, "mode", "left")
    state = F.when(F.col("real").isNotNull(), "linked").when(F.col("spare").isNotNull(), "placeholder").otherwise("missing")
    return j.select("mode", F.coalesce("real", "spare").alias("sample_id"), F.coalesce("n", F.lit(0)).alias("usable"), state.alias("state"))


def match_grid(expected: DataFrame, actual: DataFrame, by: list[str]) -> DataFrame:
    """Artifact cells against expected ones by reference: equal in value and type, and how the grid is made."""
    a = actual.select(*by, "ref", F.col("value").alias("av"), F.col("value_type").alias("at"), F.col("comment").alias("ac"), F.lit(True).alias("there"))
    j = expected.join(a, [*by, "ref"], "left")
    same = F.coalesce("there", F.lit(False)) & F.col("value").eqNullSafe(F.col("av")) & F.col("value_type").eqNullSafe(F.col("at"))
    return j.groupBy(*by).agg(F.count("ref").alias("cells"), F.count_if(same).alias("matched"), ratio(F.count_if(same), F.count("ref")).alias("rate"), F.count_if(F.coalesce(F.contains("ac", F.lit("source")), F.lit(False))).alias("sourced"), F.count_distinct(F.regexp_extract("ref", r"(\d+)", 1)).alias("rows"), F.count_distinct(F.regexp_extract("ref", r"([A-Z]+)", 1)).alias("columns"))


def match_blocks(expected: DataFrame, actual: DataFrame, by: list[str]) -> DataFrame:
    """Artifact blocks against expected ones by place: body match, source links, review guards."""
    a = actual.select(*by, "pos", F.col("text").alias("at"), F.col("link").alias("al"), F.col("guard").alias("ag"))
    j = expected.join(a, [*by, "pos"], "left")
    n = F.count("pos")
    return j.groupBy(*by).agg(n.alias("blocks"), ratio(F.count_if(same_text(F.col("text"), F.col("at"))), n).alias("body_rate"), ratio(F.count_if(F.coalesce(F.col("link") == F.col("al"), F.lit(False))), n).alias("link_rate"), ratio(F.count_if(F.col("guard") & F.coalesce("ag", F.lit(False))), F.count_if("guard")).alias("guard_rate"))


def warning_diff(expected: DataFrame, actual: DataFrame, allowed: list[str]) -> DataFrame:
    """Warnings that are missing, and those that nothing expected and no allowed prefix covers."""
    missing = expected.join(actual, ["case_id", "warning"], "left_anti").withColumn("kind", F.lit("missing"))
    free = F.lit(False)
    for p in allowed:
        free = free | F.col("warning").startswith(p)
    extra = actual.join(expected, ["case_id", "warning"], "left_anti").filter(~free).withColumn("kind", F.lit("unexpected"))
    return missing.unionByName(extra).distinct()


def check_merges(merges: DataFrame, cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Merge ranges whose block is unknown, that leave their table or are no range, overlap another, or hide a value.

    ``merges(block_id, merge_id, r1, c1, r2, c2)``, ``cells(block_id, row, col, text)``, ``blocks(block_id, n_rows,
    n_cols)``, the tables. A range is dealt out to its rows; in a row ranges are intervals, of which one overlaps
    another if an earlier one reaches it or the next begins before its end, and the filled cells that it covers
    are the difference of two running counts. So no range meets all others, nor all cells, of its block:
    work grows with the rows that ranges cover, and (block, row) deals out a hot block.
    """
    place, own = ["block_id", "row"], ["block_id", "merge_id"]
    m = merges.select(*own, "r1", "c1", "r2", "c2").join(blocks.select("block_id", "n_rows", "n_cols"), "block_id", "left")
    low, high = (F.col("r1") <= F.col("r2")) & (F.col("c1") <= F.col("c2")), (F.col("r2") >= F.col("n_rows")) | (F.col("c2") >= F.col("n_cols"))
    rows = merges.filter("r1 <= r2 AND c1 <= c2").select(*own, "r1", "c1", "c2", F.explode(F.sequence("r1", "r2")).alias("row"))
    w = Window.partitionBy(*place).orderBy("c1", "c2", "merge_id")
    reached = F.max("c2").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("c1")
    reaches = F.lead("c1").over(w) <= F.col("c2")
    over = rows.withColumn("hit", F.coalesce(reached, F.lit(False)) | F.coalesce(reaches, F.lit(False))).groupBy(*own).agg(F.bool_or("hit").alias("over"))
    # points of a row in halves: filled cells count one, ranges read the count before and after them
    at = lambda c: 2 * F.col(c)
    begin = F.when(F.col("row") == F.col("r1"), at("c1") + 1).otherwise(at("c1") - 1)  # a range's first cell may be filled
    filled = cells.filter(norm(F.col("text")) != "").select(*place, F.lit(None).cast(dict(merges.dtypes)["merge_id"]).alias("merge_id"), at("col").alias("pos"), F.lit(1).alias("n"))
    points = rows.select(*place, "merge_id", F.explode(F.array(begin, at("c2") + 1)).alias("pos"), F.lit(0).alias("n")).unionByName(filled)
    count = F.sum("n").over(Window.partitionBy(*place).orderBy("pos"))
    lost = points.withColumn("n", count).filter("merge_id IS NOT NULL").groupBy(*place, "merge_id").agg((F.max("n") > F.min("n")).alias("lost")).groupBy(*own).agg(F.bool_or("lost").alias("lost"))
    j = m.join(over, own, "left").join(lost, own, "left")
    unknown = F.col("n_rows").isNull()
    bad = rules(
        ("unknown block", unknown), ("outside table", ~unknown & F.coalesce(~low | high | (F.col("r1") < 0) | (F.col("c1") < 0), F.lit(True))),
        ("overlap", F.coalesce("over", F.lit(False))), ("value lost", F.coalesce("lost", F.lit(False))))
    return j.select("merge_id", F.concat_ws("; ", bad).alias("violations")).filter("violations <> ''")


def check_annotations(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Source annotations ``(annotation_id, block_id, text)`` of a block that is not there once, or without text."""
    b = blocks.groupBy("block_id").agg(F.count(F.lit(1)).alias("_n"))
    j = annotations.join(b, "block_id", "left")
    bad = rules(("unknown block", F.col("_n").isNull()), ("repeated block", F.coalesce(F.col("_n") > 1, F.lit(False))), ("no text", F.coalesce(norm(F.col("text")) == "", F.lit(True))))
    return j.select("annotation_id", F.concat_ws("; ", bad).alias("violations")).filter("violations <> ''")


def check_plans(runs: DataFrame, plan: str, actions: list[str]) -> DataFrame:
    """Conversion plans that are no plan, have unsupported actions, or send anything out."""
    p = F.from_json(plan, "struct<operations:array<struct<action:string>>,external:boolean>")
    keys = F.coalesce(F.json_object_keys(plan), F.array().cast("array<string>"))
    odd = F.size(F.array_except(keys, F.array(F.lit("operations"), F.lit("external")))) + F.size(F.array_except(F.array(F.lit("operations"), F.lit("external")), keys)) > 0
    bad = rules(("keys", odd), ("action", F.exists(F.coalesce(p["operations"], F.array().cast("array<struct<action:string>>")), lambda o: ~F.coalesce(o["action"].isin(*actions), F.lit(False)))), ("external", F.coalesce(p["external"], F.lit(True))))
    return runs.select("run_id", F.concat_ws("; ", bad).alias("violations")).filter("violations <> ''")


def check_labels(labels: DataFrame, taxonomy: DataFrame, blocks: DataFrame) -> DataFrame:
    """High-risk labels that are not declared once, not marked for review, without value, or unlike their block."""
    t = taxonomy.groupBy("label_id").agg(F.count(F.lit(1)).alias("declared"))
    j = labels.join(t, "label_id", "left").join(blocks.select("block_id", F.col("text").alias("found")), "block_id", "left")
    bad = rules(("taxonomy", F.coalesce("declared", F.lit(0)) != 1), ("risk", ~F.col("risk_level").isin("high", "critical")), ("review", ~F.col("requires_review")), ("value", F.coalesce(norm(F.col("value")), F.lit("")) == ""), ("text", F.coalesce(F.col("text") != F.col("found"), F.lit(True))))
    return j.select("id", F.concat_ws("; ", bad).alias("violations")).filter("violations <> ''")


def review_conditions(items: DataFrame) -> DataFrame:
    """Each item's category, whether it must be reviewed, and the conditions that say so."""
    items = items.withColumn("category", norm_category(F.col("label")))
    category = F.col("category")
    important = category.isin(*REVIEW_CATEGORIES) | type_category(F.col("value_type")).isin(*REVIEW_CATEGORIES) | is_high_risk(F.col("flag"), F.col("risk"), F.col("warnings"))
    w = rules(("ocr-derived item requires human review", ocr_derived(F.col("kind"), F.col("extractor"))), ("extraction engine mismatch requires human review", F.col("expected_extractor").isNotNull() & ~same_text(F.col("expected_extractor"), F.col("extractor"))), ("llm-involved important item requires human review", important & llm_involved(F.col("llm"), F.col("extractor"))))
    return items.select("item_id", category.alias("category"), (important | (F.size(w) > 0)).alias("review"), F.concat_ws("; ", w).alias("conditions"))


def check_audits(audits: DataFrame, results: DataFrame) -> DataFrame:
    """Audits that lack an id or lineage, or whose hashes and counts are not their result's."""
    r = results.select("case_id", F.col("sha").alias("rsha"), F.col("blocks").alias("rblocks"))
    j = audits.join(r, "case_id", "left")
    bad = rules(("audit id", F.coalesce("audit_id", F.lit("")) == ""), ("lineage", F.col("schema_version").isNull() | F.col("prompt_version").isNull()), ("hash", F.col("sha") != F.col("rsha")), ("count", F.col("blocks") != F.col("rblocks")))
    return j.select("case_id", F.concat_ws("; ", bad).alias("violations")).filter("violations <> ''")


def check_boundary(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Cases whose missing text layer is not handled as expected, null matching null."""
    r = results.select("case_id", *[F.col(c).alias(f"r_{c}") for c in ("blocks", "setting", "audited")])
    j = expected.join(r, "case_id", "left")
    bad = rules(*[(c, ~F.col(c).eqNullSafe(F.col(f"r_{c}"))) for c in ("blocks", "setting", "audited")])
    return j.select("case_id", F.concat_ws("; ", bad).alias("differs")).filter("differs <> ''")


def scenario_failures(results: DataFrame) -> DataFrame:
    """Results that failed, by what failed: their structured output first, else the scenario."""
    kind = F.when(~F.coalesce("schema_ok", F.lit(False)), "structured output").when(F.coalesce("status", F.lit("")) != F.col("expected"), "scenario")
    return results.withColumn("failure", kind).filter("failure IS NOT NULL").select("case_id", "failure")


def sheet_grid(cells: DataFrame, most_rows: int = 1024, most_columns: int = 256) -> DataFrame:
    """Sheets' filled cells as rows: (sheet, place from 1, cells).

    ``cells(sheet, nth, row, col, value)``; of cells at one place the last counts. Up to ``most_columns``
    wide, columns keep their places, and up to ``most_rows`` high, blank rows stay as well; beyond, rows
    without a cell go. In wider sheets each row closes up by itself. Cells without a place follow at the
    end, one a row, in their order.
    """
    c = cells.filter(F.coalesce(F.col("value"), F.lit("")) != "")
    placed = c.filter("row IS NOT NULL AND col IS NOT NULL").groupBy("sheet", "row", "col").agg(F.max_by("value", "nth").alias("value"))
    rows = placed.groupBy("sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("filled"), F.max("col").alias("last"))
    span = rows.groupBy("sheet").agg(F.max("row").alias("high"), F.max("last").alias("wide"), F.count("row").alias("n"))
    span = span.withColumns({"gaps": (F.col("wide") <= most_columns) & (F.col("high") <= most_rows), "aligned": F.col("wide") <= most_columns})
    blanks = span.filter("gaps").select("sheet", F.explode(F.sequence(F.lit(1), F.col("high"))).alias("row")).join(rows.select("sheet", "row"), ["sheet", "row"], "left_anti").withColumn("filled", F.array().cast(rows.schema["filled"].dataType))
    j = rows.select("sheet", "row", "filled").unionByName(blanks).join(span, "sheet")
    at = F.map_from_entries("filled")
    wide = F.transform(F.sequence(F.lit(1), F.col("wide")), lambda i: F.coalesce(F.try_element_at(at, i), F.lit("")))
    values = F.when(F.col("aligned"), wide).otherwise(F.transform("filled", lambda x: x["value"]))
    nth = F.when(F.col("gaps"), F.col("row")).otherwise(F.row_number().over(Window.partitionBy("sheet").orderBy("row")))
    grid = j.select("sheet", nth.cast("long").alias("place"), values.alias("cells"))
    loose = c.filter("row IS NULL OR col IS NULL").join(span.select("sheet", F.when(F.col("gaps"), F.col("high")).otherwise(F.col("n")).alias("above")), "sheet", "left")
    after = F.coalesce("above", F.lit(0)) + F.row_number().over(Window.partitionBy("sheet").orderBy("nth"))
    return grid.unionByName(loose.select("sheet", after.cast("long").alias("place"), F.array("value").alias("cells")))
