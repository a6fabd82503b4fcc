"""Expected against extracted cells and items: matching, metrics, consistency, modes, extractors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvigil.functions.categories import REVIEW_CATEGORIES, llm_involved, norm_category, ocr_derived
from docvigil.functions.text import norm, same_text
from docvigil.functions.values import finite, needs_review
from docvigil.operators.fixpoint import dealt, written

CELL = ["case_id", "table_id", "cell_id"]


def ratio(part: Column, whole: Column) -> Column:
    """A share; 0 of nothing is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0)).cast("double")


def rules(*pairs: tuple[str, Column]) -> Column:
    """Names of the rules that fail, in order, each once; a rule that cannot be decided fails."""
    named = [F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in pairs]
    return F.array_distinct(F.filter(F.array(*named), lambda x: x.isNotNull()))


def match_cells(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Each expected cell with what became of it.

    ``text_match`` compares normalised texts (an absent text is blank, and blank equals blank),
    ``sourced`` says whether a source is expected at all, ``source_match`` compares whole sources, and
    ``false_auto`` marks cells that need review and were confirmed by machine.
    """
    act = actual.select(*CELL, F.col("text").alias("_text"), F.struct("source_page", "source_x").alias("_source"), F.col("auto_confirmed").alias("_auto"), F.lit(True).alias("_there"))
    joined = expected.drop("auto_confirmed").join(act, CELL, "left")
    there = F.coalesce("_there", F.lit(False))
    blank = F.lit("")
    text = there & (norm(F.coalesce("text", blank)) == norm(F.coalesce("_text", blank)))
    sourced = F.coalesce(F.col("source_page") > 0, F.lit(False))
    source = there & sourced & F.coalesce(F.struct("source_page", "source_x") == F.col("_source"), F.lit(False))
    wrong = there & F.coalesce("requires_review", F.lit(False)) & F.coalesce("_auto", F.lit(False))
    return joined.withColumns({"present": there, "text_match": text, "sourced": sourced, "source_match": source, "false_auto": wrong}).drop("_text", "_source", "_auto", "_there")


def eval_metrics(matched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Match rates of tables, cells and sources, and wrongly confirmed cells, for each group."""
    flags = ("text_match", "sourced", "source_match", "false_auto")
    tables = matched.groupBy(*by, "case_id", "table_id").agg(F.bool_or("present").alias("present"), F.count("cell_id").alias("n"), *[F.count_if(c).alias(c) for c in flags])
    return tables.groupBy(*by).agg(
        F.count("table_id").alias("expected_tables"), F.coalesce(F.sum("n"), F.lit(0)).alias("expected_cells"), ratio(F.count_if("present"), F.count("table_id")).alias("table_rate"),
        ratio(F.sum("text_match"), F.sum("n")).alias("cell_rate"), ratio(F.sum("source_match"), F.sum("sourced")).alias("source_rate"), F.coalesce(F.sum("false_auto"), F.lit(0)).alias("false_auto"))


def table_consistency(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Missing, extra and changed cells of each table; blank text never matches."""
    e = expected.select(*CELL, F.col("text").alias("e"), F.lit(True).alias("in_e"))
    a = actual.select(*CELL, F.col("text").alias("a"), F.lit(True).alias("in_a"))
    both = e.join(a, CELL, "full_outer")
    missing, extra = F.col("in_a").isNull(), F.col("in_e").isNull()
    changed = ~missing & ~extra & ~same_text(F.col("e"), F.col("a"))
    out = both.groupBy("case_id", "table_id").agg(F.count_if(missing).alias("missing"), F.count_if(extra).alias("extra"), F.count_if(changed).alias("changed"))
    return out.withColumn("consistent", F.col("missing") + F.col("extra") + F.col("changed") == 0)


RISK_LEVELS = ("low", "medium", "high", "critical")
SCOPE = ("fixture_id", "document_id", "block_id")


def validate_items(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """A decision for each expected item: (item_id, status, failed_rules, warnings, auto_confirm_allowed).

    Both sides have ``item_id, label_id``, the scope ids, ``value`` and ``number`` (a number is expected
    where the expected one is not null), ``page, x`` of the source, ``risk, requires_review, extractor,
    kind``; the actual side also ``confidence, auto_confirmed``. An expected scope id that is null is not
    declared. Whatever is absent or malformed fails.
    """
    cols = ("label_id", *SCOPE, "value", "number", "page", "x", "risk", "requires_review", "extractor", "kind")
    a = actual.select("item_id", *[F.col(c).alias(f"a_{c}") for c in (*cols, "confidence", "auto_confirmed")])
    j = expected.join(a, "item_id", "left")
    no = F.lit(False)
    same = lambda c: F.coalesce((F.col(c) == F.col(f"a_{c}")) & (F.trim(c) != ""), no)

    # each is a column of its own: the rules below use them several times
    sourced = F.coalesce((F.struct("page", "x") == F.struct("a_page", "a_x")) & (F.col("page") > 0), no)
    number = F.col("number").isNotNull()
    equal = F.coalesce(finite(F.col("number")) & finite(F.col("a_number")) & (F.col("number") == F.col("a_number")), no)
    high = F.coalesce(F.col("risk").isin("high", "critical"), no) | F.coalesce(F.col("a_risk").isin("high", "critical"), no)
    j = j.withColumns({
        "unsure": needs_review(F.col("a_confidence")), "sourced": sourced, "category": norm_category(F.col("label_id")), "high": high, "by_value": F.when(number, equal).otherwise(same_text(F.col("value"), F.col("a_value"))), "by_number": ~number | equal,
        "explicit": F.coalesce("requires_review", no) | F.coalesce("a_requires_review", no), "ocr": ocr_derived(F.col("kind"), F.col("extractor")) | ocr_derived(F.col("a_kind"), F.col("a_extractor")),
        "engine": F.col("extractor").isNotNull() & ~same("extractor"), "model": llm_involved(no, F.col("extractor")) | llm_involved(no, F.col("a_extractor")),
        "declared": reduce(lambda p, q: p | q, [F.col(c).isNotNull() & ~same(c) for c in SCOPE]), "unbound": reduce(lambda p, q: p | q, [~same(c) for c in SCOPE]),
    })
    j = j.withColumn("important", F.col("explicit") | F.col("high") | number | F.coalesce(F.col("category").isin(*REVIEW_CATEGORIES), no))
    j = j.withColumn("review", F.col("important") | F.col("unsure") | F.col("ocr") | F.col("engine") | ~F.col("sourced"))
    # a flag that is no flag counts as set, and fails
    gate = F.col("a_auto_confirmed").isNull() | (F.col("review") & F.coalesce("a_auto_confirmed", F.lit(True))) | F.col("requires_review").isNull()
    failed = rules(
        ("scope_binding", ~same("label_id") | F.col("declared") | (~F.col("important") & F.col("unbound"))), ("value_non_modification", ~F.col("by_value")), ("provenance", ~F.col("sourced")), ("numeric", ~F.col("by_number")),
        ("risk_gate", gate | ~F.coalesce(F.col("risk").isin(*RISK_LEVELS), no) | F.coalesce(~F.col("a_risk").isin(*RISK_LEVELS), no)))
    warnings = rules(
        ("item confidence requires human review", F.col("unsure")), ("ocr-derived item requires human review", F.col("ocr")), ("extraction engine mismatch requires human review", F.col("engine")), ("item source requires human review", ~F.col("sourced")),
        ("llm-involved important item requires human review", F.col("important") & F.col("model")), ("item requires human review", F.col("review")))
    out = j.select("item_id", failed.alias("failed_rules"), warnings.alias("warnings"), "review")
    status = F.when(F.size("failed_rules") > 0, "block_auto_confirm").when(F.col("review"), "requires_review").otherwise("pass")
    return out.select("item_id", status.alias("status"), "failed_rules", "warnings", (status == "pass").alias("auto_confirm_allowed"))


def inherit_conditions(tables: DataFrame, cells: DataFrame, keys: list[str], conditions: list[str]) -> DataFrame:
    """Cells with each condition from their table where they have none."""
    t = tables.select(*keys, *[F.col(c).alias(f"_{c}") for c in conditions])
    joined = cells.join(t, keys, "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in conditions else F.col(c) for c in cells.columns])


def mode_metrics(cells: DataFrame, reported: DataFrame) -> DataFrame:
    """Each mode's rates, its wrongly confirmed labels (reported or captured, each once), reviews."""
    rates = cells.groupBy("mode").agg(F.count("cell_id").alias("cells"), ratio(F.count_if("text_match"), F.count("cell_id")).alias("cell_rate"), ratio(F.count_if("source_match"), F.count("cell_id")).alias("source_rate"), F.count_if("requires_review").alias("reviews"))
    captured = cells.filter("false_auto").select("mode", "label")
    wrong = captured.unionByName(reported.select("mode", "label")).distinct().groupBy("mode").agg(F.count("label").alias("false_auto_labels"))
    return rates.join(wrong, "mode", "left").fillna(0, ["false_auto_labels"])


def mode_diff(keys: DataFrame, baseline: str) -> DataFrame:
    """Review keys that each mode adds to, and lacks of, the baseline mode: (mode, key) rows in."""
    keys = keys.distinct()
    base = keys.filter(F.col("mode") == baseline).select("key")
    modes = keys.filter(F.col("mode") != baseline)
    added = modes.join(base, "key", "left_anti").groupBy("mode").agg(F.count("key").alias("added"))
    shared = modes.join(base, "key", "left_semi").groupBy("mode").agg(F.count("key").alias("shared"))
    n = base.agg(F.count("key").alias("n"))
    out = modes.select("mode").distinct().join(added, "mode", "left").join(shared, "mode", "left").crossJoin(n).fillna(0)
    return out.select("mode", "added", (F.col("n") - F.col("shared")).alias("removed"))


def check_reported(reported: DataFrame, computed: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys with the metrics whose reported value is absent or not the computed one."""
    r = reported.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    bad = rules(*[(m, F.abs(F.col(m) - F.col(f"_{m}")) > tolerance) for m in metrics])
    return computed.join(r, keys, "left").select(*keys, bad.alias("differs")).filter(F.size("differs") > 0)


# ---------------------------------------------------------------- extractors


def table_shape(cells: DataFrame, by: list[str]) -> DataFrame:
    """Rows, widths, whether all rows are equally wide, and whether all cells have a box: cells of
    (by..., row, col, text, boxed)."""
    rows = cells.groupBy(*by, "row").agg(F.count("col").alias("width"), F.count_if(~F.col("boxed")).alias("unboxed"))
    return rows.groupBy(*by).agg(
        F.count("row").alias("n_rows"), F.min("width").alias("narrowest"), F.max("width").alias("widest"), (F.min("width") == F.max("width")).alias("rectangular"), (F.sum("unboxed") == 0).alias("complete_boxes"))


def candidate_tables(cells: DataFrame) -> DataFrame:
    """Each extractor's tables in order: place, page, row widths and a digest of the texts; written, since checks
    and comparisons read them several times. What is such a table already stays as it is."""
    if "widths" in cells.columns:
        return cells
    rows = cells.groupBy("doc", "extractor", "rank", "table_no", "row").agg(F.min("page").alias("page"), F.count("col").alias("width"), F.transform(F.array_sort(F.collect_list(F.struct("col", norm(F.col("text")).alias("t")))), lambda c: c["t"]).alias("texts"), F.bool_and("boxed").alias("boxed"))
    body = F.array_sort(F.collect_list(F.struct("row", "width", "texts")))
    t = rows.groupBy("doc", "extractor", "rank", "table_no").agg(F.min("page").alias("page"), F.bool_and("boxed").alias("boxed"), body.alias("body"))
    t = t.withColumn("place", F.row_number().over(Window.partitionBy("doc", "extractor").orderBy("table_no")))
    return written(t.select("doc", "extractor", "rank", "place", "page", "boxed", F.transform("body", lambda r: r["width"]).alias("widths"), F.sha2(F.to_json(F.transform("body", lambda r: r["texts"])), 256).alias("content")))


def compare_candidates(cells: DataFrame, extractors: DataFrame) -> DataFrame:
    """Pairs of extractors of a document that disagree: (doc, left, right, kind, tables).

    Kinds: another number of tables; and of tables at the same place another page, other row widths,
    or, where these agree, other texts. ``extractors(doc, extractor, rank, status)`` that are not ok
    have no say. ``cells`` may be their ``candidate_tables``.
    """
    ok = extractors.filter("status = 'ok'").select("doc", "extractor", "rank")
    t = candidate_tables(cells).join(ok.select("doc", "extractor"), ["doc", "extractor"], "left_semi")
    counts = ok.join(t.groupBy("doc", "extractor").agg(F.count("place").alias("n")), ["doc", "extractor"], "left").fillna(0, ["n"])
    side = lambda df, p: df.select("doc", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "doc"])
    pairs = side(counts, "l").join(side(counts, "r"), "doc").filter("l_rank < r_rank AND l_n <> r_n").select("doc", F.col("l_extractor").alias("left"), F.col("r_extractor").alias("right"), F.lit("candidate-table-count").alias("kind"))
    same = side(t, "l").join(side(t, "r"), "doc").filter("l_place = r_place AND l_rank < r_rank")
    shape = F.when(F.col("l_widths") != F.col("r_widths"), "candidate-shape").when(F.col("l_content") != F.col("r_content"), "candidate-text")
    kinds = F.filter(F.array(F.when(F.col("l_page") != F.col("r_page"), "candidate-page"), shape), lambda k: k.isNotNull())
    tables = same.select("doc", F.col("l_extractor").alias("left"), F.col("r_extractor").alias("right"), F.explode(kinds).alias("kind"))
    return pairs.unionByName(tables).groupBy("doc", "left", "right", "kind").agg(F.count(F.lit(1)).alias("tables"))


def check_candidates(cells: DataFrame, extractors: DataFrame, expected: tuple[int, int] | None = None, require_boxes: bool = True) -> DataFrame:
    """What is wrong with each extractor's own tables: (doc, extractor, kind, tables). Without a shape to
    expect, only absent tables and cells without boxes count. ``cells`` may be their ``candidate_tables``."""
    ok = extractors.filter("status = 'ok'").select("doc", "extractor")
    t = candidate_tables(cells).join(ok, ["doc", "extractor"], "left_semi")
    found = [ok.join(t.select("doc", "extractor").distinct(), ["doc", "extractor"], "left_anti").withColumn("kind", F.lit("missing-table"))]
    if expected is not None:
        first = t.filter("place = 1")
        found.append(first.filter(F.size("widths") != expected[0]).select("doc", "extractor", F.lit("row-count").alias("kind")))
        found.append(first.filter(F.exists("widths", lambda w: w != expected[1])).select("doc", "extractor", F.lit("column-count").alias("kind")))
    if require_boxes:
        found.append(t.filter(~F.col("boxed")).select("doc", "extractor", F.lit("cell-boundary").alias("kind")))
    return reduce(DataFrame.unionByName, found).groupBy("doc", "extractor", "kind").agg(F.count(F.lit(1)).alias("tables"))


def select_candidate(extractors: DataFrame, own: DataFrame, pairs: DataFrame, consensus: bool = True) -> DataFrame:
    """Each document's extractor by rank of those that are ok and that nothing blocks: their own
    mismatches, and disagreements too where no shape was expected."""
    blocked = own.select("doc", "extractor")
    if consensus:
        blocked = blocked.unionByName(pairs.select("doc", F.explode(F.array("left", "right")).alias("extractor")))
    free = extractors.filter("status = 'ok'").join(blocked.distinct(), ["doc", "extractor"], "left_anti")
    best = free.groupBy("doc").agg(F.min_by("extractor", "rank").alias("selected"))
    return extractors.select("doc").distinct().join(best, "doc", "left")


def table_warnings(extractors: DataFrame, own: DataFrame, pairs: DataFrame, selected: DataFrame) -> DataFrame:
    """Warnings of each document's table report, in order: nothing selected, extractors disagree, the
    selected one lacks cell boundaries, extractors that are not available."""
    apart = own.select("doc").unionByName(pairs.select("doc")).distinct().withColumn("apart", F.lit(True))
    open_cells = own.filter("kind = 'cell-boundary'").select("doc", F.col("extractor").alias("selected"), F.lit(True).alias("open"))
    away = extractors.filter("status <> 'ok'").groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("extractor")), ", ").alias("away"))
    j = selected.join(apart, "doc", "left").join(open_cells, ["doc", "selected"], "left").join(away, "doc", "left")
    w = F.concat_ws(
        "; ", F.when(F.col("selected").isNull(), "no table selected"), F.when(F.col("apart"), "candidates disagreed"), F.when(F.col("open"), "selected table has incomplete cell boundaries"),
        F.when(F.col("away").isNotNull(), F.concat(F.lit("candidate unavailable: "), "away")))
    return j.select("doc", w.alias("warnings")).filter("warnings <> ''")


def extractor_summary(fragments: DataFrame) -> DataFrame:
    """Fragments of each document and extractor, and whether it found any text."""
    out = fragments.groupBy("doc", "extractor").agg(F.count("text").alias("fragments"), F.count_if(norm(F.col("text")) != "").alias("with_text"))
    return out.withColumn("status", F.when(F.col("with_text") > 0, "ok").otherwise("no-text"))


def ocr_pages(regions: DataFrame, pages: DataFrame, low: float = 0.8) -> DataFrame:
    """Each page's status: no-text, low-confidence (any region below ``low`` or without one), ok."""
    r = regions.filter(norm(F.col("text")) != "").groupBy("doc", "page").agg(F.count("text").alias("regions"), F.count_if(F.col("confidence").isNull() | (F.col("confidence") < low)).alias("low_regions"))
    out = pages.join(r, ["doc", "page"], "left").fillna(0, ["regions", "low_regions"])
    return out.withColumn("status", F.when(F.col("regions") == 0, "no-text").when(F.col("low_regions") > 0, "low-confidence").otherwise("ok"))


def ocr_engines(page_status: DataFrame) -> DataFrame:
    """Regions of each document, and the engine's status: no-text if all pages are, low-confidence if any is."""
    out = page_status.groupBy("doc").agg(F.count("page").alias("pages"), F.sum("regions").alias("regions"), F.sum("low_regions").alias("low_regions"), F.bool_and(F.col("status") == "no-text").alias("bare"), F.bool_or(F.col("status") == "low-confidence").alias("low"))
    return out.withColumn("engine_status", F.when(F.col("bare"), "no-text").when(F.col("low"), "low-confidence").otherwise("ok")).drop("bare", "low")


# ---------------------------------------------------------------- sets


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both have the same distinct rows, and how many only one has."""
    cols = a.columns
    side = lambda df, n: df.select(*cols, F.lit(n == "a").alias("_a"), F.lit(n == "b").alias("_b"))
    both = dealt(side(a, "a").unionByName(side(b, "b")), *cols).groupBy(*cols).agg(F.bool_or("_a").alias("_a"), F.bool_or("_b").alias("_b"))
    return both.agg(F.count_if(~F.col("_b")).alias("only_left"), F.count_if(~F.col("_a")).alias("only_right")).withColumn("same", F.col("only_left") + F.col("only_right") == 0)


def union_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only ``a`` has as removed, that only ``b`` has as added."""
    b = b.select(*a.columns)
    return a.subtract(b).withColumn("change", F.lit("removed")).unionByName(b.subtract(a).withColumn("change", F.lit("added")))


def distinct_warnings(df: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """Each group's warnings in order, each where it first occurs."""
    listed = F.array_sort(F.collect_list(F.struct(*order, column)))
    return df.groupBy(*by).agg(F.array_distinct(F.transform(listed, lambda x: x[column])).alias(column))


def duplicates(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows whose key another has, with their place among them."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return df.withColumns({"n": n, "place": F.row_number().over(Window.partitionBy(*key).orderBy(*order))}).filter("n > 1")


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
