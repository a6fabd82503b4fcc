"""Templates: versions in force, anchors in blocks, scores, field values, mapping, rules."""

from __future__ import annotations

from functools import partial, reduce
from json import dumps
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvigil.functions.text import fold, norm, norm_col, split_table, value_after
from docvigil.functions.values import fields_agree, parse_bool, parse_date, parse_number
from docvigil.operators.cells import rules
from docvigil.operators.fixpoint import SHARE, dealt, forget, written

# ---------------------------------------------------------------- versions


def effective_version(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """The template version that a document asks for, or else the highest active one in force on its day.

    ``docs(doc, template_id, as_of)``, with ``asked`` (a version or null) where documents may name one;
    ``templates(template_id, version, active, valid_from, valid_until)``; version is a struct of integers, from
    is inclusive, until exclusive or null. An asked version is found as it is, active and in force or not.

    The days on which some version opens or shuts are numbered in each template. A version covers a range of
    these numbers, which falls into at most two aligned pieces of each power of two; each piece keeps the highest
    version, and a day asks the pieces that it lies in, one of each power. So versions never meet days one by one,
    and nothing grows faster than versions and days times the logarithm of the borders. Of versions with the same
    days only the highest is in question, found by their places in one order, since Spark aggregates numbers
    without sorting rows.
    """
    key = ["template_id"]
    t = templates.filter("active AND (valid_until IS NULL OR valid_from < valid_until)").select(*key, "version", "valid_from", "valid_until")
    t = written(_highest(t, [*key, "valid_from", "valid_until"]))
    days = docs.select(*key, F.col("as_of").alias("day")).filter("day IS NOT NULL").distinct()
    borders = t.select(*key, F.explode(F.array("valid_from", "valid_until")).alias("day")).filter("day IS NOT NULL").distinct()
    in_order = Window.partitionBy(*key).orderBy("day")
    ranked = borders.withColumn("rank", F.row_number().over(in_order).cast("long") - 1)
    powers = int(ranked.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0] + 1).bit_length()
    last = (1 << powers) - 1
    v = t.join(ranked.withColumnsRenamed({"day": "valid_from", "rank": "a"}), [*key, "valid_from"]).join(ranked.withColumnsRenamed({"day": "valid_until", "rank": "b"}), [*key, "valid_until"], "left")
    v = v.select(*key, "version", F.explode(_aligned(F.col("a"), F.coalesce("b", F.lit(last)), powers)).alias("piece"))
    highest = v.groupBy(*key, "piece").agg(F.max("version").alias("version"))
    at = F.last("rank", ignorenulls=True).over(in_order.rangeBetween(Window.unboundedPreceding, 0))
    asked = days.withColumn("rank", F.lit(None).cast("long")).unionByName(ranked).withColumn("rank", at).join(days, [*key, "day"], "left_semi").filter("rank IS NOT NULL").distinct()
    piece = F.explode(F.transform(F.sequence(F.lit(0), F.lit(powers - 1)), lambda p: F.struct(p.alias("power"), F.floor(F.col("rank") / F.pow(F.lit(2.0), p)).alias("nth"))))
    best = written(asked.select(*key, "day", piece.alias("piece")).join(highest, [*key, "piece"]).groupBy(*key, F.col("day").alias("as_of")).agg(F.max("version").alias("in_force")))
    free = docs if "asked" not in docs.columns else docs.filter("asked IS NULL")
    found = free.join(best, ["template_id", "as_of"], "left").select("doc", "template_id", F.col("in_force").alias("version"))
    if "asked" not in docs.columns:
        return found
    # documents that ask for nothing would all meet in one task
    asking = docs.filter("asked IS NOT NULL").select("doc", "template_id", "asked")
    exact = templates.select("template_id", F.col("version").alias("asked")).join(asking.select("template_id", "asked").distinct(), ["template_id", "asked"], "left_semi").distinct()
    exact = asking.join(exact.withColumn("there", F.lit(True)), ["template_id", "asked"], "left")
    return found.unionByName(exact.select("doc", "template_id", F.when(F.col("there"), F.col("asked")).alias("version")))


def _highest(versions: DataFrame, by: list[str]) -> DataFrame:
    """Each group's highest version. A version's numbers, counted from the least of their kind, make one long, as
    in a number of several digits, where their ranges allow that and none is null; else versions are compared."""
    parts = [f.name for f in versions.schema["version"].dataType]
    c = {p: F.col("version")[p].cast("decimal(38,0)") for p in parts}
    seen = versions.agg(*[F.min(c[p]).alias(f"low_{i}") for i, p in enumerate(parts)], *[F.max(c[p]).alias(f"high_{i}") for i, p in enumerate(parts)], *[F.count_if(c[p].isNull()).alias(f"none_{i}") for i, p in enumerate(parts)]).first()
    lows = [int(seen[f"low_{i}"] or 0) for i in range(len(parts))]
    sizes = [int(seen[f"high_{i}"] or 0) - low + 1 for i, low in enumerate(lows)]
    if any(seen[f"none_{i}"] for i in range(len(parts))) or prod(sizes) >= 2**63:
        return versions.groupBy(*by).agg(F.max("version").alias("version"))
    code = reduce(lambda n, i: n * sizes[i] + (F.col("version")[parts[i]].cast("long") - lows[i]), range(len(parts)), F.lit(0).cast("long"))
    top = versions.groupBy(*by).agg(F.max(code).alias("code"))
    below = [prod(sizes[i + 1 :]) for i in range(len(parts))]
    digit = lambda i: F.expr(f"code DIV {below[i]}L % {sizes[i]}L") + lows[i]
    return top.select(*by, F.struct(*[digit(i).alias(p) for i, p in enumerate(parts)]).cast(dict(versions.dtypes)["version"]).alias("version"))


def _aligned(a: Column, b: Column, powers: int) -> Column:
    """The pieces (power, nth) of aligned ranges of two to a power that make up the numbers from a to below b,
    which is below two to ``powers``."""
    start = F.struct(a.alias("a"), b.alias("b"), F.array().cast("array<struct<power:int,nth:bigint>>").alias("pieces"))

    def halve(acc: Column, p: Column) -> Column:
        open_ = acc["a"] < acc["b"]
        left, right = open_ & (acc["a"] % 2 == 1), open_ & (acc["b"] % 2 == 1)
        piece = lambda n: F.array(F.struct(p.alias("power"), n.alias("nth")))
        none = F.array().cast("array<struct<power:int,nth:bigint>>")
        a, b = F.when(left, acc["a"] + 1).otherwise(acc["a"]), F.when(right, acc["b"] - 1).otherwise(acc["b"])
        pieces = F.concat(acc["pieces"], F.when(left, piece(acc["a"])).otherwise(none), F.when(right & (acc["b"] - 1 >= a), piece(acc["b"] - 1)).otherwise(none))
        return F.struct(F.shiftright(a, 1).alias("a"), F.shiftright(b, 1).alias("b"), pieces.alias("pieces"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(powers - 1)), start, halve)["pieces"]


def template_snapshot(jobs: DataFrame, versions: DataFrame) -> DataFrame:
    """Each job's template version: the pinned one, else the latest."""
    latest = versions.groupBy("template_id").agg(F.max("version").alias("latest"))
    j = jobs.join(latest, "template_id", "left").withColumn("version", F.coalesce("pinned", "latest"))
    return j.join(versions.select("template_id", "version", "content"), ["template_id", "version"], "left").select("job_id", "template_id", "version", "content")


def latest_templates(versions: DataFrame) -> DataFrame:
    return versions.groupBy("template_id").agg(F.max("version").alias("version"), F.count("version").alias("versions"), F.max_by("content", "version").alias("content"))


# ---------------------------------------------------------------- anchors and scores


#: Characters of the piece by which texts that contain others are found.
PIECE = 4
#: So many texts to be contained are looked for one by one; more are found by their first piece.
FEW = 64
#: Texts of a template library that one pass holds as literals.
LIBRARY = 20_000
#: Characters of a text that are cut into pieces at once.
SEGMENT = 32_768


def _literal(values: object, kind: str) -> Column:
    """A constant that the optimizer folds, however many entries it has."""
    return F.from_json(F.lit(dumps(values)), kind)


def contained_texts(text: Column, wanted: list[str]) -> Column:
    """Those of ``wanted`` that ``text`` contains. Time grows with the text's length, not with its square: up
    to ``FEW`` are looked for one by one. Of more, a text is read in overlapping segments, each cut into all
    pieces of up to ``PIECE`` characters, and only names that begin with a piece of the segment are looked for."""
    if len(wanted) <= FEW:
        return F.filter(_literal(wanted, "array<string>"), lambda n: F.contains(text, n))
    overlap = max(map(len, wanted)) - 1
    segments = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{SEGMENT + overlap}}})).{{1,{SEGMENT}}}"), F.lit(1))
    begins: dict[int, dict[str, list[str]]] = {}
    for n in wanted:
        begins.setdefault(min(len(n), PIECE), {}).setdefault(n[:PIECE], []).append(n)

    def of_segment(segment: Column) -> Column:
        found = []
        for size, names in begins.items():
            pieces = F.regexp_extract_all(segment, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
            keys = F.array_intersect(pieces, _literal(list(names), "array<string>"))
            by_key = _literal(names, "map<string,array<string>>")
            found.append(F.flatten(F.transform(keys, partial(F.element_at, by_key))))
        return F.filter(F.concat(*found), lambda n: F.contains(segment, n))

    return F.array_distinct(F.flatten(F.transform(segments, of_segment)))


def match_anchors(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, template_id, anchor_id, block_id, page, y, x) of blocks that an anchor's page, type and text allow.

    ``exact`` texts are the same as written, ``contains`` and all others compare folded texts; blank is
    nothing. A table header is looked for in the cells of table blocks only. The library's distinct texts
    (``LIBRARY`` of them a pass) are looked for inside each row, so that no text is copied or shuffled: what
    leaves a row is which of them it has, and that meets the anchors on equal texts.
    """
    exact, inside = F.col("mode") == "exact", F.col("mode") == "contains"
    name = fold(F.col("text"))
    find = F.when(exact, F.concat(F.lit("="), "text")).otherwise(F.concat(F.when(inside, F.lit("<")).otherwise(F.lit("~")), name))
    a = anchors.filter(F.when(exact, F.col("text") != "").otherwise(name != "")).select(
        "template_id", "anchor_id", (F.col("kind") == "table_header").alias("in_cells"), F.col("page").alias("anchor_page"), "block_types", find.alias("find"))
    a = written(a)  # its size is known then: hits do not go out by the few texts that they have
    place = ["doc_id", "block_id", "page", "type", "y", "x"]
    cells = F.transform(F.flatten(split_table(F.col("text"))), lambda c: F.struct(F.lit(True).alias("of_cell"), c.alias("written")))
    texts = F.concat(
        F.array(F.struct(F.lit(False).alias("of_cell"), F.col("text").alias("written"))),
        F.when(F.col("type") == "table", cells).otherwise(F.array().cast("array<struct<of_cell:boolean,written:string>>")),
    )
    b = blocks.select(*place, F.explode(texts).alias("t")).select(*place, "t.*").withColumn("plain", fold(F.col("written")))
    library = [r["find"] for r in a.select("find").distinct().orderBy("find").toLocalIterator()]  # anchors of templates, not data

    def found(part: list[str]) -> DataFrame:
        whole = [f for f in part if f[0] != "<"]
        own = F.array(F.concat(F.lit("="), "written"), F.concat(F.lit("~"), "plain"))
        same = F.array_intersect(own, _literal(whole, "array<string>"))
        part_of = F.transform(contained_texts(F.col("plain"), [f[1:] for f in part if f[0] == "<"]), lambda n: F.concat(F.lit("<"), n))
        none = F.array().cast("array<string>")
        return b.select(*place, "of_cell", F.explode(F.concat(F.coalesce(same, none), F.coalesce(part_of, none))).alias("find"))

    hits = reduce(DataFrame.unionByName, [found(library[i : i + LIBRARY]) for i in range(0, max(1, len(library)), LIBRARY)])
    scope = (F.col("anchor_page").isNull() | (F.col("page") == F.col("anchor_page"))) & (F.col("block_types").isNull() | F.array_contains("block_types", F.col("type")))
    j = hits.join(a, "find").filter((F.col("of_cell") == F.col("in_cells")) & scope)
    return j.select("doc_id", "template_id", "anchor_id", "block_id", "page", "y", "x").distinct()


def anchor_roles(anchors: DataFrame, fields: DataFrame, tables: DataFrame) -> DataFrame:
    """(template_id, anchor_id, required, scope_page): required are anchors of tables and of required
    fields, optional those of other fields only; what nothing refers to goes by its kind."""
    key = ["template_id", "anchor_id"]
    need = fields.filter("required").select(*key).unionByName(tables.select(*key)).distinct().withColumn("need", F.lit(True))
    may = fields.filter("NOT required").select(*key).distinct().withColumn("may", F.lit(True))
    j = anchors.select(*key, "kind", F.col("page").alias("scope_page")).join(need, key, "left").join(may, key, "left")
    by_kind = F.col("kind").isin("heading", "table_header")
    return j.select(*key, F.coalesce("need", ~F.col("may"), by_kind).alias("required"), "scope_page")


def score_templates(docs: DataFrame, roles: DataFrame, matches: DataFrame, pages: DataFrame, tables: DataFrame, every: bool = True) -> DataFrame:
    """One row a document and template: 0.6 x anchors + 0.2 x pages + 0.2 x tables, and the class.

    Anchors: the share found of those that are required or found. Pages: the share of the required
    anchors' pages that the document has (``pages(doc_id, page)``). Tables: the mean column share
    (``tables(doc_id, template_id, table_id, share)``, null where the table was not found); without
    tables, 1. A document without pages, a missing required anchor or page caps the score at 0.79, an
    incomplete table at 0.94; known from 0.95, candidate from 0.80.

    With ``every``, documents times templates is the size of the result. Without, only pairs with a found
    anchor or table have a row; all others are unknown, and the work grows with what was found.
    """
    key = ["doc_id", "template_id"]
    per = roles.groupBy("template_id").agg(F.count_if("required").alias("needed"), F.collect_set(F.when(F.col("required"), F.col("scope_page"))).alias("scoped"))
    found = matches.select(*key, "anchor_id").distinct().join(roles, ["template_id", "anchor_id"])
    found = found.groupBy(*key).agg(F.count("anchor_id").alias("matched"), F.count_if("required").alias("met"))
    t = tables.groupBy(*key).agg(F.avg(F.coalesce("share", F.lit(0.0))).alias("columns"), F.bool_or(F.coalesce(F.col("share") < 1, F.lit(False))).alias("partial"), F.bool_or(F.col("share").isNotNull()).alias("any_table"))
    if every:  # anchors meet the pairs as counts
        pairs = docs.select("doc_id").join(per, F.lit(True))
    else:
        pairs = found.select(*key).unionByName(t.filter("any_table").select(*key)).distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_semi").join(per, "template_id")
    s = pairs.join(found, key, "left").fillna(0, ["matched", "met"])
    s = s.withColumns({"anchors": F.coalesce(F.try_divide(F.col("matched"), F.col("needed") + F.col("matched") - F.col("met")), F.lit(0.0)), "lacks": F.col("met") < F.col("needed")})
    seen = pages.groupBy("doc_id").agg(F.collect_set("page").alias("seen"))
    s = s.join(seen, "doc_id", "left").join(t, key, "left")
    have = F.size(F.array_intersect("scoped", F.coalesce("seen", F.array().cast("array<int>"))))
    page_share = F.when(F.size("scoped") == 0, 1.0).otherwise(have / F.size("scoped"))
    closed = F.col("lacks") | F.col("seen").isNull() | (page_share < 1)
    raw = 0.6 * F.col("anchors") + 0.2 * page_share + 0.2 * F.coalesce("columns", F.lit(1.0))
    score = F.round(F.when(closed, F.least(raw, F.lit(0.79))).when(F.coalesce("partial", F.lit(False)), F.least(raw, F.lit(0.94))).otherwise(raw), 6)
    kind = F.when(score >= 0.95, "known").when(score >= 0.80, "candidate").otherwise("unknown")
    return s.select(*key, score.alias("score"), kind.alias("class"), "matched")


def header_spans(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Where runs of neighbouring filled cells of a row spell one of ``names(name, ...)`` together: their columns
    and (doc_id, table_no, row, first_col, last_col). Headers may be merged over several cells.

    A run has no more cells than its name has words, so a cell meets as many that follow it at most, and only
    cells that begin a name make runs. These meet the names, which go by templates, where they are made.
    """
    longest = names.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    w = Window.partitionBy("doc_id", "table_no", "row").orderBy("col", "text")
    ahead = [F.struct("col", "text") if k == 0 else F.lead(F.struct("col", "text"), k).over(w) for k in range(longest)]
    words = F.split("name", " ")
    begins = written(names.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))).alias("begin")).distinct())
    r = filled_cells(rows).select("doc_id", "table_no", "row", "col", norm_col(F.col("text")).alias("begin"), F.array(*ahead).alias("run"))
    r = r.join(begins, "begin", "left_semi")

    def span(x: Column, k: Column) -> Column:
        text = F.array_join(F.transform(F.slice("run", F.lit(1), k + 1), lambda c: c["text"]), " ")
        return F.when(x.isNotNull(), F.struct(norm_col(text).alias("name"), F.col("col").alias("first_col"), x["col"].alias("last_col")))

    spans = r.select("doc_id", "table_no", "row", F.explode(F.transform("run", span)).alias("s")).select("doc_id", "table_no", "row", "s.*")
    return spans.join(names, "name")


def filled_cells(rows: DataFrame) -> DataFrame:
    """Cells that are not blank, dealt out by table."""
    return dealt(rows.filter(norm(F.col("text")) != "").select("doc_id", "table_no", "row", "col", "text"), "doc_id", "table_no", rows=rows.count())


def column_score(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """The share of a template table's required columns on the best row of each found table.

    ``rows(doc_id, table_no, row, col, text)`` are cells, ``tables(template_id, columns)``.
    """
    need = written(tables.select("template_id", F.size("columns").alias("n"), F.explode("columns").alias("column")).select("template_id", "n", norm_col(F.col("column")).alias("name")))
    hits = header_spans(rows, need).groupBy("doc_id", "table_no", "row", "template_id", "n").agg(F.count_distinct("name").alias("found"))
    return hits.groupBy("doc_id", "table_no", "template_id").agg(F.max(F.col("found") / F.col("n")).alias("share"), F.max_by("row", F.struct("found", -F.col("row"))).alias("header_row"))


def table_lookup(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """The first filled value under a field's label: header span by name, then its columns downwards."""
    key = ["doc_id", "table_no", "template_id", "field_id"]
    f = written(fields.select("template_id", "field_id", norm_col(F.col("label")).alias("name")))
    heads = header_spans(rows, f).groupBy(*key).agg(F.min(F.struct("row", "first_col", "last_col")).alias("head"))
    heads = heads.select(*key, F.col("head.row").alias("head_row"), "head.first_col", "head.last_col")
    j = heads.join(filled_cells(rows), ["doc_id", "table_no"]).filter((F.col("row") > F.col("head_row")) & F.col("col").between(F.col("first_col"), F.col("last_col")))
    return j.groupBy(*key).agg(F.min_by("text", F.struct("row", "col")).alias("value"))


def label_values(blocks: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, block_id, template_id, field_id, value) of fields whose label and value share a block; a
    value ends where another label of the template begins."""
    others = F.collect_set("label").over(Window.partitionBy("template_id"))
    f = fields.select("template_id", "field_id", "label").withColumn("stops", F.array_except(others, F.array("label")))
    # a label ends right before a colon: both sides meet on its last letters there
    tail = F.regexp_extract(F.lower(F.trim("label")), "[^:：]*$", 0)
    f = f.withColumn("key", F.right(tail, F.least(F.length(tail), F.lit(PIECE))))
    sizes = [r[0] for r in f.select(F.length("key")).distinct().collect()]  # PIECE + 1 numbers at most
    parts = F.split(F.lower("text"), "[:：]", -1)
    ends = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.regexp_replace(p, r"\s+$", ""))

    def last(n: int) -> Column:
        return F.transform(F.filter(ends, lambda p: F.length(p) >= n), lambda p: F.right(p, F.lit(n)))

    keys = F.array_distinct(F.concat(F.array().cast("array<string>"), *[last(n) for n in sizes]))
    # keys travel without their text; a block's text then meets all labels that it may have at once
    ask = blocks.select("doc_id", "block_id", F.explode(keys).alias("key")).join(f, "key").groupBy("doc_id", "block_id").agg(F.collect_set(F.struct("template_id", "field_id", "label", "stops")).alias("asked"))
    value = F.transform("asked", lambda x: F.struct(x["template_id"].alias("template_id"), x["field_id"].alias("field_id"), value_after(F.col("text"), x["label"], x["stops"]).alias("value")))
    j = blocks.select("doc_id", "block_id", "text").join(ask, ["doc_id", "block_id"]).select("doc_id", "block_id", F.inline(value))
    return j.filter("value IS NOT NULL")


RULE_CONFIDENCE = {"same_block": 0.98, "below": 0.95, "right": 0.94, "table_cell": 0.90}


def best_value(candidates: DataFrame) -> DataFrame:
    """Each field's candidate from its strongest rule, the first in reading order, with the rule's confidence."""
    c = F.create_map(*[F.lit(x) for kv in RULE_CONFIDENCE.items() for x in kv])
    strength = F.element_at(c, F.col("rule"))
    w = Window.partitionBy("doc_id", "field_id").orderBy(F.desc(strength), "page", "y", "x", "block_id")
    return candidates.withColumn("confidence", strength).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


# ---------------------------------------------------------------- rules and mapping


def check_rules(values: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Values that break a rule: required, type, range, allowed values, cross_field. Keys (doc_id, field_id).

    ``values(doc_id, field_id, value)``; ``rule_table(field_id, rule_id, rule_type, expected_type, minimum,
    maximum, allowed, related, operator)``. A cross-field rule holds a value against the document's related
    field, compared as ``expected_type``; without that field it is broken.
    """
    other = values.select("doc_id", F.col("field_id").alias("related"), F.col("value").alias("_other"))
    j = values.join(rule_table, "field_id").join(other, ["doc_id", "related"], "left")
    text, number = F.col("value"), parse_number(F.col("value"))
    blank = F.coalesce(norm(text), F.lit("")) == ""
    typed = F.when(F.col("expected_type") == "number", number.isNotNull()).when(F.col("expected_type") == "date", parse_date(text).isNotNull()).when(F.col("expected_type") == "boolean", parse_bool(text).isNotNull()).otherwise(True)
    broken = (
        F.when(F.col("rule_type") == "required", blank)
        .when(F.col("rule_type") == "type", ~blank & ~typed)
        .when(F.col("rule_type") == "range", ~blank & F.coalesce((number < F.col("minimum")) | (number > F.col("maximum")) | number.isNull(), F.lit(True)))
        .when(F.col("rule_type") == "allowed", ~blank & ~F.coalesce(F.array_contains("allowed", norm(text)), F.lit(False)))
        .when(F.col("rule_type") == "cross_field", ~fields_agree(F.col("operator"), text, F.col("_other"), F.coalesce("expected_type", F.lit(""))))
    )
    return j.filter(F.coalesce(broken, F.lit(True))).select("doc_id", "field_id", "rule_id", "rule_type")


def risk_policy(fields: DataFrame, levels: DataFrame) -> DataFrame:
    """Each field's risk: where a template declares levels, missing and undeclared ones fail closed and
    declared ones say whether to review; high and critical always mean review."""
    plain = lambda c: F.lower(F.trim(c))
    l = levels.select("template_id", plain("level").alias("_level"), "review")
    f = fields.withColumn("_level", plain("risk_level"))
    j = f.join(l, ["template_id", "_level"], "left").join(levels.select("template_id").distinct().withColumn("declared", F.lit(True)), "template_id", "left")
    always = F.coalesce(F.col("_level").isin("high", "critical"), F.lit(False))
    open_ = F.when(always, "review").otherwise("free")
    closed = F.when(F.coalesce("_level", F.lit("")) == "", "missing").when(F.col("review").isNull(), "undeclared").when(always | F.col("review"), "review").otherwise("free")
    state = F.when(F.col("declared"), closed).otherwise(open_)
    return j.select("template_id", "field_id", state.alias("policy"), (state != "free").alias("requires_review"))


def key_conflicts(keys: DataFrame) -> DataFrame:
    """Conflicts of output keys of a template: (template_id, a, b, a_key, b_key).

    Of fields with one key the least stands for all: each other one is paired with it, and only
    these representatives are paired where one key is a dotted prefix of the other. A key is joined
    with its own prefixes, of which it has as many as dots, not with all others.
    """
    k = keys.groupBy("template_id", "output_key").agg(F.min("field_id").alias("first"))
    equal = keys.join(k, ["template_id", "output_key"]).filter(F.col("field_id") != F.col("first")).select("template_id", F.col("first").alias("a"), F.col("field_id").alias("b"), F.col("output_key").alias("a_key"), F.col("output_key").alias("b_key"))
    parts = F.split("output_key", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    long = k.filter(F.size(parts) > 1).select("template_id", F.col("first").alias("b"), F.col("output_key").alias("b_key"), F.explode(prefixes).alias("a_key"))
    short = k.select("template_id", F.col("first").alias("a"), F.col("output_key").alias("a_key"))
    return short.join(long, ["template_id", "a_key"]).select("template_id", "a", "b", "a_key", "b_key").unionByName(equal)


def key_classes(keys: DataFrame) -> DataFrame:
    """Each key of a template with the other fields it conflicts with, by class: ``equal`` keys, its
    dotted prefixes (``shorter``), keys it is a prefix of (``longer``). One row a key, no pairs."""
    k = keys.groupBy("template_id", "output_key").agg(F.count("field_id").alias("n")).withColumn("parts", F.split("output_key", r"\."))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), "."))
    long = k.select("template_id", F.col("output_key").alias("long"), F.col("n").alias("n_long"), F.explode(prefixes).alias("short"))
    short = k.select("template_id", F.col("output_key").alias("short"), F.col("n").alias("n_short"))
    j = short.join(long, ["template_id", "short"])
    own = F.col("short") == F.col("long")
    up = j.select("template_id", F.col("short").alias("output_key"), F.when(own, F.col("n_short") - 1).otherwise(0).alias("equal"), F.lit(0).alias("shorter"), F.when(own, 0).otherwise(F.col("n_long")).alias("longer"))
    down = j.filter(~own).select("template_id", F.col("long").alias("output_key"), F.lit(0).alias("equal"), F.col("n_short").alias("shorter"), F.lit(0).alias("longer"))
    return up.unionByName(down).groupBy("template_id", "output_key").agg(*[F.sum(c).alias(c) for c in ("equal", "shorter", "longer")]).filter("equal + shorter + longer > 0")


def dependents(pairs: DataFrame) -> DataFrame:
    """(field_id, dependent): which fields' rules need each field, over any number of steps, by doubling.
    Its size goes by templates, not by documents."""
    reach = written(pairs.select(F.col("related").alias("field_id"), F.col("field_id").alias("dependent")).distinct())
    n = reach.count()
    while True:
        far = reach.alias("a").join(reach.alias("b"), F.col("a.dependent") == F.col("b.field_id")).select("a.field_id", "b.dependent")
        before, reach = reach, written(reach.unionByName(far).distinct())
        forget(before)
        n, last = reach.count(), n
        if n == last:
            return reach


def cross_field(values: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Values that stay reviewed when every field whose rule fails has gone, and with it all that need it.

    ``values(doc_id, field_id, value, value_type)`` are the fields reviewed so far, ``rule_table(field_id,
    related, operator)`` their cross-field rules (``fields_agree``). A rule fails too where its related field
    is not among them; without ``operator`` it asks for nothing else. Values do not change, so after the first
    test a rule can only fail because its related field went: what depends on a field is known by template, and a
    document's fields decide in one row. They are dealt out once. Cycles are harmless.
    """
    plain = "operator" not in rule_table.columns
    of = rule_table.select("field_id", F.struct("related", *([] if plain else ["operator"])).alias("rule")).filter("field_id IS NOT NULL")
    by_field = of.groupBy("field_id").agg(F.collect_set("rule").alias("_rules"))
    falls = dependents(rule_table).groupBy("field_id").agg(F.collect_set("dependent").alias("_falls"))
    known = written(by_field.join(falls, "field_id", "full_outer"))
    own = F.struct(*values.columns).alias("v")
    v = dealt(values, "doc_id").join(known, "field_id", "left").select("doc_id", F.struct(own, "_rules", "_falls").alias("f"))
    docs = v.groupBy("doc_id").agg(F.collect_list("f").alias("f"))

    def fails(x: Column) -> Column:
        def broken(rule: Column) -> Column:
            other = F.filter("f", lambda y: y["v"]["field_id"] == rule["related"])
            if plain:
                return F.size(other) == 0
            return (F.size(other) == 0) | F.exists(other, lambda y: ~fields_agree(rule["operator"], x["v"]["value"], y["v"]["value"], x["v"]["value_type"]))

        return F.exists(F.coalesce(x["_rules"], F.array().cast(dict(known.dtypes)["_rules"])), broken)

    names = dict(known.dtypes)["_falls"]
    gone = F.flatten(F.transform(F.filter("f", fails), lambda x: F.concat(F.array(x["v"]["field_id"]), F.coalesce(x["_falls"], F.array().cast(names)))))
    stays = lambda x: ~F.coalesce(F.array_contains("gone", x["v"]["field_id"]), F.lit(False))
    docs = docs.withColumn("gone", F.when(F.col("doc_id").isNotNull(), gone))
    return docs.select(F.explode(F.filter("f", stays)).alias("f")).select("f.v.*")


def _quoted(c: Column) -> Column:
    """A text as a JSON string."""
    one = F.to_json(F.array(c))
    return F.substr(one, F.lit(2), F.length(one) - 2)


def nested_json(entries: Column) -> Column:
    """One JSON object of an array of (path, value), of which no path begins another. Sorted by path, an entry
    closes what it does not share with the one before and opens what is its own, so one pass writes all."""
    e = F.array_sort(entries)

    def shared(a: Column, b: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda k: F.slice(a, F.lit(1), k) == F.slice(b, F.lit(1), k)))

    def piece(x: Column, i: Column) -> Column:
        before = F.get(e, i - 1)["path"]
        common = F.when(i == 0, 0).otherwise(shared(before, x["path"]))
        closed = F.when(i == 0, "").otherwise(F.concat(F.repeat(F.lit("}"), F.size(before) - 1 - common), F.lit(",")))
        opened = F.transform(F.slice(x["path"], common + 1, F.size(x["path"]) - 1 - common), lambda k: F.concat(_quoted(k), F.lit(":{")))
        return F.concat(closed, F.array_join(opened, ""), _quoted(F.element_at(x["path"], -1)), F.lit(":"), _quoted(x["value"]))

    end = F.repeat(F.lit("}"), F.size(F.element_at(e, -1)["path"]) - 1)
    return F.when(F.size(e) == 0, "{}").otherwise(F.concat(F.lit("{"), F.array_join(F.transform(e, piece), ""), end, F.lit("}")))


def map_fields(fields: DataFrame) -> DataFrame:
    """A document's confirmed values (no warning) as nested JSON by dotted output key, its review fields and warnings.

    ``fields(doc_id, field_id, position, output_key, value, warning)``. Values are set in the order of ``position``:
    a later one replaces what stood at its key, below it, or at a beginning of it. Empty parts of a key count
    for nothing, a key without any sets nothing. Documents are dealt out once; all steps stay in that, each with
    a sort of its own, so shares are small.
    """
    ok = F.col("warning").isNull()
    f = dealt(fields, "doc_id", share=SHARE // 4)
    e = f.filter(ok).select("doc_id", "position", F.filter(F.split("output_key", r"\."), lambda p: p != "").alias("path"), "value").filter("size(path) > 0")
    e = e.withColumn("at", F.struct("position", F.array_join("path", "."), "value"))  # tells rows of one position apart
    r = e.select("*", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("k")).withColumn("prefix", F.slice("path", F.lit(1), F.col("k")))
    w = Window.partitionBy("doc_id", "prefix")
    leaf = F.col("k") == F.size("path")
    last_below, last_at = F.max("at").over(w), F.max(F.when(leaf, F.col("at"))).over(w)
    r = r.withColumn("stays", F.when(leaf, last_below == F.col("at")).otherwise(F.coalesce(last_at < F.col("at"), F.lit(True))))
    kept = r.groupBy("doc_id", "at").agg(F.bool_and("stays").alias("stays"), F.max(F.when(leaf, F.col("path"))).alias("path")).filter("stays")
    nested = kept.groupBy("doc_id").agg(nested_json(F.collect_list(F.struct("path", F.col("at.value").alias("value")))).alias("output"))
    review = F.array_join(F.array_sort(F.collect_set(F.when(~ok, F.concat_ws(": ", "field_id", "warning")))), "; ")
    base = f.groupBy("doc_id").agg(F.count_if(ok).alias("confirmed"), review.alias("review"))
    return base.join(nested, "doc_id", "left").select("doc_id", F.coalesce("output", F.lit("{}")).alias("output"), "confirmed", "review")


def check_templates(templates: DataFrame, fields: DataFrame, levels: DataFrame, mapping: DataFrame, anchors: DataFrame | None = None, tables: DataFrame | None = None, rule_table: DataFrame | None = None) -> DataFrame:
    """(template_id, problem, n): what makes a template's definition inconsistent.

    Always: repeated field ids, undeclared risk levels, unmapped fields, mappings to nothing. With
    ``anchors(template_id, anchor_id, kind, block_types)``, sources of fields and of ``tables(template_id,
    table_id, anchor_id, output_key)`` are checked as well; fields then have ``anchor_id``, ``direction``,
    ``output_key``. With ``rule_table(template_id, rule_id, target, rule_type, expected_type, minimum,
    maximum, allowed, related, operator)``, targets and operands are; fields then have ``value_type``,
    ``required`` and ``rule_ids``.
    """
    key = ["template_id", "field_id"]

    def problem(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("template_id", F.lit(name).alias("problem"))

    found = [
        problem(fields.groupBy(*key).count().filter("count > 1"), "repeated field"),
        problem(fields.join(levels, [fields["template_id"] == levels["template_id"], fields["risk_level"] == levels["level"]], "left_anti"), "undeclared risk level"),
        problem(fields.join(mapping, key, "left_anti"), "unmapped field"), problem(mapping.join(fields, key, "left_anti"), "mapping to nothing"),
    ]
    if anchors is not None:
        a = anchors.select("template_id", "anchor_id", ((F.col("kind") == "table_header") & F.coalesce(F.array_contains("block_types", "table"), F.lit(False))).alias("of_table"))
        found.append(problem(anchors.groupBy("template_id", "anchor_id").count().filter("count > 1"), "repeated anchor"))
        uses = fields.select("template_id", "anchor_id", (F.col("direction") == "table_cell").alias("needs_table"), "output_key")
        if tables is not None:
            found.append(problem(tables.groupBy("template_id", "table_id").count().filter("count > 1"), "repeated table"))
            uses = uses.unionByName(tables.select("template_id", "anchor_id", F.lit(True).alias("needs_table"), "output_key"))
        j = uses.join(a.groupBy("template_id", "anchor_id").agg(F.bool_or("of_table").alias("of_table")), ["template_id", "anchor_id"], "left")
        found += [problem(j.filter("of_table IS NULL"), "undeclared anchor"), problem(j.filter("needs_table AND NOT of_table"), "anchor of no table")]
        found.append(problem(uses.groupBy("template_id", "output_key").count().filter("count > 1"), "repeated output key"))
    if rule_table is not None:
        found.append(problem(rule_table.groupBy("template_id", "rule_id").count().filter("count > 1"), "repeated rule"))
        named = fields.select(*key, F.explode("rule_ids").alias("rule_id"))
        found.append(problem(named.join(rule_table, ["template_id", "rule_id"], "left_anti"), "undeclared rule"))
        of = rule_table.select("template_id", "rule_id", F.col("target").alias("field_id"))
        found.append(problem(named.join(of, ["template_id", "rule_id"]).filter(named["field_id"] != of["field_id"]), "rule of another field"))
        found.append(problem(of.join(fields.select(*key), key, "left_semi").join(named, [*key, "rule_id"], "left_anti"), "rule that its field does not name"))
        f = fields.groupBy(*key).agg(F.first("value_type").alias("value_type"), F.bool_or("required").alias("is_required"))
        r = rule_table.join(f.withColumnRenamed("field_id", "target"), ["template_id", "target"], "left")
        r = r.join(f.select("template_id", F.col("field_id").alias("related"), F.col("value_type").alias("related_type")), ["template_id", "related"], "left")
        kind, no = F.col("rule_type"), F.lit(False)
        dates, numbers = ("before", "before_or_equal", "after", "after_or_equal"), ("less_than", "less_than_or_equal", "greater_than", "greater_than_or_equal")
        number = lambda v: v.try_cast("double").isNotNull()
        fits = F.forall("allowed", lambda v: F.when(F.col("value_type") == "number", number(v)).when(F.col("value_type") == "boolean", v.isin("true", "false")).otherwise(v.isNotNull()))
        pair = F.when(F.col("operator").isin(*dates), (F.col("value_type") == "date") & (F.col("related_type") == "date")).when(F.col("operator").isin(*numbers), (F.col("value_type") == "number") & (F.col("related_type") == "number")).otherwise(F.col("value_type") == F.col("related_type"))
        bad = [
            ("rule of no field", F.col("value_type").isNull()), ("required rule of an optional field", (kind == "required") & ~F.col("is_required")),
            ("rule of another type", (kind == "type") & ~F.coalesce(F.col("expected_type") == F.col("value_type"), no)),
            ("range of no numbers", (kind == "range") & (F.col("value_type") != "number")), ("range without limits", (kind == "range") & F.col("minimum").isNull() & F.col("maximum").isNull()),
            ("empty range", (kind == "range") & F.coalesce(F.col("minimum") > F.col("maximum"), no)), ("values of another type", (kind == "allowed") & ~F.coalesce(fits, no)),
            ("related to no other field", (kind == "cross_field") & (F.col("related_type").isNull() | (F.col("related") == F.col("target")))), ("no operator", (kind == "cross_field") & F.col("operator").isNull()),
            ("operator of other types", (kind == "cross_field") & F.col("related_type").isNotNull() & ~F.coalesce(pair, no)),
            ("unknown rule type", ~kind.isin("required", "type", "range", "allowed", "cross_field")),
        ]
        found.append(r.select("template_id", F.explode(rules(*[(n, F.coalesce(c, no)) for n, c in bad])).alias("problem")))
    every = reduce(DataFrame.unionByName, found).groupBy("template_id", "problem").agg(F.count(F.lit(1)).alias("n"))
    return templates.select("template_id").distinct().join(every, "template_id")


def check_schema(df: DataFrame, key: str, json: str, rule_table: list[tuple[str, str, object]]) -> DataFrame:
    """Rows whose JSON object breaks a rule (field, kind, operand): required, const, enum, pattern, type,
    minimum, above (exclusive), maximum, min_items, and keys that no rule names. A text that is no object
    breaks every rule of what must be there; a rule of another kind is an error."""
    value = lambda f: F.get_json_object(json, f"$.{f}")
    named = sorted({f for f, _, _ in rule_table})
    bad: list[tuple[str, Column]] = []
    for f, kind, x in rule_table:
        v = value(f)
        if kind == "required":
            bad.append((f"{f} is required", v.isNull()))
        elif kind == "enum":
            bad.append((f"{f} is not allowed", v.isNotNull() & ~v.isin(*x)))
        elif kind == "const":
            bad.append((f"{f} is another constant", v.isNotNull() & (v != F.lit(x if isinstance(x, str) else dumps(x)))))
        elif kind == "type":
            of = F.lower(F.expr(f"schema_of_variant(variant_get(try_parse_json({json}), '$.{f}'))"))
            names = {"string": "string", "number": "bigint|double|decimal.*|float", "integer": "bigint", "boolean": "boolean", "array": "array.*", "object": "object.*", "null": "void"}
            bad.append((f"{f} has another type", F.coalesce(~of.rlike(f"^({names[x]})$"), F.lit(False))))
        elif kind == "maximum":
            bad.append((f"{f} is too large", v.isNotNull() & F.coalesce(v.try_cast("double") > x, F.lit(True))))
        elif kind == "above":
            bad.append((f"{f} is not above its limit", v.isNotNull() & F.coalesce(v.try_cast("double") <= x, F.lit(True))))
        elif kind == "pattern":
            bad.append((f"{f} has another form", v.isNotNull() & ~v.rlike(x)))
        elif kind == "minimum":
            bad.append((f"{f} is too small", v.isNotNull() & F.coalesce(v.try_cast("double") < x, F.lit(True))))
        elif kind == "min_items":
            bad.append((f"{f} has too few items", v.isNotNull() & F.coalesce(F.json_array_length(v) < x, F.lit(True))))
        else:
            raise ValueError(f"unknown kind of rule: {kind}")
    extra = F.size(F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in named]))) > 0
    bad.append(("unknown key", extra))
    return df.select(key, F.concat_ws("; ", rules(*bad)).alias("violations")).filter("violations <> ''")
