"""Document assembly: fragments to lines to blocks, checks of blocks and pages, review queues.

Lines and blocks are (doc_id, page, x, y, w, h, text, ...); every step groups or orders inside one
document or page, so one exchange by doc_id serves them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvigil.functions import geometry as G
from docvigil.functions.text import norm
from docvigil.functions.values import confidence, needs_review
from docvigil.operators.cells import rules

PAGE = ["doc_id", "page"]


def reading_order(blocks: DataFrame) -> DataFrame:
    """Place of each block in its document: by page, y, x and id."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y", "x", "block_id")))


def native_lines(fragments: DataFrame) -> DataFrame:
    """Fragments with their line's number, on pages where every fragment names its source line."""
    page = Window.partitionBy(*PAGE)
    named = fragments.withColumn("_all", F.bool_and(F.col("source_line").isNotNull()).over(page)).filter("_all").drop("_all")
    return named.withColumns({
        "line": F.dense_rank().over(page.orderBy("source_line")),
        "place": F.row_number().over(Window.partitionBy(*PAGE, "source_line").orderBy("x", "fragment_id")),
    })


def _page_by_page(rows: DataFrame, order: list[Column], handle: Callable[[list[list]], Iterator[tuple]], schema: str) -> DataFrame:
    """``handle(columns)`` on each page's rows in ``order``; ``rows`` begin with doc_id and page, as the result does.

    Pages are dealt out, sorted by Spark and read one after another from whole batches, so a page costs what its
    rows cost; a task holds a batch and one page.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        rest: list[list] = [[] for _ in rows_names]

        def done(groups: list[list[list]]) -> pa.RecordBatch:
            found = [(g[0][0], g[1][0], *r) for g in groups for r in handle(g)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            types = types or [batch.schema.field(0).type, batch.schema.field(1).type] + [pa.int64()] * (len(names) - 2)
            columns = [r + c.to_pylist() for r, c in zip(rest, batch.columns)]
            keys = list(zip(columns[0], columns[1]))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]]
            rest = [c[cuts[-1] :] for c in columns]
            yield done([[c[i:j] for c in columns] for i, j in zip(cuts, cuts[1:])])
        if types:
            yield done([rest])

    rows_names = rows.columns
    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE, *order).mapInArrow(run, schema)


def visual_lines(fragments: DataFrame) -> DataFrame:
    """(doc_id, page, fragment_id, line): fragments gathered into visual lines.

    In order of y and x, a fragment joins the latest line that it fits: its centre within a quarter of
    the height of the line's leftmost fragment and two heights of a neighbour at most, or else a quarter
    of the lower height in common with the line and a neighbour in line. Each decision depends on those
    before it, so a page is handled as a whole.
    """

    def page(columns: list[list]) -> Iterator[tuple]:
        lines: list[dict] = []
        for i, x, y, w, h in zip(*columns[2:]):
            for number in range(len(lines) - 1, -1, -1):
                line = lines[number]
                _, top, tall = line["first"]
                height = max(tall, h)
                if abs(y + h / 2 - top - tall / 2) <= 0.25 * height:
                    fits = min(max(x - right, left - x - w, 0.0) for left, right in line["spans"]) <= 2 * height
                else:
                    common = min(y + h, line["low"]) - max(y, line["top"])
                    fits = max(common, 0.0) >= 0.25 * min(h, line["low"] - line["top"]) and any(-0.15 * height <= g <= 2 * height for left, right in line["spans"] for g in (x - right, left - x - w))
                if fits:
                    break
            else:
                number = len(lines)
                lines.append({"first": (x, y, h), "spans": [], "top": y, "low": y + h})
            line = lines[number]
            line["spans"].append((x, x + w))
            line["first"] = min(line["first"], (x, y, h), key=lambda f: f[0])
            line["top"], line["low"] = min(line["top"], y), max(line["low"], y + h)
            yield i, number + 1

    rows = fragments.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), F.col("fragment_id").cast("long").alias("fragment_id"), *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in "xywh"])
    return _page_by_page(rows, [F.col("y"), F.col("x"), F.asc_nulls_last("fragment_id")], page, "doc_id long, page int, fragment_id long, line long").withColumn("line", F.col("line").cast("int"))


def line_text(fragments: DataFrame, by: list[str]) -> DataFrame:
    """Each line's text: fragments by x, with a blank where the gap is wide and neither side has one."""
    w = Window.partitionBy(*by).orderBy("x", "fragment_id")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)
    blank = (gap > 0.15 * F.greatest("h", F.lag("h").over(w))) & ~F.lag("text").over(w).rlike(r"\s$") & ~F.col("text").rlike(r"^\s")
    piece = F.concat(F.when(blank, " ").otherwise(""), F.col("text"))
    parts = fragments.withColumn("piece", piece)
    return parts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "fragment_id", "piece"))), lambda p: p["piece"]), "").alias("text"))


def table_groups(lines: DataFrame) -> DataFrame:
    """Consecutive tabular lines of a page as one table: their group's number; others have none."""
    w = Window.partitionBy(*PAGE).orderBy("y", "idx")
    above = F.lag(F.struct("tabular", "y", "h")).over(w)
    gap, tall = F.col("y") - above["y"] - above["h"], F.greatest(F.col("h"), above["h"])
    down = (F.col("y") > above["y"]) & (F.col("y") + F.col("h") / 2 > above["y"] + above["h"] / 2)
    joins = F.coalesce(above["tabular"] & down & (gap >= -0.75 * tall) & (gap <= tall), F.lit(False))
    new = lines.withColumn("_new", F.when(F.col("tabular") & ~joins, 1).otherwise(0))
    return new.withColumn("table_no", F.when(F.col("tabular"), F.sum("_new").over(w))).drop("_new")


def headings(lines: DataFrame, most: int = 2, factor: float = 1.2) -> DataFrame:
    """(doc_id, page, idx, heading) of the lines that are not tables.

    A heading has at most ``most`` such lines before it, none of them larger than the body, and is
    ``factor`` times the body's size: the upper median of the lines that follow it without a break,
    tables left out. A line breaks where it does not lie lower, or three heights away.
    """
    w = Window.partitionBy(*PAGE).orderBy("y", "idx")
    above = F.lag(F.struct("y", "h")).over(w)
    near = (F.col("y") + F.col("h") / 2 > above["y"] + above["h"] / 2) & (F.col("y") - above["y"] - above["h"] <= 3 * F.greatest("h", above["h"]))
    placed = lines.withColumns({"place": F.row_number().over(w), "run": F.sum(F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).over(w)}).filter(~F.col("tabular"))
    n = F.row_number().over(w) - 1
    first = placed.withColumns({"before": n, "largest": F.max("size").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    some = first.filter(F.col("before") <= most).select(*PAGE, "idx", "run", "largest", F.col("place").alias("own"), F.col("size").alias("own_size"))
    body = some.join(placed.select(*PAGE, "run", "place", "size"), [*PAGE, "run"]).filter("place > own")
    body = body.groupBy(*PAGE, "idx", "largest", "own_size").agg(F.sort_array(F.collect_list("size")).alias("sizes"))
    middle = F.get("sizes", F.floor(F.size("sizes") / 2).cast("int"))
    heads = body.filter((F.col("own_size") >= factor * middle) & (F.col("largest").isNull() | (F.col("largest") <= middle))).select(*PAGE, "idx", F.lit(True).alias("heading"))
    return placed.select(*PAGE, "idx").join(heads, [*PAGE, "idx"], "left").fillna(False, ["heading"])


def blocks_from_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with ids by document order, and one review block for each page without lines."""
    filled = lines.select("doc_id", "page", "y", "x", "text", "confidence", F.lit(False).alias("empty_page"))
    bare = pages.join(lines.select(*PAGE).distinct(), PAGE, "left_anti").select("doc_id", "page", F.lit(0.0).alias("y"), F.lit(0.0).alias("x"), F.lit("").alias("text"), F.lit(0.0).alias("confidence"), F.lit(True).alias("empty_page"))
    every = filled.unionByName(bare)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y", "x", "text"))
    value, bad = confidence(F.col("confidence"), F.lit(False))
    return every.select("doc_id", F.concat(F.lit("b"), n.cast("string")).alias("block_id"), "page", "text", value.alias("confidence"), (F.col("empty_page") | bad | needs_review(value)).alias("requires_review"))


def review_gate(blocks: DataFrame) -> DataFrame:
    """Blocks with their confidence, ordered warnings and whether a person must look.

    Reads ``idx, text, x, confidence`` and, where the table has them, ``engine, missing_confidence,
    low_confidence, parser_review, parser_warnings``. A missing box, text or confidence, or an invalid
    one, sets the confidence to 0.
    """
    have = lambda c, kind: F.col(c) if c in blocks.columns else F.lit(None).cast(kind)
    engine = have("engine", "string").isNotNull()
    value, invalid = confidence(F.col("confidence"), engine)
    yes = lambda c: F.coalesce(have(c, "boolean"), F.lit(False))
    boxless, empty = F.col("x").isNull(), norm(F.coalesce("text", F.lit(""))) == ""
    missing = yes("missing_confidence") | (F.col("confidence").isNull() & engine)
    marked = "; block marked requires_review"
    found = [("bbox missing" + marked, boxless), ("text empty" + marked, empty), ("confidence missing" + marked, missing), ("confidence invalid" + marked, invalid), ("low confidence" + marked, yes("low_confidence")), ("parser marked block requires_review", yes("parser_review"))]
    own = F.filter(F.array(*[F.when(c, F.concat(F.lit("blocks["), F.col("idx").cast("string"), F.lit(f"].{m}"))) for m, c in found]), lambda x: x.isNotNull())
    warnings = F.concat(own, F.filter(F.coalesce(have("parser_warnings", "array<string>"), F.array().cast("array<string>")), lambda x: x != ""))
    zero = boxless | empty | missing | invalid
    return blocks.withColumns({"warnings": warnings, "confidence": F.when(zero, 0.0).otherwise(value)}).withColumn("requires_review", F.size("warnings") > 0)


def bbox_union(blocks: DataFrame, by: list[str]) -> DataFrame:
    """The box around each group; nulls where units or origins are mixed."""
    one = (F.count_distinct("unit") == 1) & (F.count_distinct("origin") == 1)
    right, low = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    named = {"x": F.min("x"), "y": F.min("y"), "w": right - F.min("x"), "h": low - F.min("y")}
    return blocks.groupBy(*by).agg(*[F.when(one, v).alias(k) for k, v in named.items()])


def check_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks whose page is not declared, has another unit, or is smaller than their box."""
    p = pages.select("doc_id", "page", F.col("width").alias("pw"), F.col("height").alias("ph"), F.col("unit").alias("pu"), F.lit(True).alias("there"))
    j = blocks.join(p, PAGE, "left")
    there = F.coalesce("there", F.lit(False))
    errors = rules(("undeclared page", ~there), ("unit mismatch", there & (F.col("unit") != F.col("pu"))), ("bbox outside page", there & ((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("pw")) | (F.col("y") + F.col("h") > F.col("ph")))))
    return j.select("doc_id", "block_id", errors.alias("errors")).filter("size(errors) > 0")


def validate_ir(docs: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per document: errors in order (no pages, then those of blocks), ok, and whether to review."""
    n_pages = pages.groupBy("doc_id").agg(F.count("page").alias("n_pages"))
    bad = check_blocks(blocks, pages).join(blocks.select("doc_id", "block_id", "idx"), ["doc_id", "block_id"])
    listed = F.array_sort(F.collect_list(F.struct("idx", F.concat_ws(", ", "errors").alias("e"))))
    errors = bad.groupBy("doc_id").agg(F.transform(listed, lambda x: F.concat(x["idx"].cast("string"), F.lit(": "), x["e"])).alias("errors"))
    flags = review_gate(blocks).groupBy("doc_id").agg(F.bool_or("requires_review").alias("review"))
    j = docs.select("doc_id").join(n_pages, "doc_id", "left").join(errors, "doc_id", "left").join(flags, "doc_id", "left")
    none = F.when(F.col("n_pages").isNull(), F.array(F.lit("document has no pages"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(none, F.coalesce("errors", F.array().cast("array<string>")))
    return j.select("doc_id", F.array_distinct(every).alias("errors"), (F.size(every) == 0).alias("ok"), (F.coalesce("review", F.lit(True)) | (F.size(every) > 0)).alias("requires_review"))


def _levels(y: Column, h: Column, around: int) -> Column:
    """The (level, strip) keys under which a block is found by its top: strips of two to the level, from 4 up to
    about half its height, and ``around`` neighbours of each. Blocks that share a row meet at the lower
    one's level, where their tops are at most one strip apart."""
    top = F.greatest(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(4.0), h / 2))).cast("int"))
    keys = F.transform(F.sequence(F.lit(2), F.coalesce(top, F.lit(2))), lambda l: F.transform(F.sequence(F.lit(-around), F.lit(around)), lambda d: F.struct(l.alias("level"), (F.floor(y / F.pow(F.lit(2.0), l)) + d).alias("strip"))))
    return F.flatten(keys)


def right_of(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each anchor's nearest block to the right on the same text row: (doc_id, anchor_id, block_id). Blocks and
    anchors meet in strips of a page (``_levels``), not all of a page's with each other."""
    a = anchors.select("doc_id", "page", "anchor_id", F.col("block_id").alias("own"), G.box(*[F.col(c) for c in "xywh"]).alias("a"), F.explode(_levels(F.col("y"), F.col("h"), 1)).alias("key"))
    b = blocks.select(*PAGE, "block_id", *"xywh", F.explode(_levels(F.col("y"), F.col("h"), 0)).alias("key"))
    j = b.join(a, [*PAGE, "key"]).withColumn("b", G.box(*[F.col(c) for c in "xywh"]))
    j = j.filter((F.col("block_id") != F.col("own")) & (F.col("x") >= F.col("a.x") + F.col("a.width")) & G.share_row(F.col("b"), F.col("a")))
    return j.groupBy("doc_id", "anchor_id").agg(F.min_by("block_id", F.struct("x", "y", "block_id")).alias("block_id"))


def below(blocks: DataFrame, anchors: DataFrame, values: tuple[str, ...] = ("paragraph", "field")) -> DataFrame:
    """(doc_id, anchor_id, block_id, place) of blocks under an anchor that may hold its value.

    A label's only candidate is the first block below that overlaps it horizontally, if its type can be
    a value. Other anchors take the blocks below in reading order, up to the first that cannot be one: by a
    running number of such stops on the page they meet only blocks between the same two stops.
    """
    names = ["doc_id", "page", "anchor_id", F.col("block_id").alias("own"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("w").alias("aw")]
    stop = F.when(F.col("type").isin(*values), 0).otherwise(1)
    labels = anchors.filter("kind = 'label'").select(*names)
    j = blocks.join(labels, PAGE).filter((F.col("block_id") != F.col("own")) & (F.col("y") > F.col("ay")) & (F.col("x") < F.col("ax") + F.col("aw")) & (F.col("ax") < F.col("x") + F.col("w")))
    first = j.groupBy("doc_id", "anchor_id").agg(F.min_by(F.struct("block_id", stop.alias("stop")), F.struct("y", "x", "block_id")).alias("b")).filter("b.stop = 0")
    first = first.select("doc_id", "anchor_id", F.col("b.block_id").alias("block_id"), F.lit(1).alias("place"))
    # stops up to each block in reading order, and up to each anchor's height
    run = F.sum(stop).over(Window.partitionBy(*PAGE).orderBy("y", "x", "block_id").rowsBetween(Window.unboundedPreceding, 0))
    b = blocks.select(*PAGE, "block_id", "x", "y", run.alias("stops"), stop.alias("stop"))
    a = anchors.filter("kind IS NULL OR kind <> 'label'").select(*names)
    heights = a.select(*PAGE, F.col("ay").alias("y")).distinct().withColumns({"stop": F.lit(0), "asks": F.lit(True)})
    seen = F.sum("stop").over(Window.partitionBy(*PAGE).orderBy("y").rangeBetween(Window.unboundedPreceding, 0))
    heights = heights.unionByName(b.select(*PAGE, "y", "stop").withColumn("asks", F.lit(False))).withColumn("stops", seen).filter("asks").select(*PAGE, F.col("y").alias("ay"), "stops")
    a = a.join(heights, [*PAGE, "ay"]).select("doc_id", "page", "anchor_id", "own", "ay", "stops")
    taken = b.filter("stop = 0").join(a, [*PAGE, "stops"]).filter((F.col("y") > F.col("ay")) & (F.col("block_id") != F.col("own")))
    w = Window.partitionBy("doc_id", "anchor_id").orderBy("y", "x", "block_id")
    return first.unionByName(taken.select("doc_id", "anchor_id", "block_id", F.row_number().over(w).alias("place")))


def label_cells(labels: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells inside a label's box on its page whose text has the label's: keys (doc_id, page)."""
    l = labels.select("doc_id", "page", "label_id", F.col("text").alias("label_text"), *[F.col(c).alias(f"l{c}") for c in "xywh"])
    j = cells.join(l, PAGE).filter((F.col("x") >= F.col("lx")) & (F.col("y") >= F.col("ly")) & (F.col("x") + F.col("w") <= F.col("lx") + F.col("lw")) & (F.col("y") + F.col("h") <= F.col("ly") + F.col("lh")))
    return j.filter((norm(F.col("label_text")) != "") & F.contains(norm(F.col("text")), norm(F.col("label_text")))).select("doc_id", "page", "label_id", "block_id")


def adapt_v0(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks on their declared pages; those of undeclared ones on the document's first page."""
    first = pages.groupBy("doc_id").agg(F.min("page").alias("first_page"))
    declared = pages.select("doc_id", "page", F.col("page").alias("declared"))
    j = blocks.join(declared, PAGE, "left").join(first, "doc_id", "left")
    return j.withColumn("page", F.coalesce("declared", "first_page")).drop("declared", "first_page")


def assign_metadata(fragments: DataFrame, sources: DataFrame) -> DataFrame:
    """Each fragment's metadata source, each used once: same page and text, best by box then extractor.

    Which source is free depends on the choices before, so a page is handled as a whole: the best of all pairs
    whose fragment and source are free is the least of the fragments' own best sources, which are looked for
    again when theirs is taken. Pairs are never laid out.
    """

    def greedy(columns: list[list]) -> Iterator[tuple]:
        free: dict[str, list[tuple]] = {}
        asked = []
        for text, source, i, rank, x, y in zip(*columns[2:]):
            if source:
                free.setdefault(text, []).append((i, (rank is None, rank), x, y))
            else:
                asked.append((text, i, x, y))
        used_f: set = set()
        used_s: set = set()

        def best(text: str, i: int, x: float, y: float, at: int) -> tuple | None:
            left = free[text] = [s for s in free.get(text, ()) if s[0] not in used_s]
            pairs = ((abs(x - sx) + abs(y - sy), rank, s) for s, rank, sx, sy in left)
            found = min(((d != d, d if d == d else 0.0, rank, i, s) for d, rank, s in pairs), default=None)
            return found and (*found, at)

        heap = [b for at, f in enumerate(asked) if (b := best(*f, at))]
        heapify(heap)
        while heap:
            *_, i, s, at = heappop(heap)
            if i in used_f:
                continue
            if s not in used_s:
                used_f.add(i)
                used_s.add(s)
                yield i, s
            elif again := best(*asked[at], at):
                heappush(heap, again)

    def side(df: DataFrame, source: bool, i: str, rank: Column) -> DataFrame:
        at = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in "xy"]
        return df.filter("doc_id IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "text", F.lit(source).alias("source"), F.col(i).cast("long").alias("i"), rank.alias("rank"), *at)

    none = F.lit(None).cast(dict(sources.dtypes)["rank"])
    rows = side(fragments, False, "fragment_id", none).unionByName(side(sources, True, "source_id", F.col("rank")))
    return _page_by_page(rows, [], greedy, "doc_id long, page int, fragment_id long, source_id long").drop("page")


def attach_rows(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """Parsed tables onto table blocks of the same page and text, own extractor first, each used once."""
    key = [*PAGE, "text"]
    b = blocks.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("idx")))
    t = tables.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("foreign", "table_id")))
    return b.join(t.select(*key, "n", "table_id"), [*key, "n"], "left").select("doc_id", "block_id", "table_id")


def merge_tables(fragments: DataFrame, tables: DataFrame) -> DataFrame:
    """A selected table onto fragments by (page, normalised rows): kept, added, or stale."""
    f = fragments.select(*PAGE, F.sha2(norm(F.col("text")), 256).alias("key"), "fragment_id", F.row_number().over(Window.partitionBy(*PAGE, norm(F.col("text"))).orderBy("fragment_id")).alias("n"))
    t = tables.select(*PAGE, F.sha2(norm(F.col("text")), 256).alias("key"), "table_id").distinct().withColumn("n", F.lit(1))
    j = f.join(t, [*PAGE, "key", "n"], "full_outer")
    fate = F.when(F.col("fragment_id").isNull(), "added").when(F.col("table_id").isNull() & (F.col("n") > 1), "stale").when(F.col("table_id").isNull(), "kept").otherwise("replaced")
    return j.select("doc_id", "page", "fragment_id", "table_id", fate.alias("fate"))


# ---------------------------------------------------------------- review


def review_queue(blocks: DataFrame, fields: DataFrame, tables: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """All that a person must look at, by kind: blocks, template fields, tables, model fallbacks."""
    return (
        blocks.filter("requires_review").select("doc_id", F.lit("block").alias("kind"), F.col("block_id").alias("target"))
        .unionByName(fields.filter("requires_review").select("doc_id", F.lit("field").alias("kind"), F.col("field_id").alias("target")))
        .unionByName(tables.filter("requires_review").select("doc_id", F.lit("table").alias("kind"), F.col("table_id").alias("target")))
        .unionByName(fallbacks.select("doc_id", F.lit("model_fallback").alias("kind"), F.lit("document").alias("target")))
    )


def ocr_boundary(blocks: DataFrame) -> DataFrame:
    """Documents with blocks without a text layer: how many, and on which pages."""
    bare = blocks.filter(F.coalesce(norm(F.col("text")), F.lit("")) == "")
    return bare.groupBy("doc_id").agg(F.count("block_id").alias("blocks"), F.sort_array(F.collect_set("page")).alias("pages"))


def doc_text(blocks: DataFrame, header: Column) -> DataFrame:
    """A document as text: its header and a line for each block in reading order."""
    listed = F.array_sort(F.collect_list(F.struct("page", "y", "x", "block_id", F.concat(F.lit("["), "type", F.lit("] "), norm(F.col("text"))).alias("line"))))
    out = blocks.groupBy("doc_id").agg(F.transform(listed, lambda b: b["line"]).alias("lines"))
    return out.select("doc_id", F.array_join(F.concat(F.array(header), "lines"), "\n").alias("text"))


DECIDED = ("approved", "rejected", "needs_fix")


def high_risk_coverage(targets: DataFrame, items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(target, status, duplicates) of expected high-risk targets, and of items that nothing expected.

    Of several ``items(item_id, target, high_risk, auto_confirmed, converted)`` of a target the first
    counts. It is confirmed by machine if it says so, or if its case was converted and nobody has decided;
    covered if somebody has; else undecided. Items of high risk without a target are unexpected.
    """
    d = decisions.filter(F.col("decision").isin(*DECIDED)).select("item_id").distinct().withColumn("decided", F.lit(True))
    i = items.join(d, "item_id", "left")
    first = i.groupBy("target").agg(F.min_by(F.struct(F.coalesce("auto_confirmed", F.lit(False)).alias("auto"), F.coalesce("converted", F.lit(False)).alias("converted"), F.coalesce("decided", F.lit(False)).alias("decided")), "item_id").alias("i"), (F.count("item_id") - 1).alias("duplicates"))
    j = targets.select("target").join(first, "target", "left")
    auto = F.col("i.auto") | (F.col("i.converted") & ~F.col("i.decided"))
    status = F.when(F.col("i").isNull(), "missed").when(auto, "auto_confirmed").when(F.col("i.decided"), "covered").otherwise("undecided")
    unexpected = items.filter("high_risk").join(targets, "target", "left_anti").groupBy("target").agg(F.lit("unexpected").alias("status"), (F.count("item_id") - 1).alias("duplicates"))
    return j.select("target", status.alias("status"), F.coalesce("duplicates", F.lit(0)).alias("duplicates")).unionByName(unexpected)


def check_ir(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks whose id repeats in their document, whose page is unknown, or whose box leaves it."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "block_id"))
    repeated = blocks.withColumn("n", n).filter("n > 1").select("doc_id", "block_id", F.lit("repeated block").alias("error")).distinct()
    placed = check_blocks(blocks, pages).select("doc_id", "block_id", F.explode("errors").alias("error"))
    return repeated.unionByName(placed.distinct())
