"""Review categories of fields, by name and type, and what extractors' names say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docvigil.functions.text import word_split

# The categories that a person must review, and names that stand for them.
REVIEW_CATEGORIES = ("lot_number", "item", "date_time", "numeric_value", "specification", "judgment", "person", "correction", "deviation")
CATEGORY_ALIASES = {
    "batch_id": "lot_number", "batch_lot_id": "lot_number", "batch_lot_no": "lot_number", "batch_lot_number": "lot_number", "batch_number": "lot_number", "batch_no": "lot_number",
    "lot": "lot_number", "lot_id": "lot_number", "lot_identifier": "lot_number", "lot_no": "lot_number", "lot_number": "lot_number",
    "product": "item", "material": "item", "component": "item",
    "date": "date_time", "approval_date": "date_time", "approved_at": "date_time", "collection_date": "date_time", "effective_date": "date_time", "expiration_date": "date_time", "expiry_date": "date_time",
    "manufacture_date": "date_time", "manufactured_at": "date_time", "manufacturing_date": "date_time", "mfg_date": "date_time", "production_date": "date_time", "review_date": "date_time",
    "reviewed_at": "date_time", "sample_date": "date_time", "test_date": "date_time", "time": "date_time", "timestamp": "date_time", "datetime": "date_time",
    "quantity": "numeric_value", "measurement": "numeric_value", "number": "numeric_value", "actual_yield": "numeric_value", "expected_yield": "numeric_value", "target_yield": "numeric_value", "yield": "numeric_value",
    "limit": "specification", "standard": "specification", "acceptance_criteria": "specification",
    "result": "judgment", "decision": "judgment", "disposition": "judgment", "status": "judgment", "release_status": "judgment",
    "operator": "person", "reviewer": "person", "approver": "person", "approved_by": "person", "checked_by": "person", "performed_by": "person", "prepared_by": "person", "reviewed_by": "person",
    "signature": "person", "signed_by": "person", "verified_by": "person",
    "change": "correction", "amendment": "correction", "nonconformance": "deviation", "oos": "deviation",
}
NUMBER_TYPES = ("number", "numeric", "integer", "int", "float", "decimal")
TIME_TYPES = ("date", "datetime", "time", "timestamp")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def norm_category(c: Column) -> Column:
    """A name's category: itself or its alias, else that of the longest known name among its words,
    else date_time by its ending, else the plain name."""
    alias = F.create_map(*[F.lit(x) for kv in CATEGORY_ALIASES.items() for x in kv])
    known = sorted({*REVIEW_CATEGORIES, *CATEGORY_ALIASES}, key=lambda k: (-len(k), k))

    def category(name: Column) -> Column:
        # at each word the longest known name that begins there; of all, the longest
        each = F.regexp_extract_all(F.concat(F.lit("_"), name, F.lit("_")), F.lit(f"(?=_({'|'.join(known)})_)"), F.lit(1))
        found = F.array_max(F.transform(each, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
        inside = _let(found, lambda k: F.coalesce(F.try_element_at(alias, k), k))
        ending = F.when(name.rlike("_(date|time|timestamp|datetime)$"), "date_time")
        return F.coalesce(F.try_element_at(alias, name), F.when(name.isin(*REVIEW_CATEGORIES), name), inside, ending, name)

    return _let(word_split(c), category)


def type_category(c: Column) -> Column:
    word = F.translate(F.lower(F.trim(c)), "- ", "__")
    return F.when(word.isin(*NUMBER_TYPES), "numeric_value").when(word.isin(*TIME_TYPES), "date_time").otherwise("")


def ocr_derived(kind: Column, extractor: Column) -> Column:
    """Whether a source kind or an extractor's name says that text was recognised."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    source = _let(plain(kind), lambda k: k.isin("ocr", "optical_character_recognition", "pdf_ocr", "scanned_pdf", "scanned_pdf_ocr") | F.concat(F.lit("_"), k, F.lit("_")).contains("_ocr_"))
    return F.coalesce(source, F.lit(False)) | F.coalesce(F.lower(extractor).rlike("ocr|tesseract"), F.lit(False))


def llm_involved(flag: Column, extractor: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.lower(extractor).rlike("llm|gpt"), F.lit(False))


def is_high_risk(flag: Column, level: Column, warnings: Column) -> Column:
    """An explicit flag, a high or critical level, or a warning that says so."""
    said = F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: F.lower(w).rlike("high.?risk"))
    return reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in (flag, level.isin("high", "critical"), said)])
