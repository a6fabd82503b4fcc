"""Column expressions on values: numbers, dates, booleans, confidences, cell references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_CONFIDENCE = 0.95
REVIEW_CONFIDENCE = 0.8


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def parse_number(c: Column) -> Column:
    """A number with plain digits or strict groups of three; anything else is null."""
    text = F.trim(c)
    shape = r"^[+-]?(\d+|\d{1,3}(,\d{3})+)(\.\d+)?$"
    return F.when(text.rlike(shape), F.replace(text, F.lit(","), F.lit("")).try_cast("double"))


def parse_date(c: Column) -> Column:
    """An ISO date; impossible days are null."""
    text = F.trim(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def parse_bool(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin("true", "yes", "1"), True).when(word.isin("false", "no", "0"), False)


DATE_ORDER = {"before": "<", "before_or_equal": "<=", "after": ">", "after_or_equal": ">="}
NUMBER_ORDER = {"less_than": "<", "less_than_or_equal": "<=", "greater_than": ">", "greater_than_or_equal": ">="}


def fields_agree(operator: Column, value: Column, other: Column, value_type: Column) -> Column:
    """Whether a field's value stands to a related one as ``operator`` says; false where it cannot be told.

    Orders are those of dates or of numbers. Equality is that of the field's type where either text is such a
    value, and then both must be; else that of trimmed texts.
    """
    compare = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    kind, op = F.lower(F.trim(value_type)), F.lower(F.trim(operator))
    typed = F.when(kind == "number", F.struct(parse_number(value).cast("string").alias("a"), parse_number(other).cast("string").alias("b")))
    typed = typed.when(kind == "date", F.struct(parse_date(value).cast("string").alias("a"), parse_date(other).cast("string").alias("b")))
    typed = typed.when(kind == "boolean", F.struct(parse_bool(value).cast("string").alias("a"), parse_bool(other).cast("string").alias("b")))
    a, b = typed["a"], typed["b"]
    plain = F.coalesce(a.isNull() & b.isNull(), F.lit(True))
    same = F.when(plain, F.trim(value) == F.trim(other)).otherwise(a == b)
    told = F.when(op == "equals", same).when(op == "not_equals", ~same)
    for orders, parse in ((DATE_ORDER, parse_date), (NUMBER_ORDER, parse_number)):
        for name, sign in orders.items():
            told = told.when(op == name, compare[sign](parse(value), parse(other)))
    return F.coalesce(told, F.lit(False))


def cell_type(c: Column) -> Column:
    """``number`` for plain numbers without leading zeros and with 15 significant digits at most,
    ``blank``, else ``text``."""
    text = F.trim(c)
    digits = F.regexp_replace(F.regexp_replace(text, r"[^0-9]", ""), r"^0+", "")
    plain = text.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?$") & (F.length(digits) <= 15)
    return F.when(F.coalesce(text, F.lit("")) == "", "blank").when(plain, "number").otherwise("text")


def confidence(c: Column, percent: Column) -> tuple[Column, Column]:
    """(confidence, invalid): a default where absent, engines' percentages as shares, and 0 with a flag
    where the value is negative or not finite."""
    bad = c.isNotNull() & ~(finite(c) & (c >= 0))
    return F.when(c.isNull(), F.lit(DEFAULT_CONFIDENCE)).when(bad, F.lit(0.0)).when(percent, c / 100).otherwise(c), bad


def needs_review(c: Column) -> Column:
    """A confidence that is absent, not finite, low or above 1 means review."""
    return ~(finite(c) & (c >= REVIEW_CONFIDENCE) & (c <= 1))


def cell_ref(c: Column) -> tuple[Column, Column]:
    """Row and column numbers of a reference such as B12."""
    letters = F.upper(F.regexp_extract(c, r"^([A-Za-z]+)\d+$", 1))
    row = F.regexp_extract(c, r"^[A-Za-z]+(\d+)$", 1).try_cast("int")
    column = F.aggregate(F.split(letters, ""), F.lit(0), lambda acc, x: F.when(x == "", acc).otherwise(acc * 26 + F.ascii(x) - 64))
    return row, F.when(row.isNotNull(), column)
