"""Column expressions on text: normalisation, containment, names, labels, table text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space, Unicode's and the four ASCII separators.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def norm(c: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def fold(c: Column) -> Column:
    """Normalised and case-folded (sharp s counts as ss)."""
    return F.replace(F.lower(norm(c)), F.lit("ß"), F.lit("ss"))


def norm_contains(whole: Column, part: Column) -> Column:
    """Whether normalised ``whole`` has normalised ``part``; a blank part is in nothing."""
    return F.coalesce((norm(part) != "") & F.contains(norm(whole), norm(part)), F.lit(False))


def same_text(a: Column, b: Column) -> Column:
    """Equal after normalisation, and not blank; false where either is null."""
    return F.coalesce((norm(a) == norm(b)) & (norm(a) != ""), F.lit(False))


def norm_col(c: Column) -> Column:
    """A column's name: underscores and hyphens as blanks, then folded."""
    return fold(F.translate(c, "_-", "  "))


def split_field(c: Column) -> tuple[Column, Column]:
    """Label and value of a field's text at its first colon; without one, all is value."""
    at = F.instr(c, ":")
    label = F.when(at > 0, F.trim(F.substring_index(c, ":", 1))).otherwise(F.lit(""))
    return label, F.trim(F.when(at > 0, F.substr(c, at + 1)).otherwise(c))


def split_table(c: Column) -> Column:
    """Rows of cells of a table's text. Cells part at tabs, else at pipes (outer ones trimmed), else
    at commas, else at runs of blanks. Blank rows and Markdown rules are dropped."""

    def cells(line: Column) -> Column:
        bare = F.regexp_replace(F.trim(line), r"^\||\|$", "")
        parts = (
            F.when(F.contains(line, F.lit("\t")), F.split(line, "\t"))
            .when(F.contains(line, F.lit("|")), F.split(bare, r"\|"))
            .when(F.contains(line, F.lit(",")), F.split(line, ","))
            .otherwise(F.split(F.trim(line), r"\s{2,}"))
        )
        return F.transform(parts, lambda x: F.trim(x))

    rows = F.transform(F.split(c, "\n"), cells)
    filled = F.filter(rows, lambda r: F.exists(r, lambda x: x != ""))
    return F.filter(filled, lambda r: ~F.forall(r, lambda x: x.rlike(r"^:?-{3,}:?$")))


def word_split(c: Column) -> Column:
    """Camel humps and other characters as underscores, in lower case."""
    snake = F.regexp_replace(F.trim(c), r"(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.regexp_replace(F.regexp_replace(F.lower(snake), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def value_after(c: Column, label: Column, stops: Column) -> Column:
    """The text after a label and its colon, up to the first of the ``stops`` labels with a colon; null
    where the label is not there or nothing follows it. Labels are found in any case, as whole words."""
    low = F.lower(c)
    name = lambda x: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.regexp_replace(F.lower(F.trim(x)), r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"\s*[:：]"))
    head = F.regexp_substr(low, name(label))
    rest = F.substr(c, F.regexp_instr(low, name(label)) + F.length(head))
    ends = F.filter(F.transform(stops, lambda s: F.regexp_instr(F.lower(rest), name(s))), lambda p: p > 0)
    value = F.trim(F.substr(rest, F.lit(1), F.coalesce(F.array_min(ends) - 1, F.length(rest))))
    return F.when(head.isNotNull() & (value != ""), value)
