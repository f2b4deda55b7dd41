"""Text expressions: headings, file names, labels, tokens, annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT = ("MUST", "MUST_NOT")
PROHIBITIONS = ("MUST_NOT", "SHOULD_NOT")
KNOWN = ("MUST", "MUST_NOT", "SHOULD", "SHOULD_NOT", "MAY")


def heading(text: Column) -> Column:
    """As headings are compared: trimmed, without a colon at the end, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(text), ":+$", "")))


def kebab(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{Nd}]+", "-"), "^-+|-+$", "")


def label(text: Column, most: int = 40) -> Column:
    """One line without double quotes, of at most ``most`` characters, the last three of a longer one dots."""
    line = F.replace(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit('"'), F.lit("'"))
    return F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, max(0, most - 3)), F.lit("..."))).otherwise(line)


def tokens(text: Column) -> Column:
    """A rough count of tokens: a quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def escaped_data(text: Column) -> Column:
    """For the message of a workflow annotation."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def escaped_property(text: Column) -> Column:
    return F.replace(F.replace(escaped_data(text), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def valid_day(value: Column) -> Column:
    """A day as YYYY-MM-DD, or null for anything else."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull(), value)


def strict(modality: Column) -> Column:
    return modality.isin(*STRICT)


def prohibits(modality: Column) -> Column:
    return modality.isin(*PROHIBITIONS)


def conflicting(a: Column, b: Column) -> Column:
    """Both known, exactly one of them a prohibition."""
    return F.coalesce(a.isin(*KNOWN) & b.isin(*KNOWN) & (prohibits(a) != prohibits(b)), F.lit(False))


def accepts(value: Column, kind: str, one_of: tuple[str, ...]) -> Column:
    """Whether a declared attribute takes a value; the vocabulary minds case."""
    if one_of:
        return F.coalesce(value.isin(*one_of), F.lit(False))
    if kind == "number":
        return F.coalesce(value.try_cast("double").isNotNull(), F.lit(False))
    if kind == "date":
        return valid_day(value).isNotNull()
    return F.coalesce(F.trim(value) != "", F.lit(False))


def alternatives(names: Column) -> Column:
    """A list as "a, b or c"."""
    several = F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0))), ", "), F.lit(" or "), F.element_at(names, -1))
    return F.when(F.size(names) == 0, F.lit("")).when(F.size(names) == 1, F.element_at(names, 1)).otherwise(several)
