"""Identities and references as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.plans.config import Config, Edge

SHAPE = r"(?i)^(adr[-_ ]?)?[0-9]+(-[^/\\]*?)?(\.md)?$"


def unwrapped(ref: Column) -> Column:
    """A reference without [[ ]] and alias."""
    text = F.trim(ref)
    inner = F.regexp_extract(text, r"^\[\[([^\]|]*)(\|[^\]]*)?\]\]$", 1)
    return F.when(text.rlike(r"^\[\[[^\]]*\]\]$"), F.trim(inner)).otherwise(text)


def numbered_identity(ref: Column, width: int) -> Column:
    """The first run of digits of the last path segment, without leading zeros, filled up to width; null without digits."""
    name = F.regexp_extract(unwrapped(ref), r"([^/\\]*)$", 1)
    digits = F.regexp_replace(F.regexp_extract(name, "[0-9]+", 0), "^0+(?=.)", "")
    return F.when(digits != "", F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def pattern_identity(ref: Column, pattern: str) -> Column:
    """A reference that matches a kind's pattern as a whole; null otherwise."""
    text = unwrapped(ref)
    return F.when(text.rlike(anchored(pattern)), text)


def anchored(pattern: str) -> str:
    return f"^(?:{pattern})$"


def normalised(ref: Column, cfg: Config, edge: Edge | None = None) -> Column:
    """The identity a reference names: by number, or by the first kind that accepts it, an edge's own kinds first."""
    if not cfg.multikind:
        return numbered_identity(ref, cfg.id_width)
    own = sorted({*edge.sources, *edge.targets}) if edge else []
    order = [*own, *(k for k, _ in cfg.kind_items() if k not in own)]
    return F.coalesce(*(pattern_identity(ref, cfg.kind(k).id) for k in order))


def shaped(ref: Column, cfg: Config) -> Column:
    """Whether a reference looks like an identity at all."""
    if not cfg.multikind:
        return F.coalesce(unwrapped(ref).rlike(SHAPE), F.lit(False))
    return normalised(ref, cfg).isNotNull()


def unpadded(identity: Column) -> Column:
    """An identity with the leading zeros of its digit runs removed."""
    return F.regexp_replace(identity, "(?<![0-9])0+(?=[0-9])", "")


def number_of(identity: Column) -> Column:
    """The first run of digits as a number, or null."""
    return F.regexp_extract(identity, "[0-9]+", 0).try_cast("bigint")


def next_identity(ids: Column, width: int) -> Column:
    """An aggregate: the largest number of all identities and one, filled up to width."""
    following = (F.coalesce(F.max(number_of(ids)), F.lit(0)) + 1).cast("string")
    return F.when(F.length(following) >= width, following).otherwise(F.lpad(following, width, "0"))


def is_document_link(target: Column) -> Column:
    """Whether a link leads to a Markdown file and not to an address or an anchor."""
    path = F.substring_index(F.trim(target), "#", 1)
    return path.rlike(r"(?i)\.md$") & ~path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def kind_of(identity: Column, cfg: Config) -> Column:
    return reduce(lambda otherwise, k: F.when(identity.rlike(anchored(k[1].id)), F.lit(k[0])).otherwise(otherwise), reversed(cfg.kind_items()), F.lit(None).cast("string"))
