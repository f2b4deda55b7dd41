"""License scans: an Aho-Corasick automaton and a parser of license expressions.

A text is folded to words with single spaces between them; one pass of the automaton
over it finds every place of every phrase, and the word that introduces an identifier
tag.  The expression after a tag is read from the original text: a shunting-yard parser
takes the longest run of tokens that forms an expression of ``and``, ``or``, ``with`` and
parentheses and puts it in postfix order, from which ``licenses`` lists the licenses named
and ``satisfied`` tells whether given licenses meet it.

Null text counts as empty: no words, no labels, score 0.  An empty table has an empty result;
texts without any word, very long ones and repeated rows need no special care.  Of the
columns, the key and the text alone are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm.common import modest_batches

BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache-2",
    "apache 2 0": "apache-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 3 clause": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by": "cc-by",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "all rights reserved": "proprietary",
    "released into the public domain": "public-domain",
}
#: Identifiers whose labels are a family's; all others are their own label, in lower case.
FAMILIES = {"mit": "mit", "apache-2.0": "apache-2", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc-by": "cc-by", "cc0": "cc0", "gpl-3.0": "gpl-3", "gpl-2.0": "gpl-2", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl"}
LICENSE_NAME = re.compile(r"(?=.*[A-Z0-9])[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: Labels of licenses that ask no more than notice; an expression that these alone can meet is open.
OPEN = frozenset({"mit", "apache-2", "cc-by", "cc0", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "public-domain"})
TAG_WORDS = "spdx license identifier"
TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
BINDS = {"or": 1, "and": 2, "with": 3}
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def parse(text: str) -> list[str] | None:
    """The longest expression that a text starts with, in postfix order, or None."""
    tokens: list[str] = []
    at = depth = whole = 0
    wants_operand = True
    while m := TOKEN.match(text, at):
        token, word = m[1], m[1].lower()
        if word in BINDS or token == ")":
            if wants_operand or token == ")" and not depth:
                break
            depth -= token == ")"
            wants_operand = token != ")"
        else:
            if not wants_operand or token != "(" and not LICENSE_NAME.fullmatch(token) and word not in FAMILIES:
                break
            depth += token == "("
            wants_operand = token == "("
        tokens.append(token)
        at = m.end()
        if not wants_operand and not depth:
            whole = len(tokens)
    return postfix(tokens[:whole]) if whole else None


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard over a well-formed expression; None if ``with`` has anything but two names."""
    out: list[str] = []
    operators: list[str] = []
    atoms = 0  # names at the end of the output

    def put(op: str) -> bool:
        nonlocal atoms
        fits = op != "with" or atoms >= 2
        out.append(op)
        atoms = 0
        return fits

    for token in tokens:
        word = token.lower()
        if word in BINDS:
            while operators and operators[-1] != "(" and BINDS[operators[-1]] >= BINDS[word]:
                if not put(operators.pop()):
                    return None
            operators.append(word)
        elif token == "(":
            operators.append("(")
        elif token == ")":
            while operators[-1] != "(":
                if not put(operators.pop()):
                    return None
            operators.pop()
        else:
            out.append(token)
            atoms += 1
    while operators:
        if not put(operators.pop()):
            return None
    return out


def label_of(identifier: str) -> str:
    """The family of an identifier by its longest beginning at a version or hyphen, else itself."""
    name = identifier.lower().rstrip("+")
    at = name
    while at:
        if at in FAMILIES:
            return FAMILIES[at]
        at = at.rpartition("-")[0]
    return name


class Name(str):
    """A license or exception that isn't valued yet."""


def folded(expression: list[str], leaf, joined) -> object:
    """The value of a postfix expression: leaf(license, exception or None) and joined(op, left, right)."""
    stack: list = []

    def valued(x: object) -> object:
        return leaf(label_of(x), None) if isinstance(x, Name) else x

    for token in expression:
        if token == "with":
            exception, name = stack.pop(), stack.pop()
            stack.append(leaf(label_of(name), exception.lower()))
        elif token in ("and", "or"):
            right, left = valued(stack.pop()), valued(stack.pop())
            stack.append(joined(token, left, right))
        else:
            stack.append(Name(token))
    return valued(stack.pop())


def satisfied(expression: list[str], allowed: frozenset[str]) -> bool:
    """Whether licenses in ``allowed`` (labels, or "label with exception") meet an expression."""
    return bool(folded(expression, lambda name, exception: name in allowed or f"{name} with {exception}" in allowed, lambda op, a, b: a and b if op == "and" else a or b))


def licenses(expression: list[str]) -> set[str]:
    """The labels of all licenses that an expression names."""
    found: set[str] = set()
    folded(expression, lambda name, exception: found.add(name), lambda op, a, b: None)
    return found


@lru_cache(maxsize=8)
def automaton(phrases: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for p in phrases:
        spelt = p.encode().decode("latin-1")
        found.add_word(f" {spelt} ", (p, len(spelt) + 2))
    found.make_automaton()
    return found


def places(text: str, phrases: tuple[str, ...]) -> tuple[int, list[tuple[str, int]]]:
    """The number of words, and every phrase's places by the first word's number."""
    words = text.encode().translate(TO_WORDS).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    found, seen, at = [], 0, 0
    hits = sorted((end - size + 1, p) for end, (p, size) in automaton(phrases).iter(line))
    for start, p in hits:
        seen += line.count(" ", at, start)
        at = start
        found.append((p, seen))
    return len(words), found


def longest(found: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Places of phrases that lie in no longer phrase's place."""
    spans = sorted({(i, i + len(p.split()), p) for p, i in found}, key=lambda x: (x[0], -x[1]))
    kept, end = [], -1
    for first, last, p in spans:
        if last > end:
            kept.append((p, first))
            end = last
    return kept


def scan_text(text: str | None, base: dict[str, str], notices: dict[str, str], open_labels: frozenset[str] = OPEN) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, open_terms, expressions of a whole text.

    score: 1 with a base phrase or a whole tag, 0.8 with a notice alone, 0.5 with a tag that can't be read alone, else 0.
    open_terms: whether open licenses alone meet every tag's expression; null without a tag that can be read.
    A notice within a longer phrase is not told by itself.
    """
    text = text or ""
    n_words, found = places(text, tuple(sorted({*base, *notices, TAG_WORDS})))
    own = [(p, i) for p, i in found if p in base]
    base_labels = {base[p] for p, _ in own}
    labels = base_labels | {notices[p] for p, _ in longest(found) if p in notices}
    score = 1.0 if own else 0.8 if labels else 0.0
    expressions, open_terms = [], None
    if any(p == TAG_WORDS for p, _ in found):
        for m in TAG.finditer(text):
            expression = parse(m[1])
            if expression is None:
                score = max(score, 0.5)
                continue
            score = 1.0
            labels |= licenses(expression)
            open_terms = satisfied(expression, open_labels) and open_terms is not False
            expressions.append(" ".join(expression))
    starts = [i for _, i in own]
    return n_words, len(own), min(starts, default=None), max(starts, default=None), sorted(base_labels), sorted(labels), score, open_terms, expressions


def scan(df: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The findings of each whole text, one row for each row: key, counts, places, label lists, score, whether the terms are open, and the tags' expressions in postfix order."""
    modest_batches(df.sparkSession)
    base = BASE_PHRASES if base is None else base
    notices = NOTICE_PHRASES if notices is None else notices
    strings = pa.list_(pa.string())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), strings, strings, pa.float64(), pa.bool_(), strings]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "open_terms", "expressions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t, base, notices) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, open_terms boolean, expressions array<string>")
