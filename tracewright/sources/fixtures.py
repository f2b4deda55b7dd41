"""Fixtures made from a rule: documents on which it fires, and the same ones with one fact broken."""

from __future__ import annotations

import re
import re._parser as pattern_parser
from collections.abc import Iterator
from dataclasses import dataclass, field

from tracewright.operators.lint_corpus import FIRES, SILENT
from tracewright.plans.config import Config, ConfigError
from tracewright.plans.lint import ENDLESS, Analysis, Fact


def sample(pattern: str, n: int) -> str:
    """The nth of the texts that a pattern takes, counted through its character classes, least repeats."""
    spent = [n]

    def pick(choices: list[str]) -> str:
        spent[0], at = divmod(spent[0], len(choices))
        return choices[at]

    def letters(items) -> list[str]:
        out = []
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                out.append(chr(value))
            elif name == "RANGE":
                out += map(chr, range(value[0], value[1] + 1))
            elif name == "CATEGORY":
                out += list("0123456789") if "DIGIT" in str(value) else list("abcdefghij")
        return out or ["a"]

    def walk(tree) -> str:
        parts = []
        for op, value in reversed(list(tree)):  # the last place counts fastest
            name = str(op)
            if name == "LITERAL":
                parts.append(chr(value))
            elif name == "IN":
                parts.append(pick(letters(value)))
            elif name == "ANY":
                parts.append(pick(list("abcdefghij")))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = value
                times = low if low else min(1, high)
                parts.append("".join(reversed([walk(inner) for _ in range(times)])))
            elif name == "SUBPATTERN":
                parts.append(walk(value[-1]))
            elif name == "BRANCH":
                parts.append(walk(value[1][0]))
        return "".join(reversed(parts))

    text = walk(pattern_parser.parse(pattern))
    if not re.fullmatch(pattern.removeprefix("^").removesuffix("$"), text):
        raise ConfigError(f"no sample of {pattern} was found")
    return text


@dataclass
class Draft:
    kind: str
    id: str
    keys: dict[str, object] = field(default_factory=dict)
    edges: dict[str, list[str]] = field(default_factory=dict)


class Maker:
    def __init__(self, cfg: Config, day: str):
        self.cfg, self.day = cfg, day
        self.drafts: list[Draft] = []

    def draft(self, kind: str) -> Draft:
        pattern = self.cfg.kind(kind).id if self.cfg.multikind else ""
        nth = sum(d.kind == kind for d in self.drafts) + 1
        made = Draft(kind, sample(pattern, nth) if pattern else str(len(self.drafts) + 1).zfill(self.cfg.id_width))
        statuses = self.cfg.kind(kind).statuses or (() if self.cfg.multikind else self.cfg.statuses)
        if statuses:
            made.keys[self.cfg.status_field] = "accepted" if "accepted" in statuses else statuses[0]
        for name, f in (*self.cfg.fields, *self.cfg.kind(kind).fields):
            if f.required:
                one = f.one_of[0] if f.one_of else "x"
                made.keys[name] = [one] * max(1, f.min_items) if f.type == "list" else one
        self.drafts.append(made)
        return made

    def end(self, edge: str, side: str) -> str:
        e = self.cfg.edge(edge)
        ends = () if e is None else e.sources if side == "in" else e.targets
        return ends[0] if ends else self.cfg.kind_items()[0][0]

    def join(self, edge: str, source: Draft, target: Draft) -> None:
        e = self.cfg.edge(edge)
        holder, other = (target, source) if e is not None and e.direction == "reverse" else (source, target)
        holder.edges.setdefault(edge, []).append(other.id)

    def meet(self, subject: Draft, fact: Fact) -> None:
        """Makes a fact true of the subject."""
        if fact.on == "attr":
            value = {"eq": fact.values[:1], "contains": fact.values[:1], "subset_of": fact.values[:1]}.get(fact.op)
            if fact.holds and value and fact.key not in ("kind", "in_force") and self.cfg.projection(fact.key) is None:
                subject.keys[fact.key] = list(value) if fact.op == "contains" else value[0]
        elif fact.holds and fact.on in ("in", "out"):
            for _ in range(fact.low):
                other = self.draft(self.end(fact.key, fact.on))
                self.join(fact.key, *((other, subject) if fact.on == "in" else (subject, other)))
        elif fact.holds:
            side = fact.on.split()[-1]
            other = self.draft(self.end(fact.key, side))
            for test in fact.values:
                key, op, value = test.split(" ", 2)
                if op == "eq":
                    self.meet(other, Fact("attr", key, "eq", (value,)))
                elif op == "not" and str(other.keys.get(key, "")).lower() == value.lower():
                    allowed = Analysis(self.cfg).domain(key, [other.kind]) or ["other"]
                    other.keys[key] = next((v for v in allowed if v.lower() != value.lower()), "other")
            self.join(fact.key, *((other, subject) if side == "in" else (subject, other)))

    def text(self, d: Draft) -> str:
        rows = ["---"]
        if self.cfg.multikind:
            rows += [f"id: {d.id}", f"kind: {d.kind}"]
        rows += [f"title: Fixture {d.id}", f"date: {self.day}"]
        rows += [f"{k}: [{', '.join(v)}]" if isinstance(v, list) else f"{k}: {v}" for k, v in d.keys.items() if k != "date"]
        for name, ids in d.edges.items():
            e = self.cfg.edge(name)
            need = [(n, a) for n, a in e.attrs if a.required] if e else []
            one = lambda i: f'{{ref: "{i}", ' + ", ".join(f"{n}: {(a.one_of or ({'number': '1', 'date': self.day}.get(a.type, 'x'),))[0]}" for n, a in need) + "}" if need else f'"{i}"'
            rows.append(f"{e.key if e else name}: [{', '.join(map(one, ids))}]")
        return "\n".join([*rows, "---", f"# Fixture {d.id}", ""])

    def files(self) -> Iterator[tuple[str, str, str]]:
        """path, kind, text."""
        for d in self.drafts:
            folder = self.cfg.kind(d.kind).dir if self.cfg.multikind else self.cfg.dir
            name = d.id.rsplit("/", 1)[-1] if self.cfg.multikind else f"{d.id}-fixture"
            yield f"{folder}/{name}.md", d.kind, self.text(d)


def breakable(alternative: frozenset[Fact]) -> Fact | None:
    """The fact that the silent side leaves out: an attribute that says what it is, else an edge."""
    held = sorted(f for f in alternative if f.holds and (f.on != "attr" or (f.op in ("eq", "contains", "subset_of") and f.key != "kind")) and f.low != 0 or f.on == "attr" and f.op in ("eq", "contains", "subset_of") and f.key != "kind")
    return next(iter([f for f in held if f.on != "attr"] + held), None)


def generate(cfg: Config, rule: str, day: str) -> dict[str, list[tuple[str, str, str]]]:
    """Files (path, kind, text) of both sides of a rule's fixture, from its first alternative that can hold."""
    analysis = Analysis(cfg)
    unit = analysis.unit("rules", rule)
    if unit is None:
        raise ConfigError(f"no rule {rule}")
    chosen = next((a for a in unit.alternatives if not analysis.impossible(a, unit.scope)), None)
    if chosen is None:
        raise ConfigError(f"rule {rule} can never hold")
    kinds = analysis.kinds(chosen, unit.scope)
    readers = [k for k, v in cfg.kind_items() if {f.key for f in chosen if f.on == "attr"} & dict(v.fields).keys()]
    kind = (kinds or readers or [cfg.kind_items()[0][0]])[0]
    out = {}
    for side in (FIRES, SILENT):
        maker = Maker(cfg, day)
        subject = maker.draft(kind)
        left = breakable(chosen) if side == SILENT else None
        for f in sorted(chosen):
            if f != left:
                maker.meet(subject, f)
        if left is not None and left.on == "attr":
            domain = analysis.domain(left.key, [kind]) or []
            other = next((v for v in domain if v.lower() not in {x.lower() for x in left.values}), "other")
            subject.keys[left.key] = other
        out[side] = list(maker.files())
    return out
