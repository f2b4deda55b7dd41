"""Configuration of a corpus: kinds, edges, rules and projections as plain data.

A configuration is read from a mapping (a YAML file or a preset), merged over a preset,
and validated on the driver; conditions are compiled to columns by ``conditions``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

RESERVED = ("title", "date", "id", "kind", "retracts")
IN_FORCE = "in_force"
OPS = ("eq", "not", "contains", "not_contains", "subset_of")
SEVERITIES = ("error", "warn", "info", "off")
ADR_NAME = re.compile(r"^[0-9]{3,6}(-[A-Za-z0-9-]+)?\.md$")
DAY = re.compile(r"^\d{4}-\d{2}-\d{2}$")


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass(frozen=True)
class AttrTest:
    op: str
    value: Any

    @classmethod
    def read(cls, raw: Any) -> AttrTest:
        if not isinstance(raw, Mapping) or len(raw) != 1 or next(iter(raw)) not in OPS:
            raise ConfigError(f"an attribute test has one of {', '.join(OPS)}: {raw!r}")
        op, value = next(iter(raw.items()))
        return cls(op, tuple(map(str, value)) if op == "subset_of" else str(value))


@dataclass(frozen=True)
class Degree:
    edge: str
    least: int = 1
    most: int | None = None

    @classmethod
    def read(cls, raw: Any) -> Degree:
        if isinstance(raw, str):
            return cls(raw)
        if set(raw) - {"edge", "min", "max"} or "edge" not in raw:
            raise ConfigError(f"a degree has edge, min and max: {raw!r}")
        if raw.get("max") == 0:
            raise ConfigError("max: 0 is not_inbound or not_outbound")
        least, most = raw.get("min", 0 if "max" in raw else 1), raw.get("max")
        if most is not None and most < least:
            raise ConfigError(f"max is below min: {raw!r}")
        return cls(raw["edge"], least, most)


@dataclass(frozen=True)
class Via:
    edge: str
    attrs: tuple[tuple[str, AttrTest], ...]

    @classmethod
    def read(cls, raw: Mapping) -> Via:
        return cls(raw["edge"], tuple(sorted((k, AttrTest.read(v)) for k, v in raw.get("attr", {}).items())))


@dataclass(frozen=True)
class Condition:
    """All that is given holds together."""

    inbound: Degree | None = None
    not_inbound: str | None = None
    outbound: Degree | None = None
    not_outbound: str | None = None
    via: Via | None = None
    via_inbound: Via | None = None
    attr: tuple[tuple[str, AttrTest], ...] = ()
    any_of: tuple[Condition, ...] = ()
    negated: Condition | None = None

    @classmethod
    def read(cls, raw: Mapping) -> Condition:
        if unknown := set(raw) - {"inbound", "not_inbound", "outbound", "not_outbound", "via", "via_inbound", "attr", "any_of", "not"}:
            raise ConfigError(f"unknown clause: {', '.join(sorted(unknown))}")
        return cls(
            inbound=Degree.read(raw["inbound"]) if "inbound" in raw else None,
            not_inbound=raw.get("not_inbound"),
            outbound=Degree.read(raw["outbound"]) if "outbound" in raw else None,
            not_outbound=raw.get("not_outbound"),
            via=Via.read(raw["via"]) if "via" in raw else None,
            via_inbound=Via.read(raw["via_inbound"]) if "via_inbound" in raw else None,
            attr=tuple(sorted((k, AttrTest.read(v)) for k, v in raw.get("attr", {}).items())),
            any_of=tuple(cls.read(c) for c in raw.get("any_of", ())),
            negated=cls.read(raw["not"]) if "not" in raw else None,
        )

    def nested(self) -> Iterator[Condition]:
        yield self
        for c in (*self.any_of, *((self.negated,) if self.negated else ())):
            yield from c.nested()

    @property
    def empty(self) -> bool:
        return self == Condition()

    def edges(self) -> set[str]:
        found = set()
        for c in self.nested():
            found |= {d.edge for d in (c.inbound, c.outbound, c.via, c.via_inbound) if d}
            found |= {e for e in (c.not_inbound, c.not_outbound) if e}
        return found

    def attr_keys(self) -> set[str]:
        return {k for c in self.nested() for k in (*dict(c.attr), *(k for v in (c.via, c.via_inbound) if v for k, _ in v.attrs))}


@dataclass(frozen=True)
class EdgeAttr:
    required: bool = False
    type: str = "string"
    one_of: tuple[str, ...] = ()


@dataclass(frozen=True)
class Target:
    condition: Condition = Condition()
    leaf_of: str | None = None


@dataclass(frozen=True)
class Edge:
    name: str
    key: str = ""
    direction: str = "forward"
    acyclic: bool = False
    sources: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    max_inbound: int | None = None
    max_outbound: int | None = None
    min_outbound: int | None = None
    inverse: str | None = None
    attrs: tuple[tuple[str, EdgeAttr], ...] = ()
    target: Target | None = None
    require_mention: str = "off"
    appendable: bool = False


@dataclass(frozen=True)
class DerivedEdge:
    field: str
    pattern: str
    edge: str
    direction: str = "reverse"


@dataclass(frozen=True)
class Field:
    type: str = "scalar"
    one_of: tuple[str, ...] = ()
    required: bool = False
    min_items: int = 0
    deprecated: bool = False
    sunset: str | None = None
    replaced_by: str | None = None


@dataclass(frozen=True)
class Period:
    start: str = "date"
    until: str = "expires"


@dataclass(frozen=True)
class Section:
    heading: str
    level: int | None = None
    status: str | None = None


@dataclass(frozen=True)
class Kind:
    dir: str = ""
    id: str = ""
    statuses: tuple[str, ...] = ()
    closed: bool = False
    append_only: bool = False
    fields: tuple[tuple[str, Field], ...] = ()
    period: Period | None = None
    sections: tuple[Section, ...] = ()
    ordered_sections: bool = False


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    when: Condition
    message: str = ""


@dataclass(frozen=True)
class Projection:
    """Holds where any of its alternatives does."""

    name: str
    any_of: tuple[Condition, ...]


@dataclass(frozen=True)
class PathConstraint:
    name: str
    path: tuple[str, ...]
    subset_of: tuple[str, ...] | None = None  # None: no node may be reached
    severity: str = "error"


@dataclass(frozen=True)
class References:
    scan: tuple[str, ...] = ("body",)
    dangling: str = "off"


@dataclass(frozen=True)
class Config:
    preset: str = ""
    revision: int = 0
    dir: str = "docs/adr"
    id_width: int = 4
    status_field: str = "status"
    statuses: tuple[str, ...] = ()
    kinds: tuple[tuple[str, Kind], ...] = ()
    edges: tuple[Edge, ...] = ()
    derived_edges: tuple[DerivedEdge, ...] = ()
    fields: tuple[tuple[str, Field], ...] = ()
    period: Period | None = None
    sections: tuple[Section, ...] = ()
    ordered_sections: bool = False
    projections: tuple[Projection, ...] = ()
    binding: str = ""
    rules: tuple[Rule, ...] = ()
    path_constraints: tuple[PathConstraint, ...] = ()
    acyclic_union: tuple[str, ...] = ()
    references: References = References()
    severities: tuple[tuple[str, str], ...] = ()

    @property
    def multikind(self) -> bool:
        return bool(self.kinds)

    def kind(self, name: str) -> Kind:
        return dict(self.kinds).get(name, Kind(statuses=self.statuses, fields=self.fields, period=self.period, sections=self.sections, ordered_sections=self.ordered_sections))

    def kind_items(self) -> list[tuple[str, Kind]]:
        """Kinds in order of name; the one of a corpus without kinds is named "document"."""
        return sorted(self.kinds) if self.kinds else [("document", self.kind(""))]

    def edge(self, name: str) -> Edge | None:
        return next((e for e in self.edges if e.name == name), None)

    def projection(self, name: str) -> Projection | None:
        return next((p for p in self.projections if p.name == name), None)

    def binding_projection(self) -> Projection:
        return self.projection(self.binding) or default_binding(self.status_field)

    def vocabulary(self) -> list[str]:
        return list(dict.fromkeys(s for _, k in self.kind_items() for s in (k.statuses or self.statuses)))

    def severity(self, rule: str, standard: str) -> str:
        """Severities can only be raised."""
        own = dict(self.severities).get(rule)
        return own if own and SEVERITIES.index(own) < SEVERITIES.index(standard) else standard


def default_binding(status: str = "status") -> Projection:
    """Accepted, in force, and not replaced by a document that is accepted and in force or is itself replaced."""
    now = {status: {"eq": "accepted"}, IN_FORCE: {"eq": "true"}}
    replaced = [{"via_inbound": {"edge": "supersedes", "attr": now}}, {"via_inbound": {"edge": "supersedes", "attr": {status: {"eq": "superseded"}}}}]
    return Projection("accepted_unsuperseded", (Condition.read({"attr": now, "not": {"any_of": replaced}}),))


def read_edge(raw: Mapping) -> Edge:
    target = raw.get("target")
    return Edge(
        name=raw["name"],
        key=raw.get("key", raw["name"]),
        direction=raw.get("direction", "forward"),
        acyclic=raw.get("acyclic", False),
        sources=tuple(raw.get("from", ())),
        targets=tuple(raw.get("to", ())),
        max_inbound=raw.get("max_inbound"),
        max_outbound=raw.get("max_outbound"),
        min_outbound=raw.get("min_outbound"),
        inverse=raw.get("inverse"),
        attrs=tuple((k, EdgeAttr(v.get("required", False), v.get("type", "string"), tuple(v.get("one_of", ())))) for k, v in sorted(raw.get("attrs", {}).items())),
        target=Target(Condition.read({k: v for k, v in target.items() if k != "leaf_of"}), target.get("leaf_of")) if target else None,
        require_mention=raw.get("require_mention", "off"),
        appendable=raw.get("appendable", False),
    )


def read_fields(raw: Mapping) -> tuple[tuple[str, Field], ...]:
    known = {f.name for f in fields(Field)}
    out = []
    for key, v in sorted(raw.items()):
        v = dict(v or {})
        if isinstance(v.get("deprecated"), Mapping):
            v |= {"deprecated": True, **{k: v["deprecated"].get(k) for k in ("sunset", "replaced_by")}}
        if bad := set(v) - known:
            raise ConfigError(f"field {key}: unknown {', '.join(sorted(bad))}")
        out.append((key, Field(**{k: tuple(x) if k == "one_of" else x for k, x in v.items()})))
    return tuple(out)


def read_period(raw: Mapping | None) -> Period | None:
    return Period(raw.get("from", "date"), raw.get("until", "expires")) if raw else None


def read_sections(raw: list | None) -> tuple[Section, ...]:
    return tuple(Section(s) if isinstance(s, str) else Section(s["heading"], s.get("level"), s.get("when", {}).get("status")) for s in raw or ())


def read_kind(raw: Mapping) -> Kind:
    return Kind(raw.get("dir", ""), raw.get("id", ""), tuple(raw.get("status_values", ())), raw.get("closed", False), raw.get("append_only", False), read_fields(raw.get("fields", {})), read_period(raw.get("period")), read_sections(raw.get("sections")), raw.get("ordered_sections", False))


def read_projection(raw: Mapping) -> Projection:
    return Projection(raw["name"], tuple(Condition.read(c) for c in (raw["any_of"] if "any_of" in raw else [raw["when"]])))


#: ``acyclic_union: true``: all acyclic edges that the merged configuration has.
ALL = ("*",)

READERS = {
    "preset": ("preset", str),
    "preset_version": ("revision", int),
    "dir": ("dir", str),
    "id_width": ("id_width", int),
    "status_field": ("status_field", str),
    "status_values": ("statuses", tuple),
    "kinds": ("kinds", lambda raw: tuple((k, read_kind(v)) for k, v in sorted(raw.items()))),
    "edges": ("edges", lambda raw: tuple(map(read_edge, raw))),
    "derived_edges": ("derived_edges", lambda raw: tuple(DerivedEdge(**d) for d in raw)),
    "fields": ("fields", read_fields),
    "period": ("period", read_period),
    "sections": ("sections", read_sections),
    "ordered_sections": ("ordered_sections", bool),
    "projections": ("projections", lambda raw: tuple(map(read_projection, raw))),
    "binding": ("binding", str),
    "rules": ("rules", lambda raw: tuple(Rule(r["name"], r.get("severity", "warn"), Condition.read(r["when"]), r.get("message", "")) for r in raw)),
    "path_constraints": ("path_constraints", lambda raw: tuple(PathConstraint(p["name"], tuple(p["path"]), tuple(p["subset_of"]) if "subset_of" in p else None, p.get("severity", "error")) for p in raw)),
    "acyclic_union": ("acyclic_union", lambda raw: ALL if raw is True else tuple(raw or ())),
    "references": ("references", lambda raw: References(tuple(raw.get("scan", ("body",))), raw.get("dangling", "off"))),
    "structural": ("severities", lambda raw: tuple(sorted(raw.items()))),
}


def read(raw: Mapping | None, base: Config | None = None) -> Config:
    """A configuration from a mapping, over ``base``: what is given replaces it, lists as a whole."""
    raw = raw or {}
    if unknown := set(raw) - set(READERS):
        raise ConfigError(f"unknown key: {', '.join(sorted(unknown))}")
    given = {READERS[k][0]: READERS[k][1](v) for k, v in raw.items()}
    base = base if base is not None else presets()[given.get("preset") or "adr"]
    merged = replace(base, **given)
    if merged.acyclic_union == ALL:
        merged = replace(merged, acyclic_union=tuple(e.name for e in merged.edges if e.acyclic))
    if merged.status_field != base.status_field and "projections" not in given:
        merged = replace(merged, projections=tuple(default_binding(merged.status_field) if p == default_binding(base.status_field) else p for p in base.projections))
    if "edges" in given and "projections" not in given:  # inherited projections over edges that are gone
        names = {e.name for e in merged.edges}
        merged = replace(merged, projections=tuple(p for p in merged.projections if all(c.edges() <= names for c in p.any_of)))
    validate(merged)
    return merged


def load(text: str) -> Config:
    """A configuration from YAML; what it leaves open comes from its preset."""
    import yaml

    return read(yaml.safe_load(text))


def projection_order(cfg: Config) -> list[Projection]:
    """Projections after those that they read; those on a cycle are left out and hold nowhere."""
    left = {p.name: p for p in cfg.projections}
    names = set(left)
    done: list[Projection] = []
    while ready := [p for p in left.values() if not (set().union(*(c.attr_keys() for c in p.any_of)) & names) - {d.name for d in done}]:
        done += ready
        for p in ready:
            del left[p.name]
    return done


def validate(cfg: Config) -> None:
    def need(ok: Any, message: str) -> None:
        if not ok:
            raise ConfigError(message)

    names = [e.name for e in cfg.edges]
    need(len(set(names)) == len(names), "two edges have one name")
    keys = [k for e in cfg.edges for k in (e.key, e.inverse) if k]
    need(len(set(keys)) == len(keys), "two edges share a key")
    for e in cfg.edges:
        need(e.direction in ("forward", "reverse"), f"edge {e.name}: direction")
        need(e.key not in RESERVED, f"edge {e.name}: {e.key} is reserved")
        need(not cfg.kinds or set(e.sources) | set(e.targets) <= set(dict(cfg.kinds)), f"edge {e.name}: unknown kind")
        need(all(a.type in ("string", "number", "date") for _, a in e.attrs), f"edge {e.name}: attribute type")
        if e.target:
            need(e.target.leaf_of is None or e.target.leaf_of in names, f"edge {e.name}: leaf_of")
            check_condition(cfg, e.target.condition, f"edge {e.name}")
    for d in cfg.derived_edges:
        need(d.edge in names, f"derived edge: unknown {d.edge}")
        need(re.compile(d.pattern).groups >= 1, f"derived edge: {d.pattern} captures nothing")
    for _, k in cfg.kinds:
        re.compile(k.id)
    for where in [cfg.fields, *(k.fields for _, k in cfg.kinds)]:
        for key, f in where:
            need(f.type in ("scalar", "list"), f"field {key}: type")
            need(f.sunset is None or DAY.match(f.sunset), f"field {key}: sunset")
            need(f.min_items == 0 or f.type == "list", f"field {key}: min_items")
    projections = [p.name for p in cfg.projections]
    need(len(set(projections)) == len(projections), "two projections have one name")
    need(IN_FORCE not in projections, f"{IN_FORCE} is reserved")
    need(len(projection_order(cfg)) == len(projections), "projections depend on each other in a circle")
    need(not cfg.binding or cfg.binding in projections or not projections, f"binding: unknown {cfg.binding}")
    for p in cfg.projections:
        for c in p.any_of:
            check_condition(cfg, c, f"projection {p.name}")
    for r in cfg.rules:
        need(r.severity in SEVERITIES, f"rule {r.name}: severity")
        need(not r.when.empty, f"rule {r.name}: empty condition")
        check_condition(cfg, r.when, f"rule {r.name}")
    for p in cfg.path_constraints:
        need(1 <= len(p.path) <= 2 and {s.lstrip("^") for s in p.path} <= set(names), f"path {p.name}: one or two edges")
        need(p.subset_of is None or {s.lstrip("^") for s in p.subset_of} <= set(names), f"path {p.name}: subset_of")
    need(set(cfg.acyclic_union) <= set(names), "acyclic_union: unknown edge")
    need(all(v in SEVERITIES for _, v in cfg.severities), "structural: severity")


def check_condition(cfg: Config, condition: Condition, where: str) -> None:
    if unknown := condition.edges() - {e.name for e in cfg.edges}:
        raise ConfigError(f"{where}: unknown edge {', '.join(sorted(unknown))}")


MODALITIES = ("MUST", "MUST_NOT", "SHOULD", "SHOULD_NOT", "MAY")
_CACHE: dict[str, Config] = {}


def presets() -> dict[str, Config]:
    """The two built-in configurations: decision records, and a specification of clauses."""
    if not _CACHE:
        _CACHE["adr"] = _adr()
        _CACHE["spec"] = _spec()
    return _CACHE


def _adr() -> Config:
    projection = default_binding()
    cfg = read(
        {
            "preset": "adr",
            "preset_version": 3,
            "status_values": ["proposed", "accepted", "rejected", "deprecated", "superseded", "withdrawn"],
            "edges": [{"name": "supersedes", "acyclic": True}, {"name": "depends-on", "acyclic": True}],
            "derived_edges": [{"field": "status", "pattern": r"(?i)^superseded[\s-]+by[\s-]+(\S+)", "edge": "supersedes"}],
            "rules": [
                {"name": "status_drift", "severity": "error", "when": {"via_inbound": {"edge": "supersedes", "attr": {"status": {"subset_of": ["accepted", "superseded"]}}}, "attr": {"status": {"not": "superseded"}}}, "message": "is superseded by a document, but its status does not say so"},
                {"name": "superseded_orphan", "severity": "warn", "when": {"not_inbound": "supersedes", "attr": {"status": {"eq": "superseded"}}}, "message": "says that it is superseded, but no document supersedes it"},
            ],
        },
        Config(),
    )
    return replace(cfg, projections=(projection,), binding=projection.name)


def _spec() -> Config:
    def accepted(**more: str) -> dict:
        return {"status": {"eq": "accepted"}, **{k: {"eq": v} for k, v in more.items()}}

    def current(modality: str) -> dict:
        return accepted(in_force="true", modality=modality)

    strict = [{"attr": {"modality": {"eq": m}}} for m in ("MUST", "MUST_NOT")]
    open_ended = {"attr": {"has_inforce_successor": {"eq": "true"}}}
    clause = ["clause"]
    alternatives = lambda *cs: [{**c, "not": open_ended} for c in cs]
    return read(
        {
            "preset": "spec",
            "preset_version": 2,
            "kinds": {
                "clause": {"dir": "spec/clauses", "id": r"^UZ-[A-Z]-\d{3}$", "status_values": ["proposed", "trial", "accepted", "superseded", "withdrawn"], "closed": True, "fields": {"modality": {"one_of": MODALITIES, "required": True}, "in_force_from": {}, "in_force_until": {}}, "period": {"from": "in_force_from", "until": "in_force_until"}},
                "conform": {"dir": "spec/conform", "id": r"^conform/[a-z0-9-]+$", "append_only": True, "fields": {"test": {}}},
                "deviation": {"dir": "spec/deviations", "id": r"^dev-\d{4}$", "status_values": ["proposed", "accepted", "resolved", "withdrawn"], "closed": True, "fields": {"expires": {}}, "period": {"from": "date", "until": "expires"}},
                "measure": {"dir": "spec/measures", "id": r"^interp/UZ-[A-Z]-\d{3}@\d{4}-\d{2}-\d{2}$", "append_only": True},
                "premise": {"dir": "spec/premises", "id": r"^premise/[a-z0-9/-]+$", "status_values": ["proposed", "accepted", "retired", "superseded"], "fields": {"retired_on": {}}, "period": {"from": "date", "until": "retired_on"}},
                "principle": {"dir": "spec/principles", "id": r"^principle/[a-z0-9/-]+$", "status_values": ["proposed", "accepted", "superseded", "withdrawn"]},
                "pm": {"dir": "spec/pm", "id": r"^pm-\d{4}$", "status_values": ["draft", "published"]},
                "topic": {"dir": "spec/topics", "id": r"^topic/[a-z0-9/-]+$"},
            },
            "edges": [
                {"name": "supersedes", "acyclic": True, "from": ["clause", "premise"], "to": ["clause", "premise"], "attrs": {"reason": {"required": True, "one_of": ["correction", "evolution", "withdrawal"]}}},
                {"name": "enforces", "from": ["conform"], "to": clause, "target": {"leaf_of": "supersedes"}},
                {"name": "deviates-from", "from": ["deviation"], "to": clause, "target": {"attr": accepted(), "leaf_of": "supersedes"}},
                {"name": "premise", "from": clause, "to": ["premise"]},
                {"name": "rationale", "from": clause, "to": ["principle"]},
                {"name": "counterexample", "from": ["clause", "principle"], "to": ["pm"]},
                {"name": "measures", "from": ["measure"], "to": clause, "attrs": {"agreement": {"required": True, "type": "number"}, "model": {"required": True}}, "target": {"leaf_of": "supersedes"}},
                {"name": "about", "from": clause, "to": ["topic"], "min_outbound": 1},
                {"name": "excepts", "acyclic": True, "from": clause, "to": clause, "attrs": {"scope": {"required": True}}},
                {"name": "interop", "from": clause, "to": clause},
            ],
            "projections": [
                {"name": "enforced", "when": {"inbound": "enforces"}},
                {"name": "has_inforce_successor", "when": {"via_inbound": {"edge": "supersedes", "attr": accepted(in_force="true")}}},
                {"name": "effective_must", "any_of": alternatives(*({"attr": current(m), "inbound": "enforces"} for m in ("MUST", "MUST_NOT")))},
                {"name": "effective_should", "any_of": alternatives({"attr": current("SHOULD")}, {"attr": current("SHOULD_NOT")}, *({"attr": current(m), "not_inbound": "enforces"} for m in ("MUST", "MUST_NOT")))},
                {"name": "effective", "any_of": [{"attr": {"effective_must": {"eq": "true"}}}, {"attr": {"effective_should": {"eq": "true"}}}, *alternatives({"attr": current("MAY")})]},
            ],
            "binding": "effective",
            "rules": [
                {"name": "orphan_must", "severity": "error", "when": {"any_of": strict, "attr": accepted(), "not_inbound": "enforces"}, "message": "binds, but no conformance test enforces it"},
                {"name": "orphan_test", "severity": "error", "when": {"attr": {"kind": {"eq": "conform"}}, "not_outbound": "enforces"}, "message": "enforces no clause"},
                {"name": "stale_premise", "severity": "error", "when": {"attr": accepted(), "via": {"edge": "premise", "attr": {"in_force": {"eq": "false"}}}}, "message": "rests on a premise that is not in force"},
                {"name": "deviation_pressure", "severity": "warn", "when": {"attr": accepted(), "inbound": {"edge": "deviates-from", "min": 5}}, "message": "has five deviations or more"},
                {"name": "no_counterexample", "severity": "warn", "when": {"attr": accepted(kind="clause"), "not_outbound": "counterexample"}, "message": "names no counterexample"},
                {"name": "may_without_interop", "severity": "warn", "when": {"attr": accepted(modality="MAY"), "not_outbound": "interop"}, "message": "permits without saying what holds for others"},
                {"name": "interop_not_must", "severity": "error", "when": {"outbound": "interop", "via": {"edge": "interop", "attr": {"modality": {"not": "MUST"}}}}, "message": "relies on a clause that is no MUST"},
                {"name": "status_drift", "severity": "error", "when": {"attr": {"status": {"not": "superseded"}}, "via_inbound": {"edge": "supersedes", "attr": accepted(in_force="true")}}, "message": "has a successor in force, but its status does not say so"},
                {"name": "pending_successor", "severity": "warn", "when": {"attr": accepted(), "inbound": "supersedes", "not": open_ended}, "message": "has a successor that is not in force yet"},
                {"name": "premature_superseded", "severity": "error", "when": {"attr": {"status": {"eq": "superseded"}}, "not": open_ended}, "message": "says that it is superseded before a successor is in force"},
            ],
        },
        Config(status_field="status"),
    )
