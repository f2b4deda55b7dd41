"""New documents: what would be written, and writing it."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path
from string import Template

from pyspark.sql import functions as F

from tracewright.functions.identity import next_identity, normalised
from tracewright.operators.corpus import Corpus
from tracewright.plans.config import Config, ConfigError, Edge, EdgeAttr

#: Parts of a name and of a template; a template file may use the same names.
NAME = "{id}-{slug}.md"
RECORD = "---\ntitle: $title\nstatus: $status\ndate: $date\n$edges---\n\n# $title\n\n## Context and Problem Statement\n\n## Considered Options\n\n## Decision Outcome\n"
OF_KIND = "---\n${identity}kind: $kind\ntitle: $title\n${opening}date: $date\n$fields$edges---\n\n# $title\n"


@dataclass(frozen=True)
class Rewrite:
    path: str
    status: str
    content: bytes


@dataclass(frozen=True)
class Plan:
    id: str
    path: str
    content: bytes = b""
    rewrites: tuple[Rewrite, ...] = ()
    exists: bool = False

    def told(self) -> dict:
        """What reports tell of it."""
        return {"id": self.id, "path": self.path, "exists": self.exists, "rewrites": [{"path": r.path, "status": r.status} for r in self.rewrites]}


@dataclass(frozen=True)
class Request:
    title: str
    date: str
    id: str = ""
    kind: str = ""
    edges: dict[str, Sequence[str]] = field(default_factory=dict)


def slug(title: str) -> str:
    return "-".join(re.findall(r"[^\W_]+", title.lower()))


def file_name(cfg: Config, kind: str, identity: str, title: str, name: str = NAME) -> str:
    """A kind with a pattern is named by the identity's last segment, others by number and title."""
    if kind and cfg.kind(kind).id:
        return identity.rsplit("/", 1)[-1] + ".md"
    words = slug(title)
    if not words:
        name = re.sub(r"[-_]?\{slug\}[-_]?", "", name)
    return name.replace("{slug}", words).replace("{id}", identity)


def stub_value(a: EdgeAttr) -> str:
    return "|".join(a.one_of) if a.one_of else {"number": "number", "date": "YYYY-MM-DD"}.get(a.type, "string")


def edge_rows(cfg: Config, request: Request, ids: dict[str, str]) -> str:
    """Keys of the edges asked for, and comments for the others that the kind may declare."""
    if unknown := {n for n, refs in request.edges.items() if refs} - {e.name for e in cfg.edges}:
        raise ConfigError(f"no edge {min(unknown)} is declared")
    asked, stubs = [], []
    for e in cfg.edges:
        refs = request.edges.get(e.name, ())
        if refs:
            if need := [n for n, a in e.attrs if a.required]:
                raise ConfigError(f"edge {e.name} needs {need[0]} with each entry, which a new document can't know")
            asked.append(f"{e.key}:\n" + "".join(f'  - "{ids[r]}"\n' for r in refs))
        elif request.kind:
            stubs.append(stub(e, request.kind))
    return "".join(asked + stubs)


def stub(e: Edge, kind: str) -> str:
    own, other = (e.targets, e.sources) if e.direction == "reverse" else (e.sources, e.targets)
    if own and kind not in own:
        return ""
    target = f"<{'|'.join(other) or 'ref'}>"
    need = [f"{n}: <{stub_value(a)}>" for n, a in e.attrs if a.required]
    return f"# {e.key}:\n#   - " + ("{" + ", ".join([f"ref: {target}", *need]) + "}" if need else target) + "\n"


def field_rows(cfg: Config, kind: str) -> str:
    """Comments for fields that a document must write or that have a vocabulary."""
    own = sorted({**dict(cfg.fields), **dict(cfg.kind(kind).fields)}.items())
    return "".join(f"# {n}: <{'|'.join(f.one_of) or 'value'}>\n" for n, f in own if not f.deprecated and (f.required or f.one_of))


def with_status(content: bytes, key: str, status: str) -> bytes:
    """content with another status in its block; every other byte stays."""
    whole = re.match(rb"(?s)(\xef\xbb\xbf)?---(\r?\n)(.*?)(?=^---[ \t]*\r?$)", content, re.M)
    if whole is None:
        raise ConfigError("the document has no block of keys")
    start, end, new = whole.start(3), whole.end(3), f"{key}: {status}".encode()
    block, n = re.subn(rb"(?m)^" + re.escape(key.encode()) + rb":[^\r\n]*", lambda m: new, content[start:end], count=1)
    if not n:
        block += new + whole[2]
    return content[:start] + block + content[end:]


def plan(c: Corpus, root: str, request: Request, template: str | None = None) -> Plan:
    """What making a document would write: the file, and the status of those that it supersedes."""
    cfg = c.cfg
    if c.build_findings is not None and c.build_findings.where("rule = 'id_collision'").limit(1).count():
        raise ConfigError("two documents have one identity")
    if request.kind and (not cfg.multikind or request.kind not in dict(cfg.kinds)):
        raise ConfigError(f"no kind {request.kind}")
    refs = sorted({r for own in request.edges.values() for r in own})
    known = resolved_refs(c, refs)
    if lost := [r for r in refs if r not in known]:
        raise ConfigError(f"no document {lost[0]}")
    identity = own_identity(c, request)
    there = c.nodes.where(F.col("id") == identity).select("path", "title").head()
    if there is not None:
        if there["title"].strip() != request.title.strip():
            raise ConfigError(f"{identity} has the title {there['title']!r}")
        return Plan(identity, there["path"], exists=True)
    status = "proposed" if not request.kind else next(iter(cfg.kind(request.kind).statuses), "")
    values = {
        "id": identity, "kind": request.kind, "title": request.title, "date": request.date, "status": status,
        "identity": f"id: {identity}\n" if request.kind and cfg.kind(request.kind).id else "",
        "opening": f"{cfg.status_field}: {status}\n" if status else "",
        "fields": field_rows(cfg, request.kind) if request.kind else "",
        "edges": edge_rows(cfg, request, {r: i for r, (i, _) in known.items()}),
    }
    text = Template(template or (OF_KIND if request.kind else RECORD.replace("status:", f"{cfg.status_field}:"))).substitute(values)
    folder = cfg.kind(request.kind).dir if request.kind else cfg.dir
    rewrites = []
    for ref in request.edges.get("supersedes", ()):
        path = known[ref][1]
        rewrites.append(Rewrite(path, "superseded", with_status((Path(root) / path).read_bytes(), cfg.status_field, "superseded")))
    return Plan(identity, f"{folder}/{file_name(cfg, request.kind, identity, request.title)}", text.encode(), tuple(rewrites))


def resolved_refs(c: Corpus, refs: list[str]) -> dict[str, tuple[str, str]]:
    """Identity and path of each reference that names a document; as many as a request has."""
    if not refs:
        return {}
    asked = c.spark.createDataFrame([(r,) for r in refs], "ref string").withColumn("id", normalised(F.col("ref"), c.cfg))
    return {r["ref"]: (r["id"], r["path"]) for r in asked.join(c.nodes.select("id", "path"), "id").collect()}


def own_identity(c: Corpus, request: Request) -> str:
    cfg = c.cfg
    pattern = cfg.kind(request.kind).id if request.kind else ""
    if not request.id:
        if pattern:
            raise ConfigError(f"identities of kind {request.kind} are not counted; name one")
        own = c.nodes.where(F.col("kind") == request.kind) if request.kind else c.nodes
        return own.agg(next_identity(F.col("id"), cfg.id_width)).first()[0]
    if pattern:
        if not re.fullmatch(pattern.removeprefix("^").removesuffix("$"), request.id.strip()):
            raise ConfigError(f"{request.id} is no identity of kind {request.kind}")
        return request.id.strip()
    found = c.spark.range(1).select(normalised(F.lit(request.id), cfg)).first()[0]
    if found is None:
        raise ConfigError(f"{request.id} is no identity")
    return found


def apply(made: Plan, root: str) -> str:
    """Writes a plan: the new file, which must not be there yet, then the rewrites, which keep their modes."""
    if made.exists:
        return made.path
    path = Path(root) / made.path
    with open(path, "xb") as f:
        f.write(made.content)
    for r in made.rewrites:
        target = Path(root) / r.path
        mode = stat.S_IMODE(target.stat().st_mode)
        target.write_bytes(r.content)
        os.chmod(target, mode)
    return made.path
