"""Markdown documents with YAML frontmatter as a corpus.

Files are read by Spark; each is split, decoded and scanned in one pass (mapInArrow).
YAML numbers keep the text they were written with, and a key that stands twice is an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewright.functions import text as T
from tracewright.functions.identity import anchored, is_document_link, normalised, numbered_identity, shaped, unpadded
from tracewright.operators import checks
from tracewright.operators.corpus import FINDING, Corpus, first_declared
from tracewright.scratch import stored
from tracewright.operators.periods import by_kind
from tracewright.plans.config import ADR_NAME, Config

PARSED = "path string, name string, kind string, has_block boolean, fm string, key_lines map<string,int>, body string, body_line int, error string, error_line int, links array<struct<target:string,alias:string,line:int>>, headings array<struct<level:int,text:string,line:int>>"
#: The info string of a fence of backticks holds none.
FENCE = re.compile(r"^ {0,3}(?:(`{3,})(?=[^`]*$)|(~{3,}))")
HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
LINK = re.compile(r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]|\[([^\]]*)\]\(([^)\s]+)[^)]*\)")
EXEMPT = re.compile(r"^(_.*|\..*|readme\.md|index\.md|.*template.*\.md)$", re.I)


def split_block(text: str) -> tuple[str | None, str, int]:
    """The block between leading --- lines (None without), the body, and the body's first line number."""
    lines = text.removeprefix("\ufeff").split("\n")
    if lines[0].rstrip("\r") != "---":
        return None, text, 1
    for i, line in enumerate(lines[1:], 1):
        if line.rstrip("\r") == "---":
            return "".join(x + "\n" for x in lines[1:i]), "\n".join(lines[i + 1 :]), i + 2
    return None, text, 1


#: A line of a block that needs no YAML: a key with a plain word or words, a text in single quotes, a list of such words, or nothing.
WORDS = r"[A-Za-z0-9][A-Za-z0-9./_-]*(?: [A-Za-z0-9][A-Za-z0-9./_-]*)*"
PLAIN = re.compile(rf"([A-Za-z_][A-Za-z0-9_-]{{0,99}}):(?: +(?:({WORDS})|'([ -&(-~]*)'|\[({WORDS}(?:, {WORDS})*)?\]))? *")
#: What YAML takes for null or a boolean.
RESOLVED = frozenset(w for x in ("null", "true", "false", "yes", "no", "on", "off") for w in (x, x.title(), x.upper()))


def plain(block: str) -> tuple[dict, dict[str, int]] | None:
    """What ``decode`` gives for a block whose lines are all PLAIN; None for any other."""
    found: dict = {}
    lines: dict[str, int] = {}
    for i, row in enumerate(block.split("\n")[:-1], 2):
        m = PLAIN.fullmatch(row)
        if m is None:
            return None
        key, word, quoted, items = m.groups()
        if key in found or key in RESOLVED or word in RESOLVED:
            return None
        if word is not None:
            found[key] = word
        elif quoted is not None:
            found[key] = quoted
        elif items is not None:
            found[key] = items.split(", ")
            if not RESOLVED.isdisjoint(found[key]):
                return None
        else:
            found[key] = [] if row.rstrip().endswith("[]") else None
        lines[key] = i
    return (found, lines) if found else None


@cache
def literal() -> type:
    """A YAML loader that leaves numbers and days as text and takes no key twice."""
    import yaml

    class Literal(yaml.SafeLoader):
        pass

    kept = ("tag:yaml.org,2002:null", "tag:yaml.org,2002:bool", "tag:yaml.org,2002:merge")
    Literal.yaml_implicit_resolvers = {c: [r for r in rs if r[0] in kept] for c, rs in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    def mapping(loader, node, deep=False):
        seen = set()
        for key, _ in node.value:
            if key.value in seen:
                raise yaml.constructor.ConstructorError(None, None, f"key {key.value} stands twice", key.start_mark)
            seen.add(key.value)
        return yaml.SafeLoader.construct_mapping(loader, node, deep=True)

    Literal.add_constructor("tag:yaml.org,2002:map", mapping)
    return Literal


def decode(block: str) -> tuple[dict, dict[str, int]]:
    """The mapping of a block, all scalars as text, and the file line of each top-level key."""
    return plain(block) or decode_yaml(block)


def decode_yaml(block: str) -> tuple[dict, dict[str, int]]:
    import yaml

    loader = literal()(block)
    try:
        node = loader.get_single_node()
        if node is None:
            return {}, {}
        if not isinstance(node, yaml.MappingNode):
            raise yaml.YAMLError("the block is no mapping")
        lines: dict[str, int] = {}
        for key, _ in node.value:
            lines.setdefault(str(key.value), key.start_mark.line + 2)
        return {str(k): v for k, v in loader.construct_document(node).items()}, lines
    finally:
        loader.dispose()


def scan(body: str, first: int) -> tuple[list, list]:
    """Links and headings outside fenced and inline code."""
    links, headings, fence = [], [], None
    if "[" not in body and "#" not in body:
        return links, headings
    for i, line in enumerate(x.rstrip("\r") for x in body.split("\n")):
        m = FENCE.match(line)
        if fence is not None:
            run = line.strip()
            if m and run.strip(fence[0]) == "" and len(run) >= len(fence):
                fence = None
            continue
        if m:
            fence = m[1] or m[2]
            continue
        if m := HEADING.match(line):
            headings.append((len(m[1]), (m[2] or "").strip(), first + i))
        for m in LINK.finditer(re.sub(r"(`+).*?\1", "", line)):
            links.append((m[1], m[2], first + i) if m[1] is not None else (m[4], m[3], first + i))
    return links, headings


def parse_file(path: str, kind: str, content: bytes) -> tuple:
    text = content.decode("utf-8", errors="replace")
    block, body, body_line = split_block(text)
    fm, lines, error, at = {}, {}, None, None
    if block is not None:
        try:
            fm, lines = decode(block)
        except Exception as e:
            mark = getattr(e, "problem_mark", None)
            error, at = str(getattr(e, "problem", None) or e).split("\n")[0], (mark.line + 2 if mark else 2)
    links, headings = scan(body, body_line)
    return path, path.rsplit("/", 1)[-1], kind, block is not None, json.dumps(fm, ensure_ascii=False, default=str), lines, body, body_line, error, at, links, headings


def parsed(files: DataFrame) -> DataFrame:
    """files: path, kind, content."""

    shape = to_arrow_schema(StructType.fromDDL(PARSED))
    structs = {n: [f.name for f in shape.field(n).type.value_type] for n in ("links", "headings")}

    def column(field: pa.Field, values: tuple) -> pa.Array:
        if pa.types.is_map(field.type):
            values = [list(v.items()) for v in values]
        elif names := structs.get(field.name):
            values = [[dict(zip(names, x, strict=True)) for x in v] for v in values]
        return pa.array(values, field.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [parse_file(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([column(f, v) for f, v in zip(shape, zip(*rows, strict=True), strict=True)], schema=shape)

    return files.select("path", "kind", "content").mapInArrow(run, PARSED)


def read_files(spark: SparkSession, root: str, cfg: Config) -> DataFrame:
    """path (below root), kind and content of the Markdown files in the folders of the configuration; a missing folder is empty."""
    jvm = spark.sparkContext._jvm
    parts = []
    for kind, k in cfg.kind_items():
        folder = f"{root.rstrip('/')}/{k.dir if cfg.multikind else cfg.dir}".rstrip("/")
        where = jvm.org.apache.hadoop.fs.Path(folder)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
            parts.append(files.select(F.concat(F.lit((k.dir if cfg.multikind else cfg.dir) + "/"), F.element_at(F.split("path", "/"), -1)).alias("path"), F.lit(kind).alias("kind"), "content"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "path string, kind string, content binary")


def value(key: str) -> Column:
    return F.get_json_object("fm", f"$['{key}']")


def documents(files: DataFrame, cfg: Config) -> DataFrame:
    """Parsed files with id: from the name (one kind), or the key id or else the name, if the kind's pattern takes it."""
    docs = parsed(files)
    stem = F.regexp_replace("name", r"\.md$", "")
    if not cfg.multikind:
        managed = F.col("name").rlike(ADR_NAME.pattern)
        return docs.withColumn("managed", managed).withColumn("id", F.when(managed, numbered_identity(F.col("name"), cfg.id_width)))
    said = F.coalesce(value("id"), stem)
    pattern = by_kind(cfg, lambda k: F.lit(anchored(k.id)))
    return docs.withColumn("managed", F.lit(True)).withColumn("id", F.when(F.rlike(said, pattern), said))


ENTRIES = "array<string>"
#: JSON lists; a [[link]] is none.
LISTED = r'^\[(?!\[[^"\]])'


def entries(df: DataFrame, key: str) -> DataFrame:
    """pos and entry of each item under a key; one value is a list of one."""
    raw = value(key)
    items = F.when(raw.rlike(LISTED), F.from_json(raw, ENTRIES)).when(raw.isNotNull(), F.array(raw))
    return df.select("*", F.posexplode(items).alias("pos", "entry"))


def build(files: DataFrame, cfg: Config, as_of: str) -> Corpus:
    """The corpus of parsed files: nodes, edges, references, retractions and the findings of building it."""
    spark = files.sparkSession
    docs = stored(documents(files, cfg))
    managed = docs.where("managed")
    findings = [document_findings(docs, cfg)]
    nodes = build_nodes(managed, cfg)
    edges, bad = build_edges(managed, nodes, cfg)
    findings += bad
    kept, retractions, bad_retractions = retract(managed, edges, nodes, cfg)
    findings.append(bad_retractions)
    refs = build_refs(managed, nodes, cfg)
    build_findings = reduce(DataFrame.unionByName, [f for f in findings if f is not None], spark.createDataFrame([], FINDING))
    return Corpus(nodes, kept, cfg, as_of, refs=refs, retractions=retractions, documents=managed, build_findings=build_findings)


def load(spark: SparkSession, root: str, cfg: Config, as_of: str) -> Corpus:
    """The corpus below a folder; one without any document is an error."""
    corpus = build(read_files(spark, root, cfg), cfg, as_of)
    if corpus.nodes.limit(1).count() == 0:
        raise ValueError(f"no document below {root}")
    return corpus


def document_findings(docs: DataFrame, cfg: Config) -> DataFrame:
    def rows(where: Column, rule: str, detail: Column, line: Column) -> DataFrame:
        return checks.found(docs.where(where).withColumn("line", line), rule, cfg, detail)

    one = F.lit(1)
    parts = [
        rows(F.col("managed") & F.col("error").isNotNull(), "invalid_frontmatter", F.col("error"), F.col("error_line")),
        rows(F.col("managed") & ~F.col("has_block"), "missing_frontmatter", F.lit("has no block of keys"), one),
    ]
    if cfg.multikind:
        parts.append(rows(F.col("id").isNull() & F.col("error").isNull(), "id_mismatch", F.lit("has no identity of its kind"), one))
    else:
        parts.append(rows(~F.col("managed") & ~F.col("name").rlike(EXEMPT.pattern.replace("^(", "(?i)^(", 1)), "unmanaged_file", F.lit("is no document by its name"), one))
    return reduce(DataFrame.unionByName, parts)


def build_nodes(docs: DataFrame, cfg: Config) -> DataFrame:
    """One node for each id: of several documents, the last by path."""
    raw = F.from_json("fm", "map<string,string>")
    plain = F.map_filter(raw, lambda k, v: v.isNotNull() & ~v.rlike(LISTED) & ~v.startswith("{"))
    lists = F.transform_values(F.map_filter(raw, lambda k, v: v.rlike(LISTED)), lambda k, v: F.filter(F.from_json(v, ENTRIES), lambda x: ~x.startswith("{")))
    status = canonical_status(F.coalesce(value(cfg.status_field), F.lit("")), cfg)
    own = docs.where("id IS NOT NULL").withColumns({"plain": plain, "lists": lists, "status": status})
    fixed = F.create_map(F.lit("kind"), F.col("kind"), F.lit(cfg.status_field), F.col("status"))
    declared = F.when(F.map_contains_key("plain", "kind"), F.create_map(F.lit("declared_kind"), F.col("plain")["kind"])).otherwise(F.create_map().cast("map<string,string>"))
    rest = F.map_filter("plain", lambda k, v: ~k.isin("kind", cfg.status_field))
    own = own.withColumn("scalars", F.map_concat(rest, F.when(F.lit(cfg.multikind), F.map_filter(fixed, lambda k, v: v != "")).otherwise(F.map_filter(fixed, lambda k, v: (v != "") & (k != "kind"))), declared))
    row = F.struct("path", "kind", F.coalesce(value("title"), F.lit("")).alias("title"), "status", value("date").alias("date"), F.lit(1).alias("line"), "scalars", "lists", "key_lines")
    last = own.select("id", "path", row.alias("row")).groupBy("id").agg(F.max_by("row", "path").alias("row"))
    return last.select("id", "row.*")


def canonical_status(status: Column, cfg: Config) -> Column:
    """A word of the vocabulary as written; else what precedes a reference that a derived edge's pattern takes from it."""
    trimmed = F.trim(status)
    out = F.when(F.lower(trimmed).isin([w.lower() for w in cfg.vocabulary()]), trimmed)
    for d in cfg.derived_edges:
        if d.field == cfg.status_field:
            out = out.when(trimmed.rlike(d.pattern), F.lower(F.regexp_extract(trimmed, r"^([A-Za-z]+)", 1)))
    return out.otherwise(trimmed)


def build_edges(docs: DataFrame, nodes: DataFrame, cfg: Config) -> tuple[DataFrame, list[DataFrame]]:
    spark = docs.sparkSession
    own = docs.where("id IS NOT NULL")
    ids = nodes.select(F.col("id").alias("target"), unpadded(F.col("id")).alias("bare"))
    single = ids.groupBy("bare").agg(F.count("*").alias("same"), F.min("target").alias("meant")).where("same = 1")
    edges, findings = [], []
    base = ["id", "path", "kind", "key_lines", "fm"]
    for n, e in enumerate(cfg.edges):
        for key in (e.key, e.inverse):
            if key:
                raw = value(key)
                blank = own.where(F.map_contains_key("key_lines", key) & (raw.isNull() | (F.trim(raw) == "") | raw.isin("[]", "{}")))
                findings.append(checks.found(blank.withColumn("line", F.try_element_at("key_lines", F.lit(key))), "empty_edge", cfg, F.lit(f"{key} is there, but empty")))
        rows = entries(own.select(*base), e.key).where("entry IS NOT NULL")
        ref = F.when(F.col("entry").startswith("{"), F.get_json_object("entry", "$.ref")).when(~F.col("entry").rlike(LISTED), F.col("entry"))
        rows = rows.withColumns({"ref": ref, "line": F.try_element_at("key_lines", F.lit(e.key))})
        rows = rows.withColumn("dst", normalised(F.col("ref"), cfg, e)).withColumn("literal", F.coalesce("dst", F.trim("ref")))
        rows = rows.withColumn("bare", unpadded(F.col("literal"))).join(single, "bare", "left").join(ids.select(F.col("target").alias("literal"), F.lit(True).alias("known")), "literal", "left")
        padded = F.coalesce("known", F.lit(False)) == F.lit(False)
        wrong = padded & F.col("meant").isNotNull()
        findings.append(checks.found(rows.where(wrong), "padding_mismatch", cfg, F.format_string(f"{e.name} names %s; the document is %s", F.col("ref"), F.col("meant"))))
        unreal = rows.where(~wrong)
        findings.append(checks.found(unreal.where("ref IS NULL"), "dangling_ref", cfg, F.concat(F.lit(f"{e.name} has an entry that names nothing: "), F.col("entry"))))
        is_shaped = shaped(F.col("ref"), cfg)
        findings.append(checks.found(unreal.where(F.col("ref").isNotNull() & ~is_shaped), "invalid_ref", cfg, F.concat(F.lit(f"{e.name}: no identity: "), F.col("ref"))))
        findings.append(checks.found(unreal.where(F.col("ref").isNotNull() & is_shaped & F.col("dst").isNull()), "dangling_ref", cfg, F.concat(F.lit(f"{e.name}: no identity in "), F.col("ref"))))
        attrs = F.map_filter(F.from_json(F.when(F.col("entry").startswith("{"), F.col("entry")), "map<string,string>"), lambda k, v: (k != "ref") & v.isNotNull())
        good = unreal.where(F.col("dst").isNotNull() & is_shaped)
        seq = F.struct("path", F.lit(n).alias("n"), "pos")
        here, there = ("dst", "id") if e.direction == "reverse" else ("id", "dst")
        edges.append(good.select(F.col(here).alias("src"), F.col(there).alias("dst"), F.lit(e.name).alias("type"), F.lit("structured").alias("origin"), F.coalesce(attrs, F.create_map().cast("map<string,string>")).alias("attrs"), seq.alias("seq")))
    for n, d in enumerate(cfg.derived_edges):
        raw = F.regexp_extract(F.trim(value(d.field)), d.pattern, 1)
        found = own.select("*", normalised(raw, cfg, cfg.edge(d.edge)).alias("other")).where((raw != "") & F.col("other").isNotNull())
        here, there = ("other", "id") if d.direction == "reverse" else ("id", "other")
        seq = F.struct("path", F.lit(len(cfg.edges) + n).alias("n"), F.lit(0).alias("pos"))
        edges.append(found.select(F.col(here).alias("src"), F.col(there).alias("dst"), F.lit(d.edge).alias("type"), F.lit(f"derived:{d.field}").alias("origin"), F.create_map().cast("map<string,string>").alias("attrs"), seq.alias("seq")))
    if not edges:
        return spark.createDataFrame([], "src string, dst string, type string, origin string, attrs map<string,string>"), findings
    return first_declared(reduce(DataFrame.unionByName, edges)), findings


def retract(docs: DataFrame, edges: DataFrame, nodes: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges that are left, retractions that take effect (of accepted and superseded documents), findings on bad entries."""
    said = entries(docs.where("id IS NOT NULL").select("id", "path", "key_lines", "fm"), "retracts").withColumn("line", F.try_element_at("key_lines", F.lit("retracts")))
    item = F.when(F.col("entry").startswith("{"), F.col("entry"))
    said = said.withColumns({"src": normalised(F.get_json_object(item, "$.from"), cfg), "dst": normalised(F.get_json_object(item, "$.to"), cfg), "type": F.get_json_object(item, "$.edge")})
    ids = nodes.select("id")
    there = edges.select("src", "dst", "type").withColumn("real", F.lit(True))
    judged = said.join(there, ["src", "dst", "type"], "left").join(ids.select(F.col("id").alias("src"), F.lit(True).alias("src_known")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("dst_known")), "dst", "left")
    fits = F.coalesce(F.col("real") & F.col("src_known") & F.col("dst_known"), F.lit(False))
    bad = checks.found(judged.where(~fits), "invalid_retraction", cfg, F.concat(F.lit("retracts what is not there: "), F.col("entry")))
    effective = judged.where(fits).join(nodes.where(F.lower("status").isin("accepted", "superseded")).select("id"), "id", "left_semi")
    retractions = effective.select("src", "dst", "type", F.col("id").alias("by")).distinct()
    return edges.join(retractions, ["src", "dst", "type"], "left_anti"), retractions, bad


def build_refs(docs: DataFrame, nodes: DataFrame, cfg: Config) -> DataFrame:
    """src and dst of links in bodies (and of text in keys, if asked) that name a document."""
    links = docs.where("id IS NOT NULL").select(F.col("id").alias("src"), F.explode("links.target").alias("target"))
    if "frontmatter" in cfg.references.scan:
        keys = docs.where("id IS NOT NULL").select(F.col("id").alias("src"), F.explode(F.regexp_extract_all("fm", F.lit(r"\[\[([^\]|]+)"), F.lit(1))).alias("target"))
        links = links.unionByName(keys)
    name = F.substring_index("target", "#", 1)
    document = is_document_link(F.col("target")) | ~F.col("target").contains("://")
    stem = F.regexp_replace(name, r"(?i)\.md$", "")
    target = normalised(name, cfg) if not cfg.multikind else F.coalesce(normalised(name, cfg), normalised(F.regexp_extract(stem, "([^/]*)$", 1), cfg))
    return links.where(document & (name != "")).select("src", target.alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()


def is_heading(names: list[str], level: int | None) -> Callable[[Column], Column]:
    def fits(h: Column) -> Column:
        same = T.heading(h["text"]).isin(names)
        return same & (h["level"] == level) if level else same

    return fits


def section_findings(corpus: Corpus) -> DataFrame:
    """Required headings that are missing, and those out of their declared order."""
    cfg, parts = corpus.cfg, []
    assert corpus.documents is not None
    docs = corpus.documents.join(corpus.nodes.select("id", "status"), "id").withColumn("line", F.lit(1))
    for kind, k in cfg.kind_items():
        own = docs.where(F.col("kind") == kind) if cfg.multikind else docs
        for s in k.sections:
            names = [w.strip().rstrip(":").lower() for w in s.heading.split("|")]
            wanted = own.where(F.lower("status") == s.status.lower()) if s.status else own
            has = F.exists("headings", is_heading(names, s.level))
            parts.append(checks.found(wanted.where(~has), "missing_section", cfg, F.lit(f"has no section {s.heading}")))
        if k.ordered_sections and k.sections:
            places = F.create_map(*(F.lit(x) for i, s in enumerate(k.sections) for w in s.heading.split("|") for x in (w.strip().rstrip(":").lower(), i)))
            rows = own.select("id", "path", F.explode("headings").alias("h")).select("id", "path", F.col("h.line").alias("line"), F.col("h.text").alias("text"), F.try_element_at(places, T.heading(F.col("h.text"))).alias("place")).where("place IS NOT NULL")
            before = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
            late = rows.withColumn("top", F.max("place").over(before)).where("place < top")
            parts.append(checks.found(late, "section_order", cfg, F.concat(F.lit("stands too late: "), F.col("text"))))
    return checks.union(corpus, parts)
