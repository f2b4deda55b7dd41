"""Reachability, lineage, cycles and depth as iterated joins.

Every round writes its state to the shared folder: lineage stays short and an executor
that is lost costs a stage, not the loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby
from operator import and_, itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewright.operators.corpus import Corpus
from tracewright.scratch import stored


def steps(edges: DataFrame, types: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """src and dst of the edges of some types, once each."""
    chosen = edges if types is None else edges.where(F.col("type").isin(types))
    return chosen.select("dst", "src").toDF("src", "dst").distinct() if reverse else chosen.select("src", "dst").distinct()


def reachable(pairs: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """start, id of what each start (column id) reaches, itself left out; with the shortest way's depth, if one is given as a bound.

    Without a bound, steps double: a round joins what is reached so far with all ways of exactly as many steps as
    the rounds before have covered, so a way of n steps takes about log n rounds.
    """
    pairs = stored(pairs)
    if depth is not None:
        return within(pairs, starts, depth)
    seen = stored(starts.select(F.col("id").alias("start"), "id").distinct())
    jumps = pairs.select("src", "dst")
    while True:
        further = seen.join(jumps, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        fresh = stored(further.join(seen, ["start", "id"], "left_anti"))
        if fresh.limit(1).count() == 0:
            return seen.where("start <> id")
        seen = stored(seen.unionByName(fresh))
        wide = jumps.alias("a").join(jumps.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        jumps = stored(wide.distinct())


def within(pairs: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, id, depth: what each start reaches in at most ``depth`` steps, by its shortest way."""
    frontier = stored(starts.select(F.col("id").alias("start"), "id").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for step in range(1, depth + 1):
        further = frontier.join(pairs, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        frontier = stored(further.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.unionByName(frontier)
    return seen.where("start <> id")


def closure(pairs: DataFrame) -> DataFrame:
    """src, dst of all pairs where one reaches the other, by squaring: a round joins the newest ways with all, so
    there are as many rounds as the longest path has bits, and no two old ways meet again."""
    paths = stored(pairs.select("src", "dst").distinct())
    new = paths
    while True:
        ahead = new.alias("a").join(paths.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        behind = paths.alias("a").join(new.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        new = stored(ahead.union(behind).distinct().join(paths, ["src", "dst"], "left_anti"))
        if new.limit(1).count() == 0:
            return paths
        paths = stored(paths.union(new))


def known(found: DataFrame, corpus: Corpus) -> DataFrame:
    """Walks go through unknown ids but report known ones."""
    return found.join(corpus.nodes.select("id"), "id", "left_semi")


def descendants(corpus: Corpus, starts: DataFrame, types: list[str] | None = None, depth: int | None = None) -> DataFrame:
    return known(reachable(steps(corpus.edges, types), starts, depth), corpus)


def ancestors(corpus: Corpus, starts: DataFrame, types: list[str] | None = None, depth: int | None = None) -> DataFrame:
    return known(reachable(steps(corpus.edges, types, reverse=True), starts, depth), corpus)


def cyclic(pairs: DataFrame) -> DataFrame:
    """Nodes on a cycle."""
    return strong_components(pairs).select("id")


def shrunk(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of edges without self-loops when nodes at loose ends go and chains get shorter; and the links taken out of chains.

    A node with one way in (from p) and one way out (to s) is taken out if its hash is above those of p and s, so no
    two neighbours go at once; an edge from p to s stands for it.
    """
    sides = rest.select(F.col("src").alias("id"), F.lit(None).cast("string").alias("p"), F.col("dst").alias("s")).union(rest.select("dst", "src", F.lit(None).cast("string")))
    node = sides.groupBy("id").agg(F.count("p").alias("n_in"), F.count("s").alias("n_out"), F.min("p").alias("p"), F.min("s").alias("s"))
    order = lambda c: F.xxhash64(F.col(c))
    link = (F.col("n_in") == 1) & (F.col("n_out") == 1) & (order("id") > order("p")) & (order("id") > order("s"))
    node = stored(node.select("id", "p", "s", ((F.col("n_in") > 0) & (F.col("n_out") > 0)).alias("live"), link.alias("link")))
    links = node.where("link").select("id", "p", "s")
    stays = node.where("live AND NOT link").select("id")
    kept = rest.join(stays.withColumnRenamed("id", "src"), "src", "left_semi").join(stays.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    short = links.where("p <> s").select(F.col("p").alias("src"), F.col("s").alias("dst"))
    return stored(kept.union(short).distinct()), links


def core_components(rest: DataFrame) -> DataFrame:
    """id, component of the components of more than one node, by colours: each node takes the smallest id that
    reaches it; what reaches that id back within its colour is its component; the rest goes on without it."""
    found: DataFrame | None = None
    while rest.limit(1).count():
        labels = stored(rest.select(F.col("src").alias("id")).union(rest.select("dst")).distinct().withColumn("label", F.col("id")))
        while True:
            told = rest.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("theirs"))
            near = labels.join(told, "id", "left").select("id", F.least("label", F.coalesce("theirs", "label")).alias("label"), (F.col("theirs") < F.col("label")).alias("moved"))
            near = stored(near)
            moved = near.where("moved").limit(1).count()
            labels = near.select("id", "label")
            if not moved:
                break
        own = rest.join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", F.col("a").alias("label"))
        own = stored(own)
        reached = frontier = stored(labels.where("id = label").select("id", "label"))
        while True:
            back = own.join(frontier.withColumnRenamed("id", "dst"), ["dst", "label"]).select(F.col("src").alias("id"), "label").distinct()
            frontier = stored(back.join(reached, ["id", "label"], "left_anti"))
            if frontier.limit(1).count() == 0:
                break
            reached = stored(reached.unionByName(frontier))
        several = reached.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
        members = reached.join(several, "label", "left_semi").select("id", F.col("label").alias("component"))
        found = members if found is None else found.unionByName(members)
        gone = reached.select("id")
        rest = stored(own.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
        n = rest.count()
        while n:  # loose ends that the components left behind
            rest = stored(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            left = rest.count()
            if left == n:
                break
            n = left
    return found if found is not None else rest.select(F.col("src").alias("id"), F.col("dst").alias("component"))


def spread_components(pairs: DataFrame) -> DataFrame:
    """``strong_components`` for parts of any size.

    Loose ends and chains go first, halving the longest chains every few rounds; components of what is left are
    found by colours; links come back where both their neighbours are in one component.  Every round is linear in
    the edges that are left.
    """
    every = stored(pairs.select("src", "dst").distinct())
    loops = every.where("src = dst").select("src")
    rest = stored(every.where("src <> dst"))
    n, taken = rest.count(), []
    while n:
        rest, links = shrunk(rest)
        taken.append(links)
        left = rest.count()
        if left == n:
            break
        n = left
    found = stored(core_components(rest))
    for links in reversed(taken):
        # a link between p and p makes a component of p at least
        alone = links.where("p = s").select(F.col("p").alias("id")).distinct().join(found.select("id"), "id", "left_anti")
        found = found.unionByName(alone.select("id", F.col("id").alias("component")))
        back = links.join(found.toDF("p", "a"), "p").join(found.toDF("s", "b"), "s").where("a = b").select("id", F.col("a").alias("component"))
        found = stored(found.unionByName(back))
    own = loops.select(F.col("src").alias("id")).join(found.select("id"), "id", "left_anti")
    found = found.unionByName(own.select("id", F.col("id").alias("component")))
    least = found.groupBy("component").agg(F.min("id").alias("least"))
    return found.join(least, "component").select("id", F.col("least").alias("component"))


#: Edges of a weakly connected part that one task may hold; larger parts are left to the rounds of joins.
HELD = 50_000


def stars(links: DataFrame) -> DataFrame:
    """a, b: each node of the undirected links (a > b, both bigint) and the least of those that it is connected with,
    by large and small stars in turn; the least ones themselves are left out."""
    rest = stored(links.distinct())
    while True:
        sides = rest.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(rest.select("b", F.lit(0), F.lit(1)))
        open_ = sides.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1")
        if open_.limit(1).count() == 0:
            return rest
        near = rest.select("b", "a").union(rest.select("a", "b")).toDF("b", "m").groupBy("b").agg(F.least("b", F.min("m")).alias("m"))
        large = stored(rest.join(near, "b").select("a", F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        rest = stored(small.union(least).distinct())


def parts(edges: DataFrame, held: int) -> tuple[DataFrame, DataFrame | None]:
    """edges (src, dst, mask) with part, the same for edges that are connected either way, of the parts of at most ``held``
    edges; and the edges of larger parts, if there are any.  A part may be several that share a hash."""
    edges = stored(edges)
    links = edges.select(F.xxhash64("src").alias("x"), F.xxhash64("dst").alias("y")).where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    told = edges.withColumn("a", F.xxhash64("src")).join(stars(links), "a", "left").select("src", "dst", "mask", F.coalesce("b", "a").alias("part"))
    told = stored(told)
    large = stored(told.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > held).select("part"))
    if large.limit(1).count() == 0:
        return told, None
    return told.join(large, "part", "left_anti"), told.join(large, "part", "left_semi").select("src", "dst", "mask")


def solved(told: DataFrame, solve: Callable[[list[tuple[str, str, int]]], Iterable[tuple]], shape: str) -> DataFrame:
    """Rows that ``solve`` makes of the src, dst and mask of each part."""
    schema = to_arrow_schema(StructType.fromDDL(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for _, group in groupby(rows, itemgetter(0)):
            out += solve([row[1:] for row in group])
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return stored(told.select("part", "src", "dst", "mask").repartition("part").sortWithinPartitions("part").mapInArrow(run, shape))


def components(arcs: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Strong components of more than one node, and nodes with an arc to themselves (Tarjan, without recursion)."""
    near: dict[str, list[str]] = {}
    for a, b in arcs:
        near.setdefault(a, []).append(b)
    at: dict[str, int] = {}
    low: dict[str, int] = {}
    waiting: list[str] = []
    on: set[str] = set()
    out: list[list[str]] = []
    for root in near:
        if root in at:
            continue
        at[root] = low[root] = len(at)
        waiting.append(root)
        on.add(root)
        way = [(root, iter(near[root]))]
        while way:
            node, rest = way[-1]
            step = next(rest, None)
            if step is None:
                way.pop()
                if way:
                    low[way[-1][0]] = min(low[way[-1][0]], low[node])
                if low[node] == at[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(waiting.pop())
                        on.discard(group[-1])
                    if len(group) > 1 or node in near.get(node, ()):
                        out.append(group)
            elif step not in at:
                at[step] = low[step] = len(at)
                waiting.append(step)
                on.add(step)
                way.append((step, iter(near.get(step, ()))))
            elif step in on:
                low[node] = min(low[node], at[step])
    return out


def strong_components(pairs: DataFrame, held: int = HELD) -> DataFrame:
    """id, component (its smallest id) of the nodes on cycles.

    Weakly connected parts of at most ``held`` edges are solved in one task each; larger ones by rounds of joins.
    """
    small, large = parts(pairs.select("src", "dst").distinct().withColumn("mask", F.lit(0).cast("bigint")), held)
    found = solved(small, lambda edges: [(i, min(group)) for group in components([e[:2] for e in edges]) for i in group], "id string, component string")
    return found if large is None else found.unionByName(spread_components(large.select("src", "dst")))


def first_cycle(pairs: list[tuple[str, str]], start: str) -> list[str]:
    """A deterministic cycle of a small component: the first back edge of a walk from its smallest id by sorted neighbours closes it."""
    near: dict[str, list[str]] = {}
    for a, b in sorted(pairs):
        near.setdefault(a, []).append(b)
    path, at, open_, done = [start], {start: 0}, [iter(near.get(start, []))], set()
    while path:
        step = next(open_[-1], None)
        if step is None:
            open_.pop()
            node = path.pop()
            del at[node]
            done.add(node)
        elif step in at:
            return [*path[at[step] :], step]
        elif step not in done:
            at[step] = len(path)
            path.append(step)
            open_.append(iter(near.get(step, [])))
    return []


def cycle_paths(pairs: DataFrame) -> DataFrame:
    """component, path: one cycle of each strong component, found where the component's own edges are together."""
    members = strong_components(pairs)
    a = members.select(F.col("id").alias("src"), "component")
    b = members.select(F.col("id").alias("dst"), F.col("component").alias("other"))
    inner = pairs.join(a, "src").join(b, "dst").where("component = other")
    whole = inner.groupBy("component").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    path = F.udf(lambda component, edges: first_cycle([(e["src"], e["dst"]) for e in edges], component), "array<string>")
    return whole.select("component", path("component", "edges").alias("path"))


def blocks(arcs: list[tuple[str, str]]) -> list[set[tuple[str, str]]]:
    """The arcs in groups that share a simple cycle of the undirected graph; each simple cycle of the arcs lies in one group."""
    near: dict[str, set[str]] = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    own = set(arcs)
    at: dict[str, int] = {}
    low: dict[str, int] = {}
    out: list[set[tuple[str, str]]] = []
    for root in near:
        if root in at:
            continue
        at[root] = low[root] = len(at)
        walk_, pending = [(root, None, iter(near[root]))], []
        while walk_:
            node, parent, rest = walk_[-1]
            step = next(rest, None)
            if step is None:
                walk_.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    if low[node] >= at[parent]:
                        group = set()
                        while (parent, node) not in group:
                            group.add(pending.pop())
                        out.append({arc for a, b in group for arc in ((a, b), (b, a)) if arc in own})
            elif step not in at:
                at[step] = low[step] = len(at)
                pending.append((node, step))
                walk_.append((step, node, iter(near[step])))
            elif step != parent and at[step] < at[node]:
                pending.append((node, step))
                low[node] = min(low[node], at[step])
    return out


def mixed_cycle(edges: list[tuple[str, str, int]]) -> list[str]:
    """The first simple cycle of a component whose masks AND to 0, by sorted starts and neighbours, or none.

    Blocks whose masks have a bit in common hold none and are left out.  The rest is
    a search among simple paths, which may take long in large dense blocks.
    """
    masks = {(a, b): mask for a, b, mask in edges if a != b}
    near: dict[str, list[str]] = {}
    for group in blocks(list(masks)):
        common = -1
        for arc in group:
            common &= masks[arc]
        if common == 0:
            for a, b in group:
                near.setdefault(a, []).append(b)
    near = {a: sorted(near[a]) for a in sorted(near)}
    for start in near:
        path, met, covers, open_ = [start], {start}, [-1], [iter(near[start])]
        while path:
            step = next(open_[-1], None)
            if step is None:
                open_.pop()
                covers.pop()
                met.discard(path.pop())
                continue
            mask = covers[-1] & masks[path[-1], step]
            if step == start:
                if mask == 0:
                    return [*path, start]
            elif step > start and step not in met:
                met.add(step)
                path.append(step)
                covers.append(mask)
                open_.append(iter(near.get(step, [])))
    return []


def mixed_cycles(edges: DataFrame, types: list[str]) -> DataFrame:
    """component, path: of each strong component of the types' union, one simple cycle that no single type covers, if there is one."""
    bits = reduce(lambda otherwise, x: F.when(F.col("type") == x[1], F.lit(1 << x[0]).cast("bigint")).otherwise(otherwise), enumerate(types), F.lit(0).cast("bigint"))
    members = strong_components(steps(edges, types))
    a = members.select(F.col("id").alias("src"), "component")
    b = members.select(F.col("id").alias("dst"), F.col("component").alias("other"))
    marked = edges.where(F.col("type").isin(types)).groupBy("src", "dst").agg(F.bit_or(bits).alias("mask"))
    inner = marked.join(a, "src").join(b, "dst").where("component = other")
    whole = inner.groupBy("component").agg(F.collect_list(F.struct("src", "dst", "mask")).alias("edges"), F.bit_and("mask").alias("common")).where("common = 0")
    path = F.udf(lambda edges: mixed_cycle([(e["src"], e["dst"], e["mask"]) for e in edges]), "array<string>")
    return whole.select("component", path("edges").alias("path")).where(F.size("path") > 0)


def part_cycles(edges: list[tuple[str, str, int]], types: list[str], alone: list[str], union: list[str]) -> list[tuple[str, list[str]]]:
    """type and path of what ``cycles`` finds in one part; an edge's mask has a bit for each of its types."""
    out = []
    for t in alone:
        bit = 1 << types.index(t)
        arcs = [(a, b) for a, b, mask in edges if mask & bit]
        for group in components(arcs):
            own = set(group)
            out.append((t, first_cycle([(a, b) for a, b in arcs if a in own and b in own], min(group))))
    if union:
        bits = [1 << types.index(t) for t in union]
        every = sum(bits)
        marked = [(a, b, mask & every) for a, b, mask in edges if mask & every]
        for group in components([e[:2] for e in marked]):
            own = set(group)
            inner = [e for e in marked if e[0] in own and e[1] in own]
            if reduce(and_, (mask for _, _, mask in inner)) == 0 and (path := mixed_cycle(inner)):
                out.append((" + ".join(union), path))
    return out


def cycles(edges: DataFrame, alone: list[str], union: list[str], held: int = HELD) -> DataFrame:
    """type, path: one cycle of each strong component of each type alone, and of the union of types where no single type
    covers a cycle; all of them from one pass over weakly connected parts, as in ``strong_components``."""
    types = list(dict.fromkeys([*alone, *union]))
    bits = reduce(lambda otherwise, x: F.when(F.col("type") == x[1], F.lit(1 << x[0]).cast("bigint")).otherwise(otherwise), enumerate(types), F.lit(0).cast("bigint"))
    small, large = parts(edges.where(F.col("type").isin(types)).groupBy("src", "dst").agg(F.bit_or(bits).alias("mask")), held)
    found = solved(small, lambda part: part_cycles(part, types, alone, union), "type string, path array<string>")
    if large is None:
        return found
    own = stored(large.withColumn("type", F.explode(F.array_compact(F.array(*(F.when(F.col("mask").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, t) for i, t in enumerate(types)))))).select("src", "dst", "type"))
    for t in alone:
        found = found.unionByName(cycle_paths(steps(own, [t])).select(F.lit(t).alias("type"), "path"))
    if union:
        found = found.unionByName(mixed_cycles(own, union).select(F.lit(" + ".join(union)).alias("type"), "path"))
    return found


def depths(pairs: DataFrame) -> DataFrame:
    """id, depth: edges on the longest path from each node that starts any; nodes that reach a cycle are left out."""
    pairs = stored(pairs.select("src", "dst").distinct())
    bad = cyclic(pairs)
    into = reachable(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), bad).select("id").union(bad).distinct()
    good = stored(pairs.join(into.select(F.col("id").alias("src")), "src", "left_anti"))
    layer = stored(good.select(F.col("src").alias("id")).distinct())
    found, n = layer.withColumn("depth", F.lit(1)), 1
    while True:
        n += 1
        layer = stored(good.join(layer.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct())
        if layer.limit(1).count() == 0:
            return found.groupBy("id").agg(F.max("depth").cast("bigint").alias("depth"))
        found = found.union(layer.withColumn("depth", F.lit(n)))


def resolve(corpus: Corpus, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where lineages lead.

    (start, id): the ends of the ways along successors that are accepted and in force, or
    superseded and lead to such; a start without one is its own.
    (start, id, predecessor, reason): the successors that were met but not followed.
    Starts on the way to a cycle are left out of both; ``cyclic`` names them.
    """
    nodes = corpus.dated.select("id", F.lower("status").alias("status"), "in_force")
    successors = steps(corpus.edges, ["supersedes"], reverse=True)
    successors = stored(successors.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("id").alias("src")), "src", "left_semi"))
    bad = cyclic(successors)
    into = reachable(successors.select(F.col("dst").alias("src"), F.col("src").alias("dst")), bad).select("id").union(bad).distinct()
    starts = starts.join(into, "id", "left_anti")
    ends = nodes.where("status = 'accepted' AND in_force").select("id")
    replaced = nodes.where("status = 'superseded'").select(F.col("id").alias("src"))
    back = successors.join(replaced, "src", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    leading = stored(ends.union(reachable(back, ends).select("id")).distinct())
    followed = stored(successors.join(leading.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    ways = reachable(followed, starts).select("start", "id").union(starts.select(F.col("id").alias("start"), "id"))
    ways = stored(ways)
    resolved = ways.join(followed.select(F.col("src").alias("id")).distinct(), "id", "left_anti").select("start", "id")
    skipped = successors.join(leading.withColumnRenamed("id", "dst"), "dst", "left_anti").join(nodes.select(F.col("id").alias("dst"), "status", "in_force"), "dst")
    reason = F.when((F.col("status") == "accepted") & ~F.col("in_force"), "not in force").otherwise(F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("unknown")))
    pending = ways.join(skipped, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id"), F.col("src").alias("predecessor"), reason.alias("reason")).distinct()
    return resolved, pending


def neighbours(corpus: Corpus, starts: DataFrame) -> DataFrame:
    """start, id, layer: one step either way over references and typed edges; typed stands before reference."""
    own = stored(starts.select(F.col("id").alias("start")).distinct())
    layers = [(corpus.edges, "typed")] + ([(corpus.refs, "reference")] if corpus.refs is not None else [])
    ways = F.inline(F.array(F.struct(F.col("src").alias("start"), F.col("dst").alias("id")), F.struct(F.col("dst").alias("start"), F.col("src").alias("id"))))
    near = [pairs.where("src <> dst").select(ways, F.lit(layer).alias("layer")).join(own, "start", "left_semi") for pairs, layer in layers]
    best = reduce(DataFrame.unionByName, near).groupBy("start", "id").agg(F.max("layer").alias("layer"))
    return known(best, corpus).select("start", "id", "layer")


def walk(edges: DataFrame, path: tuple[str, ...]) -> DataFrame:
    """src, dst of a path of one or two edge types; ^ goes against the edge."""
    out: DataFrame | None = None
    for step in path:
        pairs = steps(edges, [step.lstrip("^")], reverse=step.startswith("^"))
        out = pairs if out is None else out.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).distinct()
    assert out is not None
    return out
