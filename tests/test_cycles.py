import random
from itertools import permutations

from tracewright.operators import graph


def first_mixed(edges):
    """By trying all simple cycles, in order of their nodes, from the smallest."""
    masks = {(a, b): m for a, b, m in edges}
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    ways = sorted((p for n in range(2, len(nodes) + 1) for p in permutations(nodes, n) if p[0] == min(p)), key=lambda p: p)
    found = []
    for p in ways:
        arcs = list(zip(p, (*p[1:], p[0]), strict=True))
        if all(arc in masks for arc in arcs):
            common = -1
            for arc in arcs:
                common &= masks[arc]
            if common == 0:
                found.append([*p, p[0]])
    return found


def test_mixed_cycle_against_all_cycles():
    rng = random.Random(4)
    for _ in range(300):
        names = "abcdef"[: rng.randint(2, 6)]
        edges = [(a, b, rng.choice([1, 1, 1, 2, 3, 4, 5])) for a in names for b in names if rng.random() < 0.35]
        got, want = graph.mixed_cycle(edges), first_mixed(edges)
        assert got in want if want else got == []
        assert not want or got[0] == min(w[0] for w in want)


def test_mixed_cycle_shares_a_node_with_a_cycle_of_one_type(spark):
    rows = [("A", "B", "t1"), ("B", "A", "t2"), ("A", "C", "t1"), ("C", "A", "t1")]  # the mixed one shares A
    rows += [("P", "Q", "t1"), ("Q", "P", "t1"), ("Q", "R", "t2"), ("R", "Q", "t2")]  # two of one type each, none mixed
    rows += [("X", "Y", "t1"), ("Y", "X", "t1"), ("X", "Y", "t2"), ("Y", "Z", "t3"), ("Z", "X", "t3")]
    edges = spark.createDataFrame(rows, "src string, dst string, type string")
    assert [(r.component, r.path) for r in graph.mixed_cycles(edges, ["t1", "t2"]).collect()] == [("A", ["A", "B", "A"])]
    got = sorted((r.component, r.path) for r in graph.mixed_cycles(edges, ["t1", "t2", "t3"]).collect())
    assert got == [("A", ["A", "B", "A"]), ("X", ["X", "Y", "Z", "X"])]


def brute_components(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    reach = {}
    for start in {x for e in edges for x in e}:
        seen, todo = set(), [start]
        while todo:
            for n in near.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        reach[start] = seen
    return {a: min(b for b in reach[a] if a in reach[b]) for a in reach if a in reach[a]}, {(a, b) for a in reach for b in reach[a]}


def test_components_and_reach_against_brute_force(spark):
    """Random graphs, long rings with chords, rings joined by chains, and loops, all in one."""
    import random

    rng = random.Random(4)
    edges = set()
    for g, (n, m) in enumerate([(12, 14), (20, 30), (8, 20)]):
        edges |= {(f"g{g}-{rng.randrange(n):02}", f"g{g}-{rng.randrange(n):02}") for _ in range(m)}
    edges |= {(f"r{i:02}", f"r{(i + 1) % 40:02}") for i in range(40)} | {("r05", "r30"), ("s0", "s0"), ("r07", "c0")}
    edges |= {(f"c{i}", f"c{i + 1}") for i in range(9)} | {("c9", "d0"), ("d0", "d1"), ("d1", "d0"), ("e0", "e1"), ("e1", "e0"), ("e1", "e1")}
    components, closure = brute_components(edges)
    pairs = spark.createDataFrame(sorted(edges), "src string, dst string")
    assert {r.id: r.component for r in graph.strong_components(pairs).collect()} == components
    starts = spark.createDataFrame([("r00",), ("c3",), ("g1-00",), ("d1",)], "id string")
    got = {(r.start, r.id) for r in graph.reachable(pairs, starts).collect()}
    assert got == {(a, b) for a, b in closure if a in {"r00", "c3", "g1-00", "d1"} and a != b}
    own = pairs.where("src LIKE 'c%' OR src LIKE 'd%'")
    assert {tuple(r) for r in graph.closure(own).collect()} == {(a, b) for a, b in closure if a[0] in "cd"}
    none = spark.createDataFrame([], "src string, dst string")
    assert graph.strong_components(none).collect() == [] and graph.closure(none).collect() == []
