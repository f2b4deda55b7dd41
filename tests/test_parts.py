import random

from tracewright.operators import graph

SHAPE = "src string, dst string, type string"


def drawn(seed):
    """Random parts of three types, a ring with a chord, a chain and a loop."""
    rng, rows = random.Random(seed), set()
    for part in range(5):
        names = [f"p{part}-{i}" for i in range(rng.randint(2, 9))]
        rows |= {(rng.choice(names), rng.choice(names), rng.choice("xyz")) for _ in range(rng.randint(1, 14))}
    ring = [f"r{i:02}" for i in range(7)]
    rows |= {(a, b, "xy"[i % 2]) for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True))} | {("r03", "r01", "z")}
    return sorted(rows | {(f"c{i:02}", f"c{i + 1:02}", "x") for i in range(6)} | {("l", "l", "y")})


def test_cycles_of_held_and_of_spread_parts_agree(spark):
    edges = spark.createDataFrame(drawn(5), SHAPE)
    way = lambda held: sorted((r.type, tuple(r.path)) for r in graph.cycles(edges, ["x", "z"], ["x", "y"], held).collect())
    held = way(1000)
    assert {t for t, _ in held} == {"x", "z", "x + y"} and held == way(5)
    alone = sorted(tuple(r.path) for r in graph.cycle_paths(graph.steps(edges, ["x"])).collect())
    mixed = sorted(tuple(r.path) for r in graph.mixed_cycles(edges, ["x", "y"]).collect())
    assert [p for t, p in held if t == "x"] == alone and [p for t, p in held if t == "x + y"] == mixed


def test_components_of_held_and_of_spread_parts_agree(spark):
    pairs = spark.createDataFrame(drawn(6), SHAPE).select("src", "dst").distinct()
    held, some = (sorted(map(tuple, graph.strong_components(pairs, n).collect())) for n in (1000, 5))
    assert held == some and len(held) > 8
