"""Typed shortest paths, neighbourhoods, components and cycles against plain searches of small graphs."""

from __future__ import annotations

import random
from itertools import product

import pytest

from quillgraph.operators import paths
from quillgraph.operators.cycles import components, on_cycles

SCHEMA = "src string, dst string, type string"
GRAPH = [("a", "b", "X"), ("b", "c", "X"), ("a", "d", "Y"), ("d", "c", "Y"), ("d", "c", "Z"), ("c", "f", "Z"), ("f", "g", "X"), ("e", "e", "X"), ("a", None, "X"), ("a", "c", None)]


def found(df):
    return [(list(r.nodes), list(r.types)) for r in df.collect()]


def test_typed_paths(spark):
    adjacent = paths.adjacency(spark.createDataFrame(GRAPH, SCHEMA))
    want = [(["a", "b", "c"], ["X", "X"]), (["a", "d", "c"], ["Y", "Y"]), (["a", "d", "c"], ["Y", "Z"])]
    assert sorted(found(paths.shortest_paths(adjacent, "a", "c"))) == want
    assert found(paths.shortest_paths(adjacent, "a", "c", 3, 1)) == want[:1]
    assert sorted(found(paths.shortest_paths(adjacent, "a", "c", 3, 2))) == want[:2]
    assert paths.shortest_paths(adjacent, "a", "e", 5).count() == 0
    assert paths.shortest_paths(adjacent, "a", "nobody", 5).count() == 0
    assert paths.shortest_paths(adjacent, "a", "g", 3).count() == 0
    assert found(paths.shortest_paths(adjacent, "a", "g", 4, 1)) == [(["a", "b", "c", "f", "g"], ["X", "X", "Z", "X"])]
    assert found(paths.shortest_paths(adjacent, "a", "a")) == [(["a"], [])]
    assert paths.spelled(paths.shortest_paths(adjacent, "a", "c", 3, 1)).collect() == [(2, "a>b>c", "X>X")]
    assert sorted(map(tuple, paths.around(adjacent, "a", 2).collect())) == [("b", 1, "X"), ("c", 2, "X"), ("d", 1, "Y")]


def every_shortest(edges, start, target, depth):
    near = {}
    for s, t, kind in edges:
        if s != t:
            near.setdefault(s, set()).add((t, kind))
            near.setdefault(t, set()).add((s, kind))
    walks = [([start], [])]
    for _ in range(depth + 1):
        if hits := sorted(w for w in walks if w[0][-1] == target):
            return hits
        walks = [([*n, t], [*k, kind]) for n, k in walks for t, kind in near.get(n[-1], ()) if t not in n]
    return []


@pytest.mark.parametrize("listed,seed", [(100, 1), (0, 2)])
def test_paths_equal_brute_force(spark, monkeypatch, listed, seed):
    monkeypatch.setattr(paths, "LISTED", listed)
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.choice("XYZ")) for _ in range(38)]
    adjacent = paths.adjacency(spark.createDataFrame(edges, SCHEMA))
    for target in ("n5", "n17", "n29"):
        want = every_shortest(edges, "n0", target, 5)
        assert sorted(found(paths.shortest_paths(adjacent, "n0", target, 5, 1000))) == want
        assert sorted(found(paths.shortest_paths(adjacent, "n0", target, 5, 2))) == want[:2]


def test_a_frontier_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(paths, "LISTED", 0)
    monkeypatch.setattr(paths, "BROADCAST", 0)
    adjacent = paths.adjacency(spark.createDataFrame(GRAPH, SCHEMA))
    assert len(found(paths.shortest_paths(adjacent, "a", "c"))) == 3


def closure(edges):
    reach = {(s, t) for s, t in edges if s != t}
    nodes = {n for e in reach for n in e}
    for k, i, j in product(sorted(nodes), sorted(nodes), sorted(nodes)):
        if (i, k) in reach and (k, j) in reach:
            reach.add((i, j))
    return reach


def shortest_cycle(edges, node, longest):
    at = {node}
    for k in range(1, longest + 1):
        at = {t for s, t in edges if s in at}
        if node in at:
            return k
    return None


@pytest.mark.parametrize("seed,n,m", [(1, 12, 18), (2, 25, 40)])
def test_components_and_cycles_equal_brute_force(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(3, 3), (n, n + 1), (n + 1, n)]
    df = spark.createDataFrame(edges, "src long, dst long")
    reach = closure(edges)
    together = {i: {j for j in range(n + 2) if j == i or ((i, j) in reach and (j, i) in reach)} for i in range(n + 2)}
    assert {r.node: r.component for r in components(df).collect()} == {i: max(t) for i, t in together.items() if len(t) > 1}
    want = {i: c for i in range(n + 2) if (c := shortest_cycle(edges, i, 5))}
    assert {r.node: r.length for r in on_cycles(df, 5).collect()} == want


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string, type string")
    assert components(none).count() == 0 and on_cycles(none).count() == 0
    assert paths.shortest_paths(paths.adjacency(none), "a", "b").count() == 0


def test_around_reads_kinds_without_an_adjacency(spark, monkeypatch):
    from quillgraph.operators import paths

    edges = [(f"S:{i}", f"D:{i * 7 % 31}", "T") for i in range(60)] + [(f"S:{i}", f"S:{i // 2}", "UP") for i in range(60)] + [("S:1", "D:7", None), ("S:2", None, "T"), ("D:3", "D:3", "SELF")]
    frame = spark.createDataFrame(edges, "src string, dst string, type string")
    kinds = [(frame.filter("type = 'T' OR type IS NULL"), "S:", "D:"), (frame.filter("type = 'UP'"), "S:", "S:"), (frame.filter("type = 'SELF'"), "D:", ""), (frame.filter("type = 'none'"), "X:", "Y:")]
    want = sorted(map(tuple, paths.around(paths.adjacency(frame), "S:3", 3).collect()))
    for listed, broadcast in ((100, 200_000), (2, 200_000), (2, 3)):
        monkeypatch.setattr(paths, "LISTED", listed)
        monkeypatch.setattr(paths, "BROADCAST", broadcast)
        assert sorted(map(tuple, paths.around(kinds, "S:3", 3).collect())) == want and len(want) > 10


@pytest.mark.parametrize("turned", [False, True])
def test_long_single_ways_take_few_rounds(spark, monkeypatch, turned):
    """Chains of many lengths into a cycle, into a dead end and into a node with two ways out: no round a step."""
    from quillgraph.operators import cycles

    edges = [(i, i + 1) for i in range(700)] + [(701, 400)] + [(700, 701)]  # 400 to 701 is a cycle
    edges += [(1000 + i, 1000 + i + 1) for i in range(333)] + [(2000 + i, 2000 + i + 1) for i in range(90)] + [(2090, 2000), (2090, 3000), (3000, 3001)]
    rounds, real = [], cycles.stored
    monkeypatch.setattr(cycles, "stored", lambda df: rounds.append(1) or real(df))
    df = spark.createDataFrame([e[::-1] for e in edges] if turned else edges, "src long, dst long")
    found, rest = cycles.single_ways(df)
    got = {r.node: r.component for r in found.collect()}
    assert len(rounds) < 20
    if turned:  # the way into the first cycle makes a second way out of it
        assert got == {i: 2090 for i in range(2000, 2091)}
    else:
        assert got == {i: 701 for i in range(400, 702)} and rest.count() == 91


@pytest.mark.parametrize("seed", range(4))
def test_components_where_all_have_one_way_out(spark, seed):
    import random

    r = random.Random(seed)
    n = 60
    to = {i: min(i + 1, n - 1) if r.random() < 0.8 else r.randrange(n) for i in range(n)}
    want = {}
    for i in to:
        at, seen = to[i], [i]
        while at != i and len(seen) <= n:
            seen.append(at)
            at = to[at]
        if at == i and len(seen) > 1:
            want[i] = max(seen)
    for edges in (list(to.items()), [(b, a) for a, b in to.items()]):
        assert {c.node: c.component for c in components(spark.createDataFrame(edges, "src long, dst long")).collect()} == want
