"""Interval labels of forests against plain walks, with cycles, lost parents, hubs and a deep chain."""

from __future__ import annotations

import random

import pytest

from quillgraph.operators import intervals


def forest(seed=8, n=150):
    r = random.Random(seed)
    rows = [(f"n{i}", None if i < 3 else f"n{r.randrange(i)}") for i in range(n)]
    rows += [(f"h{i}", "n5") for i in range(60)]  # a hub
    rows += [(f"d{i}", f"d{i - 1}" if i else "n2") for i in range(70)]  # a chain
    rows += [("lost", "nowhere"), ("below", "lost"), ("self", "self"), ("leaf", "self")]
    rows += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("oncycle", "c1"), ("under", "oncycle")]  # no root
    return [*rows, ("n9", None), rows[20], (None, "n1")]  # several parents: the smallest; a repeated row; no id


def plain(rows):
    """id -> the path from its root; nodes without a root are left out."""
    parent: dict = {}
    for i, p in rows:
        if i is not None and (i not in parent or (p is not None and (parent[i] is None or p < parent[i]))):
            parent[i] = p
    paths = {}
    for i in parent:
        path, at = [i], i
        while (up := parent[at]) is not None and up in parent and up != at and len(path) <= len(parent):
            path.append(up)
            at = up
        if len(path) <= len(parent):
            paths[i] = path[::-1]
    return paths


def test_labels_equal_a_walk(spark):
    rows = forest()
    paths = plain(rows)
    got = {r["id"]: r for r in intervals.labelled(spark.createDataFrame(rows, "id string, parent string").repartition(6)).collect()}
    assert set(got) == set(paths) and "c1" not in got and "under" not in got
    assert sorted(r["first"] for r in got.values()) == list(range(1, len(paths) + 1))
    for i, r in got.items():
        assert r["depth"] == len(paths[i]) - 1 and r["parent"] == (paths[i][-2] if len(paths[i]) > 1 else None)
        assert {j for j, s in got.items() if r["first"] <= s["first"] <= r["last"]} == {j for j, p in paths.items() if i in p}


def test_ranges_answer_both_directions(spark, tmp_path):
    rows = forest()
    paths = plain(rows)
    table = intervals.write_sorted(intervals.labelled(spark.createDataFrame(rows, "id string, parent string")), str(tmp_path / "t"))
    up = {(r["id"], r["distance"]) for r in intervals.lineage_of(table, "d40").collect()}
    assert up == {(a, len(paths["d40"]) - 1 - k) for k, a in enumerate(paths["d40"])}
    roots = ["n5", "h3", "n2", "lost", "none", "c1"]
    assert {r["id"] for r in intervals.below(table, roots).collect()} == {i for i, p in paths.items() if set(roots) & set(p)}
    assert intervals.lineage_of(table, "none").count() == 0 and intervals.below(table, []).count() == 0
    for block in (1, 7, 1000):
        pairs = {(r["id"], r["above_id"]) for r in intervals.enclosing(table, table.select("id", "first", "last"), block).collect()}
        assert pairs == {(i, a) for i, p in paths.items() for a in p}
    scan = intervals.below(table, ["n5"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in scan and "GreaterThanOrEqual(first," in scan


def test_topmost_rank_counts(spark):
    rows = [("a", None, "superkingdom", "Top"), ("b", "a", "kingdom", "Second"), ("c", "b", "genus", "G1"), ("d", "c", "genus", "G2"), ("e", "d", "species", None), ("f", "e", "strain", "S"), ("g", "f", "no rank", "x")]
    nodes = spark.createDataFrame(rows, "id string, parent string, rank string, name string")
    table = intervals.labelled(nodes).drop("parent").join(nodes, "id")
    got = {r["id"]: (r["kingdom"], r["genus"], r["species"], r["strain"]) for r in intervals.rank_columns(table).collect()}
    assert got["g"] == ("Top", "G1", None, "S") == got["f"] and got["b"] == ("Top", None, None, None)


def test_no_nodes_and_only_cycles(spark):
    empty = spark.createDataFrame([], "id string, parent string")
    assert intervals.labelled(empty).count() == 0
    assert intervals.labelled(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string")).count() == 0


@pytest.mark.parametrize("core", [0, 20_000])
def test_sorted_paths_equal_the_walk(spark, monkeypatch, core):
    nodes = spark.createDataFrame(forest(), "id string, parent string").repartition(5)
    walked = {tuple(r) for r in intervals.labelled(nodes, 1).collect()}
    monkeypatch.setattr(intervals, "siblings", None)  # no walk
    paths = intervals.root_paths(intervals.known_parents(nodes), 1000, core)
    assert {tuple(r) for r in intervals.by_paths(paths).collect()} == walked and len(walked) > 280


def test_shallow_trees_are_not_walked(spark, tmp_path, monkeypatch):
    rows = [(f"n{i}", f"n{i // 7}" if i else None) for i in range(3000)]
    monkeypatch.setattr(intervals, "siblings", None)
    table = intervals.write_labels(spark.createDataFrame(rows, "id string, parent string"), str(tmp_path / "t"))
    assert {r["id"] for r in intervals.below(table, ["n3"]).collect()} == {i for i, p in plain(rows).items() if "n3" in p}


def test_rank_columns_join_nothing(spark, monkeypatch):
    monkeypatch.setattr(intervals, "enclosing", None)
    rows = [(f"n{i}", f"n{i // 3}" if i else None, ["kingdom", "genus", "no rank", "species"][i % 4], None if i % 11 == 0 else f"name {i}") for i in range(2000)]
    nodes = spark.createDataFrame(rows, "id string, parent string, rank string, name string")
    paths, of = plain([r[:2] for r in rows]), {r[0]: r[2:] for r in rows}
    got = {r["id"]: r for r in intervals.rank_columns(intervals.labelled(nodes).drop("parent").join(nodes, "id")).collect()}
    assert set(got) == set(paths)
    for i, path in paths.items():
        for rank in ("kingdom", "genus", "species"):
            assert got[i][rank] == next((of[a][1] for a in path if of[a][0] == rank and of[a][1]), None)
