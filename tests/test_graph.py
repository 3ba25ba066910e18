"""Edge cases that the driver's tables do not hold."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.scope import Scope, public_orgs
from quillgraph.functions.text import collapse_key, full_match, normal_disease
from quillgraph.operators import curate, resolve, temporal
from quillgraph.operators.fuzzy import fuzzy
from quillgraph.operators.lookup import cursor_of, cursor_parts, keyset_page
from quillgraph.operators.profile import delimited, profile
from quillgraph.operators.quality import id_consistency, invariants, source_coverage
from quillgraph.operators.traverse import ancestors
from quillgraph.operators.upsert import merged


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_scope_hides_nodes_and_shows_edges_without_org(spark):
    rows = spark.createDataFrame([("a", "me"), ("b", "default"), ("c", "other"), ("d", None)], "id string, org string")
    scope = Scope("me")
    assert values(rows.filter(scope.node()), "id") == [("a",), ("b",)]
    assert values(rows.filter(scope.edge()), "id") == [("a",), ("b",), ("d",)]
    assert public_orgs("") == ["default"] and public_orgs(" a, b,") == ["a", "b"]


def test_full_match_is_anchored(spark):
    rows = spark.createDataFrame([("abc",), ("xabcx",), (None,)], "v string")
    assert values(rows.filter(full_match(F.col("v"), "A.C")), "v") == [("abc",)]


@pytest.mark.parametrize(
    ("name", "want"),
    [("IBD", "inflammatory bowel disease"), (" Crohn’s   Disease ", "crohns disease"), ("Non-Alcoholic", "non alcoholic"), ("", ""), (None, ""), ("uc", "ulcerative colitis")],
)
def test_normal_disease(spark, name, want):
    assert spark.createDataFrame([(name,)], "v string").select(normal_disease(F.col("v"))).first()[0] == want


def test_collapse_key(spark):
    rows = spark.createDataFrame([("Crohn's diseases",), ("gas is",), ("kidneys  disease",)], "v string")
    assert values(rows.select(collapse_key(F.col("v")).alias("k")), "k") == [("crohn disease",), ("gas is",), ("kidney disease",)]


def test_ancestors_survive_cycles(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "child string, parent string")
    found = values(ancestors(parents, 8).filter("node = 'a'"), "ancestor", "distance")
    assert found == [("a", 0), ("b", 1), ("c", 2)]


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "a", None, ["x"]), (2, "b", "q", None)], "id int, n string, m string, l array<string>")
    new = spark.createDataFrame([(1, None, "z", ["x", "y"]), (3, "c", None, None)], "id int, n string, m string, l array<string>")
    out = values(merged(old, new, ["id"], {"n": "replace", "m": "keep", "l": "union"}), "id", "n", "m", "l", "state")
    assert out == [(1, "a", "z", ["x", "y"], "matched"), (2, "b", "q", [], "kept"), (3, "c", None, [], "created")]


def test_identifiers_and_sources(spark):
    ids = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "id long")
    assert id_consistency(ids, "id").collect() == [(5, 2, 1, 2)]
    assert id_consistency(ids.limit(0), "id").collect() == [(0, 0, 0, 0)]
    said = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("b", None)], "part string, source string")
    assert sorted(source_coverage(said).collect()) == [("a", "x|y", 3, 2), ("b", None, 1, 0)]


def test_invariants_can_fail(spark):
    nodes = spark.createDataFrame([("a", "T", "x", "o"), ("a", "T", "x", "o"), ("b", "T", None, "o")], "id string, label string, name string, org string")
    edges = spark.createDataFrame([("a", "a", "HAS_PARENT"), ("a", "b", "HAS_PARENT"), ("a", "zz", "P"), ("a", "zz", "P")], "src string, dst string, type string")
    assoc = spark.createDataFrame([("a", "sideways", 0)], "taxon_id string, direction string, n_studies int")
    assert all(n > 0 for _, n in values(invariants(nodes, edges, assoc), "invariant", "violations"))


def test_as_of_and_current(spark):
    rows = spark.createDataFrame([(1, "2024-01-01T10:00:00Z", 2), (2, "2024-01-05T10:00:00Z", None), (3, "2024-01-03T23:59:59Z", None)], "event_id long, occurred_at string, superseded_by long")
    assert values(temporal.as_of(rows, "2024-01-03"), "event_id") == [(1,), (3,)]
    assert values(temporal.as_of(rows, "2024-01-06"), "event_id") == [(2,), (3,)]
    assert values(temporal.current(rows), "event_id") == [(2,), (3,)]


def test_chain_and_its_breaks(spark):
    events = spark.createDataFrame([("o", i, f"e{i}") for i in range(5)] + [("p", 0, "x")], "org string, k int, event string")
    chain = temporal.chained(events, "org", ["k"], "event")
    prev, want = None, []
    for i in range(5):
        own = "sha256:" + hashlib.sha256(f"{prev or ''}\ne{i}".encode()).hexdigest()
        want.append((i + 1, prev, own))
        prev = own
    assert values(chain.filter("chain = 'o'"), "seq", "prev", "digest") == sorted(want, key=lambda r: r[0])
    assert temporal.broken(chain).count() == 0
    assert values(temporal.broken(chain.withColumn("event", F.when(F.col("seq") == 3, "no").otherwise(F.col("event")))), "chain", "seq", "reason") == [("o", 3, "digest")]
    assert values(temporal.broken(chain.filter("NOT (chain = 'o' AND seq = 2)")), "chain", "seq", "reason") == [("o", 3, "link")]
    assert temporal.broken(chain.filter("seq < 4")).count() == 0  # a truncated tail


def test_append_only(spark):
    stored = spark.createDataFrame([("a", 1)], "key string, n int")
    assert values(temporal.inserted(stored, spark.createDataFrame([("a", 2), ("b", 4), ("b", 3)], "key string, n int"), "key", "n"), "key", "n") == [("b", 3)]


def test_keyset_pages_break_ties(spark):
    rows = spark.createDataFrame([(i, "t1") for i in range(5)], "id long, at string")
    assert [r.id for r in keyset_page(rows, "at", "id", 2).collect()] == [4, 3, 2]
    assert [r.id for r in keyset_page(rows, "at", "id", 2, cursor_of("t1", 3)).collect()] == [2, 1, 0]
    with pytest.raises(ValueError):
        cursor_parts("%%%")


def ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 2 * table[-1][-1] / (len(a) + len(b))


def test_fuzzy_equals_brute_force(spark):
    names = ["red bolt", "red bolts", "small ring", "smal ring", "hot gear", "blue widget"]
    asked = ["redd bolt", "small rng", "hot  gear", "nothing like it", "blue wdiget"]
    found = values(fuzzy(spark.createDataFrame([(t,) for t in asked], "term string"), spark.createDataFrame([(n, n) for n in names], "name string, id string")), "term", "id")
    want = []
    for t in asked:
        best = max(ratio(t, n) for n in names)
        want += [(t, n) for n in names if best >= 0.85 and math.isclose(ratio(t, n), best)]
    assert found == sorted(want)


def test_resolution_states(spark):
    nodes = spark.createDataFrame([("C:1", "Red"), ("C:2", "red"), ("C:3", "Violet")], "id string, name string")
    asked = spark.createDataFrame([("C:1",), ("C:9",), ("RED",), ("violett",), ("",)], "term string")
    out = {r.term: (r.id, r.status) for r in resolve.resolved(asked, nodes, F.col("term").startswith("C:")).collect()}
    assert out == {"C:1": ("C:1", "resolved"), "C:9": (None, "unresolved"), "RED": ("C:1", "ambiguous"), "violett": ("C:3", "resolved"), "": (None, "unresolved")}


def test_entities_and_relations_order(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", None, 3), ("a", "y", 2), ("", "z", 4)], "id string, p string, seq int")
    assert values(resolve.entities(rows, F.lit("L"), F.col("id"), {"p": F.col("p")}, "seq"), "id", "p") == [("a", "y")]
    assert values(resolve.relations(rows, "R", F.col("id"), F.lit("t"), F.col("p"), "seq"), "src", "value")[-1] == ("a", "x")


def test_profile_and_delimiters(spark):
    rows = spark.createDataFrame([("1", "1", "true", "", "a|b"), ("2", "1.5", "FALSE", "", "c|d"), ("", "2e3", "true", None, "e|f")], "a string, b string, c string, d string, e string")
    found = {r[0]: tuple(r)[1:] for r in profile(rows).collect()}
    assert found["a"] == ("integer", 0.3333, 2) and found["b"][0] == "float" and found["c"][0] == "boolean" and found["d"] == ("unknown", 1.0, 0)
    assert values(delimited(rows, "e"), "delimiter", "parts") == [("|", 2)]
    assert delimited(rows, "a").count() == 0


def test_derivation_leaves_hubs_out(spark):
    part = spark.createDataFrame([("c1", "p1"), ("c2", "p1"), ("hub", "p1"), ("hub", "p2"), ("hub", "p3")], "compound_id string, pathway_id string")
    linked = spark.createDataFrame([("c1", "d1"), ("c2", "d1"), ("hub", "d2")], "compound_id string, disease_id string")
    assert values(curate.implicated(part, linked, 2, 2), "pathway_id", "disease_id", "support") == [("p1", "d1", 2)]
