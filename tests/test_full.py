"""No row of the tables is left out, whatever its key."""

from __future__ import annotations

from datetime import datetime
from hashlib import sha256

import pytest

from __spark_entry__ import QUERIES
from quillgraph.operators.traverse import ancestors


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of small tables with keys beyond every bound of the short forms."""
    at = str(tmp_path_factory.mktemp("full"))

    def write(name, schema, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")

    part = [(1000, "red bolt", "Brand#1", "PROMO", 5, 900.0), (1002, "hot gear", "Brand#2", "PROMO", 7, 1900.0), (1003, "red bolt", "Brand#1", "ECONOMY", 5, 1900.0), (1004, "red bolt", "Brand#9", "PROMO", 9, 1900.0)]
    write("part", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", part)
    lineitem = [(9000, 1000, 50, 1, 5.0, "A", "F"), (9000, 1000, 50, 2, 6.0, "R", "O"), (9001, 1002, 51, 3, 7.0, "N", "O")]
    write("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string", lineitem)
    write("orders", "o_orderkey long, o_custkey long, o_orderstatus string", [(9000, 1, "F"), (9001, 1, "O")])
    write("supplier", "s_suppkey long, s_name string, s_nationkey int", [(k, f"s{k}", n) for k, n in ((1, 15), (2, 9), (3, 3), (4, 17), (5, 6), (50, 20), (51, 20))])
    write("nation", "n_nationkey int, n_name string, n_regionkey int", [(k, f"n{k}", k % 5) for k in range(25)])
    write("region", "r_regionkey int, r_name string", [(k, f"r{k}" if k else "ASIA") for k in range(5)])
    write("customer", "c_custkey long, c_name string, c_nationkey int, c_mktsegment string", [(k, f"c{k}", 0, "BUILDING") for k in range(1, 21)])
    write("events", "event_id long, ts timestamp, user_id long, event_type string, value double, props string", [(k, datetime(2024, 1, 1, 0, k), 7, "view", 1.0, "{}") for k in range(40)])
    return at


@pytest.fixture(scope="module")
def found(spark, tables):
    return lambda name: sorted((tuple(r) for r in QUERIES[name](spark, tables).collect()), key=str)


def test_resolution_takes_all_parts(found):
    assert found("e5_identifier_match") == [("C:1000", "C:1000", 1.0)]
    assert found("e6_exact_name_match") == [("HOT GEAR", "C:1002")]
    assert found("e8_ambiguity") == [("economy", "C:1003", 1, "INFERRED"), ("promo", "C:1000", 3, "AMBIGUOUS")]
    told = [("C:1002", "C:1002", 1.0, "EXTRACTED", "resolved"), ("C:x1003", None, None, None, "unresolved"), ("RED BOLT Brand#9", "C:1004", 0.95, "INFERRED", "resolved"), ("redd bolt Brand#1", "C:1000", 0.969697, "AMBIGUOUS", "ambiguous")]
    assert found("e9_resolve_pipeline") == told
    assert found("e22_confidence_report") == [("ambiguous", 1), ("resolved", 2), ("unresolved", 1)]
    own = [("PROMO", f"A{k}", f"B{k}", f"{brand}|name:{name}") for k, brand, name in ((1000, "Brand#1:5", "red bolt"), (1002, "Brand#2:7", "hot gear"), (1004, "Brand#9:9", "red bolt"))]
    assert found("e16_same_as") == sorted([*own, ("ECONOMY", "A1003", "B1003", "Brand#1:5|name:red bolt"), ("PROMO", "A1000", "B1004", "name:red bolt"), ("PROMO", "A1004", "B1000", "name:red bolt")])


def test_lineitem_and_orders_are_taken_whole(found):
    assert found("w2_association_upsert") == [("S:50", "D:1", "src1|src2", 0, 0, "enriched", "kept"), ("S:51", "D:1", "src3", 1, 1, "altered", "kept")]
    assert found("w10_sample_composition") == [(9000, 1000, 5.0), (9001, 1002, 7.0)]
    assert found("i14_coercion") == [(50, 5.0), (50, 6.0), (51, None)]
    assert found("i15_nested_measurements") == [(9000, 1000, 1), (9000, 1000, 2), (9001, 1002, 3)]
    assert found("e14_rows_to_graph") == [("Supplier", "50", "R", 6.0), ("Supplier", "51", "N", 7.0), ("edge", "50>1000", "A", None), ("edge", "51>1002", "N", None)]


def test_traversal_and_curation_take_all(found):
    assert found("g5_artifact_ancestry") == sorted([(k, a, k - a, "view") for k in range(40) for a in range(k)], key=str)
    assert found("d2_stale_cleanup") == [("P:20", "D:1")]


def test_cycles_and_curated_names(spark, tmp_path):
    write = lambda name, schema, rows: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    # The rule of supplier_links: 1 > 2 > 3 > 4 > 5 > 1, and 6 > 6; 51 is the largest key and links to 13, which is none.
    write("supplier", "s_suppkey long, s_nationkey int", [(1, 47), (2, 41), (3, 35), (4, 29), (5, 18), (6, 16), (51, 20)])
    assert run("g8_cycles") == [(1, 5), (2, 5), (3, 5), (4, 5), (5, 5), (6, 1)]
    # Two synonyms are refused, a pin to nothing too; an observed systematic name beats a predicted synonym.
    write("customer", "c_custkey long, c_name string", [(k, f"Customer#{k:09d}") for k in (501, 1000, 1002, 1004, 1005)])
    write("part", "p_partkey long, p_brand string, p_size int", [(1000, "Brand#1", 5), (1002, "Brand#2", 7), (1003, "Brand#1", 5), (1004, "Brand#9", 9)])
    curated = [(501, None), (1000, None), (1002, "C:1000"), (1004, "C:1004"), (1005, "C:1004")]
    assert run("d9_curated_resolution") == [(f"customer#{k:09d}", c) for k, c in curated]


def test_ancestors_without_a_depth(spark):
    parents = spark.createDataFrame([(k, k - 1) for k in range(1, 40)] + [(100, 101), (101, 100)], "child long, parent long")
    up = ancestors(parents, None)
    assert up.filter("node = 39").count() == 40 and up.agg({"distance": "max"}).first()[0] == 39


def test_resolver_index_has_every_node_in_scope(found):
    rows = found("e10_resolver_index")
    assert [i for label, i in rows if label == "Disease"] == sorted((f"D:{k}" for k in range(1, 21) if k != 17))
    assert [i for label, i in rows if label == "Taxon"] == ["N:0", "N:10", "N:15", "N:20", "N:5", "R:0", "S:1", "S:50"]


def test_manifest_has_every_label_and_type(found):
    rows = {part: (n, digest) for part, n, digest in found("e17_bundle_manifest")}
    assert set(rows) == {"Taxon", "Disease", "Compound", "Pathway", "Protein", "HAS_PARENT", "ASSOCIATED_WITH_DISEASE", "PRODUCES", "PARTICIPATES_IN"}

    def digest(lines):
        hashes = [sha256("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in line).encode()).hexdigest() for line in lines]
        return len(hashes), sha256(":".join(map(str, [len(hashes), *(sum(int(h[8 * i : 8 * i + 8], 16) for h in hashes) for i in range(8))])).encode()).hexdigest()

    homes = [(1, 15), (2, 9), (3, 3), (4, 17), (5, 6), (50, 20), (51, 20)]
    assert rows["HAS_PARENT"] == digest([(f"S:{s}", f"N:{n}") for s, n in homes] + [(f"N:{k}", f"R:{k % 5}") for k in range(25)])
    assert rows["Disease"] == digest([(f"D:{k}", f"c{k}", None if k == 17 else "ASIA") for k in range(1, 21)])


def test_append_only_log_grows_with_the_table(found):
    assert sorted(event_id for _, event_id in found("t11_append_only")) == [18, 21, 24]


def test_drug_counts_make_no_pairs(found, monkeypatch):
    """Drugs and proteins of a brand and type are not paired to be counted."""
    from quillgraph.plans.views import Graph

    monkeypatch.setattr(Graph, "targets", None)
    assert found("l13_get_drug") == []


def test_drug_counts(spark, tables, tmp_path):
    from shutil import copytree

    at = str(copytree(tables, tmp_path / "t", ignore=lambda _, names: [n for n in names if n.startswith("part.")]))
    part = [(1000, "a", "Brand#3", "PROMO", 46, 1.0), (1002, "b", "Brand#3", "PROMO", 7, 1.0), (1003, "c", "Brand#3", None, 50, 1.0), (1004, "d", "Brand#9", "PROMO", 50, 1.0)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{at}/part.parquet")
    assert sorted(map(tuple, QUERIES["l13_get_drug"](spark, at).collect())) == [("G:1000", "a", 2, 1), ("G:1003", "c", 0, 0)]


def test_either_key_makes_each_pair_once_without_a_shuffle_of_pairs(spark, tables, found):
    assert found("j21_disjunctive_join") == [(1000, 1003), (1002, 1003), (1002, 1004), (1003, 1004)]
    assert "Aggregate" not in QUERIES["j21_disjunctive_join"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()


def test_same_as_groups_no_pairs_of_nodes(spark, monkeypatch):
    from quillgraph.operators import resolve

    monkeypatch.setattr(resolve, "LIST", 2)
    rows = [("L", f"n{i}", [f"t{i % 3}", f"u{i % 4}", None]) for i in range(20)] + [("M", "n1", ["t1"]), ("L", "n1", ["extra"]), (None, "n2", ["t1"]), ("L", None, ["t1"]), ("L", "bare", []), ("M", "n9", ["t1", "t1"])]
    a, b = spark.createDataFrame(rows, "label string, id string, tokens array<string>"), spark.createDataFrame([*rows, ("L", "new", ["extra"])], "label string, id string, tokens array<string>")
    own = lambda more: {(l, i): {t for m, j, ts in [*rows, *more] if (m, j) == (l, i) for t in ts if t} for l, i, _ in [*rows, *more] if l and i}  # noqa: E731, E741
    want = [(l, i, j, "|".join(sorted(x & y))) for (l, i), x in own([]).items() for (m, j), y in own([("L", "new", ["extra"])]).items() if l == m and i != j and x & y]  # noqa: E741
    made = resolve.same_as(a, b)
    assert sorted(tuple(r) for r in made.collect()) == sorted(want) and len(want) > 100
    assert not [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line and "a_id#" in line]
