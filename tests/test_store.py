"""The stored frame: merges, replays, pruning, lost and concurrent writers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators.upsert import association_rules, folded_associations
from quillgraph.sources import store
from quillgraph.sources.store import Conflict, Store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def people(spark, path, size=10):
    return Store(spark, str(path), "id string, name string, tags array<string>", ["id"], {"name": "newest", "tags": "union"}, size)


def frame(spark, ids, name, tag="t"):
    return spark.createDataFrame([(f"{i:04d}", name, [tag]) for i in ids], "id string, name string, tags array<string>")


def test_matched_created_kept_and_replay(spark, tmp_path):
    s = people(spark, tmp_path / "s")
    assert s.version().number == 0 and s.read().count() == 0
    assert s.merge(frame(spark, range(20), "one", "a"), "first").states == {"created": 20}
    v = s.merge(frame(spark, range(15, 25), "two", "b"), "second")
    assert v.number == 2 and v.states["matched"] == 5 and v.states["created"] == 5
    want = [(f"{i:04d}", "two" if i >= 15 else "one", (["a"] if i < 20 else []) + (["b"] if i >= 15 else [])) for i in range(25)]
    assert rows(s.read()) == want
    assert s.merge(frame(spark, range(90), "three"), "first").number == 2 and rows(s.read()) == want
    assert rows(s.read(1)) == [(f"{i:04d}", "one", ["a"]) for i in range(20)]
    assert dict(s.read_states().groupBy("state").count().collect()) == {"kept": 15, "matched": 5, "created": 5}


def test_untouched_files_keep_their_names(spark, tmp_path):
    s = people(spark, tmp_path / "s")
    before = s.merge(frame(spark, range(200), "one"), "first")
    assert len(before.files) > 10
    after = s.merge(frame(spark, [55, 57, 1055], "two"), "second")
    gone = {f["path"] for f in before.files} - {f["path"] for f in after.files}
    assert 1 <= len(gone) <= 3
    held = sorted(after.files, key=lambda f: f["low"])
    assert all(a["high"] < b["low"] for a, b in zip(held, held[1:], strict=False)) and sum(f["rows"] for f in held) == 201
    part = s.read(low="0050", high="0060")
    assert len(part.inputFiles()) <= 4 and rows(part.filter("id BETWEEN '0050' AND '0060'")) == rows(s.read().filter("id BETWEEN '0050' AND '0060'"))


def test_groups_read_their_files_only(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), "a string, b long, c long", ["a", "b"], {"c": "newest"}, 10)
    data = [(f"{'x' * (i % 3)}{i % 40}", i, i * i) for i in range(400)]
    s.merge(spark.createDataFrame(data, "a string, b long, c long"), "all")
    groups = spark.createDataFrame([("x4",), ("x4",), ("xx38",), ("none",)], "a string")
    found = s.read_groups(groups, ["a"])
    assert rows(found) == sorted(d for d in data if d[0] in ("x4", "xx38"))
    assert len(found.inputFiles()) < len(s.version().files) / 3


def test_many_random_merges_equal_a_dictionary(spark, tmp_path):
    r, s, want = random.Random(7), people(spark, tmp_path / "s", 15), {}
    for k in range(6):
        ids = r.sample(range(300), r.choice([0, 1, 40, 90]))
        s.merge(frame(spark, ids, f"n{k}", f"t{k % 3}"), str(k))
        for i in ids:
            tags = want.get(i, (None, []))[1]
            want[i] = (f"n{k}", tags + [t for t in [f"t{k % 3}"] if t not in tags])
    assert rows(s.read()) == sorted((f"{i:04d}", *v) for i, v in want.items())


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = people(spark, tmp_path / "s")
    s.merge(frame(spark, range(30), "one"), "first")
    before = rows(s.read())
    monkeypatch.setattr(Store, "_commit", lambda self, version: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        s.merge(frame(spark, range(60), "two"), "second")
    monkeypatch.undo()
    assert s.version().number == 1 and rows(s.read()) == before
    assert s.vacuum() == 1 and rows(s.read()) == before and s.vacuum() == 0
    assert s.merge(frame(spark, range(60), "two"), "second").number == 2 and s.read().filter("name = 'two'").count() == 60


def test_two_writers_of_one_version(spark, tmp_path):
    s = people(spark, tmp_path / "s")
    late = s.version()
    s.merge(frame(spark, range(5), "one"), "first")
    with pytest.raises(Conflict):
        s._commit(store.Version(late.number + 1, [], ["other"]))
    assert s.version().chunks == ["first"] and s.read().count() == 5


def test_null_keys_are_refused(spark, tmp_path):
    s = people(spark, tmp_path / "s")
    with pytest.raises(ValueError, match="1 rows have a null"):
        s.merge(spark.createDataFrame([(None, "x", ["a"]), ("b", "x", ["a"])], "id string, name string, tags array<string>"), "c")
    assert s.version().number == 0


def test_associations_one_after_the_other(spark, tmp_path):
    r = random.Random(3)
    claims = [(f"k{r.randrange(12)}", r.choice("abc"), r.choice(["", None, "1", "2", "3"]), r.choice(["up", "down"]), i) for i in range(60)] + [("alone", "a", "", "up", 99), ("late", "a", None, "down", 60)]
    want: dict = {}
    for k, source, pmid, direction, _ in sorted(claims, key=lambda c: c[4]):
        if k not in want:
            want[k] = [direction, [source], [pmid] if pmid else [], 1]
            continue
        e = want[k]
        e[1] += [source] * (source not in e[1])
        e[2] += [pmid] * (bool(pmid) and pmid not in e[2])
        e[3] = len(e[2])
    s = Store(spark, str(tmp_path / "s"), "k string, direction string, sources array<string>, pmids array<string>, n_studies long", ["k"], association_rules(), 4)
    df = spark.createDataFrame(claims, "k string, source string, pmid string, direction string, seq long")
    for part in range(3):
        s.merge(folded_associations(df.filter(F.col("seq").between(34 * part, 34 * part + 33)), ["k"], "seq"), str(part))
    assert rows(s.read()) == sorted((k, *v) for k, v in want.items())
