"""The stream of decisions leaves the same rows whatever batches they come in."""

from __future__ import annotations

import random

import pytest

from quillgraph.streaming.decisions import Ledger, run

SCHEMA = "actor long, tool string, occurred_at string, event_id long, value double, about array<string>"


def decisions(n=120, seed=6):
    r = random.Random(seed)
    rows = [(r.choice([1, 1, 1, 2, 11]), r.choice("ab"), f"2024-01-{r.randint(1, 9):02d}", i, float(i), r.choice([["x", f"e{i % 7}", "x"], [], None, [None, "y"]])) for i in range(n)]
    r.shuffle(rows)
    return rows + rows[:30]


def expected(rows):
    groups: dict = {}
    for a, t, at, i, v, _ in set((*r[:5], None) for r in rows):
        groups.setdefault((str(a), t), []).append((at, i, v))
    edges, findings = set(), set()
    for key, own in groups.items():
        own.sort()
        edges |= {("SUPERSEDED_BY", str(x[1]), str(y[1])) for x, y in zip(own, own[1:], strict=False)}
        findings.add((*key, own[-1][2], len(own)))
    edges |= {("ABOUT", str(r[3]), e) for r in rows for e in r[5] or [] if e}
    return edges, findings


def left(ledger):
    return {tuple(r) for r in ledger.edges().collect()}, {tuple(r) for r in ledger.findings.read().collect()}


@pytest.mark.parametrize("batches", [1, 6])
def test_any_batches_leave_the_same(spark, tmp_path, batches):
    rows = decisions()
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ledger = Ledger.at(spark, str(tmp_path / "ledger"), 25)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(stream, ledger, str(tmp_path / "state"))
    assert left(ledger) == expected(rows)
    assert ledger.decisions.read().count() == len({r[3] for r in rows}) == len(ledger.edges().filter("type = 'SUPERSEDED_BY'").collect()) + len(expected(rows)[1])


def test_a_batch_that_failed_half_way_runs_again(spark, tmp_path, monkeypatch):
    rows = decisions(40)
    ledger = Ledger.at(spark, str(tmp_path / "ledger"), 25)
    ledger.take_in(spark.createDataFrame(rows[:25], SCHEMA), "batch-0")
    second = spark.createDataFrame(rows[25:], SCHEMA)
    monkeypatch.setattr(ledger.about, "merge", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        ledger.take_in(second, "batch-1")
    monkeypatch.undo()
    ledger.take_in(second, "batch-1")
    ledger.take_in(second, "batch-1")
    assert left(ledger) == expected(rows)
