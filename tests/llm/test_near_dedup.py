"""The full near-dedup against a plain version; the SimHash stage misses what it finds."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import near_dedup, ngram_join
from tests.llm import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_near_full_against_brute_force(spark):
    rows = [r[:5] for r in brute.documents(seed=9, n=150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = dict(corpus_pipeline.FULL_STAGES)["near dedup"](spark, docs, "")
    gone = sorted((d, sha) for d, _, n, sha in brute.lines([(r[0], brute.lowered(r[1]).replace("\n", " ")) for r in rows], 5) if n == 0)
    stay = sorted((d, sha) for d, _, n, sha in brute.lines([(r.doc_id, brute.lowered(r.text).replace("\n", " ")) for r in out.collect()], 5))
    assert out.columns == docs.columns and len(stay) < len(rows) and stay == gone


def test_near_full_takes_one_changed_word(spark):
    words = [f"w{k}" for k in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:100], "other", *words[101:]])), (3, "\n".join(words[:120]))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_full(spark, docs, "").orderBy("doc_id").collect()] == [1, 3]


def test_near_full_of_nothing(spark):
    assert corpus_pipeline.near_full(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_posts_carry_heads_and_counts(spark):
    r = random.Random(4)
    sets = [(i, r.randint(0, 9), sorted(r.sample(range(40), r.randint(1, 12)))) for i in range(60)]
    classes = spark.createDataFrame([(i, len(t), t, dk) for i, dk, t in sets], "id long, n int, t array<long>, dk long").repartition(5)
    found = sorted((x.p, x.id, x.place, x.dk, x.entries) for x in ngram_join.shared_posts(classes, 8, 3, ranked=True).collect())
    lists = {p: sorted((dk, i) for i, dk, t in sets if p in t) for p in range(40)}
    assert found == sorted((p, i, t.index(p), dk, len(lists[p]) * (lists[p][0] == (dk, i))) for i, dk, t in sets for p in t if len(lists[p]) > 1)


def test_posts_travel_as_planes():
    ids = (np.int64(7) << 33) + np.random.default_rng(3).permutation(3000)
    for values in (ids, np.sort(ids), ids.astype("<i4"), np.zeros(0, np.int64)):
        raw = b"head" + ngram_join.planes(values)
        assert ngram_join.of_planes(raw, values.dtype, len(values), 4).tolist() == values.tolist()
    assert len(pa.compress(ngram_join.planes(ids), "lz4_raw")) < 0.6 * len(pa.compress(ids.tobytes(), "lz4_raw"))  # as Spark compresses what it shuffles


def test_heads_are_found_without_a_join_by_class(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, i + 40))) for i in range(30)], "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = near_dedup.head_pairs(ngram_join.indexed(docs, 5, 80, ranked=True))._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Join") == 1  # posts with the heads of their lists
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
