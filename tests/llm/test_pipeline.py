"""The pipeline against a plain version of its stages, and its registration."""

from __future__ import annotations

from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
from quillgraph.llm import bpe, quality_rules
from tests.llm import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [r[:5] for r in brute.documents(seed=9, n=150)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_against_plain_ones(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality rules", "exact dedup", "near dedup", "mixing", "byte-level BPE"]
    texts = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())

    out = steps["quality rules"](spark, docs, folder)
    good = lambda t: (q := brute.quality(t))[0] >= 20 and 100 * q[4] <= 30 * q[0]
    assert quality_rules.learn(docs, spark.read.parquet(f"{folder}/labels.parquet")) == []  # all labels are good ones
    rows = [r for r in docs.collect() if good(r.text)]
    assert texts(out) == sorted((str(r.doc_id), str(r.text)) for r in rows) and out.columns == columns

    out = steps["exact dedup"](spark, spark.createDataFrame(rows, docs.schema), folder)
    best = {}
    for r in rows:
        key = brute.lowered(r.text)
        if key not in best or (r.doc_id if r.doc_id is not None else -1) > (best[key].doc_id if best[key].doc_id is not None else -1):
            best[key] = r
    rows = list(best.values())
    kept = out.collect()
    assert sorted(brute.lowered(r.text) for r in kept) == sorted(best) and sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in rows) and out.columns == columns

    rows = kept
    out = steps["near dedup"](spark, spark.createDataFrame(rows, docs.schema), folder)
    component = {d: c for d, _, c in brute.components([tuple(r) for r in rows])}
    rows = [r for r in rows if r.doc_id is None or component[str(r.doc_id)] == str(r.doc_id)]
    like = brute.lines([(r.doc_id, brute.lowered(r.text).replace("\n", " ")) for r in rows], 5)
    gone = {d for d, _, n, _ in like if n}
    rows = [r for r in rows if str(r.doc_id) not in gone]
    assert gone and texts(out) == sorted((str(r.doc_id), str(r.text)) for r in rows) and out.columns == columns

    source = spark.createDataFrame(rows, docs.schema)
    out = steps["mixing"](spark, source, folder)
    assert out.columns == columns
    mixed = out.collect()
    words = sum(len(brute.WORD.findall(r.text)) for r in rows)
    assert abs(sum(len(brute.WORD.findall(r.text)) for r in mixed) - words) <= 64
    assert all(r.n_chars == len(r.text) for r in mixed) and {r.doc_id for r in mixed} <= {r.doc_id for r in rows}

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = steps["byte-level BPE"](spark, spark.createDataFrame(mixed, docs.schema), folder)
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in out.collect()) == sorted((str(r.doc_id), len(library.encode_ordinary(r.text)), sha256(r.text.encode()).hexdigest()) for r in mixed)


def test_run_is_the_stages_in_order(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert out.agg(F.sum("n_tokens")).first()[0] > 0


def test_empty_tables_pass_through(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
