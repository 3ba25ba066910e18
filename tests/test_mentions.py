"""Names in texts against Python's own substring search."""

from __future__ import annotations

import random

import pytest

from quillgraph.operators.mentions import mentions


def tables(seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 5)))
    texts = [" ".join(word() for _ in range(r.randint(0, 25))) for _ in range(60)]
    texts += [None, "", "  ", "a\nb  c", "日本語の文 です", "x" * 5000 + "needle" + "y" * 5000, "ab  ab", "aa aa aa"]
    names = ["ab", "abab", "a b", "b a", "éa b a", "a  b", " aab", "aab ", "日本", "本語の文 で", "needle", "", None, "aa aa", "b\nb", "a b a b"]
    for t in texts[:40]:
        if t and len(t) > 8:
            i = r.randrange(len(t) - 6)
            names.append(t[i : i + r.randint(4, 12)])
    return [(i, t) for i, t in enumerate([*texts, texts[0]])], [(i, n) for i, n in enumerate([*names, names[1]])]


@pytest.mark.parametrize("looked_up", [100_000, 0])
@pytest.mark.parametrize("least", [1, 4])
def test_equal_to_substring_search(spark, least, looked_up):
    texts, names = tables()
    got = mentions(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(names, "name_id long, name string"), least, looked_up)
    want = {(i, k) for i, t in texts for k, n in names if t and n and n.strip(" ") and len(n) >= least and n in t}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 50


def test_no_rows(spark):
    empty = spark.createDataFrame([], "text_id long, text string"), spark.createDataFrame([], "name_id long, name string")
    assert mentions(*empty).count() == 0


def test_a_hundred_thousand_names(spark):
    names = spark.range(100_000).selectExpr("id AS name_id", "concat('organism ', conv(id * 7919 % 1000003, 10, 36)) AS name")
    texts = spark.range(300).selectExpr("id AS text_id", "concat('study of Organism or organism ', conv(id * 37 * 7919 % 1000003, 10, 36), 'x and more') AS text")
    got = {tuple(r) for r in mentions(texts, names).collect()}
    assert {(i, 37 * i) for i in range(300) if 37 * i < 100_000} <= got
    held = {r["name"]: r["name_id"] for r in names.collect()}
    want = {(r["text_id"], held[c]) for r in texts.collect() for k in range(len(r["text"])) for c in (r["text"][k : k + n] for n in range(10, 14)) if c in held}
    assert got == want


def test_equal_names_are_sought_once(spark, monkeypatch):
    """As many ids of a name as may be leave what is sought below the bound, and each id is found; an id of two names counts once."""
    from quillgraph.operators import mentions as module

    sought, real = [], module.anchored
    monkeypatch.setattr(module, "anchored", lambda names: sought.append(names.count()) or real(names))
    names = [(k, "large ring") for k in range(2500)] + [(k, "blue bolt") for k in range(2490, 2510)]
    texts = [(1, "a large ring and a blue bolt"), (2, "enlarge rings"), (3, "large, ring")]
    got = mentions(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(names, "name_id long, name string")).collect()
    assert sorted(map(tuple, got)) == sorted([(1, k) for k in range(2510)] + [(2, k) for k in range(2500)]) and sought == [2]
