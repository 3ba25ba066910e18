"""The fuzzy join against the ratio of every pair, and how many pairs it scores."""

from __future__ import annotations

import random

import pytest

from quillgraph.operators.fuzzy import candidates, fuzzy, pairs_bound
from quillgraph.operators.resolve import common_subsequence


def ratio(a, b):
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def changed(rng, text, letters):
    for _ in range(rng.randrange(1, 4)):
        i = rng.randrange(len(text) + 1)
        text = text[:i] + rng.choice(letters) + text[i:] if rng.random() < 0.5 else text[:i] + text[i + 1 :]
    return text


@pytest.mark.parametrize("letters,least", [("ab", 0.85), ("abcdefgh", 0.85), ("abcde", 0.7), ("abc", 0.9), ("aé字", 0.6)])
def test_no_pair_is_lost(spark, letters, least):
    rng = random.Random(7)
    names = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 19))) for _ in range(70)} | {"a", "aa", "aaaaaaaaaaaa"}
    terms = {changed(rng, n, letters) for n in sorted(names)} | names | {"", "zzz"}
    t, n = spark.createDataFrame([(x,) for x in terms] + [(None,)], "term string"), spark.createDataFrame([(x, f"i{len(x)}{x}") for x in names] + [(None, "none"), ("", "empty")], "name string, id string")
    want = {(a, b) for a in terms for b in names if a and ratio(a, b) >= least}
    met = {tuple(r) for r in candidates(t.selectExpr("term AS text"), n.selectExpr("name AS text"), least).collect()}
    assert want <= met
    best = {a: max(ratio(a, b) for x, b in want if x == a) for a in {a for a, _ in want}}
    assert {(r.term, r.name) for r in fuzzy(t, n, least).collect()} == {(a, b) for a, b in want if ratio(a, b) == best[a]}


def test_few_pairs_are_scored(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randrange(12, 30))) for _ in range(3000)]
    terms = [changed(rng, n, "abc") for n in names[:500]]
    t, n = spark.createDataFrame([(x,) for x in terms], "text string"), spark.createDataFrame([(x,) for x in names], "text string")
    assert candidates(t, n, 0.85).count() < 2 * len(terms)  # of 1,500,000


def test_pairs_serve_high_thresholds_only():
    assert pairs_bound(0.85) and pairs_bound(0.95) and not pairs_bound(0.8) and not pairs_bound(0.6)
