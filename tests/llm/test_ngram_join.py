"""The N-gram Jaccard join against all pairs, on a small table with awkward cases."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import ngram_join
from tests.llm import brute


def plain(rows, size, percent):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = []
    for r in rows:
        w = brute.WORD.findall(brute.lowered(r[1]))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(low.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows))


def found(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def near_copies(seed=4):
    """Groups of copies with words changed, chains that drift apart, texts that share long passages, hot groups."""
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfg" for b in ("a", "ei", "OU", "é")]
    sentence = lambda k: [r.choice(vocabulary) for _ in range(k)]
    texts, passage = [], sentence(60)
    for length in (3, 12, 40, 41, 120, 400):
        base = sentence(length)
        for _ in range(12):
            words = list(base)
            for _ in range(r.randint(0, max(1, length // 40))):
                words[r.randrange(length)] = r.choice(vocabulary)
            texts.append(words)
        chain = list(base)
        for k in range(15):
            chain = [*chain[1:], f"c{k}"]
            texts.append(chain)
    texts += [passage + sentence(r.randint(1, 8)) for _ in range(40)]  # few own words: short lists are common ones
    texts += [sentence(4) + passage for _ in range(20)]
    hot = sentence(90)
    texts += [[*hot[:i], "zz", *hot[i + 1 :]] for i in range(90)]
    rows = [(i, " ".join(w), "en", "x", 1, "k", 1, 2, "q") for i, w in enumerate(texts)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_components_equal_all_pairs(spark, size, percent):
    rows = [*brute.documents(), *((1000 + r[0], *r[1:]) for r in near_copies())]
    df = spark.createDataFrame(rows, brute.SCHEMA).repartition(4)
    out = ngram_join.ngram_components(df, size, percent)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert found(out) == plain(rows, size, percent)


def test_no_rows(spark):
    assert ngram_join.ngram_components(spark.createDataFrame([], brute.SCHEMA)).count() == 0
    void = spark.createDataFrame([(1, None), (2, " \n"), (None, None)], "doc_id long, text string")
    assert found(ngram_join.ngram_components(void)) == [("1", 0, "1"), ("2", 0, "2"), ("None", 0, "None")]


@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=25), min_size=2, max_size=14), st.integers(50, 100))
@settings(max_examples=150, deadline=None)
def test_merge_loses_no_similar_set(sets, percent):
    """Sets as ascending tokens; the short lists of the first against the short prefixes of the others."""
    ordered = [sorted(s) for s in sets]
    prefix = [s[: len(s) - -(-len(s) * percent // 100) + 1] for s in ordered]
    query = ordered[0]
    lists = []
    for place, token in enumerate(prefix[0]):
        entries = [(i, len(s), p.index(token)) for i, (s, p) in enumerate(zip(ordered, prefix, strict=True)) if i and token in p]
        if entries:
            lists.append((place, entries))
    got = ngram_join.occurring(len(query), lists, percent)
    similar = {i for i, s in enumerate(sets) if i and 100 * len(s & sets[0]) >= percent * len(s | sets[0])}
    assert similar <= set(got) and len(got) == len(set(got))


def test_hot_lists_are_cut_into_blocks(spark):
    posts = spark.createDataFrame([(7, i, 10, 0) for i in range(20)], "p long, id long, n int, place int")
    roots = spark.createDataFrame([(0, 0), (1, 0)], "node long, root long")
    blocks = ngram_join.open_lists(posts, roots, 90, 3).collect()
    pairs = sorted((r["id"], x["id"]) for r in blocks for x in r["found"])
    assert pairs == [(i, j) for i in range(20) for j in range(i + 1, 20) if (i, j) != (0, 1)]
    assert max(len(r["found"]) for r in blocks) < 12
