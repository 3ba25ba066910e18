"""The operators against plain versions, on a small table with awkward cases."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import bpe, exact_dedup, html_extraction, language_id, line_dedup, mixing, near_dedup, quality_rules, simhash, substring_dedup, toxicity
from quillgraph.llm.common import slices, text_buffers
from quillgraph.llm.words import range_hashes, rolling, word_codes, word_hashes, words_of
from tests.llm import brute

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def rows():
    return brute.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def got(df, *columns):
    return sorted(tuple(str(r[c]) if c in ("doc_id", "keep_id", "component_id") else r[c] for c in columns) for r in df.collect())


def test_exact_dedup(docs, rows):
    want, n_groups = brute.exact(rows)
    out = exact_dedup.exact_dedup(docs)
    assert got(out, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert out.filter("kept").count() == n_groups == out.filter("kept").select("text_sha256").distinct().count()
    assert out.filter("kept AND NOT doc_id <=> keep_id").count() == 0


def test_exact_dedup_stage_leaves_texts_where_they_are(spark, docs):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once = docs.dropDuplicates(["doc_id", "text"])
        plan = exact_dedup.keep_one_of_each(once)._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_exact_dedup_stage(docs, rows):
    kept = exact_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == brute.exact(rows)[1]


@given(st.lists(st.integers(0, 400), max_size=300), st.lists(st.integers(0, 400), max_size=300))
@settings(max_examples=40, deadline=None)
def test_counting_quotient_filter_is_lossless(a, b):
    build = lambda x: exact_dedup.CountingQuotientFilter.build(np.array(x, np.uint64), 10)
    read = lambda f: dict(zip(*(x.tolist() for x in f.items()), strict=True))
    count = lambda x: {v: x.count(v) for v in set(x)}
    again = exact_dedup.CountingQuotientFilter.from_bytes(build(a).to_bytes())
    assert read(again) == count(a)
    assert read(exact_dedup.CountingQuotientFilter.merge([again, build(b)])) == count(a + b)


def test_simhash(docs, rows):
    assert got(simhash.simhash_components(docs), "doc_id", "fingerprint", "component_id") == brute.components(rows)


def test_simhash_with_crowded_shards(docs, rows):
    assert got(simhash.simhash_components(docs, shard=1), "doc_id", "fingerprint", "component_id") == brute.components(rows)


def test_bk_tree_finds_all_and_only_near_ones():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 4).astype(np.uint64)
    p = np.unique(np.concatenate([b ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64)) for b in base]))
    tree = simhash.BKTree(p)
    found = {(int(q), int(n)) for qs, ns in tree.within(p, 2) for q, n in zip(qs, ns, strict=True)}
    assert found == {(i, j) for i in range(len(p)) for j in range(len(p)) if int(p[i] ^ p[j]).bit_count() <= 2}


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "src long, dst long").filter("src != dst")
    out = {r.node: r.root for r in simhash.components(edges).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    # A star around its largest node, and one that is as it should be.
    edges = spark.createDataFrame([(1, 9), (2, 9), (5, 4), (6, 4)], "src long, dst long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {1: 1, 2: 1, 9: 1, 4: 4, 5: 4, 6: 4}


def test_substring_dedup(docs, rows):
    assert got(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substrings(rows)


def test_substring_dedup_with_crowded_minimizers(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup.earliest_runs, "__defaults__", (1,))
    assert got(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substrings(rows)


@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=5), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_suffix_automaton_knows_first_ends(sequences, size):
    automaton, begins, total = substring_dedup.SuffixAutomaton(), [], 0
    for s in sequences:
        begins.append(total)
        automaton.add(s, total)
        total += len(s)
    first = {}
    for s, b in zip(sequences, begins, strict=True):
        for i in range(len(s) - size + 1):
            first.setdefault(tuple(s[i : i + size]), b + i + size - 1)
    for s in sequences:
        assert automaton.earliest(s, size) == [first[tuple(s[i : i + size])] for i in range(len(s) - size + 1)]


def test_line_dedup(docs, rows):
    out = line_dedup.line_dedup(docs).withColumn("gone", F.col("n_equal") + F.col("n_near"))
    assert got(out, "doc_id", "n_lines", "gone", "kept_sha256") == brute.lines(rows)


def test_mixing(docs, rows):
    out = mixing.mixed(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    total = sum(sizes.values())
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, target = set(), {}
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / w for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    assert len(out) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in out)
    for s in order:
        own = [r for r in out if abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s]]
        assert abs(sum(r.taken for r in own) - target[s]) <= 64
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed(docs.repartition(5)).collect()))


def test_mix_takes_the_words_that_it_says(docs):
    want = mixing.mixed(docs).agg(F.sum("taken")).first()[0]
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == want


def test_mixing_by_blocks_of_many_words(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(r.randint(1, 400))), r.choice("aab")) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    total, blocks = sum(size.values()), 4000
    want = {"a": total / 3, "b": min(3 * size["b"], total * 2 / 3)}
    want["a"] = total - want["b"]
    out = mixing.mixed(docs, blocks=blocks).collect()
    assert len({x.taken / x["size"] for x in out}) > 3  # some documents are taken in part
    assert all(x.taken <= 3 * x["size"] for x in out)
    for s in "ab":
        own = [x for x in out if x.source_size == size[s]]
        assert abs(own[0].target - want[s]) < 1e-6 and abs(sum(x.taken for x in own) - want[s]) <= 4 * mixing.SHARDS * (total // blocks)
    texts = mixing.mix(docs, blocks=blocks).groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()
    assert {x.doc_id: x.n for x in texts} == {x.doc_id: x.taken for x in out if x.taken}
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed(docs.repartition(7), blocks=blocks).collect()))


def test_other_columns_survive(spark):
    """Names that operators use themselves, and names that differ in case only."""
    names = ["doc_id", "text", "source", "lang", "key", "__k", "__key", "row", "part", "at", "sha", "taken"]
    docs = spark.createDataFrame([(i, f"some words number {i % 3} " * 30, "s", "en", *range(8)) for i in range(9)], names)
    for out in (mixing.mix(docs), exact_dedup.keep_one_of_each(docs), simhash.keep_one_of_each(docs)):
        assert out.columns == names and {tuple(r)[4:] for r in out.collect()} == {tuple(range(8))}
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert quality_rules.keep_good(docs, quality_rules.learn(docs, labels)).columns == names
    spark.conf.set("spark.sql.caseSensitive", "true")
    docs = docs.withColumn("TEXT", F.lit("other")).withColumn("Doc_Id", F.lit(1))
    spark.conf.set("spark.sql.caseSensitive", "false")
    assert exact_dedup.exact_dedup(docs).select("text_sha256").distinct().count() == 3
    assert line_dedup.line_dedup(docs).count() == mixing.mixed(docs).count() == 9
    reports = (simhash.simhash_components(docs), substring_dedup.substring_dedup(docs), language_id.predict(docs, language_id.learn(docs)), toxicity.score(docs, toxicity.learn(docs, labels)), bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN))
    assert [out.count() for out in reports] == [9] * len(reports)
    rules = quality_rules.learn(docs, labels)
    assert quality_rules.quality_rules(docs, rules).count() == 9
    kept = (quality_rules.keep_good(docs, rules), near_dedup.keep_no_near_copies(docs), simhash.keep_one_of_each(docs))
    for out in kept:
        assert out.columns == docs.columns
    assert kept[1].count() == kept[2].count() == 3


def test_mix_with_extreme_shares(spark):
    rows = [(i, "w " * (i % 7 + 1), "only" if i % 50 else f"rare{i}") for i in range(300)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.taken <= 3 * r["size"] for r in out)
    assert abs(sum(r.taken for r in out) - sum(r["size"] for r in out)) <= 64


@given(st.lists(st.integers(0, 500), min_size=1, max_size=9), st.integers(0, 200))
@settings(max_examples=100, deadline=None)
def test_sainte_lague_by_highest_quotients(votes, seats):
    want = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
        want[k] += 1
    out = mixing.sainte_lague(np.array(votes), seats)
    quotient = lambda n: sorted(v / (2 * k + 1) for v, s in zip(votes, n, strict=True) for k in range(s))
    assert out.sum() == sum(want) and np.allclose(quotient(out.tolist()), quotient(want))


def test_bpe_equals_tiktoken_and_round_trips(docs, rows):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = []
    for r in rows:
        ids = np.array(library.encode_ordinary(r[1] or ""), "<u4")
        want.append((str(r[0]), len(ids), sha256(ids.tobytes()).hexdigest(), sha256((r[1] or "").encode()).hexdigest()))
    assert got(bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_bpe_long_pieces():
    ranks = bpe.read_ranks(RANKS)
    one = bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    for text in ("a" * 700, "ab" * 900, "".join(r.choice("etaoinsh") for _ in range(3000)), "=" * 1500, "é" * 600):
        out = next(bpe.BatchEncoder(one).encode([text]))
        assert out.tolist() == library.encode_ordinary(text) and one.decode(out) == text.encode()


def test_quality_statistics(docs, rows):
    out = got(quality_rules.statistics(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert out == sorted((str(r[0]), *brute.quality(r[1])) for r in rows)


def test_quality_rules_learn_and_reject(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows = [(i, " ".join(word() + ("###" if i % 5 == 0 else "") for _ in range(60))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(600)] + [(1, 1, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn(docs, labels)
    assert rules and str(rules[0])
    kept = {x.doc_id for x in quality_rules.quality_rules(docs, rules).filter("kept").collect()}
    assert kept == {i for i in range(600) if i % 5}
    assert {x.doc_id for x in quality_rules.keep_good(docs, rules).collect()} == kept
    assert quality_rules.learn(docs, labels.limit(0)) == []


def test_language_id(spark):
    r = random.Random(5)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "efgha", "dd": "ghabc", "ee": "xyzab"}
    text = lambda k: " ".join("".join(r.choice(letters[k]) for _ in range(r.randint(2, 6))) for _ in range(40))
    rows = [(i, text(k), k) for i in range(500) for k in [sorted(letters)[i % 5]]] + [(900, None, "aa"), (901, "12 34", "aa"), (902, "", None), (None, text("ee"), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    out = {x.doc_id: x for x in language_id.predict(docs, model).collect()}
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[None].lang_pred == "ee" and not out[None].held_out
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held)
    assert sum(out[i].lang_pred == sorted(letters)[i % 5] for i in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in out.values())
    assert {x.lang_pred for x in language_id.predict(docs, language_id.learn(docs.filter("lang IS NULL"))).collect()} == {"und"}
    # Nothing but the text counts.
    other = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("zz").alias("lang"))
    assert sorted(x.score for x in language_id.predict(other, model).collect()) == sorted(x.score for x in out.values())


@pytest.mark.parametrize("k", [1, 2, 5, 7, 12, 30])
def test_codewords_are_apart(k):
    code = language_id.codewords(k)
    apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
    assert code.shape[0] == k and (not apart or min(apart) >= max(1, code.shape[1] // 5))


def test_toxicity(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows = []
    for i in range(900):
        words = [word() for _ in range(r.randint(5, 60))]
        if i % 3 == 0:
            words[r.randrange(len(words))] = r.choice(["vile", "Nasty,", "rotten"])
        rows.append((i, " ".join(words), r.choice(["x", None])))
    rows += [(2000, None, None), (2001, "", "x"), (None, "vile", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(900)] + [(0, 1, 0), (2000, 1, None), (None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    held = [i for i in range(900) if out[i].held_out]
    assert held and sum(out[i].predicted == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert out[2000].predicted == out[2001].predicted == 0 and out[None].predicted == 1
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in out.values())
    assert {x.score for x in toxicity.score(docs, toxicity.learn(docs, labels.filter("toxic = 0"))).collect()} == {0.0}


def test_toxicity_learns_from_every_word(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    rows = []
    for i in range(300):  # one telling word, anywhere in a text that is much longer than a window
        words = [word() for _ in range(6000)]
        words.insert(r.randrange(len(words)), "vilest" if i % 2 else "kindest")
        rows.append((i, " ".join(words), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    held = [x for x in toxicity.score(docs, toxicity.learn(docs, labels)).collect() if x.held_out]
    assert held and sum(x.predicted == x.doc_id % 2 for x in held) >= 0.95 * len(held)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home<li><a href=/b>News</ul></nav><!-- ad --><div class="cookie-notice">We use cookies.</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>  part of a story that goes on for some length.<p>Second&nbsp;part, also quite long, with  spaces.
<div class="ad">Buy now!</div><ul><li>one item of the list</li></ul></article>
<aside><h3>Related</h3><a href=/c>Other</a></aside><div id="comments"><p>Nice!</p></div><form><label>Search</label><input></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_html_extraction(spark):
    docs = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "v", None, None), (3, None, "", None), (4, "w", "just words", None), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    out = sorted(map(tuple, html_extraction.extract(docs).collect()), key=str)
    story = "Title & more First bold part of a story that goes on for some length. Second part, also quite long, with spaces. one item of the list"
    assert out[0] == out[1] == (1, "u", story, len(story))
    assert out[2] == (2, "v", "", 0) and out[3] == (3, None, "", 0)


HAND_LABELLED = [
    ("<p>Short note.</p>", "Short note."),
    ("just words", "just words"),
    ("<body><div>First long part of a story that goes on and on for a while.</div><div>Second part of it, about as long as the first one.</div></body>", "First long part of a story that goes on and on for a while. Second part of it, about as long as the first one."),
    ("<article><p>The sum <math><mi>x</mi>+1</math> is known.</p></article>", "The sum x+1 is known."),
    ("<article><p>A long text about things that matter to all of us.</p></article><div id='user-feedback'><p>Great read!</p><p>Me too.</p></div>", "A long text about things that matter to all of us."),
    ("<nav><a href=/a>ホーム</a></nav><section><p>昨日の会議で、新しい研究の結果が発表されました。多くの質問がありました。</p><p>次の会議は来月に開かれる予定です。場所はまだ決まっていません。</p></section><footer>&copy; 会社</footer>", "昨日の会議で、新しい研究の結果が発表されました。多くの質問がありました。 次の会議は来月に開かれる予定です。場所はまだ決まっていません。"),
    ("<article><p>A text that goes on for some length, as texts do.</p><![CDATA[ left out ]]><p>And its second part.</p></article>", "A text that goes on for some length, as texts do. And its second part."),
    ("<nav><a href=/>Home</a></nav><main><h2>Head</h2><p>Body &lt;b&gt; of the text, with an end.</p></main><footer>&copy; Firm</footer>", "Head Body <b> of the text, with an end."),
]


@pytest.mark.parametrize("page, want", HAND_LABELLED)
def test_html_of_hand_labelled_pages(page, want):
    assert html_extraction.main_text(page, html_extraction.trained_field()) == want


def test_html_takes_time_in_proportion():
    for piece in ("<div>x", "<button>x", "<b>x", "<li><b>x", "<script", "<a '", "<![CDATA", "<?x"):
        blocks = html_extraction.blocks_of(piece * 20_000)
        assert sum(b.text.count("x") for b in blocks) == 20_000 * (piece.endswith("x") and piece != "<?x")


def test_html_field_on_new_layouts():
    field, wrong, total = html_extraction.trained_field(), 0, 0
    for page, labels in html_extraction.composed_pages(150, seed=99):
        blocks = html_extraction.blocks_of(page)
        assert len(blocks) == len(labels)
        out = field.viterbi(field.emissions(html_extraction.features_of(blocks)))
        wrong, total = wrong + sum(a != b for a, b in zip(out, labels, strict=True)), total + len(labels)
    assert wrong <= 0.01 * total


def test_viterbi_and_marginals_agree_with_enumeration():
    from itertools import product
    from math import exp

    field = html_extraction.Field({}, [[0.3, -1.0], [-0.4, 0.8]])
    e = [0.5, -1.2, 0.7, 0.1]
    weight = {y: sum(v for v, l in zip(e, y, strict=True) if l) + sum(field.pair[a][b] for a, b in zip(y, y[1:], strict=False)) for y in product((0, 1), repeat=4)}
    assert tuple(field.viterbi(e)) == max(weight, key=weight.get)
    total = sum(map(exp, weight.values()))
    ones, _ = field.marginals(e)
    assert np.allclose(ones, [sum(exp(w) for y, w in weight.items() if y[i]) / total for i in range(4)])


def test_words_across_batches():
    texts = ["ab  cd", None, "", "é\x0bx", " lead trail ", "a b"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["skip", *texts])}).slice(1)
    offsets, data = text_buffers(batch.column("text"))
    words = words_of(offsets, data)
    assert words.counts.tolist() == [len((t or "").encode().split()) for t in texts]
    one = word_codes(words, data)
    assert (one == word_codes(words, data, size=3)).all() and len(set(one.tolist())) == 7
    for key in (0, 1):
        own = word_hashes(words, data, key)
        assert len(set(own.tolist())) == 7 and own[1] != word_hashes(words, data, 1 - key)[1]
    assert sum(p.num_rows for p in slices(batch, 3)) == len(texts)


def thue_morse(n, a="a", b="b"):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


def test_hashes_tell_patterned_words_apart():
    """Words and sequences of two letters or words in the order that polynomial hashes cannot tell from its complement."""
    words = [thue_morse(n, *ab) for n in (1, 7, 8, 9, 15, 16, 17, 1024, 2048, 4096) for ab in ("ab", "ba")] + ["a" * n for n in range(2, 40)]
    offsets, data = text_buffers(pa.array([" ".join(words)]))
    at = words_of(offsets, data)
    assert len(set(word_hashes(at, data).tolist())) == len(words)
    h = np.array([3, 5], np.uint64)
    order = np.array([i.bit_count() % 2 for i in range(4096)])
    long = np.concatenate([h[order], h[1 - order]])
    ends = np.array([4096, 8192])
    assert len(set(range_hashes(long, ends - 4096, ends).tolist())) == 2
    assert rolling(long, 4096)[0] != rolling(long, 4096)[4096]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 22))
@settings(max_examples=60, deadline=None)
def test_sequence_hashes_equal_just_for_equal_sequences(values, size):
    hashes = np.array(values, np.uint64)
    own, n = rolling(hashes, size).tolist(), max(0, len(values) - size + 1)
    assert len(own) == n
    assert all((own[i] == own[j]) == (values[i : i + size] == values[j : j + size]) for i in range(n) for j in range(i))
    spans = [(i, min(len(values), i + size + i % 3)) for i in range(len(values))]
    ranges = range_hashes(hashes, *np.array(spans).T).tolist()
    assert all((ranges[i] == ranges[j]) == (values[slice(*spans[i])] == values[slice(*spans[j])]) for i in range(len(spans)) for j in range(i))


def test_long_patterned_words(spark):
    """Windows that differ in one long word only do not repeat: op6 removes nothing, op10 counts nothing."""
    rest = " ".join(f"w{i}" for i in range(19))
    for n in (1024, 2048):
        one, two = thue_morse(n), thue_morse(n, "b", "a")
        rows = [(1, f"{rest} {one}", "en", "x"), (2, f"{rest} {two}", "en", "x"), (3, f"{rest} {one}", "en", "x")]
        table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(table).collect()} == {1: 0, 2: 0, 3: 20}
        text = " ".join([*(f"v{i}" for i in range(7)), one, *(f"x{i}" for i in range(20)), *(f"v{i}" for i in range(7)), two])
        assert quality_rules.measured(pa.array([text, text + " " + text]))["n_repeat_words"].to_pylist() == [0, 72]


def test_repeated_windows_are_compared_word_for_word():
    text = b"a b c d e f g h a b c d e f g i"
    made_up = np.zeros(9, np.uint64)  # hashes that cannot tell windows apart
    assert quality_rules.windows_twice(made_up, lambda: text, 8).sum() == 0
    twice = quality_rules.windows_twice(np.zeros(9, np.uint64), lambda: b"a b c d e f g h a b c d e f g h", 8)
    assert np.flatnonzero(twice).tolist() == [0, 8]


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_dedup(empty).count() == exact_dedup.keep_one_of_each(empty).count() == 0
    assert mixing.mixed(empty).count() == mixing.mix(empty).count() == 0
    assert language_id.predict(empty, language_id.learn(empty)).count() == 0
    assert toxicity.score(empty, toxicity.learn(empty, labels)).count() == 0
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert simhash.simhash_components(empty).count() == simhash.keep_one_of_each(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0
    assert bpe.encode_decode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert quality_rules.quality_rules(empty, quality_rules.learn(empty, labels)).count() == 0


def test_near_lines_meet_at_few_places(spark):
    """Two lines of 40 words with one word changed share most prefix tokens; they need not meet at all of them."""
    words = [f"w{k}" for k in range(40)]
    lines = [(1, 0, 0, " ".join(words)), (2, 0, 0, " ".join([*words[:39], "other"]))]
    posts = line_dedup.posts_of(spark.createDataFrame(lines, "dk long, no int, th int, line string"))
    first = posts.select("p", *(F.col(c).alias(f"x_{c}") for c in line_dedup.POST))
    met = posts.join(first, "p").filter(line_dedup.before("x_") & line_dedup.may_be_similar("x_")).count()
    assert 1 <= met <= 5 and dict(posts.dtypes)["p"] == "int"


def test_line_dedup_tells_rows_apart_only_where_doc_ids_repeat(spark):
    texts = ["a b c d e\nx y", "a b c d e\nx y", "a b c d e\nx z"]
    for ids, repeat in (((1, 2, 3), False), ((1, 1, 3), True), ((None, 2, 3), True)):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        assert line_dedup.ids_repeat(docs) is repeat
        out = line_dedup.line_dedup(docs).withColumn("gone", F.col("n_equal") + F.col("n_near"))
        assert got(out, "doc_id", "n_lines", "gone", "kept_sha256") == brute.lines(list(zip(ids, texts, strict=True)))


def test_plain_lines(spark):
    lines = ["a b", " a \t\x0b b\r", "\x0c\x0ba   b\x0c\x0b\x0c", "a", "a\u00a0b  c", "     a     b"]
    found = spark.createDataFrame([(x,) for x in lines], "line string").select(line_dedup.plain("line").alias("x")).collect()
    assert [r.x for r in found] == ["a b", "a b", "a b", "a", "a\u00a0b c", "a b"]


def test_short_prefixes_are_cut_after_the_one_exchange_of_posts(spark, tmp_path):
    """A line of 10 words meets longer ones by its first two tokens only, whichever of the two comes first."""
    words = [f"w{k}" for k in range(12)]
    for texts in ((words, words[:10]), (words[:10], words), (words[:10], [*words[:9], "x"]), (words[:9], words)):
        rows = [(k, " ".join(t), None, None) for k, t in enumerate(texts)]
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
        out = line_dedup.line_dedup(docs).withColumn("gone", F.col("n_equal") + F.col("n_near"))
        assert got(out, "doc_id", "n_lines", "gone", "kept_sha256") == brute.lines(rows)
