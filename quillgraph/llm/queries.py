"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bpe, clustering, exact_dedup, html_extraction, language_id, line_dedup, mixing, ngram_join, quality_rules, simhash, substring_dedup, toxicity, whitening
from quillgraph.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.learn(docs))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", found["deviation"].cast("long"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_mixing, op3_language_id, op4_toxicity, op5_html_extraction, op6_substring_dedup, op7_simhash, op8_line_dedup, op9_bpe, op10_quality_rules, op11_clustering, op12_ngram_join, op13_whitening)}



def clustering_sql(k: int = 16, rounds: int = 3, size: int = 64, factor: int = 64) -> str:
    """Lloyd's rounds without bounds: every distance of every round, one common table a step."""
    near = """a{r} AS (SELECT id, x, c, d FROM (SELECT id, x, c, d, row_number() OVER (PARTITION BY id ORDER BY d, c) AS place FROM (
            SELECT v.id, v.x, m.c, list_sum(list_transform(range(1, {size} + 1), lambda i: (v.x[i] - m.y[i]) * (v.x[i] - m.y[i]))) AS d FROM v CROSS JOIN m{r} AS m)) WHERE place = 1)"""
    move = """s{r} AS (SELECT c, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS y FROM (SELECT c, x, unnest(range(1, {size} + 1)) AS i FROM a{p}) GROUP BY c, i),
        m{r} AS (SELECT c, coalesce(n.y, o.y) AS y FROM m{p} AS o LEFT JOIN (SELECT c, list(y ORDER BY i) AS y FROM s{r} GROUP BY c) AS n USING (c))"""
    steps = [near.format(r=0, size=size)]
    for r in range(1, rounds + 1):
        steps += [move.format(r=r, p=r - 1, size=size), near.format(r=r, size=size)]
    return f"""
        WITH kept AS (
            SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({factor} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {size}
        ),
        v AS (SELECT vec_id, x, row_number() OVER () AS id FROM kept),
        m0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS y FROM (SELECT x, sha256('1:' || vec_id) AS h FROM v ORDER BY h NULLS LAST, x LIMIT {k})),
        {", ".join(steps)}
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(m.y, ',')) AS centroid_sha256
        FROM a{rounds} AS a JOIN v USING (id) JOIN m{rounds} AS m ON m.c = a.c
    """


ORACLE_SQL: dict[str, str] = {
    "op12_ngram_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
        g AS (SELECT list_sort(s) AS s, min(doc_id) AS id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
        t AS (SELECT id, n, unnest(s) AS t FROM g),
        few AS (SELECT t.id, t.n, t.t, row_number() OVER (PARTITION BY t.id ORDER BY f.f, t.t) AS place FROM t JOIN (SELECT t, count(*) AS f FROM t GROUP BY t) AS f USING (t)),
        short AS (SELECT id, n, t FROM few WHERE place <= n - (90 * n + 99) // 100 + 1),
        pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM short AS x JOIN short AS y ON x.t = y.t AND x.id < y.id AND x.n * 100 >= y.n * 90 AND y.n * 100 >= x.n * 90),
        links AS (SELECT a, b FROM (SELECT a, b, len(list_intersect(x.s, y.s)) AS c, x.n + y.n AS n FROM pairs JOIN g AS x ON x.id = a JOIN g AS y ON y.id = b) WHERE 190 * c >= 90 * n),
        both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT id AS a, id AS b FROM g UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
        low AS (SELECT a AS id, min(b) AS low FROM reach GROUP BY a)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(low.low, s.doc_id) AS component_id
        FROM s LEFT JOIN g ON list_sort(s.s) = g.s LEFT JOIN low ON low.id = g.id
    """,
    "op11_clustering": clustering_sql(),
    "op1_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
        )
        SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
        FROM n
    """,
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
        later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
        cut AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body FROM words ANTI JOIN cut USING (doc_id, i) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op8_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
        v AS (SELECT doc_id, no, line, array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ') AS k, doc_id * 1000000 + no AS pos FROM l),
        c AS (SELECT k, min(pos) AS first_at FROM v WHERE k <> '' GROUP BY 1),
        t AS (SELECT k, first_at, n, unnest(w) AS token FROM (SELECT k, first_at, w, len(w) AS n FROM (SELECT k, first_at, list_distinct(string_split(k, ' ')) AS w FROM c))),
        pairs AS (SELECT y.k, count(*) AS common, any_value(x.n) + any_value(y.n) AS total FROM t x JOIN t y ON x.token = y.token AND x.first_at < y.first_at AND x.n * 5 >= y.n * 4 AND y.n * 5 >= x.n * 4 GROUP BY y.k, x.k),
        near AS (SELECT DISTINCT k FROM pairs WHERE common * 100 >= (total - common) * 80),
        fate AS (SELECT v.doc_id, v.no, v.line, v.k <> '' AND v.pos <> c.first_at AS copy, v.k <> '' AND v.pos = c.first_at AND near.k IS NOT NULL AS close FROM v LEFT JOIN c USING (k) LEFT JOIN near USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(copy, false)) AS n_equal, count(*) FILTER (coalesce(close, false)) AS n_near,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT coalesce(copy, false) AND NOT coalesce(close, false)), '')) AS kept_sha256
        FROM fate GROUP BY 1
    """,
}
