"""Decisions, assertions, artifacts and the hash chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.lineage import scratch
from quillgraph.functions.text import joined_set
from quillgraph.operators import temporal
from quillgraph.operators.lookup import cursor_of, keyset_page
from quillgraph.plans.registry import query
from quillgraph.plans.views import Graph
from quillgraph.streaming.decisions import Ledger, run

ABOUT = "about AS (SELECT event_id, 'user' || user_id AS entity FROM events UNION ALL SELECT event_id, 'k' || regexp_extract(props, '\\d+') FROM events)"


def about(g: Graph) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return g.table("events").select("event_id", F.explode(F.array(F.concat(F.lit("user"), F.col("user_id").cast("string")), F.concat(F.lit("k"), k))).alias("entity"))


def streamed(g: Graph, batches: int = 3) -> Ledger:
    """The events as a stream of decisions in some batches, out of order, a third of them sent twice."""
    at = scratch(g.spark)
    own, k = g.table("events"), F.get_json_object("props", "$.k")
    about_ = F.array(F.concat(F.lit("user"), F.col("user_id").cast("string")), F.concat(F.lit("k"), k))
    rows = own.select(F.col("user_id").alias("actor"), F.col("event_type").alias("tool"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("occurred_at"), "event_id", "value", about_.alias("about"))
    rows.unionAll(rows.filter("event_id % 3 = 0")).withColumn("part", F.rand(5)).repartitionByRange(batches, "part").drop("part").write.parquet(f"{at}/in")
    ledger = Ledger.at(g.spark, f"{at}/ledger")
    run(g.spark.readStream.schema(g.spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), ledger, f"{at}/state")
    return ledger


@query(f"WITH {ABOUT} SELECT 'ABOUT' AS type, CAST(event_id AS VARCHAR) AS src, entity AS dst FROM about UNION ALL SELECT 'SUPERSEDED_BY', CAST(event_id AS VARCHAR), CAST(superseded_by AS VARCHAR) FROM decision WHERE superseded_by IS NOT NULL")
def t1_decision_ingest(g: Graph) -> DataFrame:
    """The edges that taking in the decisions makes, whatever batches they come in."""
    return streamed(g).edges()


@query(f"WITH {ABOUT} SELECT d.event_id, d.occurred_at, string_agg(DISTINCT a.entity, '|' ORDER BY a.entity) AS about FROM decision d JOIN about a USING (event_id) WHERE a.entity LIKE '%k1%' GROUP BY 1, 2 ORDER BY d.occurred_at DESC, d.event_id DESC LIMIT 21")
def t2_query(g: Graph) -> DataFrame:
    hits = about(g).filter(F.col("entity").contains("k1")).groupBy("event_id").agg(joined_set("entity").alias("about"))
    return keyset_page(g.decision.join(hits, "event_id").select("event_id", "occurred_at", "about"), "occurred_at", "event_id", 20)


@query("SELECT event_id, tool, actor FROM decision WHERE superseded_by IS NULL")
def t3_current(g: Graph) -> DataFrame:
    return temporal.current(g.decision).select("event_id", "tool", "actor")


@query("SELECT d.event_id FROM decision d WHERE d.occurred_at <= '2024-01-15T23:59:59Z' AND NOT EXISTS (SELECT 1 FROM decision s WHERE s.event_id = d.superseded_by AND s.occurred_at <= '2024-01-15T23:59:59Z')")
def t4_as_of(g: Graph) -> DataFrame:
    return temporal.as_of(g.decision, "2024-01-15").select("event_id")


@query("""SELECT event_id, occurred_at, kind FROM (SELECT event_id, occurred_at, 'decision' AS kind FROM decision WHERE actor < 75 UNION SELECT event_id, occurred_at, 'contribution' FROM decision WHERE tool = 'signup')
          WHERE occurred_at < '2024-01-18T12:00:00.000000' OR (occurred_at = '2024-01-18T12:00:00.000000' AND event_id < 5) ORDER BY occurred_at DESC, event_id DESC, kind LIMIT 61""")
def t5_ledger(g: Graph) -> DataFrame:
    rows = g.decision.filter("actor < 75").select("event_id", "occurred_at", F.lit("decision").alias("kind")).unionAll(g.decision.filter("tool = 'signup'").select("event_id", "occurred_at", F.lit("contribution"))).distinct()
    at = "2024-01-18T12:00:00.000000"
    return rows.filter((F.col("occurred_at") < at) | ((F.col("occurred_at") == at) & (F.col("event_id") < 5))).orderBy(F.col("occurred_at").desc(), F.col("event_id").desc(), "kind").limit(61)


@query("SELECT a.event_id, a.actor, a.tool, a.occurred_at AS valid_from, s.occurred_at AS valid_to FROM decision a LEFT JOIN decision s ON s.event_id = a.superseded_by WHERE a.occurred_at <= '2024-01-10T00:00:00' AND (s.occurred_at IS NULL OR s.occurred_at > '2024-01-10T00:00:00')")
def t6_assertion_lineage(g: Graph) -> DataFrame:
    """Assertions valid at a time: from their own to their superseder's."""
    ends = g.decision.select(F.col("event_id").alias("superseded_by"), F.col("occurred_at").alias("valid_to"))
    t = "2024-01-10T00:00:00"
    rows = g.decision.filter(F.col("occurred_at") <= t).join(ends, "superseded_by", "left").filter(F.col("valid_to").isNull() | (F.col("valid_to") > t))
    return rows.select("event_id", "actor", "tool", F.col("occurred_at").alias("valid_from"), "valid_to")


@query("SELECT actor, tool, max_by(value, (occurred_at, event_id)) AS value, count(*) AS versions FROM decision GROUP BY 1, 2".replace("max_by(value, (occurred_at, event_id))", "arg_max(value, occurred_at || lpad(CAST(event_id AS VARCHAR), 12, '0'))"))
def t7_projection(g: Graph) -> DataFrame:
    """The latest finding of each pair, and how many there were, as a stream of decisions leaves them stored."""
    return streamed(g).findings.read().select(F.col("actor").cast("long").alias("actor"), "tool", "value", "versions")


@query("SELECT o.event_id AS output, i.event_id AS input FROM events o JOIN events i ON i.user_id = o.user_id AND CAST(i.ts AS DATE) = CAST(o.ts AS DATE) WHERE o.event_type = 'purchase' AND i.event_type = 'view'")
def t8_artifact_edges(g: Graph) -> DataFrame:
    """DERIVED_FROM: what a user bought on what the user viewed that day."""
    rows = g.table("events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type")
    out = rows.filter("event_type = 'purchase'").select(F.col("event_id").alias("output"), "user_id", "day")
    return out.join(rows.filter("event_type = 'view'").select(F.col("event_id").alias("input"), "user_id", "day"), ["user_id", "day"]).select("output", "input")


CHAIN = """WITH RECURSIVE e AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, '{"actor":' || user_id || ',"event_id":' || event_id || ',"tool":"' || event_type || '"}' AS event FROM events),
    c AS (SELECT chain, seq, CAST(NULL AS VARCHAR) AS prev, 'sha256:' || sha256(chr(10) || event) AS digest, event FROM e WHERE seq = 1
          UNION ALL SELECT e.chain, e.seq, c.digest, 'sha256:' || sha256(c.digest || chr(10) || e.event), e.event FROM c JOIN e ON e.chain = c.chain AND e.seq = c.seq + 1)"""


def chains(g: Graph) -> DataFrame:
    text = F.concat(F.lit('{"actor":'), F.col("user_id").cast("string"), F.lit(',"event_id":'), F.col("event_id").cast("string"), F.lit(',"tool":"'), F.col("event_type"), F.lit('"}'))
    return temporal.chained(g.table("events").select("user_id", "event_id", text.alias("event")), "user_id", ["event_id"], "event")


@query(CHAIN + " SELECT chain, seq, prev, digest FROM c")
def t9_hash_chain(g: Graph) -> DataFrame:
    return chains(g).select("chain", "seq", "prev", "digest")


@query(CHAIN + ", bad AS (SELECT chain, seq, 'digest' AS reason FROM c WHERE seq = 7 AND chain % 10 = 3 UNION ALL SELECT chain, seq + 1, 'link' FROM c x WHERE seq = 9 AND chain % 10 = 4 AND EXISTS (SELECT 1 FROM c y WHERE y.chain = x.chain AND y.seq = 10)) SELECT chain, min(seq) AS seq, arg_min(reason, seq) AS reason FROM bad GROUP BY 1")
def t10_chain_verify(g: Graph) -> DataFrame:
    """Some chains get a changed event, some lose an entry; a truncated tail stays unseen."""
    rows = chains(g)
    changed = F.when((F.col("seq") == 7) & (F.col("chain") % 10 == 3), F.concat("event", F.lit(" "))).otherwise(F.col("event"))
    return temporal.broken(rows.withColumn("event", changed).filter("NOT (seq = 9 AND chain % 10 = 4)"))


@query("WITH k AS (SELECT sha256(event_type || '|decision_log|' || (event_id // 3)) AS key, event_id, event_id // 9 % 3 AS third FROM events) SELECT key, min(event_id) AS event_id FROM k WHERE third > 0 AND key NOT IN (SELECT key FROM k WHERE third < 2) GROUP BY 1")
def t11_append_only(g: Graph) -> DataFrame:
    """Log and intake are two thirds of the events each, and share one."""
    key = F.sha2(F.concat("event_type", F.lit("|decision_log|"), F.floor(F.col("event_id") / 3).cast("string")), 256)
    rows = g.table("events").select(key.alias("key"), "event_id")
    return temporal.inserted(rows.filter("event_id div 9 % 3 < 2"), rows.filter("event_id div 9 % 3 > 0"), "key", "event_id")


@query("SELECT sha256(event_type) AS mapping_sha, sha256(props) AS source_sha, count(*) AS writes, min(event_id) AS first_id, max(user_id) AS last_actor FROM events GROUP BY 1, 2")
def t12_contributions(g: Graph) -> DataFrame:
    return g.table("events").groupBy(F.sha2("event_type", 256).alias("mapping_sha"), F.sha2("props", 256).alias("source_sha")).agg(F.count(F.lit(1)).alias("writes"), F.min("event_id").alias("first_id"), F.max("user_id").alias("last_actor"))
