"""The event log as a stream, run to completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.lineage import scratch
from quillgraph.plans.registry import query
from quillgraph.plans.views import Graph
from quillgraph.streaming import event_log


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def st1_idempotent_intake(g: Graph) -> DataFrame:
    """Every event sent twice and taken once, in bounded batches."""
    at = scratch(g.spark)
    doubled = g.table("events").unionAll(g.table("events"))
    doubled.repartition(4).write.parquet(f"{at}/in")
    stream = event_log.read_log(g.spark, f"{at}/in")
    event_log.run_once(event_log.idempotent(stream, late="400 days"), f"{at}/out", f"{at}/state")
    return g.spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
