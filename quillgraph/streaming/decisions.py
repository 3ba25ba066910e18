"""Decisions as a stream into stored frames: supersession, what they are about, and findings, exactly once.

Each micro-batch is one chunk of every frame (sources.store), so a batch that runs again after a failure changes
nothing that it had written, and completes what it had not. A batch reads the stored decisions of its own actors
and tools only. What it makes depends on the decisions alone, not on how they were dealt to batches: late ones are
put into their place, and those before them get a new successor; repeated ones are taken once.

Cases: a decision without actor, tool, time or event_id is refused by the frame, with an error. Two versions of one
event_id with the same actor, tool and time are one decision, the first one taken stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.sources.store import Store

GROUP = ["actor", "tool"]
ORDER = ["occurred_at", "event_id"]
DECISION = "actor string, tool string, occurred_at string, event_id string, value double, superseded_by string"


def in_time() -> list[Column]:
    """The order of decisions; of those of one time, numbers go by size."""
    return [F.col("occurred_at"), F.length("event_id"), F.col("event_id")]


@dataclass
class Ledger:
    decisions: Store
    about: Store
    findings: Store

    @classmethod
    def at(cls, spark: SparkSession, path: str, rows: int = 1_000_000) -> Ledger:
        return cls(
            Store(spark, f"{path}/decisions", DECISION, [*GROUP, *ORDER], {"value": "keep", "superseded_by": "newest"}, rows),
            Store(spark, f"{path}/about", "entity string, event_id string, times long", ["entity", "event_id"], {"times": "keep"}, rows),
            Store(spark, f"{path}/findings", "actor string, tool string, value double, versions long", GROUP, {"value": "newest", "versions": "newest"}, rows),
        )

    def take_in(self, batch: DataFrame, chunk: str) -> None:
        """batch: actor, tool, occurred_at, event_id, value and about (a list of entities)."""
        rows = batch.select(*(F.col(c).cast("string").alias(c) for c in (*GROUP, *ORDER)), "value", "about").dropDuplicates([*GROUP, *ORDER])
        groups = rows.select(*GROUP).distinct()
        held = self.decisions.read_groups(groups, GROUP)
        new = rows.join(held.select(*GROUP, *ORDER), [*GROUP, *ORDER], "left_anti").select(*GROUP, *ORDER, "value", F.lit(None).cast("string").alias("superseded_by"), F.lit(True).alias("new"))
        following = F.lead("event_id").over(Window.partitionBy(*GROUP).orderBy(*in_time()))
        placed = held.withColumn("new", F.lit(False)).unionByName(new).withColumn("after", following)
        # Only decisions that came, or whose successor came, are written.
        changed = placed.filter(F.col("new") | ~F.col("after").eqNullSafe(F.col("superseded_by"))).select(*GROUP, *ORDER, "value", F.col("after").alias("superseded_by"))
        self.decisions.merge(changed, chunk)
        tagged = rows.select(F.explode(F.array_distinct("about")).alias("entity"), "event_id").filter("entity IS NOT NULL").distinct()
        self.about.merge(tagged.withColumn("times", F.lit(1).cast("long")), chunk)
        # From what is stored now, so that a batch that runs again finds the same.
        latest = self.decisions.read_groups(groups, GROUP).groupBy(*GROUP).agg(F.max_by("value", F.struct(*in_time())).alias("value"), F.count(F.lit(1)).alias("versions"))
        self.findings.merge(latest, chunk)

    def edges(self) -> DataFrame:
        """type, src, dst: ABOUT and SUPERSEDED_BY."""
        after = self.decisions.read().filter("superseded_by IS NOT NULL").select(F.lit("SUPERSEDED_BY").alias("type"), F.col("event_id").alias("src"), F.col("superseded_by").alias("dst"))
        return after.unionByName(self.about.read().select(F.lit("ABOUT").alias("type"), F.col("event_id").alias("src"), F.col("entity").alias("dst")))


def run(decisions: DataFrame, ledger: Ledger, checkpoint: str) -> None:
    """Everything there is now of a stream of decisions; the checkpoint numbers the batches, and so the chunks."""
    query = decisions.writeStream.foreachBatch(lambda batch, k: ledger.take_in(batch, f"batch-{k}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
