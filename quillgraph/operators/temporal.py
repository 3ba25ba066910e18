"""Temporal provenance: as-of reads, supersession, hash chains."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def end_of(moment: str) -> str:
    """A bare date stands for the end of its day."""
    return f"{moment}T23:59:59Z" if len(moment) == 10 else moment


def as_of(decisions: DataFrame, moment: str) -> DataFrame:
    """Decisions made by then and not superseded by one made by then: an anti-join on the id, with the time beside it."""
    t = end_of(moment)
    made = decisions.filter(F.col("occurred_at") <= t)
    later = made.select(F.col("event_id").alias("superseded_by"))
    return made.join(later, "superseded_by", "left_anti")


def current(decisions: DataFrame) -> DataFrame:
    known = decisions.select(F.col("event_id").alias("superseded_by"))
    return decisions.join(known, "superseded_by", "left_anti")


def digest(prev: str | None, event: str) -> str:
    return "sha256:" + sha256(f"{prev or ''}\n{event}".encode()).hexdigest()


def chained(events: DataFrame, chain: str, order: list[str], event: str) -> DataFrame:
    """chain, seq, prev, digest, event: each chain folded in order.

    A chain is a sequence by nature; it is streamed through one task batch by batch, never held as a whole.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, prev, seq = None, None, 0
        for rows in batches:
            out = []
            for key, text in zip(rows[chain], rows[event], strict=True):
                if key != now:
                    now, prev, seq = key, None, 0
                seq += 1
                own = digest(prev, text)
                out.append((key, seq, prev, own, text))
                prev = own
            yield pd.DataFrame(out, columns=["chain", "seq", "prev", "digest", "event"])

    ordered = events.repartition(chain).sortWithinPartitions(chain, *order).select(chain, event)
    kind = ordered.schema[chain].dataType.simpleString()
    return ordered.mapInPandas(fold, f"chain {kind}, seq long, prev string, digest string, event string")


def broken(entries: DataFrame) -> DataFrame:
    """chain, seq, reason of the first bad entry of each chain: an entry meets the one before it by number, so that a
    chain of any length is dealt out among tasks."""
    earlier = entries.select("chain", (F.col("seq") + 1).alias("seq"), F.col("digest").alias("before"))
    entries, before = entries.join(earlier, ["chain", "seq"], "left"), F.col("before")
    own = F.concat(F.lit("sha256:"), F.sha2(F.concat(F.coalesce("prev", F.lit("")), F.lit("\n"), F.col("event")), 256))
    reason = F.when(~before.eqNullSafe(F.col("prev")), "link").when(own != F.col("digest"), "digest")
    bad = entries.withColumn("reason", reason).filter("reason IS NOT NULL")
    return bad.groupBy("chain").agg(F.min("seq").alias("seq"), F.min_by("reason", "seq").alias("reason"))


def inserted(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The incoming rows that an append-only log takes: one of each key, none that it has."""
    fresh = incoming.join(stored.select(key), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min(order).alias(order))
    return fresh.join(first, [key, order], "left_semi")
