"""Exact dedup by counting quotient filters.

1. Each partition fingerprints its normalised texts (64 bits of SHA-256) and builds one counting quotient
   filter for each fingerprint range it meets (from HELD fingerprints on it begins new ones): quotients are
   slots, remainders lie sorted in runs behind occupied and run-end bits, counts beside them. Nothing is
   lost: quotient and remainder give back the fingerprint.
2. The filters of a range are merged pair by pair, as sorted streams of remainders, counts added.
3. Fingerprints with a count above one are routed to byte verification: only documents with such a
   fingerprint are compared, by their whole bytes, with map-side aggregation, so that a group of copies
   travels as one text from each task. Fingerprints of very many documents (at most HEAVY of them can
   exist, as each holds 1/HEAVY of all rows) are salted for the joins of documents with classes.

Cases: null texts count as empty; texts differing only in A-Z/a-z are equal; of equal texts the row with
the largest doc_id stays, null doc_ids being smallest; of repeated rows (same doc_id and text) exactly one
stays. A text of any length is hashed whole. An empty table gives an empty result. Other columns are
ignored, whatever their names, also if they differ from doc_id and text in case only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import own, written

#: A fingerprint is heavy, and salted, if it holds at least this part of all rows.
HEAVY = 512
#: Fingerprints that one merged range holds, about; fingerprints that a partition holds before it gives out its filters.
RANGE, HELD = 100_000, 4_000_000
#: Copies whose keys may be broadcast to drop them, at most.
LOOKED_UP = 500_000


class CountingQuotientFilter:
    """Exact multiset of fingerprints of `bits` bits: sorted runs of remainders, with counts.

    The slot of the i-th fingerprint (in order) is max(its quotient, slot before + 1), as linear probing in
    sorted order gives; occupied marks quotients that have a run, run_end the last slot of each run.
    """

    def __init__(self, bits: int, qbits: int, occupied: np.ndarray, run_end: np.ndarray, remainder: np.ndarray, count: np.ndarray):
        self.bits, self.qbits, self.occupied, self.run_end, self.remainder, self.count = bits, qbits, occupied, run_end, remainder, count

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        counts = np.ones(len(fingerprints), np.int64) if counts is None else counts
        order = np.argsort(fingerprints, kind="stable")
        return cls.of_sorted(fingerprints[order].astype(np.uint64), bits, counts[order])

    @classmethod
    def of_sorted(cls, prints: np.ndarray, bits: int, counts: np.ndarray) -> CountingQuotientFilter:
        first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)
        prints, counts = prints[first], (np.add.reduceat(counts, first) if len(first) else counts)
        qbits = min(bits, max(1, int(len(prints) * 4 / 3).bit_length()))
        quotient = (prints >> np.uint64(bits - qbits)).astype(np.int64)
        i = np.arange(len(prints))
        slot = i + np.maximum.accumulate(quotient - i) if len(i) else i
        size = max(1 << qbits, int(slot[-1]) + 1 if len(slot) else 0)
        occupied, run_end = np.zeros(1 << qbits, bool), np.zeros(size, bool)
        occupied[quotient] = True
        run_end[slot[np.concatenate([quotient[1:] != quotient[:-1], [True]])] if len(i) else i] = True
        remainder, count = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        remainder[slot] = prints & np.uint64((1 << (bits - qbits)) - 1)
        count[slot] = counts
        return cls(bits, qbits, occupied, run_end, remainder, count)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints in order, counts): the k-th occupied quotient owns the run that ends at the k-th run end."""
        used = np.flatnonzero(self.count)
        run = np.cumsum(self.run_end)[used] - self.run_end[used]  # runs that ended before the slot
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return (quotient << np.uint64(self.bits - self.qbits)) | self.remainder[used], self.count[used]

    def to_bytes(self) -> bytes:
        used = self.count > 0
        head = np.array([self.bits, self.qbits, len(self.count)], "<i8").tobytes()
        width = -(-(self.bits - self.qbits) // 8)
        left = self.remainder[used].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        many = self.count[used] > 1
        big = self.count[used][many].astype("<i8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.run_end, used)) + left.tobytes() + np.packbits(many).tobytes() + big

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        bits, qbits, size = (int(x) for x in np.frombuffer(raw, "<i8", 3))
        at = 24

        def flags(n: int) -> np.ndarray:
            nonlocal at
            out = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at))[:n].astype(bool)
            at += -(-n // 8)
            return out

        occupied, run_end, used = flags(1 << qbits), flags(size), flags(size)
        n, width = int(used.sum()), -(-(bits - qbits) // 8)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        many = flags(n)
        counts = np.ones(n, np.int64)
        counts[many] = np.frombuffer(raw, "<i8", int(many.sum()), at)
        remainder, count = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        remainder[used], count[used] = wide.view("<u8").ravel(), counts
        return cls(bits, qbits, occupied, run_end, remainder, count)

    @classmethod
    def merge(cls, filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The filter of all fingerprints: two sorted streams at a time become one, and counts of equal ones are added."""
        parts = list(filters)
        streams = [f.items() for f in parts]
        while len(streams) > 1:
            pairs = [merged(*streams[k], *streams[k + 1]) for k in range(0, len(streams) - 1, 2)]
            streams = pairs + streams[2 * len(pairs) :]
        return cls.of_sorted(streams[0][0], parts[0].bits, streams[0][1])


def merged(a: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted arrays as one, with their counts: each value goes as many places on as the other array has before it."""
    prints, counts = np.empty(len(a) + len(b), a.dtype), np.empty(len(a) + len(b), np.int64)
    for own, own_counts, other, side in ((a, a_counts, b, "left"), (b, b_counts, a, "right")):
        at = np.arange(len(own)) + np.searchsorted(other, own, side)
        prints[at], counts[at] = own, own_counts
    return prints, counts


def digests(docs: DataFrame, with_body: bool = False) -> DataFrame:
    """doc_id, fp (64 bits), digest (SHA-256) of each normalised text; with_body: and its bytes."""
    schema = "doc_id long, fp long, digest binary" + ", body binary" * with_body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = pc.ascii_lower(batch.column("text").fill_null("")).cast(pa.binary()).to_pylist()
            digest = [sha256(b).digest() for b in bodies]
            fp = np.frombuffer(b"".join(d[:8] for d in digest), "<i8")
            columns = {"doc_id": batch.column("doc_id"), "fp": pa.array(fp), "digest": pa.array(digest, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns | ({"body": pa.array(bodies, pa.binary())} if with_body else {}))

    return docs.select(own(docs, "doc_id").cast("long").alias("doc_id"), own(docs, "text").cast("string").alias("text")).mapInArrow(run, schema)


def repeated_fingerprints(prints: DataFrame, n_rows: int) -> DataFrame:
    """fp and n of the fingerprints that occur more than once, from merged counting quotient filters."""
    high = max(8, min(24, (n_rows // RANGE).bit_length()))  # bits that name the range
    spread = 1 << high

    def filters_of(prints: list[np.ndarray]) -> pa.RecordBatch:
        fp = np.sort(np.concatenate(prints))
        ranges, first = np.unique(fp >> np.uint64(64 - high), return_index=True)
        low = fp & np.uint64((1 << (64 - high)) - 1)
        filters = [CountingQuotientFilter.of_sorted(x, 64 - high, np.ones(len(x), np.int64)).to_bytes() for x in np.split(low, first[1:])] if len(fp) else []
        return pa.RecordBatch.from_pydict({"range": pa.array(ranges.astype(np.int32)), "filter": pa.array(filters, pa.binary())})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, held = [], 0
        for batch in batches:
            prints.append(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            held += batch.num_rows
            if held >= HELD:
                yield filters_of(prints)
                prints, held = [], 0
        if held:
            yield filters_of(prints)

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        low, n = CountingQuotientFilter.merge(map(CountingQuotientFilter.from_bytes, group["filter"])).items()
        fp = (low | (np.uint64(key[0]) << np.uint64(64 - high))).view(np.int64)
        return pd.DataFrame({"fp": fp[n > 1], "n": n[n > 1]})

    filters = prints.select("fp").mapInArrow(build, "range int, filter binary")
    return filters.repartition(min(spread, max(16, n_rows // 50_000)), "range").groupBy("range").applyInPandas(merge, "fp long, n long")


def heavy_salts(repeated: DataFrame, n_rows: int) -> DataFrame:
    """fp and salts of the fingerprints with 1/HEAVY of all rows or more: HEAVY rows at most."""
    least = max(1000, n_rows // HEAVY)
    return F.broadcast(repeated.filter(F.col("n") >= least).select("fp", F.ceil(F.col("n") / least).cast("int").alias("salts")))


def salted(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """rows with a salt: one of several if the fingerprint is heavy, else 0."""
    return rows.join(heavy, "fp", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "row"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")


def with_all_salts(keys: DataFrame, heavy: DataFrame) -> DataFrame:
    """A row of keys for every salt of its fingerprint."""
    return keys.join(heavy, "fp", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def verified_classes(docs: DataFrame, repeated: DataFrame, heavy: DataFrame) -> DataFrame:
    """fp, digest, keep_id and group_size of the groups of equal texts, compared byte by byte."""
    bodies = salted(digests(docs, with_body=True).withColumn("row", F.monotonically_increasing_id()), heavy)
    routed = bodies.join(with_all_salts(repeated.select("fp"), heavy), ["fp", "salt"], "left_semi")
    groups = routed.groupBy("fp", "digest", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.filter("group_size > 1").select("fp", "digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs; of repeated rows one is kept."""
    prints = written(digests(docs).withColumn("row", F.monotonically_increasing_id()), "digests")
    n_rows = prints.count()
    repeated = written(repeated_fingerprints(prints, n_rows), "repeated")
    heavy = heavy_salts(repeated, n_rows)
    classes = written(verified_classes(docs, repeated, heavy), "classes")
    # The first row of each group's largest doc_id; repeated rows beyond it go. Partial maxima travel, not rows.
    stays = prints.groupBy("fp", "digest").agg(F.max(F.struct("doc_id", (-F.col("row")).alias("row"))).alias("last")).select("fp", "digest", (-F.col("last.row")).alias("stays"))
    fates = with_all_salts(classes.join(stays, ["fp", "digest"]), heavy)
    found = salted(prints, heavy).join(fates, ["fp", "digest", "salt"], "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("stays"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns as they were."""
    report = written(exact_dedup(docs).filter("group_size > 1").select("doc_id", "kept", "text_sha256"), "copies")
    rows = report.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    gone = rows.filter("not kept").select("doc_id", "text_sha256")
    # Few keys go to every task, so that the texts stay where they are; report has a row at least for each.
    gone = F.broadcast(gone) if report.count() <= LOOKED_UP else gone
    twice = rows.filter("kept and rows > 1").select("doc_id", "text_sha256")
    schema = "doc_id long, sha string, row " + docs.select(F.struct(*(own(docs, c) for c in docs.columns)).alias("row")).schema["row"].dataType.simpleString()

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = pc.ascii_lower(batch.column("text").fill_null("")).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sha256(b).hexdigest() for b in bodies], pa.string()), batch.column("row")], names=["doc_id", "sha", "row"])

    tagged = docs.select(own(docs, "doc_id").cast("long").alias("doc_id"), own(docs, "text").cast("string").alias("text"), F.struct(*(own(docs, c) for c in docs.columns)).alias("row")).mapInArrow(tag, schema)

    def same(other: DataFrame):
        return (tagged["sha"] == other["text_sha256"]) & tagged["doc_id"].eqNullSafe(other["doc_id"])

    out = tagged.join(gone, same(gone), "left_anti")
    if not twice.isEmpty():
        repeated = tagged.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "sha"])
        out = out.join(twice, same(twice), "left_anti").unionByName(repeated)
    return out.select("row.*")
