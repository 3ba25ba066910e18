"""Substring dedup by suffix automata: every window of WINDOW words that starts earlier too is removed.

1. Windows are grouped by their minimizer: the least hash of the GRAM-word sequences in them. Equal windows
   have equal minimizers, so only windows whose minimizer occurs twice can repeat. Runs of neighbouring
   windows with one minimizer form a segment, about one for eight words; segments travel packed and without
   their words, and minimizers that are frequent in one task are settled there.
2. Of equal segments (by minimizer and a digest of the words, two 64-bit hashes with independent keys) the earliest is fetched with its words:
   these are the reference. It is sharded by minimizer, which keeps equal windows in one shard.
3. Each shard's suffix automaton is built in order of place, so that a state knows its first end. The
   shard's segments stream through it: while the matched length is at least WINDOW, the state of the last
   WINDOW words tells the window's earliest place. A minimizer with more than SHARD different segments is
   split: its single windows, equal ones first made one, become shards of their own.
4. Places later than the earliest are marked, ranges of words joined by document and cut out.

Documents go in order of doc_id (null last), words in order of place. Cases: null texts have no words;
texts under WINDOW words lose none; windows of rows that share a doc_id at the same place don't remove
each other, so repeated rows are treated alike; windows may repeat within a document, overlapping
themselves too. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, map_arrow, own, slices, text_buffers, texts, written
from quillgraph.llm.words import joined, rolling, word_hashes, words_of

WINDOW, GRAM, SHARD = 20, 6, 400
REACH = WINDOW - GRAM + 1
#: Segments that a task packs at a time; bytes of text for each bucket of minimizers, about.
CHUNK, BUCKET = 200_000, 4_000_000
LAST = 2**63 - 1


PACKED = np.dtype([("h", "<u8"), ("dg", "<u8"), ("dk", "<i8"), ("th", "<i4"), ("start", "<i4"), ("n", "u1"), ("known", "u1")])


def window_minima(grams: np.ndarray) -> np.ndarray:
    """Minima of REACH neighbours, by doubling."""
    out, width = grams, 1
    while width * 2 <= REACH:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = REACH - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments_of(column: pa.Array) -> np.ndarray:
    """The segments of a column's texts: h (minimizer), dg (digest of the words), dk (here the row), start, n
    (windows), and known where windows may repeat within the segment."""
    offsets, data = text_buffers(column)
    words = words_of(offsets, data)
    hashes = word_hashes(words, data)
    grams = rolling(hashes, GRAM)
    counts = words.counts
    windows = np.maximum(counts - WINDOW + 1, 0)
    row = np.repeat(np.arange(len(counts)), windows)
    if not len(row):
        return np.zeros(0, PACKED)
    place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at_word = words.first[row] + place
    value, gram = window_minima(grams)[at_word], grams[at_word]
    new = np.ones(len(row), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    since = np.arange(len(row)) - np.repeat(at, np.diff(np.append(at, len(row))))
    at = np.flatnonzero(since % REACH == 0)
    out, n = np.zeros(len(at), PACKED), np.diff(np.append(at, len(row)))
    out["h"], out["dk"], out["start"], out["n"] = value[at], row[at], place[at], n
    # The first and the last window cover the words of a segment; their hashes have another key than the minimizer's.
    whole = rolling(word_hashes(words, data, 1), WINDOW)
    out["dg"] = joined(whole[at_word[at]], whole[at_word[at] + n - 1]) + n.astype(np.uint64)
    segment = np.repeat(np.arange(len(at)), n)
    for shift in range(1, REACH):  # equal windows of one segment begin with equal sequences
        same = np.flatnonzero(gram[shift:] == gram[:-shift])
        out["known"][segment[same][segment[same] == segment[same + shift]]] = 1
    return out


def packed_segments(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, pack: the segments of all texts, by ranges of their minimizers.

    Of the segments of one minimizer in a chunk one goes to its bucket; the others are known to repeat and
    go anywhere, so that no minimizer fills a bucket.
    """

    def pack(parts: list[np.ndarray]) -> pa.RecordBatch:
        all_ = np.concatenate(parts)
        _, first, inverse, total = np.unique(all_["h"], return_index=True, return_inverse=True, return_counts=True)
        all_["known"] |= total[inverse] > 1
        # Minima are small numbers: they are spread before their high bits name the bucket.
        bucket = ((all_["h"] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        rest = np.ones(len(all_), bool)
        rest[first] = False
        bucket[rest] = np.flatnonzero(rest) % buckets
        order = np.argsort(bucket, kind="stable")
        ids, cut = np.unique(bucket[order], return_index=True)
        return pa.RecordBatch.from_pydict({"bucket": pa.array(ids.astype(np.int32)), "pack": pa.array([x.tobytes() for x in np.split(all_[order], cut[1:])], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for part in slices(batch):
                own = segments_of(part.column("text"))
                row = own["dk"].copy()
                own["dk"] = part.column("dk").to_numpy(zero_copy_only=False)[row]
                own["th"] = part.column("th").to_numpy(zero_copy_only=False)[row]
                parts.append(own)
                held += len(own)
                if held >= CHUNK:
                    yield pack(parts)
                    parts, held = [], 0
        if held:
            yield pack(parts)

    return rows.select("dk", "th", "text").mapInArrow(run, "bucket int, pack binary")


def repeated_segments(packs: DataFrame, partitions: int) -> DataFrame:
    """h, dg, dk, th, start, n of the segments whose minimizer occurs twice or more."""

    def settle(packs: list[bytes]) -> pa.RecordBatch:
        all_ = np.frombuffer(b"".join(packs), PACKED)
        _, inverse, total = np.unique(all_["h"], return_inverse=True, return_counts=True)
        own = all_[(all_["known"] > 0) | (total[inverse] > 1)]
        wide = {"h": np.uint64, "dg": np.uint64, "dk": np.int64}
        columns = {c: pa.array(own[c].astype(kind).view(np.int64)) for c, kind in wide.items()}
        return pa.RecordBatch.from_pydict(columns | {c: pa.array(own[c].astype(np.int32)) for c in ("th", "start", "n")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, pack in zip(batch.column("bucket").to_pylist(), batch.column("pack").to_pylist(), strict=True):
                if bucket != now and held:
                    yield settle(held)
                    held = []
                now = bucket
                held.append(pack)
        if held:
            yield settle(held)

    return packs.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "h long, dg long, dk long, th int, start int, n int")


def cut_out(rows: DataFrame) -> DataFrame:
    """h, dg, dk, start, content: the segments that a document's `found` names, with their words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(5)]
        columns = [batch.column(c).to_pylist() for c in ("dk", "text", "found")]
        for dk, text, found in zip(*columns, strict=True):
            words = (text or "").encode().split()
            for f in found:
                content = b" ".join(words[f["start"] : f["start"] + f["n"] + WINDOW - 1])
                for o, v in zip(out, (f["h"], f["dg"], dk, f["start"], content), strict=True):
                    o.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["h", "dg", "dk", "start", "content"])

    return map_arrow(rows, run, "h long, dg long, dk long, start int, content binary")


class SuffixAutomaton:
    """Of several sequences, added in order. first: the earliest end of a state's words, as a number that grows
    with the order of adding. Sequences share nothing across their borders."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def add(self, sequence: list, begin: int) -> None:
        next_, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for end, word in enumerate(sequence, begin):
            known = next_[last].get(word)
            if known is not None:
                if length[known] == length[last] + 1:
                    last = known
                else:
                    last = self.clone(last, known, word)
                continue
            state = len(next_)
            next_.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(end)
            p = last
            while p >= 0 and word not in next_[p]:
                next_[p][word] = state
                p = link[p]
            if p >= 0:
                q = next_[p][word]
                link[state] = q if length[q] == length[p] + 1 else self.clone(p, q, word)
            last = state

    def clone(self, p: int, q: int, word) -> int:
        """A state for q's words up to the length of p's and one; q and the transitions of p's suffixes go to it."""
        state = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.first.append(self.first[q])
        self.link[q] = state
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = state
            p = self.link[p]
        return state

    def earliest(self, sequence: list, size: int) -> list[int]:
        """Matching statistics: for each place from the size-th on, the first end of the last `size` words, -1 if none."""
        next_, link, length, first = self.next, self.link, self.length, self.first
        state, matched, out = 0, 0, []
        for i, word in enumerate(sequence):
            while state and word not in next_[state]:
                state = link[state]
                matched = length[state]
            state = next_[state].get(word, 0)
            matched = matched + 1 if state else 0
            while state and length[link[state]] >= size:
                state = link[state]
                matched = length[state]
            if i + 1 >= size:
                out.append(first[state] if matched >= size else -1)
        return out


def shard_runs(contents: list[bytes], dk: list[int], start: list[int]) -> list[list[tuple[int, int, int, int]]]:
    """For each segment of a shard, in order of place: runs (first window, windows, dk and start of the earliest)."""
    automaton, sequences, begins, total = SuffixAutomaton(), [c.split(b" ") for c in contents], [], 0
    for s in sequences:
        begins.append(total)
        automaton.add(s, total)
        total += len(s)
    begins_ = np.array(begins)
    out = []
    for s in sequences:
        ends = np.array(automaton.earliest(s, WINDOW))
        owner = np.searchsorted(begins_, ends, "right") - 1
        runs: list[tuple[int, int, int, int]] = []
        for j, (o, e) in enumerate(zip(owner.tolist(), ends.tolist(), strict=True)):
            at = (dk[o], start[o] + e - begins[o] - WINDOW + 1)
            if runs and runs[-1][2] == at[0] and runs[-1][3] + runs[-1][1] == at[1]:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1, *runs[-1][2:])
            else:
                runs.append((j, 1, *at))
        out.append(runs)
    return out


RUNS = "array<struct<from: int, n: int, dk: long, start: int>>"


def searched(shards: DataFrame, partitions: int) -> DataFrame:
    """h, dg, runs of each segment; shards has h, part, dg, dk, start, content, and h and part name the shard."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        runs = []
        cut = [i for i in range(len(held)) if not i or held[i][:2] != held[i - 1][:2]] + [len(held)]
        for a, b in zip(cut, cut[1:], strict=False):
            runs += shard_runs([r[5] for r in held[a:b]], [r[3] for r in held[a:b]], [r[4] for r in held[a:b]])
        kind = pa.list_(pa.struct([("from", pa.int32()), ("n", pa.int32()), ("dk", pa.int64()), ("start", pa.int32())]))
        values = pa.array([[dict(zip(("from", "n", "dk", "start"), x, strict=True)) for x in r] for r in runs], kind)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[2] for r in held], pa.int64()), values], names=["h", "dg", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("h", "part", "dg", "dk", "start", "content")]
            for row in zip(*columns, strict=True):
                if len(held) >= 2000 and row[:2] != held[-1][:2]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    ordered = shards.repartition(partitions, "h", "part").sortWithinPartitions("h", "part", "dk", "start")
    return ordered.select("h", "part", "dg", "dk", "start", "content").mapInArrow(run, f"h long, dg long, runs {RUNS}")


def windows_of(hot: DataFrame) -> DataFrame:
    """h, dg, j, part, dk, start, content of the single windows of segments; part digests a window's words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for row in batch.to_pylist():
            words = row["content"].split(b" ")
            for j in range(len(words) - WINDOW + 1):
                content = b" ".join(words[j : j + WINDOW])
                for o, v in zip(out, (row["h"], row["dg"], j, xxhash.xxh64_intdigest(content) - 2**63, row["dk"], row["start"] + j, content), strict=True):
                    o.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["h", "dg", "j", "part", "dk", "start", "content"])

    return map_arrow(hot.select("h", "dg", "dk", "start", "content"), run, "h long, dg long, j int, part long, dk long, start int, content binary")


def earliest_runs(refs: DataFrame, partitions: int, shard: int = SHARD) -> DataFrame:
    """h, dg, runs: where the windows of each different segment occur first."""
    # Written, so that the joins deal refs out anew and a crowded minimizer's entries can be split among tasks.
    crowded = written(refs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard).select("h"), "crowded")
    calm = refs.join(crowded, "h", "left_anti").withColumn("part", F.lit(0).cast("long"))
    single = written(windows_of(refs.join(crowded, "h", "left_semi")), "windows")
    first = F.min(F.struct("dk", "start"))
    distinct = single.groupBy("h", "part").agg(first.alias("at"), F.first("content").alias("content")).select("h", "part", F.col("part").alias("dg"), "at.dk", "at.start", "content")
    windows = searched(distinct, partitions).select("h", F.col("dg").alias("part"), F.col("runs")[0].alias("run"))
    back = single.select("h", "dg", "j", "part").join(windows, ["h", "part"])
    one = F.struct(F.col("j").alias("from"), F.lit(1).alias("n"), F.col("run.dk").alias("dk"), F.col("run.start").alias("start"))
    return searched(calm, partitions).unionByName(back.groupBy("h", "dg").agg(F.collect_list(one).cast(RUNS).alias("runs")))


def marked_words(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows of docs with dk and th; dk, th, ranges: the words to remove of each document that has some).

    dk orders documents; th, a hash of the text, tells rows that share a doc_id apart.
    """
    spark = docs.sparkSession
    doc_id, text = own(docs, "doc_id").cast("long"), own(docs, "text").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("dk"), F.hash(text, F.xxhash64(text)).alias("th"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(min(100_000, max(16, size // 8_000_000)))
    found = written(repeated_segments(packed_segments(rows, int(max(64, size // BUCKET))), partitions), "found")
    # Equal segments are one entry of the reference: the earliest. A document has as many as words at most.
    entries = found.groupBy("h", "dg").agg(F.min(F.struct("dk", "start", "th", "n")).alias("at")).select("h", "dg", "at.*")
    wanted = entries.groupBy("dk", "th").agg(F.collect_set(F.struct("h", "dg", "start", "n")).alias("found"))
    refs = written(cut_out(rows.join(wanted.hint("shuffle_hash"), ["dk", "th"])), "reference")  # repeated rows give entries twice, which does no harm
    runs = written(earliest_runs(refs, partitions), "runs")
    each = found.join(runs, ["h", "dg"]).select("dk", "th", F.col("start").alias("own"), F.explode("runs").alias("run"))
    later = (F.col("run.dk") < F.col("dk")) | ((F.col("run.dk") == F.col("dk")) & (F.col("run.start") < F.col("own") + F.col("run.from")))
    ranges = each.filter(later).select("dk", "th", F.struct((F.col("own") + F.col("run.from")).alias("from"), (F.col("own") + F.col("run.from") + F.col("run.n") + WINDOW - 1).alias("to")).alias("range"))
    marks = written(ranges.groupBy("dk", "th").agg(F.collect_set("range").alias("ranges")), "marks")
    for done in (found, refs, runs):
        discard(done)
    return rows, marks


def substring_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs; with_text: and kept, the words that stay."""
    rows, marks = marked_words(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, digest, kept = [], [], [], []
        for text, ranges in zip(texts(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
            words = text.encode().split()
            n_words.append(len(words))
            if ranges:
                change = np.zeros(len(words) + 1, np.int64)
                for r in ranges:
                    change[r["from"]] += 1
                    change[r["to"]] -= 1
                stay = np.cumsum(change[:-1]) == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            n_removed.append(n_words[-1] - len(words))
            body = b" ".join(words)
            digest.append(sha256(body).hexdigest())
            kept.append(body.decode() if with_text else None)
        columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(kept, pa.string())} if with_text else {}))

    joined = rows.join(marks.hint("shuffle_hash"), ["dk", "th"], "left").select("doc_id", "text", "ranges")
    return map_arrow(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
