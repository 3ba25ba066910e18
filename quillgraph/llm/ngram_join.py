"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A text's set has its distinct shingles of `size` words (with fewer words the whole sequence as one). Two texts
link if 100 |A & B| >= percent |A | B|; the result names components of links. Equal sets are one class, and
classes are searched for each other:

1. Tokens are hashes of shingles, headed by the logarithm of how often their bucket (of BUCKETS) occurs, so that
   numbers order them by rarity. A set of n shares at least T = ceil(percent n / 100) tokens with any similar
   one, so of its n inverted lists the T - 1 longest may be set aside: a similar set occurs in a short one, of
   the first n - T + 1 tokens (`prefixes`). Only short lists are made, and those with a single entry go
   (`shared_posts`).
2. First every class is searched in the pivots of its lists alone: the class with the fewest rarer tokens. That
   settles groups of near copies, as most lists then hold one component; only lists that span several stay open,
   and of these a class gets only the entries of other components (`open_lists`).
3. The open lists of a class are merged by a heap (`merged`): what occurs in them must have, with the places where
   it occurs, enough tokens left to reach the overlap that both sizes ask for, and parities of tokens that differ
   in no more bits than similar sets may differ in tokens. The lists set aside are not scanned but probed for these candidates (`probed`): by binary search of their tokens in the candidate's set.

Rounds of components join the links. A list is dealt in blocks of about BLOCK entries, so no list fills a row or
a task; its cost is the square of how many different components it holds after step 2. Sets are compared as
57-bit hashes of shingles; within two texts of n shingles these agree wrongly with a probability of
n**2 / 2**57.

Cases: null texts count as empty; empty sets link with nothing and name themselves. Rows that share a doc_id
are documents of their own. Rows without doc_id take part, and their component has no name if no row in it has
a doc_id. Repeated rows are one class. Texts of any length are cut whole. An empty table gives an empty
result. Only doc_id and text are read; columns with other names, whatever these are, do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, map_arrow, mix64, own, slices, text_buffers, written
from quillgraph.llm.simhash import components
from quillgraph.llm.words import range_hashes, rolling, word_hashes, words_of

SIZE, PERCENT = 3, 90
BUCKETS, HASH_BITS = 1 << 20, 57
HASH = np.uint64((1 << HASH_BITS) - 1)
#: Posts that a task packs at a time; bytes of text for each bucket of tokens and for each partition, about.
CHUNK, BUCKET, PARTITION = 300_000, 4_000_000, 8_000_000
#: Entries of a block of an open list, about; classes whose keys may be broadcast to look up their texts, at most.
BLOCK, LOOKED_UP = 512, 500_000
#: Parities of a set; bytes of text that one task counts tokens of, at least, as each sends up to BUCKETS counts.
BITS, COUNTED = 1024, 64_000_000
LAST = 2**63 - 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
POST = np.dtype([("p", "<i8"), ("id", "<i8"), ("n", "<i4"), ("place", "<i4"), ("count", "i1")])
RANKED = np.dtype([*((c, POST[c]) for c in ("p", "id", "n", "place")), ("count", "<i4"), ("dk", "<i8")])


def rows_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, dk and th (the place in the order of documents, and a hash that tells rows of one doc_id apart), and more columns of docs."""
    doc_id, text = own(docs, "doc_id").cast("long"), F.coalesce(own(docs, "text").cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("dk"), F.hash(text, F.xxhash64(text)).alias("th"), text.alias("text"), *more)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of a column's texts, repeats included; rows ascend."""
    offsets, data = text_buffers(column)
    words = words_of(offsets, data)
    hashes, count = word_hashes(words, LOWER[data]), words.counts
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + words.first[row]
    long = rolling(hashes, size)
    value = long[np.minimum(at, max(len(long) - 1, 0))] if len(long) else np.zeros(len(row), np.uint64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        value[(count < size)[row]] = range_hashes(hashes, words.first[short], words.first[short + 1])
    return row, value


def rarities(rows: DataFrame, size: int, tasks: int) -> np.ndarray:
    """Twice the logarithm of how many shingles fall into each of BUCKETS buckets: a table of 1 MB for any corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount((shingles(part.column("text"), size)[1] & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen.astype(np.int32)), "n": pa.array(total[seen])})

    # BUCKETS rows at most come to the driver, whatever the corpus.
    sums = rows.select("text").coalesce(tasks).mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.uint8)
    out[sums.column("id").to_numpy()] = np.minimum(2 * np.log2(sums.column("n").to_numpy()), 62).astype(np.uint8)
    return out


def token_sets(column: pa.Array, size: int, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all texts one after the other, each text's ascending and distinct; how many each text has)."""
    row, value = shingles(column, size)
    token = (value & HASH).astype(np.int64) | (rarity[(value & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.int64) << HASH_BITS)
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    return token[new], np.bincount(row[new], minlength=len(column))


def parities(token: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each set BITS bits, each the parity of how many of its tokens name it: sets differ in as many tokens at least
    as their bits differ."""
    out = np.zeros(len(n) * BITS // 64, np.uint64)
    np.bitwise_xor.at(out, np.repeat(np.arange(len(n)) * (BITS // 64), n) + (token >> 6 & (BITS // 64 - 1)), np.uint64(1) << (token & 63).astype(np.uint64))
    return out.reshape(len(n), -1)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The fewest tokens that a set of n shares with any similar set."""
    return -(-n * percent // 100)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def prefixes(rows: DataFrame, size: int, percent: int, rarity: Broadcast) -> DataFrame:
    """doc_id, dk, th, n, a, b (two digests of the set), t (the tokens of short lists) and bits (parities) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        token, n = token_sets(batch.column("text"), size, rarity.value)
        end = np.cumsum(n)
        digests = [range_hashes(mix64(token.view(np.uint64) ^ np.uint64(key)), end - n, end).view(np.int64) for key in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        kept = np.where(n > 0, n - least_overlap(n, percent) + 1, 0)
        place = np.arange(len(token)) - np.repeat(end - n, n)
        t = lists(token[place < np.repeat(kept, n)], kept)
        bits = pa.array([x.tobytes() for x in parities(token, n)], pa.binary())
        own_columns = {c: batch.column(c) for c in ("doc_id", "dk", "th")}
        return pa.RecordBatch.from_pydict(own_columns | {"n": pa.array(n.astype(np.int32)), "a": pa.array(digests[0]), "b": pa.array(digests[1]), "t": t, "bits": bits})

    return map_arrow(rows, run, "doc_id long, dk long, th int, n int, a long, b long, t array<long>, bits binary")


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: bytes that hardly differ lie together and compress to nothing."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def of_planes(raw: bytes, kind: np.dtype, n: int, at: int) -> np.ndarray:
    """The n numbers whose planes() begin at `at`."""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).view(kind).ravel()


def shared_posts(classes: DataFrame, buckets: int, partitions: int, ranked: bool = False) -> DataFrame:
    """p, id, n, place of the tokens in t that two classes or more have there; ranked: dk, and entries, which has at the
    first post of each token (by dk, then id) how many it has, else 0.

    Of the posts of one token in a chunk the first goes to the token's bucket, with their count; the others are known
    to be shared (their counts are negative) and go anywhere, so that no token fills a bucket.
    """
    kind, most = (RANKED, 2**31 - 1) if ranked else (POST, 2)
    out = ("p", "id", "n", "place", *(("dk", "entries") if ranked else ()))

    def pack(parts: list[np.ndarray]) -> pa.RecordBatch:
        posts = np.concatenate(parts)
        if ranked:
            posts = posts[np.lexsort((posts["id"], posts["dk"]))]
        _, first, inverse, total = np.unique(posts["p"], return_index=True, return_inverse=True, return_counts=True)
        bucket = ((posts["p"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        rest = np.ones(len(posts), bool)
        rest[first] = False
        posts["count"] = np.where(rest, -1, 1) * np.minimum(total[inverse], most)
        bucket[rest] = np.flatnonzero(rest) % buckets
        order = np.argsort(bucket, kind="stable")
        ids, cut = np.unique(bucket[order], return_index=True)
        return pa.RecordBatch.from_pydict({"bucket": pa.array(ids.astype(np.int32)), "pack": pa.array([b"".join(planes(x[c]) for c in kind.names) for x in np.split(posts[order], cut[1:])], pa.binary())})

    def unpack(packs: list[bytes]) -> dict[str, np.ndarray]:
        """The fields of packs, each of which has the planes of one field after the other."""
        found: dict[str, list[np.ndarray]] = {c: [] for c in kind.names}
        for x in packs:
            n, at = len(x) // kind.itemsize, 0
            for c in kind.names:
                found[c].append(of_planes(x, kind[c], n, at))
                at += n * kind[c].itemsize
        return {c: np.concatenate(v) for c, v in found.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            n_tokens = np.diff(batch.column("t").offsets.to_numpy())
            posts = np.zeros(int(n_tokens.sum()), kind)
            posts["p"] = batch.column("t").flatten().to_numpy()
            for c in ("id", "n", *(("dk",) if ranked else ())):
                posts[c] = np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n_tokens)
            posts["place"] = np.arange(len(posts)) - np.repeat(np.cumsum(n_tokens) - n_tokens, n_tokens)
            parts.append(posts)
            held += len(posts)
            if held >= CHUNK:
                yield pack(parts)
                parts, held = [], 0
        if held:
            yield pack(parts)

    def settle(packs: list[bytes]) -> pa.RecordBatch:
        posts = unpack(packs)
        kept = posts["count"] < 0
        at = np.flatnonzero(~kept)
        if ranked:
            at = at[np.lexsort((posts["id"][at], posts["dk"][at]))]
        _, first, inverse = np.unique(posts["p"][at], return_index=True, return_inverse=True)
        entries = np.bincount(inverse, weights=posts["count"][at]).astype(np.int64)
        kept[at] = entries[inverse] > 1
        posts["entries"] = np.zeros(len(kept), np.int64)
        posts["entries"][at[first]] = entries
        return pa.RecordBatch.from_pydict({c: pa.array(posts[c][kept]) for c in out})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, pack_ in zip(batch.column("bucket").to_pylist(), batch.column("pack").to_pylist(), strict=True):
                if bucket != now and held:
                    yield settle(held)
                    held = []
                now = bucket
                held.append(pack_)
        if held:
            yield settle(held)

    packs = classes.select("id", "n", "t", *(("dk",) if ranked else ())).mapInArrow(deal, "bucket int, pack binary")
    return packs.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "p long, id long, n int, place int" + ", dk long, entries long" * ranked)


def alike_in_length(percent: int, a: str, b: str) -> Column:
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def enough_follow(percent: int, n: Column, place: Column, m: Column, other: Column) -> Column:
    """Sets of n and m that meet at these places may overlap enough, with all before and all after in common."""
    return (F.least(place, other) + F.least(n - place, m - other)) * (100 + percent) >= (n + m) * percent


def pivot_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """id, other: each class with the pivots of its lists that it may be similar to."""
    pivots = posts.groupBy("p").agg(F.min(F.struct("place", "id", "n")).alias("x")).select("p", F.col("x.id").alias("other"), F.col("x.n").alias("m"), F.col("x.place").alias("there"))
    met = posts.join(pivots, "p").filter((F.col("id") != F.col("other")) & alike_in_length(percent, "n", "m"))
    return met.filter(enough_follow(percent, F.col("n"), F.col("place"), F.col("m"), F.col("there"))).select("id", "other").distinct()


def entries_for(queries: DataFrame, entries: DataFrame, fits: Callable[[Column], Column], block: int = BLOCK) -> DataFrame:
    """id, n, place, found: for each post of queries (p, id, n, place and more) the entries (p, id, n, place, entries and
    more) of its list that fit, dealt in blocks of about `block`. entries: how many the list has."""
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("entries") / block))
    columns = [c for c in entries.columns if c not in ("p", "entries")]
    blocks = entries.groupBy("p", part.alias("block")).agg(F.collect_list(F.struct(*columns)).alias("entry")).select("p", "entry")
    found = F.transform(F.filter("entry", fits), lambda x: F.struct(x["id"].alias("id"), x["n"].alias("n"), x["place"].alias("place")))
    return queries.join(blocks, "p").select("id", "n", "place", found.alias("found")).filter(F.size("found") > 0)


def open_lists(posts: DataFrame, roots: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """id, n, place, found: for a class and a list of its that spans components, the entries of others that are as
    large or larger (of the same size: with a larger id) and may be similar."""
    named = posts.join(roots, posts["id"] == roots["node"], "left").select("p", "id", "n", "place", F.coalesce("root", "id").alias("root"))
    spread = named.groupBy("p").agg(F.count(F.lit(1)).alias("entries"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("p", "entries")
    named = written(named.join(spread, "p"), "open")
    fits = lambda x: (
        (x["root"] != F.col("root"))
        & ((x["n"] > F.col("n")) | ((x["n"] == F.col("n")) & (x["id"] > F.col("id"))))
        & (F.col("n") * 100 >= x["n"] * percent)
        & enough_follow(percent, F.col("n"), F.col("place"), x["n"], x["place"])
    )
    return entries_for(named, named, fits, block)


def occurring(n: int, lists_: list[tuple[int, list[tuple[int, int, int]]]], percent: int) -> list[int]:
    """The candidates of a set of n in its short lists, merged by a heap: (place in the set, entries (id, m, place there),
    by id) of each list. One stays if what it has in common so far and what may follow reach the overlap needed."""
    out, now, common, last, there, m = [], None, 0, 0, 0, 0

    def settled() -> bool:
        return now is not None and (common + min(n - last, m - there) - 1) * (100 + percent) >= (n + m) * percent

    # Lists come in order of their place in the set, so the last entry of a candidate is that of its last common token.
    for id_, place, size, other in merge(*([(i, place, size, other) for i, size, other in entries] for place, entries in lists_)):
        if id_ != now:
            if settled():
                out.append(now)
            now, common = id_, 0
        common, last, there, m = common + 1, place, other, size
    if settled():
        out.append(now)
    return out


def merged(lists_: DataFrame, percent: int, partitions: int) -> DataFrame:
    """id, other: the candidates of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, held = None, 0, {}
        for batch in batches:
            left, right = [], []
            for id_, size, place, found in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "place", "found")), strict=True):
                if id_ != now:
                    if held:
                        other = occurring(n, [(k, sorted(v)) for k, v in held.items()], percent)
                        left += [now] * len(other)
                        right += other
                    now, n, held = id_, size, {}
                held.setdefault(place, []).extend((x["id"], x["n"], x["place"]) for x in found)
            yield pa.RecordBatch.from_pydict({"id": pa.array(left, pa.int64()), "other": pa.array(right, pa.int64())})
        if held:
            other = occurring(n, [(k, sorted(v)) for k, v in held.items()], percent)
            yield pa.RecordBatch.from_pydict({"id": pa.array([now] * len(other), pa.int64()), "other": pa.array(other, pa.int64())})

    return lists_.repartition(partitions, "id").sortWithinPartitions("id", "place").mapInArrow(run, "id long, other long")


def sets_of(ids: DataFrame, classes: DataFrame, rows: DataFrame, size: int, rarity: Broadcast) -> DataFrame:
    """id, t: the whole sets of the classes in ids. Only their texts are cut again."""
    wanted = classes.select("id", "dk", "th").join(ids, "id", "left_semi")
    met = rows.join(F.broadcast(wanted) if ids.count() <= LOOKED_UP else wanted.hint("shuffle_hash"), ["dk", "th"]).select("id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"id": batch.column("id"), "t": lists(*token_sets(batch.column("text"), size, rarity.value))})

    return map_arrow(met, run, "id long, t array<long>")


def probed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int, rarity: Broadcast) -> DataFrame:
    """src, dst of the pairs (id, other) that are similar: the tokens of one are looked up in the other's by binary search.

    Pairs whose parities differ in more bits than similar sets may differ in tokens go before any set is made.
    """
    sides = classes.select("id", "n", "bits")
    near = pairs.join(sides, "id").join(sides.select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("bits").alias("bits2")), "other")

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("bits", "bits2"))
        both = sum(batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
        keep = pa.array(np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) * (100 + percent) <= both * (100 - percent))
        return pa.RecordBatch.from_pydict({c: batch.column(c).filter(keep) for c in ("id", "other")})

    pairs = written(map_arrow(near.select("id", "other", "n", "m", "bits", "bits2"), compare, "id long, other long"), "alike")
    ids = written(pairs.select("id").union(pairs.select("other")).distinct(), "ids")
    # Repeated rows give sets twice; their links are made one below.
    sets = written(sets_of(ids, classes, rows, size, rarity), "sets")
    both = pairs.join(sets.withColumnRenamed("t", "s"), "id").join(sets.select(F.col("id").alias("other"), "t"), "other").select("id", "other", "s", "t")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, bool)
        (s, s_at), (t, t_at) = ((c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch.column("s"), batch.column("t")))
        for k in range(batch.num_rows):
            few, many = s[s_at[k] : s_at[k + 1]], t[t_at[k] : t_at[k + 1]]
            at = np.searchsorted(many, few)
            common = int((many[np.minimum(at, len(many) - 1)] == few).sum())
            keep[k] = common * (100 + percent) >= (len(few) + len(many)) * percent
        return pa.RecordBatch.from_pydict({"src": batch.column("id").filter(pa.array(keep)), "dst": batch.column("other").filter(pa.array(keep))})

    out = written(map_arrow(both, run, "src long, dst long").distinct(), "links")
    for done in (pairs, ids, sets):
        discard(done)
    return out


@dataclass
class Index:
    """The prefixes of all rows, the classes of equal sets in the order of their first document, and the short lists."""

    every: DataFrame
    classes: DataFrame
    posts: DataFrame
    rows: DataFrame
    rarity: Broadcast
    partitions: int
    size: int
    percent: int

    def similar(self, pairs: DataFrame) -> DataFrame:
        return probed(pairs, self.classes, self.rows, self.size, self.percent, self.rarity)


def indexed(docs: DataFrame, size: int, percent: int, ranked: bool = False) -> Index:
    rows = rows_of(docs)
    amount = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(min(100_000, max(16, amount // PARTITION)))
    rarity = rows.sparkSession.sparkContext.broadcast(rarities(rows, size, max(1, amount // COUNTED)))
    wide = written(prefixes(rows, size, percent, rarity), "prefixes")
    first = wide.filter("n > 0").groupBy("a", "b").agg(F.min(F.struct("dk", "th")).alias("at"), F.first("n").alias("n"), F.first("t").alias("t"), F.first("bits").alias("bits"))
    # Written, so that the numbers stay as they are. The short lists are kept once, with the classes.
    classes = written(first.select("a", "b", "at.dk", "at.th", "n", "t", "bits").select(F.monotonically_increasing_id().alias("id"), "*"), "classes")
    every = written(wide.select("doc_id", "dk", "th", "n", "a", "b"), "sets")
    discard(wide)
    posts = written(shared_posts(classes, int(max(64, amount // BUCKET)), partitions, ranked), "posts")
    return Index(every, classes, posts, rows, rarity, partitions, size, percent)


def ngram_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    index = indexed(docs, size, percent)
    every, classes, posts = index.every, index.classes, index.posts
    tried = written(pivot_pairs(posts, percent), "pivots")
    near = index.similar(tried)
    roots = written(components(near), "roots")
    found = merged(open_lists(posts, roots, percent), percent, index.partitions)
    both_ways = tried.union(tried.select("other", "id"))
    more = written(found.join(both_ways, ["id", "other"], "left_anti"), "candidates")
    far = index.similar(more)
    all_roots = components(near.union(far))

    named = classes.select("id", "a", "b", "dk").join(all_roots, F.col("id") == F.col("node"), "left").select("a", "b", "dk", F.coalesce("root", "id").alias("root"))
    lows = named.groupBy("root").agg(F.min("dk").alias("low"))
    # Written, so that the last join deals the documents out anew and a class that many have can be split among tasks.
    names = written(named.join(lows, "root").select("a", "b", F.when(F.col("low") < LAST, F.col("low")).alias("component_id")), "names")
    for done in (posts, tried, near, roots, more, far, classes):
        discard(done)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return every.select("doc_id", "n", "a", "b").join(names, ["a", "b"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
