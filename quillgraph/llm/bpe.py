"""Byte-level BPE encoding and decoding in padded numpy matrices.

Pieces (matches of the split pattern) are put into matrices of equal padded length, one row a piece, one
cell a token. In each round every row merges its leftmost pair of minimum rank; ranks of pairs come from
an open-addressing hash table probed for whole matrices, and a gather compacts the rows. Finished rows
leave the matrix. Pieces longer than LONG bytes, where a round a merge would be quadratic, are merged with
a heap, by the same rule.

Null texts count as empty: no tokens, and the digests of nothing.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillgraph.llm.common import own, texts

NONE = np.int32(2**31 - 1)
LONG = 512
#: Pieces remembered by a worker, at most, and bytes of text that are split at a time.
REMEMBERED, SLICE = 400_000, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file, by token."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PairTable:
    """Ranks of pairs of token ids, by open addressing with linear probing; lookups are for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        size = 1 << max(4, (4 * len(pairs)).bit_length())
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        keys = np.fromiter((a << 32 | b for a, b in pairs), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        at, self.probes = self.place(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[at] < 0
            slot, which = np.unique(np.where(free, at, -1), return_index=True)
            won = which[slot >= 0]
            self.keys[at[won]], self.ranks[at[won]] = keys[won], ranks[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            keys, ranks, at = keys[lost], ranks[lost], (at[lost] + 1) & self.mask

    def place(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(40)) & np.uint64(self.mask)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class ByteBPE:
    """Encoder and decoder for a table of ranks and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs, self.table = pairs, PairTable(pairs)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def merge_matrix(self, rows: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Token ids of pieces given as a matrix of byte tokens, padded with -1."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(rows)
        ids = np.arange(len(rows))
        while len(rows):
            width = rows.shape[1]
            if width > 1:
                keys = (rows[:, :-1].astype(np.int64) << 32) | (rows[:, 1:].astype(np.int64) & 0xFFFFFFFF)
                ranks = np.full(keys.shape, NONE, np.int32)
                real = rows[:, 1:] >= 0
                ranks[real] = self.table[keys[real]]
                best = ranks.argmin(1)
                lowest = ranks[np.arange(len(rows)), best]
                open_ = lowest != NONE
            else:
                open_ = np.zeros(len(rows), bool)
            for i in np.flatnonzero(~open_):
                out[ids[i]] = rows[i, : lengths[i]]
            rows, lengths, ids = rows[open_], lengths[open_], ids[open_]
            if not len(rows):
                break
            best, lowest = best[open_], lowest[open_]
            n = np.arange(len(rows))
            rows[n, best] = lowest
            take = np.arange(width - 1) + (np.arange(width - 1) > best[:, None])
            rows = np.take_along_axis(rows, take, 1)
            lengths = lengths - 1
            rows = rows[:, : int(lengths.max())]
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Token ids of one long piece: a heap of pairs by rank and place, over a linked list of tokens."""
        token = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(token)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := self.pairs.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and after[i] == j and self.pairs.get((token[i], token[j])) == rank):
                continue
            token[i], alive[j], after[i] = rank, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.pairs.get((token[a], token[b]))) is not None:
                    heapq.heappush(heap, (r, a, b))
        return np.array([t for t, kept in zip(token, alive, strict=True) if kept], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece; pieces that are tokens themselves need no merging."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > LONG:
                out[i] = self.merge_long(p)
            elif p:
                rest.append(i)
        lengths = np.array([len(pieces[i]) for i in rest], np.int64)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            width = -(-int(lengths[order[at]]) // 4) * 4  # buckets of four lengths
            end = int(np.searchsorted(lengths[order], width, "right"))
            end = min(end, at + max(1, (1 << 19) // width))
            chosen = order[at:end]
            n = lengths[chosen]
            rows = np.full((len(chosen), int(n.max())), -1, np.int32)
            rows[np.arange(rows.shape[1]) < n[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces[rest[i]] for i in chosen), np.uint8)]
            for i, ids in zip(chosen, self.merge_matrix(rows, n), strict=True):
                out[rest[i]] = ids
            at = end
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        if not len(n):
            return b""
        at = np.arange(int(n.sum())) + np.repeat(self.begin[ids] - (np.cumsum(n) - n), n)
        return self.bytes[at].tobytes()


class BatchEncoder:
    """A worker's encoder: remembers the ids of a bounded number of pieces between batches."""

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.split, self.known = bpe, regex.compile(bpe.pattern).findall, {}

    def encode(self, batch: list[str]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(batch):
            end, size = at, 0
            while end < len(batch) and (end == at or size + len(batch[end]) <= SLICE):
                size += len(batch[end])
                end += 1
            split = [self.split(t) for t in batch[at:end]]
            if len(self.known) > REMEMBERED:
                self.known = {}
            new = list({p for pieces in split for p in pieces if p not in self.known})
            ids = self.bpe.encode_pieces([p.encode() for p in new])
            self.known.update(zip(new, (i.astype("<u4").tobytes() for i in ids), strict=True))
            get = self.known.__getitem__
            for pieces in split:
                yield np.frombuffer(b"".join(map(get, pieces)), "<u4")
            at = end


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, by the ranks at a path (read on the driver).

    with_ids: the ids too, as an array. One row a row of docs, repeated rows and null doc_ids included.
    """
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BatchEncoder(ByteBPE(*shared.value))
        for batch in batches:
            rows = []
            for ids in encoder.encode(texts(batch.column("text"))):
                raw = ids.tobytes()
                rows.append((len(ids), sha256(raw).hexdigest(), sha256(encoder.bpe.decode(ids)).hexdigest(), ids.astype(np.int32) if with_ids else None))
            n, a, b, ids = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(own(docs, "doc_id").cast("long").alias("doc_id"), own(docs, "text").cast("string").alias("text")).mapInArrow(run, schema)
