"""Toxicity: a convolutional text classifier trained in numpy.

Words (runs of letters, digits and bytes beyond ASCII, A-Z lower-cased) are hashed to 64 bits; a hash table
of the words that most labelled texts have gives each an embedding, all others share one. Filters of
several widths run over the whole text, each keeps its maximum, and a logistic layer scores these. One
coordinate of the embeddings starts from the words' log odds, the rest at random; all of it is trained.
Thresholds are calibrated by language: a helper predicts the language from the same words, and each
language's threshold is moved to 0.5 by a monotone stretch of the scores.

Fitting takes every word of every labelled row that is not held out, a quarter of them for the thresholds.
Rows are dealt by a hash to learners of LEARNER rows, about. In each epoch every learner trains the network
on its rows, one slice after the other, and their weighted mean is the next network; words, languages and scores
are counted by Spark. The driver gets what the model has (VOCABULARY words, LANGUAGES, BINS), never texts. A
score sees nothing but the text.

Cases: null and empty texts are scored like a text without words; several labels of one document count
as the highest; labels without documents, null labels and null doc_ids teach nothing; without labelled texts of
both kinds all scores are 0. Repeated rows are scored alike. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, held_out, map_arrow, may_learn, own, slices, text_buffers, trimmed, written
from quillgraph.llm.language_id import LOWER
from quillgraph.llm.words import word_codes, words_of

#: Rows of a learner, about; labels that may be broadcast to look up their texts, at most.
LEARNER, LOOKED_UP = 4096, 500_000
#: Languages that have a threshold of their own, bins of the scores that thresholds are chosen from, parts of a network that is averaged.
LANGUAGES, BINS, PARTS = 64, 1 << 14, 16
EPOCHS = 4
#: Words embedded, embedding size, filter widths, filters of each width, slots of the hash table.
VOCABULARY, SIZE, WIDTHS, FILTERS, SLOTS = 20_000, 12, (1, 2, 3), 6, 1 << 18
BETWEEN = np.ones(256, bool)
BETWEEN[48:58] = BETWEEN[65:91] = BETWEEN[97:123] = BETWEEN[128:] = False


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, index of each text's first word)."""
    offsets, data = text_buffers(column)
    data = LOWER[data]
    words = words_of(offsets, data, BETWEEN)
    return word_codes(words, data), words.first


@dataclass
class Vocabulary:
    """An id for each known hash: a slot holds one hash, the most frequent that falls there; 1 is any other word."""

    holder: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> Vocabulary:
        """hashes: in order of importance."""
        holder, number = np.zeros(SLOTS, np.uint64), np.ones(SLOTS, np.int32)
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        slot, first = np.unique(slot, return_index=True)
        holder[slot], number[slot] = hashes[first], np.arange(2, len(slot) + 2)
        return cls(holder, number)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        return np.where(self.holder[slot] == hashes, self.number[slot], 1)


def padded(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts' ids with id 0 after each text, as often as the widest filter needs, and one window at least."""
    gap = max(WIDTHS)
    n = np.diff(first)
    begin = np.concatenate([[0], np.cumsum(n + gap)])
    out = np.zeros(int(begin[-1]), np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)) * gap, n)] = ids
    return out, begin


@dataclass
class Network:
    embedding: np.ndarray  # words x SIZE; row 0 (padding) is zero
    kernels: list[np.ndarray]  # of each width: width x SIZE x FILTERS
    shift: np.ndarray
    output: np.ndarray
    bias: float

    @classmethod
    def start(cls, log_odds: np.ndarray, seed: int = 11) -> Network:
        random = np.random.default_rng(seed)
        embedding = random.normal(0, 0.1, (len(log_odds), SIZE)).astype(np.float32)
        embedding[:, 0] = log_odds
        embedding[0] = 0
        kernels = [random.normal(0, 0.3 / w, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        for k in kernels:
            k[0, 0] = np.abs(k[0, 0]) + 0.3
        n = FILTERS * len(WIDTHS)
        return cls(embedding, kernels, np.zeros(n, np.float32), random.normal(0.2, 0.1, n).astype(np.float32), -1.0)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.embedding, *self.kernels, self.shift, self.output)] + [[self.bias]]).astype(np.float32)

    def filled(self, flat: np.ndarray) -> Network:
        """A network of this shape with the numbers of flat()."""
        shapes = [x.shape for x in (self.embedding, *self.kernels, self.shift, self.output)]
        parts = np.split(flat.astype(np.float32), np.cumsum([int(np.prod(x)) for x in shapes]))
        first, *kernels, shift, output = (x.reshape(shape) for x, shape in zip(parts, shapes, strict=False))
        return Network(first, kernels, shift, output, float(parts[-1][0]))

    def tables(self) -> list[np.ndarray]:
        """What each word adds to the filters of each width at each place: convolutions become look-ups and sums."""
        return [self.embedding @ k[j] for k in self.kernels for j in range(len(k))]

    def pooled(self, ids: np.ndarray, begin: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """The maxima of all filters over each text."""
        n, gap, out, at = len(ids), max(WIDTHS), [], 0
        # Windows that begin in the padding belong to no text, but for the first one of an empty text.
        real = np.ones(n, bool)
        for k in range(1, gap + 1):
            real[begin[1:] - k] = False
        real[begin[:-1]] = True
        for w in WIDTHS:
            value = tables[at][ids]
            for j in range(1, w):
                value[: n - j] += tables[at + j][ids[j:]]
            at += w
            value[~real] = -np.inf
            out.append(np.maximum.reduceat(value, begin[:-1], axis=0))
        return np.concatenate(out, 1)

    def raw_scores(self, ids: np.ndarray, begin: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        if len(begin) < 2:
            return np.zeros(0)
        hidden = np.maximum(self.pooled(ids, begin, tables) + self.shift, 0)
        return 1 / (1 + np.exp(-(hidden @ self.output + self.bias)))


class Learner:
    """Adam on the logistic loss; only the windows that won the pooling pass gradients down."""

    def __init__(self, net: Network, batch: int = 64, pace: float = 0.01, seed: int = 12) -> None:
        self.net, self.batch, self.pace = replace(net, kernels=[k.copy() for k in net.kernels]), batch, pace
        self.random, self.step, self.rows = np.random.default_rng(seed), 0, 0
        self.mean = {k: np.zeros_like(getattr(net, k)) for k in ("embedding", "shift", "output")} | {f"k{i}": np.zeros_like(k) for i, k in enumerate(net.kernels)}
        self.square = {k: np.zeros_like(v) for k, v in self.mean.items()}

    def learn(self, ids: np.ndarray, begin: np.ndarray, target: np.ndarray) -> None:
        """One pass over padded texts."""
        net, length = self.net, np.diff(begin)
        self.rows += len(target)
        for rows in np.array_split(self.random.permutation(len(target)), max(1, len(target) // self.batch)):
            self.step += 1
            own = np.concatenate([ids[begin[i] : begin[i + 1]] for i in rows])
            start = np.concatenate([[0], np.cumsum(length[rows])])
            x = net.embedding[own]
            maxima, winners = [], []
            for w, kernel in zip(WIDTHS, net.kernels, strict=True):
                value = np.full((len(own), FILTERS), -np.inf, np.float32)
                value[: len(own) - w + 1] = sum(x[j : len(own) - w + 1 + j] @ kernel[j] for j in range(w))
                best = np.stack([start[i] + value[start[i] : max(start[i] + 1, start[i + 1] - max(WIDTHS))].argmax(0) for i in range(len(rows))])
                winners.append(best)
                maxima.append(np.take_along_axis(value, best, 0))
            z = np.concatenate(maxima, 1) + net.shift
            hidden = np.maximum(z, 0)
            score = 1 / (1 + np.exp(-(hidden @ net.output + net.bias)))
            error = ((score - target[rows]) / len(rows)).astype(np.float32)
            grad = {"output": hidden.T @ error + 1e-4 * net.output}
            down = error[:, None] * net.output * (z > 0)
            grad["shift"] = down.sum(0)
            grad["embedding"] = np.zeros_like(net.embedding)
            for i, (w, kernel, best) in enumerate(zip(WIDTHS, net.kernels, winners, strict=True)):
                d = down[:, i * FILTERS : (i + 1) * FILTERS]
                grad[f"k{i}"] = np.stack([np.einsum("rfs,rf->sf", x[best + j], d) for j in range(w)]) + 1e-4 * kernel
                for j in range(w):
                    np.add.at(grad["embedding"], own[best + j], d[:, :, None] * kernel[j].T[None])
            grad["embedding"][0] = 0
            for k, g in grad.items():
                mean, square = self.mean[k], self.square[k]
                mean += 0.1 * (g - mean)
                square += 0.01 * (g * g - square)
                change = self.pace * (mean / (1 - 0.9**self.step)) / (np.sqrt(square / (1 - 0.99**self.step)) + 1e-6)
                if k[0] == "k":
                    net.kernels[int(k[1:])] -= change
                else:
                    setattr(net, k, getattr(net, k) - change)
            net.bias -= 0.05 * float(error.sum())


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network
    tables: list[np.ndarray]
    tongue: np.ndarray  # words x languages: log shares
    threshold: np.ndarray  # by language

    def scores(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        ids = self.vocabulary.ids(hashes)
        return self.stretched(self.network.raw_scores(*padded(ids, first), self.tables), self.languages(ids, first))

    def languages(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(first) - 1, self.tongue.shape[1]))
        full = np.flatnonzero(np.diff(first))
        if len(full):
            sums[full] = np.add.reduceat(self.tongue[ids], first[:-1][full], axis=0)
        return sums.argmax(1)

    def stretched(self, raw: np.ndarray, language: np.ndarray) -> np.ndarray:
        t = self.threshold[language]
        return np.clip(np.where(raw < t, 0.5 * raw / t, 0.5 + 0.5 * (raw - t) / (1 - t)), 0, 1)


def best_threshold(raw: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold with the most right answers, in the middle of the gap that it lies in: good and bad texts have each
    of the different scores raw, which ascend."""
    right = np.concatenate([[0], np.cumsum(good)]) + bad.sum() - np.concatenate([[0], np.cumsum(bad)])
    edge = np.concatenate([[0.0], raw, [1.0]])
    best = np.flatnonzero(right == right.max())
    k = best[np.argmax(edge[best + 1] - edge[best])]
    return float(np.clip((edge[k] + edge[k + 1]) / 2, 0.02, 0.98))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """text, toxic, lang, judge (whether it is for the thresholds), learner and place (an order) of every row that may be learnt from."""
    marked = labels.filter(F.col("toxic").isNotNull() & may_learn(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(F.col("toxic").isin(0, 1))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    few = sum(counts.values()) <= LOOKED_UP
    lang = own(docs, "lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(own(docs, "doc_id").cast("long").alias("doc_id"), own(docs, "text").cast("string").alias("text"), lang.alias("lang")).filter(may_learn(F.col("doc_id")))
    rows = rows.join(F.broadcast(marked) if few else marked, "doc_id")
    place = F.xxhash64("doc_id", F.lit("toxicity"))
    learner = F.pmod(F.shiftright(place, 8), F.lit(-(-3 * sum(counts.values()) // (4 * LEARNER))))
    return rows.select("text", "toxic", F.coalesce("lang", F.lit("")).alias("lang"), (F.pmod(place, F.lit(4)) == 0).alias("judge"), learner.alias("learner"), place.alias("place"))


def vocabulary_of(rows: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The words that most of rows have, three rows at least, and for each id in how many rows without and with label 1."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, first = hashed_words(batch.column("text"))
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((row, hashes))
        hashes, row = hashes[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        word, at = np.unique(hashes[new], return_inverse=True)
        bad = np.bincount(at, weights=batch.column("toxic").to_numpy()[row[new]], minlength=len(word)).astype(np.int64)
        return pa.RecordBatch.from_pydict({"word": pa.array(word.view(np.int64)), "n": pa.array(np.bincount(at, minlength=len(word))), "bad": pa.array(bad)})

    sums = map_arrow(rows.select("text", "toxic"), count, "word long, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    often = sums.filter("n >= 3").orderBy(F.desc("n"), "word").limit(VOCABULARY).toArrow()
    word, n, bad = (often.column(c).to_numpy() for c in ("word", "n", "bad"))
    vocabulary = Vocabulary.of(word.view(np.uint64))
    hits = np.zeros((2, int(vocabulary.number.max()) + 1))
    number = vocabulary.ids(word.view(np.uint64))
    held = number > 1
    hits[0, number[held]], hits[1, number[held]] = (n - bad)[held], bad[held]
    return vocabulary, hits


def numbered(rows: DataFrame, vocabulary: Vocabulary, names: list[str]) -> DataFrame:
    """toxic, language, judge, learner, place and the ids of all words of rows."""
    shared, of = rows.sparkSession.sparkContext.broadcast(vocabulary), {v: i for i, v in enumerate(names)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, first = hashed_words(batch.column("text"))
        ids = shared.value.ids(hashes).astype(np.int32)
        language = pa.array([of.get(v, len(of)) for v in batch.column("lang").to_pylist()], pa.int32())
        words = pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_pydict({"words": words, "language": language} | {c: batch.column(c) for c in ("toxic", "judge", "learner", "place")})

    return map_arrow(rows, run, "words binary, language int, toxic int, judge boolean, learner long, place long")


def packed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, index of each text's first word)."""
    offsets, data = text_buffers(batch.column("words"))
    return np.frombuffer(data.tobytes(), np.int32), offsets // 4


def tongues(rows: DataFrame, size: int, n_languages: int) -> np.ndarray:
    """For each word and language the logarithm of the word's share."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * n_languages, np.int64)
        for batch in batches:
            for part in slices(batch):
                ids, first = packed(part)
                total += np.bincount(ids.astype(np.int64) * n_languages + np.repeat(part.column("language").to_numpy(), np.diff(first)), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(seen), "n": pa.array(total[seen])})

    sums = rows.select("words", "language").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.ones(size * n_languages)
    out[sums.column("at").to_numpy()] += sums.column("n").to_numpy()
    out = out.reshape(size, n_languages)
    out = np.log(out / out.sum(0))
    out[:2] = 0
    return out


def epoch(rows: DataFrame, net: Network, seed: int) -> Network:
    """The mean of what the learners make of net, each on its rows, which stand together."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        now, learner, total, n = None, None, None, 0

        def ended() -> None:
            nonlocal total, n
            if learner is not None:
                flat = learner.net.flat().astype(np.float64) * learner.rows
                total, n = flat if total is None else total + flat, n + learner.rows

        for batch in batches:
            for part in slices(batch):
                of = part.column("learner").to_numpy()
                for a, b in zip(edges := np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])), edges[1:]):  # noqa: B905
                    if of[a] != now:
                        ended()
                        now, learner = of[a], Learner(shared.value, seed=seed)
                    own_part = part.slice(a, b - a)
                    learner.learn(*padded(*packed(own_part)), own_part.column("toxic").to_numpy().astype(np.float32))
        ended()
        if n:
            cut = [x.tobytes() for x in np.array_split(total, PARTS)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.arange(PARTS, dtype=np.int32)), "n": pa.array([n] * PARTS, pa.int64()), "total": pa.array(cut, pa.binary())})
        trimmed()

    def mean(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in group.column("total"))
        return pa.table({"part": group.column("part").slice(0, 1), "mean": pa.array([(total / sum(group.column("n").to_pylist())).tobytes()], pa.binary())})

    sums = rows.select("words", "toxic", "learner").mapInArrow(run, "part int, n long, total binary")
    means = {r["part"]: r["mean"] for r in sums.groupBy("part").applyInArrow(mean, "part int, mean binary").collect()}  # PARTS rows, one network together
    return net.filled(np.concatenate([np.frombuffer(means[k]) for k in range(PARTS)]))


def judged(rows: DataFrame, model: Model) -> DataFrame:
    """language (predicted), bin (of the score), toxic and how many of rows have them."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, first = packed(batch)
        raw = shared.value.network.raw_scores(*padded(ids, first), shared.value.tables)
        said = shared.value.languages(ids, first)
        return pa.RecordBatch.from_pydict({"language": pa.array(said.astype(np.int32)), "bin": pa.array(np.minimum(raw * BINS, BINS - 1).astype(np.int32)), "toxic": batch.column("toxic")})

    return map_arrow(rows.select("words", "toxic"), run, "language int, bin int, toxic int").groupBy("language", "bin").agg(F.count_if(F.col("toxic") == 0).alias("good"), F.count_if(F.col("toxic") == 1).alias("bad"))


def learn(docs: DataFrame, labels: DataFrame, seed: int = 12) -> Model | None:
    """A model from all words of all labelled rows; what comes to the driver has a bound."""
    rows = labelled(docs, labels)
    if rows is None:
        return None
    have = {(r["judge"], r["toxic"]): r["n"] for r in rows.groupBy("judge", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = {c: have.get((False, c), 0) + have.get((True, c), 0) for c in (0, 1)}
    if not every[0] or not every[1]:
        return None
    taught = {c: have.get((False, c), 0) for c in (0, 1)}
    if not taught[0] or not taught[1]:  # so few rows that each is needed
        rows, taught = rows.withColumn("judge", F.lit(False)), every
    learning = rows.filter("NOT judge")
    vocabulary, hits = vocabulary_of(learning)
    odds = np.log((hits[1] + 0.5) / (taught[1] + 1)) - np.log((hits[0] + 0.5) / (taught[0] + 1))
    odds[:2] = 0
    often = learning.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    names = sorted(r["lang"] for r in often[:LANGUAGES])
    n_languages = max(1, len(often))  # all languages after LANGUAGES are one more
    # A learner's rows stand in one file, in the order of their places.
    files = 4 * -(-sum(every.values()) // LEARNER)
    table = written(numbered(rows, vocabulary, names).repartition(files, "judge", "learner").sortWithinPartitions("judge", "learner", "place"), "numbered")
    mine = table.filter("NOT judge")
    net = Network.start((odds / 3).astype(np.float32))
    for k in range(EPOCHS):
        net = epoch(mine, net, seed + k)
    model = Model(vocabulary, net, net.tables(), tongues(mine, len(odds), n_languages), np.full(n_languages, 0.5))
    apart = sum(every.values()) - sum(taught.values()) > 50
    found = judged(table.filter("judge") if apart else mine, model).toArrow()
    language, score_, good, bad = (found.column(c).to_numpy() for c in ("language", "bin", "good", "bad"))
    for k in range(n_languages):
        at = np.flatnonzero(language == k)
        at = at[np.argsort(score_[at])]
        if good[at].sum() + bad[at].sum() >= 20:
            model.threshold[k] = best_threshold((score_[at] + 0.5) / BINS, good[at], bad[at])
    discard(table)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        out = np.zeros(batch.num_rows)
        column = batch.column("text")
        for at in range(0, batch.num_rows, 1024) if model else ():
            hashes, first = hashed_words(column.slice(at, 1024))
            out[at : at + 1024] = model.scores(hashes, first)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(out)})

    source = docs.select(own(docs, "doc_id").cast("long").alias("doc_id"), own(docs, "text").cast("string").alias("text"))
    found = map_arrow(source, run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
