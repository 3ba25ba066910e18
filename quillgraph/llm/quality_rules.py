"""Quality rules: statistics of whole texts, and a learned decision list of threshold conjunctions.

Statistics are made in numpy for whole Arrow batches. Sequential covering learns the list: each rule grows
by the condition with the best information gain (FOIL's) on the growing part of the labelled statistics,
is pruned on the other part, and stays if it is precise there; what it covers leaves the growing part.
The list becomes ordered Spark conditional expressions, so applying it needs no Python.

Cases: null texts count as empty; texts with fewer than 20 words, or with over 30% of their words in
repeated windows, fail the base rules. Without labels of both kinds the list is empty and only the base
rules decide. Repeated labels of a document count once, the worst one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import map_arrow, may_learn, own, text_buffers
from quillgraph.llm.words import SPACE, rolling, word_hashes, words_of

#: Labelled rows that learning uses, at most, chosen by a hash of doc_id: a bounded sample for fitting only.
SAMPLE = 12_000
WINDOW = 8
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
UPPER = np.isin(np.arange(256), np.arange(65, 91))
MARKS = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
NOT_CONTINUED = (np.arange(256) & 0xC0) != 0x80
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long, n_lines long"
#: What rules test: name and the expression of the statistics it stands for.
FEATURES = {
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flagged bytes each text has."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def windows_twice(own: np.ndarray, text: Callable[[], bytes], size: int) -> np.ndarray | None:
    """Which windows of a text it has twice or more, None if none. own: their hashes; what these take as equal is
    compared word for word."""
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    if not same.any():
        return None
    ids: dict[bytes, int] = {}
    words = np.lib.stride_tricks.sliding_window_view(np.array([ids.setdefault(w, len(ids)) for w in text().split()]), size)
    a, b = order[1:][same], order[:-1][same]
    if (words[a] == words[b]).all():
        twice = np.zeros(len(own), bool)
        twice[a] = twice[b] = True
        return twice
    _, group, total = np.unique(words, axis=0, return_inverse=True, return_counts=True)
    return total[group.ravel()] > 1


def repeated_words(hashes: np.ndarray, first: np.ndarray, text: Callable[[int], bytes], size: int = WINDOW) -> np.ndarray:
    """For each text, its words in windows of `size` words that the text has twice or more."""
    out = np.zeros(len(first) - 1, np.int64)
    windows = rolling(hashes, size)
    for i in np.flatnonzero(np.diff(first) > size):
        own = windows[first[i] : first[i + 1] - size + 1]
        twice = windows_twice(own, lambda i=i: text(i), size)
        if twice is not None:
            change = np.zeros(len(own) + size, np.int64)
            at = np.flatnonzero(twice)
            change[at] += 1
            change[at + size] -= 1
            out[i] = int((np.cumsum(change) > 0).sum())
    return out


def duplicate_lines(data: bytes) -> tuple[int, int]:
    """(lines with a word, those of them equal to an earlier one)."""
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def measured(column: pa.Array) -> dict[str, pa.Array]:
    """The statistics of each text of a column."""
    offsets, data = text_buffers(column)
    words = words_of(offsets, data)
    lines = [duplicate_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    n_lines, dup = np.array(lines, np.int64).reshape(-1, 2).T
    found = {
        "n_words": words.counts,
        "word_chars": per_text(NOT_CONTINUED[data] & ~SPACE[data], offsets),
        "n_symbols": per_text(SYMBOLS[data], offsets),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(word_hashes(words, data), words.first, lambda i: data[offsets[i] : offsets[i + 1]].tobytes()),
        "n_upper": per_text(UPPER[data], offsets),
        "n_marks": per_text(MARKS[data], offsets),
        "n_lines": n_lines,
    }
    return {k: pa.array(v.astype(np.int64)) for k, v in found.items()}


def statistics(docs: DataFrame, keep: str = "") -> DataFrame:
    """doc_id, the columns named in keep ("a int, b string"), and the statistics of each whole text."""
    kept = [c.split()[0] for c in keep.split(",") if c.strip()]

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: batch.column(c) for c in ["doc_id", *kept]} | measured(batch.column("text")))

    source = docs.select(own(docs, "doc_id").cast("long").alias("doc_id"), *kept, own(docs, "text").cast("string").alias("text"))
    return map_arrow(source, measure, "doc_id long, " + (keep + ", " if keep else "") + STATISTICS)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def base_failed(of: Callable[[str], Column] = F.col) -> Column:
    """of: the column that holds a statistic."""
    return (of("n_words") < 20) | (of("n_repeat_words") * 100 > of("n_words") * 30)


@dataclass
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, of: Callable[[str], Column]) -> Column:
        value = ratio(*map(of, FEATURES[self.feature]))
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class Rule:
    """A conjunction; documents that it covers are rejected."""

    conditions: list[Condition] = field(default_factory=list)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def grown(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Conditions are added by FOIL gain until no good row is covered or nothing is gained."""
    rule, covered = Rule(), np.ones(len(bad), bool)
    while len(rule.conditions) < 4 and (covered & ~bad).any():
        p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
        best, best_gain = None, 1e-9
        for name, values in x.items():
            own, labels = values[covered], bad[covered]
            order = np.argsort(own, kind="stable")
            own, labels = own[order], labels[order]
            cut = np.flatnonzero(own[1:] > own[:-1])
            if not len(cut):
                continue
            cut = cut[:: max(1, len(cut) // 512)]
            below = np.cumsum(labels)[cut]
            for above, p, total in ((False, below, cut + 1), (True, p0 - below, len(own) - cut - 1)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / total) - np.log2(p0 / (p0 + n0))), 0)
                k = int(gain.argmax())
                if gain[k] > best_gain:
                    best_gain, best = gain[k], Condition(name, above, float((own[cut[k]] + own[cut[k] + 1]) / 2))
        if best is None:
            break
        rule.conditions.append(best)
        covered &= best.holds(x)
    return rule


def pruned(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The prefix of the conditions with the best (p - n) / (p + n) on other rows; its precision and cover there."""
    best, best_worth, precision, cover = rule, -2.0, 0.0, 0
    for k in range(len(rule.conditions), 0, -1):
        short = Rule(rule.conditions[:k])
        hit = short.covers(x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best_worth:
            best, best_worth, precision, cover = short, worth, p / (p + n) if p + n else 0.0, p + n
    return best, precision, cover


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.9, least_cover: int = 3, seed: int = 7) -> list[Rule]:
    """Sequential covering: two thirds of the rows grow rules, one third prunes and judges them."""
    rules: list[Rule] = []
    if not bad.any() or bad.all():
        return rules
    growing = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    at = {True: growing.copy(), False: ~growing}
    while len(rules) < 12 and (bad & at[True]).sum() >= least_cover:
        part = lambda side: ({k: v[at[side]] for k, v in x.items()}, bad[at[side]])
        rule = grown(*part(True))
        if not rule.conditions:
            break
        rule, precision, cover = pruned(rule, *part(False))
        if precision < least_precision or cover < least_cover:
            break
        rules.append(rule)
        hit = rule.covers(x)
        for side in at:
            at[side] &= ~hit
    return rules


def verdict(rules: list[Rule], of: Callable[[str], Column] = F.col) -> Column:
    """The list as one ordered conditional expression: the first rule that holds rejects; else the document stays."""
    out = None
    for rule in rules:
        condition = rule.conditions[0].column(of)
        for c in rule.conditions[1:]:
            condition &= c.column(of)
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """The decision list from labelled rows that are not held out; rows that fail the base rules don't teach."""
    marked = labels.filter(F.col("quality").isNotNull() & may_learn(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    n = marked.count()
    part = min(1.0, sample / max(n, 1))
    marked = marked.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < int(part * (1 << 20)))
    taught = docs.select(own(docs, "doc_id").cast("long").alias("doc_id"), own(docs, "text").alias("text")).join(F.broadcast(marked), "doc_id")  # sample rows at most, about
    rows = statistics(taught, "quality int").filter(~base_failed()).orderBy("doc_id").limit(2 * sample).toPandas()
    x = {k: np.where(rows[b] > 0, rows[a] / np.maximum(rows[b], 1), 0.0) for k, (a, b) in FEATURES.items()}
    return learn_list(x, (rows["quality"] == 0).to_numpy())


def quality_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of each row of docs."""
    failed = base_failed()
    return statistics(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"), "n_upper", "n_marks", "n_lines"
    )


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs without the rows that the rules reject, all columns as they were, in one pass."""
    names, text_at = docs.columns, docs.columns.index("text")
    # Columns go by place, so that no name of theirs can clash.
    plain, added = docs.toDF(*(f"c{i}" for i in range(len(names)))), [x.split() for x in STATISTICS.split(", ")]
    wide = plain.select("*", *(F.lit(0).cast(kind).alias(n) for n, kind in added)).schema

    def tag(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measured(batch.column(text_at))
        return pa.RecordBatch.from_arrays([*batch.columns, *(found[n] for n, _ in added)], names=wide.names)

    return map_arrow(plain, tag, wide).filter(~base_failed() & verdict(rules)).select(*plain.columns).toDF(*names)
