"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier for each bit (logistic regression on hashed byte
n-grams of the whole text) predicts it. A text gets the language whose codeword has the least loss, the
bits weighted by how well they tell that language in training. The score is the chosen language's share
under these losses; a low one marks the text as ambiguous.

Fitting takes a bounded sample of the labelled rows that are not held out (SAMPLE rows, divided among the
languages). Prediction sees nothing but the text.

Cases: null texts and texts without a letter are `und` with score 0; languages are the non-null values
of lang; without any labelled row every text is `und`; a single language is always predicted. Repeated
rows and null doc_ids are predicted like others. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import held_out, map_arrow, may_learn, own, text_buffers

#: Rows that fitting uses, at most, about; hashed n-grams; lengths of n-grams.
SAMPLE, DIM, LENGTHS = 3000, 2048, (1, 2, 3)
AMBIGUOUS = 0.6
UNDETERMINED = "und"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASCII_LETTER = np.isin(LOWER, np.arange(97, 123))


def has_letter(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])[offsets]
    out = np.diff(seen) > 0
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def features(offsets: np.ndarray, data: np.ndarray, at: slice) -> np.ndarray:
    """Rows `at` of the texts: square roots of n-gram shares, of length one together."""
    rows = range(*at.indices(len(offsets) - 1))
    out = np.zeros((len(rows), DIM), np.float32)
    for k, i in enumerate(rows):
        own = LOWER[data[offsets[i] : offsets[i + 1]]].astype(np.uint32)
        code = np.zeros(len(own), np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            if len(own) < n:
                break
            code = (code[: len(own) - n + 1] * np.uint32(0x01000193)) ^ (own[n - 1 :] * np.uint32(0x9E3779B1) >> np.uint32(3))
            if n in LENGTHS:
                out[k] += np.bincount((code ^ code >> np.uint32(15)) & np.uint32(DIM - 1), minlength=DIM)
    np.sqrt(out, out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)
    return out


def codewords(k: int, seed: int = 3) -> np.ndarray:
    """A row of +1 and -1 for each of k languages: all distinct splits for up to seven, else the best of random codes."""
    if k <= 7:
        splits = range(1, 1 << max(k - 1, 0))
        return np.array([[1] * len(splits), *([1 - 2 * (s >> i & 1) for s in splits] for i in range(k - 1))], float).reshape(k, -1)
    bits, random = int(np.ceil(10 * np.log2(k))), np.random.default_rng(seed)
    best, best_apart = None, -1
    for _ in range(200):
        code = random.choice([-1.0, 1.0], (k, bits))
        apart = ((bits - code @ code.T) / 2 + bits * np.eye(k)).min()
        if apart > best_apart and (np.abs(code.sum(0)) < k).all():
            best, best_apart = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    mean: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """For each row and language the weighted sum of the bits' logistic losses."""
        margin = (x - self.mean) @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -margin * word) * trust).sum(1) for word, trust in zip(self.code, self.trust, strict=True)], 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, score)."""
        loss = self.losses(x)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        return loss.argmin(1), 1 / share.sum(1)


def fit(x: np.ndarray, languages: list[str], label: np.ndarray, steps: int = 150, decay: float = 1e-4) -> Model:
    """One logistic regression a bit, all at once, by accelerated gradient descent; classes weigh the same."""
    code = codewords(len(languages))
    target = code[label]
    size = np.bincount(label, minlength=len(languages))
    weight = (1 / size[label] / len(languages))[:, None].astype(np.float32)
    mean = (x * weight).sum(0)
    x = x - mean
    top = np.ones(DIM, np.float32)
    for _ in range(20):  # the largest curvature sets the step
        top = x.T @ (weight[:, 0] * (x @ top))
        curve = np.linalg.norm(top)
        top /= max(curve, 1e-9)
    pace = 4 / max(curve, 1e-3)
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    ahead_w, ahead_b = w, b
    for step in range(steps):
        pull = -weight * target / (1 + np.exp(target * (x @ ahead_w + ahead_b)))
        new_w, new_b = ahead_w - pace * (x.T @ pull.astype(np.float32) + decay * ahead_w), ahead_b - 4 * pull.sum(0)
        ahead_w, ahead_b = new_w + step / (step + 3) * (new_w - w), new_b + step / (step + 3) * (new_b - b)
        w, b = new_w.astype(np.float32), new_b.astype(np.float32)
    right = (np.sign(x @ w + b) == target).astype(float)
    trust = np.stack([right[label == k].mean(0) if size[k] else np.ones(code.shape[1]) for k in range(len(languages))])
    trust *= code.shape[1] / np.maximum(trust.sum(1, keepdims=True), 1e-9)
    return Model(languages, code, w, b, trust, mean)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most about `sample` labelled rows that are not held out, the same number a language."""
    rows = docs.select(own(docs, "doc_id").cast("long").alias("doc_id"), own(docs, "text").cast("string").alias("text"), own(docs, "lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & may_learn(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not counts:
        return None
    languages = sorted(counts)
    each = max(20, sample // len(languages))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20))
    bound = None
    for lang, n in counts.items():
        part = int(min(1.0, each / n) * (1 << 20))
        bound = F.when(F.col("lang") == lang, part) if bound is None else bound.when(F.col("lang") == lang, part)
    rows = rows.filter(chosen < bound)

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(*text_buffers(batch.column("text")), slice(None)).astype(np.float16)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    taken = map_arrow(rows, extract, "doc_id long, lang string, x binary").toPandas().sort_values(["doc_id", "lang"])
    taken = taken.groupby("lang").head(2 * each)
    if not len(taken):
        return None
    languages = sorted(set(taken["lang"]))
    x = np.frombuffer(b"".join(taken["x"]), np.float16).reshape(-1, DIM).astype(np.float32)
    return fit(x, languages, np.array([languages.index(v) for v in taken["lang"]]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        offsets, data = text_buffers(batch.column("text"))
        n = batch.num_rows
        lang, score = np.full(n, UNDETERMINED, object), np.zeros(n)
        known = has_letter(offsets, data) if model else np.zeros(n, bool)
        for at in range(0, n, 512) if model else ():
            best, share = model.predict(features(offsets, data, slice(at, at + 512)))
            own = slice(at, at + len(best))
            lang[own] = np.where(known[own], np.array(model.languages, object)[best], UNDETERMINED)
            score[own] = np.where(known[own], share, 0.0)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "ambiguous": pa.array(score < AMBIGUOUS)})

    source = docs.select(own(docs, "doc_id").cast("long").alias("doc_id"), own(docs, "text").cast("string").alias("text"))
    found = map_arrow(source, run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
