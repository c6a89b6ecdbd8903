"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w[i] + sum over pairs of <v[i], v[j]>) over the distinct hashed terms of the text: the pair part
learns that two terms together mean more than each alone. It is trained on a bounded sample of labelled texts (`max_rows`,
those with the smallest text hashes; equal texts are one sample with their mean label), in three steps over all terms that
at least `min_samples` samples hold:

1. the weights alone, under an l1 penalty that grows with the noise of each term's gradient (`penalty` standard errors); terms
   enter as long as any of them breaks the optimality conditions, so the penalty prunes, not a test of one term at a time;
2. the factors of all terms, on what the weights leave unexplained, by AdaGrad. Terms whose factors grow to `stand_out` times
   the median norm take part in pairs, whether or not they have a weight: a pair of terms that are both as common in
   toxic as in other texts is found too;
3. weights and factors of the terms that are left, together.

All documents are scored whole, in one pass without a shuffle.

Edge cases: null and empty texts score sigmoid(w0); documents without a label row, or with a null one, train nothing; a table
without usable labels gives 0 for all; repeated label rows of an id are averaged; repeated documents each get a row.
Labels, language, source and id are never inputs of a score. Extra columns, whatever their names, pass through
`remove_toxic` untouched.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._common import fold_of, materialize, positional, text_of

BUCKETS, MAX_ROWS, MIN_SAMPLES, FACTORS = 1 << 20, 20_000, 3, 8
PENALTY, STAND_OUT = 4.0, 4.0
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings of 5 and 6 letters: inflected and compound forms share them."""
    return [word, *(word[:n] + "*" for n in (5, 6) if len(word) >= n)]


def bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Samples:
    """Terms of each sample in one flat array: cols[ends[i]:ends[i + 1]] are those of sample i; y: labels."""

    def __init__(self, terms: list[np.ndarray], y: np.ndarray, size: int):
        self.cols = np.concatenate(terms).astype(np.int32) if terms else np.zeros(0, np.int32)
        self.ends = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        self.y, self.size = np.asarray(y, np.float64), size

    def parts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the given samples: their terms, whose they are, and where each sample's begin."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        first = np.cumsum(sizes) - sizes
        return self.cols[np.repeat(self.ends[rows] - first, sizes) + np.arange(sizes.sum())], np.repeat(np.arange(len(rows)), sizes), first

    def chunks(self, rows: int = 2048) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        for lo in range(0, len(self.y), rows):
            part = np.arange(lo, min(lo + rows, len(self.y)))
            cols, owner, _ = self.parts(part)
            yield slice(lo, lo + len(part)), cols, owner

    def gradient(self, error: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        for part, cols, owner in self.chunks():
            out += np.bincount(cols, error[part][owner], self.size)
        return out

    def margin(self, w0: float, w: np.ndarray) -> np.ndarray:
        return np.concatenate([w0 + np.bincount(owner, w[cols], part.stop - part.start) for part, cols, owner in self.chunks()])

    def columns(self, chosen: np.ndarray) -> np.ndarray:
        """A dense matrix of the chosen terms."""
        place = np.full(self.size, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        out = np.zeros((len(self.y), len(chosen)), np.float32)
        for part, cols, owner in self.chunks():
            at = place[cols]
            out[part.start + owner[at >= 0], at[at >= 0]] = 1
        return out

    def only(self, chosen: np.ndarray) -> Samples:
        place = np.full(self.size, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        at = place[self.cols]
        kept = np.concatenate([[0], np.cumsum(at >= 0)])[self.ends]
        out = Samples([], self.y, len(chosen))
        out.cols, out.ends = at[at >= 0], kept
        return out


def _fit_dense(a: np.ndarray, y: np.ndarray, w: np.ndarray, w0: float, penalty: np.ndarray, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression with a weighted l1 penalty: accelerated proximal gradient, restarted when it overshoots."""
    u, norm = np.ones(a.shape[1], np.float32), 1.0
    for _ in range(8):
        u = a.T @ (a @ u)
        norm = max(float(np.linalg.norm(u)), 1e-9)
        u /= norm
    scale = 0.25 * (1.1 * norm + len(y))
    x = z = np.append(w, w0)
    t = 1.0
    for _ in range(steps):
        error = (_sigmoid(a @ z[:-1].astype(np.float32) + z[-1]) - y).astype(np.float32)
        g = np.append(a.T @ error, error.sum())
        new = z - g / scale
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - penalty / scale, 0)
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / ahead * (new - x)
        if g @ (new - x) > 0:
            ahead, z = 1.0, new
        x, t = new, ahead
    return x[:-1], float(x[-1])


def sparse_weights(samples: Samples, penalty: float = PENALTY, step: int = 300) -> tuple[float, np.ndarray]:
    """w0 and w over all terms. Each round admits the `step` terms whose gradient exceeds their penalty most, until none does or
    those admitted no longer lower the penalised loss. There is no bound on terms but the penalty: one takes 4 bytes a sample on the driver."""
    y = samples.y
    p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    noise = np.sqrt(np.bincount(samples.cols, minlength=samples.size) * p * (1 - p))
    w, w0, active = np.zeros(samples.size), float(np.log(p / (1 - p))), np.zeros(0, np.int64)
    least = np.inf
    while True:
        margin = samples.margin(w0, w)
        loss = float((np.logaddexp(0, margin) - y * margin).sum() + penalty * (noise * np.abs(w)).sum())
        if loss >= least * (1 - 1e-6):
            break
        least = loss
        excess = np.abs(samples.gradient(_sigmoid(margin) - y)) / np.maximum(noise, 1e-9)
        excess[active] = 0
        new = np.flatnonzero(excess > 1.02 * penalty)
        if not len(new):
            break
        active = np.concatenate([active, new[np.argsort(-excess[new], kind="stable")[:step]]])
        own, w0 = _fit_dense(samples.columns(active), y, w[active], w0, penalty * noise[active])
        w[:] = 0
        w[active] = own
        active = active[own != 0]
    return w0, w


def factor_gradient(v: np.ndarray, cols: np.ndarray, owner: np.ndarray, first: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each sample: the sum of its terms' factors, and the pair part of its margin."""
    total = np.zeros((rows, v.shape[1]), v.dtype)
    some = np.flatnonzero(np.bincount(owner, minlength=rows))
    if len(some):
        total[some] = np.add.reduceat(v[cols], first[some], axis=0)
    return total, 0.5 * ((total**2).sum(axis=1) - np.bincount(owner, (v**2).sum(axis=1)[cols], rows))


def descend(samples: Samples, offset: np.ndarray, w: np.ndarray, v: np.ndarray, w0: float, epochs: int, rate: float, start: float, l1: float = 0.0, l2: float = 1e-3) -> float:
    """AdaGrad on w and v in place, over the given margins; returns w0."""
    gw, gv, g0, rng = np.full(len(w), start), np.full(v.shape, start, v.dtype), start, np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(samples.y))
        for lo in range(0, len(order), 256):
            part = order[lo : lo + 256]
            cols, owner, first = samples.parts(part)
            used, at = np.unique(cols, return_inverse=True)
            mine = v[used]
            total, pairs = factor_gradient(mine, at, owner, first, len(part))
            error = (_sigmoid(offset[part] + w0 + np.bincount(owner, w[cols], len(part)) + pairs) - samples.y[part]) / len(part)
            own = error[owner]
            dw = np.bincount(at, own, len(used))
            dv = np.stack([np.bincount(at, own * total[owner, f], len(used)) for f in range(v.shape[1])], axis=1) - dw[:, None] * mine + l2 * mine
            gw[used] += dw**2
            new = w[used] - rate / np.sqrt(gw[used]) * dw
            w[used] = np.sign(new) * np.maximum(np.abs(new) - l1 * rate, 0)
            gv[used] += dv**2
            v[used] = mine - rate / np.sqrt(gv[used]) * dv
            g0 += error.sum() ** 2
            w0 -= rate / np.sqrt(g0) * error.sum()
    return float(w0)


@dataclass
class FactorizationMachine:
    place: dict[int, int]  # bucket to row of w and v
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, terms: list) -> np.ndarray:
        """Scores of texts, from the rows in w and v of the terms of each."""
        sizes = np.fromiter(map(len, terms), np.int64, len(terms))
        cols = np.fromiter((r for t in terms for r in t), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(terms)), sizes)
        _, pairs = factor_gradient(self.v, cols, owner, np.cumsum(sizes) - sizes, len(terms))
        return _sigmoid(self.w0 + np.bincount(owner, self.w[cols], len(terms)) + pairs)

    @staticmethod
    def train(chosen: np.ndarray, samples: Samples, factors: int = FACTORS, penalty: float = PENALTY, stand_out: float = STAND_OUT) -> FactorizationMachine:
        """chosen: the bucket of each term of the samples."""
        y = samples.y
        if not len(y) or not 0 < y.sum() < len(y):
            return FactorizationMachine({}, -35.0 if not len(y) or not y.sum() else 35.0, np.zeros(0), np.zeros((0, factors)))
        w0, w = sparse_weights(samples, penalty)
        v = np.random.default_rng(7).normal(0, 0.02, (samples.size, factors)).astype(np.float32)
        descend(samples, samples.margin(w0, w), np.zeros(samples.size), v, 0.0, epochs=10, rate=0.05, start=1e-2)
        norm = np.linalg.norm(v, axis=1)
        kept = np.flatnonzero((w != 0) | (norm > stand_out * np.median(norm))) if len(norm) else np.zeros(0, np.int64)
        w, v = np.zeros(len(kept)), v[kept].astype(np.float64)
        w0 = descend(samples.only(kept), np.zeros(len(y)), w, v, float(np.log(y.sum() / (len(y) - y.sum()))), epochs=40, rate=0.1, start=1e-6, l1=1e-4)
        return FactorizationMachine({int(b): i for i, b in enumerate(chosen[kept])}, w0, w, v)


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """x, y, b: hash, mean label and distinct buckets of at most max_rows different labelled texts of the rows in `learn`."""
    text = text_of(text_col)
    narrow = docs.where(learn).select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_x"))
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_y"))
    picked = narrow.join(known, "_id").groupBy("_x").agg(F.avg("_y").alias("_y")).orderBy("_x").limit(max_rows)
    texts = docs.where(learn).select(text.alias("_text"), F.xxhash64(text).alias("_x")).join(F.broadcast(picked), "_x")  # max_rows rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for x, y, t in zip(*(batch.column(c).to_pylist() for c in ("_x", "_y", "_text")), strict=True):
                if x not in seen:
                    seen.add(x)
                    out.append((x, y, sorted({bucket(z) for w in words_of(t) for z in terms_of(w)})))
            xs, ys, bs = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.float64()), pa.array(bs, pa.list_(pa.int32()))], names=["x", "y", "b"])

    return materialize(texts.mapInArrow(features, "x long, y double, b array<int>").dropDuplicates(["x"]), "toxicity-sample")


def supported_terms(sample: DataFrame, min_samples: int = MIN_SAMPLES) -> np.ndarray:
    """The buckets that at least min_samples samples hold; BUCKETS at most."""
    counts = sample.select(F.explode("b").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("a")).where(F.col("a") >= min_samples)
    return np.sort(counts.select("t").toArrow().column("t").to_numpy()).astype(np.int64)


def places_in(sample: DataFrame, chosen: np.ndarray) -> Samples:
    """The samples (max_rows at most) by places in chosen, in the order of their hashes."""
    terms = sample.sparkSession.sparkContext.broadcast(chosen)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in batches:
            found = []
            for b in batch.column("b"):
                own = b.values.to_numpy() if len(known) else np.zeros(0, np.int64)
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                found.append(at[known[at] == own].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(found, pa.binary())], names=["x", "y", "at"])

    rows = sample.mapInArrow(select, "x long, y double, at binary").toArrow().sort_by("x")
    return Samples([np.frombuffer(t.as_buffer(), "<i4") for t in rows.column("at")], rows.column("y").to_numpy(), len(chosen))


_CACHE = 200_000


class _Places(dict):
    """Words to the rows of their terms in the model."""

    def __init__(self, place: dict[int, int]):
        self.place = place

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = at = tuple(self.place[b] for b in map(bucket, terms_of(word)) if b in self.place)
        return at


def _scorer(model: FactorizationMachine):
    places = _Places(model.place)

    def scores(texts: pa.Array) -> np.ndarray:
        return model.scores([set().union(*map(places.__getitem__, words_of(t))) if t else () for t in texts.to_pylist()])

    return scores


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, min_samples: int = MIN_SAMPLES, **options) -> FactorizationMachine:
    sample = training_sample(docs, labels, F.lit(True) if learn is None else learn, max_rows, id_col, text_col)
    chosen = supported_terms(sample, min_samples)
    return FactorizationMachine.train(chosen, places_in(sample, chosen), **options)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted. Rows whose fold (of 3) is 1 are held out of training."""
    held = fold_of(id_col, 3) == 1
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, ~held, id_col, text_col))
    narrow = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(scores(batch.column("_text")))], names=["_id", "score"])

    scored = narrow.mapInArrow(run, StructType([narrow.schema["_id"], StructField("score", DoubleType())]))
    return scored.select(F.col("_id").alias(id_col), (fold_of("_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under the threshold, with their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fold_of(id_col, 3) != 1, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) < threshold))

    plain = positional(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
