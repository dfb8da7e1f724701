"""Operator 3: quality classifier on random-indexing word vectors.

A token of a text is a word as written, its shape (capitals, digits, other
signs, length) or its relation to the words before it (equal, pair seen
before). Each has a sparse random index vector; words also have a context
vector, the sum of their neighbours' index vectors over the training texts. A
document is the mean of its words', shapes' and relations' vectors and the
spread of the first. A two-layer network on these, trained with numpy, gives a
logit; its temperature is fitted on rows set aside, so scores are probabilities.

Labels are learned from at most MAX_TRAIN labelled rows that are not held out,
drawn by a hash of doc_id; everything else of a row but its text is ignored.

Defined cases: a null text counts as empty and is scored as one; repeated rows
get equal scores; several labels of a doc_id count as their largest; a null
doc_id is not held out and not learned from; without labels every score is 0.5;
an empty table gives an empty result; a very long text is pooled in runs of
RUN words, alone in its slice. ``classify`` reads doc_id and text alone;
``score`` and ``keep_good`` return all columns as they are, whatever they are
called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_name, saver, small_batches
from .words import Words, mix, words

MAX_TRAIN = 20_000
BUCKETS, DIM, NONZERO, REACH = 1 << 13, 48, 6, 2
SHAPES, RELATIONS = 1024, 8
HIDDEN, EPOCHS, BATCH = 32, 40, 256
#: Tasks over the labelled rows; each sends a sum of BUCKETS x DIM numbers to the driver.
TASKS = 12
#: Words, and texts, whose vectors are in memory at once.
RUN, TEXTS = 12_500, 256
THRESHOLD, FOLDS = 0.3, 5


def _index_vectors(n: int, seed: int) -> np.ndarray:
    """Sparse random vectors of length 1."""
    rng = np.random.default_rng(seed)
    v = np.zeros((n, DIM), np.float32)
    rows = np.repeat(np.arange(n), NONZERO)
    v[rows, rng.integers(0, DIM, n * NONZERO)] += rng.choice([-1, 1], n * NONZERO)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)


WORD_INDEX, SHAPE_INDEX, RELATION_INDEX = _index_vectors(BUCKETS, 1), _index_vectors(SHAPES, 2), np.eye(RELATIONS, dtype=np.float32)


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, shape, relation) of each word."""
    d, s, e = w.data, w.start, w.end
    bucket = (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[e] - sums[s]

    upper = count((d >= 65) & (d <= 90) | (d == 0xC3) & np.r_[(d[1:] >= 0x80) & (d[1:] <= 0x9E), False] if len(d) else np.zeros(0, bool))
    lower = count((d >= 97) & (d <= 122) | (d == 0xC3) & np.r_[d[1:] >= 0x9F, False] if len(d) else np.zeros(0, bool))
    digit = count((d >= 48) & (d <= 57))
    signs = count((d < 128) & ~((d >= 65) & (d <= 90)) & ~((d >= 97) & (d <= 122)) & ~((d >= 48) & (d <= 57)))
    size = np.digitize(e - s, (3, 6, 10, 15, 25, 40, 80))
    capitals = np.where(upper == 0, 0, np.where(lower > 0, np.where(upper == 1, 1, 2), 3))
    shape = (np.minimum(signs, 7) * 4 + capitals) * 16 + (digit > 0) * 8 + size
    h, doc = w.hash, w.doc
    relation = np.zeros(len(h), np.int64)
    if len(h) > 1:
        pair = mix(h[1:] * np.uint64(3) ^ mix(h[:-1] + doc[1:].astype(np.uint64)))
        inside = doc[1:] == doc[:-1]
        _, first = np.unique(pair, return_index=True)
        seen = np.ones(len(pair), bool)
        seen[first] = False
        relation[1:] = np.where(inside, 1 + seen + 2 * (h[1:] == h[:-1]), 0)
    return bucket, shape, relation


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sum of context vectors, one row."""
    total = np.zeros((BUCKETS, DIM), np.float64)
    for b in batches:
        for w in words(b.column("text"), lower=False):
            bucket, shape, _ = _tokens(w)
            for k in range(1, REACH + 1):
                near = np.flatnonzero(w.doc[k:] == w.doc[:-k]) if len(bucket) > k else np.zeros(0, np.int64)
                for lo in range(0, len(near), RUN):
                    i = near[lo : lo + RUN]
                    for one, other in ((i, i + k), (i + k, i)):
                        order = np.argsort(bucket[one], kind="stable")
                        own = bucket[one][order]
                        v = (WORD_INDEX[bucket[other]] + SHAPE_INDEX[shape[other]])[order]
                        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                        total[own[at]] += np.add.reduceat(v, at)
    yield pa.record_batch({"sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Index vector plus context direction."""
    return WORD_INDEX + sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)


def features(column: pa.Array, vectors: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(lo, hi, a row of pooled vectors per text)."""
    for w in words(column, lower=False):
        n = w.hi - w.lo
        bucket, shape, relation = _tokens(w)
        bounds = w.bounds
        count = np.maximum(np.diff(bounds), 1)[:, None].astype(np.float32)
        mean, square = np.zeros((n, DIM), np.float32), np.zeros((n, DIM), np.float32)
        for lo in range(0, len(bucket), RUN):
            hi = min(lo + RUN, len(bucket))
            v, doc = vectors[bucket[lo:hi]], w.doc[lo:hi]
            at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            mean[doc[at]] += np.add.reduceat(v, at)
            square[doc[at]] += np.add.reduceat(v * v, at)
        mean /= count
        spread = np.sqrt(np.maximum(square / count - mean * mean, 0))

        def pooled(x: np.ndarray, index: np.ndarray) -> np.ndarray:
            k, parts = len(index), []
            for lo in range(0, n, TEXTS):
                hi = min(lo + TEXTS, n)
                own = slice(bounds[lo], bounds[hi])
                parts.append(np.bincount((w.doc[own] - lo) * k + x[own], minlength=(hi - lo) * k).reshape(hi - lo, k).astype(np.float32) / count[lo:hi] @ index)
            return np.concatenate(parts)

        shapes, relations = pooled(shape, SHAPE_INDEX), pooled(relation, RELATION_INDEX)
        length = np.log1p(np.diff(bounds))[:, None].astype(np.float32) / 10
        yield w.lo, w.hi, np.concatenate([mean, spread, shapes, relations, length], axis=1).astype(np.float32)


WIDTH = 3 * DIM + RELATIONS + 1


@dataclass
class Network:
    """Standardise, tanh layer, logit, temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    """Adam on nine tenths, the temperature on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held = order[: len(x) // 10] if len(x) >= 50 else order
    fit = order[len(x) // 10 :] if len(x) >= 50 else order
    scale = x.std(axis=0)
    net = Network(x.mean(axis=0), np.where(scale > 1e-6, scale, 1), rng.normal(0, WIDTH**-0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    share = np.clip(y.mean(), 0.01, 0.99)
    net.b2 = float(np.log(share / (1 - share)))
    z = np.clip((x - net.centre) / net.scale, -8, 8)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        rate = 3e-3 * (1 - epoch / EPOCHS)
        for lo in range(0, len(fit), BATCH):
            i = fit[rng.permutation(len(fit))[:BATCH]]
            a = np.tanh(z[i] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(a @ params[2] + params[3][0], -30, 30)))
            g = (p - y[i]) / len(i)
            back = np.outer(g, params[2]) * (1 - a * a)
            grads = [z[i].T @ back + 1e-4 * params[0], back.sum(0), a.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            step += 1
            for k, gr in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logit, own = net.logit(x[held]), y[held]
    loss = lambda t: float(np.mean(np.logaddexp(0, -np.where(own > 0, 1, -1) * logit / t)))
    net.temperature = min(np.geomspace(0.25, 8, 60), key=loss)
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, Network] | None:
    """(word vectors, network) from the texts of at most ``max_train`` labelled rows; None without any."""
    chosen = (
        labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    # max_train rows of two numbers are broadcast; documents are read by as many tasks as they have, and what is left by a few.
    save = saver(docs.sparkSession)
    chosen_rows = save(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text"))
    rows = chosen_rows.coalesce(TASKS)
    sums = np.zeros((BUCKETS, DIM), np.float64)
    for r in rows.mapInArrow(_contexts, "sums binary").collect():  # TASKS rows
        sums += np.frombuffer(r["sums"], np.float32).reshape(BUCKETS, DIM)
    vectors = word_vectors(sums).astype(np.float32)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, x in features(b.column("text"), vectors):
                yield pa.record_batch({"quality": b.column("quality").slice(lo, hi - lo), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    got = rows.mapInArrow(pooled, "quality int, x binary").toArrow()
    save.drop(chosen_rows)
    y = got["quality"].to_numpy().astype(np.float64)
    if not len(y):
        return None
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(len(y), WIDTH).astype(np.float64)
    # An order of their own, whatever partitions they came from.
    order = np.lexsort(x.T[::-1])
    return vectors, train(x[order], y[order])


def _scorer(model: tuple[np.ndarray, Network] | None, text: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.full(b.num_rows, 0.5)
            if model:
                for lo, hi, x in features(b.column(text), model[0]):
                    score[lo:hi] = model[1].score(x)
            yield pa.record_batch([*b.columns, pa.array(score)], names=[*b.schema.names, "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[DataFrame, str]:
    """``docs`` with the probability of label 1, and the name of that column: score, or what is free."""
    small_batches(docs.sparkSession)
    model, name = fit(docs, labels, max_train), free_name(docs.columns, "score")
    # A function over Arrow batches can't be given columns with dots in their names, so they go by number.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    scored = plain.mapInArrow(_scorer(model, docs.columns.index("text")), StructType([*plain.schema.fields, StructField("score", DoubleType())]))
    return scored.toDF(*docs.columns, name), name


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    scored, name = score(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out().alias("held_out"), F.col(name).alias("score"), (F.col(name) >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't rejected."""
    scored, name = score(docs, labels)
    return scored.where(F.col(name) >= THRESHOLD).drop(name)
