"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from .common import folded, query, table
from .pieces import portions

BUCKETS = 1 << 18           # hash space of terms
FEATURES = 4096             # term buckets that tell the classes apart best in the sample
MIN_GAIN = 16.0             # chi-square that a bucket needs; below it is what chance gives in a small sample
FACTORS = 8
SAMPLE = 8000               # labelled documents that a fit looks at, at most
ROUNDS = 150
THRESHOLD = 0.3
PREFIXES = (4, 5)           # a word also counts by its first characters: inflected forms share them
CACHED_WORDS = 500_000
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def term_buckets(word: str) -> set[int]:
    parts = [word.encode(), *(b"%d" % n + word[:n].encode() for n in PREFIXES)]
    return {zlib.crc32(p) % BUCKETS for p in parts}


class Machine:
    """logit = bias + w.x + sum of pair interactions <v_i, v_j> x_i x_j, x = presence of a term bucket."""

    def __init__(self, buckets, bias, weights, factors):
        self.column = np.full(BUCKETS, -1, np.int32)
        self.column[buckets] = np.arange(len(buckets))
        self.bias, self.weights, self.factors = float(bias), np.asarray(weights), np.asarray(factors).reshape(len(buckets), FACTORS)
        self.cache: dict[str, tuple[int, ...]] = {}

    def columns(self, word: str) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > CACHED_WORDS:
                self.cache.clear()
            found = self.cache[word] = tuple(int(c) for b in term_buckets(word) if (c := self.column[b]) >= 0)
        return found

    def scores(self, texts: list[str]) -> np.ndarray:
        active = [{c for w in set(SPLIT.findall(t)) for c in self.columns(w)} for t in texts]
        flat = np.array([c for cs in active for c in sorted(cs)], np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(cs) for cs in active])
        linear = np.bincount(owner, self.weights[flat], len(texts))
        v = self.factors[flat]
        pairs = sum(np.bincount(owner, v[:, f], len(texts)) ** 2 - np.bincount(owner, v[:, f] ** 2, len(texts)) for f in range(FACTORS))
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -30, 30)))


def train(texts: list[str], labels: np.ndarray, seed: int = 7):
    """Buckets, bias, weights, factors: chi-square picks the buckets, full-batch Adam fits the log loss."""
    n, positive = len(texts), float(labels.sum())
    bias = np.log((positive + 0.5) / (n - positive + 0.5))
    if not 0 < positive < n:
        return np.empty(0, np.int64), bias if n else -30.0, np.empty(0), np.empty((0, FACTORS))
    sets = [np.array(sorted({b for w in set(SPLIT.findall(t)) for b in term_buckets(w)}), np.int64) for t in texts]
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    seen, hit = np.bincount(flat, minlength=BUCKETS), np.bincount(flat, labels[owner], BUCKETS)
    expected = seen * positive / n
    gain = np.where(seen >= 3, (hit - expected) ** 2 / np.maximum(expected * (1 - seen / n) * (1 - positive / n), 1e-9), 0)
    buckets = np.argsort(-gain, kind="stable")[:FEATURES]
    buckets = buckets[gain[buckets] >= MIN_GAIN]
    column = np.full(BUCKETS, -1)
    column[buckets] = np.arange(len(buckets))
    x = np.zeros((n, len(buckets)), np.float32)
    used = column[flat]
    x[owner[used >= 0], used[used >= 0]] = 1
    y = labels.astype(np.float32)
    v = (0.01 * np.random.default_rng(seed).standard_normal((len(buckets), FACTORS))).astype(np.float32)
    values = [np.full(1, bias, np.float32), np.zeros(len(buckets), np.float32), v]
    first, second = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values]
    for step in range(1, ROUNDS + 1):
        b, w, v = values
        sums = x @ v
        logit = b + x @ w + 0.5 * ((sums ** 2).sum(1) - x @ (v ** 2).sum(1))
        residual = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / n
        by_column = x.T @ residual
        slopes = [residual.sum(keepdims=True), by_column + 1e-4 * w, x.T @ (residual[:, None] * sums) - by_column[:, None] * v + 1e-4 * v]
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            values[i] = values[i] - 0.02 * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-8)
    return buckets, values[0][0], values[1], values[2]


def fit(documents: DataFrame, labels: DataFrame, target: str = "toxic") -> Machine:
    """Fit on at most SAMPLE labelled documents whose crc32(doc_id as text) mod 4 is not 2, the first in hash order.

    Labels without doc_id or value are left out; a document with both labels counts as labelled 1. With one
    class only every text gets the prior, without labelled rows a score of 0. One task trains, as the sample is bounded;
    FEATURES rows of the result come back.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max(target).cast("double").alias("y")).orderBy(hash_key("fit", "doc_id"), "doc_id").limit(SAMPLE)
    texts = documents.filter("text is not null").select("doc_id", folded(F.col("text")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").repartition(1)

    def run(batches):
        import pyarrow as pa

        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        buckets, bias, w, v = train([r[1] for r in rows], np.array([r[2] for r in rows]))
        yield pa.RecordBatch.from_pydict({"bucket": [-1, *buckets.tolist()], "w": [float(bias), *map(float, w)],
                                          "v": [[], *v.astype(float).tolist()]},
                                         schema=pa.schema([("bucket", pa.int32()), ("w", pa.float64()), ("v", pa.list_(pa.float64()))]))

    rows = sorted(sample.mapInArrow(run, "bucket int, w double, v array<double>").collect())
    if not rows:        # nothing labelled, nothing to suspect
        return Machine([], -30.0, [], [])
    return Machine([r[0] for r in rows[1:]], rows[0][1], [r[1] for r in rows[1:]], [r[2] for r in rows[1:]])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_texts(documents: DataFrame, machine: Machine, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns plus ``out``, the probability of label 1. Whole texts; null counts as empty. Only a scan."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)
    kept = [c for c in documents.columns if c != out]
    with_text = documents.select(*[F.col(f"`{c}`") for c in kept], folded(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("__folded"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in portions(batch, batch.num_columns - 1, 1 << 20):
                scores = shared.value.scores(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64())], names=[*kept, out])

    from pyspark.sql.types import DoubleType

    return with_text.mapInArrow(run, with_text.drop("__folded").schema.add(out, DoubleType()))


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with the columns they came with."""
    name = "__toxicity"
    return score_texts(documents, fit(documents, labels), out=name).filter(F.col(name) < threshold).drop(name)


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(documents, table(spark, sf_dir, "labels"))
    scored = score_texts(documents, machine)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
