"""Toxicity by a factorization machine over hashed terms.

Terms are runs of ASCII letters and digits (A-Z lower-cased) and of bytes beyond ASCII, and the
beginnings of such runs, so that inflected and compound forms count together; a document's features
are the terms it holds, hashed. Each of the 2^20 slots has a weight and a short vector, and each pair
of terms adds the product of theirs, so that a pair such as an insult with the mention of a group can
count for more than both by themselves, or for something where each by itself says nothing. No term
is left out beforehand: what says nothing ends at zero, by an L1 penalty on weights and by clearing
vectors that have not grown. In long texts, where any two terms are likely to meet, pairs count less.

The fit takes ``MAX_ROWS`` labelled documents at most, those whose hashed ids are least, and runs in one
executor task; the driver gets the parameters only, and those are bounded by the slots. Every document
is scored, whole, in one pass without a shuffle.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import scratch, shielded, written

TERM = re.compile(rb"[a-z0-9\x80-\xff]+")
BITS = 20
#: Bytes of the beginnings that are terms.
STEMS = (4, 5, 6, 7)
#: Labelled documents that the fit takes at most.
MAX_ROWS = 20_000
#: Length of a term's vector, and words of a text beyond which its pairs count less.
FACTORS, NEAR = 4, 32
#: Learning rates of weights and vectors, decay of vectors, and the size they start with and must reach.
RATE, PAIR_RATE, DECAY, START, GROWN = 0.5, 0.1, 1e-3, 0.01, 0.05
#: Penalties tried, and documents to go through with each (2 to 30 passes).
PENALTIES, STEPS = (3.0, 10.0, 30.0), 40_000


def words(text: str | None) -> set[bytes]:
    return set(TERM.findall((text or "").encode().lower()))


def hashed(word: bytes) -> list[int]:
    """The terms of a word: itself and its beginnings."""
    return [zlib.crc32(word) & ((1 << BITS) - 1)] + [zlib.crc32(word[:n], n) & ((1 << BITS) - 1) for n in STEMS if len(word) > n]


def features(own: set[bytes]) -> np.ndarray:
    return np.unique(np.array([h for w in own for h in hashed(w)], np.int32))


def damping(n_words: int) -> float:
    """What a pair counts for in a text of so many distinct words."""
    return min(1.0, NEAR / max(1, n_words))


@dataclass
class Model:
    bias: float
    ids: np.ndarray  # slots that have parameters
    weights: np.ndarray
    factors: np.ndarray
    known: dict[bytes, tuple[int, ...]] = field(default_factory=dict)  # columns of words seen; emptied when large

    def __post_init__(self) -> None:
        self.of = {h: i for i, h in enumerate(self.ids.tolist())}

    def score(self, text: str | None) -> float:
        own, known, of, at = words(text), self.known, self.of, set()
        for w in own:
            cols = known.get(w)
            if cols is None:
                if len(known) > 200_000:
                    known.clear()
                cols = known[w] = tuple(of[h] for h in hashed(w) if h in of)
            if cols:
                at.update(cols)
        c = sorted(at)
        v = self.factors[c]
        s = self.bias + self.weights[c].sum() + 0.5 * damping(len(own)) * float((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


class Machine:
    """Parameters while they are learned: weights by follow-the-regularized-leader, vectors by AdaGrad."""

    def __init__(self, rate_of_ones: float, penalty: float, pairs: np.ndarray):
        m = len(pairs)
        self.bias, self.bias_n, self.penalty = float(np.log(rate_of_ones / (1 - rate_of_ones))), 1.0, penalty
        self.z, self.n, self.w, self.v, self.vn = np.zeros(m), np.zeros(m), np.zeros(m), pairs, np.ones(m)

    def margin(self, c: np.ndarray, damp: float) -> tuple[float, np.ndarray, np.ndarray]:
        v = self.v[c]
        total = v.sum(axis=0)
        return self.bias + self.w[c].sum() + 0.5 * damp * float(total @ total - np.einsum("ij,ij->", v, v)), v, total

    def learn(self, rows: list[np.ndarray], damps: np.ndarray, y: np.ndarray, order: np.ndarray, pairs: bool) -> None:
        for j in order.tolist():
            c, damp = rows[j], damps[j] if pairs else 0.0
            if pairs:
                s, v, total = self.margin(c, damp)
            else:
                s = self.bias + self.w[c].sum()
            e = 1 / (1 + np.exp(-min(30.0, max(-30.0, s)))) - y[j]
            n = self.n[c]
            more = np.sqrt(n + e * e)
            z = self.z[c] + e - (more - np.sqrt(n)) / RATE * self.w[c]
            self.z[c], self.n[c] = z, n + e * e
            self.w[c] = -np.sign(z) * np.maximum(np.abs(z) - self.penalty, 0) * (RATE / (1 + more))
            self.bias_n += e * e
            self.bias -= RATE * e / self.bias_n**0.5
            if pairs:
                g = (e * damp) * (total - v) + DECAY * v
                vn = self.vn[c] + np.einsum("ij,ij->i", g, g)
                self.vn[c], self.v[c] = vn, v - (PAIR_RATE / np.sqrt(vn))[:, None] * g

    def loss(self, rows: list[np.ndarray], damps: np.ndarray, y: np.ndarray, pairs: bool) -> float:
        s = np.array([self.margin(c, d if pairs else 0.0)[0] for c, d in zip(rows, damps)])
        return float(np.logaddexp(0, np.where(y > 0, -s, s)).sum())


def fit(rows: list[np.ndarray], n_words: list[int], y: np.ndarray) -> Model:
    """``rows``: the slots of each document. Logistic loss, in a fixed order.

    Each fifth document is not learned from: the penalty is the one with the least loss there, and pairs are
    kept if they lower that loss further. Weights are learned first, so that pairs explain what these cannot.
    Labels of one class, or none: the bias alone, and it says no."""
    y = np.asarray(y, np.float64)
    ones, none = float(y.sum()), np.empty(0, np.int64)
    if ones in (0.0, float(len(y))):
        return Model(float(np.log((ones * (ones < len(y)) + 0.5) / (len(y) + 1.5))), none, np.empty(0), np.empty((0, FACTORS)))
    rng = np.random.default_rng(9)
    damps = np.array([damping(n) for n in n_words])
    start = rng.normal(0, START, (1 << BITS, FACTORS))
    kept_out = np.flatnonzero(np.arange(len(y)) % 5 == 2)
    learned = np.setdiff1d(np.arange(len(y)), kept_out)
    passes = min(30, max(2, STEPS // len(y)))
    orders = [rng.permutation(learned) for _ in range(passes)]
    apart = [rows[j] for j in kept_out], damps[kept_out], y[kept_out]
    best = None
    for penalty in PENALTIES:
        m = Machine((ones + 0.5) / (len(y) + 1), penalty, start)
        for order in orders:
            m.learn(rows, damps, y, order, False)
        lost = m.loss(*apart, False)
        if best is None or lost < best[0]:
            best = lost, m
    least, m = best
    alone = copy.copy(m)
    alone.w, alone.v = m.w.copy(), np.zeros_like(start)
    for order in orders:
        m.learn(rows, damps, y, order, True)
    m.v[np.einsum("ij,ij->i", m.v, m.v) < GROWN**2] = 0
    if m.loss(*apart, True) >= least:
        m = alone
    ids = np.flatnonzero((m.w != 0) | m.v.any(axis=1))
    return Model(float(m.bias), ids, m.w[ids], m.v[ids])


def _features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        own = [words(t) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(map(len, own), pa.int32()), pa.array([features(w).tobytes() for w in own], pa.binary())], ["doc_id", "toxic", "n", "data"])


def _fitted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the sample, sorted; a row for each slot with parameters, and one of slot -1 for the bias."""
    n, rows, y = [], [], []
    for batch in it:
        n += batch["n"].to_pylist()
        y += [t == 1 for t in batch["toxic"].to_pylist()]
        rows += [np.frombuffer(d, np.int32) for d in batch["data"].to_pylist()]
    model = fit(rows, n, np.array(y, bool))
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1, *model.ids], pa.int32()), pa.array([model.bias, *model.weights], pa.float64()), pa.array([b"", *(v.tobytes() for v in model.factors)], pa.binary())],
        ["slot", "weight", "factors"],
    )


def held_out(doc_id: Column | str) -> Column:
    """Rows that nothing is learned from; a null id is learned from neither."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled documents that are not held out. Several labels of a document: toxic if any says
    so. Null labels are none. Several rows of one doc_id: the text of the least digest is learned from.
    No labels, or of one class only: the bias alone, and never toxic."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    some = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")  # max_rows small rows at most
    once = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = once.mapInArrow(_features, "doc_id long, toxic int, n int, data binary")
    with scratch():
        fitted = written(sample.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_fitted, "slot int, weight double, factors binary"), "model")
        got = fitted.orderBy("slot").toArrow()  # 2^20 slots at most
    slots, weights, vectors = (got[c].to_pylist() for c in ("slot", "weight", "factors"))
    bias = weights[0] if weights else fit([], [], np.empty(0)).bias
    return Model(bias, np.array(slots[1:], np.int64), np.array(weights[1:]), np.frombuffer(b"".join(vectors), np.float64).reshape(-1, FACTORS))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with one column more: score (0 to 1). Null or empty text: the bias's score.
    A column of ``docs`` of that name is replaced. Nothing but the text enters the score."""
    docs, back = shielded(docs.drop("score"), "_text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([model.score(t) for t in batch["_text"].to_pylist()], pa.float64())], [*batch.schema.names[:-1], "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double"])
    return docs.select("*", F.col("text").alias("_text")).mapInArrow(run, schema).withColumnsRenamed(back)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted (1 if the score is 0.5 or more).

    Null text: as empty. Null doc_id: scored, and not held out. Repeated rows: each is scored. Empty
    table: no rows. Extra columns are ignored."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slim = scored(own, trained(docs, labels))
    return slim.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
