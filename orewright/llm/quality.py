"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text is a bag of character-shape n-grams (letters by case, digits, spaces and lines as classes, punctuation as itself),
hashed words and runs of repeated words, with square-rooted counts and inverse document frequencies. The latent space comes from a truncated
singular value decomposition of at most ``sample_rows`` labelled texts; their vectors and labels are broadcast (their number
is the bound). Every document meets all of them: exact cosines by blocked matrix products, the ``neighbours`` nearest vote
with the ``sharpness`` power of their similarity.

Only the labelled sample is bounded. Frequencies come from it as well: they are part of the fitted model.

Defined cases: without labelled rows every score is 1; a null, empty or featureless text gets the sample's share of label 1;
repeated labels of one id count once (the lower); labels that are null are no labels; repeated rows each get their score;
of neighbours with equal similarity those with lower ids vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy, utf8
from .decontaminate import _Powers, words_of


@dataclass(frozen=True)
class Plan:
    sample_rows: int = 4096
    dims: int = 64
    neighbours: int = 15
    sharpness: float = 8.0
    threshold: float = 0.3
    held_out_in: int = 5


_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 1, 2, 3
_CLASS[0x20], _CLASS[0x0A] = 4, 5
_CLASS[0xC0:] = 1
_MARKS = [b for b in range(0x21, 0x7F) if not _CLASS[b]]
_CLASS[_MARKS] = np.arange(6, 6 + len(_MARKS))
_KINDS = 6 + len(_MARKS)
_PAIRS, _TRIPLES, _WORDS, _REPEATS = _KINDS**2, 4096, 2048, 4
FEATURES = _PAIRS + _TRIPLES + _WORDS + _REPEATS
_POWERS = _Powers(0x5851F42D4C957F2F)
_PIECE = 1 << 20


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and square-rooted counts of a whole text; n-grams across the edges of pieces count like any others."""
    total = np.zeros(FEATURES, dtype=np.int64)
    text, last = text or b"", np.zeros(0, dtype=np.int64)
    for at in range(0, len(text), _PIECE):
        data = np.frombuffer(text, dtype=np.uint8, count=min(_PIECE, len(text) - at), offset=at)
        c = np.concatenate([last, _CLASS[data[(data < 0x80) | (data >= 0xC0)]]])
        pair = c[:-1] * _KINDS + c[1:]
        triple = ((pair[:-1] * _KINDS + c[2:]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64)
        total[:_PAIRS] += np.bincount(pair[max(0, len(last) - 1) :], minlength=_PAIRS)
        total[_PAIRS : _PAIRS + _TRIPLES] += np.bincount(triple, minlength=_TRIPLES)
        last = c[-2:]
    h = words_of(text.lower(), _POWERS)[2]
    total[_PAIRS + _TRIPLES : -_REPEATS] += np.bincount((h * np.uint64(0x9FB21C651E98DF25) >> np.uint64(53)).astype(np.int64), minlength=_WORDS)
    same = (h[1:] == h[:-1]).astype(np.int64)
    total[-_REPEATS:] += np.bincount(2 * same[:-1] + same[1:], minlength=_REPEATS)
    some = np.flatnonzero(total)
    return some.astype(np.int32), np.sqrt(total[some]).astype(np.float32)


class Model:
    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, plan: Plan):
        self.plan, self.labels = plan, labels.astype(np.float64)
        self.share = float(self.labels.mean()) if len(labels) else 1.0
        x = np.zeros((len(rows), FEATURES), dtype=np.float32)
        for k, (at, value) in enumerate(rows):
            x[k, at] = value
        self.weight = np.log((1 + len(rows)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        for k in range(len(x)):
            x[k] *= self.weight
            x[k] /= max(float(np.sqrt((x[k] * x[k]).sum())), 1e-12)
        self.axes = self._axes(x, min(plan.dims, max(1, min(x.shape))))
        self.vectors = self._unit(x @ self.axes)

    @staticmethod
    def _axes(x: np.ndarray, dims: int) -> np.ndarray:
        """The leading right singular vectors, by subspace iteration from a fixed start."""
        if not len(x):
            return np.zeros((FEATURES, 1), dtype=np.float32)
        q = np.random.default_rng(11).normal(size=(x.shape[1], min(dims + 16, min(x.shape)))).astype(np.float32)
        for _ in range(5):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        v = np.linalg.svd(x @ q, full_matrices=False)[2]
        return np.ascontiguousarray((q @ v.T)[:, :dims])

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)

    def latent(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return (value * self.weight[at]) @ self.axes[at]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Votes for latent vectors; vectors of zeros get the sample's share."""
        if not len(self.labels):
            return np.ones(len(x))
        k, out = min(self.plan.neighbours, len(self.labels)), np.empty(len(x))
        for a in range(0, len(x), 512):
            sims = self._unit(x[a : a + 512]) @ self.vectors.T
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            edge = np.take_along_axis(sims, top, axis=1).min(axis=1, keepdims=True)
            if (tied := np.flatnonzero((sims >= edge).sum(axis=1) > k)).size:  # of equal neighbours the first in the sample vote
                top[tied] = np.argsort(-sims[tied], axis=1, kind="stable")[:, :k]
            weight = np.maximum(np.take_along_axis(sims, top, axis=1).astype(np.float64), 0) ** self.plan.sharpness
            total = weight.sum(axis=1)
            out[a : a + 512] = np.where(total > 1e-9, (weight * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-9), self.share)
        return np.clip(out, 0, 1)


def _mod(column, by: int):
    return F.crc32(column.cast("string").cast("binary")) % by


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", label_id: str = "doc_id", plan: Plan = Plan()) -> Model:
    """Learns from labelled rows that aren't held out (crc32 of the id as text, modulo ``held_out_in``, is not 0): those whose
    ids hash lowest, ``sample_rows`` at most."""
    known = labels.where(labels[label].isNotNull() & labels[label_id].isNotNull()).groupBy(labels[label_id].alias("i")).agg(F.min(label).cast("int").alias("y"))
    chosen = known.where(_mod(F.col("i"), plan.held_out_in) != 0).orderBy(F.xxhash64("i"), "i").limit(plan.sample_rows)
    texts = docs.select(docs[doc_id].alias("d"), docs[text].cast("string").alias("t"))
    joined = texts.join(F.broadcast(chosen), F.col("d") == F.col("i")).select("t", "d", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in utf8(batch.column(0))]
            at, value = [a.tolist() for a, _ in found], [v.tolist() for _, v in found]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["d", "y", "at", "value"])

    schema = T.StructType([T.StructField("d", joined.schema["d"].dataType), *T.StructType.fromDDL("y int, at array<int>, value array<float>").fields])
    rows = joined.mapInArrow(tidy(run), schema).groupBy("d").agg(F.first("y").alias("y"), F.min_by(F.struct("at", "value"), F.size("at")).alias("x")).orderBy("d").toArrow()
    x = rows.column("x").to_pylist()
    return Model([(np.array(r["at"], dtype=np.int32), np.array(r["value"], dtype=np.float32)) for r in x], np.array(rows.column("y").to_pylist()), plan)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The ``keep`` columns of every row and its score (0 to 1, higher: label 1 likelier), which replaces a column of its name."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    flat = docs.select(docs[text].cast("string").alias("__text"), *[docs[c] for c in keep])
    schema = T.StructType([*flat.drop("__text").schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.latent(*features(t)) for t in utf8(batch.column(0))]
            found = model.scores(np.stack(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found)], names=[*batch.schema.names[1:], name])

    return flat.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(docs, labels, doc_id=doc_id, text=text, plan=plan)
    narrow = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    found = score(narrow, model, keep=["doc_id"])
    held = F.coalesce(_mod(F.col("doc_id"), plan.held_out_in) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= plan.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """``docs`` without the rows whose score is under the threshold."""
    model = fit(docs, labels, doc_id=doc_id, text=text, plan=plan)
    columns = docs.columns
    flat = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    found = score(flat, model, text=f"c{columns.index(text)}", name="__score").where(F.col("__score") >= plan.threshold)
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])
