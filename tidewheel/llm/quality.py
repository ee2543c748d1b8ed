"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A text's terms are hashed byte trigrams of the whole text; its vector is a truncated
singular value decomposition of their damped, document-frequency weighted counts, with a
few measures of its form beside it. The labelled vectors are a bounded sample, so they are
sent to every executor; each document's cosine to all of them is computed in blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import held_out

TERMS, LATENT, NEIGHBOURS = 4096, 32, 15
#: Of the measures of form against the topics.
FORM_WEIGHT = 2.0
BLOCK = 256
_CLASS = np.zeros(256, dtype=np.uint8)  # of bytes: 1 upper case, 2 digit, 3 other ASCII sign, 4 white space, 5 line end
_CLASS[65:91] = 1
_CLASS[48:58] = 2
for _signs in (range(33, 48), range(58, 65), range(91, 97), range(123, 127)):
    _CLASS[list(_signs)] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(counts of hashed byte trigrams, measures of form) of a whole text; null and empty: zeros."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    n = len(data)
    if not n:
        return np.zeros(TERMS, np.float32), np.zeros(8, np.float32)
    b = data.astype(np.uint32)
    terms = np.zeros(TERMS, np.float32)
    if n > 2:
        code = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(20)
        terms = np.bincount(code, minlength=TERMS).astype(np.float32)
    kinds = np.bincount(_CLASS[data], minlength=6)
    words = max(1, int(kinds[4] + kinds[5]) + 1)
    head = (text or "").split()
    form = [kinds[1] / n * 3, kinds[2] / n * 5, kinds[3] / n * 5, kinds[5] / words * 5, min(n / words / 20, 2), np.log1p(n) / 10, len(set(head)) / max(1, len(head)), np.count_nonzero(terms) / min(n, TERMS)]
    return terms, np.array(form, dtype=np.float32)


def _damped(terms: np.ndarray) -> np.ndarray:
    out = np.log1p(terms)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)


def _basis(matrix: np.ndarray, latent: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    q = np.random.default_rng(7).standard_normal((matrix.shape[1], latent + 8)).astype(np.float32)
    for _ in range(rounds):
        q, _r = np.linalg.qr(matrix.T @ (matrix @ q))
    _u, _s, v = np.linalg.svd(matrix @ q, full_matrices=False)
    return (q @ v.T[:, :latent]).astype(np.float32)


class Model:
    """Labelled latent vectors and the projection that makes one of a text."""

    def __init__(self, terms: np.ndarray, form: np.ndarray, labels: np.ndarray, latent: int = LATENT):
        damped = _damped(terms)
        spread = (terms > 0).sum(axis=0)
        self.idf = np.log((1 + len(terms)) / (1 + spread)).astype(np.float32) + 0.1
        self.basis = _basis((damped * self.idf).astype(np.float32), latent)
        self.centre, self.scale = form.mean(axis=0), form.std(axis=0) + 1e-6
        self.labels = labels.astype(np.float64)
        self.vectors = np.zeros((0, latent + form.shape[1]), np.float32)
        self.vectors = self.latent(terms, form)

    def latent(self, terms: np.ndarray, form: np.ndarray) -> np.ndarray:
        topic = (_damped(terms) * self.idf) @ self.basis
        topic = topic / np.maximum(np.sqrt((topic * topic).sum(axis=1, keepdims=True)), 1e-9)
        shape = np.clip((form - self.centre) / self.scale, -4, 4) * (FORM_WEIGHT / np.sqrt(form.shape[1]))
        whole = np.concatenate([topic, shape], axis=1).astype(np.float32)
        return whole / np.maximum(np.sqrt((whole * whole).sum(axis=1, keepdims=True)), 1e-9)

    def score(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The labels of each vector's nearest neighbours, weighted by the eighth power of the cosine; of neighbours equally near at the limit, those earlier in the sample count."""
        near = np.round(vectors.astype(np.float64) @ self.vectors.T.astype(np.float64), 9)  # so that equal vectors are equally near, wherever they lie in a block
        k = min(neighbours, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        closer, level = near > last, near == last
        level &= np.cumsum(level, axis=1, dtype=np.int32) <= k - closer.sum(axis=1, keepdims=True)
        i, at = np.nonzero(closer | level)  # k of each row
        at = at.reshape(len(near), k)
        weight = np.maximum(np.take_along_axis(near, at, axis=1), 1e-6) ** 8
        return np.clip((weight * self.labels[at]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label): up to `rows` labelled documents, chosen by a hash of their ids, none held out; of several texts of an id the one with the least hash."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most `rows` ids and labels: a broadcast of known size.
    met = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    one = met.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "label")).alias("r"))
    return one.select("doc_id", "r.text", "r.label")


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [counts(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([zlib.compress(t.astype(np.uint32).tobytes(), 1) for t, _ in out], pa.binary()), pa.array([f.tobytes() for _, f in out], pa.binary())], names=["doc_id", "label", "terms", "form"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 4096) -> Model | None:
    """A model from at most `rows` labelled documents, a row for each id (a sample by hash of the id; bounds what the driver and every executor hold); None without any."""
    found = sample(docs, labels, label, rows).mapInArrow(_featured, "doc_id bigint, label int, terms binary, form binary").orderBy("doc_id").toArrow()
    if not found.num_rows:
        return None
    terms = np.stack([np.frombuffer(zlib.decompress(t), np.uint32) for t in found.column("terms").to_pylist()]).astype(np.float32)
    form = np.stack([np.frombuffer(t, np.float32) for t in found.column("form").to_pylist()])
    return Model(terms, form, found.column("label").to_numpy())


def _scored(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            if model is None:
                score = np.full(part.num_rows, 0.5)
            else:
                out = [counts(t.as_py()) for t in part.column(1)]
                score = model.score(model.latent(np.stack([t for t, _ in out]), np.stack([f for _, f in out])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["doc_id", "score"])


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, rows: int = 4096) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Whole texts are read; null and empty texts are scored like any other (their counts are
    zeros). Labels of held-out ids (see `held_out`; a null id is not held out) are never
    read. No usable label: score 0.5. Repeated rows return as often as they are; further
    columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, rows))
    scores = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lambda it: _scored(it, model), "doc_id bigint, score double")
    return scores.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
