"""Quality scores by nearest-neighbour voting in a latent semantic space.

A text is a vector of hashed terms: its words, the shapes of its words (letters,
case, digits and signs, runs collapsed) and a few terms for how its words repeat
and how long they are. The labelled texts span a latent space (principal
directions of their weighted term vectors); every text is compared with every
labelled vector by exact cosine, in blocks, and the nearest vote with weights
that grow with similarity.

Road-network records hold no running text, so the operator is general.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.llm.text import SPACES, Words, bound_batches, chunks, mix, word_hashes, words

#: Expected number of labelled texts the space is fitted on and that vote.
LABELLED = 4000
WORD_TERMS, SHAPE_TERMS, LEVELS = 512, 256, 12
TERMS = WORD_TERMS + SHAPE_TERMS + 4 * LEVELS
DIMENSIONS, NEIGHBOURS, SHARPNESS = 64, 25, 8

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x30:0x3A] = ord("0")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[list(SPACES)] = 0x20


def _shapes(w: Words) -> Words:
    """Words rewritten as collapsed runs of character classes."""
    kinds = _SHAPE[w.data]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[w.starts] = True
    at = np.cumsum(keep)
    data = np.concatenate((kinds[keep], np.zeros(8, np.uint8)))
    return Words(data, at[w.starts] - 1, at[w.ends - 1] if len(w) else w.ends, w.bounds)


def vectors(column: pa.Array) -> np.ndarray:
    """Term vectors (rows) of the texts of a column; each of the three groups of terms has length one."""
    w = words(column, fold=True)
    n = len(w.bounds) - 1
    out = np.zeros((n, TERMS), np.float32)
    count = np.diff(w.bounds)
    if not len(w):
        return out
    doc, h = w.documents(), word_hashes(w)
    shape = word_hashes(_shapes(words(column)))
    of = lambda hashes, size: np.bincount(doc * size + (mix(hashes) % np.uint64(size)).astype(np.int64), minlength=n * size).reshape(n, size)
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    out[:, :WORD_TERMS] = np.log1p(of(h, WORD_TERMS))
    out[:, WORD_TERMS : WORD_TERMS + SHAPE_TERMS] = unit(of(shape, SHAPE_TERMS))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    some = np.maximum(count, 1)
    shares = [
        np.bincount(doc, again, n) / some, np.bincount(doc[order], new, n) / some ** 0.8 / 2,
        np.bincount(doc, w.ends - w.starts, n) / some / 16, np.log1p(count) / 12,
    ]
    filled = np.flatnonzero(count)
    for k, share in enumerate(shares):
        level = np.minimum((np.minimum(share, 0.999) * LEVELS).astype(int), LEVELS - 1)
        out[filled, WORD_TERMS + SHAPE_TERMS + k * LEVELS + level[filled]] = 0.5
    return out


@dataclass
class Voters:
    """Weights of the word terms, the latent directions, the labelled vectors in them, their labels."""

    weights: np.ndarray
    directions: np.ndarray
    latent: np.ndarray
    labels: np.ndarray

    def project(self, terms: np.ndarray) -> np.ndarray:
        x = terms.copy()
        words_part = x[:, :WORD_TERMS] * self.weights
        x[:, :WORD_TERMS] = 0.5 * words_part / np.maximum(np.linalg.norm(words_part, axis=1, keepdims=True), 1e-9)
        y = x @ self.directions
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def vote(self, terms: np.ndarray, block: int = 512) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by similarity; the overall share where nothing is similar."""
        prior = float(self.labels.mean())
        out = np.full(len(terms), prior)
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(terms), block):
            near = self.project(terms[a : a + block]) @ self.latent.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, axis=1), 0) ** SHARPNESS
            total = weight.sum(axis=1)
            share = (weight * self.labels[best]).sum(axis=1) / np.maximum(total, 1e-30)
            out[a : a + block] = np.where(total > 1e-12, share, prior)
        return np.clip(out, 0.0, 1.0)


def fit(terms: np.ndarray, labels: np.ndarray) -> Voters:
    seen = (terms[:, :WORD_TERMS] > 0).sum(axis=0)
    weights = np.log((1 + len(terms)) / (1 + seen)).astype(np.float32)
    model = Voters(weights, np.eye(TERMS, dtype=np.float32), terms[:0], labels)
    x = terms.copy()
    part = x[:, :WORD_TERMS] * weights
    x[:, :WORD_TERMS] = 0.5 * part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    _, directions = np.linalg.eigh((x.T @ x).astype(np.float64))
    model.directions = np.ascontiguousarray(directions[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
    model.latent = model.project(terms)
    return model


def learn(
    texts: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED,
) -> Voters | None:
    """The voters; None when no text is labelled.

    A bounded sample of the labelled rows is used: a row is taken when a hash of
    its id falls under ``labelled / rows``, so ``labelled`` is the expected
    number that is broadcast. Rows with a null label or id are left out; null
    texts count as empty.
    """
    bound_batches(texts)
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    n = marked.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = marked.where(draw < labelled / n)
    # The sample is bounded by its expected size, so it may be broadcast; the texts stay where they are.
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(F.broadcast(chosen), "id").select("id", "label", "body")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "body"):
            v = vectors(batch.column("body"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in v], pa.binary())], names=["id", "label", "terms"])

    kind = rows.schema["id"].dataType.simpleString()
    got = sorted((str(r["id"]), r["label"], bytes(r["terms"])) for r in rows.mapInArrow(describe, f"id {kind}, label int, terms binary").toLocalIterator())
    if not got:
        return None
    return fit(np.stack([np.frombuffer(t, np.float32) for _, _, t in got]), np.array([float(x > 0) for _, x, _ in got]))


def score(texts: DataFrame, voters: Voters | None, text_col: str = "text") -> DataFrame:
    """All columns of ``texts`` with ``score``, 0 to 1: how much its neighbours are labelled 1.

    Null and empty texts are like nothing and get the share of label 1 among all
    voters, as do all texts when nothing could be learned (0.5). A column named
    ``score`` is replaced.
    """
    bound_batches(texts)
    keep = [c for c in texts.columns if c != "score"]
    if voters is None:
        return texts.select(*keep, F.lit(0.5).alias("score"))
    shared = texts.sparkSession.sparkContext.broadcast(voters)  # bounded by the sample

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__body"):
            s = shared.value.vote(vectors(batch.column("__body")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s, pa.float64())], names=[*keep, "score"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema.fields), "score double"])
    return texts.select(*keep, F.col(text_col).alias("__body")).mapInArrow(vote, ddl)
