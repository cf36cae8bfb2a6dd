"""Hashed maximum-entropy language model with a class-factored softmax.

Every word belongs to a class by its last two bytes (the most frequent endings
have a class each, the others share one; the end of a text is a class of its
own), and

    P(word | history) = P(class | history) * P(word | class, class of the word before).

* The class is a softmax over hashed features of the history: the word before,
  the word before that (a skip feature), and both together (an n-gram feature).
  Its weights are trained in rounds of distributed gradient updates: each round
  takes another part of the training texts, the tasks add up how often every
  feature meets every class and how often the model expected it, and the driver
  takes one diagonally scaled step. After all rounds each text was used once.
* The word is a softmax with a bias per word and one conjunction feature per
  (class before, word). These features say everything the factor can see, so the
  weights that fit best are log ratios of counts, which are taken directly.
* Words too rare for weights of their own share the rest of their class in
  proportion to (count + 0.5), an unseen word counting 0.5.

Texts are scored in blocks of sparse rows gathered by numpy. What is broadcast
is bounded by parameters: the weights, the words that make up at least a
``1 / MODELLED`` or ``1 / KNOWN`` of all tokens. Counts of rarer words are joined.
The feature tables do not grow with the text: more histories share a row, and
words below ``1 / MODELLED`` see no context (figures in the README).

Road-network records hold no running text, so the operator is general.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.llm.language import Index
from netresil.llm.text import bound_batches, chunks, mix, word_hashes, words
from netresil.session import cut_lineage

#: Words with at least this share of all tokens have weights, or travel with their counts.
MODELLED, KNOWN = 16_384, 1_000_000
CLASSES = 32
ROUNDS, STEP, DAMP = 3, 0.45, 4.0
#: Rows of the three feature tables: word before, skip, n-gram.
TABLES = (1 << 13, 1 << 12, 1 << 14)
SMOOTH = 20.0
_ROWS = 512  # rows of a feature table in one message
_END, _START = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0x57A7757A7757A775)
_BLOCK = 1 << 14


@dataclass
class Tokens:
    """Tokens of several texts, one after the other, each text closed by its end."""

    hashes: np.ndarray
    endings: np.ndarray
    before: np.ndarray
    skip: np.ndarray
    first: np.ndarray
    bounds: np.ndarray


def tokens(column: pa.Array) -> Tokens:
    w = words(column, fold=True)
    n = len(w.bounds) - 1
    bounds = w.bounds + np.arange(n + 1)
    h = np.full(bounds[-1], _END, np.uint64)
    ending = np.full(bounds[-1], -1, np.int32)
    at = np.arange(len(w)) + w.documents()
    h[at] = word_hashes(w)
    last = w.data[w.ends - 1].astype(np.int32)
    ending[at] = last | np.where(w.ends - w.starts > 1, w.data[np.maximum(w.ends - 2, 0)].astype(np.int32) << 8, 0)
    before = np.concatenate(([_START], h[:-1])) if len(h) else h
    before[bounds[:-1]] = _START
    skip = np.concatenate(([_START], before[:-1])) if len(h) else h
    skip[bounds[:-1]] = _START
    first = np.zeros(len(h), bool)
    first[bounds[:-1]] = True
    return Tokens(h, ending, before, skip, first, bounds)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens with their ending and number, added up over a few million tokens at a time."""
    held, size = [], 0

    def flush():
        h, e = (np.concatenate(x) for x in zip(*held))
        u, at, n = np.unique(h, return_index=True, return_counts=True)
        for a in range(0, len(u), 200_000):
            part = slice(a, a + 200_000)
            yield pa.RecordBatch.from_pydict({"token": pa.array(u[part].view(np.int64)), "ending": pa.array(e[at[part]]), "n": pa.array(n[part])})

    for batch in chunks(batches, "body"):
        t = tokens(batch.column("body"))
        held.append((t.hashes, t.endings))
        size += len(t.hashes)
        if size > 3_000_000:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


@dataclass
class Model:
    total: int
    distinct: int
    classes: np.ndarray  # class by ending; the last entry is the end of a text
    modelled: Index
    known: Index
    known_log: np.ndarray
    rest_log: np.ndarray  # log10 of the mass that the rare words of a class share
    weights: np.ndarray
    bias: np.ndarray
    word_rows: int = 0
    word_class: np.ndarray | None = None
    word_log: np.ndarray | None = None  # log10 P(word or rest of its class | class, class before)

    def rows(self, t: Tokens):
        cls = self.classes[t.endings]
        prev = np.empty(len(cls), np.int64)
        prev[1:] = cls[:-1]
        prev[t.first] = CLASSES - 1
        word = self.modelled.find(t.hashes).astype(np.int64)
        return cls.astype(np.int64), prev, word

    def features(self, t: Tokens) -> list[np.ndarray]:
        one, two, three = TABLES
        pair = mix(t.before * np.uint64(0x9E3779B97F4A7C15) + t.skip)
        return [
            (mix(t.before) % np.uint64(one)).astype(np.int64), one + (mix(t.skip ^ np.uint64(0x51)) % np.uint64(two)).astype(np.int64),
            one + two + (pair % np.uint64(three)).astype(np.int64),
        ]

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.take(self.weights, rows[0], axis=0)
        for r in rows[1:]:
            z += np.take(self.weights, r, axis=0)
        z += self.bias
        return z


def _blocks(n: int):
    return (slice(a, min(n, a + _BLOCK)) for a in range(0, n, _BLOCK))


def _gradients(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Per block of feature rows: how often each class was met and expected; then the counts of (word, class before)."""
    rows, vocabulary = sum(TABLES), len(model.rest_log) + model.word_rows
    met, expected = np.zeros((rows, CLASSES), np.float32), np.zeros((rows, CLASSES), np.float32)
    pairs = np.zeros(vocabulary * CLASSES, np.float32)
    for batch in chunks(batches, "body"):
        t = tokens(batch.column("body"))
        cls, prev, word = model.rows(t)
        row = np.where(word >= 0, word, model.word_rows + cls)
        pairs += np.bincount(row * CLASSES + prev, minlength=len(pairs))
        where = model.features(t)
        for f in where:
            met += np.bincount(f * CLASSES + cls, minlength=met.size).reshape(met.shape)
        for part in _blocks(len(cls)):
            p = model.logits([f[part] for f in where])
            np.exp(p, out=p)
            p /= p.sum(axis=1, keepdims=True)
            for f in where:
                # Sum the expected rows of equal features together before adding them.
                order = np.argsort(f[part], kind="stable")
                sorted_rows = f[part][order]
                edge = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
                expected[sorted_rows[edge]] += np.add.reduceat(p[order], edge, axis=0)
    out = []
    for a in range(0, rows, _ROWS):
        both = np.concatenate((met[a : a + _ROWS].ravel(), expected[a : a + _ROWS].ravel()))
        if both.any():
            out.append((a // _ROWS, _half(both)))
    first = -(-rows // _ROWS)
    for i, a in enumerate(range(0, len(pairs), _ROWS * CLASSES)):
        part = pairs[a : a + _ROWS * CLASSES]
        if part.any():
            out.append((first + i, part.tobytes()))
    for block, data in out:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], names=["block", "data"])


def _half(values: np.ndarray) -> bytes:
    """The upper two bytes of 32-bit floats, rounded: enough for a gradient, half of what is sent."""
    return ((values.astype(np.float32).view(np.uint32) + np.uint32(0x8000)) >> np.uint32(16)).astype(np.uint16).tobytes()


def _whole(data: bytes) -> np.ndarray:
    return (np.frombuffer(data, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)


def _add(batches: Iterator[pa.RecordBatch], halves: int) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of one partition; at most the size of the model."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
            v = (_whole(data) if block < halves else np.frombuffer(data, np.float32)).astype(np.float64)
            sums[block] = sums[block] + v if block in sums else v
    for block, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], names=["block", "data"])


def _start(counts: DataFrame) -> Model:
    """The untrained model from the counts of all training tokens."""
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, distinct = total or 0, distinct or 0
    by_ending = {r["ending"]: (r["n"], r["k"]) for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).toLocalIterator()}
    own = sorted((e for e in by_ending if e >= 0), key=lambda e: (-by_ending[e][0], e))[: CLASSES - 2]
    classes = np.full((1 << 16) + 1, CLASSES - 2, np.uint8)
    classes[own] = np.arange(len(own))
    classes[-1] = CLASSES - 1
    known = [(r["token"] % (1 << 64), r["n"], r["ending"]) for r in counts.where(F.col("n") * KNOWN >= total).orderBy("token").toLocalIterator()]
    hashes = np.array([k for k, _, _ in known], np.uint64)
    n = np.array([x for _, x, _ in known], np.float64)
    endings = np.array([e for _, _, e in known], np.int64)
    big = n * MODELLED >= total
    mass = np.full(CLASSES, 0.5)
    met = np.zeros(CLASSES)
    for e, (words_n, kinds) in by_ending.items():
        mass[classes[e]] += words_n + 0.5 * kinds
        met[classes[e]] += words_n
    np.subtract.at(mass, classes[endings[big]], n[big] + 0.5)
    prior = (met + 0.5) / (met + 0.5).sum()
    model = Model(
        total, distinct, classes, Index(hashes[big]), Index(hashes), np.log10(n + 0.5), np.log10(np.maximum(mass, 0.5)),
        np.zeros((sum(TABLES), CLASSES), np.float32), np.log(prior).astype(np.float32), int(big.sum()), classes[endings[big]].astype(np.int64),
    )
    return model


def _word_table(model: Model, pairs: np.ndarray) -> np.ndarray:
    """log10 P(word | class, class before): counts under each class before, pulled towards those of the class."""
    of = np.concatenate((model.word_class, np.arange(CLASSES)))
    one = pairs.sum(axis=1) + 0.5
    share = one / np.bincount(of, one, CLASSES)[of]
    under = np.zeros((CLASSES, CLASSES))
    np.add.at(under, of, pairs)
    return np.log10((pairs + SMOOTH * share[:, None]) / (under[of] + SMOOTH)).astype(np.float32)


def train(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and the counts (``token``, ``ending``, ``n``) of all training tokens."""
    bound_batches(texts)
    src = texts.select(F.col(text_col).alias("body"), F.pmod(F.xxhash64(F.lit("round"), F.col(id_col)), F.lit(rounds)).alias("round"))
    seen = src.select("body").mapInArrow(_count, "token bigint, ending int, n bigint")
    counts = cut_lineage(seen.groupBy("token").agg(F.first("ending").alias("ending"), F.sum("n").alias("n")))
    model = _start(counts)
    rows, halves = sum(TABLES), -(-sum(TABLES) // _ROWS)
    pairs = np.zeros((model.word_rows + CLASSES) * CLASSES)
    for turn in range(rounds):
        held = texts.sparkSession.sparkContext.broadcast(model)
        sent = src.where(F.col("round") == turn).select("body").mapInArrow(lambda b, m=held: _gradients(b, m.value), "block int, data binary")
        summed = sent.repartition("block").mapInArrow(lambda b: _add(b, halves), "block int, data binary")
        met, expected = np.zeros((rows, CLASSES)), np.zeros((rows, CLASSES))
        for r in summed.toLocalIterator():
            v, block = np.frombuffer(r["data"], np.float32), r["block"]
            if block < halves:
                a = block * _ROWS
                x, y = v.reshape(2, -1, CLASSES)
                met[a : a + len(x)], expected[a : a + len(y)] = x, y
            else:
                a = (block - halves) * _ROWS * CLASSES
                pairs[a : a + len(v)] += v
        model.weights = model.weights + (STEP * np.log((met + DAMP) / (expected + DAMP))).astype(np.float32)
        held.unpersist()
    model.word_log = _word_table(model, pairs.reshape(-1, CLASSES))
    return model, counts


_PARTS = ("__tokens", "__common", "__base", "__part", "__rare")


def _score(batches: Iterator[pa.RecordBatch], model: Model, keep: list[str]) -> Iterator[pa.RecordBatch]:
    unit = float(np.log10(model.total + 0.5 * (model.distinct + 1))) if model.total else 0.0
    for batch in chunks(batches, "__body"):
        t = tokens(batch.column("__body"))
        cls, prev, word = model.rows(t)
        where = model.features(t)
        log = np.empty(len(cls))
        for part in _blocks(len(cls)):
            z = model.logits([f[part] for f in where])
            picked = z[np.arange(len(z)), cls[part]].astype(np.float64)
            np.exp(z, out=z)
            log[part] = (picked - np.log(z.sum(axis=1, dtype=np.float64))) / np.log(10)
        row = np.where(word >= 0, word, model.word_rows + cls)
        log += model.word_log[row, prev]
        at = model.known.find(t.hashes)
        common = at >= 0
        alone = np.where(common, model.known_log[np.maximum(at, 0)] if len(model.known_log) else 0.0, 0.0)
        rest = word < 0
        log += np.where(rest, alone - model.rest_log[cls], 0.0)
        add = lambda x: np.add.reduceat(x, t.bounds[:-1]) if len(x) else np.zeros(0)
        n = np.diff(t.bounds)
        rare = ~common
        per_text = add(rare.astype(np.int64)).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_text))).astype(np.int32)), pa.array(t.hashes[rare].view(np.int64)))
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in keep), pa.array(n.astype(np.int64)), pa.array(n - per_text), pa.array(add(alone) - n * unit), pa.array(add(log)), lists,
        ], names=[*keep, *_PARTS])


def score(texts: DataFrame, trained: tuple[Model, DataFrame], text_col: str = "text") -> DataFrame:
    """All columns of ``texts`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one
    end; null counts as empty, its only token is the end. ``base_score`` sums
    log10((c + 0.5) / (N + 0.5 (V + 1))) over them, ``score`` is the log10
    probability under the model. Without training tokens both are 0 and nothing
    is known. Columns with the new names are replaced.
    """
    bound_batches(texts)
    model, counts = trained
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in texts.columns if c not in new]
    held = texts.select(*keep, F.col(text_col).alias("__body"))
    shared = texts.sparkSession.sparkContext.broadcast(model)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema.fields)
    kinds = ("bigint", "bigint", "double", "double", "array<bigint>")
    ddl = f"{kept}{', ' if kept else ''}" + ", ".join(f"{c} {k}" for c, k in zip(_PARTS, kinds))
    done = held.mapInArrow(lambda b: _score(b, shared.value, keep), ddl)
    # The number is written with its row and so stays with it.
    done = cut_lineage(done.withColumn("__row", F.monotonically_increasing_id()))
    c = F.coalesce("n", F.lit(0))
    sums = done.select("__row", F.explode("__rare").alias("token")).join(
        counts.where(F.col("n") * KNOWN < model.total).select("token", "n"), "token", "left",
    ).groupBy("__row").agg(F.sum((c > 0).cast("bigint")).alias("__seen"), F.sum(F.log10(c + 0.5)).alias("__logs"))
    out = done.drop("__rare").join(sums, "__row", "left")
    logs, some = F.coalesce("__logs", F.lit(0.0)), F.lit(model.total > 0)
    return out.select(
        *keep, F.col("__tokens").alias("n_tokens"),
        F.when(some, F.col("__common") + F.coalesce("__seen", F.lit(0))).otherwise(0).cast("bigint").alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"), F.when(some, F.col("__base") + logs).otherwise(0.0).alias("base_score"),
        F.when(some, F.col("__part") + logs).otherwise(0.0).alias("score"),
    )
