"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: how often each byte followed each
context of up to ``order`` bytes. A byte not seen after a context is coded by an
escape and the next shorter context (method C: with n occurrences of d distinct
bytes the escape has probability d / (n + d)). The trees are frozen; a text's
score under a language is its exact code length in bits, and the shortest code
wins. A-Z are lower-cased first.

Road-network records hold no running text, so the operator is general.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.llm.text import LOWER, bound_batches, chunks, raw

#: Documents per language that the trees are learned from (expected number; the
#: rows are chosen by a hash of their id). Their texts are counted as a whole.
DOCUMENTS_PER_LANGUAGE = 1500
ORDER = 3
UNDETERMINED = "und"
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Index:
    """Position of a 64-bit key in a sorted unique array, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, 3 * len(keys))))))
        self.slots = np.full(1 << self.bits, _EMPTY, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        todo, probe = np.arange(len(keys)), 0
        while len(todo):
            at = self._slot(keys[todo], probe)
            free = self.slots[at] == _EMPTY
            _, one = np.unique(at[free], return_index=True)
            won = todo[free][one]
            self.slots[at[free][one]] = keys[won]
            self.rows[at[free][one]] = won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            probe += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        start = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (start + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is absent."""
        at = self._slot(keys, 0)
        held = self.slots[at]
        out = np.where(held == keys, self.rows[at], -1)
        todo, probe = np.flatnonzero((held != keys) & (held != _EMPTY)), 1
        while len(todo):
            at = self._slot(keys[todo], probe)
            held = self.slots[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.rows[at[hit]]
            todo, probe = todo[~hit & (held != _EMPTY)], probe + 1
        return out


@dataclass
class Trees:
    """Frozen statistics of all languages.

    ``grams[k]`` indexes the (k + 1)-byte strings seen in any language and
    ``cost[k]`` holds the code length of their last byte per language, escapes
    included. ``contexts[k]`` and ``escape[k]`` serve bytes not seen after a
    context.
    """

    languages: list[str]
    order: int
    grams: list[Index] = field(default_factory=list)
    cost: list[np.ndarray] = field(default_factory=list)
    contexts: list[Index] = field(default_factory=list)
    escape: list[np.ndarray] = field(default_factory=list)


def build(counts: dict[str, dict[int, int]], order: int) -> Trees:
    """``counts[language][packed (order + 1) bytes]`` -> code lengths of every order."""
    languages = sorted(counts)
    full = {lang: (np.fromiter(c.keys(), np.uint64, len(c)), np.fromiter(c.values(), np.float64, len(c))) for lang, c in counts.items()}
    trees = Trees(languages, order)
    lower_keys = lower_cost = None
    for k in range(order + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        own = {}
        for lang, (keys, n) in full.items():
            u, at = np.unique(keys & mask, return_inverse=True)
            own[lang] = u, np.bincount(at, n, len(u))
        keys = np.unique(np.concatenate([u for u, _ in own.values()]))
        context = np.unique(keys >> np.uint64(8))
        escape = np.zeros((len(context), len(languages)))
        if k == 0:
            shorter = np.full((len(keys), len(languages)), 8.0)
        else:
            shorter = lower_cost[np.searchsorted(lower_keys, keys & (mask >> np.uint64(8)))]
        cost = np.empty((len(keys), len(languages)))
        for j, lang in enumerate(languages):
            u, n = own[lang]
            ctx, at = np.unique(u >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(at, n, len(ctx)), np.bincount(at, minlength=len(ctx))
            escape[np.searchsorted(context, ctx), j] = np.log2((total + kinds) / kinds)
            cost[:, j] = shorter[:, j] + escape[np.searchsorted(context, keys >> np.uint64(8)), j]
            cost[np.searchsorted(keys, u), j] = np.log2((total + kinds)[at] / n)
        trees.grams.append(Index(keys))
        trees.cost.append(cost.astype(np.float32))
        trees.contexts.append(Index(context))
        trees.escape.append(escape.astype(np.float32))
        lower_keys, lower_cost = keys, cost
    return trees


def _packed(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last ``order + 1`` bytes up to each place; every text starts after
    ``order`` line ends. Also where each text begins and ends."""
    if column.null_count:
        column = pc.fill_null(column, "")
    padded = pc.binary_join_element_wise("\n" * order, column, "") if order else column
    data, offsets = raw(padded)
    data = LOWER[data]
    out = data.astype(np.uint64)
    for back in range(1, order + 1):
        out[back:] |= data[:-back].astype(np.uint64) << np.uint64(8 * back)
    return out, offsets[:-1] + order, offsets[1:]


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "body"):
        langs = batch.column("lang")
        for lang in langs.unique().to_pylist():
            part = batch.filter(pc.equal(langs, lang))
            grams, first, last = _packed(part.column("body"), order)
            inside = np.zeros(len(grams) + 1, np.int32)
            np.add.at(inside, first, 1)
            np.add.at(inside, last, -1)
            u, n = np.unique(grams[np.cumsum(inside[:-1]) > 0], return_counts=True)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(u), pa.string()), "gram": pa.array(u.view(np.int64)), "n": pa.array(n.astype(np.int64)),
            })


def learn(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    order: int = ORDER, documents_per_language: int = DOCUMENTS_PER_LANGUAGE,
) -> Trees:
    """Context trees of every language of ``labelled``.

    The languages are fitted on a bounded sample of the labelled rows: each row
    is taken when a hash of its id and text falls under
    ``documents_per_language / rows of its language``, so the expected number
    per language is the bound. Chosen texts are counted whole, in the tasks;
    the driver receives the counts. Rows without language or text are left out.
    """
    bound_batches(labelled)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return Trees([], order)
    rate = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, documents_per_language / n)))])
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < rate[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("body"))
    grams = sample.mapInArrow(lambda b: _count(b, order), "lang string, gram bigint, n bigint")
    counts: dict[str, dict[int, int]] = {lang: {} for lang in sizes}
    for r in grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["lang"]][r["gram"] % (1 << 64)] = r["n"]
    return build({lang: c for lang, c in counts.items() if c}, order)


def code_lengths(trees: Trees, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text under each language, and its number of bytes."""
    grams, first, last = _packed(column, trees.order)
    n = len(grams)
    bits = np.zeros((n + 1, len(trees.languages)), np.float32)
    todo, keys = np.arange(n), grams
    for k in range(trees.order, -1, -1):
        row = trees.grams[k].find(keys)
        hit = row >= 0
        if hit.all():
            bits[todo] += trees.cost[k][row]
            todo = todo[:0]
            break
        bits[todo[hit]] += trees.cost[k][row[hit]]
        todo, keys = todo[~hit], keys[~hit]
        ctx = trees.contexts[k].find(keys >> np.uint64(8))
        known = ctx >= 0
        bits[todo[known]] += trees.escape[k][ctx[known]]
        keys = keys & np.uint64((1 << 8 * k) - 1)
    bits[todo] += 8.0
    length = last - first
    if not len(first):
        return np.zeros((0, len(trees.languages))), length
    pairs = np.column_stack((first, last)).ravel()
    total = np.add.reduceat(bits, pairs, axis=0, dtype=np.float64)[::2]
    total[length == 0] = 0
    return total, length


def identify(texts: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """All columns of ``texts`` with ``lang_pred``, ``score``, ``bits_per_byte``.

    ``score`` is the posterior of the winner under equal priors; ties go to the
    first language by name. Texts that are null or hold no letter, and all texts
    when nothing could be learned, get ``und``, score 0 and null bits per byte.
    Columns with the new names are replaced.
    """
    bound_batches(texts)
    new = ("lang_pred", "score", "bits_per_byte")
    keep = [c for c in texts.columns if c not in new]
    if not trees.languages:
        return texts.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    held = texts.select(*keep, F.when(lettered, F.col(text_col)).alias("__body"))
    shared = texts.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages, object)
        for batch in chunks(batches, "__body"):
            body = batch.column("__body")
            bits, length = code_lengths(model, body)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(best)), best]
            posterior = 1 / np.exp2(np.minimum(0, least[:, None] - bits)).sum(axis=1)
            none = pc.is_null(body)
            lang = pc.if_else(none, UNDETERMINED, pa.array(names[best], pa.string()))
            score = pc.if_else(none, 0.0, pa.array(posterior))
            per_byte = pc.if_else(none, pa.scalar(None, pa.float64()), pa.array(least / np.maximum(length, 1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lang, score, per_byte], names=[*keep, *new])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema.fields), "lang_pred string, score double, bits_per_byte double"])
    return held.mapInArrow(predict, ddl)


def accepted(texts: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The rows of ``texts`` that hold a letter and that their best language
    codes in less than eight bits per byte, what plain bytes take."""
    found = identify(texts, trees, text_col)
    if not trees.languages:
        return found.where(F.col(text_col).rlike(r"\p{L}")).select(*texts.columns)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("bits_per_byte") < 8)).select(*texts.columns)
