"""Benchmark decontamination with one Aho-Corasick automaton.

Test items (questions, answers) and texts are normalised alike: A-Z lower-cased,
words are runs of letters, digits and non-ASCII characters, joined by one space.
Every run of ``window`` item words is a pattern; an item with fewer words, but
not none, is one pattern as a whole. Each text is scanned once, and the places
found are mapped back to offsets in the original text.

Road-network records hold no running text, so the operator is general.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.llm.text import bound_batches

#: Bytes that separate words become a space, A-Z become a-z.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

#: Bytes of patterns in one automaton. It is broadcast, so this bounds what a
#: task holds; a larger benchmark is scanned in several parts.
AUTOMATON_BYTES = 16 << 20


def normalise(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def _patterns(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = [], []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("body").to_pylist()):
            w = normalise(text)
            found = {b" ".join(w[i : i + window]) for i in range(max(len(w) - window, 0) + 1)} if w else set()
            ids += [item] * len(found)
            keys += found
        yield pa.RecordBatch.from_pydict({"item": pa.array(ids, pa.string()), "pattern": pa.array(keys, pa.binary())})


def item_patterns(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """``item`` (the id as text), ``pattern``: the normalised word runs of every item, each once."""
    src = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("body"))
    return src.mapInArrow(lambda b: _patterns(b, window), "item string, pattern binary").distinct()


class Scanner:
    """The automaton of one part of the patterns; built once per Python worker."""

    def __init__(self, patterns: list[tuple[bytes, list[str]]]):
        self.patterns = patterns
        self.automaton = None

    def build(self):
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for key, items in self.patterns:
                self.automaton.add_word(f" {key.decode('latin-1')} ", (key.count(b" ") + 1, items))
            self.automaton.make_automaton()
        return self.automaton

    def scan(self, text: str | None):
        """Number of words, runs of hit words ``[first, last)``, item ids, normalised bytes."""
        body = (text or "").encode("utf-8", "replace").translate(_TABLE)
        w = body.split()
        if not w or not self.patterns:
            return len(w), [], set(), body
        line = f" {b' '.join(w).decode('latin-1')} "
        found = list(self.build().iter(line))
        if not found:
            return len(w), [], set(), body
        # A match ends at the space after its last word: count the spaces up to there.
        gaps = np.cumsum(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
        runs, items = [], set()
        for end, (length, ids) in found:
            last = int(gaps[end]) - 1
            runs.append((last - length, last))
            items.update(ids)
        return len(w), merge(runs), items, body


def merge(runs: list) -> list[list[int]]:
    """Overlapping and touching runs as one."""
    merged: list[list[int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def _original_spans(text: str, body: bytes, runs: list[list[int]]) -> list[dict]:
    """Word runs as character offsets of the original text."""
    raw = np.frombuffer(body, np.uint8)
    inside = raw != 0x20
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    original = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    chars = np.concatenate(([0], np.cumsum((original & 0xC0) != 0x80)))
    return [{"start": int(chars[starts[a]]), "stop": int(chars[ends[b - 1]])} for a, b in runs]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_NEW = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": _SPANS}
_DDL = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,stop:int>>"


def _scan(batches: Iterator[pa.RecordBatch], scanner: Scanner, keep: list[str], first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Scan with one part. Between parts ``spans`` holds word positions; the last part turns them into offsets."""
    for batch in batches:
        texts = batch.column("__body").to_pylist()
        n, hit, items, spans = [], [], [], []
        before = [([], [])] * len(texts) if first else zip(batch.column("items").to_pylist(), batch.column("spans").to_pylist())
        for text, (old_items, old_spans) in zip(texts, before):
            words, runs, ids, body = scanner.scan(text)
            if old_spans:
                runs = merge(runs + [[s["start"], s["stop"]] for s in old_spans])
            n.append(words)
            hit.append(sum(b - a for a, b in runs))
            items.append(sorted(ids.union(old_items)))
            spans.append(_original_spans(text, body, runs) if last and runs else [{"start": a, "stop": b} for a, b in runs])
        made = [pa.array(x, t) for x, t in zip((n, hit, items, spans), _NEW.values())]
        held = keep if last else [*keep, "__body"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in held] + made, names=[*held, *_NEW])


def contamination(
    texts: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 10, automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """All columns of ``texts`` with ``n_words``, ``n_hit``, ``items``, ``spans``.

    ``n_hit`` counts the words inside any occurrence of a pattern, ``items`` are
    the ids (as text, sorted) of items with an occurring pattern, ``spans`` the
    hit stretches as character offsets of the original text. Null and empty
    texts have no words. Repeated items count once per id; an item without id
    marks words but is not listed. Columns of ``texts`` with the names of the
    new ones are replaced.

    The patterns are collected to build the automaton. Their size is checked
    first: beyond ``automaton_bytes`` they are split by a hash, and every text
    passes one automaton after the other within the same task, without a
    shuffle.
    """
    bound_batches(texts)
    patterns = item_patterns(items, item_col, item_text_col, window)
    grouped = patterns.groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))
    total = grouped.agg(F.sum(F.length("pattern") + 8)).first()[0] or 0
    parts = max(1, -(-total // automaton_bytes))
    keep = [c for c in texts.columns if c not in _NEW]
    out = texts.select(*keep, F.col(text_col).alias("__body"))
    for part in range(parts):
        wanted = grouped if parts == 1 else grouped.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
        scanner = Scanner([(bytes(r["pattern"]), r["items"]) for r in wanted.toLocalIterator()])
        last = part == parts - 1
        held = out.select(*keep) if last else out.select(*keep, "__body")
        ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields), _DDL])
        out = out.mapInArrow(lambda b, s=scanner, f=part == 0, e=last: _scan(b, s, keep, f, e), ddl)
    return out
