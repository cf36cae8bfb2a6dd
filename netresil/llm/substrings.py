"""Substring deduplication by window hashes, dealt by the short window that stands for each.

A window of ``window`` words is removed where the same words also start earlier.
The texts are scanned once; every window is hashed and, unless it is settled within
its block of text, sent to the task of the shorter window that stands for it. Lengths
are not doubled level by level: windows under a short one met once are skipped where
they arrive, not before they are sent.

* The window of ``n`` words that stands for one of ``2 n`` is the one with the
  smallest hash among the ``n + 1`` inside it, the leftmost of equals. Equal long
  windows agree on it, so about one short window in ``n / 2`` has to be sent.
* Each short window carries the 64-bit hash of every longer window it stands for,
  so the texts are not read again. Long windows are the
  same where both hashes are, that of the short window and that of the long one.
* Where a short window is frequent in all texts together (found by a counting
  table of fixed size), the longer windows are dealt out by themselves, so no
  task receives all of a hot passage; repeats within one block of text are
  settled where they are found and not sent.

Road-network records hold no running text, so the operator is general.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.llm.text import bound_batches, chunks, mix, sliding_min, strings, windows, word_hashes, words

WINDOW = 20
#: Bytes of text whose repeats are settled together before anything is sent.
BLOCK = 8 << 20
#: Slots of the counting table; a broadcast of 4 bytes each.
SLOT_BITS = 20
_PIECE = "bucket int, doc binary, place binary, short binary, count binary, tag binary"
_NAMES = ["bucket", "doc", "place", "short", "count", "tag"]


def _levels(window: int) -> tuple[int, int]:
    """The short length, and how many short windows stand in a long one."""
    short = max(1, window // 2)
    return short, window - short + 1


def _scan(batch: pa.RecordBatch, window: int):
    """All long windows of a batch: document row, start, hash, and the short window that stands for each (hash, offset)."""
    w = words(batch.column("body"))
    n = len(w)
    short, inner = _levels(window)
    if n < window:
        z = np.zeros(0, np.int64)
        return w, z, z, z.astype(np.uint64), z.astype(np.uint64), z
    h = word_hashes(w)
    small, long = windows(h, short), windows(h, window)
    # The smallest hash with its leftmost place: low bits of a mixed hash give way to the offset,
    # which is counted within the long window, so candidates are compared window by window.
    least = sliding_min(small, inner)
    starts = np.arange(len(long))
    first = np.full(len(long), -1, np.int64)
    for o in range(inner - 1, -1, -1):
        hit = small[o : o + len(long)] == least
        first[hit] = o
    docs = w.documents()
    whole = docs[: len(long)] == docs[window - 1 :]
    keep = np.flatnonzero(whole)
    place = w.place()
    return w, docs[keep], place[keep], long[keep], least[keep], first[keep]


def _slots(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """How often each slot of short windows is met, as one sparse table per task."""
    table = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in chunks(batches, "body"):
        _, docs, place, _, short, offset = _scan(batch, window)
        if len(docs) == 0:
            continue
        at = place + offset
        new = np.concatenate(([True], (docs[1:] != docs[:-1]) | (at[1:] != at[:-1])))
        table += np.bincount((mix(short[new]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(table))
    # Only slots that stand out within the task can stand out in all: what is left out is below its share.
    limit = max(2, int(table.sum() // 10_000))
    hot = np.flatnonzero(table >= limit)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(hot.astype(np.int32)), "n": pa.array(table[hot])})


def _hot_slots(src: DataFrame, window: int) -> np.ndarray:
    """Slots with a ten-thousandth or more of the short windows of some task: at most 10,000 per task, a bounded bitmap together."""
    found = src.mapInArrow(lambda b: _slots(b, window), "slot int, n bigint")
    hot = np.zeros(1 << SLOT_BITS, bool)
    for r in found.select("slot").distinct().toLocalIterator():
        hot[r["slot"]] = True
    return hot


def _settle(doc, place, long, short):
    """Order by both hashes, text and place; True where the same window starts earlier, in another text or place."""
    order = np.argsort(long, kind="stable") if _ordered(doc, place) else np.lexsort((place, doc, long))
    same = long[order][1:] == long[order][:-1]
    if np.any(same & (short[order][1:] != short[order][:-1])):
        # Different windows with the same long hash: told apart by the short one.
        order = np.lexsort((place, doc, short, long))
        same = (long[order][1:] == long[order][:-1]) & (short[order][1:] == short[order][:-1])
    d, p = doc[order], place[order]
    same = np.concatenate(([False], same))
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    # A row repeated with its id is the same text: its windows aren't earlier than themselves.
    return order, same & ((d != d[first]) | (p != p[first]))


def _ordered(doc, place) -> bool:
    return bool(np.all((doc[1:] > doc[:-1]) | ((doc[1:] == doc[:-1]) & (place[1:] >= place[:-1]))))


def _pieces(batches: Iterator[pa.RecordBatch], window: int, hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Long windows by bucket; a window met again within a block goes to the bucket of known repeats (-1)."""
    held, size = [], 0

    def flush():
        doc, place, long, short, offset = (np.concatenate(x) for x in zip(*held))
        if not _ordered(doc, place):
            by = np.lexsort((place, doc))
            doc, place, long, short, offset = (x[by] for x in (doc, place, long, short, offset))
        order, again = _settle(doc, place, long, short)
        known = np.zeros(len(doc), bool)
        known[order] = again
        own = np.where(hot[(mix(short) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], long, short)
        bucket = (mix(own + np.uint64(7)) % np.uint64(buckets)).astype(np.int32)
        bucket[known] = -1
        yield from _pack(bucket, doc, place, long, short, offset)

    for batch in chunks(batches, "body"):
        ids = batch.column("doc").to_numpy(zero_copy_only=False)
        _, docs, place, long, short, offset = _scan(batch, window)
        if len(docs):
            held.append((ids[docs].astype(np.int64), place.astype(np.int64), long, short, offset.astype(np.int64)))
        size += batch.column("body").nbytes
        if size > BLOCK and held:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _thin(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; the first byte says how many."""
    top = int(x.max())
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _thick(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint64)


def _pack(bucket, doc, place, long, short, offset) -> Iterator[pa.RecordBatch]:
    """One row per bucket with columns of runs: windows of one text that stand side by side under one short window."""
    small = bucket.max() < 0x7FFF
    order = np.argsort(bucket.astype(np.int16) if small else bucket, kind="stable")
    bucket, doc, place, long, short, offset = (x[order] for x in (bucket, doc, place, long, short, offset))
    head = np.ones(len(bucket), bool)
    side = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + 1) & (bucket[1:] == bucket[:-1])
    head[1:] = ~(side & ((bucket[1:] < 0) | ((short[1:] == short[:-1]) & (offset[1:] == offset[:-1] - 1))))
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, len(bucket)))
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    run_edge = np.append(np.searchsorted(at, edge), len(at)).tolist()
    edge = np.append(edge, len(bucket)).tolist()
    doc, place, short = doc[at].astype(np.int64).view(np.uint64), place[at], short[at]
    rows = []
    for i in range(len(edge) - 1):
        a, b = run_edge[i], run_edge[i + 1]
        number = int(bucket[edge[i]])
        rows.append((
            number, doc[a : a + 1].tobytes() + _thin(np.diff(doc[a:b], prepend=doc[a])), _thin(place[a:b]), short[a:b].tobytes() if number >= 0 else b"",
            _thin(count[a:b]), long[edge[i] : edge[i + 1]].tobytes() if number >= 0 else b"",
        ))
    for i in range(0, len(rows), 64):
        part = list(zip(*rows[i : i + 64]))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32())] + [pa.array(x, pa.binary()) for x in part[1:]], names=_NAMES)


def _unpack(row):
    doc = np.frombuffer(row["doc"], np.uint64, 1) + np.cumsum(_thick(row["doc"][8:]))
    return doc.view(np.int64), _thick(row["place"]).astype(np.int64), _thick(row["count"]).astype(np.int64)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of removed windows: text, first start, number. Rows come sorted by bucket."""
    held, current = [], None

    def settle():
        doc, place, count = (np.concatenate(x) for x in zip(*(_unpack(r) for r in held)))
        if current == -1:
            yield _runs(doc, place, count)
            return
        short = np.concatenate([np.frombuffer(r["short"], np.uint64) for r in held])
        # A short window met once has no longer repeat.
        order = np.argsort(short, kind="stable")
        s = short[order]
        same = np.concatenate(([False], s[1:] == s[:-1]))
        twice = np.empty(len(s), bool)
        twice[order] = same | np.append(same[1:], False)
        if not twice.any():
            return
        # The long windows under the others.
        run = np.repeat(np.arange(len(doc)), count)
        tag = np.concatenate([np.frombuffer(r["tag"], np.uint64) for r in held])
        step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        live = np.flatnonzero(twice[run])
        run, step, tag = run[live], step[live], tag[live]
        d, p = doc[run], place[run] + step
        order, again = _settle(d, p, tag, short[run])
        if again.any():
            order = order[again]
            yield _runs(d[order], p[order], np.ones(len(order), np.int64))

    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bucket"] != current:
                yield from settle()
                held = []
            current = row["bucket"]
            held.append(row)
            if current == -1:
                yield from settle()
                held = []
    if held:
        yield from settle()


def _runs(doc, place, count) -> pa.RecordBatch:
    """Side by side starts of one text as one run."""
    order = np.lexsort((place, doc))
    doc, place, count = doc[order], place[order], count[order]
    head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + count[:-1]))))
    stop = np.maximum.reduceat(place + count, head)
    return pa.RecordBatch.from_pydict({"doc": pa.array(doc[head]), "start": pa.array(place[head].astype(np.int32)), "stop": pa.array(stop.astype(np.int32))})


def repeated_runs(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc``, ``start``, ``stop``: starts of windows of a text that also start earlier.

    Earlier is a smaller id, or the same id and an earlier word. Rows without id
    or text have no windows; several texts under one id count as one text.
    """
    bound_batches(texts)
    spark = texts.sparkSession
    src = texts.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("body"))
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = spark.sparkContext.broadcast(_hot_slots(src, window))
    pieces = src.mapInArrow(lambda b: _pieces(b, window, hot.value, buckets), _PIECE)
    # Known repeats need no meeting: spread them.
    known = F.when(F.col("bucket") < 0, F.xxhash64("doc", "place") % (1 << 20)).otherwise(F.lit(0))
    dealt = pieces.withColumn("spread", known).repartition("bucket", "spread").sortWithinPartitions("bucket")
    return dealt.select(*_NAMES).mapInArrow(_repeats, "doc bigint, start int, stop int")


def _cut(batches: Iterator[pa.RecordBatch], keep: list[str], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, kept = [], [], []
        for text, runs in zip(strings(batch.column("__body")), batch.column("__runs").to_pylist()):
            w = text.split()
            n.append(len(w))
            if runs:
                stays = np.ones(len(w), bool)
                for r in runs:
                    stays[r["start"] : r["stop"] - 1 + window] = False
                w = [x for x, s in zip(w, stays) if s]
            removed.append(n[-1] - len(w))
            kept.append(b" ".join(w))
        made = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "n_words", "n_removed", "kept"])


def remove_repeats(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``texts`` with ``n_words``, ``n_removed``, ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Every word covered by a window
    of ``window`` words that also starts earlier (smaller id, or same id and
    earlier word) is removed, judged on the input; ``kept`` joins the others by
    one space. Null and empty texts have no words; texts without id are left as
    they are; repeated rows of one id count as the same text. Columns with the
    new names are replaced.
    """
    new = ("n_words", "n_removed", "kept")
    keep = [c for c in texts.columns if c not in new]
    runs = repeated_runs(texts, id_col, text_col, window).groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("start", "stop")).alias("__runs"))
    held = texts.select(*keep, F.col(text_col).alias("__body"))
    joined = held.join(runs, F.col(id_col).cast("bigint") == F.col("__doc"), "left").select(*keep, "__body", "__runs")
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema.fields), "n_words bigint, n_removed bigint, kept string"])
    return joined.mapInArrow(lambda b: _cut(b, keep, window), ddl)
