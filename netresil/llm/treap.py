"""Ranked lexical search over K2-treaps of a term-document grid.

Rows of the grid are the terms the items ask for, columns are documents in
order of their lengths, so that neighbours have like impacts. A treap halves both sides at every level; a cell is kept
where it holds an entry, and stores the greatest impact below it. An item sits
on a range of documents with one cell per term: the sum of weight x greatest
impact bounds every score in the range. Ranges are halved best bound first,
each term's cell giving way to the cell of its row in the half, until no range
left can come before the documents found.

Documents are split by Spark into blocks; a task builds the treap of a block,
searches it for all items and hands the scores to beat to its next block. Two
scans are made: one counts what the weights and lengths need, one searches.

Road-network records hold no running text, so the operator is general: it takes
any two tables with an id and a text column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netresil.llm.text import IS_ALNUM, bound_batches, chunks, word_hashes, words

#: Bytes of text and number of documents of one block, and terms of the items searched together.
BLOCK_BYTES, BLOCK_DOCS, PART_TERMS = 16 << 20, 1 << 16, 1 << 18
#: Ranges of one item halved at once in the first descent (twice as many in each that follows), and entries under the
#: items searched together: about twice as many cells are held at most.
WIDTH, HELD_CELLS = 32, 4 << 20


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term in order (runs of letters and digits, A-Z in lower case, every non-ASCII character a letter), and where each text's begin."""
    w = words(column, fold=True, inside_word=IS_ALNUM)
    return word_hashes(w), w.bounds


@dataclass
class Treap:
    """Cells of all levels in one row, from the cell over the whole grid to single entries; ``most`` is a cell's greatest impact.

    The children of cell c are consecutive cells from ``first[c]`` on; bit
    2 * r + d of ``mask[c]`` says that there is one in row half r and document
    half d. ``depth`` is the number of halvings.
    """

    depth: int
    most: np.ndarray
    mask: np.ndarray
    first: np.ndarray


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers moved to every second place."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


def build(row: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> Treap:
    """Treap of entries (row, document, impact), each place at most once."""
    depth = int(max(row.max(initial=0), doc.max(initial=0))).bit_length()
    code = _spread(row) << np.uint64(1) | _spread(doc)
    order = np.argsort(code)
    code, values = code[order], impact[order]
    most, mask, first = [values], [], []
    for _ in range(depth if len(row) else 0):
        parent = code >> np.uint64(2)
        at = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        mask.append(np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), at))
        first.append(at)
        values = np.maximum.reduceat(values, at)
        most.append(values)
        code = parent[at]
    below = np.cumsum([len(m) for m in most[::-1]])
    first = [f + below[level] for level, f in enumerate(first[::-1])]
    return Treap(depth, np.concatenate(most[::-1]), np.concatenate([*mask[::-1], np.zeros(0, np.uint8)]), np.concatenate([*first, np.zeros(0, np.int64)]))


#: How many of the lower bits of a mask are set before each place.
_BEFORE = np.array([[bin(m & ((1 << k) - 1)).count("1") for k in range(4)] for m in range(16)])


class _Frontier:
    """Ranges still open: item, level, place (in units of their size), bound, and their slice of the cells held."""

    FIELDS = ("item", "level", "at", "bound", "start", "size")

    def __init__(self, item, at, bound, start, size, cells):
        self.item, self.level, self.at, self.bound, self.start, self.size = item, np.zeros_like(at), at, bound, start, size
        self.cells = cells

    def __len__(self) -> int:
        return len(self.item)

    def where(self, keep: np.ndarray) -> None:
        for f in self.FIELDS:
            setattr(self, f, getattr(self, f)[keep])

    def add(self, cells: tuple, **fields: np.ndarray) -> None:
        """New ranges whose cells follow the held ones; cells of closed ranges go when they are the larger part."""
        fields["start"] = fields["start"] + len(self.cells[0])
        for f in self.FIELDS:
            setattr(self, f, np.concatenate([getattr(self, f), fields[f]]))
        self.cells = tuple(np.concatenate(x) for x in zip(self.cells, cells))
        if len(self.cells[0]) > 2 * self.size.sum():
            at = _slices(self.start, self.size)
            self.cells = tuple(x[at] for x in self.cells)
            self.start = np.cumsum(self.size) - self.size


def _slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all given slices one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def search(treap: Treap, items: np.ndarray, rows: np.ndarray, weights: np.ndarray, n_items: int, k: int, beat: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best documents (item, ``tie`` of the document, score) of every item, equal scores by smaller ``tie``.

    ``items``, ``rows``, ``weights``: an item's terms by row of the grid, ordered by
    item. Documents below ``beat[item]`` are left out. All items descend
    together; each halves its best ranges, more of them with every descent.
    """
    best = tuple(np.zeros(0, np.int64) for _ in range(3))
    beat = np.maximum(beat, 1)
    inside = rows < 1 << treap.depth  # other rows have no entry
    items, rows, weights = items[inside], rows[inside], weights[inside]
    if len(items) == 0 or len(treap.most) == 0:
        return best
    whole, start, size = np.unique(items, return_index=True, return_counts=True)
    bound = np.add.reduceat(weights * treap.most[0], start)
    front = _Frontier(whole, np.zeros_like(start), bound, start, size, (rows, weights, np.zeros_like(rows)))
    turn = 0
    while len(front):
        width = WIDTH << turn // (treap.depth + 1)
        turn += 1
        order = np.lexsort((-front.bound, front.item))
        item = front.item[order]
        taken = np.zeros(len(order), bool)
        taken[order[_place(item) < width]] = True
        single = taken & (front.level == treap.depth)
        # A single document's bound is its score.
        best = _leading(*(np.concatenate(x) for x in zip(best, (front.item[single], tie[front.at[single]], front.bound[single]))), k, beat)
        count = np.bincount(best[0], minlength=n_items)
        score, full = beat.copy(), count >= k
        score[full] = best[2][(np.cumsum(count) - 1)[full]]
        halved = np.flatnonzero(taken & ~single)
        cells, fields = _halve(treap, front, halved, score)
        front.where(~taken & (front.bound >= score[front.item]))
        front.add(cells, **fields)
    return best


def _halve(treap: Treap, front: _Frontier, ranges: np.ndarray, score: np.ndarray) -> tuple[tuple, dict[str, np.ndarray]]:
    """Cells and fields of both halves of the given ranges, but for those below ``score``."""
    size = front.size[ranges]
    at = _slices(front.start[ranges], size)
    owner = np.repeat(np.arange(len(ranges)), size)
    row, weight, cell = (x[at] for x in front.cells)
    half = (row >> (treap.depth - 1 - front.level[ranges][owner])) & 1
    held, first = treap.mask[cell], treap.first[cell]
    cells, fields = [], []
    for side in (0, 1):
        bit = 2 * half + side
        there = np.flatnonzero((held >> bit) & 1)
        child = first[there] + _BEFORE[held[there], bit[there]]
        n = np.bincount(owner[there], minlength=len(ranges))
        have = np.flatnonzero(n)
        n = n[have]
        bound = np.add.reduceat(weight[there] * treap.most[child], np.cumsum(n) - n) if len(have) else np.zeros(0, np.int64)
        parent = ranges[have]
        keep = bound >= score[front.item[parent]]
        stay = np.repeat(keep, n)
        cells.append((row[there][stay], weight[there][stay], child[stay]))
        parent = parent[keep]
        fields.append({"item": front.item[parent], "level": front.level[parent] + 1, "at": front.at[parent] * 2 + side, "bound": bound[keep], "size": n[keep]})
    joined = {f: np.concatenate([x[f] for x in fields]) for f in fields[0]}
    joined["start"] = np.cumsum(joined["size"]) - joined["size"]
    return tuple(np.concatenate(x) for x in zip(*cells)), joined


def _place(group: np.ndarray) -> np.ndarray:
    """Place of each entry within its group; equal entries stand together."""
    if len(group) == 0:
        return np.zeros(0, np.int64)
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.arange(len(group)) - np.repeat(begin, np.diff(np.r_[begin, len(group)]))


def _leading(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int, beat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` first of every item by score and then document, ordered so, none below ``beat``."""
    order = np.lexsort((doc, -score, item))
    order = order[score[order] >= beat[item[order]]]
    item, doc, score = item[order], doc[order], score[order]
    first = _place(item) < k
    return item[first], doc[first], score[first]


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an entry adds per unit of weight: saturated in its count, less in longer documents."""
    m = 10 + (90 * length * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _entries(asked: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries (row of the term in ``asked``, document, count) and the number of terms of each document."""
    hashes, bounds = terms(column)
    lengths = np.diff(bounds)
    at = np.searchsorted(asked, hashes)
    at[at == len(asked)] = 0
    known = asked[at] == hashes if len(asked) else np.zeros(len(hashes), bool)
    places = at[known] * len(lengths) + np.repeat(np.arange(len(lengths)), lengths)[known]
    places, tf = np.unique(places, return_counts=True)
    return places // max(len(lengths), 1), places % max(len(lengths), 1), tf, lengths


def _parts(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Items with their distinct terms, in parts of at most ``limit`` terms or of one item."""
    ids, held, n = [], [], 0
    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        asked = np.unique(terms(pa.array([row["t"]], pa.string()))[0])
        if ids and n + len(asked) > limit:
            yield ids, held
            ids, held, n = [], [], 0
        ids.append(row["i"])
        held.append(asked)
        n += len(asked)
    if ids:
        yield ids, held


def rank_documents(
    documents: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    part_terms: int = PART_TERMS, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """Each item's ``k`` documents of the highest score above 0: item id, ``rank``, document id, ``score``.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), where N counts the
    documents with a term; an item's score of a document is the sum over its
    distinct terms of weight x impact (see ``impacts``). Equal scores rank by
    ascending document id, null ids last; rows with equal ids are documents of
    their own. Every item is ranked by itself, also under a repeated or null
    id. Null and empty texts have no terms, so such items give no rows. Other
    columns are not read. Terms are compared by 64-bit hashes.

    The items are a stated query set: they pass the driver in parts of at most
    ``part_terms`` terms, and each part is searched in all documents.
    """
    bound_batches(documents)
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    id_type, item_type = docs.schema["id"].dataType, items.schema[item_id].dataType
    found = [
        _search_part(docs, names, asked, k, block_bytes, block_docs, id_type, item_type)
        for names, asked in _parts(items, item_id, item_text, part_terms)
    ]
    out_types = f"`{item_id}` {item_type.simpleString()}, rank int, `{doc_id}` {id_type.simpleString()}, score bigint"
    if not found:
        return spark.createDataFrame([], out_types)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("item").alias(item_id), "rank", F.col("id").alias(doc_id), "score")


def _search_part(docs: DataFrame, names: list, asked: list[np.ndarray], k: int, block_bytes: int, block_docs: int, id_type, item_type) -> DataFrame:
    spark = docs.sparkSession
    grid = np.unique(np.concatenate(asked)) if asked else np.zeros(0, np.uint64)
    shared_grid = spark.sparkContext.broadcast(grid)  # bounded by part_terms, but for one longer item

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared_grid.value), np.int64)
        n_docs = n_terms = 0
        for batch in chunks(batches, "body"):
            row, _, _, lengths = _entries(shared_grid.value, batch.column(1))
            df += np.bincount(row, minlength=len(df))
            n_docs, n_terms = n_docs + int((lengths > 0).sum()), n_terms + int(lengths.sum())
        seen = np.flatnonzero(df)
        key, n = np.r_[-2, -1, seen], np.r_[n_docs, n_terms, df[seen]]
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    totals = docs.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    total = dict(zip(totals["key"].tolist(), totals["n"].tolist()))
    n_docs, n_terms = total.get(-2, 0), total.get(-1, 0)
    weights = np.array([weight(n_docs, total[r]) if r in total else 0 for r in range(len(grid))], np.int64)
    item = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
    row = np.searchsorted(grid, np.concatenate(asked))
    held = weights[row] > 0
    queries = spark.sparkContext.broadcast((item[held], row[held], weights[row[held]]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, rows, w = queries.value
        best, beat = None, np.zeros(len(asked), np.int64)
        for block in _blocks(batches, block_bytes, block_docs):
            order = pc.sort_indices(block.column(0), null_placement="at_end")
            entry_row, entry_doc, tf, lengths = _entries(shared_grid.value, block.column(1))
            by_id, by_length = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            by_id[np.asarray(order)] = np.arange(len(lengths))
            column = np.argsort(lengths, kind="stable")
            by_length[column] = np.arange(len(lengths))
            treap = build(entry_row, by_length[entry_doc], impacts(tf, lengths[entry_doc], n_docs, n_terms))
            under = np.bincount(entry_row, minlength=len(shared_grid.value))[rows]
            parts = [search(treap, items[a:b], rows[a:b], w[a:b], len(asked), k, beat, by_id[column]) for a, b in _cut(items, under, HELD_CELLS)]
            i, d, s = (np.concatenate([p[c] for p in parts] or [np.zeros(0, np.int64)]) for c in range(3))
            got = pa.table({"item": pa.array(i, pa.int64()), "id": block.column(0).take(order).take(pa.array(d)), "score": pa.array(s, pa.int64())})
            best = got if best is None else pa.concat_tables([best, got])
            # Ids order as in the block: ascending, nulls last.
            best = best.take(pc.sort_indices(best, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end"))
            held_item = np.asarray(best["item"])
            begin = np.searchsorted(held_item, np.arange(len(asked) + 1))
            best = best.take(pa.array(np.flatnonzero(np.arange(len(held_item)) - begin[held_item] < k)))
            n = np.minimum(np.diff(begin), k)
            last = np.cumsum(n) - 1
            beat[n == k] = np.asarray(best["score"])[last[n == k]]
        if best is not None:
            yield from best.to_batches()

    candidates = docs.mapInArrow(look, f"item bigint, id {id_type.simpleString()}, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = spark.createDataFrame([(i, name) for i, name in enumerate(names)], f"number bigint, item {item_type.simpleString()}")
    return ranked.withColumnRenamed("item", "number").join(F.broadcast(named), "number").select("item", "rank", "id", "score")  # named: one row per item of the part


def _cut(items: np.ndarray, size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Slices of whole items whose sizes add up to ``limit`` at most, or of one item."""
    edges = np.r_[np.flatnonzero(np.r_[True, items[1:] != items[:-1]]), len(items)] if len(items) else np.zeros(1, np.int64)
    total = np.r_[0, np.cumsum(size)][edges]
    at = 0
    while at < len(edges) - 1:
        stop = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield int(edges[at]), int(edges[stop])
        at = stop


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int, block_docs: int) -> Iterator[pa.Table]:
    """Batches gathered up to a number of bytes and documents."""
    held, size, n = [], 0, 0
    for batch in chunks(batches, "body", block_bytes):
        more = batch.column(1).nbytes
        if held and (size + more > block_bytes or n + batch.num_rows > block_docs):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, n = [], 0, 0
        held.append(batch)
        size, n = size + more, n + batch.num_rows
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()[:1]
