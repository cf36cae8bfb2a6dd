"""Links between texts by the Jaccard similarity of their word shingles.

A size-aware heavy-light join. Sets up to a boundary are light: they list all
subsets of the sizes that a linked light partner must share, and two of them
meet where a subset is equal. Larger sets are heavy: they meet in inverted lists
over the first ``n - ceil(t n) + s`` shingles in one global order (those with a
rare word first), of which a linked pair shares at least ``s``; pairs that share fewer are
no candidates. The boundary is the size at which the listed subsets begin to
cost more than the lists.

Texts with equal sets are folded first. In every list each member is compared
with one centre; what is linked so is one component, and only members of
different components are compared with each other. Size and a parity bitmap of
512 bits bound the overlap exactly from above, so few pairs need their sets; the
verdict is exact on shingle hashes of 60 bits.

Road-network records hold no running text, so the operator is general.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netresil.llm.text import bound_batches, chunks, mix, sliding_min, windows, word_hashes, words
from netresil.operators.components import star_labels
from netresil.session import Scratch, cut_lineage

#: Fixed values of the contract: words per shingle, similarity in hundredths.
SHINGLE, PERCENT = 4, 85
#: Slots of the table that counts words, and how often a slot must be met in a task to be told of.
SLOT_BITS, MET = 20, 8
_WORDS = -1_000_000
#: Cost of scanning one inverted list against storing one subset, and the largest boundary considered.
SCAN_COST, LARGEST_LIGHT = 5, 24
#: Shingles of their lists that linked heavy sets share.
SHARED = 4
#: Words of the parity bitmap of every set, and of the wide one of sets beyond ``WIDE_FROM`` shingles.
BITMAP_WORDS, WIDE_BITS, WIDE_FROM = 8, 13, 512


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Smallest intersection of linked sets of sizes ``n`` and ``m``."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int = PERCENT) -> range:
    """Sizes that a set linked to one of size ``n`` can have."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix(n, percent: int = PERCENT):
    """Shingles of which a linked pair shares at least ``SHARED``, or as many as its smaller set must share at all."""
    return np.minimum(n, n - (percent * n + 99) // 100 + SHARED)


def subset_sizes(n: int, boundary: int, percent: int = PERCENT) -> list[int]:
    return sorted({least_overlap(n, m, percent) for m in partners(n, percent) if 1 <= m <= boundary})


def choose_boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """The largest light size: the boundary with the least cost for the sets at hand."""

    def cost(b: int) -> int:
        light = sum(k * sum(comb(n, c) for c in subset_sizes(n, b, percent)) for n, k in sizes.items() if n <= b)
        return light + sum(k * int(prefix(n, percent)) * SCAN_COST for n, k in sizes.items() if n > b or n >= partners(b + 1, percent)[0])

    return min(range(LARGEST_LIGHT + 1), key=lambda b: (cost(b), b))


def _shingles(column: pa.Array, length: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in the order of the texts, and the bounds of each text's.

    With ``rank`` (by slot of a word) the top four bits give way to the rank of
    the shingle's rarest word.
    """
    w = words(column, fold=True)
    h = word_hashes(w)
    count = np.diff(w.bounds)
    n = np.where(count >= length, count - length + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(bounds[-1], np.uint64)
    r = None if rank is None else rank[_slot(h)]
    top = lambda x, least: x if least is None else (x >> np.uint64(4)) | (least.astype(np.uint64) << np.uint64(60))
    whole = top(windows(h, length), None if r is None or len(r) < length else sliding_min(r, length))
    long = count >= length
    if long.any():
        at = np.arange(int(n[long].sum())) - np.repeat(np.cumsum(n[long]) - n[long], n[long])
        out[np.repeat(bounds[:-1][long], n[long]) + at] = whole[np.repeat(w.bounds[:-1][long], n[long]) + at]
    for d in np.flatnonzero(~long & (count > 0)):
        a, b = w.bounds[d], w.bounds[d + 1]
        out[bounds[d]] = top(windows(h[a:b], int(b - a)), None if r is None else r[a:b].min(keepdims=True))[0]
    return out, bounds


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _frequent(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Word slots met at least ``MET`` times in a task; as negative slots, how many sets there are of each small size, and the words."""
    table, small = np.zeros(1 << SLOT_BITS, np.int64), np.zeros(2 * LARGEST_LIGHT + 2, np.int64)
    for batch in chunks(batches, "body"):
        w = words(batch.column("body"), fold=True)
        table += np.bincount(_slot(word_hashes(w)), minlength=len(table))
        count = np.diff(w.bounds)
        small += np.bincount(np.minimum(np.where(count >= length, count - length + 1, np.minimum(count, 1)), len(small) - 1), minlength=len(small))
    hot = np.flatnonzero(table >= MET)
    slots = np.concatenate((hot, -1 - np.arange(len(small)), [_WORDS]))
    yield pa.RecordBatch.from_pydict({"slot": pa.array(slots.astype(np.int32)), "n": pa.array(np.concatenate((table[hot], small, [table.sum()])))})


class Order:
    """The global order of shingles: by how rare their rarest word is, then by hash.

    Any order serves, as long as it is one; rare first keeps lists short. The
    rank of a word is the logarithm of its share of all words, from about one in
    two million on.
    """

    def __init__(self, counts: dict[int, int], length: int):
        self.length = length
        self.sizes = {-1 - s: n for s, n in counts.items() if _WORDS < s < -1 and n}
        self.rank = np.zeros(1 << SLOT_BITS, np.uint8)
        total = max(1, counts.get(_WORDS, 1))
        for slot, n in counts.items():
            if slot >= 0:
                self.rank[slot] = min(15, max(1, int(np.log2(n / total)) + 20))

    def sets(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of each text in the global order (rank in the top four bits), and their bounds."""
        h, bounds = _shingles(column, self.length, self.rank)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[bounds[:-1][bounds[:-1] < len(h)]] = True
        return h[new], np.concatenate(([0], np.cumsum(new)))[bounds]


def _reduce(ufunc, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    filled = np.flatnonzero(np.diff(bounds))
    out = np.zeros(len(bounds) - 1, values.dtype)
    if len(filled):
        out[filled] = ufunc.reduceat(values, bounds[filled])
    return out


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _describe(batches: Iterator[pa.RecordBatch], order: Order, boundary: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Per text: id, size, digest of the set, parity bitmaps, keys under which linked sets meet."""
    first_heavy = partners(boundary + 1, percent)[0]
    for batch in chunks(batches, "body"):
        h, bounds = order.sets(batch.column("body"))
        n = np.diff(bounds)
        m = mix(h)
        one, two = _reduce(np.add, m, bounds), _reduce(np.add, mix(m ^ np.uint64(0x5851F42D4C957F2D)), bounds)
        bit = m >> np.uint64(55)
        flag = np.uint64(1) << (bit & np.uint64(63))
        bits = np.column_stack([_reduce(np.bitwise_xor, np.where(bit >> np.uint64(6) == k, flag, np.uint64(0)), bounds) for k in range(BITMAP_WORDS)])
        wide: list = [None] * len(n)
        for d in np.flatnonzero(n > WIDE_FROM).tolist():
            odd = np.bincount((m[bounds[d] : bounds[d + 1]] >> np.uint64(64 - WIDE_BITS)).astype(np.int64), minlength=1 << WIDE_BITS) & 1
            wide[d] = np.packbits(odd.astype(bool)).view(np.int64)
        listed = np.where(n >= max(first_heavy, 1), prefix(n, percent), 0)
        subsets = {}
        for d in np.flatnonzero((n > 0) & (n <= boundary)).tolist():
            held = h[bounds[d] : bounds[d + 1]]
            keys = []
            for c in subset_sizes(int(n[d]), boundary, percent):
                rows = np.array(list(combinations(range(int(n[d])), c)))
                acc = np.full(len(rows), c, np.uint64)
                for j in range(c):
                    acc = mix(acc + held[rows[:, j]])
                keys.append(acc)
            subsets[d] = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        total = listed + np.array([len(subsets.get(d, ())) for d in range(len(n))], np.int64)
        at = np.concatenate(([0], np.cumsum(total)))
        keys = np.zeros(at[-1], np.uint64)
        step = np.arange(int(listed.sum())) - np.repeat(np.cumsum(listed) - listed, listed)
        keys[np.repeat(at[:-1], listed) + step] = mix(h[np.repeat(bounds[:-1], listed) + step] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        for d, k in subsets.items():
            keys[at[d] + listed[d] : at[d + 1]] = k
        yield pa.RecordBatch.from_arrays([
            batch.column("doc"), pa.array(n.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
            _lists(bits.ravel(), np.arange(0, bits.size + 1, BITMAP_WORDS)), pa.array(wide, pa.list_(pa.int64())), _lists(keys, at),
        ], names=["doc", "n", "d1", "d2", "bits", "wide", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], order: Order) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "body"):
        h, bounds = order.sets(batch.column("body"))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), _lists(h, bounds)], names=["doc", "shingles"])


def _differ(n: Column, m: Column, percent: int) -> Column:
    """Shingles that two linked sets of these sizes may have on one side only."""
    return n + m - 2 * F.ceil(percent * (n + m) / (100.0 + percent) - 1e-9)


def _can_link(n: Column, m: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sizes and bitmaps leave a link possible: differing bits are differing shingles."""
    bits = sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(BITMAP_WORDS)), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (bits <= _differ(n, m, percent))


def _linked(pairs: DataFrame, src: DataFrame, reps: DataFrame, order, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs ``a, b`` whose sets reach the similarity; only texts in a pair that both bitmaps allow are read in full."""
    side = lambda x: reps.select(F.col("doc").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "bits", "wide")])
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_can_link(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"), percent))
    bits = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    near = near.where(F.coalesce(bits <= _differ(F.col("n_a"), F.col("n_b"), percent), F.lit(True)))
    near = scratch.cut(near.select("a", "b").distinct())
    wanted = scratch.cut(near.select(F.col("a").alias("doc")).unionByName(near.select(F.col("b").alias("doc"))).distinct())
    sets = scratch.cut(src.join(wanted, "doc", "left_semi").mapInArrow(lambda b: _sets(b, order.value), "doc bigint, shingles array<bigint>"))
    both = near.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y")), "b")
    inter = F.size(F.array_intersect("x", "y"))
    return scratch.cut(both.where(100 * inter >= percent * (F.size("x") + F.size("y") - inter)).select("a", "b"))


def jaccard_components(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` of every row.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a set holds the
    distinct runs of ``length`` words, or all words as one run where there are
    fewer. Two texts link when ``100 * intersection >= percent * union``;
    ``component_id`` is the smallest id reachable by links. Texts that are null
    or have no words have size 0 and are linked with nothing; rows without id
    are too, and get no component. Repeated rows link with each other; several
    texts under one id are one document, linked by any of them.
    """
    bound_batches(texts)
    with Scratch() as scratch:
        return cut_lineage(_components(texts.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("body")), length, percent, scratch)).withColumnRenamed("doc", id_col)


def _components(src: DataFrame, length: int, percent: int, scratch: Scratch) -> DataFrame:
    sc = src.sparkSession.sparkContext
    counted = src.where("body is not null").mapInArrow(lambda b: _frequent(b, length), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    order = sc.broadcast(Order({r["slot"]: r["n"] for r in counted.toLocalIterator()}, length))  # as many slots at most as the table has
    boundary = choose_boundary({n: k for n, k in order.value.sizes.items() if n <= 2 * LARGEST_LIGHT}, percent)
    ddl = "doc bigint, n int, d1 bigint, d2 bigint, bits array<bigint>, wide array<bigint>, keys array<bigint>"
    described = scratch.cut(src.mapInArrow(lambda b: _describe(b, order.value, boundary, percent), ddl))

    # Equal sets are one: the smallest id stands for them.
    real = described.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    folded = real.groupBy("n", "d1", "d2").agg(F.min("doc").alias("rep"))
    of = scratch.cut(real.select("doc", "n", "d1", "d2").distinct().join(folded, ["n", "d1", "d2"]).select("doc", "n", "rep"))
    # an id with several texts of one size has a bitmap for each
    reps = scratch.cut(real.join(of.where(F.col("doc") == F.col("rep")).select("doc", "n"), ["doc", "n"]).dropDuplicates(["doc", "n", "d1", "d2"]).select("doc", "n", "bits", "wide"))

    # Lists of two whose sizes can't link are dropped before anything else travels.
    keyed = real.select("doc", "n", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low"), F.max("n").alias("high"))
    met = met.where((F.col("k") > 2) | (F.col("k") == 2) & (100 * F.col("low") >= percent * F.col("high"))).select("key")
    lists = scratch.cut(keyed.select("key", "doc").join(met, "key").select("key", "doc"))

    # A pair of texts stands for the sets they hold. Light sets share one subset, others so many shingles of their lists.
    least = F.least("n_x", "n_y")
    enough = F.when(F.greatest("n_x", "n_y") <= boundary, 1).otherwise(F.least(F.lit(SHARED), F.ceil(percent * least / 100.0 - 1e-9)))
    side = lambda x: of.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("rep").alias(f"r_{x}"))
    centre = lists.groupBy("key").agg(F.min("doc").alias("y"))
    star = lists.select("key", F.col("doc").alias("x")).join(centre, "key").where("x <> y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"))
    star = star.join(side("x"), "x").join(side("y"), "y").where((F.col("r_x") != F.col("r_y")) & (F.col("shared") >= enough))
    star = star.select(F.least("r_x", "r_y").alias("a"), F.greatest("r_x", "r_y").alias("b")).distinct()
    links = _linked(star, src, reps, order, percent, scratch)
    labels = star_labels(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = scratch.cut(of.join(labels.withColumnRenamed("node_id", "rep"), "rep", "left").select("doc", "n", "rep", F.coalesce("component", "rep").alias("component")))

    # What still meets without being connected is compared pair by pair.
    held = lists.join(placed, "doc").select("key", F.col("rep").alias("doc"), "n", "component").distinct()
    held = scratch.cut(held)
    torn = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rest = scratch.cut(held.join(torn, "key").join(reps.select("doc", "n", "bits"), ["doc", "n"]).select("key", "doc", "n", "component", "bits"))
    left = rest.select("key", *[F.col(c).alias(f"{c}_a") for c in ("doc", "n", "component", "bits")])
    right = rest.select("key", *[F.col(c).alias(f"{c}_b") for c in ("doc", "n", "component", "bits")])
    apart = (F.col("doc_a") < F.col("doc_b")) & (F.col("component_a") != F.col("component_b"))
    fits = _can_link(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"), percent)
    pairs = left.join(right, (left["key"] == right["key"]) & apart & fits).groupBy(
        F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), F.col("n_a").alias("n_x"), F.col("n_b").alias("n_y")).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= enough).select("a", "b")
    more = _linked(pairs, src, reps, order, percent, scratch)
    ends = of.groupBy("doc").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    same_id = of.join(ends, "doc").select(F.col("low").alias("a"), F.col("rep").alias("b")).where("a < b")
    joined = star_labels(links.unionByName(more).unionByName(same_id).select(F.col("a").alias("src"), F.col("b").alias("dst")))

    known = of.select("doc", "rep").join(joined.withColumnRenamed("node_id", "rep"), "rep", "left").groupBy("doc").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    return described.select("doc", "n").join(known, "doc", "left").select(
        "doc", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc")).alias("component_id"))
