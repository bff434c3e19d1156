"""N-gram Jaccard join: size-aware, with subsets for small sets and inverted lists for large ones.

Two sets A and B of similarity t or more share c = ceil(t * max(|A|, |B|))
members at least. In any total order of all shingles, the first l of the
shared members then stand among the first |A| - ceil(t * |A|) + l of A, and
of B alike. The order here is rarest first (by a count sketch of the whole
corpus, ties by hash), which any reader of the sketch can repeat.

- Large sets take l = 1: each of those first members is a key, an inverted
  list to be scanned.
- Small sets take l = 2: each pair of those first members is a key; pairs are
  much rarer than members, so common lines don't gather in long lists.
- The boundary is the size with the least cost in all: for each size, the
  number of sets, of their keys of either kind, and how many of their first
  members stand in another set's list too, measured over all documents on one
  of SLICE hash ranges of members. Sets just below the boundary, which may have partners above it, take
  both kinds of keys.

A pair of sets with a common key is a candidate if the members after the key
in the order leave room for as many as it must share; candidates that digests of
their sets don't rule out are verified on whole texts. Equal sets are one class from the start. For components not
every link is needed: in a key's list, each class is first compared with one
class of the list, its hub, and of its hubs with the one met most often. Then
candidates that are still in different components are compared, all of them
that bitmaps of the sets, sent with the list, don't rule out: no link between
different components is left out. Groups of near copies thus cost about one
comparison a member, not all pairs. A list with many such candidates is split
among tasks: its sets are dealt to parts, and each two parts meet in a task.

What is of fixed size whatever the corpus: the sketch (4 MB where it is sent)
and filters of ids (16 MB at most). A corpus that fills them gets a poorer order
and more rows shuffled; results don't depend on either.

Nulls: a null text is empty; texts without words have no set and link with
nothing. A text of one to four words has its whole word sequence as its set.
A row with a null doc_id links with nothing and has a null component. Repeated
rows are each reported; rows with one doc_id and different texts count as
different sets, the component of either being the least that one of them
reaches. Ties (equal sets) are one class. Very long texts are read whole, one
at a time. An empty table gives no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xylem.llm.common import U64, cut, discard, doc_frame, mix64, ragged, slices, tidy
from xylem.llm.components import connected_components
from xylem.llm.shingles import shingle_sets, signatures

_LOG = logging.getLogger(__name__)
#: Counters of the sketch, and blocks it is summed in: 4 MB in all where it is sent, whatever the corpus.
COUNTERS, BLOCKS = 1 << 22, 64
#: Bits of a filter of ids for each id, and in all at most: 16 MB; where it fills up, more texts are shuffled.
ID_BITS, FILTER_BITS = 16, 1 << 27
#: What a key in another set's list costs more than a key alone: joins, and texts of candidates. Measured as about 25 against 3 microseconds.
SCAN_COST = 8.0
#: Lists are measured on one of so many hash ranges of members. Sizes from LARGE on count as one.
SLICE, LARGE = 16, 4096
#: A hub with more pairs than this has its members dealt to so many tasks.
SPREAD = ((1 << 8, 1 << 6), (1 << 16, 1 << 12))
#: Bits of the bitmap that a set has in a list, whatever its size; and pairs whose bitmaps are compared at a time.
LIST_BITS, LIST_STEP = 512, 1 << 16
#: A list with more pairs of different components, or more rows, than these is split among tasks, in so many parts at most.
PAIRS_A_TASK, ROWS_A_TASK, PARTS = 1 << 19, 1 << 18, (4, 16, 64, 256, 1024)
#: Text worked on at a time: arrays of eight bytes a byte stay small.
STEP_BYTES = 1 << 20
#: Rows of a list that are held at once where its hubs are found.
RUN_ROWS = 1 << 20


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(42)).astype(np.int64)


def _summed_blocks(rows: DataFrame, dtype: str) -> DataFrame:
    """(block, data): blobs of one block from many tasks made one: counts added up and given as their logarithms in a byte, bits or-ed."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.frombuffer(zstandard.decompress(data.as_buffer()), dtype)
                if dtype == "u1":
                    sums[block] = one | sums[block] if block in sums else one
                else:
                    sums[block] = one + sums.get(block, np.uint64(0))
        for block, data in sums.items():
            data = data if dtype == "u1" else np.minimum(8 * np.log2(data + 1.0), 255).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})

    return rows.repartition("block").mapInArrow(tidy(add), "block int, data binary")


def _collected(blocks: DataFrame, size: int) -> np.ndarray:
    out = np.zeros((BLOCKS, size // BLOCKS), np.uint8)
    for row in blocks.collect():  # BLOCKS rows of a fixed size, 16 MB in all at most; one by one would be a job for each partition
        out[row["block"]] = np.frombuffer(row["data"], np.uint8)
    return out.reshape(-1)


def prefix_length(n: int, members: int, t: tuple[int, int]) -> int:
    """How many of a set's first members hold the first `members` shared ones."""
    return n - -(-n * t[0] // t[1]) + members


def boundary(histogram: dict[int, int], lists: dict[int, tuple[int, int]], t: tuple[int, int]) -> int:
    """The largest size of a small set: the one with the least cost over the histogram of sizes, which counts those from LARGE on together.

    lists: for each size, the number of first members measured, and how many of
    them have another set in their list. Sizes that were seldom met lean on the mean of all.
    """
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return 0
    n = np.array([histogram[s] for s in sizes.tolist()], float)
    met = np.array([lists.get(s, (0, 0)) for s in sizes.tolist()], float)
    mean = met[:, 1].sum() / max(1.0, met[:, 0].sum())
    share = (met[:, 1] + 50 * mean) / (met[:, 0] + 50)
    one = sizes - -(-sizes * t[0] // t[1]) + 1
    small = (one + 1) * one / 2 * n
    large = one * (1 + SCAN_COST * share) * n
    below = np.concatenate([[0], np.cumsum(small)])
    above = np.concatenate([np.cumsum(large[::-1])[::-1], [0]])
    # small sets that may have a partner above the boundary take both kinds of keys
    upto = np.concatenate([[0], np.cumsum(large)])
    nearest = np.append(sizes, 1 << 40)
    both = upto - upto[np.minimum(np.searchsorted(sizes, -(-nearest * t[0] // t[1])), np.arange(len(upto)))]
    cost = below + above + both
    best = int(np.argmin(cost[: 1 + int((sizes < LARGE).sum())]))
    return int(sizes[best - 1]) if best else 0


def first_members(members: np.ndarray, rank: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """The first members of a set in the order, as many as either kind of key needs; none of a set that can only link with an equal one."""
    n = len(members)
    if n < 4:
        return members[:0]
    return members[np.lexsort((members, rank))[: prefix_length(n, 2, t)]]


def takes_lists(n, light: int, nearest: int, t: tuple[int, int]):
    """Whether a set of n members has its first members as keys: a large one, or one that may have a large partner; nearest is the least size of these."""
    return (n > light) | (n * t[1] >= nearest * t[0])


def set_keys(n: np.ndarray, members: list[np.ndarray], light: int, nearest: int, t: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of sets of n members with these first members: each key's set, the key, and the place in the order of its first member."""
    flat, sizes = np.concatenate([np.empty(0, U64), *members]), np.array([len(x) for x in members], np.int64)
    begin = np.cumsum(sizes) - sizes
    lists = np.flatnonzero(takes_lists(n, light, nearest, t) & (sizes > 0))
    many = sizes[lists] - 1  # the last of them is needed for pairs only
    at = ragged(begin[lists], many)
    own = np.repeat(lists, many)
    parts = [(own, flat[at], at - begin[own])]
    small = np.flatnonzero((n <= light) & (sizes > 1))
    for size in np.unique(sizes[small]).tolist():
        some = small[sizes[small] == size]
        i, j = np.triu_indices(size, 1)
        first = flat[begin[some][:, None] + np.arange(size)]
        parts.append((np.repeat(some, len(i)), mix64(mix64(first[:, i] ^ U64(0xA0761D6478BD642F)) + first[:, j]).reshape(-1), np.tile(i, len(some))))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def largest_partner(n: np.ndarray, place: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """The largest set that a set of n members can link with, if the first member they share is its place-th.

    They share n - place members at most, and t / (1 + t) of both sizes at least.
    """
    return (n - place) * (t[0] + t[1]) // t[0] - n


def _sizes_fit(a: str, b: str, t: tuple[int, int]) -> str:
    return f"{t[1]} * least({a}, {b}) >= {t[0]} * greatest({a}, {b})"


def _fit(n, place, m, other, t):
    """Whether sets of n and m members, whose first shared member is at place and other, can link."""
    return (m <= largest_partner(n, place, t)) & (n <= largest_partner(m, other, t)) & (t[1] * np.minimum(n, m) >= t[0] * np.maximum(n, m))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and the number of each row's run."""
    new = np.append(True, key[1:] != key[:-1])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _values(column: pa.Array) -> np.ndarray:
    """A column of longs, or of bitmaps of LIST_BITS as a row of words each."""
    if not pa.types.is_binary(column.type):
        return column.to_numpy()
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first:][: len(column) * LIST_BITS // 8].view(U64).reshape(len(column), -1)


def _in_runs(emit, most: int | None = None):
    """A function of batches sorted by their first column that hands emit() whole runs of it, as arrays.

    A run of more than `most` rows comes in pieces: emit() gets the first three
    rows of the run before each later piece, and how many rows those are.
    """

    def scan(batches):
        rest, head = None, 0
        for batch in batches:
            cols = [_values(c) for c in batch.columns]
            if not len(cols[0]):
                continue
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on in the next batch
            if last:
                yield from emit(*(c[:last] for c in cols), head=head)
                head = 0
            rest = [c[last:] for c in cols]
            if most is not None and len(rest[0]) > most:
                yield from emit(*rest, head=head, part=True)
                rest, head = [c[:3].copy() for c in rest], 3
        if rest is not None:
            yield from emit(*rest, head=head)

    return scan


def _lists(keyed: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(key, node, size, hub): rows of keys with a partner that can link; size is place << 32 | n.

    hub is the row with the least place that can link, among the first three:
    it has the fewest members that are rarer than the key, so of a group of
    near copies it is the one that the others derive from. Its own hub is its own node.
    A list of more than RUN_ROWS rows is read in pieces, none of whose rows is passed over.
    """

    def emit(key, node, size, head=0, part=False):
        whole = not head and not part
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (size[1:] != size[:-1]))
        new[:head] = True
        key, node, size = key[new], node[new], size[new]
        for _ in range(2):
            first, run = _runs(key)
            n, place = size & 0xFFFFFFFF, size >> 32
            # a row needs another one whose size is within its bounds
            least = np.minimum.reduceat(n, first)
            keep = (np.bincount(run)[run] > 1) & (largest_partner(n, place, t) >= least[run])
            if not whole:
                keep |= key == (key[-1] if part else key[0])
            key, node, size = key[keep], node[keep], size[keep]
            if not len(key):
                return
        first, run = _runs(key)
        n, place = size & 0xFFFFFFFF, size >> 32
        hub = node.copy()
        open_ = np.ones(len(key), bool)
        for k in range(3):
            at = np.minimum(first + k, np.append(first[1:], len(key)) - 1)[run]
            fit = open_ & _fit(n, place, n[at], place[at], t) & (np.arange(len(key)) > at)
            hub[fit] = node[at[fit]]
            open_ &= ~fit
        many = np.bincount(run)[run] > 1
        many[:head] = False
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (key, node, size, hub)], ["key", "node", "size", "hub"])

    rows = keyed.repartition("key").sortWithinPartitions("key", "size", "node")
    return rows.mapInArrow(tidy(_in_runs(emit, RUN_ROWS)), "key long, node long, size long, hub long")


def _heavy(rows: DataFrame) -> list:
    """(filter of keys, parts) for the lists that are split, the least parts first; rows has key, root. A key that a filter takes too much is split alike for all its rows."""
    each = rows.groupBy("key", "root").agg(F.count("*").cast("double").alias("c"))
    pairs = (F.pow(F.sum("c"), F.lit(2)) - F.sum(F.col("c") * F.col("c"))) / 2
    parts = F.greatest(F.sqrt(pairs / PAIRS_A_TASK), F.sum("c") / ROWS_A_TASK)
    heavy = cut(each.groupBy("key").agg(F.when(pairs > 0, parts).alias("k")).where("k > 1"))
    out = []
    for least, parts in zip((1, *PARTS), PARTS, strict=False):
        some = heavy.where(F.col("k") > least)
        if n := some.count():
            out.append((rows.sparkSession.sparkContext.broadcast(_filter_of(some.select(F.col("key").alias("id")), n)), parts))
    discard(heavy)
    return out


def _part(rep: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (mix64(rep.view(U64) ^ U64(0x8EBC6AF09C88C6E3)) % parts.astype(U64)).astype(np.int64)


def _apart(rows: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(a, b): pairs of one key that can link and are in different components; rows, a written table, has key, rep, size, root, bits.

    Bitmaps rule out what sizes and places can't before a pair is a row. In a
    split list a row goes to the cell of its part with each part, and pairs are
    taken where their parts meet: parts << 42 | one part << 21 | other.
    """
    heavy = _heavy(rows)

    def deal(batches):
        for batch in batches:
            key, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = np.ones(len(key), np.int64)
            for bits, k in heavy:
                parts[_in_filter(bits.value, key)] = k
            step = np.cumsum(parts) >> 16
            cuts = [*np.flatnonzero(np.append(True, step[1:] != step[:-1])).tolist(), len(key)] if len(key) else [0]
            for c, e in zip(cuts[:-1], cuts[1:], strict=True):
                at = np.repeat(np.arange(c, e), parts[c:e])
                k, own, other = parts[at], _part(rep[at], parts[at]), ragged(np.zeros(e - c, np.int64), parts[c:e])
                cell = np.where(k > 1, k << 42 | np.minimum(own, other) << 21 | np.maximum(own, other), 0)
                dealt = np.where(k > 1, mix64(key[at].view(U64) ^ mix64(cell.view(U64))).view(np.int64), key[at])
                rest = [x.take(pa.array(at)) for x in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(dealt), *rest, pa.array(cell)], ["key", "rep", "size", "root", "bits", "cell"])

    def pairs(n, place, bits, alone, side, i, j):
        fit = _fit(n[i], place[i], n[j], place[j], t) & (alone[i] | (side[i] != side[j]))
        i, j = i[fit], j[fit]
        for c in range(0, len(i), LIST_STEP):
            u, v = i[c : c + LIST_STEP], j[c : c + LIST_STEP]
            lacks = [np.bitwise_count(x & ~y).sum(1, dtype=np.int64) for x, y in ((bits[u], bits[v]), (bits[v], bits[u]))]
            common = np.minimum(n[u] - lacks[0], n[v] - lacks[1])
            fit = t[1] * common >= t[0] * (n[u] + n[v] - common)
            yield u[fit], v[fit]

    def emit(key, rep, size, root, bits, cell, head=0):
        first, run = _runs(key)
        mixed = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
        keep = mixed[run]
        key, rep, size, root, bits, cell = (x[keep] for x in (key, rep, size, root, bits, cell))
        if not len(key):
            return
        n, place, low = size & 0xFFFFFFFF, size >> 32, (1 << 21) - 1
        alone, side = (cell >> 21 & low) == (cell & low), _part(rep, np.maximum(cell >> 42, 1)) == (cell & low)
        first, run = _runs(key)
        end = np.append(first[1:], len(key))
        # each row with those of later components in its list, some rows at a time; a list is sorted by component
        same = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (root[1:] != root[:-1])))
        later = np.repeat(np.append(same[1:], len(key)), np.diff(np.append(same, len(key))))
        after = end[run] - later
        part = np.cumsum(after) >> 20
        cuts = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist(), len(key)]
        for c, e in zip(cuts[:-1], cuts[1:], strict=True):
            for w in range(0, int(after[c:e].max(initial=0)), 1 << 20):  # a row with a longer list than that: parts of it
                here = np.clip(after[c:e] - w, 0, 1 << 20) if e - c == 1 else after[c:e]
                for i, j in pairs(n, place, bits, alone, side, np.repeat(np.arange(c, e), here), ragged(later[c:e] + w, here)):
                    if len(i):
                        one, other = rep[i], rep[j]
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, other)), pa.array(np.minimum(one, other))], ["a", "b"])
                if e - c > 1:
                    break

    kind = "key long, rep long, size long, root long, bits binary, cell long"
    dealt = rows.select("key", "rep", "size", "root", "bits").mapInArrow(tidy(deal), kind)
    found = cut(dealt.repartition("key").sortWithinPartitions("key", "root").mapInArrow(tidy(_in_runs(emit)), "a long, b long").distinct())
    for bits, _ in heavy:
        bits.destroy()
    return found


def _filter_of(ids: DataFrame, many: int | None = None) -> np.ndarray:
    """A filter that passes every id of a column `id`, and few others as long as it isn't full; many: how many there are at most, where that is known."""
    bits = FILTER_BITS if many is None else min(FILTER_BITS, max(1 << 16, 1 << (many * ID_BITS).bit_length()))
    size = bits // BLOCKS

    def build(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            block, a, b = _filter_places(batch.column(0).to_numpy(), size)
            for k in np.unique(block).tolist():
                one = held.setdefault(k, np.zeros(size, bool))
                one[a[block == k]] = one[b[block == k]] = True
        for k, one in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "data": pa.array([zstandard.compress(np.packbits(one).tobytes(), 1)], pa.binary())})

    return _collected(_summed_blocks(ids.mapInArrow(build, "block int, data binary"), "u1"), bits // 8)


def _filter_places(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = mix64(ids.astype(np.int64).view(U64))
    return (h % U64(BLOCKS)).astype(np.int64), ((h >> U64(8)) % U64(size)).astype(np.int64), ((h >> U64(34)) % U64(size)).astype(np.int64)


def _in_filter(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    size = len(bits) * 8 // BLOCKS
    block, a, b = _filter_places(ids, size)
    base = block * size
    hit = lambda x: (bits[(base + x) >> 3] >> (7 - ((base + x) & 7)).astype(np.uint8)) & 1
    return (hit(a) & hit(b)).astype(bool)


def _bitmap(members: np.ndarray, bins: int) -> np.ndarray:
    """Which of `bins` bins, a power of two from 8 on, the members fall in, a bit each."""
    bits = np.zeros(bins, bool)
    bits[(members & U64(bins - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def digest(members: np.ndarray) -> bytes:
    """The number of members, and which of two to four times as many bins they fall in."""
    return np.int32(len(members)).tobytes() + _bitmap(members, 1 << max(3, (2 * len(members)).bit_length())).tobytes()


def shared_bound(one: bytes, other: bytes) -> tuple[int, int, int]:
    """No fewer members than two sets share, from their digests, and both sizes; the finer digest is folded first.

    Each bin that only one of two sets falls in holds a member that the other one lacks.
    """
    (n,), (m,) = np.frombuffer(one, "<i4", 1), np.frombuffer(other, "<i4", 1)
    x, y = np.frombuffer(one, np.uint8, offset=4), np.frombuffer(other, np.uint8, offset=4)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(int(n) - int(np.bitwise_count(x & ~y).sum()), int(m) - int(np.bitwise_count(y & ~x).sum())), int(n), int(m)


def _met(found: DataFrame, pairs: DataFrame, compare) -> DataFrame:
    """The pairs (a, b) that compare() keeps, as a written table; found has id and data.

    compare() takes batches of (b, chunk, a, data), sorted, b's own data first,
    with a null. Members of a b with many pairs are dealt to many tasks
    (SPREAD), each with a copy of b's data.
    """
    spark = pairs.sparkSession
    ids = spark.sparkContext.broadcast(_filter_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), 2 * pairs.count()))
    hot = []
    degrees = cut(pairs.groupBy("b").agg(F.count("*").alias("k")).where(F.col("k") > SPREAD[0][0]))
    for least, tasks in SPREAD:
        some = degrees.where(F.col("k") > least)
        if k := some.count():
            hot.append((spark.sparkContext.broadcast(_filter_of(some.select(F.col("b").alias("id")), k)), tasks))

    def deal(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            chunk = np.zeros(len(a), np.int32)
            for bits, tasks in hot:
                flagged = _in_filter(bits.value, b)
                chunk[flagged] = (mix64(a[flagged].view(U64)) % U64(tasks)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk)], ["a", "b", "chunk"])

    texts = dict(found.dtypes)["data"] == "string"

    def wanted(batches):
        some = (batch.filter(pa.array(_in_filter(ids.value, batch.column(0).to_numpy()))) for batch in batches)
        yield from _compressed(some) if texts else some

    found = found.mapInArrow(tidy(wanted), "id long, data binary")
    dealt = pairs.select("a", "b").mapInArrow(deal, "a long, b long, chunk int") if hot else pairs.select("a", "b", F.lit(0).alias("chunk"))
    hubs = dealt.select(F.lit(None).cast("long").alias("a"), "b", "chunk").distinct()
    rows = dealt.withColumn("id", F.col("a")).unionByName(hubs.withColumn("id", F.col("b"))).join(found, "id").select("b", "chunk", "a", "data")
    met = rows.repartition("b", "chunk").sortWithinPartitions("b", "chunk", F.col("a").asc_nulls_first())
    out = cut(met.mapInArrow(tidy(compare), "a long, b long"))
    for x in (ids, *(bits for bits, _ in hot)):
        x.destroy()
    discard(degrees)
    return out


def _compressed(batches):
    compressor = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for run in slices(batch):
            yield pa.RecordBatch.from_arrays([run.column(0), pa.array([compressor.compress(x.as_buffer()) for x in run.column(1)], pa.binary())], ["id", "data"])


def possible(digests: DataFrame, pairs: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs of doc_ids that their sets' digests (id, data) don't rule out."""

    def compare(batches):
        at, hubs = None, set()
        for batch in batches:
            out = []
            for b, chunk, a, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a is None:
                    if at != (b, chunk):
                        at, hubs = (b, chunk), set()
                    hubs.add(data)  # more than one if b stands for different texts
                elif at == (b, chunk):
                    for common, n, m in (shared_bound(data, hub) for hub in hubs):
                        if t[1] * common >= t[0] * (n + m - common):
                            out.append((a, b))
                            break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return _met(digests, pairs, compare)


def verified(docs: DataFrame, pairs: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs of doc_ids whose sets have similarity t or more. Texts travel compressed and become sets where they meet: a task holds one set and some texts."""

    def compare(batches):
        at, hubs, decompressor = None, {}, zstandard.ZstdDecompressor()
        for batch in batches:
            marks = list(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True))
            done = 0
            while done < len(marks):
                some, size = [], 0
                for x in batch.column(3).slice(done):  # texts of about STEP_BYTES at a time
                    some.append(decompressor.decompress(x.as_buffer()))
                    size += len(some[-1])
                    if size > STEP_BYTES:
                        break
                hashes, bounds = shingle_sets(pa.array(some, pa.binary()).cast(pa.string()) if size < 1 << 30 else pa.array(some, pa.large_binary()).cast(pa.large_string()))
                out = []
                for (b, chunk, a), i, j in zip(marks[done : done + len(some)], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = hashes[i:j]
                    if a is None:
                        if at != (b, chunk):
                            at, hubs = (b, chunk), {}
                        if len(own):
                            hubs[own.tobytes()] = own.copy()
                    elif at == (b, chunk):
                        for hub in hubs.values():
                            common = int((hub[np.minimum(np.searchsorted(hub, own), len(hub) - 1)] == own).sum())
                            if t[1] * common >= t[0] * (len(own) + len(hub) - common):
                                out.append((a, b))
                                break
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                done += len(some)

    return _met(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("data")), pairs, compare)


def jaccard_components(docs: DataFrame, t: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the least doc_id that links of similarity t[0] / t[1] or more reach."""
    spark = docs.sparkSession
    docs = doc_frame(docs, id_col, text_col)

    names = ["doc_id", "n", "node", "block", "data", "bits"]

    def measure(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for run in slices(batch, 1, STEP_BYTES):
                hashes, bounds = shingle_sets(run.column(1))
                counts += np.bincount(_counter(hashes), minlength=COUNTERS).astype(np.uint32)
                n = len(bounds) - 1
                sets = [hashes[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                bits = pa.array([_bitmap(x, LIST_BITS).tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([run.column(0), pa.array(np.diff(bounds)), pa.array(signatures(hashes, bounds).view(np.int64)), pa.nulls(n, pa.int32()), pa.array([digest(x) for x in sets], pa.binary()), bits], names)
        for k, block in enumerate(counts.reshape(BLOCKS, -1)):
            if block.any():
                data = zstandard.compress(block.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 3 + [pa.array([k], pa.int32()), pa.array([data], pa.binary()), pa.nulls(1, pa.binary())], names)

    measured = cut(docs.mapInArrow(tidy(measure), "doc_id long, n long, node long, block int, data binary, bits binary"))
    each = measured.where("block IS NULL").select("doc_id", "n", "node")
    digests = measured.where("block IS NULL AND doc_id IS NOT NULL AND n > 0").select(F.col("doc_id").alias("id"), "data")

    def linked(pairs):
        some = possible(digests, pairs, t)
        out = verified(docs, some, t)
        discard(pairs, some)
        return out

    sent = spark.sparkContext.broadcast(_collected(_summed_blocks(measured.where("block IS NOT NULL").select("block", "data"), "u4"), COUNTERS))

    def first(batches):
        seen: set[int] = set()  # equal sets of a task's documents are there once
        for batch in batches:
            for run in slices(batch, 1, STEP_BYTES):
                hashes, bounds = shingle_sets(run.column(1))
                nodes = signatures(hashes, bounds).view(np.int64)
                rank = sent.value[_counter(hashes)]
                out, which = [], []
                for i, node in enumerate(nodes.tolist()):
                    if node in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    a, b = bounds[i], bounds[i + 1]
                    one = first_members(hashes[a:b], rank[a:b], t)
                    if len(one):
                        out.append(one.tobytes())
                        which.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[which]), pa.array(np.diff(bounds)[which]), pa.array(out, pa.binary())], ["node", "n", "members"])

    firsts = cut(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(tidy(first), "node long, n long, members binary"))
    sent.destroy()
    histogram, lists = _measured_lists(firsts, t)
    light = boundary(histogram, lists, t)
    nearest = min((s for s in histogram if s > light), default=1 << 40)
    _LOG.info("sets of up to %d shingles give pairs of members as keys: %d of %d sets", light, sum(k for s, k in histogram.items() if s <= light), sum(histogram.values()))

    def keys(batches):
        for batch in batches:
            n = batch.column(1).to_numpy()
            own, key, place = set_keys(n, [np.frombuffer(x.as_buffer(), U64) for x in batch.column(2)], light, nearest, t)
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(batch.column(0).to_numpy()[own]), pa.array((place << 32) + n[own])], ["key", "node", "size"])

    listed = cut(_lists(firsts.mapInArrow(keys, "key long, node long, size long"), t))
    discard(firsts)
    # by (node, n): sets of different sizes never count as one
    sets = measured.where("block IS NULL AND doc_id IS NOT NULL AND n > 0")
    classes = cut(sets.groupBy("node", "n").agg(F.min("doc_id").alias("rep"), F.min("bits").alias("bits")))
    n = F.col("size").bitwiseAND(F.lit(0xFFFFFFFF)).alias("n")
    met = listed.where("node <> hub").groupBy("node", n, "hub").agg(F.count("*").alias("k"))
    best = met.groupBy("node", "n").agg(F.max(F.struct("k", "hub"))["hub"].alias("hub"))
    hubs = classes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("rep").alias("b"))
    pairs = cut(best.join(classes, ["node", "n"]).select(F.col("rep").alias("a"), "hub", "n").join(hubs, "hub").where(_sizes_fit("n", "hub_n", t)).select("a", "b"))
    links = linked(pairs)
    roots = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = classes.join(roots.withColumnRenamed("u", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    spread = cut(listed.select("key", "node", "size", n).join(placed, ["node", "n"]).select("key", "rep", "size", "root", "bits"))
    discard(listed)
    pairs = _apart(spread, t)
    discard(spread)
    both = links.unionByName(linked(pairs))
    # rows of one doc_id with different texts are tied by it
    copies = each.where("n > 0 AND doc_id IS NOT NULL").join(classes, ["node", "n"]).where("rep <> doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    tied = each.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("u"))
    links_ = both.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(copies.join(tied, "u", "left_semi"))
    roots = connected_components(links_)
    final = classes.join(roots.withColumnRenamed("u", "rep"), "rep", "left").select("node", "n", F.coalesce("root", "rep").alias("root"))
    out = each.join(final, ["node", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def _measured_lists(firsts: DataFrame, t: tuple[int, int]) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """How many sets there are of each size, and for boundary() their first members in one of SLICE hash ranges, and how many of these are another set's too.

    Sizes from LARGE on count together: the boundary is below.
    """

    def sliced(batches):
        for batch in batches:
            n = batch.column(1).to_numpy()
            own, key, _ = set_keys(n, [np.frombuffer(x.as_buffer(), U64) for x in batch.column(2)], 0, 0, t)
            some = mix64(key) % U64(SLICE) == 0
            yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(np.minimum(n[own[some]], LARGE))], ["key", "s"])

    each = firsts.mapInArrow(sliced, "key long, s long").groupBy("key", "s").agg(F.count("*").alias("k"))
    shared = F.when(F.sum("k").over(Window.partitionBy("key")) > 1, F.col("k")).otherwise(0)
    lists = each.withColumn("shared", shared).groupBy("s").agg(F.sum("k").alias("k"), F.sum("shared").alias("shared"))
    sizes = firsts.groupBy(F.least("n", F.lit(LARGE)).alias("s")).agg(F.count("*").alias("k"))
    return {r["s"]: r["k"] for r in sizes.collect()}, {r["s"]: (r["k"], r["shared"]) for r in lists.collect()}  # LARGE rows at most
