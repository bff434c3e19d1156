"""Best-fit packing of documents into sequences of bounded length, by bin completion.

How full sequences can be is a matter of how many pieces there are of each
length, not of which pieces these are. So the cluster counts lengths (at most
`capacity` numbers, whatever the corpus), the driver solves bin packing over
those counts, and the cluster gives pieces their places by rank within their
length. No tokens are shuffled.

The solver takes the largest length left, enumerates the undominated fillings
around it, the least waste first, and commits a filling as often as the counts
last, then half as often, and so on down to once. A filling's waste is charged
against the waste that a better solution than the incumbent may have in all;
branches beyond it are cut, as are counts met before. The first incumbent is
best-fit decreasing. Nothing that could be better is left out, so the search
ends with the fewest bins, unless its budget of nodes ends first.

Nulls: a null text is empty, so its piece is the end id alone. Repeated rows
are packed each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xylem.llm.bpe import REMEMBERED, encoder
from xylem.llm.common import cut, doc_frame, slices, tidy

#: Text encoded at a time.
STEP_BYTES = 1 << 20

Pattern = tuple[tuple[int, int], ...]  # (length, times), descending


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts of lengths: equal bins are handled together."""
    bins: dict[int, Counter] = defaultdict(Counter)  # room left -> fillings
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                each = capacity // length
                if left >= each:
                    bins[capacity - each * length][((length, each),)] += left // each
                if left % each:
                    bins[capacity - left % each * length][((length, left % each),)] += 1
                break
            filling, n = bins[room].popitem()
            fits = room // length
            used = min(n, -(-left // fits))
            if n > used:
                bins[room][filling] += n - used
            full, rest = divmod(left, fits)
            full = min(full, used)
            if full:
                bins[room - fits * length][*filling, (length, fits)] += full
            if used > full:
                bins[room - rest * length][*filling, (length, rest)] += 1
            left -= full * fits + (rest if used > full else 0)
            if not bins[room]:
                del bins[room]
    return [x for some in bins.values() for x in some.items()]


def fewest_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound of the bins: the total, and lengths beyond half a bin, which never meet (Martello and Toth's L2)."""
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    upto, sums = np.cumsum(n).tolist(), np.cumsum(n * np.arange(capacity + 1)).tolist()
    half, bounds = capacity // 2, [-(-sums[-1] // capacity)]
    for k in range(1, half + 1):
        wide = upto[capacity - k] - upto[half]
        room = capacity * wide - (sums[capacity - k] - sums[half])
        bounds.append(upto[-1] - upto[half] + max(0, -(-(sums[half] - sums[k - 1] - room) // capacity)))
    return max(bounds)


class Completion:
    """A search over counts of lengths. `left` are the counts not yet committed, `steps` what enumeration may still visit."""

    def __init__(self, counts: dict[int, int], capacity: int, steps: int):
        self.capacity, self.steps = capacity, steps
        self.lengths = sorted(counts, reverse=True)
        self.negative = [-x for x in self.lengths]
        self.left = dict(counts)

    def sums(self, top: int) -> list[int]:
        """For each place in lengths from top on, the sums, as bits, that can be made of what is left from there on."""
        out, bits, mask = [0] * len(self.lengths), 1, (1 << self.capacity + 1) - 1
        for i in range(len(self.lengths) - 1, top - 1, -1):
            x = self.lengths[i]
            n, k = min(self.left[x], self.capacity // x), 1
            while n > 0:
                k = min(k, n)
                bits |= bits << x * k
                n, k = n - k, 2 * k
            bits &= mask
            out[i] = bits
        return out

    def fillings(self, top: int, sums: list[int], most: int) -> Iterator[tuple[int, list[int]]]:
        """(waste, members) of each undominated filling around the length at top with at most this waste, the least waste first.

        A filling is dominated if a length that is left fits beside it, could
        stand for a shorter member, or is the sum of two or more members.
        Among fillings of equal waste those of fewest members, then the most
        even, come first: the shortest lengths are what the last bins need.
        sums may be those of an earlier state with more left.
        """
        left, lengths = self.left, self.lengths
        first = lengths[top]
        least = next(x for x in reversed(lengths) if left[x])
        chosen, taken, room = [first], Counter([first]), self.capacity - first

        def free(x: int) -> bool:
            return left.get(x, 0) > taken[x]

        if room == 0 or free(room):  # one length that fills the room dominates all else
            yield 0, [first, room] if room else [first]
            return
        if left[least] > self.capacity // least:
            most = min(most, least - 1)
        for waste in range(min(room, most) + 1):
            if not sums[top] >> room - waste & 1:
                continue
            for members in range(-(-(room - waste) // first), (room - waste) // least + 1):
                need, k, at, tries = room - waste, members, top, []
                while True:
                    self.steps -= 1
                    if self.steps <= 0:
                        return
                    if k == 0:
                        if not waste or not any(map(free, range(1, waste + 1))) and not any(free(y) for x in set(chosen) for y in range(x + 1, x + waste + 1)):
                            yield waste, list(chosen)
                        i = -1
                    elif k > 1 and free(need):
                        i = -1
                    else:  # the shortest length that can be the longest of k
                        i = bisect_right(self.negative, -(-(-need // k))) - 1
                    while True:
                        while i >= at:
                            x = lengths[i]
                            if x > need - (k - 1) * least:
                                i = -1
                            elif left[x] > taken[x] and (sums[i] >> need - x & 1 if k > 1 else x == need) and not free(x + chosen[-1]):
                                break
                            else:
                                i -= 1
                        if i >= at or not tries:
                            break
                        at, i = tries.pop()
                        x = chosen.pop()
                        taken[x] -= 1
                        need, k, i = need + x, k + 1, i - 1
                    if i < at:
                        break
                    tries.append((at, i))
                    chosen.append(x)
                    taken[x] += 1
                    need, k, at = need - x, k - 1, i


@dataclass
class Node:
    """The counts at one point of a search, and the filling that is committed there."""

    options: Iterator[tuple[int, list[int]]]
    top: int
    sums: list[int]
    gone: int  # lengths used up since sums were made
    waste: int
    bins: int
    state: int
    spoil: int = 0
    pattern: Pattern = ()
    tries: int = 0  # times to try next
    times: int = 0


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = 100_000) -> list[tuple[Pattern, int]]:
    """Fillings and how often each is used, for all the counts, in as few bins as the search finds.

    It stops at a proof (a lower bound is met, or nothing is left to try), or
    with the best incumbent after `nodes` nodes or 100 times as many steps of enumeration.
    """
    counts = {k: n for k, n in counts.items() if n > 0}
    total = sum(k * n for k, n in counts.items())
    best = best_fit_decreasing(counts, capacity)
    best_bins, least = sum(n for _, n in best), fewest_bins(counts, capacity)
    if best_bins <= least:
        return best
    search = Completion(counts, capacity, 100 * nodes)
    left, lengths = search.left, search.lengths
    draw = Random(0)
    code = {x: draw.getrandbits(100) for x in lengths}
    state = sum(code[x] * n for x, n in left.items())  # tells counts apart
    met: dict[int, int] = {}  # state -> the fewest bins it was met with
    stack: list[Node] = []
    top = gone = waste = bins = 0
    sums, fresh = search.sums(0), True
    while nodes > 0 and search.steps > 0:
        if fresh:
            while top < len(lengths) and not left[lengths[top]]:
                top += 1
            if top == len(lengths):  # a whole solution
                if bins < best_bins:
                    best, best_bins = [(x.pattern, x.times) for x in stack], bins
                if best_bins <= least:
                    break
            elif met.get(state, best_bins) > bins:
                met[state] = bins
                if gone > 30:
                    sums, gone = search.sums(top), 0
                stack.append(Node(search.fillings(top, sums, (best_bins - 1) * capacity - total - waste), top, sums, gone, waste, bins, state))
        if not stack:
            break
        # take the next option of the deepest node
        fresh, node = False, stack[-1]
        for x, m in node.pattern:
            left[x] += m * node.times
        node.times = 0
        if not node.tries:
            found = next(node.options, None)
            if found is None:
                stack.pop()
                continue
            node.spoil, node.pattern = found[0], tuple(Counter(found[1]).items())
            node.tries = min(left[x] // m for x, m in node.pattern)
        times, allowed = node.tries, (best_bins - 1) * capacity - total - node.waste
        node.tries //= 2
        if node.spoil * times > allowed:
            continue
        nodes -= 1
        node.times = times
        top, sums, gone, waste, bins, state = node.top, node.sums, node.gone, node.waste + node.spoil * times, node.bins + times, node.state
        for x, m in node.pattern:
            left[x] -= m * times
            gone += not left[x]
            state -= code[x] * m * times
        fresh = True
    return best


def segments(solution: list[tuple[Pattern, int]]) -> np.ndarray:
    """Where the pieces of each length go: rows (length, first rank, times in a bin, first bin, offset), by length and rank."""
    rows, given, bin_ = [], Counter(), 0
    for pattern, times in solution:
        at = 0
        for length, m in pattern:
            rows.append((length, given[length], m, bin_, at))
            given[length] += m * times
            at += m * length
        bin_ += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, nodes: int = 100_000, remembered: int = REMEMBERED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their sequence and their place in it.

    A document longer than capacity is cut into pieces of capacity tokens, of
    which the first takes the remainder. Sequences are gapless from offset 0.
    remembered bounds the words that a worker keeps encoded.
    """

    def cut_up(batches):
        coder, part = encoder(tokenizer, end_id, remembered), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for run in slices(batch, 1, STEP_BYTES):
                ids, bounds = coder.encode(run.column(1))
                sizes = np.diff(bounds)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = sizes - (n - 1) * capacity
                length = np.where(piece == 0, head[doc], capacity)
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                data, at = memoryview(ids.astype("<u4").tobytes()), (bounds[:-1][doc] + start) * 4
                crc = [zlib.crc32(data[a : a + 4 * m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                runs = np.flatnonzero(np.diff(length[order], prepend=-1))
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) - np.repeat(runs, np.diff(np.append(runs, len(doc)))) + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [run.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    pieces = cut(doc_frame(docs, id_col, text_col).mapInArrow(tidy(cut_up), PIECES))
    counts = cut(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = segments(complete_bins(by_length, capacity, nodes))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    sent = docs.sparkSession.sparkContext.broadcast(places)  # capacity fillings and their members at most

    def place(batches):
        table = sent.value
        span = int(table[:, 1].max(initial=0)) + 1
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            row = table[np.searchsorted(keys, length * span + np.minimum(rank, span - 1), "right") - 1]
            which, slot = np.divmod(rank - row[:, 1], row[:, 2])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("piece"), batch.column("start"), pa.array(length), batch.column("ids_crc32"), pa.array(row[:, 3] + which), pa.array(row[:, 4] + slot * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(before, ["length", "part"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "before").mapInArrow(place, PLACED)
