"""Removal of long strings that earlier documents have, by a Burrows-Wheeler transform with bounded interval expansion.

A byte goes if it lies in a string of LENGTH bytes that also starts in a
document with a smaller doc_id. Four steps, none of which gathers the corpus:

1. Anchors. Each window of LENGTH bytes has an anchor, the K-gram in it with
   the least hash, so equal windows have equal anchors at equal places. Each
   task sends its anchors' fingerprints, mixed hashes, sorted and packed, to their ranges;
   a range finds those that two documents or more have, and sets bits for
   them in a filter of fixed size (FILTER_BITS). Where a corpus fills the
   filter, more is sent in step 2; results don't depend on it.
2. Stretches. Windows in a row with one anchor are a stretch. Each task keeps
   those that pass the filter. Of equal stretches it sends the first
   document's alone; in the others, which the task has just seen repeat, the
   windows go at once. (Stretches are grouped by hash and compared by bytes.) So what is sent for a passage that a third of all
   documents share is one stretch a task.
3. Ranges. For the stretches of an anchor, equal ones are again one, the
   least document's; different ones that agree beyond the anchor, far enough
   on one side for a shared window, get a suffix array, to LENGTH symbols, and its Burrows-Wheeler transform's order. Breadth-first
   backward extension marks where common prefixes of 0, 1, 2 ... symbols end
   and stops below LENGTH: what is unmarked then lies in intervals of equal
   windows. In each interval all but the least document's windows go.
4. Texts. The windows that go meet their document's text, sorted, in one
   pass. Texts without any aren't shuffled.

Nulls: a null text is empty; a row with a null doc_id loses nothing and is no
one's earlier document. doc_id names a document: rows that repeat it with the
same text get the same result, and don't count as earlier for each other. A
text under LENGTH bytes stays. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.llm.common import U64, cut, free_shuffles, mix64, powers, prefix_hash, ragged, slices, span_hash, text_bytes, tidy
from xylem.llm.ngram_join import _filter_of, _in_filter

LENGTH = 50
K = 20
PRINT_BITS = 40
#: Ranges of fingerprints, 2**9 to 2**16 of them: as many as input partitions at least in step 1; in steps 2 and 3 as many as keep a range's stretches at about RANGE_BYTES.
RANGE_BITS = (9, 16)
RANGE_BYTES = 8 << 20
#: Steps 2 and 3 take the ranges in so many passes at most, where stretches, which overlap, are more than the text; what a pass has sent is deleted before the next one.
PASSES = 4
#: The filter's size, 64 MB: a slice of it for each range.
SLOT_BITS = 29
#: Fingerprints, and bytes of stretches, that a task holds before it sends them.
PRINTS_HELD, BYTES_HELD = 2_000_000, 16 << 20
#: Spans that a task holds before it sends them.
SPANS_HELD = 1_000_000
#: Text worked on at a time: its arrays, some 60 bytes a byte, stay in the cache and are little beside what a task holds.
STEP_BYTES = 1 << 18
#: Bytes in one suffix array; an anchor with more is one array.
ARRAY_BYTES = 1 << 20


def pack(*columns: np.ndarray) -> bytes:
    """Integer arrays as one blob: their bytes by significance, then zstandard."""
    parts = [np.int64(len(columns)).tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c)
        parts.append(np.array([len(c), c.dtype.itemsize], np.int64).tobytes())
        parts.append(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    return zstandard.compress(b"".join(parts), 1)


def unpack(blob, *dtypes: str) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    out, at = [], 8
    for dtype in dtypes:
        n, width = np.frombuffer(data, np.int64, 2, at).tolist()
        at += 16
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += n * width
    return out


def stretches(flat: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first window's start, last window's start, fingerprint, anchor; and the prefix hash."""
    n = len(flat)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, np.empty(0, U64), none, None
    k = min(K, length)
    prefix = prefix_hash(flat)
    h = mix64((prefix[k:] - prefix[:-k]) * powers(n + 1)[1][: n - k + 1])
    low = (h >> U64(28) << U64(28)) | np.arange(len(h), dtype=U64)
    width, have = length - k + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if width > have:
        low = np.minimum(low[: have - width], low[width - have :])
    whole = np.ones(len(low) + 1, bool)
    whole[-1] = False
    for a, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        whole[max(a, e - length + 1) : e] = False
    # low holds the anchor's place, so it changes with the anchor
    new = np.append(True, low[1:] != low[:-1])
    start = np.flatnonzero(whole[:-1] & (new | ~np.append(False, whole[:-2])))
    last = np.flatnonzero(whole[:-1] & (np.append(new[1:], True) | ~whole[1:]))
    row = np.searchsorted(offsets, start, "right") - 1
    anchor = (low[start] & U64((1 << 28) - 1)).astype(np.int64)
    # an anchor's hash is a least one: mixed again, fingerprints fill ranges and filter evenly
    return row, start, last, mix64(h[anchor] ^ U64(0x5851F42D4C957F2D)) >> U64(64 - PRINT_BITS), anchor, prefix


def string_hashes(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of strings that stand end to end, of their anchors with half of the rest of a window to the right, and to the left (0: too short).

    A window that two strings share reaches half of its rest or more beyond
    the anchor on one side: without a partner on either, a string shares none.
    """
    out, right, left = (np.zeros(len(sizes), U64) for _ in range(3))
    k = min(K, length)
    half = (length - k + 1) // 2
    part = begin // STEP_BYTES
    cuts = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist(), len(sizes)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        base = begin[i]
        prefix = prefix_hash(flat[base : begin[j - 1] + sizes[j - 1]])
        own, n, at = begin[i:j] - base, sizes[i:j], place[i:j].astype(np.int64)
        out[i:j] = span_hash(prefix, own, own + n)
        fits = np.flatnonzero(at + k + half <= n)
        right[i + fits] = span_hash(prefix, (own + at)[fits], (own + at)[fits] + k + half)
        fits = np.flatnonzero(at >= half)
        left[i + fits] = span_hash(prefix, (own + at)[fits] - half, (own + at)[fits] + k)
    return out, right, left


def _has_partner(h: np.ndarray) -> np.ndarray:
    """Whether a hash other than 0 is there more than once."""
    _, number, n = np.unique(h, return_inverse=True, return_counts=True)
    return (n[number] > 1) & (h != 0)


def equal_windows(text: np.ndarray, length: int) -> np.ndarray:
    """For each place of a text (symbols from 1; 0 ends a string), the number of its class: places with the next `length` symbols equal."""
    n = len(text)
    sa, rank = _sorted_to(text, length)
    prev, here = sa[:-1], sa[1:]
    # common prefixes of 0 symbols end where first symbols differ; no prefix runs over the end of a string
    marked = np.zeros(n, bool)
    marked[0] = True
    marked[1:] = (text[prev] != text[here]) | (text[here] == 0)
    open_ = np.flatnonzero(~marked)
    one, other = (rank[sa[k] + 1].astype(np.int32) for k in (open_ - 1, open_))
    lo, hi = np.minimum(one, other), np.maximum(one, other)
    for _ in range(length - 1):
        seen = np.cumsum(marked, dtype=np.int32)
        # extended by the symbol before, two rows part where the rows they come from part
        part = seen[hi] != seen[lo]
        if not part.any():
            break
        marked[open_[part]] = True
        open_, lo, hi = open_[~part], lo[~part], hi[~part]
    out = np.empty(n, np.int64)
    out[sa] = np.cumsum(marked)
    return out


def _sorted_to(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `length` symbols, ties by place, and each suffix's row; by doubling from eight symbols."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, text.dtype)])
    key = np.zeros(n, U64)
    depth = min(8, length)
    for k in range(depth):
        key = (key << U64(8)) | padded[k : k + n].astype(U64)
    while True:
        sa = np.argsort(key, kind="stable")
        if depth >= length:
            break
        ordered = key[sa]
        rank = np.empty(n + length, np.int64)
        rank[sa] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1]))
        rank[n:] = 0
        step = min(depth, length - depth)
        key = (rank[:n].astype(U64) << U64(32)) | rank[step : step + n].astype(U64)
        depth += step
    rows = np.empty(n, np.int64)
    rows[sa] = np.arange(n)
    return sa, rows


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch | None:
    """One row for each document: the union of its spans, as pairs of int64."""
    if not len(doc):
        return None
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    first = np.append(True, doc[1:] != doc[:-1])
    base = (np.cumsum(first) - 1) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(base + end)
    new = np.append(True, base[1:] + start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    spans = np.column_stack([start[at], (reach - base)[np.append(at[1:], len(doc)) - 1]])
    own = np.flatnonzero(np.append(True, doc[at][1:] != doc[at][:-1]))
    bounds = np.append(own, len(at)) * 16
    data = spans.tobytes()
    runs = [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(doc[at][own]), pa.array(runs, pa.binary())], ["doc_id", "runs"])


def _firsts(doc: np.ndarray, strings: np.ndarray, flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their strings; the number of each one's string; whether it is of the string's least document.

    strings are hashes; their bytes are compared, and decide where they differ.
    """
    order = np.argsort(strings, kind="stable")
    new = np.append(True, strings[order][1:] != strings[order][:-1])
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    if not _same_bytes(flat, begin, sizes, lead):
        known: dict[bytes, int] = {}
        exact = np.array([known.setdefault(flat[b : b + n].tobytes(), k) for k, (b, n) in enumerate(zip(begin.tolist(), sizes.tolist(), strict=True))])
        order = np.argsort(exact, kind="stable")
        new = np.append(True, exact[order][1:] != exact[order][:-1])
    number, d = np.cumsum(new) - 1, doc[order]
    return order, number, d == np.minimum.reduceat(d, np.flatnonzero(new))[number]


def _same_bytes(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, lead: np.ndarray) -> bool:
    """Whether each string has the bytes of its leading row's."""
    rest = np.flatnonzero(lead != np.arange(len(lead)))
    if (sizes[rest] != sizes[lead[rest]]).any():
        return False
    part = np.cumsum(sizes[rest]) // STEP_BYTES
    cuts = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist(), len(rest)] if len(rest) else []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        some = rest[i:j]
        if not np.array_equal(flat[ragged(begin[some], sizes[some])], flat[ragged(begin[lead[some]], sizes[some])]):
            return False
    return True


class _Spans:
    """Spans that go, sent as one row for each document when there are many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, doc, start, end):
        if len(doc):
            self.parts.append((doc, start, end))
            self.held += len(doc)

    def take(self, least: int = 0):
        if self.held <= least:
            return None
        out = merged(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.held = [], 0
        return out


def _compare(arrays: list[tuple], length: int, spans: _Spans) -> None:
    """Find equal windows among different stretches: (document, start, size, bytes) of strings and of their rows."""
    if not arrays:
        return
    least, sizes, flat, string, doc, start = (list(x) for x in zip(*arrays, strict=True))
    shift = np.cumsum([0, *(len(x) for x in least[:-1])])
    string = np.concatenate([s + k for s, k in zip(string, shift, strict=True)])
    least, sizes, flat, doc, start = (np.concatenate(x) for x in (least, sizes, flat, doc, start))
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()) + 1, np.uint8)
    text[ragged(begin, sizes)] = flat + 1  # UTF-8 has no byte 255
    kind = equal_windows(text, length)
    windows = sizes - length + 1
    at = ragged(begin, windows)
    own = np.repeat(np.arange(len(sizes)), windows)
    low = np.full(int(kind.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, kind[at], least[own])
    goes = low[kind[at]] < least[own]
    hit, owner = at[goes], own[goes]
    if not len(hit):
        return
    first = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[1:] != owner[:-1])))
    a, b, owner = hit[first], hit[np.append(first[1:], len(hit)) - 1], owner[first]
    a, b = a - begin[owner], b - begin[owner] + length
    # each row of a string loses the same windows
    order = np.argsort(string, kind="stable")
    left, right = np.searchsorted(string[order], owner), np.searchsorted(string[order], owner, "right")
    rows = order[ragged(left, right - left)]
    a, b = np.repeat(a, right - left), np.repeat(b, right - left)
    spans.add(doc[rows], start[rows] + a, start[rows] + b)


class Filter:
    """Bits for fingerprints, as packed slices of equal size, one for each range that has any; tasks unpack them.

    The driver only passes the slices on: it never holds the whole filter,
    which is nearly empty unless the corpus is large. What a worker unpacks goes with the broadcast.
    """

    def __init__(self, packed: dict[int, bytes], ranges: int):
        self.packed, self.ranges = packed, ranges
        self.bits: np.ndarray | None = None

    def has(self, fp: np.ndarray) -> np.ndarray:
        if self.bits is None:
            bits = np.zeros((self.ranges, (1 << SLOT_BITS - 3) // self.ranges), np.uint8)
            while self.packed:
                r, data = self.packed.popitem()
                bits[r] = np.frombuffer(zstandard.decompress(data), np.uint8)
            self.bits = bits.reshape(-1)
        slot = (fp >> U64(PRINT_BITS - SLOT_BITS)).astype(np.int64)
        return (self.bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, runs): spans of bytes that go, in any number of rows a document; docs has doc_id and text."""
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL")
    range_bits = min(max(RANGE_BITS[0], (docs.rdd.getNumPartitions() - 1).bit_length()), RANGE_BITS[1])
    below = U64(PRINT_BITS - range_bits)

    def prints(batches):
        kept: list[np.ndarray] = []

        def send():
            values = np.concatenate(kept)
            kept.clear()
            values, n = np.unique(values, return_counts=True)
            # each value is in once for each document, or twice if a part has found two
            cuts = np.searchsorted(values, np.arange((1 << range_bits) + 1, dtype=U64) << below)
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                v, m = values[cuts[r] : cuts[r + 1]], n[cuts[r] : cuts[r + 1]] > 1
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([pack(np.diff(v, prepend=U64(0)), np.packbits(m))], pa.binary())], ["range", "blob"])

        for batch in batches:
            for run in slices(batch, 1, STEP_BYTES):
                flat, offsets = text_bytes(run.column(1))
                row, _, _, fp, _, _ = stretches(flat, offsets, length)
                ids = run.column(0).to_numpy()
                document = np.unique(ids, return_inverse=True)[1]
                pair = np.unique((fp << U64(64 - PRINT_BITS)) | document[row].astype(U64)) >> U64(64 - PRINT_BITS)
                value, n = np.unique(pair, return_counts=True)
                kept.append(np.repeat(value, np.minimum(n, 2)))
                if sum(map(len, kept)) > PRINTS_HELD:
                    yield from send()
        if kept:
            yield from send()

    def shared(batches):
        at, parts = None, []

        def close():
            one = np.sort(np.concatenate(parts))
            value = np.unique(one[1:][one[1:] == one[:-1]])
            bits = np.zeros(1 << (SLOT_BITS - range_bits), bool)
            slot = lambda x: ((x >> U64(PRINT_BITS - SLOT_BITS)) & U64(len(bits) - 1)).astype(np.int64)
            bits[slot(value)] = True
            passing = sum(int(bits[slot(x)].sum()) for x in parts[::2])
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zstandard.compress(np.packbits(bits).tobytes(), 1)], pa.binary()), pa.array([sum(map(len, parts[::2]))], pa.int64()), pa.array([passing], pa.int64())], ["range", "bits", "anchors", "passing"])

        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != at and parts:
                    yield close()
                    parts = []
                at = r
                steps, twice = unpack(blob.as_buffer(), "u8", "u1")
                value = np.cumsum(steps)
                parts += [value, value[np.unpackbits(twice, count=len(value)).astype(bool)]]
        if parts:
            yield close()

    ranges = docs.mapInArrow(tidy(prints), "range int, blob binary").repartition("range").sortWithinPartitions("range")
    found: dict[int, bytes] = {}
    anchors = passing = 0
    for r in ranges.mapInArrow(tidy(shared), "range int, bits binary, anchors long, passing long").toLocalIterator():  # packed slices of a filter of fixed size
        found[r["range"]] = bytes(r["bits"])
        anchors, passing = anchors + r["anchors"], passing + r["passing"]
    del ranges
    sent = spark.sparkContext.broadcast(Filter(found, 1 << range_bits))
    del found
    range_bits, passes = plan_of(anchors, passing, length)
    out = None
    for p in range(passes):
        one = _pass(docs, length, sent, range_bits, p << range_bits, passes)
        out = one if out is None else out.unionByName(one)
        free_shuffles(spark)
    sent.destroy()
    return out


def plan_of(anchors: int, passing: int, length: int) -> tuple[int, int]:
    """Bits of ranges, and passes, for anchors that tasks have seen, and those of them that pass the filter."""
    width = length - min(K, length) + 1
    size = passing * (length + width // 2)
    bits = min(max(RANGE_BITS[0], (size // RANGE_BYTES).bit_length()), RANGE_BITS[1])
    # a new anchor comes each width / 2 bytes
    return bits, min(max(1, round(size / max(1, anchors * (width // 2 + 1)))), PASSES)


def _pass(docs: DataFrame, length: int, sent, range_bits: int, first: int, passes: int) -> DataFrame:
    """Steps 2 and 3 for the ranges from first / passes on, one of `passes` parts of all; sent: the filter."""
    low, high = first // passes, (first + (1 << range_bits)) // passes
    below = U64(PRINT_BITS - range_bits)

    def collect(batches):
        held, size, spans = [], 0, _Spans()

        def send():
            doc, start, windows, fp, place, string, flat = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()  # not beside what is made of it
            sizes = windows + length - 1
            begin = np.cumsum(sizes) - sizes
            order, _, first = _firsts(doc, string, flat, begin, sizes)
            gone = order[~first]
            spans.add(doc[gone], start[gone], start[gone] + windows[gone] + length - 1)
            keep = order[first]
            keep = keep[np.argsort(fp[keep], kind="stable")]  # equal strings stay together
            cuts = np.searchsorted(fp[keep], np.arange((1 << range_bits) + 1, dtype=U64) << below)
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                k = keep[cuts[r] : cuts[r + 1]]
                blob = pack(np.diff(fp[k], prepend=U64(0)), doc[k], start[k], windows[k].astype(np.uint16), place[k], flat[ragged(begin[k], sizes[k])])
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([blob], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.binary())], ["range", "blob", "doc_id", "runs"])

        def gone(least):
            if (out := spans.take(least)) is not None:
                n = out.num_rows
                ranges = out.column(0).to_numpy() % (1 << range_bits)
                yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.nulls(n, pa.binary()), *out.columns], ["range", "blob", "doc_id", "runs"])

        for batch in batches:
            for run in slices(batch, 1, STEP_BYTES):
                flat, offsets = text_bytes(run.column(1))
                row, start, last, fp, anchor, prefix = stretches(flat, offsets, length)
                pass_ = sent.value.has(fp)
                if passes > 1:
                    own = (fp >> below).astype(np.int64)
                    pass_ &= (own >= low) & (own < high)
                if not pass_.any():
                    continue
                row, start, last, fp, anchor = (x[pass_] for x in (row, start, last, fp, anchor))
                windows = last - start + 1
                held.append((run.column(0).to_numpy()[row], start - offsets[row], windows, fp, (anchor - start).astype(np.uint16), span_hash(prefix, start, last + length), flat[ragged(start, windows + length - 1)]))
                size += int((windows + length - 1).sum())
                if size > BYTES_HELD:
                    yield from send()
                    yield from gone(SPANS_HELD)
                    size = 0
        if held:
            yield from send()
        yield from gone(0)

    found = docs.mapInArrow(tidy(collect), "range int, blob binary, doc_id long, runs binary")

    def expand(batches):
        at, parts, arrays, size, spans = None, [], [], 0, _Spans()

        def close():
            nonlocal size
            fp, doc, start, windows, place, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            sizes = windows.astype(np.int64) + length - 1
            begin = np.cumsum(sizes) - sizes
            string, right, left = string_hashes(flat, begin, sizes, place, length)
            order, string, first = _firsts(doc, string, flat, begin, sizes)
            gone = order[~first]
            spans.add(doc[gone], start[gone], start[gone] + sizes[gone])
            # strings that may share a window with another one of their anchor
            rows, string = order[first], string[first]
            lead = rows[np.append(True, string[1:] != string[:-1])]
            anchor = np.unique(fp[lead], return_inverse=True)[1]
            many = _has_partner(right[lead]) | _has_partner(left[lead])
            some = many[string]
            rows, string, lead, anchor = rows[some], (np.cumsum(many) - 1)[string[some]], lead[many], anchor[many]
            if not len(lead):
                return
            # some anchors at a time
            by_anchor = np.argsort(anchor, kind="stable")
            upto = np.cumsum(sizes[lead[by_anchor]])
            starts = np.flatnonzero(np.append(True, anchor[by_anchor][1:] != anchor[by_anchor][:-1]))
            part = (upto[starts] - sizes[lead[by_anchor[starts]]]) // ARRAY_BYTES
            cuts = [*starts[np.append(True, part[1:] != part[:-1])].tolist(), len(lead)]
            number = np.empty(len(lead), np.int64)
            number[by_anchor] = np.arange(len(lead))
            order = np.argsort(number[string], kind="stable")
            rows, string = rows[order], number[string][order]
            lead = lead[by_anchor]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                some, own = lead[i:j], slice(*np.searchsorted(string, [i, j]))
                arrays.append((doc[some], sizes[some], flat[ragged(begin[some], sizes[some])], string[own] - i, doc[rows[own]], start[rows[own]]))
                size += int(sizes[some].sum())
                if size > ARRAY_BYTES:
                    _compare(arrays, length, spans)
                    arrays.clear()
                    size = 0

        for batch in batches:
            done = batch.column(1).is_null()
            yield batch.filter(done).select(["doc_id", "runs"])
            batch = batch.filter(pc.invert(done))
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != at and parts:
                    close()
                    parts = []
                    if (out := spans.take(SPANS_HELD)) is not None:
                        yield out
                at = r
                fp, doc, start, windows, place, flat = unpack(blob.as_buffer(), "u8", "i8", "i8", "u2", "u2", "u1")
                parts.append((np.cumsum(fp), doc, start, windows, place, flat))
        if parts:
            close()
        _compare(arrays, length, spans)
        if (out := spans.take()) is not None:
            yield out

    # a number of its own: what a range costs isn't told by its bytes, by which small partitions would be merged
    return cut(found.repartition(max(1, high - low >> 2), "range").sortWithinPartitions("range").mapInArrow(tidy(expand), "doc_id long, runs binary"))


def _kept(text: bytes, spans: np.ndarray) -> bytes:
    parts, at = [], 0
    for a, b in spans.tolist():
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def deduplicate(docs: DataFrame, length: int = LENGTH, with_text: bool = False, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept, the text that is left; carry adds columns of docs.

    Spans needn't begin and end between characters; in kept, the rests of cut
    characters are dropped.
    """
    spark = docs.sparkSession
    carried = F.to_json(F.struct(*(F.col(f"`{c}`") for c in carry)), {"ignoreNullFields": "false"}) if carry else F.lit(None).cast("string")
    kinds = {c: docs.schema[c].dataType for c in carry}
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), carried.alias("carried"))
    spans = repeated_spans(docs.select("doc_id", "text"), length)
    some = spark.sparkContext.broadcast(_filter_of(spans.select(F.col("doc_id").alias("id"))))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, carried string" + ", kept string" * with_text
    names = [x.split()[0] for x in schema.split(", ")]

    def row(doc_id, text, carried, removed):
        left = _kept(text, removed)
        one = [doc_id, len(text), len(text) - len(left), len(removed), hashlib.sha256(left).hexdigest(), carried]
        return [*one, left.decode("utf-8", "ignore")] if with_text else one

    def table(rows):
        types = [pa.int64()] * 4 + [pa.string()] * (2 + with_text)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)

    def split(batches, inside):
        for batch in batches:
            mask = _in_filter(some.value, batch.column(0).fill_null(0).to_numpy()) & ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(mask == inside))

    def whole(batches):
        none = np.empty((0, 2), np.int64)
        for batch in split(batches, False):
            for run in slices(batch):
                yield table([row(d, (t or "").encode(), c, none) for d, t, c in zip(*(x.to_pylist() for x in run.columns), strict=True)])

    def some_texts(batches):
        for batch in split(batches, True):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.binary())], ["doc_id", "text", "carried", "runs"])

    def apply(batches):
        at, texts, runs, out, size = None, [], [], [], 0

        def close():
            nonlocal size
            one = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int64) for x in runs)]).reshape(-1, 2)
            if len(one):
                done = merged(np.zeros(len(one), np.int64), one[:, 0], one[:, 1])
                one = np.frombuffer(done.column(1)[0].as_py(), np.int64).reshape(-1, 2)
            for text, carried in texts:
                out.append(row(at, text, carried, one))
                size += len(text)

        for batch in batches:
            for doc, text, carried, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc != at:
                    if texts:
                        close()
                        if size > 4 << 20:
                            yield table(out)
                            out, size = [], 0
                    at, texts, runs = doc, [], []
                if run is None:
                    texts.append(((text or "").encode(), carried))
                else:
                    runs.append(run)
        if texts:
            close()
        if out:
            yield table(out)

    none = F.lit(None).cast("string")
    texts = docs.mapInArrow(some_texts, "doc_id long, text string, carried string, runs binary")
    gone = spans.select("doc_id", none.alias("text"), none.alias("carried"), "runs")
    met = texts.unionByName(gone).repartition("doc_id").sortWithinPartitions("doc_id", F.col("runs").asc_nulls_first())
    out = docs.mapInArrow(tidy(whole), schema).unionByName(met.mapInArrow(tidy(apply), schema))
    fields = F.from_json("carried", T.StructType([T.StructField(c, k) for c, k in kinds.items()])) if carry else None
    return out.select(*(c for c in names if c != "carried"), *(fields[c].alias(c) for c in carry))
