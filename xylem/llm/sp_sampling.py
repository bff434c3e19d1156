"""SentencePiece encoding with distinct sampled segmentations, and decoding.

A text's segmentations are the paths of its lattice; a path's probability is
proportional to the product of its pieces' weights. The k samples are drawn
without replacement by Gumbel top-k (Kool et al., 2019): every path gets a
Gumbel-perturbed log-probability, and the k greatest are found by A-star
search (Maddison et al., 2014) without visiting the others: the maximum over
all paths of a node of the search tree is itself a Gumbel, so it can be drawn
first, top down, and is an exact bound.

Pieces never hold a space mark behind another character, so the lattice of a
text is a chain of the lattices of its units (space marks and what follows),
and forward sums are needed once for each distinct unit. A node of the search
tree is a set of paths that share the units before a place and differ from a
path found earlier at that place; its mass is known from the units' sums. So
a step of the search is: take the node with the greatest bound, draw a
segmentation of its unit other than those already drawn there and of each
later unit, and add the nodes along the new path with their bounds.

Random numbers are hashes of the row key, the sample, the unit and the step:
results don't depend on partitioning. A sample's inclusion score is
1 - exp(-exp(log_prob - kappa)), kappa being the next perturbed value
(1 where there is none), as in importance weighting of such samples.

The model's scores are merge ranks, no log-probabilities, so a piece of rank r
weighs (r + 2.7) ** -ALPHA. Characters without a piece are their bytes.

Nulls: a null or empty text has one segmentation, the empty one, which decodes
to the empty text: its round_trip is true. A text with
fewer than k segmentations has as many samples. Rows with one key get the same
samples; a null key counts as 0. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from xylem.llm.common import U64, doc_frame, list_array, mix64, powers, ragged, slices, span_hash, span_sum

ALPHA = 1.0
SAMPLES = 2
MARK = "▁"
#: Distinct units whose lattices are built at once, and those that a worker keeps: about 150 MB.
UNITS = 30_000
REMEMBERED = 400_000
#: Bits of the sizes of two tables by hash: pieces, and what pieces begin with.
SIEVE = 20
MASK = (1 << 64) - 1
#: The precision of sums of probabilities: what other segmentations of a unit have below it counts as none.
LEAST_MASS = 1e-14
#: Text sampled at a time: the more, the fewer distinct units a byte.
RUN_BYTES = 4 << 20


def _slot(h: np.ndarray) -> np.ndarray:
    """A hash's place in a table, by the high bits of a product."""
    return ((h * U64(0x9E3779B97F4A7C15)) >> U64(64 - SIEVE)).astype(np.int64)


class Lattices:
    """The lattices of distinct units in flat arrays: for each node, the arcs that end there with cumulated probabilities.

    Units stay from one run of texts to the next; beyond `most` units only the
    present run's are kept.
    """

    KINDS = {"first": np.int32, "ends": np.int32, "cum": np.float64, "logp": np.float64, "back": np.int32, "tok": np.int32, "n_tok": np.int8}

    def __init__(self, model: Pieces, most: int = REMEMBERED):
        self.model, self.most = model, most
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rooms: dict[str, np.ndarray] = {}
        for name, kind in self.KINDS.items():
            self.rooms[name] = np.empty(0, kind)
            setattr(self, name, self.rooms[name])

    def _extend(self, name: str, more: np.ndarray) -> None:
        """Append to one of KINDS, in a room with some to spare: it is copied now and then only, and what isn't used yet takes no memory."""
        have, room = getattr(self, name), self.rooms[name]
        size = len(have) + len(more)
        if size > len(room):
            room = self.rooms[name] = np.empty(size * 3 // 2, room.dtype)
            room[: len(have)] = have
        room[len(have) : size] = more
        setattr(self, name, room[:size])

    def learn(self, words: list[str]) -> np.ndarray:
        """The numbers of units, whose lattices are built where they are new."""
        entry = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(entry < 0)
        if len(self.known) + len(new) > self.most and self.known:
            self._forget()
            return self.learn(words)
        if len(new):
            some = [words[i] for i in new.tolist()]
            for i in range(0, len(some), UNITS):
                nodes, arcs = len(self.first), len(self.cum)
                first, ends, cum, logp, back, tok, n_tok = self.model.arcs(some[i : i + UNITS])
                for name, x in zip(self.KINDS, (first + arcs, ends + nodes, cum, logp, back + nodes, tok, n_tok), strict=True):
                    self._extend(name, x)
            entry[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(some, entry[new].tolist(), strict=True))
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        return entry

    def draw(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """A segmentation of each unit: its log-probability, and the arcs from its end, step by step."""
        node, start = self.ends[unit], self.starts[unit]
        logp = np.zeros(len(unit))
        at, steps = np.arange(len(unit)), []
        while len(at):
            u = (mix64(key[at] + U64(len(steps) * 0xD1342543DE82EF95 & MASK)) >> U64(11)).astype(np.float64) * 2.0**-53
            arc = self.first[node]
            late = np.flatnonzero(u >= self.cum[arc])
            while len(late):
                arc[late] += 1
                late = late[u[late] >= self.cum[arc[late]]]
            logp[at] += self.logp[arc]
            steps.append((at, arc))
            node = self.back[arc]
            more = node > start[at]
            at, node = at[more], node[more]
        return logp, steps

    def draw_other(self, unit: int, paths: list[tuple[int, ...]], u: list[float]) -> tuple[float, tuple[int, ...]]:
        """A segmentation (log-probability, arcs from the end) of a unit that is none of paths, in proportion to its probability.

        At each node an arc weighs its probability less that of the paths that go on through it.
        """
        node, logp, out = int(self.ends[unit]), 0.0, []
        left = [(p, float(np.exp(self.logp[list(p)].sum()))) for p in paths]
        for step in range(1 << 30):
            if node == self.starts[unit]:
                return logp, tuple(out)
            arc = int(self.first[node])
            arcs, weights = [], []
            while True:
                through = sum(x for p, x in left if p[step] == arc)
                arcs.append(arc)
                weights.append(max(0.0, float(np.exp(self.logp[arc])) - through))
                if self.cum[arc] >= 1:
                    break
                arc += 1
            sums = list(accumulate(weights))
            pick = min(bisect_right(sums, u[step] * sums[-1]), max(k for k, x in enumerate(weights) if x))
            arc, own = arcs[pick], float(np.exp(self.logp[arcs[pick]]))
            left = [(p, x / own) for p, x in left if p[step] == arc]
            logp += float(self.logp[arc])
            out.append(arc)
            node = int(self.back[arc])


class Pieces:
    """The pieces of a model file with their weights; encode, decode and sample."""

    def __init__(self, path: str, alpha: float = ALPHA):
        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.alpha = n, alpha
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        rank = lambda i: min(-sp.get_score(i), n)
        self.byte_weight = -alpha * float(np.log(n + 2.7))
        self.begun = np.zeros(1 << SIEVE, bool)
        by: dict[int, list[int]] = {}
        for i in usable:
            if MARK in names[i].lstrip(MARK):
                raise ValueError(f"piece {i} has a space mark inside: units can't be told apart")
            by.setdefault(len(names[i]), []).append(i)
        hashes = []
        for length, ids in by.items():
            points = np.frombuffer("".join(names[i] for i in ids).encode("utf-32-le"), np.uint32)
            at = np.arange(len(ids)) * length
            prefix = self._prefix(points)
            hashes.append(span_hash(prefix, at, at + length))
            for k in range(1, length + 1):
                self.begun[_slot(span_sum(prefix, at, at + k))] = True
        self.longest = max(by)
        # entry 0 is no piece
        self.hashes = np.concatenate([[U64(0)], *hashes])
        self.piece = np.array([0, *(i for ids in by.values() for i in ids)])
        self.weight = np.array([0.0, *(-alpha * np.log(rank(i) + 2.7) for i in self.piece[1:].tolist())])
        self.table, self.probes = np.zeros((1 << SIEVE) + n, np.int32), 1
        for k, at in enumerate(_slot(self.hashes).tolist()[1:], 1):
            probes = 1
            while self.table[at]:
                at, probes = at + 1, probes + 1
            self.table[at], self.probes = k, max(self.probes, probes)
        surface = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.surface_size = np.array([len(x) for x in surface])
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.lattices = Lattices(self)

    @staticmethod
    def _prefix(points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points) + 1, U64)
        np.cumsum((points.astype(U64) + U64(1)) * powers(len(points) + 1)[0][: len(points)], out=out[1:])
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The model's own segmentation."""
        return self.processor.encode(texts, num_threads=1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of a sequence of ids, without the space that encoding puts first."""
        out = self.surface[ragged(self.surface_at[ids], self.surface_size[ids])].tobytes()
        return out[1:] if out[:1] == b" " else out

    def _entries(self, h: np.ndarray) -> np.ndarray:
        """The pieces with these hashes as places in self.piece, 0 for none."""
        slot = _slot(h)
        found = self.table[slot]
        wrong = np.flatnonzero(self.hashes[found] != h)
        for step in range(1, self.probes):
            later = wrong[found[wrong] > 0]
            if not len(later):
                break
            found[later] = self.table[slot[later] + step]
            wrong = later[self.hashes[found[later]] != h[later]]
        found[self.hashes[found] != h] = 0
        return found

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Flat lattices of units: per node its first arc; the end nodes; per arc cumulated and log-probability, the node before, first token and number of tokens.

        Tokens below the number of pieces are ids; above it, they are the code point of a character that is its bytes.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        points = np.frombuffer("".join(f"{MARK}{w}" for w in words).encode("utf-32-le"), np.uint32)
        end = np.repeat(np.cumsum(sizes), sizes)
        unit = np.repeat(np.arange(len(words)), sizes)
        prefix, at = self._prefix(points), np.arange(len(points))
        starts, stops, tokens, weights = [], [], [], []
        covered = np.zeros(len(points), bool)
        here = at
        for length in range(1, self.longest + 1):  # only places where a piece of this length or more may begin
            here = here[here + length <= end[here]]
            h = span_sum(prefix, here, here + length)
            going = np.flatnonzero(self.begun[_slot(h)])
            here, h = here[going], h[going]
            found = self._entries(mix64(h))
            hit = np.flatnonzero(found)
            found, start = found[hit], here[hit]
            starts.append(start)
            stops.append(start + length)
            tokens.append(self.piece[found])
            weights.append(self.weight[found])
            if length == 1:
                covered[start] = True
        for x in (starts, stops, tokens, weights):
            x.reverse()  # longer pieces are likelier
        bare = at[~covered]
        n_bytes = 1 + (points[bare] >= 0x80) + (points[bare] >= 0x800) + (points[bare] >= 0x10000).astype(np.int64)
        start, stop = np.concatenate([*starts, bare]), np.concatenate([*stops, bare + 1])
        token = np.concatenate([*tokens, points[bare].astype(np.int64) + self.size])
        weight = np.concatenate([*weights, n_bytes * self.byte_weight])
        count = np.concatenate([np.ones(len(start) - len(bare), np.int64), n_bytes])
        own = unit[start]
        back, to = start + own, stop + own  # a unit has one node more than characters
        order = np.argsort(to, kind="stable")  # each length's arcs are in order already
        back, to, token, count, weight = (x[order] for x in (back, to, token, count, weight))
        first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        many = np.diff(np.append(first, len(to)))
        # forward sums, all units' nodes at one place at a time
        total = np.full(len(points) + len(words), -np.inf)
        roots = np.cumsum(sizes + 1) - sizes - 1
        total[roots] = 0
        nodes = to[first]
        place = nodes - roots[np.searchsorted(roots, nodes, "right") - 1]
        by_place = np.argsort(place.astype(np.min_scalar_type(place.max(initial=0))), kind="stable")  # of 16 bits it is quicker
        bounds = np.searchsorted(place[by_place], np.arange(1, int(sizes.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            some = by_place[a:b]
            if len(some):
                arcs = ragged(first[some], many[some])
                total[nodes[some]] = np.logaddexp.reduceat(total[back[arcs]] + weight[arcs], np.cumsum(many[some]) - many[some])
        logp = total[back] + weight - total[to]
        sums = np.cumsum(np.exp(logp))
        cum = sums - np.repeat(np.concatenate([[0], sums[first[1:] - 1]]), np.diff(np.append(first, len(to))))
        cum[np.append(first[1:], len(to)) - 1] = 1
        node_first = np.zeros(len(total), np.int64)
        node_first[to[first]] = first
        return node_first, np.cumsum(sizes + 1) - 1, cum, logp, back, token, count

    def expand(self, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of tokens, characters without a piece as their bytes."""
        if (counts == 1).all() and (tokens < self.size).all():
            return tokens
        out = np.repeat(tokens, counts)
        ends = np.cumsum(counts)
        for i in np.flatnonzero(tokens >= self.size).tolist():
            out[ends[i] - counts[i] : ends[i]] = self.byte_ids[list(chr(int(tokens[i]) - self.size).encode("utf-8", "replace"))]
        return out


_UNITS = re.compile(f"{MARK}+[^{MARK}]*")


def units_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Each text's units as numbers, the distinct units without their first space mark, and where each text's begin."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, MARK))
    if pc.any(odd).as_py():
        lists = [[u[1:] for u in _UNITS.findall(MARK + t.replace(" ", MARK))] if t else [] for t in texts.to_pylist()]
        flat, sizes = pa.array([u for x in lists for u in x], pa.large_string()), np.array([len(x) for x in lists])
    else:
        parts = pc.split_pattern(texts, " ")
        flat, sizes = parts.flatten(), np.diff(parts.offsets.to_numpy())
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        if empty.any():  # an empty text has no unit
            flat = flat.filter(pa.array(~np.repeat(empty, sizes)))
            sizes = np.where(empty, 0, sizes)
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much quicker than to_pylist()
    return coded.indices.to_numpy().astype(np.int64), words, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)) for x <= 0."""
    with np.errstate(divide="ignore"):
        return np.where(x > -0.693, np.log(-np.expm1(x)), np.log1p(-np.exp(x)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((mix64(h) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def sample(pieces: Pieces, keys: np.ndarray, texts: pa.Array, k: int = SAMPLES, seed: int = 0) -> list[dict[str, np.ndarray]]:
    """k rounds of samples of every text: for each round the texts that have one, log-probabilities, perturbed values, ids and their bounds; the last round's `kappa` is the next value."""
    unit, words, bounds = units_of(texts)
    n, sizes = len(keys), np.diff(bounds)
    if words:
        unit = pieces.lattices.learn(words)[unit]
    lattice = pieces.lattices if words else None
    doc = np.repeat(np.arange(n), sizes)
    nth = np.arange(len(unit)) - np.repeat(bounds[:-1], sizes)
    base = mix64(keys.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    occurrence = mix64(base[doc] + nth.astype(U64) * U64(0xC2B2AE3D27D4EB4F)) if len(unit) else np.empty(0, U64)
    by_unit = np.argsort(unit)

    def draw(which, salt):
        order = which[np.argsort(unit[which])] if len(which) < len(unit) else by_unit
        logp, steps = lattice.draw(unit[order], mix64(occurrence[order] + U64(salt * 0x2545F4914F6CDD1D & MASK)))
        return order, logp, [(order[at], arc) for at, arc in steps]

    # the path of each round: the log-probability of each unit's segmentation, and its arcs
    rounds: list[dict] = []
    gumbel = -np.log(-np.log(_uniform(base + U64(1))))
    alive = np.arange(n)
    logp, steps = np.zeros(len(unit)), []
    if len(unit):
        order, lp, steps = draw(np.arange(len(unit)), 0)
        logp[order] = lp
    state = {"alive": alive, "value": gumbel, "logp": logp, "arcs": _arcs(steps, len(unit)), "taken": [[] for _ in range(n)]}
    results, paths = [], []
    for r in range(k + 1):
        if r:
            # the node with the greatest bound among all rounds' paths
            best, where, from_ = np.full(n, -np.inf), np.full(n, -1), np.full(n, -1)
            for j, p in enumerate(paths):
                if len(unit):
                    top = _segment_argmax(p["bound"], bounds)
                    value = np.where(top >= 0, p["bound"][np.maximum(top, 0)], -np.inf)
                    better = value > best
                    best[better], where[better], from_[better] = value[better], top[better], j
            if r == k:
                results[-1]["kappa"] = best
                break
            alive = np.flatnonzero(best > -np.inf)
            logp = np.zeros(len(unit))
            fresh, kept_from = np.zeros(len(unit), bool), np.full(len(unit), -1)
            taken: list = [[] for _ in range(n)]
            for d in alive.tolist():
                a, w, e, j = bounds[d], where[d], bounds[d + 1], from_[d]
                kept_from[a:w] = j
                fresh[w:e] = True
                p = paths[j]
                before = p["taken"][d]
                arcs_, starts_, sizes_ = p["arcs"]
                own = tuple(arcs_[starts_[w] : starts_[w] + sizes_[w]][::-1].tolist())
                taken[d] = [int(w), *(before[1:] if before and before[0] == w else []), (float(p["logp"][w]), own)]
            parts = [(np.flatnonzero(kept_from == j), paths[j]) for j in range(len(paths))]
            for at, p in parts:
                logp[at] = p["logp"][at]
            which = np.flatnonzero(fresh)
            order, lp, steps = draw(which, r)
            logp[order] = lp
            own = _arcs(steps, len(unit))
            # the unit where paths part is drawn among the others
            redrawn: dict[int, tuple[int, ...]] = {}
            spots = np.array([taken[d][0] for d in alive.tolist()], np.int64)
            most = lattice.ends[unit[spots]] - lattice.starts[unit[spots]]  # a draw of its own for each step
            nth_step = ragged(np.zeros(len(most), np.int64), most).astype(U64)
            draws = _uniform(np.repeat(occurrence[spots], most) + nth_step * U64(0x9E6C63D0876A9A35) + U64((r << 32) + 7)).tolist()
            stop = np.cumsum(most).tolist()
            for d, a, b in zip(alive.tolist(), [0, *stop], stop, strict=False):
                w, *drawn = taken[d]
                logp[w], redrawn[w] = lattice.draw_other(int(unit[w]), [x for _, x in drawn], draws[a:b])
            arcs = _merge_arcs(own, parts, fresh, redrawn, len(unit))
            for d in alive.tolist():  # that node is spent; what is left of it belongs to the new path
                paths[from_[d]]["bound"][where[d]] = -np.inf
            state = {"alive": alive, "value": best, "logp": logp, "arcs": arcs, "taken": taken}
        p = state
        # bounds of the nodes along the path: the mass of other segmentations at each unit, below the path's own value
        sums = np.concatenate([[0.0], np.cumsum(p["logp"])])
        before = sums[:-1] - np.repeat(sums[bounds[:-1]], sizes)
        left = _log1mexp(np.minimum(p["logp"], 0))
        left[p["logp"] > -LEAST_MASS] = -np.inf
        live = np.zeros(n, bool)
        live[p["alive"]] = True
        skip = ~live[doc]
        for d in p["alive"].tolist() if r else ():
            w, *drawn = p["taken"][d]
            skip[bounds[d] : w] = True
            rest = 1 - sum(np.exp(x) for x, _ in drawn) - np.exp(p["logp"][w])
            left[w] = np.log(rest) if rest > LEAST_MASS else -np.inf
        value = p["value"][doc] if len(unit) else np.empty(0)
        noise = -np.log(_uniform(occurrence + U64((r + 1) * 0x632BE59BD9B4E019 & MASK)))
        with np.errstate(invalid="ignore", divide="ignore"):
            bound = -np.logaddexp(-value, np.log(noise) - (before + left))
        bound[skip | np.isneginf(left)] = -np.inf
        p["bound"] = bound
        paths.append(p)
        results.append(_result(pieces, lattice, p, sums, bounds))
    return results


def _segment_argmax(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The place of each segment's greatest value, -1 for empty segments."""
    out = np.full(len(bounds) - 1, -1)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        top = np.maximum.reduceat(x, bounds[some])
        owner = np.repeat(np.arange(len(some)), np.diff(bounds)[some])
        hit = np.flatnonzero(x == top[owner])
        out[some[owner[hit[::-1]]]] = hit[::-1]
    return out


def _arcs(steps: list, n: int) -> list[np.ndarray]:
    """Arcs of each unit's segmentation in reading order, end to end by unit: arcs, starts, sizes."""
    sizes = np.bincount(np.concatenate([at for at, _ in steps]), minlength=n) if steps else np.zeros(n, np.int64)
    ends = np.cumsum(sizes)
    out = np.empty(int(sizes.sum()), np.int64)
    for k, (at, arc) in enumerate(steps, 1):
        out[ends[at] - k] = arc
    return [out, ends - sizes, sizes]


def _merge_arcs(own, parts, fresh, redrawn, n):
    sizes = np.where(fresh, own[2], 0)
    for at, p in parts:
        sizes[at] = p["arcs"][2][at]
    for w, path in redrawn.items():
        sizes[w] = len(path)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int64)
    plain = fresh.copy()
    plain[list(redrawn)] = False
    for at, a in [(np.flatnonzero(plain), own), *((at, p["arcs"]) for at, p in parts)]:
        out[ragged(starts[at], sizes[at])] = a[0][ragged(a[1][at], sizes[at])]
    for w, path in redrawn.items():
        out[starts[w] : starts[w] + sizes[w]] = path[::-1]
    return [out, starts, sizes]


def _result(pieces, lattice, p, sums, bounds):
    alive = p["alive"]
    live = np.zeros(len(bounds) - 1, bool)
    live[alive] = True
    arcs, starts, sizes = p["arcs"]
    if lattice is None:
        ids, ends = np.empty(0, np.int64), np.zeros(len(alive) + 1, np.int64)
    else:
        counts = lattice.n_tok[arcs]
        total = np.zeros(len(arcs) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        edge = np.append(starts, len(arcs))
        per_unit = np.append(total[edge[:-1]], total[-1])
        ends = per_unit[np.append(bounds[:-1][live], bounds[-1])] if len(alive) else np.zeros(1, np.int64)
        ids = pieces.expand(lattice.tok[arcs], counts)
    return {"row": alive, "log_prob": (sums[bounds[1:]] - sums[bounds[:-1]])[alive], "value": p["value"][alive], "ids": ids, "bounds": ends}


_PIECES: dict[tuple[str, float], Pieces] = {}


def pieces(path: str, alpha: float = ALPHA) -> Pieces:
    if (path, alpha) not in _PIECES:
        _PIECES[path, alpha] = Pieces(path, alpha)
    return _PIECES[path, alpha]


SAMPLED = "doc_id long, sample int, n_tokens long, ids_crc32 long, log_prob double, perturbed double, inclusion double, round_trip boolean"


def sample_segmentations(docs: DataFrame, model: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k distinct sampled segmentations of every text, by descending perturbed value, with inclusion scores.

    round_trip says that the ids decode to the text; with_ids adds the ids.
    """
    schema = SAMPLED + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run_(batches):
        own = pieces(model, alpha)
        for batch in batches:
            for run in slices(batch, 1, RUN_BYTES):
                keys = run.column(0).fill_null(0).to_numpy()
                texts = [(t or "").encode() for t in run.column(1).to_pylist()]
                found = sample(own, keys, run.column(1), k, seed)
                kappa = found[-1].get("kappa", np.full(len(keys), -np.inf))
                for r, one in enumerate(found):
                    if not len(one["row"]):
                        continue
                    ends = one["bounds"]
                    data = memoryview(one["ids"].astype("<u4").tobytes())
                    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    back = own.surface[ragged(own.surface_at[one["ids"]], own.surface_size[one["ids"]])].tobytes()
                    size = np.concatenate([[0], np.cumsum(own.surface_size[one["ids"]])])[ends].tolist()
                    same = [back[a:b][1:] == texts[i] for a, b, i in zip(size[:-1], size[1:], one["row"].tolist(), strict=True)]
                    with np.errstate(over="ignore"):
                        inclusion = -np.expm1(-np.exp(one["log_prob"] - kappa[one["row"]]))
                    cols = [run.column(0).take(pa.array(one["row"])), pa.array(np.full(len(crc), r + 1), pa.int32()), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), pa.array(one["log_prob"]), pa.array(one["value"]), pa.array(inclusion), pa.array(same)]
                    if with_ids:
                        cols.append(list_array(one["ids"].astype(np.int32), ends, pa.int32()))
                    yield pa.RecordBatch.from_arrays(cols, names)

    return doc_frame(docs, id_col, text_col).mapInArrow(run_, schema)
