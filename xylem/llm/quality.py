"""Quality classifier by co-training (Blum and Mitchell, 1998).

Two views of a page: its text (hashed words, runs of punctuation and a few
ratios) and its metadata (source, language, length). Each has a logistic
regression. In each round, both classifiers score all documents without a
label; of those that one is sure of, GIVEN of each class teach the other. At
the end each view is calibrated (Platt scaling) on labelled documents that
neither has learned from, and a logistic regression on both calibrated views
gives the score.

A document is acceptable if its label has quality 1 and toxic 0 (null: 0).

What is bounded: LABELLED labelled documents, those with the least hash of
doc_id, and GIVEN pseudo-labels of a class that a view gives in a round, those
with the least hash of their features, which is a uniform draw of all the
distinct ones it is sure of. So one task fits, whatever the corpus, and the
driver gets weights only. The pool is every document without a label: their
features are written once and scored in every round. Scoring reads all whole
texts.

Nulls: a null text is empty; null metadata is a value of its own; labels with
a null quality or doc_id teach nothing, nor does a null doc_id's row have a
label. A doc_id with several labels has the best of them; with several rows,
one row of them teaches. With labels of one class only, or none, every
document scores 1 and is kept. Documents with the same text and metadata have
the same score (ties are kept or go together). Repeated rows are each scored.
An empty table gives no rows. Texts of any length are read whole, STEP_BYTES or
one text at a time. Other columns are kept as they are by `classify`; columns
that it adds replace columns of the same name.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import cut, discard, prefix_hash, slices, span_hash, text_bytes, tidy
from xylem.llm.shingles import _LOWER, _WHITE

LABELLED = 12_000
BINS = 1 << 17
FEATURES = 3000
ROUNDS = 4
#: Pseudo-labels of each class that a view gives in a round, at most, and how sure it must be.
GIVEN, SURE = 300, 0.97
CUT = 0.5
#: Text worked on at a time.
STEP_BYTES = 1 << 20
RATIOS = 8

_KIND = np.full(256, 2, np.uint8)  # 0 white, 1 of words, 2 punctuation
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[_WHITE] = 0


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bin) of each token of each text, and a row of ratios for each text."""
    flat, offsets = text_bytes(texts)
    n = len(offsets) - 1
    ratios = np.zeros((n, RATIOS))
    if not len(flat):
        return np.empty(0, np.int64), np.empty(0, np.int64), ratios
    kind = _KIND[flat]
    edge = np.append(True, kind[1:] != kind[:-1])
    edge[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(flat))
    real = kind[start] > 0
    start, end = start[real], end[real]
    row = np.searchsorted(offsets, start, "right") - 1
    bins = (span_hash(prefix_hash(_LOWER[flat]), start, end) % np.uint64(BINS)).astype(np.int64)
    size = np.maximum(np.diff(offsets), 1)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    words = np.bincount(row[kind[start] == 1], minlength=n)
    marks = np.bincount(row[kind[start] == 2], minlength=n)
    ratios[:, 0] = per(kind == 2) / size
    ratios[:, 1] = per((flat >= 65) & (flat <= 90)) / size
    ratios[:, 2] = per((flat >= 48) & (flat <= 57)) / size
    ratios[:, 3] = per(flat == 10) / size
    ratios[:, 4] = marks / np.maximum(words, 1)
    ratios[:, 5] = np.log1p(words) / 10
    ratios[:, 6] = size / np.maximum(words, 1) / 10
    distinct = np.unique(row * BINS + bins) // BINS
    ratios[:, 7] = np.bincount(distinct, minlength=n) / np.maximum(words + marks, 1)
    return row, bins, np.minimum(ratios, 4)


def metadata_values(lang: str | None, source: str | None, chars: int | None) -> list[str]:
    size = "null" if chars is None else str(int(np.log2(max(chars, 0) + 1) * 2))
    return [f"lang={lang}", f"source={source}", f"size={size}", f"lang={lang},size={size}"]


@dataclass
class Logistic:
    """Weights of sparse features with the value 1, of dense ones, and the intercept."""

    sparse: np.ndarray
    dense: np.ndarray
    bias: float

    @classmethod
    def fit(cls, row, col, width, dense, y, weight, l2=1e-3, steps=150):
        n, p = len(y), dense.shape[1]
        w, v, b = np.zeros(width), np.zeros(p), 0.0
        mean, moment = np.zeros(width + p + 1), np.zeros(width + p + 1)
        total = weight.sum()
        for t in range(1, steps + 1):
            z = np.bincount(row, w[col], minlength=n) + dense @ v + b
            e = weight * (_sigmoid(z) - y) / total
            g = np.concatenate([np.bincount(col, e[row], minlength=width) + l2 * w, dense.T @ e + l2 * v, [e.sum()]])
            mean, moment = 0.9 * mean + 0.1 * g, 0.99 * moment + 0.01 * g * g
            step = 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(moment / (1 - 0.99**t)) + 1e-8)
            w, v, b = w - step[:width], v - step[width:-1], b - step[-1]
        return cls(w, v, float(b))

    def logit(self, row, col, dense) -> np.ndarray:
        return np.bincount(row, self.sparse[col], minlength=len(dense)) + dense @ self.dense + self.bias


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _telling(bags: list[np.ndarray], y: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The bins that tell the classes of the known rows apart best: at most FEATURES, with |z| of 4 or more."""
    bad, good = np.zeros((2, BINS), np.int64)
    for i in np.flatnonzero(known):
        (bad, good)[y[i]][np.unique(bags[i])] += 1
    n1, n0 = max(1, int((y[known] == 1).sum())), max(1, int((y[known] == 0).sum()))
    p = (good + bad + 1) / (n1 + n0 + 2)
    z = np.abs(good / n1 - bad / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    best = np.argsort(-z, kind="stable")[:FEATURES]
    return np.sort(best[z[best] >= 4])


@dataclass
class CoTrained:
    """The two views with their calibration, and the weights that combine them; taken: prints of the pseudo-labelled documents that have taught each view."""

    bins: np.ndarray
    text: Logistic
    values: dict[str, int]
    meta: Logistic
    platt: tuple[tuple[float, float], tuple[float, float]]
    mix: np.ndarray
    taken: tuple[frozenset[int], frozenset[int]] = (frozenset(), frozenset())

    def scores(self, texts: pa.Array, lang: list, source: list, chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, of the metadata view, and of both."""
        row, bins, ratios = text_features(texts)
        a = self.text.logit(*self._chosen(row, bins), ratios)
        mrow, mcol = self._meta(list(zip(lang, source, chars, strict=True)))
        b = self.meta.logit(mrow, mcol, np.zeros((len(ratios), 0)))
        a, b = (x * k + c for x, (k, c) in zip((a, b), self.platt, strict=True))
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])

    def _chosen(self, row, bins):
        at = np.minimum(np.searchsorted(self.bins, bins), max(0, len(self.bins) - 1))
        hit = self.bins[at] == bins if len(self.bins) else np.zeros(len(bins), bool)
        pair = np.unique(row[hit] * (len(self.bins) + 1) + at[hit])
        return pair // (len(self.bins) + 1), pair % (len(self.bins) + 1)

    def _meta(self, rows):
        found = [(i, self.values[v]) for i, x in enumerate(rows) for v in metadata_values(*x) if v in self.values]
        return np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)


@dataclass
class Taught:
    """What the views learn from: chosen bins, ratios and metadata of documents, each view's labels (-1: none), and the labels kept for calibration."""

    bins: list[np.ndarray]
    ratios: np.ndarray
    meta: list[tuple]
    labels: list[np.ndarray]
    kept: np.ndarray

    def add(self, bins: list[np.ndarray], ratios: np.ndarray, meta: list[tuple], view: np.ndarray, y: np.ndarray) -> None:
        """Pseudo-labelled documents, each for one view."""
        self.bins += bins
        self.ratios = np.concatenate([self.ratios, ratios])
        self.meta += meta
        self.labels = [np.concatenate([x, np.where(view == k, y, -1)]) for k, x in enumerate(self.labels)]
        self.kept = np.concatenate([self.kept, np.full(len(y), -1)])


def begin(bags: list[np.ndarray], ratios: np.ndarray, meta: list[tuple], y: np.ndarray) -> tuple[np.ndarray, Taught] | None:
    """The bins that tell labelled documents apart, and what the views learn from at first. None if there is one class only."""
    if len(np.unique(y)) < 2:
        return None
    # every fourth document is kept for calibration
    kept = np.arange(1, len(y) + 1) % 4 == 0
    if len(np.unique(y[kept])) < 2:
        kept = np.ones(len(y), bool)
    learn = ~kept if (~kept).any() and len(np.unique(y[~kept])) == 2 else np.ones(len(y), bool)
    chosen = _telling(bags, y, learn)
    own = [np.searchsorted(chosen, x[np.isin(x, chosen)]).astype(np.uint16) for x in bags]
    labels = np.where(learn, y, -1)
    return chosen, Taught(own, ratios, meta, [labels, labels.copy()], np.where(kept, y, -1))


def fitted(chosen: np.ndarray, taught: Taught) -> CoTrained:
    """Both views fitted to their labels, calibrated and combined on the documents kept for that."""
    names = sorted({v for x in taught.meta for v in metadata_values(*x)})
    model = CoTrained(chosen, None, {v: k for k, v in enumerate(names)}, None, ((1.0, 0.0), (1.0, 0.0)), np.array([1.0, 0.0, 0.0]))
    n = len(taught.bins)
    row, col = np.repeat(np.arange(n), [len(x) for x in taught.bins]), np.concatenate(taught.bins).astype(np.int64)
    views = [(row, col, len(chosen) + 1, taught.ratios), (*model._meta(taught.meta), len(names), np.zeros((n, 0)))]
    models = []
    for (r, c, width, dense), labels in zip(views, taught.labels, strict=True):
        use = labels >= 0
        at, own = np.cumsum(use) - 1, use[r]
        share = np.array([(labels == v).sum() for v in (0, 1)], float)
        models.append(Logistic.fit(at[r[own]], c[own], width, dense[use], labels[use].astype(float), 1 / share[labels[use]]))
    kept = taught.kept >= 0
    z = [m.logit(r, c, dense)[kept] for m, (r, c, _, dense) in zip(models, views, strict=True)]
    target, even, none = taught.kept[kept].astype(float), np.ones(int(kept.sum())), np.empty(0, np.int64)
    platt = []
    for x in z:
        line = Logistic.fit(none, none, 0, x[:, None] / 10, target, even, 1e-4, 400)
        platt.append((max(0.0, float(line.dense[0])) / 10, line.bias))
    both = np.column_stack([x * k + c for x, (k, c) in zip(z, platt, strict=True)])
    line = Logistic.fit(none, none, 0, both / 10, target, even, 1e-4, 400)
    model.text, model.meta, model.platt, model.mix = models[0], models[1], tuple(platt), np.array([*(line.dense / 10), line.bias])
    return model


def sure_of(model: CoTrained, bins: list[np.ndarray], ratios: np.ndarray, meta: list[tuple]) -> list[np.ndarray]:
    """For each view, the class that the other view is sure a document has, or -1."""
    n = len(bins)
    row, col = np.repeat(np.arange(n), [len(x) for x in bins]), np.concatenate([np.empty(0, np.uint16), *bins]).astype(np.int64)
    p = [_sigmoid(model.text.logit(row, col, ratios)), _sigmoid(model.meta.logit(*model._meta(meta), np.zeros((n, 0))))]
    return [np.where(x >= SURE, 1, np.where(x <= 1 - SURE, 0, -1)) for x in reversed(p)]


def _drawn(view: np.ndarray, y: np.ndarray, prints: np.ndarray, given: int) -> np.ndarray:
    """Places of the `given` least distinct prints of each view and class."""
    order = np.lexsort((prints, y, view))
    group, p = (view * 2 + y)[order], prints[order]
    order = order[np.append(True, (group[1:] != group[:-1]) | (p[1:] != p[:-1]))] if len(order) else order
    group = (view * 2 + y)[order]
    first = np.searchsorted(group, group)
    return order[np.arange(len(order)) - first < given]


COMPACT = "bins binary, ratios binary, lang string, source string, n_chars long, print long"
_GIVEN = f"view int, y int, {COMPACT}"


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, given: int = GIVEN, rounds: int = ROUNDS) -> CoTrained | None:
    """Co-train on docs (doc_id, text, lang, source, n_chars) and labels (doc_id, quality, toxic).

    Both fits and the pool's scores are tasks; the driver sees the weights of each round.
    """
    spark, h = docs.sparkSession, F.xxhash64("doc_id")
    target = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1), 1).otherwise(0)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).alias("y"))
    taught = known.orderBy(h, "doc_id").limit(labelled)  # labelled rows of two numbers
    rows = _columns(docs).join(F.broadcast(taught), "doc_id").select("doc_id", "text", "lang", "source", "n_chars", "y")

    def bags(batches):
        for batch in batches:
            for run in slices(batch, 1, STEP_BYTES):
                row, bins, ratios = text_features(run.column(1))
                pair = np.unique(row * BINS + bins)
                bounds = np.searchsorted(pair // BINS, np.arange(run.num_rows + 1)).tolist()
                bins = (pair % BINS).astype("<i4")
                own = pa.array([bins[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([run.column(0), own, pa.array([x.tobytes() for x in ratios], pa.binary()), *(run.column(k) for k in range(2, 6))], ["doc_id", "bag", "ratios", "lang", "source", "n_chars", "y"])

    def start(batches):
        found = [x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not found:
            return
        found.sort(key=lambda x: x[0])
        made = begin([np.frombuffer(x[1], "<i4") for x in found], np.array([np.frombuffer(x[2]) for x in found]), [x[3:6] for x in found], np.array([x[6] for x in found]))
        if made is not None:
            yield _state(fitted(*made), made[1], 0)

    sample = rows.mapInArrow(tidy(bags), "doc_id long, bag binary, ratios binary, lang string, source string, n_chars long, y int")
    # one row of each labelled document: at most `labelled` rows meet in the task that fits
    one = sample.groupBy("doc_id").agg(F.min(F.struct("bag", "ratios", "lang", "source", "n_chars", "y")).alias("o")).select("doc_id", "o.*")
    state = cut(one.repartition(1).mapInArrow(tidy(start), "model binary, taught binary, added int"))
    model = _model(state)
    if model is None or not rounds:
        discard(state)
        return model
    chosen = spark.sparkContext.broadcast(model)

    def compact(batches):
        for batch in batches:
            for run in slices(batch, 1, STEP_BYTES):
                row, bins, ratios = text_features(run.column(1))
                row, col = chosen.value._chosen(row, bins)
                bounds, col = np.searchsorted(row, np.arange(run.num_rows + 1)).tolist(), col.astype("<u2")
                own = [col[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                dense = [x.tobytes() for x in ratios.astype("<f4")]
                yield pa.RecordBatch.from_arrays([run.column(0), pa.array(own, pa.binary()), pa.array(dense, pa.binary()), *(run.column(k) for k in range(2, 5))], ["doc_id", "bins", "ratios", "lang", "source", "n_chars"])

    free = _columns(docs).mapInArrow(tidy(compact), f"doc_id long, {COMPACT.removesuffix(', print long')}")
    pool = cut(free.join(known, "doc_id", "left_anti").select("bins", "ratios", "lang", "source", "n_chars", F.xxhash64("bins", "ratios", "lang", "source", "n_chars").alias("print")))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        new = cut(_round(pool, state, sent, given))
        discard(state)
        sent.destroy()
        state, model = new, _model(new)
        if not state.select("added").first()["added"]:
            break
    discard(state, pool)
    chosen.destroy()
    return model


def _round(pool: DataFrame, state: DataFrame, model, given: int) -> DataFrame:
    """The state after a round: pseudo-labels from all of the pool join what is learned from, and both views are fitted again."""

    def decoded(cols):
        return [np.frombuffer(x, "<u2") for x in cols[0]], np.array([np.frombuffer(x, "<f4") for x in cols[1]], float).reshape(-1, RATIOS), list(zip(*cols[2:5], strict=True))

    def pick(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cols, prints = [c.to_pylist() for c in batch.columns], batch.column(5).to_numpy()
            view, y, at = [], [], []
            for k, own in enumerate(sure_of(model.value, *decoded(cols))):
                taken = model.value.taken[k]
                hit = np.array([i for i in np.flatnonzero(own >= 0).tolist() if prints[i] not in taken], np.int64)
                view.append(np.full(len(hit), k, np.int32))
                y.append(own[hit].astype(np.int32))
                at.append(hit)
            view, y, at = (np.concatenate(x) for x in (view, y, at))
            some = _drawn(view, y, prints[at], given)
            rest = batch.take(pa.array(at[some]))
            yield pa.RecordBatch.from_arrays([pa.array(view[some]), pa.array(y[some]), *rest.columns], [c.split()[0] for c in _GIVEN.split(", ")])

    def least(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([*(held.to_batches() if held is not None else ()), batch]).combine_chunks()
            view, y, prints = (held.column(k).to_numpy() for k in (0, 1, 7))
            held = held.take(pa.array(_drawn(view, y, prints, given)))
        if held is not None:
            yield from held.to_batches()

    def learn(batches):
        taught, parts = None, []
        for batch in batches:
            for data in batch.column("taught").to_pylist():
                taught = taught if data is None else pickle.loads(data)
            parts.append(batch.filter(batch.column("taught").is_null()).select([c.split()[0] for c in _GIVEN.split(", ")]))
        if taught is None:
            return
        rows = pa.Table.from_batches(parts)
        view, y, prints = (rows.column(k).to_numpy() for k in (0, 1, 7))
        at = _drawn(view, y, prints, given)
        taught.add(*decoded([c.to_pylist() for c in rows.take(pa.array(at)).columns[2:7]]), view[at], y[at])
        new = fitted(model.value.bins, taught)
        new.taken = tuple(old | set(prints[at][view[at] == k].tolist()) for k, old in enumerate(model.value.taken))  # a document teaches a view once
        yield _state(new, taught, len(at))

    none = [c.split() for c in _GIVEN.split(", ")]
    # one function, so one Python worker, for both
    drawn = pool.mapInArrow(lambda batches: least(pick(batches)), _GIVEN).repartition(16).mapInArrow(least, _GIVEN)
    drawn = drawn.select("*", F.lit(None).cast("binary").alias("taught"))
    old = state.select(*(F.lit(None).cast(kind).alias(c) for c, kind in none), "taught")
    return drawn.unionByName(old).repartition(1).mapInArrow(tidy(learn), "model binary, taught binary, added int")


def _state(model: CoTrained, taught: Taught, added: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary()), pa.array([pickle.dumps(taught)], pa.binary()), pa.array([added], pa.int32())], ["model", "taught", "added"])


def _model(state: DataFrame) -> CoTrained | None:
    found = state.select("model").collect()  # the weights of FEATURES bins and of the sample's metadata
    return pickle.loads(found[0]["model"]) if found else None


def _columns(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    col = lambda c, kind: (F.col(f"`{c}`") if c in have else F.lit(None)).cast(kind).alias(c)
    return docs.select(col("doc_id", "long"), col("text", "string"), col("lang", "string"), col("source", "string"), col("n_chars", "long"))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT, **bounds) -> DataFrame:
    """The columns of docs with text_score, metadata_score, quality_score (0 to 1) and keep (quality_score >= cut)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **bounds))  # FEATURES weights and those of metadata values of the samples
    added = ("text_score", "metadata_score", "quality_score", "keep")
    own = [c for c in docs.columns if c not in added]
    packed = docs.select(*(F.col(f"`{c}`") for c in own), *(F.lit(None).cast("double").alias(c) for c in added[:3]), F.lit(None).cast("boolean").alias("keep"))

    def score(batches):
        for batch in batches:
            for run in slices(batch, own.index("text"), STEP_BYTES):
                pick = lambda c: run.column(own.index(c)).to_pylist() if c in own else [None] * run.num_rows  # noqa: B023, E731
                if model.value is None:
                    found = [np.ones(run.num_rows)] * 3
                else:
                    found = model.value.scores(run.column(own.index("text")), pick("lang"), pick("source"), pick("n_chars"))
                yield pa.RecordBatch.from_arrays([*(run.column(k) for k in range(len(own))), *(pa.array(x) for x in found), pa.array(found[2] >= cut)], [*own, *added])

    return packed.mapInArrow(tidy(score), packed.schema)
