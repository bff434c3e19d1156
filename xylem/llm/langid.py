"""Language ID by rank-order profiles of character n-grams (Cavnar and Trenkle, 1994).

Texts are lower-cased; characters that are no letters become spaces and runs
of spaces one. A profile is the most frequent 1- to 3-grams in order. A text's
distance to a language is, over the text's own most frequent n-grams, the sum
of how far each is out of place in the language's profile, and PROFILE for
those that it lacks. The least distance wins; ties go to the lesser name.

Profiles come from a bounded sample of the learning rows: PER_LANGUAGE texts
of each language at most, those with the least hash of doc_id. Their n-grams
are counted in tasks. Learning and prediction read whole texts.

Nulls: a null text, or one without a letter, is `und` with score 0. A null
lang teaches nothing. Without learning rows everything is `und`. Repeated rows
are each predicted. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import slices

PROFILE = 400
PER_LANGUAGE = 300
UND = "und"


def _tables() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


_TABLE: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """The code points that n-grams are taken from: lower-case letters, single spaces between, before and after words."""
    if not _TABLE:
        _TABLE.append(_tables())
    points = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    points = np.concatenate([[np.uint32(32)], points, [np.uint32(32)]])
    space = points == 32
    return points[~(space & np.append(False, space[:-1]))]


def ngrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of 1- to 3-grams and how often each is there. A lone space is no n-gram, nor has one a space inside."""
    p = points.astype(np.uint64)
    one = p[p != 32]
    two = (p[:-1] << np.uint64(21)) | p[1:]
    three = (two[:-1] << np.uint64(21)) | p[2:] if len(p) > 2 else np.empty(0, np.uint64)
    three = three[p[1:-1] != 32] if len(three) else three
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of several texts as one."""
    codes, at = np.unique(np.concatenate([c for c, _ in counts]), return_inverse=True)
    n = np.zeros(len(codes), np.int64)
    np.add.at(n, at, np.concatenate([k for _, k in counts]))
    return codes, n


def most_frequent(codes: np.ndarray, n: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order; ties by code."""
    if len(codes) > most:
        least = np.partition(n, len(n) - most)[len(n) - most]
        codes, n = codes[n >= least], n[n >= least]
    return codes[np.lexsort((codes, -n))][:most]


def top_ngrams(points: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """Codes of the most frequent 1- to 3-grams of a text in order."""
    return most_frequent(*ngrams(points), most)


class Profiles:
    """Profiles of languages, and the distances of texts to them."""

    def __init__(self, ranked: dict[str, np.ndarray]):
        self.languages = sorted(ranked)
        codes = [ranked[k] for k in self.languages]
        self.codes = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.uint64)
        self.ranks = np.full((len(self.codes) + 1, len(codes)), -1, np.int64)  # the last row: n-grams that no language has
        for k, one in enumerate(codes):
            self.ranks[np.searchsorted(self.codes, one), k] = np.arange(len(one))

    @classmethod
    def learn(cls, texts: list[tuple[str, str]], most: int = PROFILE) -> Profiles:
        by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in texts:
            by.setdefault(lang, []).append(ngrams(letters(text)))
        return cls({k: top for k, v in by.items() if len(top := most_frequent(*summed(v), most))})

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and, from 0 to 1, how much nearer it is than the next one (with one language: than nothing in common)."""
        if not text or not self.languages:
            return UND, 0.0
        points = letters(text)
        if len(points) < 2:
            return UND, 0.0
        own = top_ngrams(points)
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        rank = self.ranks[at]
        far = np.where(rank < 0, PROFILE, np.abs(rank - np.arange(len(own))[:, None])).sum(0)
        best = int(np.argmin(far))
        other = min((int(x) for k, x in enumerate(far) if k != best), default=PROFILE * len(own))
        return self.languages[best], 0.0 if not other else round(1 - int(far[best]) / other, 6)


def learned(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles of at most per_language rows of each language, the least hashes of doc_id first.

    Each task keeps so many rows of a language, then each of 64 does, then each
    language does: no task sees more than 64 times as many of one.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"), "text")

    def keep(batches):
        kept: dict[str, list] = {}
        for batch in batches:
            order = pc.sort_indices(batch.column(1)).to_numpy()
            langs, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            fresh: dict[str, int] = {}
            for i in order.tolist():
                if (n := fresh.get(langs[i], 0)) < per_language:
                    fresh[langs[i]] = n + 1
                    kept.setdefault(langs[i], []).append((hashes[i], batch.column(2)[i].as_py()))
            kept = {k: sorted(v)[:per_language] for k, v in kept.items()}
        for k, v in sorted(kept.items()):
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v)), pa.array([h for h, _ in v], pa.int64()), pa.array([t for _, t in v])], ["lang", "h", "text"])

    def profile(batches):
        # rows come by language, the least hashes first
        lang, n, counts = None, 0, []

        def ended():
            top = most_frequent(*counts[0]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([top.tolist()], pa.list_(pa.int64()))], ["lang", "codes"])

        for batch in batches:
            for own, text in zip(batch.column(0), batch.column(2), strict=True):
                if own.as_py() != lang:
                    if counts:
                        yield ended()
                    lang, n, counts = own.as_py(), 0, []
                if n < per_language:
                    n += 1
                    counts = [summed([*counts, ngrams(letters(text.as_py()))])]
        if counts:
            yield ended()

    schema = "lang string, h long, text string"
    some = rows.mapInArrow(keep, schema).repartition(64).mapInArrow(keep, schema).repartition(16, "lang").sortWithinPartitions("lang", "h", "text")
    # PROFILE n-grams of each language
    found = some.select("lang", "h", "text").mapInArrow(profile, "lang string, codes array<long>").collect()
    return Profiles({r["lang"]: np.array(r["codes"], np.int64).view(np.uint64) for r in found if r["codes"]})


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, learn: Callable[[str], Column] | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document. Only rows that aren't held out are learned from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang"))
    held = F.coalesce(held_out(), F.lit(False))
    profiles = learned(docs, learn("doc_id") if learn else ~held, per_language)
    sent = docs.sparkSession.sparkContext.broadcast(profiles)  # PROFILE n-grams of each language at most

    def predict(batches):
        for batch in batches:
            for run in slices(batch):
                found = [sent.value.predict(t) for t in run.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([run.column(0), run.column(2), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")

