"""Byte-level BPE of whole texts with the tokenizers library, which encodes each distinct word of a batch once.

The vocabulary's pre-tokeniser never joins a space to what stands before it,
except inside a run of white space. So a text may be cut before each space
whose neighbours aren't both white space: the ids of the parts, end to end,
are the ids of the text. Texts with other spaces are encoded in one piece, and
so are texts that hold an added token such as <|endoftext|>: the library takes
these out of the text first, so that what stands before one ends there.
"""

from __future__ import annotations

import os
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from xylem.llm.common import ragged

# a task has one core: the library's own threads only add to its CPU time and memory
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WHITE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
#: A space between white space, or between white space and the end.
UNSAFE = rf"{WHITE} (?:{WHITE}|$)"
#: White space at an end of a word.
EDGED = rf"^{WHITE}|{WHITE}$"
#: What stands for a space in the vocabulary's tokens.
SPACE = "Ġ"
#: Words that a worker remembers, about 200 MB; beyond it, those met once are forgotten.
REMEMBERED = 1_000_000


def byte_strings(column: pa.Array) -> list[bytes]:
    """The UTF-8 of strings, much quicker than to_pylist()."""
    return column.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


class WordCachedEncoder:
    """encode() gives the ids that Tokenizer.encode(text, add_special_tokens=False) gives, each text followed by end_id.

    special_as_text sets the library's encode_special_tokens: special tokens in a text are then text like any other.
    """

    def __init__(self, path: str, end_id: int | None = 0, remembered: int = REMEMBERED, special_as_text: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (t.special and special_as_text)]
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.end_id, self.remembered = end_id, remembered
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True
        self._forget()

    def _forget(self, words: list[bytes] = ()) -> None:
        """Forget words that were met once and aren't among these."""
        kept = {w: self.known[w] for w in words if w in self.known}
        if words:
            again = self.again[np.fromiter(self.known.values(), np.int64, len(self.known))]
            if np.count_nonzero(again) < self.remembered // 2:
                kept |= compress(self.known.items(), again.tolist())
        at = np.array([0, *kept.values()], np.int64)
        starts, sizes = (self.starts[at], self.lengths[at]) if words else (None, None)
        flat = self.ids[ragged(starts, sizes)] if words else None
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)
        self.used = self.count = 0
        if words:
            self._append(flat, sizes)
            self.known = {w: k + 1 for k, w in enumerate(kept)}
        else:
            self._store([[] if self.end_id is None else [self.end_id]])  # entry 0

    def _store(self, lists: list[list[int]]) -> int:
        """Keep lists of ids; gives the entry of the first."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return self._append(np.fromiter((x for y in lists for x in y), np.uint32, int(sizes.sum())), sizes)

    def _append(self, flat: np.ndarray, sizes: np.ndarray) -> int:
        first, n = self.count, len(sizes)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + n > len(self.starts):
            self.starts, self.lengths, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.again))
        self.ids[self.used : self.used + len(flat)] = flat
        self.again[first : first + n] = False
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.lengths[first : first + n] = sizes
        self.used += len(flat)
        self.count += n
        return first

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Encode new words with a space before them; gives their entries. Those without white space at an end go many to a call: only their first ids begin with a space."""
        odd = pc.or_(pc.match_substring_regex(words, EDGED), pc.equal(pc.binary_length(words), 0))
        entry = np.empty(len(words), np.int64)
        for mask, joined in ((pc.invert(odd), True), (odd, False)):
            some = byte_strings(words.filter(mask))
            if not some:
                continue
            if joined:
                lines = [b" ".join([b"", *some[i : i + 1000]]).decode() for i in range(0, len(some), 1000)]
                flat = np.concatenate([np.array(x, np.uint32) for x in self._encode(lines)])
                at = self._append(flat, np.diff(np.append(np.flatnonzero(self.spaced[flat]), len(flat))))
            else:
                at = self._store(self._encode([f" {w.decode()}" for w in some]))
            entry[mask.to_numpy(zero_copy_only=False)] = range(at, at + len(some))
            self.known.update(zip(some, range(at, at + len(some)), strict=True))
        return entry

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end as uint32, and where each text's begin (one more for the end). Null is empty."""
        n = len(texts)
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        unsafe = pc.match_substring_regex(texts, UNSAFE)
        for token in self.added:
            unsafe = pc.or_(unsafe, pc.match_substring(texts, token))
        parts = pc.split_pattern(pc.if_else(unsafe, "", texts), " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        words = byte_strings(coded.dictionary)
        if len(self.known) + len(words) + n > self.remembered:
            self._forget(words)
        entry = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        self.again[entry[entry >= 0]] = True
        if (new := entry < 0).any():
            entry[new] = self._learn(coded.dictionary.filter(pa.array(new)))
        heads = pc.if_else(unsafe, texts, pc.list_element(parts, 0)).to_pylist()
        mark, used = self.count, self.used
        first = self._store(self._encode(heads))
        # this run's own words, then the end, then the heads: small beside all words, so taking from them is quick
        own = np.concatenate([entry, [0], np.arange(first, first + n)])
        sizes = self.lengths[own]
        flat = self.ids[ragged(self.starts[own], sizes)]
        self.count, self.used = mark, used  # heads aren't kept
        lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(np.concatenate([[0], 4 * np.cumsum(sizes)])), pa.py_buffer(flat)])
        row = np.arange(n, dtype=np.int32)
        seq = np.insert(coded.indices.to_numpy(), bounds[1:], np.int32(len(entry)))
        seq[bounds[:-1] + row] = len(entry) + 1 + row
        taken = lists.take(pa.array(seq))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(seq) + 1] // 4
        ids = np.frombuffer(taken.buffers()[2] or b"", np.uint32)[: ends[-1]]
        return ids, ends[np.append(bounds[:-1] + row, len(seq))]


_ENCODERS: dict[tuple, WordCachedEncoder] = {}


def encoder(path: str, end_id: int | None = 0, remembered: int = REMEMBERED) -> WordCachedEncoder:
    """This Python worker's encoder of a vocabulary file: plain Tokenizer.encode, where special tokens in a text are themselves."""
    key = path, end_id, remembered
    if key not in _ENCODERS:
        _ENCODERS[key] = WordCachedEncoder(path, end_id, remembered, special_as_text=False)
    return _ENCODERS[key]
