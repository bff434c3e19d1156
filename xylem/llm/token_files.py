"""Token-ID files: independent zstandard frames with a trailing seek table and a checksum for each frame.

A file holds the ids of documents in ascending doc_id order, unsigned
little-endian, two bytes each if the vocabulary allows, else four:

    frame ... frame | skippable frame 0x184D2A5D: the documents | skippable frame 0x184D2A5E: the seek table

The seek table is that of the zstandard seekable format: for each frame its
compressed size, its size and the low half of the XXH64 of its content; then
the number of frames, a descriptor and 0x8F92EAB1. Any zstandard tool reads
the file as a whole. The documents (also a zstandard frame, inside the
skippable one) are their ids and numbers of tokens, so a reader finds a
document's place and decompresses only the frames that hold it.

Nulls: a null text is empty, so the document has its end id only; rows with a
null doc_id come first. Repeated doc_ids stay, ordered by text. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xylem.llm.bpe import encoder
from xylem.llm.common import cut, doc_frame, shared_dir, slices, tidy

# Fixed values of the zstandard seekable format.
SEEK_FRAME, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
DOCS_FRAME = 0x184D2A5D
#: Bytes of ids in a frame.
FRAME_BYTES = 1 << 18
MANIFEST = "part int, path string, first_doc long, n_docs long, n_tokens long"


class TokenFileWriter:
    """Writes to a file object; add() documents in order, then close()."""

    def __init__(self, sink, width: int, level: int = 1, frame_bytes: int = FRAME_BYTES):
        self.sink, self.dtype, self.frame_bytes = sink, np.dtype(f"<u{width}"), frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.pending: list[bytes] = []
        self.pending_bytes = 0
        self.seek: list[tuple[int, int, int]] = []
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.docs.append(doc_ids.astype("<i8"))
        self.sizes.append(sizes.astype("<i8"))
        self.pending.append(ids.astype(self.dtype).tobytes())
        self.pending_bytes += len(self.pending[-1])
        if self.pending_bytes >= self.frame_bytes:
            data = memoryview(b"".join(self.pending))
            whole = len(data) - len(data) % self.frame_bytes
            for a in range(0, whole, self.frame_bytes):
                self._frame(data[a : a + self.frame_bytes])
            self.pending = [bytes(data[whole:])]
            self.pending_bytes = len(self.pending[0])

    def _frame(self, data) -> None:
        packed = self.zstd.compress(data)
        self.seek.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.sink.write(packed)

    def _skippable(self, magic: int, data: bytes) -> None:
        self.sink.write(struct.pack("<II", magic, len(data)) + data)

    def close(self) -> None:
        if self.pending_bytes:
            self._frame(b"".join(self.pending))
        docs, sizes = (np.concatenate(x) if x else np.empty(0, "<i8") for x in (self.docs, self.sizes))
        body = self.zstd.compress(np.diff(docs, prepend=0).astype("<i8").tobytes() + sizes.tobytes())
        self._skippable(DOCS_FRAME, struct.pack("<QI", len(docs), self.dtype.itemsize) + body)
        table = b"".join(struct.pack("<III", *x) for x in self.seek)
        table += struct.pack("<IBI", len(self.seek), CHECKSUM_FLAG, SEEK_MAGIC)
        self._skippable(SEEK_FRAME, table)


class TokenFileReader:
    """Reads a seekable file object; only the frames that hold the wanted documents are decompressed and checked."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2) or source.tell()
        source.seek(size - 9)
        count, flag, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("not a token file: it doesn't end with a seek table")
        start = size - 9 - 12 * count - 8
        source.seek(start)
        head = struct.unpack("<II", source.read(8))
        if head != (SEEK_FRAME, 12 * count + 9):
            raise ValueError("not a token file: its seek table has a wrong frame")
        table = np.frombuffer(source.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.packed_at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.plain_at = np.concatenate([[0], np.cumsum(table[:, 1])])
        self.checks = table[:, 2]
        source.seek(int(self.packed_at[-1]))
        magic, length = struct.unpack("<II", source.read(8))
        if magic != DOCS_FRAME:
            raise ValueError("not a token file: it has no list of documents")
        n, width = struct.unpack("<QI", source.read(12))
        self.zstd = zstandard.ZstdDecompressor()
        lists = np.frombuffer(self.zstd.decompress(source.read(length - 12)), "<i8")
        self.dtype = np.dtype(f"<u{width}")
        self.doc_ids, self.sizes = np.cumsum(lists[:n]), lists[n:]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.frames_read = 0

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.packed_at[k]))
        data = self.zstd.decompress(self.source.read(int(self.packed_at[k + 1] - self.packed_at[k])))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checks[k] or len(data) != self.plain_at[k + 1] - self.plain_at[k]:
            raise ValueError(f"frame {k} is damaged")
        self.frames_read += 1
        return data

    def tokens(self, start: int, length: int) -> np.ndarray:
        """Ids start to start + length of the file."""
        a, b = start * self.dtype.itemsize, (start + length) * self.dtype.itemsize
        if a == b:
            return np.empty(0, self.dtype)
        first, last = np.searchsorted(self.plain_at, [a, b - 1], "right") - 1
        data = b"".join(self.frame(k) for k in range(first, last + 1))
        return np.frombuffer(data, self.dtype)[(a - self.plain_at[first]) // self.dtype.itemsize :][:length]

    def documents(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        for wanted in doc_ids:
            for i in range(*np.searchsorted(self.doc_ids, [wanted, wanted + 1])):
                yield wanted, self.tokens(self.starts[i], self.sizes[i])

    def all(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All documents in runs: doc_ids, sizes, their ids end to end. Each frame is read once."""
        rest, first = np.empty(0, self.dtype), 0
        ends = self.starts + self.sizes
        for k in range(len(self.checks)):
            rest = np.concatenate([rest, np.frombuffer(self.frame(k), self.dtype)])
            upto = int(np.searchsorted(ends, self.plain_at[k + 1] // self.dtype.itemsize, "right"))
            if upto > first:
                n = int(self.sizes[first:upto].sum())
                yield self.doc_ids[first:upto], self.sizes[first:upto], rest[:n]
                rest, first = rest[n:], upto


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents into files below path (a new shared folder by default); gives the files' manifest, one row each.

    Range partitioning by doc_id orders the files; only texts are shuffled,
    never ids. A task writes under a name of its own and renames at its end,
    so tasks that are tried again leave one whole file each.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)

    def write(batches):
        coder, part = encoder(tokenizer, end_id), TaskContext.get().partitionId()
        fs, folder = _place(path)
        fs.create_dir(folder, recursive=True)
        final, temporary = f"{folder}/{part:06d}.ids.zst", f"{folder}/.{part:06d}-{uuid.uuid4().hex}"
        first, n, total = None, 0, 0
        with fs.open_output_stream(temporary) as sink:
            writer = TokenFileWriter(sink, 2 if coder.vocab_size <= 1 << 16 else 4)
            for batch in batches:
                for run in slices(batch):
                    ids, bounds = coder.encode(run.column(1))
                    doc_ids = run.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
                    first = doc_ids[0] if first is None else first
                    n, total = n + len(doc_ids), total + len(ids)
                    writer.add(doc_ids, ids, np.diff(bounds))
            writer.close()
        if n:
            fs.move(temporary, final)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [final if "://" not in path else f"{path}/{part:06d}.ids.zst"], "first_doc": [first], "n_docs": [n], "n_tokens": [total]}, pa.schema([("part", pa.int32()), ("path", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
        else:
            fs.delete_file(temporary)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = doc_frame(docs, id_col, text_col).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(rows.mapInArrow(tidy(write), MANIFEST))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""
    # one row for each file: the window's single partition is as small as the list of files
    placed = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = _place(file)
                with fs.open_input_file(name) as source:
                    for doc_ids, sizes, ids in TokenFileReader(source).all():
                        data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes)
                        crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(base + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        base += int(ends[-1])

    return placed.select("path", "base").repartition(parts, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
