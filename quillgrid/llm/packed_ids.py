"""Token ids in files of fixed-width bit packing, with random access.

A file holds blocks of ``BLOCK`` ids, each id in the fewest bits that number the vocabulary, in little-endian 64-bit words. Behind the
blocks stand the blocks' byte offsets, the documents' ids and token counts, and a trailer that tells where these begin. So the id at any
place is found from its block's offset and its place in the block, and a range of ids is unpacked by array operations alone.

A table is encoded in tasks that are ranges of ``doc_id``; each task writes files as it goes and returns a line of the manifest for each. A
file's name is drawn anew by each attempt and counts only by its line in the stored manifest, so that lost or repeated tasks leave at most
files that nothing names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.llm import bpe
from quillgrid.llm import textbytes as T
from quillgrid.llm.common import materialise, parts_of
from quillgrid.session import run_dir

BLOCK = 1 << 16
#: Ids of a file (some 128 MB at 16 bits); a task goes on with a new file at the next document.
FILE_IDS = 1 << 26
_MAGIC = b"QGIDS001"
#: Bits, ids a block, blocks, documents, ids, byte offset of the tables.
_TRAILER = struct.Struct("<6Q")
_NULL_ID = np.iinfo(np.int64).min


def width_of(vocabulary_size: int) -> int:
    """The fewest bits that tell so many ids apart."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids below ``2 ** bits`` (``bits`` up to 32) as 64-bit words, the first id in the lowest bits."""
    n = len(ids)
    rows = np.zeros((-(-n // 64), 64), np.uint64)
    rows.reshape(-1)[:n] = ids
    if n and int(rows.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    out = np.zeros((len(rows), bits), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        out[:, word] |= rows[:, i] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return out.reshape(-1)[:-(-n * bits // 64)].astype("<u8")


def unpack(words: np.ndarray, bits: int, start: int, stop: int) -> np.ndarray:
    """The ids from ``start`` to ``stop`` of packed words."""
    at = np.arange(start, stop, dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    padded = np.append(words, np.uint64(0)).astype(np.uint64)
    value = (padded[word] >> shift) | ((padded[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))
    return (value & np.uint64((1 << bits) - 1)).astype(np.uint32)


def open_folder(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a shared folder, given as a path or a URI."""
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")


class Writer:
    """One file, written block by block; memory holds one block and the documents' table."""

    def __init__(self, path: str, bits: int):
        fs, self.path = open_folder(path)
        fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(self.path)
        self.out.write(_MAGIC)
        self.bits, self.place, self.n_ids = bits, len(_MAGIC), 0
        self.offsets: list[int] = []
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.place)
        self._put(pack(ids, self.bits).tobytes())

    def add(self, docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their token counts, and all their ids in turn."""
        self.docs.append(docs)
        self.sizes.append(sizes)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK:
            ids = np.concatenate(self.held)
            whole = len(ids) // BLOCK * BLOCK
            for lo in range(0, whole, BLOCK):
                self._block(ids[lo:lo + BLOCK])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> int:
        """Write the tables; the number of documents."""
        if self.n_held:
            self._block(np.concatenate(self.held))
        docs, sizes = (np.concatenate([np.zeros(0, np.int64), *x]).astype("<i8") for x in (self.docs, self.sizes))
        tables = self.place
        self._put(np.array(self.offsets, "<u8").tobytes() + docs.tobytes() + sizes.tobytes())
        self._put(_TRAILER.pack(self.bits, BLOCK, len(self.offsets), len(docs), self.n_ids, tables))
        self.out.close()
        return len(docs)


class Reader:
    """A packed file: ``docs`` (the smallest 64-bit number for null), ``first`` (where each document's ids begin, and the end), ids by place."""

    def __init__(self, path: str):
        fs, self.path = open_folder(path)
        self.file = fs.open_input_file(self.path)
        size = self.file.size()
        if self.file.read_at(len(_MAGIC), 0) != _MAGIC:
            raise ValueError(f"not a file of packed ids: {path}")
        self.bits, self.block, blocks, n_docs, self.n_ids, at = _TRAILER.unpack(self.file.read_at(_TRAILER.size, size - _TRAILER.size))
        raw = self.file.read_at(8 * (blocks + 2 * n_docs), at)
        self.offsets = np.frombuffer(raw, "<u8", blocks).astype(np.int64)
        self.docs = np.frombuffer(raw, "<i8", n_docs, 8 * blocks)
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i8", n_docs, 8 * (blocks + n_docs)))])

    def close(self) -> None:
        self.file.close()

    def _read(self, block: int, start: int, stop: int) -> np.ndarray:
        """Ids of a block, reading the words that hold them alone."""
        lo, hi = start * self.bits // 64, -(-stop * self.bits // 64)
        words = np.frombuffer(self.file.read_at(8 * (hi - lo), int(self.offsets[block]) + 8 * lo), "<u8")
        shift = lo * 64
        if (start * self.bits - shift) % self.bits:  # the first word begins within an id
            words, shift = np.concatenate([np.zeros(lo, np.uint64), words]), 0
        return unpack(words, self.bits, start - shift // self.bits, stop - shift // self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from one place to another, over as many blocks as they take."""
        parts = [np.zeros(0, np.uint32)]
        while start < stop:
            block, within = divmod(start, self.block)
            n = min(stop - start, self.block - within)
            parts.append(self._read(block, within, within + n))
            start += n
        return np.concatenate(parts)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.ids(int(self.first[k]), int(self.first[k + 1]))

    def blocks(self) -> Iterator[np.ndarray]:
        """All ids, a block at a time."""
        for lo in range(0, self.n_ids, self.block):
            yield self.ids(lo, min(self.n_ids, lo + self.block))


class _Library:
    """The tokenizers library; strings of special tokens within a text are ordinary text."""

    def __init__(self, vocabulary: str):
        import public_tokenizers as P
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary if "/" in vocabulary else P.path(vocabulary))
        self.tokenizer.encode_special_tokens = True

    def encode_ordinary(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def library_encoder(vocabulary: str) -> str:
    """The name under which this process encodes by the tokenizers library."""
    name = f"{vocabulary}#library"
    if name not in bpe._encoders:
        bpe._encoders[name] = _Library(vocabulary)
    return name


def write(docs: DataFrame, folder: str, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """Encode ``docs`` (``doc_id, text``) into packed files in ``folder`` (a path or URI that all executors share), in ascending ``doc_id``.

    Returns the stored manifest ``part, seq, path, n_docs, n_ids``; files in the order of ``part, seq`` hold the documents in order. Each
    document's ids are followed by the end id. A null text counts as empty, a null id comes first, rows of one id come in the order of a
    hash of their text; an empty table gives no files. Other columns are ignored.
    """
    n = parts_of(docs.sparkSession)
    bits = width_of(_Library(vocabulary).tokenizer.get_vocab_size())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows of one id may be many; the text's hash and the row's own number let them part.
    order = [F.col("doc_id"), F.xxhash64("text").alias("_mix"), F.monotonically_increasing_id().alias("_row")]
    rows = rows.select(*order, "text").repartitionByRange(n, "doc_id", "_mix", "_row").sortWithinPartitions("doc_id", "_mix", "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part, seq, out = library_encoder(vocabulary), TaskContext.get().partitionId(), 0, None

        def done() -> pa.RecordBatch:
            many = out.close()
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "n_docs": many, "n_ids": out.n_ids}], schema=manifest)

        for batch in batches:
            doc = batch.column(0).fill_null(_NULL_ID).to_numpy()
            for lo, hi, buf, off in T.slices(batch.column(1), bpe.SLICE_BYTES):
                ids, first = bpe.encode(buf, off, name)
                ids = np.insert(ids, first[1:], bpe.END_ID)
                sizes = np.diff(first) + 1
                if out is None:
                    path = f"{folder}/part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.ids"
                    out = Writer(path, bits)
                out.add(doc[lo:hi], sizes, ids)
                if out.n_ids >= FILE_IDS:
                    yield done()
                    seq, out = seq + 1, None
        if out is not None:
            yield done()

    manifest = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    listed = rows.select("doc_id", "text").mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long")
    return materialise(listed, "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of the manifest's files, read from them block by block."""
    # One row a file: the sums before each are a running total over the manifest alone.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "base")
    files = files.repartition(parts_of(manifest.sparkSession), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = Reader(path)
                n = len(file.docs)
                crc = np.zeros(n, np.int64)
                at = k = 0
                for ids in file.blocks():
                    data = memoryview(ids.astype("<u4").tobytes())
                    lo = at
                    at += len(ids)
                    while k < n:
                        begin, stop = max(int(file.first[k]), lo), min(int(file.first[k + 1]), at)
                        crc[k] = zlib.crc32(data[4 * (begin - lo):4 * (stop - lo)], int(crc[k]))
                        if file.first[k + 1] > at:
                            break
                        k += 1
                file.close()
                docs = pa.array(file.docs, mask=file.docs == _NULL_ID)
                table = pa.table({"doc_id": docs, "start": file.first[:-1] + base, "n_tokens": np.diff(file.first), "ids_crc32": crc})
                yield from table.to_batches(max_chunksize=20_000)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, folder: str | None = None, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """Write ``docs`` into packed files and tell, from the files, each document's place, number of ids and their checksum."""
    spark: SparkSession = docs.sparkSession
    return read(write(docs, folder or run_dir(spark, "packed-ids"), vocabulary))
