"""Token ids as binary files: each id in the fewest bits that hold the vocabulary, blocks found by offsets.

A file, integers little-endian::

    magic 8 bytes | blocks of packed ids | document ids int64[n_docs] | first id of each document int64[n_docs + 1]
    | byte offset of each block int64[n_blocks + 1] | bits, n_docs, n_blocks, ids per block int64 | place of tables int64

Every block but the last holds the same number of ids, a multiple of 8, so blocks end on whole bytes and any document is
read by seeking to the blocks it lies in. A null document id is written as the least int64.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tokens import STEP, encoder

MAGIC = b"IDBITS01"
#: Fixed value of a null document id in files.
NO_ID = -(2**63)
#: Ids of a block.
BLOCK = 1 << 16
#: Characters that deal rows of one document id to several files.
HEAD = 16

WRITTEN = "part int, path string, n_docs bigint, n_ids bigint"
INDEX = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Unsigned 32-bit ids to ``bits`` bits each, lowest bit first: 64 ids at a time fill ``bits`` words of 64 bits."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    padded = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    padded.ravel()[: len(ids)] = ids
    words = np.zeros((len(padded), bits), "<u8")
    for i, word, shift in _places(bits):
        words[:, word] |= padded[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= padded[:, i] >> np.uint64(64 - shift)
    return words.tobytes()[: -(-len(ids) * bits // 8)]


def unpack_bits(packed: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", n).astype("<u4")
    rows = -(-n // 64)
    words = np.frombuffer(packed.ljust(8 * bits * rows, b"\0"), "<u8", bits * rows).reshape(rows, bits)
    ids = np.empty((rows, 64), np.uint64)
    for i, word, shift in _places(bits):
        ids[:, i] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            ids[:, i] |= words[:, word + 1] << np.uint64(64 - shift)
    return (ids.ravel()[:n] & np.uint64((1 << bits) - 1)).astype("<u4")


def _places(bits: int) -> Iterator[tuple[int, int, int]]:
    """Word and shift of each of 64 ids."""
    return ((i, i * bits // 64, i * bits % 64) for i in range(64))


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


class Writer:
    """Writes one file; holds no more than a block of ids and the index of its documents."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, len(MAGIC)
        self.docs: list[int] = []
        self.first, self.blocks = [0], [self.at]
        self.waiting: list[np.ndarray] = []
        self.held = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.first.append(self.first[-1] + len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        """Write the first ``n`` of the ids that wait, put together once."""
        ids = np.concatenate(self.waiting)
        for at in range(0, n, BLOCK):
            self._block(ids[at : min(at + BLOCK, n)])
        self.waiting, self.held = [ids[n:].copy()], len(ids) - n

    def _block(self, ids: np.ndarray) -> None:
        packed = pack_bits(ids, self.bits)
        self.out.write(packed)
        self.at += len(packed)
        self.blocks.append(self.at)

    def close(self) -> tuple[int, int]:
        if self.held:
            self._flush(self.held)
        for numbers in (self.docs, self.first, self.blocks, [self.bits, len(self.docs), len(self.blocks) - 1, BLOCK, self.at]):
            self.out.write(np.array(numbers, "<i8").tobytes())
        return len(self.docs), self.first[-1]


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a file of packed ids")
        source.seek(size - 40)
        self.bits, n_docs, n_blocks, self.block, at = np.frombuffer(source.read(40), "<i8").tolist()
        source.seek(at)
        tables = np.frombuffer(source.read(8 * (2 * n_docs + n_blocks + 2)), "<i8")
        self.docs, self.first = tables[:n_docs], tables[n_docs : 2 * n_docs + 1]
        self.blocks = tables[2 * n_docs + 1 :]
        self._last: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))

    def _ids_of_block(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            self.source.seek(int(self.blocks[k]))
            packed = self.source.read(int(self.blocks[k + 1] - self.blocks[k]))
            n = min(self.block, int(self.first[-1]) - k * self.block)
            self._last = (k, unpack_bits(packed, n, self.bits))
        return self._last[1]

    def pieces(self, number: int) -> Iterator[np.ndarray]:
        """Ids of the document with this number in the file, a block's share at a time."""
        at, end = int(self.first[number]), int(self.first[number + 1])
        while at < end:
            k = at // self.block
            stop = min(end, (k + 1) * self.block)
            yield self._ids_of_block(k)[at - k * self.block : stop - k * self.block]
            at = stop

    def document(self, number: int) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint32), *self.pieces(number)])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text", special: bool = False) -> DataFrame:
    """Encode whole texts and write their ids, each document followed by ``end_id``, in ascending ``doc_id`` order.

    The documents are dealt by ranges of ``doc_id`` and the first HEAD characters, so that a doc_id which many rows share is cut
    too; each task sorts its range and writes one file under a name of its own, so a repeated or second attempt harms nothing:
    only the files named in the result count. Lazy; one row per file (``part``, ``path``, ``n_docs``, ``n_ids``). Null text
    counts as empty and gives just ``end_id``; a null ``doc_id`` comes first; equal ids follow each other by text. No documents give no files. ``folder`` must be one that all executors reach.
    ``special`` is that of ``Encoder``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, special)
        bits = bits_for(max(encode.vocabulary, end_id + 1))
        end = np.array([end_id], np.uint32)
        part = TaskContext.get().partitionId()
        store, root = _store(folder)
        path, out = f"{root}/ids-{part:06d}-{uuid.uuid4().hex}.bin", None
        for batch in batches:
            for first in range(0, batch.num_rows, STEP):
                rows = batch.slice(first, STEP)
                texts = rows.column(1).to_pylist()
                for doc_id, ids in zip(rows.column(0).to_pylist(), encode.encode_all(texts), strict=True):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(path)
                        writer = Writer(out, bits)
                    writer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
        if out is not None:
            n_docs, n_ids = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]}
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), docs[text].alias("_text"), F.substring(docs[text], 1, HEAD).alias("_head"))
    ordered = rows.repartitionByRange("doc_id", "_head").sortWithinPartitions("doc_id", "_text").select("doc_id", "_text")
    return ordered.mapInArrow(write, WRITTEN)


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Read every document of the files back: its place, length and crc32 of its ids as unsigned 32-bit integers.

    ``files`` is a written result of ``write_token_files``. ``start`` counts the ids of all documents before it, over all
    files in order of ``part``; each file's row brings the count of the files before it, so nothing is joined to what is read.
    There are as many reading tasks as files.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("file_start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    reader = Reader(source)
                    for at in range(0, len(reader.docs), 4096):
                        yield _index(reader, start, at, min(at + 4096, len(reader.docs)))

    # With the number given, the table of a few rows isn't put into one partition.
    return placed.repartition(max(1, files.count())).mapInArrow(read, INDEX)


def _index(reader: Reader, start: int, at: int, end: int) -> pa.RecordBatch:
    sums = []
    for number in range(at, end):
        crc = 0
        for ids in reader.pieces(number):
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"), crc)
        sums.append(crc)
    docs, first = reader.docs[at:end], reader.first[at : end + 1]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(docs, pa.int64(), mask=docs == NO_ID),
            pa.array(first[:-1] + start, pa.int64()),
            pa.array(np.diff(first), pa.int64()),
            pa.array(sums, pa.int64()),
        ],
        ["doc_id", "start", "n_tokens", "ids_crc32"],
    )
