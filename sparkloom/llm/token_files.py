"""Token-id files: groups of independently coded, checksummed blocks.

A file is a row of groups.  A group holds a zlib-packed table of its documents
(id and number of ids; a document that does not fit continues in the next
group), the prior from which its blocks start, and up to ``LANES`` blocks coded
by :mod:`sparkloom.llm.rangecoder`.  Each block carries its length and the
CRC-32 of its ids, and table and prior carry one of their own, so damage is
found, and that of a block is confined to it.

Rows go to files in ascending order of doc_id (null first, equal ids by the
hash of their text).  Defined cases: a null or empty text has only the end id;
any length is written whole; repeated rows are written each; an id that the
coder cannot hold is an error before anything is written; an empty table writes
no file and reads back as no rows; further columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm import bpe, rangecoder, storage
from sparkloom.runtime import materialize, shared_path, ship

MAGIC = b"SLTK0002"
LANES, GROUP_IDS, LEAST_BLOCK = 1024, 8_000_000, 1024
FILE_IDS = 64_000_000
#: Rows, bytes and CRC-32 of the table, nibbles of an id, bytes and CRC-32 of the prior, blocks.
_GROUP, _BLOCK = struct.Struct("<IIIIIII"), struct.Struct("<III")


class TokenFileError(ValueError):
    pass


def write_group(out, table: np.ndarray, ids: np.ndarray) -> None:
    """``table``: rows of (doc_id, is_null, n_ids, continues)."""
    levels = rangecoder.nibbles(int(ids.max(initial=0)))
    packed = zlib.compress(table.astype("<i8").tobytes(), 6)
    prior = rangecoder.prior_of(ids, levels)
    start = b"" if prior is None else zlib.compress(prior.astype("<i2").tobytes(), 6)
    n = max(1, min(LANES, -(-len(ids) // LEAST_BLOCK))) if len(ids) else 0
    blocks = np.array_split(ids, n) if n else []
    out.write(_GROUP.pack(len(table), len(packed), zlib.crc32(packed), levels, len(start), zlib.crc32(start), n))
    out.write(packed + start)
    for block, coded in zip(blocks, rangecoder.encode_blocks(blocks, levels, prior), strict=True):
        out.write(_BLOCK.pack(len(block), len(coded), zlib.crc32(block.astype("<u4").tobytes())))
        out.write(coded)


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise TokenFileError("the file ends early")
    return data


def read_groups(stream) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(table, ids) of each group, verified."""
    if _exactly(stream, len(MAGIC)) != MAGIC:
        raise TokenFileError("not a token file")
    while head := stream.read(_GROUP.size):
        if len(head) != _GROUP.size:
            raise TokenFileError("the file ends early")
        rows, size, crc, levels, start_size, start_crc, n = _GROUP.unpack(head)
        packed = _exactly(stream, size)
        if zlib.crc32(packed) != crc:
            raise TokenFileError("a document table is damaged")
        start = _exactly(stream, start_size)
        if zlib.crc32(start) != start_crc or not 4 <= levels <= 7:
            raise TokenFileError("a prior is damaged")
        prior = np.frombuffer(zlib.decompress(start), "<i2").reshape(-1, 17) if start else None
        table = np.frombuffer(zlib.decompress(packed), "<i8").reshape(rows, 4)
        coded, lengths, crcs = [], [], []
        for _ in range(n):
            length, size, crc = _BLOCK.unpack(_exactly(stream, _BLOCK.size))
            coded.append(_exactly(stream, size))
            lengths.append(length)
            crcs.append(crc)
        try:
            blocks = rangecoder.decode_blocks(coded, lengths, levels, prior)
        except IndexError as beyond:  # the damage asks for more than a block has
            raise TokenFileError("a block is damaged") from beyond
        for block, crc in zip(blocks, crcs, strict=True):
            if zlib.crc32(block.astype("<u4").tobytes()) != crc:
                raise TokenFileError("a block is damaged")
        yield table, np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)


class _Writer:
    """Gathers documents into groups and groups into files."""

    def __init__(self, folder: str, part: int):
        self.folder, self.part, self.seq = folder, part, 0
        self.out = self.uri = None
        self.done: list[tuple] = []
        self._fresh_group()
        self.ids = 0

    def _fresh_group(self) -> None:
        self.rows: list[tuple[int, int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        while True:
            now = ids[: GROUP_IDS - self.n_held]
            ids = ids[len(now) :]
            self.rows.append((doc_id or 0, doc_id is None, len(now), len(ids) > 0))
            self.held.append(now)
            self.n_held += len(now)
            if self.n_held >= GROUP_IDS:
                self._flush()
            if not len(ids):
                if self.ids + self.n_held >= FILE_IDS:
                    self.close()
                return

    def _flush(self) -> None:
        if self.rows:
            if self.out is None:
                self.uri, self.out = storage.create(self.folder, f"ids-{self.part:06d}-{self.seq:06d}", ".sltk")
                self.out.write(MAGIC)
            write_group(self.out, np.array(self.rows, np.int64), np.concatenate(self.held))
            self.ids += self.n_held
            self._fresh_group()

    def close(self) -> None:
        self._flush()
        if self.out is not None:
            self.out.close()
            self.done.append((self.part, self.seq, self.uri, self.ids))
            self.seq, self.out, self.ids = self.seq + 1, None, 0


def write_ids(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` into files; their list (part, seq, uri, n_ids) is stored."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_path(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = bpe.LibraryEncoder(path), end_id.to_bytes(4, "little")
        writer = _Writer(folder, TaskContext.get().partitionId())
        for batch in batches:
            doc_ids, done = batch.column("doc_id").to_pylist(), 0
            for run in bpe.runs(batch.column("text")):
                for doc_id, coded in zip(doc_ids[done : done + len(run)], encoder.encode(run), strict=True):
                    writer.add(doc_id, np.frombuffer(coded + end, "<u4"))
                done += len(run)
        writer.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "uri", "n_ids"), d, strict=True)) for d in writer.done], schema=_FILES)

    ordered = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return materialize(ordered.mapInArrow(write, "part int, seq int, uri string, n_ids long"), "token-file-list")


_FILES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("n_ids", pa.int64())])


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone.

    ``files`` has one row for each file, so the sum over all of them stays small.
    """
    ship(files.sparkSession)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    placed = materialize(placed, "token-file-starts")
    n = max(1, placed.count())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with storage.read(row["uri"]) as stream:
                    start, n, crc, out = row["first"], 0, 0, []
                    for table, ids in read_groups(stream):
                        at = 0
                        for doc_id, is_null, length, goes_on in table.tolist():
                            crc = zlib.crc32(ids[at : at + length].astype("<u4").tobytes(), crc)
                            at, n = at + length, n + length
                            if not goes_on:
                                out.append((None if is_null else doc_id, start, n, crc))
                                start, n, crc = start + n, 0, 0
                        yield _documents(out)
                        out = []

    shape = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return placed.repartition(n, "uri").select("uri", "first").mapInArrow(scan, shape)


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


