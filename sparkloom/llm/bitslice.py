"""Exact top-k inner products over a bit-sliced index.

A block of the index holds the quantised attributes of its rows as bitmaps,
one for each bit of each attribute.  For a query, the bitmaps are added into
the bits of the score by carry-save adders, 64 rows to a word; a negative
weight adds the complement.  The best rows are then found from the most
significant slice of the score downward, and the rows that tie at the border
are resolved exactly, smaller ids first (rows of a block are in id order).

The index is built once and stored: blocks of bitmaps, dealt to parts.  The
queries are read out of it, so a query knows its own place and leaves out that
row alone, and they travel to the parts, not the index to them.  Each task
keeps the best rows of its part for a query before those of all parts are
merged by rank.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; an empty vector has the score 0 with all;
missing trailing components count as 0, and vectors of any length are used
whole; repeated rows all take part, as queries and as candidates, also of their
equals; ties go to the smaller id; an empty table gives no rows; further
columns are not read.  Components are floor(scale * x) as longs; one that no
long holds is an error, as is a score among the best that no long holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.runtime import materialize, ship

BLOCK_ROWS = 32768
#: Most blocks of a part: what one task works on, and how often a query is sent.
PART_BLOCKS = 8
#: Short bitmaps cost as many steps as long ones, so small tables have few parts and deal their queries to several tasks.
LEAST_ROWS, ASKED_ROWS, MOST_GROUPS = 16384, 128, 64


def quantise(vector: Column, scale: int = 64) -> Column:
    """array<long>, or null for vectors that take no part."""
    fine = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= F.lit(1.7976931348623157e308))), F.lit(False))
    level = lambda x: F.floor(x.cast("double") * scale)
    # Beyond the range a cast would saturate in silence.
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < F.lit(2.0**63))
    return F.when(fine, F.when(fits, F.transform(vector, level)).otherwise(F.raise_error(F.lit("a vector component does not fit a long")).cast("array<bigint>")))


def slice_rows(values: np.ndarray) -> tuple[np.ndarray, int]:
    """(bitmaps[dim, bit, word], bias) of values + bias >= 0."""
    n, dims = values.shape
    bias = max(0, -int(values.min(initial=0)))
    shifted = values.view(np.uint64) + np.uint64(bias)  # of the range of two longs, so without overflow
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    planes = np.zeros((dims, bits, -(-n // 64) * 8), np.uint8)
    for j in range(bits):
        packed = np.packbits(((shifted >> np.uint64(j)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        planes[:, j, : packed.shape[1]] = packed
    return planes.view("<u8"), bias


def rows_of(planes: np.ndarray, bias: int, at: np.ndarray) -> np.ndarray:
    """The values of the rows at some positions; the inverse of :func:`slice_rows`."""
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros((len(at), planes.shape[0]), np.uint64)
    for j in range(planes.shape[1]):
        out |= ((planes[:, j][:, word] >> bit) & np.uint64(1)).T << np.uint64(j)
    return (out - np.uint64(bias)).view(np.int64)


def add_slices(planes: np.ndarray, flipped: np.ndarray, weights: list[int]) -> tuple[list[np.ndarray], int]:
    """(bits of the sum from the lowest up, constant): score = sum - constant, before the bias."""
    bits = planes.shape[1]
    stacks: dict[int, list[np.ndarray]] = {}
    constant = 0
    picks: dict[int, tuple[list[int], list[int]]] = {}
    for d, w in enumerate(weights):
        if w < 0:
            constant += -w * ((1 << bits) - 1)
        for i in range(abs(w).bit_length()):
            if abs(w) >> i & 1:
                picks.setdefault(i, ([], []))[w < 0].append(d)
    for i, (plus, minus) in picks.items():
        for j in range(bits):
            if plus:
                stacks.setdefault(i + j, []).append(planes[plus, j])
            if minus:
                stacks.setdefault(i + j, []).append(flipped[minus, j])
    out: list[np.ndarray] = []
    empty = np.zeros(planes.shape[2], np.uint64)
    p = 0
    while stacks:
        rows = stacks.pop(p, [])
        if not rows:
            out.append(empty)
            p += 1
            continue
        x = np.concatenate(rows)
        above = stacks.setdefault(p + 1, [])
        while len(x) > 2:
            k = len(x) // 3
            a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
            half = a ^ b
            above.append((a & b) | (half & c))
            x = np.concatenate([half ^ c, x[3 * k :]])
        if len(x) == 2:
            above.append((x[0] & x[1])[None])
            x = (x[0] ^ x[1])[None]
        if not above:
            del stacks[p + 1]
        out.append(x[0])
        p += 1
    return out, constant


def best_rows(score: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores among the allowed bits; ties to lower positions."""
    count = lambda x: int(np.bitwise_count(x).sum())
    sure, maybe, n_sure = np.zeros_like(allowed), allowed, 0
    for s in reversed(score):
        x = maybe & s
        n = count(x)
        if n_sure + n > k:
            maybe = x
            continue
        sure, n_sure, maybe = sure | x, n_sure + n, maybe & ~s
        if n_sure == k:
            break
    at = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    if n_sure < k:
        rest = np.flatnonzero(np.unpackbits(maybe.view(np.uint8), bitorder="little"))
        at = np.concatenate([at, rest[: k - n_sure]])
    return at


def _dense(lists: pa.ListArray, dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims), np.int64)
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    for i in range(len(lists)):
        row = flat[ends[i] : ends[i + 1]]
        out[i, : len(row)] = row
    return out


_BLOCK = pa.schema([("part", pa.int64()), ("no", pa.int64()), ("dims", pa.int32()), ("bits", pa.int32()), ("bias", pa.string()), ("ids", pa.binary()), ("asks", pa.binary()), ("planes", pa.binary())])
_BLOCK_DDL = "part long, no long, dims int, bits int, bias string, ids binary, asks binary, planes binary"
_ASKED = pa.schema([("q_no", pa.int64()), ("q_dims", pa.int32()), ("q_at", pa.binary()), ("q_ids", pa.binary()), ("q_values", pa.binary())])
_ASKED_DDL = "q_no long, q_dims int, q_at binary, q_ids binary, q_values binary"
_FOUND = pa.schema([("q_no", pa.int64()), ("q_at", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _planes(row: dict) -> np.ndarray:
    return np.frombuffer(row["planes"], "<u8").reshape(row["dims"], row["bits"], -1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield {c: batch.column(c)[r].as_py() for c in batch.schema.names}


def build(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """The stored index of ``rows(vec_id, q, asks)``, the number of its parts, and that of the groups of queries.

    A block's number holds its partition and its place there, so no two agree.
    """
    spark = rows.sparkSession
    n, tasks = rows.count(), 3 * spark.sparkContext.defaultParallelism
    size = min(PART_BLOCKS * BLOCK_ROWS, max(LEAST_ROWS, -(-n // tasks)))
    parts = max(1, -(-n // size))
    groups = min(MOST_GROUPS, -(-tasks // parts))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, count, seq = TaskContext.get().partitionId(), [], 0, 0

        def block(table: pa.Table) -> pa.RecordBatch:
            table = table.sort_by("vec_id")
            lists = table.column("q").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            dims = max(1, int(pa.compute.max(pa.compute.list_value_length(lists)).as_py()))
            planes, bias = slice_rows(_dense(lists, dims))
            asks = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
            row = {"part": part, "no": part << 32 | seq, "dims": dims, "bits": planes.shape[1], "bias": str(bias), "ids": table.column("vec_id").to_numpy().astype("<i8").tobytes(), "asks": asks.astype("<i8").tobytes(), "planes": planes.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK_ROWS))
                seq, held, count = seq + 1, table.slice(BLOCK_ROWS).to_batches(), count - BLOCK_ROWS
        if count:
            yield block(pa.Table.from_batches(held))

    return materialize(rows.repartition(parts).mapInArrow(pack, _BLOCK_DDL), "slice-index"), parts, groups


def asked(index: DataFrame) -> DataFrame:
    """The queries of each block with their place in it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            at = _longs(row["asks"])
            ids, planes = _longs(row["ids"]), _planes(row)
            for first in range(0, len(at), ASKED_ROWS):
                few = at[first : first + ASKED_ROWS]
                values = rows_of(planes, int(row["bias"]), few)
                yield pa.RecordBatch.from_pylist([{"q_no": row["no"], "q_dims": row["dims"], "q_at": few.tobytes(), "q_ids": ids[few].tobytes(), "q_values": values.tobytes()}], schema=_ASKED)

    return materialize(index.mapInArrow(read, _ASKED_DDL), "slice-queries")


def search_block(planes: np.ndarray, bias: int, n: int, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(query, positions, scores) of the best k of a block's ``n`` rows for each query.

    ``own`` has the position of each query in this block, which is no candidate.
    """
    flipped = ~planes
    everyone = np.zeros(planes.shape[2] * 64, np.uint8)
    everyone[:n] = 1
    for i, weights in enumerate(queries[:, : planes.shape[0]].tolist()):
        allowed = everyone
        if own is not None:
            allowed = everyone.copy()
            allowed[own[i]] = 0
        score, constant = add_slices(planes, flipped, weights)
        at = best_rows(score, np.packbits(allowed, bitorder="little").view(np.uint64), k)
        total = np.zeros(len(at), object if len(score) > 61 else np.int64)
        for p, s in enumerate(score):
            total += ((s[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(total.dtype) << p
        less = constant + bias * sum(weights)
        yield i, at, [x - less for x in total.tolist()]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) from ``vectors(vec_id, embedding)``."""
    ship(vectors.sparkSession)
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", quantise(F.col("embedding"), scale).alias("q"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("q is not null")
    index, parts, groups = build(rows)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    sent = asked(index).withColumn("group", F.pmod(F.xxhash64("q_no", "q_at"), F.lit(groups))).withColumn("part", every(parts))
    dealt = index.withColumn("group", every(groups))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, at, q_ids = _longs(row["ids"]), _longs(row["q_at"]), _longs(row["q_ids"])
            queries = _longs(row["q_values"]).reshape(-1, row["q_dims"])
            out: list[list] = [[], [], [], [], []]
            for i, found, score in search_block(_planes(row), int(row["bias"]), len(ids), queries, k, at if row["q_no"] == row["no"] else None):
                if score and not -(1 << 63) <= min(score) <= max(score) < 1 << 63:
                    raise OverflowError("a score does not fit a long")
                out[0].append(np.full(len(found), row["q_no"]))
                out[1].append(np.full(len(found), at[i]))
                out[2].append(np.full(len(found), q_ids[i]))
                out[3].append(ids[found])
                out[4].append(np.array(score, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], schema=_FOUND)

    # Both sides are far larger than the stored tables they come from, by whose size Spark would choose to send one to all tasks.
    found = sent.hint("merge").join(dealt, ["part", "group"]).mapInArrow(search, "q_no long, q_at long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_no", "q_at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
