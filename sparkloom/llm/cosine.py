"""Near copies among vectors: sign hashing, exact cosines, components.

1. Signs: the sides of ``bits`` random hyperplanes are a vector's key in one of
   several tables.  ``bits`` grows with the logarithm of the number of vectors,
   so buckets do not grow with it, and the number of tables follows from the
   chance at which a pair at the threshold may be missed (``MISSED``).
2. The signs of the first ``SKETCH`` planes travel with the keys, 64 bytes at
   most.  Pairs of a bucket whose signs differ in more places than a pair at
   the threshold does (but for a chance of ``MISSED``) go; the others give a
   spanning forest of the bucket, never the pairs.
3. Blocks of vectors that have at least one pair left are compared by exact
   cosines, as a product of two matrices.  A pair of vectors belongs to one
   pair of blocks, so links are counted once, however many tables found them.
   A forest of the true links gives the components.

Equal vectors are one *point* and only add to counts.  Vectors of different
length link with nothing but their own length.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components have no link and a component of their own; rows without a vec_id are
vectors like others, and a component of these alone has a null id, all of its
rows kept; repeated rows link with each other; ties go to the smaller vec_id;
components of any size of number are scaled before they are squared; vectors of
any length are used whole; an empty table gives no rows; columns other than
vec_id and embedding are not read and do not come back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.jaccard import BUCKET_BLOCK, _dealt, _forest, _grouped, _longs, _placed, _sides
from sparkloom.operators.graph import connected_components
from sparkloom.operators.skew import join_counted
from sparkloom.runtime import materialize, release, ship

THRESHOLD = 0.95
#: The chance that a pair at the threshold shares no bucket, and that its signs differ too much.
MISSED = 1e-6
SKETCH = 512
#: A bucket of unrelated vectors has about so many members.
BUCKET = 16
SEED = 20250311


def layout(points: int, threshold: float = THRESHOLD, missed: float = MISSED) -> tuple[int, int, int]:
    """(bits of a key, tables, most differing signs of the sketch) for so many vectors."""
    bits = min(48, max(4, math.ceil(math.log2(max(points, 2) / BUCKET))))
    differ = math.acos(threshold) / math.pi
    tables = math.ceil(math.log(missed) / math.log1p(-((1 - differ) ** bits)))
    size = min(SKETCH, bits * tables)
    tail, k, term = 1.0, 0, (1 - differ) ** size
    while tail > missed and k < size:  # the binomial tail beyond k
        tail -= term
        term *= (size - k) / (k + 1) * differ / (1 - differ)
        k += 1
    return bits, tables, k


@lru_cache(4)
def planes(dims: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((count, dims)).T


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the vectors of each length."""
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for dims in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dims)
        yield at, flat[(ends[at] - dims)[:, None] + np.arange(dims)].astype(np.float64)


def signs(vectors: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed sketch, keys) of unit rows; a key holds its table, its signs and the number of dimensions."""
    side = vectors @ planes(vectors.shape[1], bits * tables) >= 0
    sketch = np.packbits(side[:, :SKETCH], axis=1)
    value = side.reshape(len(vectors), tables, bits) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
    key = (value * np.uint64(tables) + np.arange(tables, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(vectors.shape[1] * 0xC2B2AE3D27D4EB4F % 2**64)
    return sketch, (key ^ (key >> np.uint64(32))).view(np.int64)


def usable(vector: Column) -> Column:
    """Whether all components are finite and one is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= F.lit(1.7976931348623157e308)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _points(rows: DataFrame) -> DataFrame:
    """(id, v1, v2, vector, copies, first_id): the different vectors, stored."""
    grouped = rows.groupBy("v1", "v2").agg(F.any_value("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    return materialize(grouped.withColumn("id", F.monotonically_increasing_id()), "cosine-points")


def _signed(points: DataFrame, bits: int, tables: int) -> DataFrame:
    """(id, sketch, keys), stored."""

    @F.arrow_udf("sketch binary, keys array<long>")
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sketch, keys = [b""] * len(batch), np.zeros((len(batch), tables), np.int64)
            for at, vectors in _by_length(batch):
                s, keys[at] = signs(unit(vectors), bits, tables)
                for i, x in zip(at.tolist(), s, strict=True):
                    sketch[i] = x.tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * tables, pa.int32()), pa.array(keys.ravel()))
            yield pa.StructArray.from_arrays([pa.array(sketch, pa.binary()), lists], names=["sketch", "keys"])

    return materialize(points.select("id", signed(F.col("vector")).alias("s")).select("id", "s.*"), "cosine-signs")


def _buckets(signed: DataFrame, tables: int) -> DataFrame:
    """(bucket, id, n): the members of buckets of two or more, stored."""
    keyed = signed.select("id", F.explode("keys").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return materialize(join_counted(keyed, shared, ["bucket"], tables * signed.count()), "cosine-buckets")


def near(sketches: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Boolean matrix of the pairs whose sketches differ in ``most`` places at the most."""
    differ = np.zeros((len(a), len(b)), np.uint16)
    for k in range(sketches.shape[1]):
        differ += np.bitwise_count(sketches[a, k][:, None] ^ sketches[b, k][None, :])
    return differ <= most


def _sketches(table: pa.Table) -> np.ndarray:
    """As rows of 64-bit words; shorter ones end with zeros."""
    parts = table.column("sketch").to_pylist()
    width = -(-len(parts[0]) // 8) * 8
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint64).reshape(len(parts), -1)


def _roots(members: DataFrame, most: int) -> DataFrame:
    """(u, v): forests of the pairs of each bucket that may reach the threshold, stored."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for table in _grouped(batches, ("bucket", "_i", "_j")):
            a, b = _sides(table)
            u, v = _forest(table.column("id").to_numpy(), a, b, near(_sketches(table), a, b, most))
            us.append(u[u != v])
            vs.append(v[u != v])
            if len(us) >= 2000:
                yield pa.RecordBatch.from_arrays(_longs(us, vs), names=["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays(_longs(us, vs), names=["u", "v"])

    return materialize(_dealt(members, "bucket", "n", BUCKET_BLOCK).mapInArrow(prune, "u long, v long"), "cosine-roots")


def _units(members: DataFrame, placed: DataFrame, most: int) -> DataFrame:
    """(unit, leader, place, side): the blocks of each pair of blocks with a pair left, stored."""
    names = ["la", "pa", "lb", "pb"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*seen, strict=True)) or [()] * 4)], names=names)

        for table in _grouped(batches, ("bucket", "_i", "_j")):
            block = list(zip(table.column("leader").to_pylist(), table.column("place").to_pylist(), strict=True))
            number = {x: i for i, x in enumerate(dict.fromkeys(block))}
            own, known = np.array([number[x] for x in block]), list(number)
            a, b = _sides(table)
            i, j = np.nonzero(near(_sketches(table), a, b, most) & (a[:, None] != b[None, :]))
            for code in np.unique(own[a[i]] * len(known) + own[b[j]]).tolist():
                x, y = known[code // len(known)], known[code % len(known)]
                seen.add(min(x, y) + max(x, y))
            if len(seen) >= 20_000:
                yield done()
                seen.clear()
        yield done()

    here = members.join(placed, "id")
    found = _dealt(here, "bucket", "n", BUCKET_BLOCK).mapInArrow(pairs, ", ".join(f"{c} long" for c in names)).distinct()
    units = materialize(found.withColumn("unit", F.monotonically_increasing_id()), "cosine-units")
    one = (F.col("la") == F.col("lb")) & (F.col("pa") == F.col("pb"))
    side = lambda n: F.struct(F.col(f"l{n}").alias("leader"), F.col(f"p{n}").alias("place"), F.lit(n).alias("side"))
    return units.select("unit", F.explode(F.when(one, F.array(side("a"))).otherwise(F.array(side("a"), side("b")))).alias("s")).select("unit", "s.*")


def _links(points: DataFrame, placed: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """(id, root, n): the copies that each point's links of a unit lead to, stored."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ("unit",)):
            ids, side = table.column("id").to_numpy(), np.array(table.column("side").to_pylist())
            a = np.flatnonzero(side == "a")
            b = np.flatnonzero(side == "b") if (side == "b").any() else a
            vectors = table.column("vector").combine_chunks()
            hit = np.zeros((len(a), len(b)), bool)
            for at, rows in _by_length(vectors):
                x, y = np.isin(a, at), np.isin(b, at)
                rows = unit(rows)
                hit[np.ix_(x, y)] = rows[np.searchsorted(at, a[x])] @ rows[np.searchsorted(at, b[y])].T >= threshold
            hit &= a[:, None] != b[None, :]
            copies, n = table.column("copies").to_numpy(), np.zeros(len(ids), np.int64)
            n[a] = hit @ copies[b]
            if a is not b:
                n[b] = copies[a] @ hit
            u, v = _forest(ids, a, b, hit)
            order = np.argsort(ids)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n[order[np.searchsorted(ids, u, sorter=order)]])], names=["id", "root", "n"])

    vectors = placed.join(points.select("id", "copies", F.col("vector").cast("array<double>").alias("vector")), "id")
    work = vectors.join(units, ["leader", "place"]).select("unit", "side", "id", "copies", "vector")
    return materialize(work.repartition("unit").sortWithinPartitions("unit").mapInArrow(verify, "id long, root long, n long"), "cosine-links")


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept.

    ``n_links`` is the number of other vectors whose cosine reaches the
    threshold, ``component_id`` the least vec_id that links lead to, and
    ``kept`` holds for the row of that id.
    """
    ship(vectors.sparkSession)
    read = vectors.select("vec_id", F.col("embedding").alias("vector"))
    keyed = read.where(usable(F.col("vector"))).withColumns({"v1": F.xxhash64("vector"), "v2": F.xxhash64(F.lit(1), "vector")})
    points = _points(keyed)
    count = points.count()
    bits, tables, most = layout(count, threshold)
    signed = _signed(points, bits, tables)
    buckets = _buckets(signed, tables)
    members = buckets.join(signed.select("id", "sketch"), "id")
    placed = _placed(_roots(members, most))
    links = _links(points, placed, _units(members, placed, most), threshold)
    release(buckets)
    components = connected_components(links.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    labelled = points.select("id", "v1", "v2", "copies", "first_id").join(components.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    labelled = labelled.select("v1", "v2", "copies", "first_id", F.coalesce("label", "id").alias("label"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    labelled = materialize(labelled, "cosine-labels")
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    named = join_counted(labelled, least, ["label"], count).select("v1", "v2", "n_links", "component_id", F.col("copies").alias("n"))
    per_point = materialize(named, "cosine-components")
    found = join_counted(keyed.select("vec_id", "v1", "v2"), per_point, ["v1", "v2"], keyed.count()).select("vec_id", "n_links", "component_id")
    alone = read.where(~usable(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
  coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings),
p AS (SELECT a.i AS a, b.i AS b FROM v a JOIN v b ON a.ok AND b.ok AND a.i <> b.i AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT i AS node, i AS label FROM v UNION SELECT p.b, r.label FROM reach r JOIN p ON p.a = r.node),
c AS (SELECT node, min(w.vec_id) AS component_id FROM reach JOIN v w ON w.i = label GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c ON node = i LEFT JOIN n ON a = i"""
