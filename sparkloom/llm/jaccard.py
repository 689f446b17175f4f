"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (lower case, words between ASCII
white space; a text of one to four words is one shingle).  Equal sets form one
*text*; the join is between different texts, and copies only add to counts.

1. MinHash: 128 values for each text; 28 bands of 4 values propose pairs.  A
   pair at the threshold of 0.8 is missed with a chance under 4e-7.
2. Bayes: the values of proposed pairs are compared 16 at a time; a pair goes
   once the posterior probability that its similarity reaches the threshold
   falls below ``TOLERANCE``.  A bucket hands on a spanning forest of its
   surviving pairs, never the pairs, so its output grows with its members.
3. Exact: the pairs left are verified from the shingles.  A text's *leader* is
   the least of the roots it has in its buckets; a leader's texts form blocks,
   and the unit of work is a pair of blocks with at least one surviving pair.
   So a chain of texts costs as many units as it has links, however long it
   is, and only dense groups are compared all with all.  A text gets its number
   of links, and a forest of the true links gives the classes.

Buckets beyond a block are dealt out as pairs of blocks, and the rows of
frequent keys do not meet in one task.  Texts and rows are told apart by 128
bits.

Defined cases: null and empty texts, and others without a word, have no
shingle, no link and a class of their own; null ids are rows like others, and a
class of null ids alone has a null class_id; repeated rows count as copies;
ties go to the smaller id; texts of any length are read whole; an empty table
gives no rows.  :func:`join` reads doc_id and text and returns none of the
other columns; :func:`one_of_each` returns all as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.rows import ROW, packed, passengers
from sparkloom.operators.graph import connected_components
from sparkloom.operators.skew import join_counted
from sparkloom.runtime import materialize, release, ship

WIDTH, THRESHOLD = 5, 0.8
HASHES, BANDS, ROWS = 128, 28, 4
STEP, TOLERANCE = 16, 1e-6
BUCKET_BLOCK, VERIFY_BLOCK = 512, 128
#: Up to so many pairs of a unit are verified one by one, more by a matrix product.
FEW_PAIRS = 48
KEPT_WORDS = 400_000

_R = np.random.default_rng(20240607)
_A = _R.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _R.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class Words(dict):
    """Stable 64-bit hashes of words; the store starts anew past a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: Words, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    parts = (text or "").lower().encode("utf-8", "replace").split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = max(1, len(h) - width + 1)
    mixed = h[:n] * _M[0]
    for k in range(1, min(width, len(h))):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _M[1] + h[k : k + n] * _M[k % 5]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _M[2]
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def minhash(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        v = x[None, at : at + 4096] * _A[:, None]
        v += _B[:, None]
        np.minimum(least, v.min(1), out=least)
    return least


def short_values(values: np.ndarray) -> np.ndarray:
    """One byte of each MinHash value, enough for the Bayesian test."""
    return ((values * np.uint32(2654435769)) >> np.uint32(24)).astype(np.uint8)


def band_keys(values: np.ndarray) -> np.ndarray:
    v = values[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = v[:, 0]
    for k in range(1, ROWS):
        key = (key ^ (key >> np.uint64(31))) * _M[0] + v[:, k] * _M[k]
    key = (key ^ (key >> np.uint64(32))) * _M[3] + np.arange(BANDS, dtype=np.uint64) * _M[4]
    return key.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After m values, the fewest matches at which the posterior still reaches the tolerance.

    Bytes of different values match by chance once in 256; the prior is uniform.
    """
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256
    out = {}
    for m in range(STEP, HASHES + 1, STEP):
        for k in range(m + 1):
            log = k * np.log(p) + (m - k) * np.log1p(-p)
            like = np.exp(log - log.max())
            if like[j >= threshold].sum() / like.sum() >= tolerance:
                out[m] = k
                break
    return out


def surviving(a: np.ndarray, b: np.ndarray, limits: dict[int, int]) -> np.ndarray:
    """Boolean matrix of the pairs that no comparison drops."""
    rows, cols = (x.ravel() for x in np.indices((len(a), len(b))))
    count = np.zeros(len(rows), np.int32)
    for m, k in limits.items():
        part = slice(m - STEP, m)
        count += (a[rows, part] == b[cols, part]).sum(1, dtype=np.int32)
        keep = count >= k
        if not keep.all():
            rows, cols, count = rows[keep], cols[keep], count[keep]
    out = np.zeros((len(a), len(b)), bool)
    out[rows, cols] = True
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """The lowest index of each one's component in a symmetric matrix."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            seen = np.zeros(n, bool)
            seen[i] = True
            front = seen
            while front.any():
                new = linked[front].any(0) & ~seen
                seen |= new
                front = new
            root[seen] = i
    return root


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(k[:, a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Rows of each (group, i, j), the pairs of blocks; ``_at`` is the row's own block."""
    n = F.ceil(F.col(size) / block)
    own = F.pmod(F.xxhash64("id", F.lit(7)), n)
    dealt = rows.withColumn("_at", F.when(F.col(size) > 2 * block, own).otherwise(0).cast("int"))
    others = F.when(F.col(size) > 2 * block, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array(F.lit(0).cast("long")))
    dealt = dealt.withColumn("_other", F.explode(others)).withColumn("_i", F.least("_at", "_other").cast("int")).withColumn("_j", F.greatest("_at", "_other").cast("int")).drop("_other", size)
    return dealt.repartition(group, "_i", "_j").sortWithinPartitions(group, "_i", "_j")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two blocks of a group; one block is compared with itself."""
    i, j, at = (table.column(c).to_numpy() for c in ("_i", "_j", "_at"))
    if i[0] == j[0]:
        every = np.arange(len(at))
        return every, every
    return np.flatnonzero(at == i[0]), np.flatnonzero(at == j[0])


def _forest(keys: np.ndarray, a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, root key) of the keys that have a link."""
    full = np.zeros((len(keys), len(keys)), bool)
    full[np.ix_(a, b)] = hit
    full |= full.T
    np.fill_diagonal(full, False)
    who = np.flatnonzero(full.any(0))
    root = roots(full[np.ix_(who, who)])
    return keys[who], keys[who][root]


def row_keys() -> list:
    """Two hashes of a row's doc_id and text: 128 bits in all."""
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("r2")]


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, r1, r2, n_shingles, t1, t2, values, bands) of ``docs(doc_id, text)``, stored."""

    @F.arrow_udf("n_shingles int, t1 long, t2 long, values binary, bands array<long>")
    def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        words = Words()
        for batch in batches:
            n, t1, t2, values, bands = [], [], [], [], []
            for text in batch:
                s = shingles(text.as_py(), words)
                n.append(len(s))
                if not len(s):
                    for x in (t1, t2, values, bands):
                        x.append(None)
                    continue
                v, key = minhash(s), np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                t1.append(int(key[0]))
                t2.append(int(key[1]))
                values.append(short_values(v).tobytes())
                bands.append(band_keys(v))
            columns = [pa.array(n, pa.int32()), pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(values, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.StructArray.from_arrays(columns, names=["n_shingles", "t1", "t2", "values", "bands"])

    rows = docs.select("doc_id", *row_keys(), sketched(F.col("text")).alias("s"))
    return materialize(rows.select("doc_id", "r1", "r2", "s.*"), "jaccard-sketch")


def _members(texts: DataFrame) -> DataFrame:
    """(bucket, id, n): the members of buckets of two or more, stored."""
    keyed = texts.select("id", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return materialize(join_counted(keyed, shared, ["bucket"], BANDS * texts.count()), "jaccard-buckets")


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("values").to_pylist()), np.uint8).reshape(-1, HASHES)


def _longs(*parts: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in parts]


def _roots(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): forests of the pairs in a bucket that the Bayesian test keeps, stored."""
    limits = least_matches()

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for table in _grouped(batches, ("bucket", "_i", "_j")):
            ids, sig = table.column("id").to_numpy(), _signatures(table)
            a, b = _sides(table)
            u, v = _forest(ids, a, b, surviving(sig[a], sig[b], limits))
            us.append(u[u != v])
            vs.append(v[u != v])
            if len(us) >= 2000:
                yield pa.RecordBatch.from_arrays(_longs(us, vs), names=["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays(_longs(us, vs), names=["u", "v"])

    signed = members.join(texts.select("id", "values"), "id")
    return materialize(_dealt(signed, "bucket", "n", BUCKET_BLOCK).mapInArrow(prune, "u long, v long"), "jaccard-roots")


def _placed(roots_: DataFrame) -> DataFrame:
    """(id, leader, place): the block of each text that has a surviving pair, stored."""
    led = materialize(roots_.union(roots_.select("v", "v")).groupBy(F.col("u").alias("id")).agg(F.min("v").alias("leader")), "jaccard-leaders")
    sizes = led.groupBy("leader").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / VERIFY_BLOCK)
    sized = join_counted(led, sizes, ["leader"], led.count())
    return materialize(sized.select("id", "leader", F.pmod(F.xxhash64("id", F.lit(11)), blocks).cast("long").alias("place")), "jaccard-blocks")


def _units(members: DataFrame, texts: DataFrame, placed: DataFrame) -> DataFrame:
    """(unit, leader, place, side): the blocks of each pair of blocks with a surviving pair, stored."""
    limits = least_matches()
    names = ["la", "pa", "lb", "pb"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*seen, strict=True)) or [()] * 4)], names=names)

        for table in _grouped(batches, ("bucket", "_i", "_j")):
            block = list(zip(table.column("leader").to_pylist(), table.column("place").to_pylist(), strict=True))
            a, b = _sides(table)
            if len(set(block)) == 1:
                seen.add(block[0] * 2)
            else:
                sig = _signatures(table)
                for i, j in np.argwhere(surviving(sig[a], sig[b], limits)).tolist():
                    x, y = block[a[i]], block[b[j]]
                    if a[i] != b[j]:
                        seen.add(min(x, y) + max(x, y))
            if len(seen) >= 20_000:
                yield done()
                seen.clear()
        yield done()

    here = members.join(placed, "id").join(texts.select("id", "values"), "id")
    found = _dealt(here, "bucket", "n", BUCKET_BLOCK).mapInArrow(pairs, ", ".join(f"{c} long" for c in names)).distinct()
    units = materialize(found.withColumn("unit", F.monotonically_increasing_id()), "jaccard-units")
    one = (F.col("la") == F.col("lb")) & (F.col("pa") == F.col("pb"))
    side = lambda n: F.struct(F.col(f"l{n}").alias("leader"), F.col(f"p{n}").alias("place"), F.lit(n).alias("side"))
    return units.select("unit", F.explode(F.when(one, F.array(side("a"))).otherwise(F.array(side("a"), side("b")))).alias("s")).select("unit", "s.*")


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of the numbers of shingles that the sets of two sides share."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    common = np.zeros((len(a), len(b)), np.float32)
    in_a, in_b = np.full(len(sets), -1), np.full(len(sets), -1)
    in_a[a], in_b[b] = np.arange(len(a)), np.arange(len(b))
    width, at, total = 4096, 0, int(number[-1]) + 1 if len(number) else 0
    for first in range(0, total, width):  # a slice of the shingles at a time
        end = int(np.searchsorted(number, first + width))
        own, col = owner[at:end], number[at:end] - first
        at = end
        left, right = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        here = in_a[own] >= 0
        left[in_a[own[here]], col[here]] = 1
        here = in_b[own] >= 0
        right[in_b[own[here]], col[here]] = 1
        common += left @ right.T
    return common


def verify_block(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, left: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Those pairs of the matrix ``left`` whose exact Jaccard similarity reaches the threshold."""
    out = np.zeros(left.shape, bool)
    rows, cols = np.nonzero(left & (a[:, None] != b[None, :]))
    if not len(rows):
        return out
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(rows) <= FEW_PAIRS:
        common = np.array([len(np.intersect1d(sets[a[i]], sets[b[j]], assume_unique=True)) for i, j in zip(rows, cols, strict=True)])
    else:
        common = shared_counts(sets, a, b)[rows, cols]
    reach = common >= threshold * (sizes[a[rows]] + sizes[b[cols]] - common) - 1e-6
    out[rows[reach], cols[reach]] = True
    return out


def _links(docs: DataFrame, texts: DataFrame, placed: DataFrame, units: DataFrame) -> DataFrame:
    """(id, root, n_texts, n_docs): links found in each unit, stored."""
    wanted = placed.join(texts.select("id", "copies", "values", "first.*"), "id")
    # A text is read from the rows whose keys its first copy has; equal rows meet again below.
    read = docs.select(*row_keys(), "text").join(wanted, ["r1", "r2"])
    limits = least_matches()

    @F.arrow_udf("binary")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words()
        for batch in batches:
            yield pa.array([shingles(t.as_py(), words).tobytes() for t in batch], pa.binary())

    sets_ = read.select("leader", "place", "id", "copies", "values", cut(F.col("text")).alias("set"))
    work = sets_.join(units, ["leader", "place"]).select("unit", "side", "id", "copies", "values", "set")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ("unit",)):
            ids = table.column("id").to_numpy()
            _, first = np.unique(ids, return_index=True)
            if len(first) < len(ids):
                table = table.take(first)
                ids = ids[first]
            side = np.array(table.column("side").to_pylist())
            a = np.flatnonzero(side == "a")
            b = np.flatnonzero(side == "b") if (side == "b").any() else a
            copies, sig = table.column("copies").to_numpy(), _signatures(table)
            sets = [np.frombuffer(s.as_py(), np.uint64) for s in table.column("set")]
            hit = verify_block(sets, a, b, surviving(sig[a], sig[b], limits))
            n_texts, n_docs = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            n_texts[a], n_docs[a] = hit.sum(1), hit @ copies[b]
            if a is not b:
                n_texts[b], n_docs[b] = hit.sum(0), copies[a] @ hit
            u, v = _forest(ids, a, b, hit)
            at = np.searchsorted(ids, u) if (np.diff(ids) > 0).all() else [ids.tolist().index(x) for x in u.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n_texts[at]), pa.array(n_docs[at])], names=["id", "root", "n_texts", "n_docs"])

    dealt = work.repartition("unit").sortWithinPartitions("unit", "id")
    return materialize(dealt.mapInArrow(verify, "id long, root long, n_texts long, n_docs long"), "jaccard-links")


def _joined(docs: DataFrame) -> DataFrame:
    """(doc_id, r1, r2, class_id, n_links, n_text_links, class_key); no class_key without a word."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = sketch(docs)
    worded, empty = rows.where("n_shingles > 0"), rows.where("n_shingles = 0")
    grouped = worded.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min(F.struct("r1", "r2")).alias("first"), F.any_value("values").alias("values"), F.any_value("bands").alias("bands"))
    texts = materialize(grouped.withColumn("id", F.monotonically_increasing_id()), "jaccard-texts")
    members = _members(texts)
    placed = _placed(_roots(members, texts))
    links = _links(docs, texts, placed, _units(members, texts, placed))
    release(members)
    classes = connected_components(links.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    counts = links.groupBy("id").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    labelled = texts.select("id", "t1", "t2", "copies", "first_id").join(classes.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    labelled = labelled.select("t1", "t2", "copies", "first_id", F.coalesce("label", "id").alias("class_key"), F.coalesce("n_texts", F.lit(0)).alias("n_text_links"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
    labelled = materialize(labelled, "jaccard-labels")
    ids = labelled.groupBy("class_key").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n"))
    named = join_counted(labelled, ids, ["class_key"], labelled.count()).drop("n")
    per_text = materialize(named.select("t1", "t2", "class_id", (F.col("copies") - 1 + F.col("n_docs")).alias("n_links"), "n_text_links", "class_key", F.col("copies").alias("n")), "jaccard-classes")
    found = join_counted(worded.select("doc_id", "r1", "r2", "t1", "t2"), per_text, ["t1", "t2"], rows.count())
    zero = F.lit(0).cast("long")
    alone = empty.select("doc_id", "r1", "r2", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_text_links"), F.lit(None).cast("long").alias("class_key"))
    return found.select(*alone.columns).union(alone)


def join(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs(doc_id, text)``: doc_id, class_id, n_links, n_text_links.

    ``class_id`` is the least doc_id of the class, ``n_links`` the number of
    other documents at or above the threshold, ``n_text_links`` that of
    different texts.
    """
    return _joined(docs).select("doc_id", "class_id", "n_links", "n_text_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of the least doc_id of each class (null ids last), and the rows without a word.

    Rows that agree in doc_id and text are copies even without a word.
    """
    joined = materialize(_joined(docs), "jaccard-result")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("f")
    kept = joined.where("class_key is not null").groupBy("class_key").agg(first).select("f.r1", "f.r2")
    kept = materialize(kept.union(joined.where("class_key is null").select("r1", "r2")), "jaccard-kept")
    rows = packed(docs, "doc_id", "text").select(ROW, *row_keys())
    out = rows.join(kept, ["r1", "r2"], "left_semi")
    if joined.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        out = out.dropDuplicates(["r1", "r2"])
    return out.select(*passengers(out))
