"""Phrase collocations, counted in the slots of a minimal perfect hash.

Texts are lower-cased, cut into pieces at punctuation and line ends, and these
into words.  Phrases of one to ``LONGEST`` words are known by two 64-bit hashes.

1. Filter: mappers count hashed phrases in arrays of bytes that stop at 255;
   the arrays are summed as a tree.  A phrase whose cell stays under the least
   count is rarer than that, so the cells leave a bitmap that drops no frequent
   phrase.  It has a cell for each 64 bytes of text and ``MOST_CELLS`` for each
   length of phrase, so 32 MB at the most; beyond these it drops less.
2. Candidates: phrases that pass with both their parts of one word less (the
   Apriori rule).  A task sends a candidate once as a rule; distinct ones are
   dealt to shards of about 65,536 keys, and each gets a minimal perfect hash
   with its keys stored by slot.
3. Counts: mappers read the texts again, look each phrase up (a slot counts only
   if its stored key agrees) and bincount the slots into an array for each
   shard; the arrays are summed as a tree.  If there are more shards than the 64
   that a task holds, it gathers keys by shard and looks up those of a shard
   together, so a shard is read once for many keys, not once for each run.
4. Cuts: the parts of every cut are candidates too, so their counts are read by
   slot, shard by shard for many phrases.  Phrases inside longer ones go by a join, the ranking takes the best of
   salted groups before those of a language.

Defined cases: a null text counts as empty and a null lang as ``und``; texts of
any length are read whole, in slices that carry their last words on; repeated
rows count again; ties in score and count go to the phrase that is first in
UTF-8 order; a language without a candidate has no rows; an empty table gives
none; columns other than text and lang are not read.
"""

from __future__ import annotations

import io
import math
import re
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm import storage
from sparkloom.runtime import materialize, shared_path, ship, spread

LEAST, LONGEST, TOP = 30, 4, 2000
#: A longer phrase of at least this many percent of the occurrences replaces its parts.
INSIDE = 80
LEAST_CELLS, MOST_CELLS, CHUNK = 1 << 12, 1 << 26, 1 << 20
#: Cells of the filter for each candidate a task remembers to have sent, words whose hash it keeps, and shards it counts at a time.
KNOWN_CELLS, KEPT_WORDS, COUNTED_SHARDS = 4, 150_000, 1024


@dataclass(frozen=True)
class Sizes:
    """Bytes of text that are worked on together, bytes of text for a cell of the filter, keys of a shard, shards a task holds.

    If there are more shards, ``gathered`` keys for each, but not more than
    ``most_gathered``, and ``together`` phrases wait until they are looked up.
    """

    run: int = 1 << 20
    cell: int = 64
    shard: int = 1 << 16
    resident: int = 64
    gathered: int = 1 << 14
    most_gathered: int = 1 << 23
    together: int = 1 << 18


_LOWER = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?" or 10 <= c <= 13 else c for c in range(256))
_GAP = re.compile(rb"[\x20\x09]")
_BREAK = b"."
_M1 = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_M2 = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def _mixed(x: np.ndarray, m: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * m
    return x ^ (x >> np.uint64(29))


def first_keys(words: np.ndarray, lang: np.uint64, m=_M1) -> np.ndarray:
    return _mixed(words * m[0] + lang, m[2])


def longer_keys(keys: np.ndarray, words: np.ndarray, m=_M1) -> np.ndarray:
    """The keys of phrases that go on with one more word each."""
    return _mixed(keys * m[1] + words * m[0] + m[2], m[2])


def runs(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, words, old): words of about ``run`` bytes, breaks among them; the first ``old`` are those before, again."""
    held: dict[str, list[bytes]] = {}
    total = 0

    def words() -> Iterator[tuple[str, list[bytes], int]]:
        for lang, parts in held.items():
            yield lang, b" . ".join(parts).split(), 0
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_py().encode().translate(_LOWER).replace(_BREAK, b" . ")
            if len(data) <= run:
                held.setdefault(lang, []).append(data)
                total += len(data)
            else:
                at, last = 0, []
                while at < len(data):
                    gap = _GAP.search(data, at + run)
                    end = gap.start() if gap else len(data)
                    now = last + data[at:end].split()
                    yield lang, now, len(last)
                    at, last = end, now[1 - LONGEST :]
            if total >= run:
                yield from words()
                total = 0
    yield from words()


class Filter:
    """Bitmaps of the cells whose phrases may be frequent; ``None`` lets all pass."""

    def __init__(self, cells: int, maps: list[np.ndarray] | None):
        self.cells, self.shift, self.maps = cells, np.uint64(64 - int(math.log2(cells))), maps

    def cell(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift).astype(np.int64)

    def passes(self, level: int, keys: np.ndarray) -> np.ndarray:
        at = self.cell(keys)
        return (self.maps[level][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


class Hashes(dict):
    """Hashes of words; the store starts anew past a bound."""

    def __init__(self, of: Callable[[bytes], int]):
        super().__init__()
        self.of = of

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = self.of(word)
        return h


class Phrases:
    """The phrases of each run, as keys by number of words and place of the first word."""

    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        self.words = Hashes(self.hash)
        self.stop = np.uint64(self.hash(_BREAK))

    def lang(self, name: str) -> np.uint64:
        return np.uint64(self.hash(name.encode()))

    def hashed(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def all(self, lang: str, words: list[bytes], old: int) -> Iterator[tuple[int, np.ndarray]]:
        """(level, keys) of every phrase that ends past the ``old`` words."""
        h = self.hashed(words)
        real = fine = h != self.stop
        keys = first_keys(h, self.lang(lang))
        for level in range(LONGEST):
            if level:
                keys, fine = longer_keys(keys[:-1], h[level:]), fine[:-1] & real[level:]
            new = slice(max(0, old - level), None)
            yield level, keys[new][fine[new]]

    def passing(self, lang: str, words: list[bytes], old: int, cells: Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, places, keys, second keys) of those that pass the filter with all their parts."""
        h, name = self.hashed(words), self.lang(lang)
        one, two = first_keys(h, name), first_keys(h, name, _M2)
        fine = h != self.stop
        for level in range(LONGEST):
            if level:
                one, two, fine = longer_keys(one[:-1], h[level:]), longer_keys(two[:-1], h[level:], _M2), fine[:-1] & fine[1:]
            at = np.flatnonzero(fine)
            at = at[cells.passes(level, one[at])]
            fine = np.zeros(len(one), bool)
            fine[at] = True
            at = at[at >= old - level]
            yield level, at, one[at], two[at]


class PerfectHash:
    """Slots 0 to n - 1 of n different keys of 128 bits.

    Level by level, keys that are alone in a cell of a bit array set its bit;
    the others go on to the next one.  A slot is the number of set bits before
    the key's own.
    """

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        sizes, bits, rest = [], [], np.arange(len(k1))
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            at = self._at(k1[rest], k2[rest], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            rest = rest[~alone[at]]
        self.sizes = np.array(sizes, np.int64)
        flat = np.concatenate([*bits, np.zeros(64, bool)])
        self.words = np.packbits(flat, bitorder="little").view(np.uint64)
        self.before = np.cumsum(np.bitwise_count(self.words).astype(np.int64)) - np.bitwise_count(self.words)
        self.k1, self.k2 = np.zeros(len(k1), np.uint64), np.zeros(len(k1), np.uint64)
        slots = self._slots(k1, k2)
        self.k1[slots], self.k2[slots] = k1, k2

    @staticmethod
    def _at(k1: np.ndarray, k2: np.ndarray, level: int, size: int) -> np.ndarray:
        h = _mixed(k1 ^ (k2 * _M2[0] + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)), _M1[1])
        return (((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)

    def _slots(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        out, rest, start = np.full(len(k1), -1), np.arange(len(k1)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = self._at(k1[rest], k2[rest], level, size) + start
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[hit]] = (self.before[at >> 6] + below)[hit]
            rest, start = rest[~hit], start + size
        return out

    def slots(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for others than the stored ones."""
        out = self._slots(k1, k2)
        known = np.flatnonzero(out >= 0)
        wrong = (self.k1[out[known]] != k1[known]) | (self.k2[out[known]] != k2[known])
        out[known[wrong]] = -1
        return out

    def save(self, folder: str, shard: int) -> str:
        uri, stream = storage.create(folder, f"hash-{shard}", ".npz")
        data = io.BytesIO()
        np.savez(data, sizes=self.sizes, words=self.words, before=self.before, k1=self.k1, k2=self.k2)
        with stream:
            stream.write(data.getvalue())
        return uri

    @classmethod
    def load(cls, uri: str) -> PerfectHash:
        out = cls.__new__(cls)
        with storage.read(uri) as stream:
            out.__dict__.update(np.load(io.BytesIO(stream.read())))
        return out


class Resident:
    """The most recently used of the shards; ``gone`` takes those that make room."""

    def __init__(self, load, gone=None, most: int = 64):
        self.load, self.gone, self.most, self.held = load, gone, most, OrderedDict()

    def __getitem__(self, shard: int):
        if shard not in self.held:
            if len(self.held) >= self.most:
                old = self.held.popitem(last=False)
                if self.gone:
                    self.gone(*old)
            self.held[shard] = self.load(shard)
        self.held.move_to_end(shard)
        return self.held[shard]


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of the keys."""
    shard = np.mod(keys.view(np.int64), shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard[part[0]]), part


def slot_counts(keys: Iterator[tuple[np.ndarray, np.ndarray]], load: Callable[[int], PerfectHash], shards: int, sizes: Sizes) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, count of each slot), a shard perhaps more than once, of both keys of phrases.

    Keys of about a run are looked up together if all shards can be held, and many more otherwise.
    """
    given: list[tuple[int, np.ndarray]] = []
    tables = Resident(load, most=sizes.resident)
    totals = Resident(lambda s: np.zeros(len(tables[s].k1), np.int64), lambda *x: given.append(x), COUNTED_SHARDS)
    enough = sizes.run // 4 if shards <= sizes.resident else min(sizes.most_gathered, sizes.gathered * shards)
    waiting, n = [], 0

    def look_up() -> None:
        k1, k2 = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        for shard, at in _by_shard(k1, shards):
            slots = tables[shard].slots(k1[at], k2[at])
            total = totals[shard]
            total += np.bincount(slots[slots >= 0], minlength=len(total))

    for pair in keys:
        waiting.append(pair)
        n += len(pair[0])
        if n >= enough:
            look_up()
            n = 0
            while given:
                yield given.pop()
    if waiting:
        look_up()
    yield from given
    yield from totals.held.items()


def _packed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(1).compress(values.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


_ARRAYS = "level int, chunk int, node int, data binary"


def _arrays(rows: list[tuple]) -> pa.RecordBatch:
    level, chunk, node, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(chunk, pa.int32()), pa.array(node, pa.int32()), pa.array(data, pa.binary())], names=["level", "chunk", "node", "data"])


def _tree_sum(arrays: DataFrame, mappers: int, kind: str, finish: Callable[[int, np.ndarray], bytes]) -> DataFrame:
    """What ``finish`` makes of each (level, chunk) and its array, summed in two rounds; arrays of bytes stop at 255."""

    def add(batches: Iterator[pa.RecordBatch], given: Callable[[int, np.ndarray], bytes]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for level, chunk, node, data in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                values = _unpacked(data, kind)
                if key != (level, chunk, node):
                    if key:
                        yield _arrays([(*key, given(key[1], total))])
                    key, total = (level, chunk, node), values.copy()
                elif kind == "u1":
                    total += np.minimum(values, 255 - total)
                else:
                    total += values
        if key:
            yield _arrays([(*key, given(key[1], total))])

    for nodes, given in ((max(1, math.isqrt(mappers)), lambda _, x: _packed(x)), (1, finish)):
        dealt = arrays.withColumn("node", F.pmod("node", F.lit(nodes)).cast("int")).repartition("level", "chunk", "node")
        arrays = dealt.sortWithinPartitions("level", "chunk", "node").mapInArrow(partial(add, given=given), _ARRAYS)
    return arrays


def _filter(texts: DataFrame, cells: int, least: int, mappers: int, sizes: Sizes) -> tuple[Filter, DataFrame]:
    """The filter, and (lang, n) with the number of words, stored."""
    blank = Filter(cells, None)
    chunk = min(cells, CHUNK)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, tables = Phrases(), np.zeros((LONGEST, cells), np.uint8)
        words: dict[str, int] = {}
        for lang, run, old in runs(batches, sizes.run):
            for level, keys in phrases.all(lang, run, old):
                if not len(keys):
                    continue
                if not level:
                    words[lang] = words.get(lang, 0) + len(keys)
                at = np.sort(blank.cell(keys).astype(np.uint32))
                first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
                count = np.diff(first, append=len(at))
                place = at[first]
                tables[level, place] = np.minimum(tables[level, place] + count, 255)
        node = TaskContext.get().partitionId()
        for level in range(LONGEST):
            for c in range(0, cells, chunk):
                if tables[level, c : c + chunk].any():
                    yield named(_arrays([(level, c // chunk, node, _packed(tables[level, c : c + chunk]))]), [None], [None])
        if words:
            yield named(_arrays([(-1, 0, node, b"")] * len(words)), list(words), list(words.values()))

    def named(rows: pa.RecordBatch, lang: list, n: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang, pa.string()), pa.array(n, pa.int64())], names=[*rows.schema.names, "lang", "n"])

    made = materialize(texts.mapInArrow(sketch, f"{_ARRAYS}, lang string, n long"), "collocation-cells")
    sums = _tree_sum(made.where("level >= 0").drop("lang", "n"), mappers, "u1", lambda _, x: np.packbits(x >= least).tobytes())
    maps = [np.zeros(-(-cells // 8), np.uint8) for _ in range(LONGEST)]
    for row in sums.toLocalIterator():  # bitmaps of MOST_CELLS bits for each length at the most
        data = np.frombuffer(row["data"], np.uint8)
        maps[row["level"]][row["chunk"] * (chunk // 8) :][: len(data)] = data
    return Filter(cells, maps), made.where("level < 0").groupBy("lang").agg(F.sum("n").alias("n"))


def _candidates(texts: DataFrame, held, sizes: Sizes) -> DataFrame:
    """(k1, k2, lang, phrase), stored."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, cells = Phrases(), held.value
        size = max(1 << 12, cells.cells // KNOWN_CELLS)
        known = np.ones(size, np.uint64)
        for lang, run, old in runs(batches, sizes.run):
            one, two, text = [], [], []
            for level, at, k1, k2 in phrases.passing(lang, run, old, cells):
                place = (k1 & np.uint64(size - 1)).astype(np.int64)
                new = np.flatnonzero(known[place] != k1)
                _, first = np.unique(k1[new], return_index=True)
                new = new[first]
                known[place[new]] = k1[new]
                one.append(k1[new])
                two.append(k2[new])
                text += [b" ".join(run[i : i + level + 1]) for i in at[new].tolist()]
            keys = [pa.array(np.concatenate(x).view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([lang] * len(text), pa.string()), pa.array(text, pa.binary()).cast(pa.string())], names=["k1", "k2", "lang", "phrase"])

    # A task hardly sends one twice, so candidates meet before equal ones are looked for.
    return materialize(texts.mapInArrow(found, "k1 long, k2 long, lang string, phrase string").repartition("k1", "k2").distinct(), "collocation-candidates")


def _hashed(candidates: DataFrame, shards: int, folder: str) -> DataFrame:
    """(shard, slot, lang, phrase, uri): the perfect hash of each shard is in its file; stored."""

    def build(table: pa.Table) -> pa.Table:
        k1, k2 = (table.column(c).to_numpy().view(np.uint64) for c in ("k1", "k2"))
        shard = table.column("shard")[0].as_py()
        made = PerfectHash(k1, k2)
        uri = made.save(folder, shard)
        return pa.table({"shard": table.column("shard"), "slot": pa.array(made.slots(k1, k2), pa.int32()), "lang": table.column("lang"), "phrase": table.column("phrase"), "uri": pa.array([uri] * len(k1), pa.string())})

    dealt = candidates.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("shard").applyInArrow(build, "shard int, slot int, lang string, phrase string, uri string"), "collocation-slots")


def _counted(texts: DataFrame, held, uris: dict[int, str], shards: int, mappers: int, folder: str, sizes: Sizes) -> DataFrame:
    """(shard, uri) of the files with the count of each slot, stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, node = Phrases(), TaskContext.get().partitionId()
        keys = (x[2:] for run in runs(batches, sizes.run) for x in phrases.passing(*run, held.value))
        for shard, total in slot_counts(keys, lambda s: PerfectHash.load(uris[s]), shards, sizes):
            yield _arrays([(0, shard, node, _packed(total))])

    def store(shard: int, total: np.ndarray) -> bytes:
        uri, stream = storage.create(folder, f"counts-{shard}", ".zst")
        with stream:
            stream.write(_packed(total))
        return uri.encode()

    sums = _tree_sum(texts.mapInArrow(count, _ARRAYS), mappers, "<i8", store)
    return materialize(sums.select(F.col("chunk").alias("shard"), F.col("data").cast("string").alias("uri")), "collocation-counts")


def scores(a: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """floor(2000000 * a / parts), also where the product passes 64 bits."""
    if len(a) and int(a.max()) >= 1 << 42:
        return np.array([2_000_000 * x // y for x, y in zip(a.tolist(), parts.tolist(), strict=True)], np.int64)
    return 2_000_000 * a // np.maximum(parts, 1)


def _cut(hashed: DataFrame, hashes: dict[int, str], counts: dict[int, str], shards: int, least: int, sizes: Sizes) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of phrases of two words or more, at their lowest cut; stored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases()

        def counts_of(shard: int) -> np.ndarray:
            with storage.read(counts[shard]) as stream:
                return _unpacked(stream.read(), "<i8")

        tables, totals = Resident(lambda s: PerfectHash.load(hashes[s]), most=sizes.resident), Resident(counts_of, most=sizes.resident)

        def read(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
            out = np.zeros(len(k1), np.int64)
            for shard, at in _by_shard(k1, shards):
                out[at] = totals[shard][tables[shard].slots(k1[at], k2[at])]
            return out

        def keys(langs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            both = []
            for m in (_M1, _M2):
                k = first_keys(words[:, 0], langs, m)
                for c in range(1, words.shape[1]):
                    k = longer_keys(k, words[:, c], m)
                both.append(k)
            return both[0], both[1]

        def scored(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            own_all = rows.column("a").to_numpy()
            split = [p.encode().split(b" ") for p in rows.column("phrase").to_pylist()]
            size = np.array([len(p) for p in split], np.int64)
            lang = np.array([phrases.lang(x) for x in rows.column("lang").to_pylist()], np.uint64)
            of = {n: np.flatnonzero(size == n) for n in range(2, LONGEST + 1)}
            asked = []  # the parts of all cuts, so that a shard is read once for them
            for n, here in of.items():
                words = phrases.hashed([w for i in here.tolist() for w in split[i]]).reshape(-1, n)
                asked += [keys(lang[here], part) for k in range(1, n) for part in (words[:, :k], words[:, k:])]
            got = read(*(np.concatenate(x) for x in zip(*asked, strict=True)))
            for n, here in of.items():
                parts, got = got[: 2 * (n - 1) * len(here)].reshape(n - 1, 2, len(here)), got[2 * (n - 1) * len(here) :]
                if not len(here):
                    continue
                own, left, right = own_all[here], parts[:, 0], parts[:, 1]
                score = np.stack([scores(own, x + y) for x, y in zip(left, right, strict=True)])
                best, row = score.argmin(0), np.arange(len(here))
                take = pa.array(here)
                texts = [rows.column(c).take(take).combine_chunks() for c in ("lang", "phrase")]
                numbers = [np.full(len(here), n), own, left[best, row], right[best, row], score[best, row]]
                yield pa.RecordBatch.from_arrays([*texts, *[pa.array(x, pa.int64()) for x in numbers]], names=["lang", "phrase", "words", "a", "l", "r", "score"])

        enough, held = 0 if shards <= sizes.resident else sizes.together, []
        for batch in batches:
            shard, slot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            a = np.zeros(len(shard), np.int64)
            for s in np.unique(shard).tolist():
                at = np.flatnonzero(shard == s)
                a[at] = totals[s][slot[at]]
            at = np.flatnonzero(a >= least)
            held.append(pa.table({"lang": batch.column(2).take(pa.array(at)), "phrase": batch.column(3).take(pa.array(at)), "a": a[at]}))
            if sum(map(len, held)) >= enough:
                yield from scored(pa.concat_tables(held))
                held.clear()
        if held:
            yield from scored(pa.concat_tables(held))

    return materialize(hashed.drop("uri").mapInArrow(cut, "lang string, phrase string, words long, a long, l long, r long, score long"), "collocation-cuts")


def without_parts(scored: DataFrame, inside: int = INSIDE) -> DataFrame:
    """Phrases that do not lie in a longer one of ``inside`` percent of their occurrences."""
    word = F.split("phrase", " ")
    spans = [(F.col("words") > n) & (F.col("words") >= n + i) for n in range(2, LONGEST) for i in range(LONGEST)]
    parts = [F.array_join(F.slice(word, i + 1, n), " ") for n in range(2, LONGEST) for i in range(LONGEST)]
    within = F.explode(F.filter(F.array(*[F.when(s, p) for s, p in zip(spans, parts, strict=True)]), lambda x: x.isNotNull()))
    most = scored.where("words > 2").select("lang", within.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    wide = "decimal(22,0)"
    kept = F.col("_most").isNull() | (F.col("_most").cast(wide) * 100 < F.col("a").cast(wide) * inside)
    return scored.join(most, ["lang", "phrase"], "left").where(kept).drop("_most")


def ranked(scored: DataFrame, top: int = TOP, salts: int = 64) -> DataFrame:
    """The ``top`` first of each lang with their rank; what one task orders is bounded by ``top`` and ``salts``."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    best = salted.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_n") <= top).drop("_n", "_salt")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, sizes: Sizes = Sizes()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each lang of ``docs(text, lang)``."""
    spark = docs.sparkSession
    ship(spark)
    read = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << min(int(math.log2(MOST_CELLS)), max(int(math.log2(LEAST_CELLS)), math.ceil(math.log2(max(size, 1) / sizes.cell))))
    # Few long tasks, so that the arrays that leave them are few.
    mappers = 2 * spark.sparkContext.defaultParallelism
    texts = spread(read).coalesce(mappers)
    cells, words = _filter(texts, cells, least, mappers, sizes)
    held = spark.sparkContext.broadcast(cells)  # MOST_CELLS bits for each length of phrase at the most
    candidates = _candidates(texts, held, sizes)
    shards = max(1, math.ceil(candidates.count() / sizes.shard))
    folder = shared_path(spark, "collocation-files")
    hashed = _hashed(candidates, shards, folder)
    hashes = {r["shard"]: r["uri"] for r in hashed.select("shard", "uri").distinct().toLocalIterator()}  # a name for each shard
    counts = {r["shard"]: r["uri"] for r in _counted(texts, held, hashes, shards, mappers, folder, sizes).toLocalIterator()}
    scored = _cut(hashed, hashes, counts, shards, least, sizes)
    best = ranked(without_parts(scored), top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (SELECT c.lang, c.phrase, c.k, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM c, (SELECT unnest([1, 2, 3]) AS j) WHERE j < c.k),
s AS (SELECT cuts.lang, cuts.phrase, cuts.k, a, j, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT c.lang, array_to_string(c.w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < c.k AND i + m - 1 <= c.k GROUP BY 1, 2),
d AS (SELECT b.* FROM b LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM d) JOIN n USING (lang) WHERE rank <= 2000"""
