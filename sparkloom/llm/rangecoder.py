"""Adaptive range coder for token ids, many blocks at a time.

Each block starts from fresh models and decodes alone.  Blocks of a group are
coded in lockstep, one numpy lane each, so a step costs a few array calls for
all of them.  An id is coded in up to two moves:

1. Orders 2 and 1 each *predict* an id from the ids before it, with a count of
   how often that prediction held.  The chance that order 2 is right mixes
   three adaptive estimates: by order 2's count, by order 1's, and by how often
   the predicted id itself has come up, which is order 0's; the weights of the
   mix adapt too.  One symbol says: order 2 right, order 1 right, neither.
2. If neither, order 0 codes the id's nibbles with adaptive cumulative
   frequencies, each in the context of the nibbles before it.

Every block starts from the same state: order 0 from the *prior* of the group,
a table of its nibbles that is stored once beside the blocks, the rest from
nothing.  Ids below 65,536 take four nibbles and larger ones up to seven; an id
that does not fit is an error before anything is coded.
"""

from __future__ import annotations

import numpy as np

BITS, SLOT_BITS = 12, 11
#: Slots hold an id and a count of four bits.
MOST_ID = (1 << 28) - 1
#: Groups of fewer ids start from even frequencies, as their prior would outweigh them.
PRIOR_IDS = 200_000
_ROOM = np.uint64(1 << 32)
_LOW32 = np.uint64((1 << 32) - 1)
_START = np.uint64(1 << 48)
_RATES = (5, 5, 4, 4, 4, 4, 4)
_STEP = np.arange(17, dtype=np.int32)
_TARGET = np.where(np.arange(17)[None, :] > np.arange(16)[:, None], 16384, 0).astype(np.int16)


def nibbles(most: int) -> int:
    """Nibbles that each id of a group takes."""
    if not 0 <= most <= MOST_ID:
        raise ValueError(f"ids must lie between 0 and {MOST_ID}, not at {most}")
    return max(4, -(-int(most).bit_length() // 4))


def n_nodes(levels: int) -> int:
    return 273 + 1024 * (levels - 3)


def node(level: int, head: np.ndarray) -> np.ndarray:
    """Row of a nibble's context; ``head`` holds the nibbles before it.  Contexts of three nibbles and more are hashed."""
    if level < 3:
        return head + (0, 1, 17)[level]
    return 273 + 1024 * (level - 3) + ((head * 40503 >> 4) & 1023)


def prior_of(ids: np.ndarray, levels: int) -> np.ndarray | None:
    """Cumulative frequencies of the nibbles of a group, or none for a small one."""
    if len(ids) < PRIOR_IDS:
        return None
    counts = np.zeros((n_nodes(levels), 16), np.int64)
    wide = ids.astype(np.int64)
    for level in range(levels):
        up = 4 * (levels - level)
        at = node(level, wide >> up) * 16 + ((wide >> (up - 4)) & 15)
        counts += np.bincount(at, minlength=counts.size).reshape(counts.shape)
    counts = counts * 64 + 1
    cum = np.concatenate([np.zeros((len(counts), 1), np.int64), np.cumsum(counts, 1)], 1)
    return (cum * 16384 // cum[:, -1:]).astype(np.int16)


class _Models:
    """Fresh statistics of ``n`` lanes."""

    def __init__(self, n: int, levels: int, prior: np.ndarray | None):
        self.n, nodes = n, n_nodes(levels)
        lane = np.arange(n, dtype=np.int64)
        self.slot0, self.row0, self.ctx0 = lane << SLOT_BITS, lane * nodes, lane << 4
        self.order1 = np.zeros(n << SLOT_BITS, np.uint32)  # id << 4 | count
        self.order2 = np.zeros(n << SLOT_BITS, np.uint32)
        self.order0 = np.zeros(n << SLOT_BITS, np.uint8)
        self.by2, self.by1, self.by0, self.hit1 = (np.full(n << 4, 1024, np.int32) for _ in range(4))
        self.w2, self.w1 = np.full(n, 1536, np.int32), np.full(n, 1280, np.int32)
        even = np.tile((np.arange(17) * 1024).astype(np.int16), (nodes, 1))
        self.cdf = np.tile(even if prior is None else prior, (n, 1))
        self.a = np.zeros(n, np.uint32)
        self.b = np.zeros(n, np.uint32)

    def predict(self, m: int) -> None:
        """Predictions and the three-way split for the first ``m`` lanes."""
        a, b, shift = self.a[:m], self.b[:m], np.uint32(32 - SLOT_BITS)
        h1 = a * np.uint32(2654435761)
        h2 = a * np.uint32(2246822519) + b * np.uint32(3266489917)
        self.s1, self.s2 = self.slot0[:m] + (h1 >> shift), self.slot0[:m] + (h2 >> shift)
        t1, t2 = self.order1[self.s1], self.order2[self.s2]
        self.c1, self.c2 = t1 >> np.uint32(4), t2 >> np.uint32(4)
        self.n1, self.n2 = t1 & np.uint32(15), t2 & np.uint32(15)
        n0 = self.order0[self.slot0[:m] + ((self.c2 * np.uint32(2654435761)) >> shift)]
        ctx = self.ctx0[:m]
        self.x2, self.x1, self.x0 = ctx + self.n2, ctx + self.n1, ctx + n0
        self.p2, self.p1, self.p0 = self.by2[self.x2], self.by1[self.x1], self.by0[self.x0]
        self.mixed = self.p0 + (((self.p2 - self.p0) * self.w2[:m] + (self.p1 - self.p0) * self.w1[:m]) >> 12)
        self.f2 = np.minimum(np.maximum(self.mixed, 32), 3968)
        self.q1 = self.hit1[self.x1]
        f1 = ((4096 - self.f2) * np.minimum(np.maximum(self.q1, 64), 3968)) >> 12
        self.f1 = np.where(self.c1 == self.c2, 1, np.maximum(f1, 1))

    def learn(self, m: int, ids: np.ndarray, move: np.ndarray) -> None:
        right2 = move == 0
        goal, sign = np.where(right2, 4096, 0), np.where(right2, 1, -1)
        self.by2[self.x2] = self.p2 + ((goal - self.p2) >> 4)
        self.by1[self.x1] = self.p1 + ((goal - self.p1) >> 4)
        self.by0[self.x0] = self.p0 + ((goal - self.p0) >> 4)
        self.w2[:m] = np.minimum(np.maximum(self.w2[:m] + ((self.p2 - self.mixed) * sign >> 5), 256), 2816)
        self.w1[:m] = np.minimum(np.maximum(self.w1[:m] + ((self.p1 - self.mixed) * sign >> 5), 256), 3840 - self.w2[:m])
        seen1 = ~right2 & (self.c1 != self.c2)
        self.hit1[self.x1] = self.q1 + np.where(seen1, ((move == 1) * 4096 - self.q1) >> 4, 0)
        fresh = ids << np.uint32(4)
        for slots, s, c, n in ((self.order1, self.s1, self.c1, self.n1), (self.order2, self.s2, self.c2, self.n2)):
            slots[s] = fresh | np.where(c == ids, np.minimum(n + np.uint32(1), np.uint32(15)), np.where(n > 3, np.uint32(2), np.uint32(1)))
        s0 = self.slot0[:m] + ((ids * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS))
        self.order0[s0] = np.minimum(self.order0[s0] + np.uint8(1), np.uint8(15))
        self.b[:m] = self.a[:m]
        self.a[:m] = ids

    def adapt(self, rows: np.ndarray, table: np.ndarray, nibble: np.ndarray, level: int) -> None:
        table += (_TARGET[nibble] - table) >> _RATES[level]
        self.cdf[rows] = table


def _scaled(c: np.ndarray, step: np.ndarray) -> np.ndarray:
    return ((c.astype(np.int32) * 4080) >> 14) + step


def _order(lengths: list[int]) -> np.ndarray:
    return np.argsort(-np.array(lengths, np.int64), kind="stable")


def encode_blocks(blocks: list[np.ndarray], levels: int = 4, prior: np.ndarray | None = None) -> list[bytes]:
    """The coded bytes of each block of ids, all of up to ``levels`` nibbles."""
    if not blocks:
        return []
    if max((int(b.max()) for b in blocks if len(b)), default=0) >> 4 * levels:
        raise ValueError(f"an id does not fit {levels} nibbles")
    order = _order([len(b) for b in blocks])
    n, longest = len(blocks), len(blocks[order[0]])
    lengths = np.array([len(blocks[i]) for i in order])
    ids = np.zeros((longest, n), np.uint32)
    for k, i in enumerate(order):
        ids[: len(blocks[i]), k] = blocks[i]
    out = np.zeros((n, -(-levels // 2) * longest + 8), ">u2")
    at = np.zeros(n, np.int64)
    models = _Models(n, levels, prior)
    low, span = np.zeros(n, np.uint64), np.full(n, _START, np.uint64)

    def push(low: np.ndarray, span: np.ndarray, who: np.ndarray | None) -> None:
        while True:
            tight = np.flatnonzero(span < _ROOM)
            if not len(tight):
                return
            x, s = low[tight], span[tight]
            cross = ((x ^ (x + s - np.uint64(1))) & ~_LOW32) != 0
            s = np.where(cross, _ROOM - (x & _LOW32), s)
            lanes = tight if who is None else who[tight]
            out[lanes, at[lanes]] = (x >> np.uint64(32)).astype(np.uint16)
            at[lanes] += 1
            low[tight], span[tight] = (x & _LOW32) << np.uint64(16), s << np.uint64(16)

    for t in range(longest):
        m = int(np.searchsorted(-lengths, -t, side="left"))
        x, lo, sp = ids[t, :m], low[:m], span[:m]
        models.predict(m)
        move = np.where(models.c2 == x, 0, np.where(models.c1 == x, 1, 2))
        cum = np.where(move == 0, 0, np.where(move == 1, models.f2, models.f2 + models.f1))
        freq = np.where(move == 0, models.f2, np.where(move == 1, models.f1, 4096 - models.f2 - models.f1))
        part = sp >> np.uint64(BITS)
        lo += part * cum.astype(np.uint64)
        sp[:] = part * freq.astype(np.uint64)
        lost = np.flatnonzero(move == 2)
        if len(lost):
            l0, s0, left = lo[lost], sp[lost], x[lost].astype(np.int64)
            base = models.row0[lost]
            for level in range(levels):
                if level % 2:
                    push(l0, s0, lost)
                up = 4 * (levels - level)
                nibble = (left >> (up - 4)) & 15
                rows = base + node(level, left >> up)
                table = models.cdf[rows]
                k = np.arange(len(lost))
                under = _scaled(table[k, nibble], nibble)
                over = _scaled(table[k, nibble + 1], nibble + 1)
                part = s0 >> np.uint64(BITS)
                l0 += part * under.astype(np.uint64)
                s0 = part * (over - under).astype(np.uint64)
                models.adapt(rows, table, nibble, level)
            lo[lost], sp[lost] = l0, s0
        push(lo, sp, None)
        models.learn(m, x, move)
    for shift in (32, 16, 0):
        out[np.arange(n), at] = (low >> np.uint64(shift)).astype(np.uint16)
        at += 1
    coded: list[bytes] = [b""] * n
    for k, i in enumerate(order):
        coded[i] = out[k, : at[k]].tobytes() if lengths[k] else b""
    return coded


def decode_blocks(coded: list[bytes], lengths: list[int], levels: int = 4, prior: np.ndarray | None = None) -> list[np.ndarray]:
    """The ids of each block; the inverse of :func:`encode_blocks`."""
    if not coded:
        return []
    order = _order(lengths)
    n, longest = len(coded), int(max(lengths))
    sizes = np.array([lengths[i] for i in order])
    width = max(len(c) // 2 for c in coded) + 8
    words = np.zeros((n, width), np.uint64)
    for k, i in enumerate(order):
        got = np.frombuffer(coded[i], ">u2")
        words[k, : len(got)] = got
    at = np.full(n, 3, np.int64)
    code = words[:, 0] << np.uint64(32) | words[:, 1] << np.uint64(16) | words[:, 2]
    ids = np.zeros((longest, n), np.uint32)
    models = _Models(n, levels, prior)
    low, span = np.zeros(n, np.uint64), np.full(n, _START, np.uint64)

    def pull(low: np.ndarray, span: np.ndarray, code: np.ndarray, who: np.ndarray | None) -> None:
        while True:
            tight = np.flatnonzero(span < _ROOM)
            if not len(tight):
                return
            x, s = low[tight], span[tight]
            cross = ((x ^ (x + s - np.uint64(1))) & ~_LOW32) != 0
            s = np.where(cross, _ROOM - (x & _LOW32), s)
            lanes = tight if who is None else who[tight]
            code[tight] = (code[tight] & _LOW32) << np.uint64(16) | words[lanes, at[lanes]]
            at[lanes] += 1
            low[tight], span[tight] = (x & _LOW32) << np.uint64(16), s << np.uint64(16)

    for t in range(longest):
        m = int(np.searchsorted(-sizes, -t, side="left"))
        lo, sp, co = low[:m], span[:m], code[:m]
        models.predict(m)
        part = sp >> np.uint64(BITS)
        goal = np.minimum((co - lo) // part, np.uint64(4095)).astype(np.int32)
        edge = models.f2 + models.f1
        move = np.where(goal < models.f2, 0, np.where(goal < edge, 1, 2))
        cum = np.where(move == 0, 0, np.where(move == 1, models.f2, edge))
        freq = np.where(move == 0, models.f2, np.where(move == 1, models.f1, 4096 - edge))
        lo += part * cum.astype(np.uint64)
        sp[:] = part * freq.astype(np.uint64)
        x = np.where(move == 0, models.c2, models.c1)
        lost = np.flatnonzero(move == 2)
        if len(lost):
            l0, s0, c0 = lo[lost], sp[lost], co[lost]
            base = models.row0[lost]
            head = np.zeros(len(lost), np.int64)
            for level in range(levels):
                if level % 2:
                    pull(l0, s0, c0, lost)
                rows = base + node(level, head)
                table = models.cdf[rows]
                part = s0 >> np.uint64(BITS)
                goal = np.minimum((c0 - l0) // part, np.uint64(4095)).astype(np.int32)
                edges = _scaled(table, _STEP)
                nibble = np.minimum((edges[:, 1:] <= goal[:, None]).sum(1), 15)
                k = np.arange(len(lost))
                under, over = edges[k, nibble], edges[k, nibble + 1]
                l0 += part * under.astype(np.uint64)
                s0 = part * (over - under).astype(np.uint64)
                models.adapt(rows, table, nibble, level)
                head = head << 4 | nibble
            lo[lost], sp[lost], co[lost] = l0, s0, c0
            x[lost] = head.astype(np.uint32)
        pull(lo, sp, co, None)
        ids[t, :m] = x
        models.learn(m, x, move)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    for k, i in enumerate(order):
        out[i] = ids[: sizes[k], k].copy()
    return out
