"""Adaptive context-mixing range coder for token ids below 65536, many blocks in lockstep.

Every block starts from the same empty model and is coded on its own. Three models each
give a probability to every id. Order 0: the block's ids so far, by groups of 64 ids. Orders 1 and 2: the id that
last followed the one, or the two, ids before, with the share of cases in which such a
prediction held at its confidence so far; what is left of the share goes to order 0. The three are
mixed by weights that are multiplied by the probability that each model gave to the id
that came, so that they move to the models that predict the block best. The id is coded at
its place in the cumulative mixture, in a single step. Encoder and
decoder run the same numpy steps over all blocks of a call, one id of each
block a step; all arithmetic on probabilities is elementwise, so that both get the same bits.

Token files are coded by the same steps in the JVM (`RangeCoder.java`, to the same bytes); a change here is one there.
"""

from __future__ import annotations

import numpy as np

#: Slots of the hashed order-1 and order-2 tables.
SLOTS = 4096
GROUPS = 1024  # of 64 ids each
#: Ids between rebuilds of the order-0 distribution (also after 16).
REBUILD = 128
LANES = 2048
_TOP, _LOW = np.uint64(1 << 48), np.uint64(1 << 32)
_W, _FULL = np.uint64(16), np.uint64(0xFFFFFFFFFFFFFFFF)
#: The cumulative mixture: order 0 in 2**20 parts (2**14 of groups), candidates in 2**12.
_ZERO, _CUMULATED, _MIXED = 20, 14, 12
_TOTAL = np.uint64(_ZERO + _MIXED)
#: What each weight gets back at every step, so that none vanishes.
_SHARE = 0.01


class _Model:
    def __init__(self, lanes: int):
        self.n = lanes
        self.lane = np.arange(lanes)
        self.guess = [np.zeros(lanes * SLOTS, np.uint16) for _ in range(2)]  # of order 1 and 2
        self.trust = [np.zeros(lanes * SLOTS, np.uint8) for _ in range(2)]
        self.hit = [np.full(lanes * 16, 2048, np.int32), np.full(lanes * 16, 4096, np.int32)]  # of 65536, by trust
        self.count = np.ones(lanes * GROUPS, np.int32)
        self.cdf = np.zeros((lanes, GROUPS + 1), np.int64)
        self.mix = [np.full(lanes, 1 / 3) for _ in range(3)]  # weights of orders 0, 1 and 2
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.base = [self.lane * SLOTS, self.lane * 16, self.lane * GROUPS, self.lane * (GROUPS + 1)]
        self.step = 0

    def shrink(self, lanes: int) -> None:
        """Only the first lanes go on."""
        self.n = lanes
        self.lane, self.one, self.two = self.lane[:lanes], self.one[:lanes], self.two[:lanes]
        self.base = [x[:lanes] for x in self.base]
        self.mix = [x[:lanes] for x in self.mix]

    def weigh(self) -> None:
        """The candidates of orders 1 and 2, their parts of the mixture, and the part of order 0."""
        if self.step % REBUILD == 0 or self.step == 16:
            c = self.count[: self.n * GROUPS].reshape(self.n, GROUPS)
            share = 1 + c * np.int64((1 << _CUMULATED) - GROUPS) // c.sum(axis=1, keepdims=True)
            np.cumsum(share, axis=1, out=self.cdf[: self.n, 1:])
            self.cdf[: self.n, GROUPS] = 1 << _CUMULATED
        self.step += 1
        self.at1 = self.base[0] + ((self.one * 40503) >> 4 & (SLOTS - 1))
        self.at2 = self.base[0] + ((self.one * 40503 + self.two * 30011) >> 5 & (SLOTS - 1))
        self.g1, self.g2 = self.guess[0][self.at1], self.guess[1][self.at2]
        self.t1, self.t2 = self.trust[0][self.at1], self.trust[1][self.at2]
        self.c1, self.c2 = self.base[1] + self.t1, self.base[1] + self.t2
        self.p1, self.p2 = self.hit[0][self.c1], self.hit[1][self.c2]
        self.m1 = (self.mix[1] * self.p1 * (1 / (1 << 16 - _MIXED))).astype(np.int64)
        self.m2 = (self.mix[2] * self.p2 * (1 / (1 << 16 - _MIXED))).astype(np.int64)
        self.rest = (1 << _MIXED) - self.m1 - self.m2

    def zero(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of ids in order 0."""
        at = self.base[3] + (ids >> 6)
        flat = self.cdf.reshape(-1)
        c = flat[at]
        f = flat[at + 1] - c
        return (c << 6) + f * (ids & 63), f

    def place(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of ids in the mixture; remembers what `learn` needs."""
        start, self.f = self.zero(ids)
        self.right1, self.right2 = self.g1 == ids, self.g2 == ids
        begin = ((self.g1 < ids) * self.m1 + (self.g2 < ids) * self.m2 << _ZERO) + self.rest * start
        size = (self.right1 * self.m1 + self.right2 * self.m2 << _ZERO) + self.rest * self.f
        return begin.astype(np.uint64), size.astype(np.uint64)

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids at places of the mixture."""
        swap = self.g1 > self.g2
        low, high = np.where(swap, self.g2, self.g1).astype(np.int64), np.where(swap, self.g1, self.g2).astype(np.int64)
        first = np.where(swap, self.m2, self.m1) << _ZERO
        both = self.m1 + self.m2 << _ZERO
        start, f = self.zero(low)
        begin = self.rest * start
        end = begin + first + self.rest * f
        start, f = self.zero(high)
        begin2 = first + self.rest * start
        end2 = begin2 + both - first + self.rest * f
        x = np.where(v < end, low, high)
        other = np.flatnonzero((v < begin) | (v >= end) & (v < begin2) | (v >= end) & (v >= end2))
        if len(other):
            u = v[other]
            u = u - np.where(u < begin[other], 0, np.where(u < begin2[other], first[other], both[other]))
            u //= self.rest[other]
            goal, base, flat = u >> 6, self.base[3][other], self.cdf.reshape(-1)
            at = base.copy()
            for bit in (512, 256, 128, 64, 32, 16, 8, 4, 2, 1):
                at += bit * (flat[at + bit] <= goal)
            c = flat[at]
            x[other] = ((at - base) << 6) + (u - (c << 6)) // (flat[at + 1] - c)
        return x

    def learn(self, ids: np.ndarray) -> None:
        zero = self.f * (1 / (1 << _ZERO))
        s1, s2 = self.p1 * (1 / 65536), self.p2 * (1 / 65536)
        w0 = self.mix[0] * zero
        w1 = self.mix[1] * (self.right1 * s1 + (1 - s1) * zero)
        w2 = self.mix[2] * (self.right2 * s2 + (1 - s2) * zero)
        scale = (1 - 3 * _SHARE) / (w0 + w1 + w2)
        self.mix = [w0 * scale + _SHARE, w1 * scale + _SHARE, w2 * scale + _SHARE]
        for k, (at, guess, cell, p, right, t) in enumerate(((self.at1, self.g1, self.c1, self.p1, self.right1, self.t1), (self.at2, self.g2, self.c2, self.p2, self.right2, self.t2))):
            self.hit[k][cell] = p + np.where(right, 64512 - p, 512 - p) // 16
            self.trust[k][at] = np.where(right, np.minimum(t + 1, 15), t >> 1)
            self.guess[k][at] = np.where(right | (t < 2), ids, guess)
        self.count[self.base[2] + (ids >> 6)] += 24
        self.two, self.one = self.one, ids


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded bytes of each block of ids (uint16)."""
    out: list[bytes] = []
    for i in range(0, len(blocks), LANES):
        out += _encode(blocks[i : i + LANES])
    return out


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of lanes, longest first, and how many are still running at each step."""
    order = np.argsort(-lengths, kind="stable")
    running = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
    return order, running


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    lengths = np.array([len(b) for b in blocks])
    order, running = _by_length(lengths)
    n = len(blocks)
    ids = np.zeros((len(running), n), np.uint16)
    for k, b in enumerate(order):
        ids[: lengths[b], k] = blocks[b]
    out = np.zeros((n, int(len(running) * 2 + 8)), np.uint16)
    used = np.zeros(n, np.int64)
    low, span = np.zeros(n, np.uint64), np.full(n, _FULL)
    model = _Model(n)

    def put(lanes, start, size, bits) -> None:
        """Narrow the range of lanes to [start, start + size) of 2**bits, and write what is settled."""
        r = span[lanes] >> bits
        a = low[lanes] + r * start
        r = r * size
        go = None
        while True:
            settled = (a ^ (a + r)) < _TOP
            tight = ~settled & (r < _LOW)
            if tight.any():
                r = np.where(tight, (~a + np.uint64(1)) & (_LOW - np.uint64(1)), r)
                settled |= tight
            go = np.flatnonzero(settled)
            if not len(go):
                break
            who = lanes[go]
            out[who, used[who]] = (a[go] >> np.uint64(48)).astype(np.uint16)
            used[who] += 1
            a[go] <<= _W
            r[go] <<= _W
        low[lanes], span[lanes] = a, r

    for t, live in enumerate(running):
        if live < model.n:
            model.shrink(live)
        x = ids[t, :live].astype(np.int64)
        model.weigh()
        put(model.lane, *model.place(x), _TOTAL)
        model.learn(x)
    for _ in range(4):
        out[np.arange(n), used] = (low >> np.uint64(48)).astype(np.uint16)
        used += 1
        low <<= _W
    coded: list[bytes] = [b""] * n
    for k, b in enumerate(order):
        coded[b] = out[k, : used[k]].astype("<u2").tobytes()
    return coded


def decode(coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of blocks, given how many each has."""
    out: list[np.ndarray] = []
    for i in range(0, len(coded), LANES):
        out += _decode(coded[i : i + LANES], np.array(lengths[i : i + LANES]))
    return out


def _decode(coded: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    order, running = _by_length(lengths)
    n = len(coded)
    words = [np.frombuffer(coded[b], "<u2") for b in order]
    begin = np.concatenate(([0], np.cumsum([len(w) + 4 for w in words])))
    data = np.zeros(begin[-1] + 8, np.uint64)
    for k, w in enumerate(words):
        data[begin[k] : begin[k] + len(w)] = w
    ids = np.zeros((len(running), n), np.uint16)
    low, span, code = np.zeros(n, np.uint64), np.full(n, _FULL), np.zeros(n, np.uint64)
    next_word = begin[:-1].copy()
    for _ in range(4):
        code = code << _W | data[next_word]
        next_word += 1
    model = _Model(n)

    def take(lanes, start, size, bits) -> None:
        r = span[lanes] >> bits
        a = low[lanes] + r * start
        r = r * size
        v = code[lanes]
        while True:
            settled = (a ^ (a + r)) < _TOP
            tight = ~settled & (r < _LOW)
            if tight.any():
                r = np.where(tight, (~a + np.uint64(1)) & (_LOW - np.uint64(1)), r)
                settled |= tight
            go = np.flatnonzero(settled)
            if not len(go):
                break
            who = lanes[go]
            v[go] = v[go] << _W | data[np.minimum(next_word[who], len(data) - 1)]
            next_word[who] += 1
            a[go] <<= _W
            r[go] <<= _W
        low[lanes], span[lanes], code[lanes] = a, r, v

    top = np.uint64((1 << int(_TOTAL)) - 1)
    for t, live in enumerate(running):
        if live < model.n:
            model.shrink(live)
        model.weigh()
        lanes = model.lane
        x = model.find(np.minimum((code[lanes] - low[lanes]) // (span[lanes] >> _TOTAL), top).astype(np.int64))
        take(lanes, *model.place(x), _TOTAL)
        ids[t, :live] = x
        model.learn(x)
    out: list[np.ndarray] = [ids[:0, 0] if n else np.zeros(0, np.uint16)] * n
    for k, b in enumerate(order):
        out[b] = ids[: lengths[b], k].copy()
    return out
