"""Range asymmetric numeral coding of token ids with shared static frequencies, in numpy.

A block's ids are dealt to ``LANES`` coders in turn, which share one stream of 32-bit words. States are in
[2**31, 2**63) and frequencies sum to 2**BITS, so one word is moved at most for each id. At every ``STEPS`` steps a
checkpoint holds the states of the lanes and the place in the stream, and decoding can begin at any of them; here
all stretches between checkpoints, of many blocks, are decoded side by side.
"""

from __future__ import annotations

import zlib

import numpy as np

BITS, LANES, STEPS = 20, 16, 256
BLOCK = 4 * LANES * STEPS
_LOW = np.uint64(1 << 31)


class Frequencies:
    """Frequencies of ids, scaled to a sum of 2**BITS; every id that occurs has one."""

    def __init__(self, ids: np.ndarray, scaled: np.ndarray):
        self.ids, self.scaled = ids, scaled.astype(np.uint64)
        self.filler = int(ids[np.argmax(scaled)]) if len(ids) else 0
        self.first = np.concatenate([[0], np.cumsum(self.scaled)[:-1]]).astype(np.uint64) if len(ids) else self.scaled
        self.index = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.int64)
        self.index[ids] = np.arange(len(ids))
        self.at_slot = np.repeat(np.arange(len(ids), dtype=np.int32), self.scaled.astype(np.int64))

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray) -> Frequencies:
        if len(ids) > 1 << (BITS - 1):
            raise ValueError("too many different ids for the frequency table")
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order].astype(np.float64)
        spare = (1 << BITS) - len(ids)  # one slot for each id, the rest in proportion
        extra = np.floor(counts / counts.sum() * spare).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        scaled = extra + 1
        if len(ids):
            scaled[np.argmax(scaled)] += (1 << BITS) - scaled.sum()
        return cls(ids, scaled)


def encode(blocks: np.ndarray, table: Frequencies) -> list[tuple[bytes, bytes]]:
    """Stream and checkpoints of each row of ``blocks``, whose length is a multiple of ``LANES``."""
    n, length = blocks.shape
    steps = length // LANES
    at = table.index[blocks].reshape(n, steps, LANES)
    states = np.full((n, LANES), _LOW, dtype=np.uint64)
    words = np.zeros((n, steps, LANES), dtype=np.uint32)
    moved = np.zeros((n, steps, LANES), dtype=bool)
    marks = {}
    for t in range(steps - 1, -1, -1):
        f, c = table.scaled[at[:, t]], table.first[at[:, t]]
        full = states >= f << np.uint64(63 - BITS)
        words[:, t] = states & np.uint64(0xFFFFFFFF)
        moved[:, t] = full
        states = np.where(full, states >> np.uint64(32), states)
        d = states // f
        states = (d << np.uint64(BITS)) + (states - d * f) + c
        if t % STEPS == 0:
            marks[t] = states
    out = []
    for b in range(n):
        stream = words[b][moved[b]]
        done = np.concatenate([[0], np.cumsum(moved[b].sum(axis=1))])
        points = b"".join(np.uint32(done[t]).tobytes() + marks[t][b].astype("<u8").tobytes() for t in sorted(marks))
        out.append((stream.astype("<u4").tobytes(), points))
    return out


def decode(coded: list[tuple[bytes, bytes, int]], table: Frequencies) -> list[np.ndarray]:
    """The ids of blocks given as stream, checkpoints and number of ids; stretches are decoded side by side."""
    size = 4 + 8 * LANES
    stretches = []
    for b, (stream, points, n) in enumerate(coded):
        steps = -(-n // LANES)
        for k in range(len(points) // size):
            p = points[k * size:(k + 1) * size]
            stretches.append((b, min(STEPS, steps - k * STEPS), int(np.frombuffer(p[:4], "<u4")[0]), np.frombuffer(p[4:], "<u8")))
    streams = np.concatenate([*(np.frombuffer(s, "<u4") for s, _, _ in coded), np.zeros(LANES, np.uint32)])
    base = np.concatenate([[0], np.cumsum([len(s) // 4 for s, _, _ in coded])])
    place = np.array([base[b] + w for b, _, w, _ in stretches], dtype=np.int64)
    states = np.array([s for *_, s in stretches], dtype=np.uint64).reshape(-1, LANES)
    lasts = np.array([s for _, s, _, _ in stretches])
    out = np.zeros((len(stretches), STEPS, LANES), dtype=np.uint32)
    for t in range(int(lasts.max(initial=0))):
        slot = states & np.uint64((1 << BITS) - 1)
        s = table.at_slot[slot]
        out[:, t] = table.ids[s]
        states = table.scaled[s] * (states >> np.uint64(BITS)) + slot - table.first[s]
        low = (states < _LOW) & (t < lasts)[:, None]
        take = np.cumsum(low, axis=1)
        word = streams[np.minimum(place[:, None] + take - 1, len(streams) - 1)]
        states = np.where(low, (states << np.uint64(32)) | word.astype(np.uint64), states)
        place += take[:, -1]
    ids, k = [], 0
    for _, points, n in coded:
        m = len(points) // size
        ids.append(out[k:k + m].reshape(-1)[:n].astype("<u4"))
        k += m
    return ids


_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32; the highest bit is the constant term."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def join_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two strings in a row from the CRC of each, and the size of the second."""
    power, square, bits = 1 << 31, 1 << 30, 8 * size  # x**0, x**1
    while bits:
        if bits & 1:
            power = _times(power, square)
        square = _times(square, square)
        bits >>= 1
    return _times(power, first) ^ second


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
