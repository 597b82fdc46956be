"""Helpers of the operators: words as numpy hashes, state kept by a Python worker, keys of rows.

A word here is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
Equal words have equal 64-bit hashes on every executor and in every run.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95
_CHUNK = 1 << 18


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def per_process(key: str, make):
    """A value made once in each Python worker process, such as a tokenizer."""
    store = sys.__dict__.setdefault("_llm_worker_state", {})
    if key not in store:
        store[key] = make()
    return store[key]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and ``base ** -i`` modulo 2**64 for ``i < n``."""

    def make():
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(n, dtype=np.uint64)
            done = 1
            while done < n:  # the first powers times a power give the next ones
                take = min(done, n - done)
                p[done:done + take] = p[:take] * np.uint64(pow(b, done, 1 << 64))
                done += take
            out.append(p)
        return tuple(out)

    return per_process(f"powers {base} {n}", make)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def runs_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run ``data[start:end]`` of bytes; runs are sorted and apart."""
    out = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):  # memory stays small in long texts
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        if b - a > _CHUNK:
            h = 0
            for c in range(a, b, _CHUNK):
                p, _ = powers(_BASE, _CHUNK)
                piece = data[c:min(b, c + _CHUNK)].astype(np.uint64) + np.uint64(1)
                h = (h + int((piece * p[:len(piece)]).sum(dtype=np.uint64)) * pow(_BASE, c - a, 1 << 64)) & _MASK
            out[i] = h
        else:
            p, q = powers(_BASE, _CHUNK)
            total = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * p[:b - a], out=total[1:])
            out[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * q[starts[i:j] - a]
        i = j
    return mix(out)


def white(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text's bytes."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = np.diff(np.concatenate([[0], (~white(data)).view(np.int8), [0]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    return runs_hashed(data, *word_spans(data))


def windows_hashed(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` word hashes; none if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for a in range(0, n, _CHUNK // 2):
        b = min(n, a + _CHUNK // 2)
        p, q = powers(_STEP, _CHUNK // 2 + k)
        part = words[a:b + k - 1]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * p[:len(part)], out=total[1:])
        out[a:b] = (total[k:] - total[:len(part) - k + 1]) * q[:b - a]
    return mix(out)


def covered(flags: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of ``n`` words, those inside a flagged window of ``k`` words."""
    step = np.zeros(n + 1, dtype=np.int32)
    at = np.flatnonzero(flags)
    step[at] += 1
    step[at + k] -= 1
    return np.cumsum(step[:n]) > 0


def text_bytes(column: pa.Array):
    """The UTF-8 bytes of each text; a null is an empty text."""
    for value in column.cast(pa.large_binary()):
        yield np.frombuffer(value.as_buffer(), dtype=np.uint8) if value.is_valid and len(value.as_buffer()) else np.zeros(0, np.uint8)
