"""Runs of repeated words, found online by catchers over completed power-of-two blocks.

Words are appended one after another or in batches. Level ``k`` keeps a catcher for each completed block of ``b = 2**k``
words; a catcher watches the suffix of ``b`` words at a lag of ``b`` to ``2 b - 1`` behind its block and reports when the
two are equal. The lag is then the period of a stretch, whose ends are found by comparing words themselves, so a clash of
hashes cannot give a false run. A stretch that reaches the last word stays open and grows with the words that follow; all
squares of one stretch are so merged into one run.

Why no run is missed: in a run of period ``q`` and exponent 3 or more, words ``q`` apart agree over ``2 q`` words or more,
and with ``b <= q < 2 b`` such a piece holds a whole aligned block. Below an exponent of 3 the lags are doubled, so that a
block fits into ``q`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm.text import mix

_LEFT = np.uint64(0x9E3779B97F4A7C15)
BATCH = 1 << 16  # words appended at a time


class Catchers:
    """All runs of an append-only sequence of numbers, with exponent and length of at least the given ones."""

    def __init__(self, exponent: int = 4, least: int = 6):
        if exponent < 2:
            raise ValueError("a run repeats at least twice")
        self.exponent, self.least = exponent, least
        self.lag = 1 if exponent >= 3 else 2
        self.n = 0
        self.words = np.empty(256, dtype=np.int64)
        self.levels: list[tuple[int, np.ndarray]] = []  # first window kept, hashes of windows from there on
        self.open: dict[int, int] = {}                  # period: start, of the stretches that reach the last word
        self.closed: dict[tuple[int, int], int] = {}    # (start, end): smallest period
        self.until = np.zeros(256, dtype=np.int64)      # end and period of the longest known stretch at a word
        self.period = np.ones(256, dtype=np.int64)

    def append(self, words: np.ndarray) -> None:
        old, n = self.n, self.n + len(words)
        if n > len(self.words):
            room = max(n, 2 * len(self.words)) - old
            self.words = np.concatenate([self.words[:old], np.empty(room, dtype=np.int64)])
            self.until = np.concatenate([self.until[:old], np.zeros(room, dtype=np.int64)])
            self.period = np.concatenate([self.period[:old], np.ones(room, dtype=np.int64)])
        self.words[old:n] = words
        self.n = n
        for q, start in list(self.open.items()):
            end = self._forward(q, max(start, old - q)) + q
            if end < n:
                del self.open[q]
                self._close(start, end, q)
        k = 0
        while 1 << k <= n:
            self._hash(k, old)
            b = 1 << k
            if self._watches(b, n):
                self._catch(b, *self.levels[k], max(0, old - b + 1) if self._watches(b, old) else 0)
            k += 1
        for k, (first, hashes) in enumerate(self.levels):
            surplus = len(hashes) - (8 * self.lag << k) - 2
            if surplus > 0:
                self.levels[k] = first + surplus, hashes[surplus:]

    def _watches(self, b: int, n: int) -> bool:
        """Whether ``n`` words can hold a run of the least period of a level; before that it only keeps its hashes."""
        return (1 if b == 1 else b * self.lag) * self.exponent <= n

    def _hash(self, k: int, old: int) -> None:
        """Hashes of the windows that end with the new words, each from two of half the length."""
        if k == 0:
            new = mix(self.words[old:self.n].view(np.uint64) + np.uint64(1))
        else:
            half = 1 << k - 1
            first, below = self.levels[k - 1]
            low = max(0, old - 2 * half + 1)
            left = below[low - first:self.n - 2 * half + 1 - first]
            new = mix(left * _LEFT + below[low + half - first:self.n - half + 1 - first])
        if k == len(self.levels):
            self.levels.append((0, new))
        else:
            first, before = self.levels[k]
            self.levels[k] = first, np.concatenate([before, new])

    def _catch(self, b: int, first: int, hashes: np.ndarray, low: int) -> None:
        """Advance the catchers of one level over the windows from ``low`` on."""
        window = np.arange(low, self.n - b + 1)
        starts, lags = [], []
        for back in range(1 if b == 1 else self.lag, 2 * self.lag):
            block = (window // b - back) * b
            known = np.flatnonzero(block >= first)
            hit = known[hashes[window[known] - first] == hashes[block[known] - first]]
            starts.append(block[hit])
            lags.append(window[hit] - block[hit])
        start, q = np.concatenate(starts), np.concatenate(lags)
        if not len(start):
            return
        inside = (self.until[start] >= start + q + b) & (q % self.period[start] == 0)
        for p, s in self.open.items():
            inside |= (start >= s) & (q % p == 0)
        order = np.lexsort((start[~inside], q[~inside]))
        start, q = start[~inside][order], q[~inside][order]
        if len(start):  # hits of neighbouring blocks at one lag lie in one stretch
            new = np.concatenate([[True], (np.diff(q) != 0) | (np.diff(start) != b)])
            start, q = start[new], q[new]
        last, end = 0, 0
        for s, p in zip(start.tolist(), q.tolist(), strict=True):
            if p == last and s + p + b <= end or p in self.open and self.open[p] <= s:
                continue
            stop = self._forward(p, s)
            if stop - s < b:  # equal hashes of other words
                continue
            last, end = p, stop + p
            if end == self.n:
                self.open[p] = self._backward(p, s)
            else:
                self._close(self._backward(p, s), end, p)

    def _forward(self, q: int, at: int) -> int:
        """The first place from ``at`` on where the word ``q`` later differs or is not there yet."""
        step, last = 16, self.n - q
        while at < last:
            to = min(last, at + step)
            same = self.words[at:to] == self.words[at + q:to + q]
            if not same.all():
                return at + int(same.argmin())
            at, step = to, step * 2
        return at

    def _backward(self, q: int, at: int) -> int:
        step = 16
        while at:
            low = max(0, at - step)
            same = self.words[low:at] == self.words[low + q:at + q]
            if not same.all():
                return low + len(same) - int(same[::-1].argmin())
            at, step = low, step * 2
        return at

    def _long(self, start: int, end: int, q: int) -> bool:
        return end - start >= max(self.least, self.exponent * q)

    def _close(self, start: int, end: int, q: int) -> None:
        if end - start < 2 * q:
            return
        at = slice(start, end)
        longer = self.until[at] < end
        self.period[at][longer] = q
        self.until[at][longer] = end
        if self._long(start, end, q):
            self.closed[start, end] = min(q, self.closed.get((start, end), q))

    def runs(self) -> list[tuple[int, int, int]]:
        """``(start, length, period)`` of the runs of the words so far, by start, then period."""
        found = dict(self.closed)
        for q, start in self.open.items():
            if self._long(start, self.n, q):
                found[start, self.n] = min(q, found.get((start, self.n), q))
        return sorted((s, e - s, q) for (s, e), q in found.items())


def numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def runs_of(words: list[bytes], exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    if len(words) < least:
        return []
    seen = Catchers(exponent, least)
    values = numbers(words)
    for at in range(0, len(values), BATCH):
        seen.append(values[at:at + BATCH])
    return seen.runs()


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by period, compared exactly; of equal ones the first, then that of the least period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: of each run its first period stays."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic(docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """One row per document: ``key``, ``runs`` as structs (start, length, period), the place of the ``best`` one in that list
    (null: none), and ``kept``, the words without repeats, joined by one space.

    A text is one unit of work and its words are held in memory once; nothing is shuffled. Null and empty texts have no
    runs and keep an empty text. Null and repeated keys stay as rows of their own, an empty table gives no rows, and other
    columns are not read. Ties for the best run go to the least start, then the least period.
    """

    narrow = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([
        T.StructField(key, narrow.schema[0].dataType),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
        T.StructField("best", T.IntegerType()), T.StructField("kept", T.StringType())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_runs, best, kept = [], [], []
            for value in batch.column(1).cast(pa.large_binary()):
                words = value.as_buffer().to_pybytes().split() if value.is_valid else []
                runs = runs_of(words, exponent, least)
                all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                best.append(runs.index(strongest(runs)) if runs else None)
                kept.append(b" ".join(collapsed(words, runs)).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(all_runs, pa.list_(_RUN)), pa.array(best, pa.int32()), pa.array(kept, pa.string())],
                names=schema.names)

    return narrow.mapInArrow(found, schema)


def planted(key: Column, text: Column) -> Column:
    """The text, or for a tenth of the keys, by a checksum, its words with the last part made periodic.

    With ``h`` the checksum of the decimal key and ``g`` a tenth of it, words from ``a = g % n`` on repeat with a period of
    ``1 + (n - a) / (3 + g % 8)``. A null key has no checksum, and its text stays as it is.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(s: Column) -> Column:
        n = F.size(s["w"]).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.array_join(F.transform(place, lambda i: F.get(s["w"], i)), " ")

    made = F.transform(F.filter(F.array(F.struct(words.alias("w"))), lambda s: F.size(s["w"]) > 0), repeated)
    return F.when((h % 10 == 0) & (F.length(text) > 0), F.coalesce(F.get(made, F.lit(0)), text)).otherwise(text)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the best run and checksums of all runs and of the kept words."""
    best = F.get("runs", F.col("best"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        key, F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * get(runs, best).length div get(runs, best).period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"))
