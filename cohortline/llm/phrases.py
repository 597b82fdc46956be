"""Repeated passages: words covered by a window of words that also begins elsewhere are removed.

1. Each window is represented by its least phrase (a run of ``PHRASE`` words, by hash). Equal windows have equal least
   phrases, so a window can recur only if its phrase was chosen at two places at least; these phrases are counted.
2. Texts with a recurring phrase are written once each, in shards. Their windows at such phrases are counted by phrase
   and window hash (128 bits together), summed within each task first; those found twice are confirmed.
3. Each shard gets the confirmed windows that occur in it, however often they do elsewhere. It compiles an Aho-Corasick
   automaton of their phrases and streams its texts: around each located phrase the windows are compared with the
   confirmed ones, and the words they cover go.

Windows are judged on the input texts, copies and repeated rows included. Null texts and texts of fewer words than a window
lose nothing. Each input row gives one row, also null and repeated keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm import text as tx
from cohortline.session import materialize

PHRASE = 8


def slide(op, v: np.ndarray, width: int) -> np.ndarray:
    """``op`` (minimum or maximum) over each run of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        v = op(v[:-step], v[step:])
        done += step
    return v


def phrase_values(words: np.ndarray, window: int) -> np.ndarray:
    return tx.windows_hashed(words, min(PHRASE, window))


def window_values(values: np.ndarray, window: int) -> np.ndarray:
    """The least phrase of each window."""
    return slide(np.minimum, values, window - min(PHRASE, window) + 1)


def chosen(values: np.ndarray, window: int) -> np.ndarray:
    """The phrases that are the least of some window, at most two of a kind."""
    width = window - min(PHRASE, window) + 1
    if len(values) < width:
        return values[:0]
    least = window_values(values, window)
    edge = np.zeros(width - 1, dtype=np.uint64)
    of_any = slide(np.maximum, np.concatenate([edge, least, edge]), width)
    found, times = np.unique(values[of_any == values], return_counts=True)
    return np.concatenate([found, found[times > 1]])


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _surveyed(docs: DataFrame, window: int) -> DataFrame:
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("whole", T.StringType()),
                         T.StructField("phrases", T.ArrayType(T.LongType()))])

    @F.arrow_udf(kind)
    def survey(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            n, whole, phrases = [], [], []
            for data in tx.text_bytes(column):
                words = data.tobytes().split()
                n.append(len(words))
                whole.append(_digest(words))
                values = phrase_values(tx.word_hashes(data), window) if len(words) >= window else np.zeros(0, np.uint64)
                phrases.append(chosen(values, window).view(np.int64))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(whole, pa.string()), pa.array(phrases, pa.list_(pa.int64()))],
                                             names=["n_words", "whole", "phrases"])

    return docs.withColumn("s", survey("text")).select("key", "mark", "s.*")


def _windows(shards: DataFrame, window: int) -> DataFrame:
    """``shard, phrase, window, times`` of the windows at recurring phrases, summed over the texts of a task."""
    names = ["shard", "phrase", "window", "times"]

    def summed(parts):
        a, h, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((h, a))
        a, h, w = a[order], h[order], w[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])])) if len(a) else np.zeros(0, np.int64)
        return a[new], h[new], np.add.reduceat(w, new) if len(new) else w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def rows():
            for shard, parts in held.items():
                a, h, w = summed(parts)
                for at in range(0, len(a), 100_000):
                    p = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[p]), shard)), pa.array(a[p].view(np.int64)),
                                                      pa.array(h[p].view(np.int64)), pa.array(w[p])], names=names)

        size = 0
        for batch in batches:
            for shard, copies, data, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), tx.text_bytes(batch.column(2)),
                                                  batch.column(3), strict=True):
                words = tx.word_hashes(data)
                values = phrase_values(words, window)
                least = window_values(values, window)
                at = np.flatnonzero(among(least, np.sort(np.asarray(known.values).view(np.uint64))))
                part = summed([(least[at], tx.windows_hashed(words, window)[at], np.full(len(at), copies, dtype=np.int64))])
                held.setdefault(shard, []).append(part)
                size += len(part[0])
            if size > 2_000_000:
                yield from rows()
                held.clear()
                size = 0
        yield from rows()

    return shards.select("shard", "copies", "text", "phrases").mapInArrow(run, "shard long, phrase long, window long, times long")


def among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``wanted``."""
    if not len(wanted):
        return np.zeros(len(values), dtype=bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


class Confirmed:
    """Pairs of phrase and window, looked up in bulk."""

    def __init__(self, phrases: np.ndarray, windows: np.ndarray):
        order = np.lexsort((phrases, windows))
        self.phrases, self.windows = phrases[order], windows[order]
        same = np.diff(np.flatnonzero(np.concatenate([[True], self.windows[1:] != self.windows[:-1], [True]]))) if len(order) else [0]
        self.most = int(np.max(same))

    def has(self, phrases: np.ndarray, windows: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.windows, windows)
        out = np.zeros(len(windows), dtype=bool)
        for j in range(self.most):
            k = np.minimum(at + j, len(self.windows) - 1)
            out |= (self.windows[k] == windows) & (self.phrases[k] == phrases)
        return out


def _removed(shards: DataFrame, confirmed: DataFrame, window: int) -> DataFrame:
    """``mark, n_removed, kept_sha256`` of the texts that lose words."""
    width = min(PHRASE, window)

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        import ahocorasick

        marks, removed, digests = [], [], []
        if texts.num_rows and pairs.num_rows:
            column = lambda c: pairs.column(c).to_numpy().view(np.uint64)
            known = Confirmed(column("phrase"), column("window"))
            wanted = np.unique(known.phrases)
            automaton = ahocorasick.Automaton()
            seen: set[int] = set()
            split = []
            for data in (x for chunk in texts.column("text").chunks for x in tx.text_bytes(chunk)):
                words = data.tobytes().decode("utf-8", "surrogatepass")
                words = words.translate(_WHITE).split(" ")
                words = [w for w in words if w]
                hashes = tx.word_hashes(data)
                values = phrase_values(hashes, window)
                split.append((words, hashes, values))
                if len(seen) < len(wanted):
                    for p in np.flatnonzero(among(values, wanted)):
                        if int(values[p]) not in seen:
                            seen.add(int(values[p]))
                            automaton.add_word(" " + " ".join(words[p:p + width]) + " ", int(values[p]))
            if seen:
                automaton.make_automaton()
            for mark, (words, hashes, values) in zip(texts.column("mark").to_pylist(), split, strict=True):
                joined = " " + " ".join(words) + " "
                ends = np.cumsum([len(w) + 1 for w in words])  # where the space after each word is
                found = [e for e, _ in automaton.iter(joined)] if seen else []
                if not found:
                    continue
                windows = tx.windows_hashed(hashes, window)
                first = np.searchsorted(ends, np.array(found)) - width + 1
                near = np.zeros(len(values) + 1, dtype=np.int32)  # windows with a located phrase in them
                np.add.at(near, np.maximum(first - (window - width), 0), 1)
                np.add.at(near, first + 1, -1)
                at = np.flatnonzero(np.cumsum(near)[:len(windows)] > 0)
                flags = np.zeros(len(windows), dtype=bool)
                flags[at] = known.has(window_values(values, window)[at], windows[at])
                if flags.any():
                    gone = tx.covered(flags, window, len(words))
                    marks.append(mark)
                    removed.append(int(gone.sum()))
                    digests.append(_digest([w.encode("utf-8", "surrogatepass") for w, g in zip(words, gone, strict=True) if not g]))
        return pa.table({"mark": pa.array(marks, pa.binary()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    return shards.select("shard", "mark", "text").groupBy("shard").cogroup(confirmed.groupBy("shard")).applyInArrow(
        run, "mark binary, n_removed long, kept_sha256 string")


_WHITE = {c: " " for c in (9, 10, 11, 12, 13)}


def without_repeats(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``n_removed`` and ``kept_sha256`` of the words left, joined by spaces.

    An empty table gives no rows; other columns are not read. A text is judged whole, and its words are held by one task.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.unhex(F.md5(F.col("text").cast("binary"))))
    surveyed = materialize(_surveyed(rows, window))

    each = surveyed.select("mark", F.explode("phrases").alias("phrase"))
    recurring = each.groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1").select("phrase")
    lists = each.distinct().join(recurring, "phrase").groupBy("mark").agg(F.collect_list("phrase").alias("phrases"))
    copies = surveyed.groupBy("mark").agg(F.count("*").alias("copies"))
    texts = rows.groupBy("mark").agg(F.first("text").alias("text"))
    shards = materialize(texts.join(lists, "mark").join(copies, "mark").withColumn("shard", F.spark_partition_id().cast("long")))

    windows = _windows(shards, window).groupBy("phrase", "window").agg(F.sum("times").alias("times"), F.collect_set("shard").alias("in"))
    confirmed = windows.where("times > 1").select(F.explode("in").alias("shard"), "phrase", "window")
    removed = _removed(shards, confirmed, window)
    return surveyed.select("key", "mark", "n_words", "whole").join(removed, "mark", "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
