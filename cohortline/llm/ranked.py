"""Ranked lexical search by intervals of documents, bounded through range maxima of posting lists.

Two passes. The first reads the texts and keeps of each document its length and its counts of the terms that are asked for;
the counts of all documents give each term its weight. In the second each task searches its own documents, in blocks: each
term has a posting list of impacts with a sparse table, which tells the place of the greatest impact in any range of
the list. An interval of documents cannot hold a score above the sum of its terms' range maxima. The intervals of an item are
taken best bound first; each is split at the document of its greatest impact, which is scored exactly, and both sides
get bounds of their own. An item is done when no interval can reach its k-th score. Splits of many intervals are made
together as arrays. The best of all tasks are merged in two steps.

All numbers are 64-bit integers, but for the logarithm in a term's weight.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.session import materialize

_LETTERS = bytes(b for b in range(128) if not chr(b).isalnum())
#: Lower-cases A-Z and makes spaces of all other ASCII characters but letters and digits; bytes beyond ASCII stay.
_TABLE = bytes.maketrans(_LETTERS + bytes(range(65, 91)), b" " * len(_LETTERS) + bytes(range(97, 123)))
BLOCK_POSTINGS = 1 << 20  # postings that a task holds at a time, besides those of one document
ITEM_TERMS = 200_000      # terms of items, repeats over items counted, that are sent to the tasks at once
FEW, MANY = 16, 512       # intervals of one item split together, at first and at most
PER_TERM = 1_000_000_000


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class RangeMaxima:
    """Places of the greatest value in ranges of an array, by a sparse table of spans of power-of-two lengths."""

    def __init__(self, values: np.ndarray, longest: int | None = None):
        self.values = values
        place = np.arange(len(values), dtype=np.int32)
        self.levels = [place]
        span = 1
        while 2 * span <= (len(values) if longest is None else longest):
            left, right = self.levels[-1][:-span], self.levels[-1][span:]
            self.levels.append(np.where(values[right] > values[left], right, left))
            span *= 2
        size = len(values)
        self.base = np.concatenate([[0], np.cumsum([len(x) for x in self.levels])])[:-1]
        self.table = np.concatenate(self.levels) if size else np.zeros(0, np.int32)
        self.levels = []

    def places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each range ``[low, high)``, none of them empty, the first place of its greatest value."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        at = self.base[level]
        left, right = self.table[at + low], self.table[at + high - (1 << level.astype(np.int64))]
        return np.where(self.values[right] > self.values[left], right, left)


class Block:
    """Posting lists of some documents, sorted by term, then by document."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, weights: np.ndarray, order: np.ndarray):
        """``order`` gives each document its place among all keys of the block, for ties."""
        n = len(m)
        rare = np.full(n, -1, dtype=np.int64)  # documents that share a rare term come together, which sharpens the bounds
        np.maximum.at(rare, doc, weights[term] * (len(weights) + 1) + term)
        self.documents = np.lexsort((order, rare))
        local = np.empty(n, dtype=np.int64)
        local[self.documents] = np.arange(n)
        self.order = order[self.documents]
        doc = local[doc]
        by = np.lexsort((doc, term))
        doc, term, tf = doc[by], term[by], tf[by]
        impact = weights[term] * ((PER_TERM * tf) // (1000 * tf + 20 * m[self.documents][doc]))
        self.n = n
        self.key = term * (n + 1) + doc  # ascending, so one search finds places of many terms and documents
        self.first = np.searchsorted(self.key, np.arange(len(weights) + 1) * (n + 1))
        self.lists = RangeMaxima(impact, int(np.diff(self.first).max(initial=0)))
        self.doc, self.impact = doc, impact
        self.earliest = RangeMaxima(-self.order)

    def _bounds(self, low: np.ndarray, high: np.ndarray):
        """Of intervals with posting ranges, one row for each interval and one column for each term: bound and split document."""
        value = np.zeros(low.shape, dtype=np.int64)
        split = np.zeros(low.shape, dtype=np.int64)
        some = low < high
        at = self.lists.places(low[some], high[some])
        value[some], split[some] = self.impact[at], self.doc[at]
        best = value.argmax(axis=1)
        return value.sum(axis=1), split[np.arange(len(split)), best]

    def best(self, asked: np.ndarray, k: int, floor: int = 0) -> list[tuple[int, int]]:
        """``(score, document)`` of the ``k`` best documents for the terms ``asked``, by score, then by order.

        Documents below ``floor`` may be left out; scores of 0 are.
        """
        low, high = self.first[asked], self.first[asked + 1]
        asked, low, high = asked[low < high], low[low < high], high[low < high]
        if not len(asked):
            return []
        top: list[tuple[int, int, int]] = []  # a heap: score, minus the order, document
        bound, split = self._bounds(low[None], high[None])
        made = 0  # numbers the intervals, so that those of equal bounds compare
        queue = [(-int(bound[0]), made, 0, self.n, int(split[0]), low, high)]
        keys, take = asked * (self.n + 1), FEW
        while queue:
            rows = []
            while queue and len(rows) < take:
                row = heapq.heappop(queue)
                if self._may_hold(-row[0], row[2], row[3], top, k, floor):
                    rows.append(row)
                elif -row[0] < max(floor, 1) or len(top) == k and -row[0] < top[0][0]:
                    queue = []  # all others are bounded by less
            if not rows:
                break
            take = min(MANY, 2 * take)
            a, b, at = (np.array([row[i] for row in rows], dtype=np.int64) for i in (2, 3, 4))
            low, high = np.stack([row[5] for row in rows]), np.stack([row[6] for row in rows])
            middle = np.clip(np.searchsorted(self.key, (keys[None] + at[:, None]).ravel()).reshape(low.shape), low, high)
            inside = np.minimum(middle, len(self.key) - 1)
            here = (middle < high) & (self.doc[inside] == at[:, None])
            score = np.where(here, self.impact[inside], 0).sum(axis=1)
            for s, d in zip(score.tolist(), at.tolist(), strict=True):
                if s >= max(floor, 1):
                    entry = (s, -int(self.order[d]), d)
                    if len(top) < k:
                        heapq.heappush(top, entry)
                    elif entry > top[0]:
                        heapq.heapreplace(top, entry)
            ends = np.concatenate([np.stack([a, at], axis=1), np.stack([at + 1, b], axis=1)])
            lows, highs = np.concatenate([low, middle + here]), np.concatenate([middle, high])
            bound, split = self._bounds(lows, highs)
            least = max(floor, 1, top[0][0] if len(top) == k else 0)
            for i in np.flatnonzero(bound >= least).tolist():
                made += 1
                heapq.heappush(queue, (-int(bound[i]), made, int(ends[i, 0]), int(ends[i, 1]), int(split[i]), lows[i].copy(), highs[i].copy()))
        return [(s, d) for s, _, d in sorted(top, reverse=True)]

    def _may_hold(self, bound: int, a: int, b: int, top: list, k: int, floor: int) -> bool:
        if bound < max(floor, 1):
            return False
        if len(top) < k or bound > top[0][0]:
            return True
        if bound < top[0][0]:
            return False
        first = int(self.earliest.places(np.array([a]), np.array([b]))[0])  # a tie: does an earlier document remain?
        return -int(self.order[first]) > top[0][1]


def _vocabulary(items: list[tuple[int, list[bytes]]]) -> tuple[dict[bytes, int], list[tuple[int, np.ndarray]]]:
    known: dict[bytes, int] = {}
    rows = [(i, np.array(sorted({known.setdefault(w, len(known)) for w in words}), dtype=np.int64)) for i, words in items]
    return known, rows


def counted(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """``(id, n, terms, times)`` of each document with a term: its length and its counts of the terms of the vocabulary."""
    narrow = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([narrow.schema[0], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("times", T.ArrayType(T.IntegerType()))])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            lengths, found, times, ends, some = [], [], [], [0], []
            for row, value in enumerate(batch.column(1).cast(pa.large_binary())):
                words = terms(value.as_buffer().to_pybytes()) if value.is_valid else []
                if not words:
                    continue
                at = np.array([x for x in map(number, words) if x is not None], dtype=np.int32)
                ids, n = np.unique(at, return_counts=True)
                some.append(row)
                lengths.append(len(words))
                found.append(ids)
                times.append(n.astype(np.int32))
                ends.append(ends[-1] + len(ids))
            if some:
                cuts = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(some)), pa.array(lengths, pa.int64()),
                     pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(found), pa.int32())),
                     pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(times), pa.int32()))], names=schema.names)

    return narrow.mapInArrow(count, schema)


def statistics(counts: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the document frequency of each term of the vocabulary."""
    row = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    of = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).toArrow()
    df = np.zeros(size, dtype=np.int64)
    df[of["term"].to_numpy()] = of["n"].to_numpy()
    return row[0], row[1], df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        ends = batch.column(2).offsets.to_numpy()
        at = 0
        while at < batch.num_rows:  # as many documents as fit, one at least
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + max(0, limit - size), side="right")) - 1)
            held.append(batch.slice(at, to - at))
            size += int(ends[to] - ends[at]) + to - at
            at = to
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _ordered(key) -> tuple:
    return (key is None, 0 if key is None else key)


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           item_text: str = "text", block_postings: int = BLOCK_POSTINGS, item_terms: int = ITEM_TERMS) -> DataFrame:
    """``(item_key, rank, key, score)``: for each item the ``k`` documents of the highest scores above 0.

    Terms are letters and digits in a row, and any characters beyond ASCII; only A-Z are lower-cased. Equal scores are ranked by
    ascending key, a null key last. Null and empty texts have no terms: such documents are in no count and such items
    have no rows. Each row of a repeated item gets results of its own, each row of a repeated document is a document, an empty
    table gives no rows, and other columns are not read. A text, and the documents of a block, are held by one task.

    Items go to the tasks in lots of about ``item_terms`` terms, each lot a pass over the documents; that, and one count for
    each of these terms, is all that passes through the driver.
    """
    spark = docs.sparkSession
    rows = materialize(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_key}`").alias("name"), F.col(f"`{item_text}`").alias("text")))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    lots = max(1, math.ceil(size / 3 / item_terms))
    kind = docs.schema[key].dataType
    found = None
    for lot in range(lots):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(lots)) == lot).select("item", "text").collect() if size else []
        vocabulary, asked = _vocabulary([(r["item"], terms((r["text"] or "").encode())) for r in part])
        counts = materialize(counted(docs, vocabulary, key, text))
        n_docs, all_terms, df = statistics(counts, len(vocabulary))
        one = _searched(counts, kind, asked, weights(n_docs, df), n_docs, all_terms, k, block_postings)
        found = one if found is None else found.unionByName(one)
    best = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    first = Window.partitionBy("item", "task").orderBy(*best)  # merged by groups of tasks, then all together
    last = Window.partitionBy("item").orderBy(*best)
    merged = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return merged.join(rows.select("item", "name"), "item").select(F.col("name").alias(item_key), "rank", F.col("id").alias(key), "score")


def _searched(counts: DataFrame, kind: T.DataType, asked, weight: np.ndarray, n_docs: int, all_terms: int, k: int, limit: int) -> DataFrame:
    """``(item, task, id, score)``: the best documents of each task."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("id", kind),
                           T.StructField("score", T.LongType())])
    shared = counts.sparkSession.sparkContext.broadcast((asked, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        asked, weight = shared.value
        tops: dict[int, list] = {}
        id_type = None
        for held in _blocks(batches, limit):
            table = pa.Table.from_batches(held).combine_chunks()
            ids, lists, times = (table.column(i).combine_chunks() for i in (0, 2, 3))
            id_type = ids.type
            names = ids.to_pylist()
            order = np.empty(len(names), dtype=np.int64)
            order[sorted(range(len(names)), key=lambda i: _ordered(names[i]))] = np.arange(len(names))
            n = table.column(1).to_numpy()
            m = 50 + 50 * n * n_docs // all_terms
            doc = np.repeat(np.arange(len(names)), np.diff(lists.offsets.to_numpy()))
            block = Block(doc, lists.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64), m, weight, order)
            for item, terms_of in asked:
                top = tops.get(item, [])
                new = block.best(terms_of, k, top[-1][0] if len(top) == k else 0)
                if new:
                    top += [(s, names[block.documents[d]]) for s, d in new]
                    tops[item] = sorted(top, key=lambda e: (-e[0], _ordered(e[1])))[:k]
        group = TaskContext.get().partitionId() % 64
        rows = [(item, s, name) for item, top in tops.items() for s, name in top]
        for at in range(0, len(rows), 10_000):
            part = rows[at:at + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.int64()), pa.array([group] * len(part), pa.int32()), pa.array([r[2] for r in part], id_type),
                 pa.array([r[1] for r in part], pa.int64())], names=schema.names)

    return counts.mapInArrow(run, schema)
