"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Terms are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII, over the whole text. The examples are a bounded
sample of the labelled rows, stratified by label, and all their terms are kept. Terms that no example has count in the length of
a text's vector. Document frequencies are counted over all documents. TF-IDF weights are multiplied by the dependence of a term's
presence on the label, a factor between 0.02 and 1, so that no term is left out. The examples' vectors form an inverted index whose lists
are cut into blocks of examples with the largest weight of each. Telling lists are added first; the search ends when the bounds of
the rest, by term, by length and by block, leave so few examples that comparing them as vectors is cheaper. The ``k`` nearest vote
with the square of their cosine; a logistic curve, fitted to the votes that each example gets from the
others, turns votes into probabilities. Votes and curve weigh each label by its share of all labelled rows.

Null and empty texts, and texts without terms of the examples, get the probability of no votes. Without usable labels of both
kinds every score is the share of positive labels (0 without any). Each input row gives one row, also null and repeated
keys; null labels or keys are not used for learning.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm import text as tx


LEAST, HALF = 0.02, 12.5
ROWS_HELD = 512  # of the longest lists, 8 bytes for each example


def terms(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's terms, in order, and how often each occurs."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = tx.per_process("term bytes", _term_bytes)
    low = table[data]
    edge = np.diff(np.concatenate([[0], (low > 0).view(np.int8), [0]]).astype(np.int8))
    return np.unique(tx.runs_hashed(low, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), return_counts=True)


def _term_bytes() -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    for a, b in ((48, 58), (97, 123), (128, 256)):
        out[a:b] = np.arange(a, b)
    out[65:91] = np.arange(97, 123)
    return out


class Index:
    """Examples as unit vectors in an inverted index of blocks; only lists that have entries are held."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = 64):
        self.n, self.block = len(rows), block
        self.blocks = max(1, -(-len(rows) // block))
        t = np.concatenate([np.zeros(0, np.int64), *[ts for ts, _ in rows]]).astype(np.int64)
        e = np.repeat(np.arange(len(rows), dtype=np.int32), [len(ts) for ts, _ in rows])
        w = np.concatenate([np.zeros(0), *[ws for _, ws in rows]])
        self.row_term, self.row_weight = t.astype(np.int32), w  # the vectors themselves, for exact cosines
        self.rows = np.concatenate([[0], np.cumsum([len(ts) for ts, _ in rows], dtype=np.int64)])
        order = np.argsort(t, kind="stable")  # of a term, examples stay in order
        t, self.example, self.weight = t[order], e[order], w[order]
        lists = t * self.blocks + self.example // block
        first = np.flatnonzero(np.diff(lists, prepend=-1))
        self.at = (lists[first] % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.lists = np.searchsorted(lists[first], np.arange(n_terms + 1) * self.blocks)  # bounds of the lists of each term
        self.entries = np.append(first, len(t))[self.lists]  # bounds of the entries of each term
        self.top = np.zeros(n_terms)
        np.maximum.at(self.top, t, self.weight)
        self.asked = np.zeros(n_terms)  # weights of the vector that is asked for, 0 between calls
        # the longest lists are held as rows over all examples, which are added faster than entries
        size = np.diff(self.entries)
        long = np.argsort(-size, kind="stable")[:ROWS_HELD]
        long = long[size[long] > self.n / 16]
        self.slot = np.full(n_terms, -1, dtype=np.int32)
        self.slot[long] = np.arange(len(long))
        self.dense = np.zeros((len(long), self.n))
        for i, t in enumerate(long.tolist()):
            here = slice(self.entries[t], self.entries[t + 1])
            self.dense[i, self.example[here]] = self.weight[here]

    def bases(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the rows of the longest lists give to all examples, for several vectors: a product of matrices."""
        asked = np.zeros((len(vectors), len(self.dense)))
        for i, (ts, ws) in enumerate(vectors):
            slot = self.slot[ts]
            asked[i, slot[slot >= 0]] = ws[slot >= 0]
        return asked @ self.dense

    def nearest(self, ts: np.ndarray, ws: np.ndarray, k: int, without: int = -1, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the ``k`` nearest with a cosine above 0; of equal ones, the first. ``base`` is the row of :meth:`bases`.

        Lists are added by the most they can give, those of rare and telling terms first. What the others can still give bounds
        all examples, by their maxima, by the length of what is left of the vector, and by block; those that cannot reach
        the k-th sum so far drop out. When comparing the rest as vectors is cheaper than the lists to come, that ends the search.
        """
        whole = ts, ws
        scores = (self.bases([(ts, ws)])[0] if base is None else base).copy()
        gives = np.where(self.slot[ts] < 0, ws * self.top[ts], 0.0)
        order = np.argsort(-gives, kind="stable")[:int((gives > 0).sum())]
        ts, ws, gives = ts[order], ws[order], gives[order]
        start, stop = self.entries[ts], self.entries[ts + 1]
        cost = np.concatenate([[0], np.cumsum(stop - start)])
        rest = np.minimum(np.cumsum(gives[::-1])[::-1], np.sqrt(np.cumsum((ws * ws)[::-1])[::-1]))
        done, step, left = 0, 4096, np.zeros(0, dtype=np.int64)
        while done < len(ts):
            to = max(done + 1, min(len(ts), int(np.searchsorted(cost, cost[done] + step, side="right")) - 1))
            entry, of = _ranges(start[done:to], stop[done:to])
            scores += np.bincount(self.example[entry], ws[done:to][of] * self.weight[entry], self.n)
            done, step = to, step * 4
            to_come = cost[-1] - cost[done]
            if done == len(ts) or to_come < self.n or self.n <= k:
                continue
            if without >= 0:
                scores[without] = -1.0
            least = np.partition(scores, -k)[-k] - 2e-9  # ties of rounded cosines stay in
            if rest[done] >= least:
                continue
            left = np.flatnonzero(scores + rest[done] >= least)
            if len(left) * self.rows[-1] > to_come * self.n:
                chosen, owner = _ranges(self.lists[ts[done:]], self.lists[ts[done:] + 1])
                block = np.bincount(self.at[chosen], ws[done:][owner] * self.most[chosen], self.blocks)
                left = left[scores[left] + block[left // self.block] >= least]
            if len(left) * self.rows[-1] <= to_come * self.n:
                break
        if without >= 0:
            scores[without] = -1.0
        if done == len(ts):
            ids = np.flatnonzero(scores > 1e-12)
            if len(ids) > 4 * k:
                ids = ids[scores[ids] >= np.partition(scores[ids], -k)[-k] - 1e-8]
            cosines = scores[ids]
        else:
            entry, of = _ranges(self.rows[left], self.rows[left + 1])
            self.asked[whole[0]] = whole[1]
            cosines = np.bincount(of, self.asked[self.row_term[entry]] * self.row_weight[entry], len(left))
            self.asked[whole[0]] = 0.0
            ids, cosines = left[cosines > 1e-12], cosines[cosines > 1e-12]
        order = np.lexsort((ids, -np.round(cosines, 9)))[:k]
        return ids[order], cosines[order]

    def many(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without_own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """:meth:`nearest` of each vector; ``without_own``: they are the examples, and none is its own neighbour."""
        for a in range(0, len(vectors), 128):
            part = vectors[a:a + 128]
            for i, ((ts, ws), base) in enumerate(zip(part, self.bases(part), strict=True), a):
                yield self.nearest(ts, ws, k, i if without_own else -1, base)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges ``start..end - 1`` one after the other, and the range of each."""
    n = ends - starts
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) + (starts - np.cumsum(n) + n)[owner], owner


def votes(labels: np.ndarray, ids: np.ndarray, cosines: np.ndarray, weights: np.ndarray) -> float:
    w = cosines ** 2 * weights[ids]
    return float((w * labels[ids]).sum() / (w.sum() + 0.1)) if len(ids) else 0.0


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and intercept of a curve with a slight pull to 0."""
    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = weights * p * (1 - p) + 1e-9
        gradient = np.array([(weights * (y - p) * x).sum() - 1e-2 * a, (weights * (y - p)).sum()])
        hessian = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0), float(b)


class Model:
    """Vocabulary, factors of its terms, examples and curve; the index is built in each worker process.

    ``rows`` have places in the sorted ``vocabulary``; ``unknown`` is the factor of a term outside it, ``weights`` count what an example stands for.
    """

    def __init__(self, vocabulary: np.ndarray, factor: np.ndarray, unknown: float, rows: list, labels: np.ndarray, weights: np.ndarray,
                 names: list[str], k: int):
        self.vocabulary, self.factor, self.unknown = vocabulary, factor, unknown
        self.labels, self.weights, self.names, self.k = labels, weights, names, k
        self.mark = uuid.uuid4().hex
        self.rows = [self.vector(t, n) for t, n in rows]
        self.curve = None
        self.share = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.0
        if 0 < self.share < 1:
            index = self.index()
            own = np.array([votes(labels, ids, cosines, weights) for ids, cosines in index.many(self.rows, k, True)])
            self.curve = logistic(own, labels, weights)

    def index(self) -> Index:
        return Index(self.rows, len(self.factor))

    def kept_index(self) -> Index:
        """The index, made once in each worker process; that of an earlier model is let go."""
        held = tx.per_process("toxicity index", dict)
        if self.mark not in held:
            held.clear()
            held[self.mark] = self.index()
        return held[self.mark]

    def vector(self, ts: np.ndarray, times: np.ndarray, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the known terms in a vector of length 1, which also has the ``others``: how often each unknown term occurs."""
        w = (1 + np.log(np.asarray(times, dtype=float))) * self.factor[ts]
        rest = 0.0 if others is None else (((1 + np.log(np.asarray(others, dtype=float))) * self.unknown) ** 2).sum()
        norm = np.sqrt((w * w).sum() + rest)
        return np.asarray(ts), w / norm if norm else w

    def scores(self, index: Index, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Probability, nearest examples and their cosines of each text, given by its terms."""
        if self.curve is None:
            yield from ((self.share, np.zeros(0, np.int64), np.zeros(0)) for _ in texts)
            return
        vectors = []
        for hashes, times in texts:
            at, known = places(self.vocabulary, hashes)
            vectors.append(self.vector(at[known], times[known], times[~known]))
        a, b = self.curve
        for ids, cosines in index.many(vectors, self.k):
            yield float(1 / (1 + np.exp(-(a * votes(self.labels, ids, cosines, self.weights) + b)))), ids, cosines


def dependence(with_term: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """A factor for each of the terms in ``n`` examples, ``with_term`` of them positive: from 0.02 to 1 by the log-likelihood of
    their labels, against labels at the ``share`` of all examples. 12.5, a chi-square of 25, gives half."""
    if not 0 < share < 1:
        return np.ones(len(n))
    q = with_term / n
    gain = np.zeros(len(n))
    for part, base in ((q, share), (1 - q, 1 - share)):
        gain += n * np.where(part > 0, part * np.log(np.maximum(part, 1e-300) / base), 0.0)
    return (np.maximum(gain, 0.0) + LEAST * HALF) / (np.maximum(gain, 0.0) + HALF)


def places(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each hash in the sorted vocabulary, and whether it is there."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
    return at, vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), dtype=bool)


def _listed(text: str) -> Column:
    """Hashes of the terms of a text and how often each occurs."""

    @F.arrow_udf(T.StructType([T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]))
    def listed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            rows = [terms(data) for data in tx.text_bytes(column)]
            yield pa.StructArray.from_arrays([pa.array([h.view(np.int64) for h, _ in rows], pa.list_(pa.int64())),
                                              pa.array([n.astype(np.int32) for _, n in rows], pa.list_(pa.int32()))], names=["terms", "times"])

    return listed(F.col(text))


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, usable: Callable[[Column], Column], rows: int) -> tuple[DataFrame, dict]:
    """At most ``rows`` labelled documents, by a hash of their keys: ``name, label, text``; and the number of labelled rows by label.

    Each label gets half of the room, and what the other leaves of its half.
    """
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("label")).dropna().where(usable(F.col("k")))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for kind, n in sorted(counts.items()):
        take = min(n, max(rows // 2, rows - sum(counts.values()) + n))
        near = min(1.0, (take + 6 * take ** 0.5 + 50) / n)  # the limit's one task gets little more than it takes
        part = known.where((F.col("label") == kind) & (F.xxhash64("k") <= min(int(near * 2 ** 64) - 2 ** 63, 2 ** 63 - 1))
                           ).orderBy(F.xxhash64("k"), "k").limit(take)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = known.limit(0) if chosen is None else chosen
    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "k").select(
        F.col("k").cast("string").alias("name"), "label", "text"), counts


def frequencies(docs: DataFrame, text: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term of the vocabulary is, and the number of documents. A task sends one row for each term."""
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(given.value), dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for data in tx.text_bytes(batch.column(0)):
                at, known = places(given.value, terms(data)[0])
                df[at[known]] += 1
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1).astype(np.int32)), pa.array(np.append(df[met], n))], names=["term", "n"])

    rows = docs.select(F.col(f"`{text}`")).mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = rows["term"].to_numpy(), rows["n"].to_numpy()
    df = np.zeros(len(vocabulary))
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def scored(docs: DataFrame, labels: DataFrame, usable: Callable[[Column], Column], label: str = "toxic", key: str = "doc_id", text: str = "text",
           sample_rows: int = 8_000, min_rows: int = 1, k: int = 15) -> DataFrame:
    """One row per document: ``key``, ``score``, and ``evidence``: its nearest examples with label and cosine.

    ``usable`` gives the condition on a label's key under which it may be learned from. ``sample_rows`` bounds what goes to the
    driver and to each worker: all terms of the sampled examples. A ``min_rows`` above 1 leaves out terms of fewer examples.
    """
    chosen, labelled = sample(docs, labels, label, key, text, usable, sample_rows)
    taken = (chosen.withColumn("s", _listed("text")).orderBy("name", "label", F.xxhash64("text")).limit(sample_rows)
             .select("name", "label", "s.terms", "s.times").toArrow())
    lists = [(h.values.to_numpy().view(np.uint64), n.values.to_numpy()) for h, n in zip(
        *[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (taken["terms"], taken["times"])], strict=True)]
    y = taken["label"].to_numpy()
    vocabulary, at, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in lists]]), return_inverse=True, return_counts=True)
    positive = np.bincount(at, np.repeat(y, [len(h) for h, _ in lists]), len(vocabulary))[of >= min_rows]
    vocabulary, of = vocabulary[of >= min_rows], of[of >= min_rows]
    df, n_docs = frequencies(docs, text, vocabulary)
    factor = np.log((1 + n_docs) / (1 + df)) + 1e-3
    factor *= dependence(positive, of, float(y.mean()) if len(y) else 0.0)
    rows = []
    for h, n in lists:
        at, known = places(vocabulary, h)
        rows.append((at[known], n[known]))
    weights = np.array([labelled[x] / (y == x).sum() for x in y.tolist()])
    made = Model(vocabulary, factor, LEAST * float(np.log((1 + n_docs) / 2) + 1e-3), rows, y.astype(float), weights, taken["name"].to_pylist(), k)
    model = docs.sparkSession.sparkContext.broadcast(made)

    near = T.StructType([T.StructField("example", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())])

    @F.arrow_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(near))]))
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value
        index = m.kept_index()
        for column in batches:
            scores, evidence = [], []
            for a in range(0, len(column), 512):
                for p, ids, cosines in m.scores(index, [terms(data) for data in tx.text_bytes(column.slice(a, 512))]):
                    scores.append(p)
                    evidence.append([{"example": m.names[i], "label": int(m.labels[i]), "cosine": float(c)} for i, c in zip(ids[:3], cosines[:3], strict=True)])
            yield pa.StructArray.from_arrays(
                [pa.array(scores, pa.float64()),
                 pa.array(evidence, pa.list_(pa.struct([("example", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())])))],
                names=["score", "evidence"])

    return docs.select(F.col(f"`{key}`").alias(key), judged(F.col(f"`{text}`")).alias("j")).select(key, "j.score", "j.evidence")


def held_out(key: Column) -> Column:
    """The rows whose labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
