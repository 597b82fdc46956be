"""Similarity join of documents on word shingles, with Bayesian pruning of candidates by MinHash.

Documents with one text form a node. A node's MinHash values are cut into bands; the members of a band's bucket
are linked to the bucket's least node, and the connected components of these links hold all candidates. Components are
dealt in blocks of nodes, and each pair of blocks is compared in one task: MinHash values are compared some at a time,
a pair is dropped as soon as the posterior probability that its similarity reaches the threshold, given the matches
so far and a uniform prior, falls below the tolerance, and the pairs left are verified on their whole
shingle sets. Pairs stay inside the task; it returns the number of links of each node and its least neighbour reached.

Shingles are the sets of ``size`` following words; a text of fewer words is one shingle of all of them. Null texts and
texts without words have no shingles: they have no links and are each a class of their own. Exact copies,
repeated rows too, are links of each other. Null keys are kept; a class id is the least key that isn't null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm import text as tx
from cohortline.llm.components import components
from cohortline.session import materialize

ROWS, BANDS = 6, 32
HASHES = ROWS * BANDS


def shingles(data: np.ndarray, size: int) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    words = tx.word_hashes(data)
    return np.unique(tx.windows_hashed(words, min(size, len(words)))) if len(words) else words


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_011)
    return r.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(sets: np.ndarray) -> np.ndarray:
    """``HASHES`` MinHash values, the upper halves of multiplied 64-bit hashes."""
    a, b = tx.per_process("minhash seeds", _seeds)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(sets), 1024):
        part = sets[at:at + 1024]
        for c in range(0, HASHES, 32):
            values = (part[None, :] * a[c:c + 32, None] + b[c:c + 32, None]) >> np.uint64(32)
            out[c:c + 32] = np.minimum(out[c:c + 32], values.min(axis=1).astype(np.uint32))
    return out


def least_matches(threshold: float, tolerance: float, step: int) -> dict[int, int]:
    """For ``k`` compared values, the fewest matches with which a pair goes on."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for k in range(step, HASHES + 1, step):
        for m in range(k + 1):
            density = m * np.log(grid) + (k - m) * np.log1p(-grid)
            density = np.exp(density - density.max())
            if density[grid >= threshold].sum() >= tolerance * density.sum():
                out[k] = m
                break
    return out


def _candidates(a: np.ndarray, b: np.ndarray, fewest: dict[int, int]) -> np.ndarray:
    """A mask of the pairs of rows of two signature tables that are not dropped."""
    alive = np.ones((len(a), len(b)), dtype=bool)
    matches = np.zeros(alive.shape, dtype=np.int16)
    before = 0
    for k, m in fewest.items():
        for h in range(before, k):
            matches += a[:, h, None] == b[None, :, h]
        alive &= matches >= m
        if not alive.any():
            break
        before = k
    return alive


def _intersections(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of ``sets[rows]`` with ``sets[cols]``."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    in_all = int((times == len(sets)).sum())
    use = (times > 1) & (times < len(sets))  # the others are in one set only, or counted at once
    place = np.cumsum(use) - 1
    keep = use[column]
    owner, column = owner[keep], place[column[keep]]
    out = np.full((len(rows), len(cols)), in_all, dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(use.sum()), 4096):
        i, j = np.searchsorted(column, [at, at + 4096])
        dense = np.zeros((len(sets), 4096), dtype=np.float32)
        dense[owner[i:j], column[i:j] - at] = 1
        out += dense[rows] @ dense[cols].T
    return out.astype(np.int64)


def compare(nodes: np.ndarray, weights: np.ndarray, left: np.ndarray, right: np.ndarray, sigs: np.ndarray,
            sets: list[np.ndarray], threshold: float, fewest: dict[int, int]):
    """Links in documents, links in nodes, and least node reached, for the nodes of two blocks (or of one, twice)."""
    rows, cols = np.flatnonzero(left), np.flatnonzero(right)
    same = bool((left == right).all())
    alive = _candidates(sigs[rows], sigs[cols], fewest)
    if same:
        np.fill_diagonal(alive, False)
    linked = np.zeros_like(alive)
    i, j = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    if len(i):
        used = np.union1d(rows[i], cols[j])
        inter = _intersections([sets[u] for u in used], np.searchsorted(used, rows[i]), np.searchsorted(used, cols[j]))
        n = np.array([len(s) for s in sets])
        union = n[rows[i]][:, None] + n[cols[j]][None, :] - inter
        linked[np.ix_(i, j)] = (inter >= threshold * union - 1e-9) & alive[np.ix_(i, j)]
    in_docs, in_nodes = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
    in_docs[rows] += linked @ weights[cols]
    in_nodes[rows] += linked.sum(axis=1)
    if not same:
        in_docs[cols] += weights[rows] @ linked
        in_nodes[cols] += linked.sum(axis=0)
    x, y = np.nonzero(linked)
    x, y = rows[x], cols[y]
    root = nodes.copy()
    while len(x):  # the least node over the links, again and again until nothing changes
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        if (new == root).all():
            break
        root = new
    return in_docs, in_nodes, root


def with_signatures(docs: DataFrame, text: str, size: int) -> DataFrame:
    @F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("values", T.BinaryType())]))
    def signed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            sets = [shingles(x, size) for x in tx.text_bytes(column)]
            yield pa.StructArray.from_arrays([pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([signature(s).tobytes() for s in sets], pa.binary())], names=["n", "values"])

    return docs.withColumn("signed", signed(F.col(text)))


def _with_sets(table: DataFrame, size: int) -> DataFrame:
    @F.arrow_udf(T.BinaryType())
    def hashed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array([shingles(x, size).tobytes() for x in tx.text_bytes(column)], pa.binary())

    return table.withColumn("sets", hashed(F.col("text"))).drop("text")


def _compared(table: DataFrame, threshold: float, fewest: dict[int, int]) -> DataFrame:
    """Rows of each ``(root, low, high)`` together, compared; a row per node and pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        task = None
        ready: list = []

        def result():
            nodes = np.array([r["node"] for r in held], dtype=np.int64)
            block = np.array([r["block"] for r in held])
            sets = [np.frombuffer(r["sets"], dtype=np.uint64) for r in held]
            sigs = np.array([np.frombuffer(r["values"], dtype=np.uint32) for r in held])
            weights = np.array([r["copies"] for r in held], dtype=np.int64)
            _, low, high = task
            docs, links, roots = compare(nodes, weights, block == low, block == high, sigs, sets, threshold, fewest)
            return list(zip(nodes.tolist(), docs.tolist(), links.tolist(), roots.tolist(), [r["blocks"] for r in held], strict=True))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ready, strict=True)], names=names)

        for b in batches:
            for row in b.to_pylist():
                now = (row["root"], row["low"], row["high"])
                if now != task and held:
                    ready += result()
                    held.clear()
                    if len(ready) > 5000:
                        yield batch()
                        ready.clear()
                task = now
                held.append(row)
        if held:
            ready += result()
        if ready:
            yield batch()

    names = ["node", "link_docs", "link_nodes", "reached", "blocks"]
    return table.mapInArrow(run, T.StructType([T.StructField(c, T.LongType()) for c in names]))


def similar(docs: DataFrame, threshold: float = 0.8, size: int = 5, key: str = "doc_id", text: str = "text",
            tolerance: float = 1e-6, block: int = 256) -> DataFrame:
    """One row per document: ``key``, ``class_id`` (least key of its connected documents), ``copies`` (documents with its
    very text, itself included), ``n_links`` (other documents with a similarity of ``threshold`` or more) and
    ``n_linked_texts`` (other texts among them)."""
    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    mark = F.unhex(F.md5(F.col("text").cast("binary")))
    signed = materialize(with_signatures(narrow, "text", size).select("key", mark.alias("mark"), "signed.n", "signed.values"))
    nodes = materialize(signed.where("n > 0").groupBy("mark").agg(
        F.min("key").alias("least"), F.count("*").alias("copies"), F.first("values").alias("values"))
        .withColumn("node", F.monotonically_increasing_id()))

    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                                     lambda i: F.xxhash64(i, F.substring(F.col("values"), i * ROWS * 4 + 1, F.lit(ROWS * 4)))))
    buckets = nodes.select("node", bands.alias("band", "bucket")).select("node", "bucket")
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = buckets.join(shared, "bucket").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    linked = components(edges)

    sizes = linked.groupBy("root").agg(F.ceil(F.count("*") / block).alias("blocks"))
    members = materialize(linked.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
                          .join(nodes.select("node", "mark", "copies", "values"), "node"))
    texts = narrow.select(mark.alias("mark"), "text").groupBy("mark").agg(F.first("text").alias("text"))
    whole = _with_sets(texts.join(members, "mark").drop("mark"), size)
    tasks = (whole.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
             .repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "node"))
    found = materialize(_compared(tasks, threshold, least_matches(threshold, tolerance, 16)))

    across = components(found.where("blocks > 1 and reached <> node").select(F.col("node").alias("u"), F.col("reached").alias("v")))
    links = found.groupBy("node").agg(F.sum("link_docs").alias("link_docs"), F.sum("link_nodes").alias("link_nodes"),
                                      F.min("reached").alias("reached"))
    final = (nodes.select("node", "mark", "least", "copies").join(links, "node", "left").join(across, "node", "left")
             .withColumn("root", F.coalesce("root", "reached", "node")))
    least = final.groupBy("root").agg(F.min("least").alias("class_id"))
    about = final.join(least, "root").select("mark", "class_id", "copies",
                                             (F.coalesce("link_docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                             F.coalesce("link_nodes", F.lit(0)).alias("n_linked_texts"))
    return signed.select("key", "mark").join(about, "mark", "left").select(
        F.col("key").alias(key), F.coalesce("class_id", "key").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_linked_texts", F.lit(0)).alias("n_linked_texts"))
