"""Files of token ids, coded in independent blocks by ``rans``.

A store is a folder of two Parquet tables. ``frequencies`` has the shared table of ids. ``blocks`` has a row for each
block: ``part`` and ``first``, its place in the order of the documents; ``n``, its number of ids; ``stream`` and
``checkpoints``; ``crc32`` of its ids; and ``documents``, the stretches of documents in it. Documents are in the order of
their keys, ranges of which are the parts; equal keys are in the order of their texts. Each document ends with ``end_id``.

A null text is empty, so that its document is ``end_id`` alone. Null keys come first. Equal rows are stored once each. No
documents give empty tables. Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm import rans, tokens
from cohortline.session import scratch_path

SIDE_BY_SIDE = 128


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str, path: str) -> DataFrame:
    """Documents in order with ids, written once: the bytes of the ids by significance, which compress well."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("key", "h").sortWithinPartitions("key", "h", "text").drop("h")
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("part", T.LongType()),
                           T.StructField("ordinal", T.LongType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("planes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ordinal, first = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                ids = [np.concatenate([x, end]) for x in tokens.encode(tokenizer, (t.as_py() for t in piece.column(1)))]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                starts = first + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                planes = [x.view(np.uint8).reshape(-1, 4).T.tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.full(len(ids), part)), pa.array(np.arange(ordinal, ordinal + len(ids))), pa.array(starts),
                     pa.array(sizes), pa.array(planes, pa.binary())], names=["key", "part", "ordinal", "first", "n", "planes"])
                ordinal, first = ordinal + len(ids), first + int(sizes.sum())

    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _ids(planes: pa.Scalar) -> np.ndarray:
    b = np.frombuffer(planes.as_buffer(), dtype=np.uint8)
    return np.ascontiguousarray(b.reshape(4, -1).T).view("<u4").reshape(-1)


def _counts(tokenized: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                here = np.bincount(np.concatenate([_ids(x) for x in batch.column(0).slice(at, 512)]))
                if len(here) > len(total):
                    total = np.concatenate([total, np.zeros(len(here) - len(total), dtype=np.int64)])
                total[:len(here)] += here
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "times"])

    return tokenized.select("planes").mapInArrow(run, "id long, times long").groupBy("id").agg(F.sum("times").alias("times"))


def _table(frame: DataFrame) -> rans.Frequencies:
    rows = frame.toPandas().sort_values("id")  # one row for each id of the vocabulary that occurs
    return rans.Frequencies(rows["id"].to_numpy(np.int64), rows["scaled"].to_numpy(np.int64))


def _blocks(tokenized: DataFrame, table: rans.Frequencies) -> DataFrame:
    key = tokenized.schema["key"].dataType
    stretch = T.StructType([T.StructField("key", key), T.StructField("ordinal", T.LongType()), T.StructField("start", T.LongType()),
                            T.StructField("n", T.LongType())])
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("stream", T.BinaryType()), T.StructField("checkpoints", T.BinaryType()),
                           T.StructField("crc32", T.LongType()), T.StructField("documents", T.ArrayType(stretch))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list = []  # blocks of full size wait for each other

        def coded(blocks):
            ids = np.array([np.concatenate([x, np.full(-len(x) % rans.LANES, table.filler)]) for _, _, x, _ in blocks])
            columns = zip(*[(p, f, len(x), s, c, rans.crc(x), d) for (p, f, x, d), (s, c)
                            in zip(blocks, rans.encode(ids, table), strict=True)], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(v), arrow.field(i).type) for i, v in enumerate(columns)], schema=arrow)

        part, first, held, size, documents = None, 0, [], 0, []

        def closed():
            block = (part, first, np.concatenate(held), documents)
            return block

        for batch in batches:
            for k, p, o, f, x in zip(*[batch.column(i) for i in range(5)], strict=True):
                k, p, o, f, x = k.as_py(), p.as_py(), o.as_py(), f.as_py(), _ids(x)
                if size and (p != part or f != first + size):  # another part begins
                    yield coded([closed()])
                    held, size, documents = [], 0, []
                if not size:
                    part, first = p, f
                at = 0
                while at < len(x):
                    take = min(rans.BLOCK - size, len(x) - at)
                    held.append(x[at:at + take])
                    documents.append({"key": k, "ordinal": o, "start": at, "n": take})
                    size, at = size + take, at + take
                    if size == rans.BLOCK:
                        whole.append(closed())
                        part, first, held, size, documents = p, first + size, [], 0, []
                        if len(whole) == SIDE_BY_SIDE:
                            yield coded(whole)
                            whole = []
        if whole:
            yield coded(whole)
        if size:
            yield coded([closed()])

    return tokenized.select("key", "part", "ordinal", "first", "planes").mapInArrow(run, schema)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode the whole texts into a store at ``path``."""
    spark = docs.sparkSession
    tokenized = _tokenized(docs, tokenizer, end_id, key, text, scratch_path(spark, "tokens.parquet"))
    counted = _counts(tokenized).toPandas()
    table = rans.Frequencies.of_counts(counted["id"].to_numpy(np.int64), counted["times"].to_numpy(np.int64))
    spark.createDataFrame([(int(i), int(s)) for i, s in zip(table.ids, table.scaled, strict=True)], "id long, scaled long").write.parquet(f"{path}/frequencies")
    _blocks(tokenized, table).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stretches of documents in the blocks of a store, decoded: ``part, ordinal, key, start, n, ids, place``.

    ``place`` is the number of ids before the stretch in its part. A block whose checksum fails raises an error.
    """
    table = _table(spark.read.parquet(f"{path}/frequencies"))
    blocks = spark.read.parquet(f"{path}/blocks")
    key = blocks.schema["documents"].dataType.elementType["key"].dataType
    schema = T.StructType([T.StructField("key", key), *[T.StructField(c, T.LongType()) for c in ("part", "ordinal", "start", "n", "place")],
                           T.StructField("ids", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SIDE_BY_SIDE):
                rows = batch.slice(at, SIDE_BY_SIDE).to_pylist()
                out = []
                for r, ids in zip(rows, rans.decode([(r["stream"], r["checkpoints"], r["n"]) for r in rows], table), strict=True):
                    if rans.crc(ids) != r["crc32"]:
                        raise ValueError(f"block {r['part']}:{r['first']} is damaged")
                    begin = 0
                    for d in r["documents"]:
                        out.append((d["key"], r["part"], d["ordinal"], d["start"], d["n"], r["first"] + begin, ids[begin:begin + d["n"]].tobytes()))
                        begin += d["n"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), arrow.field(i).type) for i, c in enumerate(zip(*out, strict=True))], schema=arrow)

    return blocks.mapInArrow(run, schema)


def digest(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row per stored document: key, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``."""

    @F.arrow_udf(T.LongType())
    def joined(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in lists:
            out = []
            for stretches in column.to_pylist():
                total = stretches[0]["crc"]
                for s in stretches[1:]:
                    total = rans.join_crc(total, s["crc"], 4 * s["n"])
                out.append(total)
            yield pa.array(out, pa.int64())

    blocks = spark.read.parquet(f"{path}/blocks")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    bases = blocks.groupBy("part").agg(F.sum("n").alias("total")).select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    stretches = read(spark, path).select("key", "part", "ordinal", "start", "n", "place", F.crc32("ids").alias("crc"))
    each = stretches.groupBy("part", "ordinal").agg(
        F.first("key").alias("key"), F.min("place").alias("place"), F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("start", "n", "crc"))).alias("stretches"))
    crc = F.when(F.size("stretches") == 1, F.col("stretches")[0]["crc"]).otherwise(joined("stretches"))
    return each.join(bases, "part").select(F.col("key").alias(key), (F.col("base") + F.col("place")).alias("start"), "n_tokens", crc.alias("ids_crc32"))
