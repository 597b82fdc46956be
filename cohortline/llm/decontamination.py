"""Benchmark decontamination: documents that hold a window of a benchmark item, found by a prefix-filtered set join.

Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. A window is a run of
``window`` words of an item, or the whole item if it has fewer. A window's shingles are its runs of three words (of all its
words, if it has fewer). They are ordered by their number of occurrences in the documents: as the whole window must
be contained, the rarest one alone is a necessary prefix, and a window with a shingle that never occurs is
out at once. Documents meet the windows on that shingle; the shingle's place in the window bounds where the window begins and
must leave room for its length, and the words themselves are compared.

Documents are read once: positions that hold any item shingle are written with the words around them. Item shingles are
broadcast in blocks of at most ``block`` values; further blocks read the documents again.

Null or empty texts have no words; items without words, or with a null id, have no windows. Items with one id count once. Each
input row gives one row, also null and repeated keys. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.session import materialize

SHINGLE = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _runs(of: Column, n: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` words, in order."""
    at = lambda i: F.xxhash64(F.lit(k), *[F.get(of, i + j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), at)).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct ``item, phrase, size, runs`` of the items."""
    w = items.select(F.col(f"`{key}`").cast("string").alias("item"), words(F.col(f"`{text}`")).alias("w")).where("item IS NOT NULL")
    w = w.withColumn("n", F.size("w")).where("n > 0").withColumn("size", F.least("n", F.lit(window)))
    each = w.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)))
    each = each.select("item", F.slice("w", F.col("at"), F.col("size")).alias("w"), "size").distinct()
    runs = reduce(lambda rest, k: F.when(F.col("size") >= k, _runs(F.col("w"), F.col("size"), k)).otherwise(rest),
                  range(1, SHINGLE + 1), F.array().cast("array<bigint>"))
    return each.select("item", F.array_join("w", " ").alias("phrase"), "size", runs.alias("runs"))


def _positions(docs: DataFrame, shingles: DataFrame, sizes: list[int], window: int, with_documents: bool) -> DataFrame:
    """A row for each position whose shingle is among ``shingles``, with the words around it.

    With ``with_documents`` also a row with place null for each document: its list ends with a value of its own.
    """
    n = F.col("n")
    w = docs.select("row", "key", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    mark = F.xxhash64(F.lit("a document's row"))
    lists = [_runs(F.col("w"), n, k) for k in sizes] + ([F.array(mark)] if with_documents else [])
    each = w.select("row", "key", "n", "w", F.posexplode(F.concat(*lists)).alias("p", "shingle"))
    if with_documents:
        shingles = shingles.unionByName(docs.sparkSession.range(1).select(mark.alias("shingle"))).distinct()
    found = each.join(F.broadcast(shingles), "shingle")
    place = F.lit(None).cast("int")
    for k in reversed(sizes):  # positions of the lists follow one another
        before = sum((F.greatest(n - j + 1, F.lit(0)) for j in sizes if j < k), F.lit(0))
        place = F.when((F.col("p") >= before) & (F.col("p") < before + F.greatest(n - k + 1, F.lit(0))), F.col("p") - before).otherwise(place)
    found = found.withColumn("place", place)
    near = F.greatest(F.col("place") - window, F.lit(0))
    return found.select("row", "key", "n", "shingle", "place", near.alias("near"),
                        F.when(F.col("place").isNotNull(), F.slice("w", near + 1, F.lit(2 * window + SHINGLE))).alias("around"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", block: int = 1_000_000) -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``items`` (sorted ids
    of the items with occurring windows) and ``contaminated``.

    An empty table of documents gives no rows, one of items no hits; other columns are not read. A text is read whole by one task.
    """
    windows = materialize(item_windows(items, window, item_key, item_text))
    runs = windows.select(F.explode("runs").alias("shingle")).distinct()
    sizes = [r[0] for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("k")).distinct().orderBy("k").collect()] or [SHINGLE]
    blocks = max(1, -(-runs.count() // block))
    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).withColumn("row", F.monotonically_increasing_id())
    if blocks > 1:
        narrow = materialize(narrow)
        runs = materialize(runs.withColumn("block", F.pmod(F.hash("shingle"), F.lit(2 * blocks))))  # halves, as blocks vary in size
        blocks *= 2
    found = materialize(reduce(DataFrame.unionByName, [
        _positions(narrow, runs.where(F.col("block") == b).select("shingle") if blocks > 1 else runs, sizes, window, b == 0)
        for b in range(blocks)]))
    hits = found.where("place IS NOT NULL")

    rarity = hits.groupBy("shingle").agg(F.count("*").alias("times"))
    phrases = windows.select("phrase", "size", "runs").distinct()
    prefix = (phrases.select("phrase", "size", F.posexplode("runs").alias("offset", "shingle")).join(rarity, "shingle", "left")
              .groupBy("phrase", "size").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "offset", "shingle")).alias("rarest"))
              .where("rarest.times > 0").select("phrase", "size", "rarest.offset", "rarest.shingle"))
    prefix = materialize(prefix)
    begins = F.col("place") - F.col("offset")
    met = hits.join(F.broadcast(prefix) if prefix.count() <= block else prefix, "shingle").where((begins >= 0) & (begins + F.col("size") <= F.col("n")))
    same = F.array_join(F.slice("around", begins - F.col("near") + 1, F.col("size")), " ") == F.col("phrase")
    occurs = materialize(met.where(same).select("row", begins.alias("start"), (begins + F.col("size")).alias("stop"), "phrase").distinct())

    order = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = occurs.select("row", "start", "stop").distinct().withColumn("before", F.coalesce(F.max("stop").over(order), F.lit(0)))
    hit = spans.groupBy("row").agg(F.sum(F.greatest(F.col("stop") - F.greatest("start", "before"), F.lit(0))).alias("n_hit"))
    named = (occurs.select("row", "phrase").distinct().join(windows.select("item", "phrase"), "phrase").select("row", "item").distinct()
             .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")))
    out = found.where("place IS NULL").select("row", "key", "n").join(hit.join(named, "row"), "row", "left")
    return out.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
