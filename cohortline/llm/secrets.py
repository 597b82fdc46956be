"""Secret scans: spans of credentials, and weak candidates linked to complementary parts nearby.

Base spans are found on their own: assignments, access identifiers and long hexadecimal runs. A bare 40-character
token is reported (kind ``secret``) only if an access identifier lies within the scope, and an endpoint (a URL with a
scheme, kind ``endpoint``) only if an identifier, an assignment or a linked token does. The scope is a number
of characters in the same text. The link is an interval join: each strong span reaches over cells of the
scope's length, spans of a cell are reduced to two numbers before the join, and a weak span meets at most one row for each
cell it touches.

Positions count code points; ends are exclusive. A null text is empty and has no spans. Each input row gives one row, also
null and repeated keys. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.session import materialize

#: Kinds in their order, and their patterns.
KINDS = ["assign", "access", "hex", "secret", "endpoint"]
BASE = KINDS[:3]
HEAD = r"""(?:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)"""
PATTERNS = {
    "assign": HEAD + r"[A-Za-z0-9+/_.=-]+",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "secret": r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])",
    "endpoint": r"""(?:https?|wss?|ftps?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\x00-\x20"'<>]+""",
}
WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]


def _quick(text: Column) -> dict[str, Column]:
    """Cheap conditions that a text with a span of the kind, or with a link for it, meets."""
    low = F.lower(text)
    assign = F.lit(False)
    for w in WORDS:
        assign = assign | F.contains(low, F.lit(w))
    access = F.contains(text, F.lit("AKIA"))
    return {"assign": assign, "access": access, "hex": F.rlike(text, F.lit(r"[0-9a-f]{32}")), "secret": access,
            "endpoint": F.contains(text, F.lit("://")) & (access | assign)}


def _sound(kind: str, span: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_replace(span, f"^{HEAD}", "")) >= 8
    if kind == "secret":
        return span.rlike("[A-Z]") & span.rlike("[a-z]") & span.rlike("[0-9]")
    return F.lit(True)


def _pieces(text: Column, kind: str) -> Column:
    """The matches of a kind in order: length of the gap before, length, and whether the match counts.

    The pattern also takes the gap before a match or the end, so that a text is read once from left to right.
    """
    pattern = F.lit(f"(?s)(.*?)({PATTERNS[kind]}|\\z)")
    gaps, matches = (F.regexp_extract_all(text, pattern, F.lit(g)) for g in (1, 2))
    return F.filter(F.zip_with(gaps, matches, lambda g, m: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.length(g).alias("gap"), F.length(m).alias("size"), _sound(kind, m).alias("sound"))),
        lambda p: p["size"] > 0)


def find_parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``parts``: the matches of all kinds, linked or not."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.array().cast("array<struct<kind:int,gap:int,size:int,sound:boolean>>")
    return docs.withColumn("parts", F.concat(*[F.when(c, _pieces(t, kind)).otherwise(none) for kind, c in _quick(t).items()]))


def positions(found: DataFrame, row: str = "row") -> DataFrame:
    """``row, kind, start, stop`` of the parts that count."""
    each = found.select(row, F.posexplode("parts").alias("i", "p")).select(row, "i", "p.*")
    before = Window.partitionBy(row, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.withColumn("stop", F.sum(F.col("gap").cast("long") + F.col("size")).over(before))
    return ends.where("sound").select(row, "kind", (F.col("stop") - F.col("size")).alias("start"), "stop")


def _cells(low: Column, high: Column, scope: int) -> Column:
    return F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))


def within(weak: DataFrame, strong: DataFrame, scope: int, row: str = "row") -> DataFrame:
    """The rows of ``weak`` that lie at most ``scope`` characters from a row of ``strong``."""
    edge = F.col("cell") * scope
    reach = (strong.select(row, (F.col("start") - scope).alias("low"), (F.col("stop") + scope).alias("high"))
             .withColumn("cell", _cells(F.col("low"), F.col("high"), scope)).groupBy(row, "cell")
             .agg(F.max(F.when(F.col("low") < edge, F.col("high"))).alias("until"),
                  F.min(F.when(F.col("low") >= edge, F.col("low"))).alias("since")))
    asked = weak.withColumn("cell", _cells(F.col("start"), F.col("stop") - 1, scope))
    met = asked.join(reach, [row, "cell"]).where("start <= until OR stop >= since")
    return met.select(row, "kind", "start", "stop").distinct()


def link(parts: DataFrame, scope: int = 300, row: str = "row") -> DataFrame:
    """All base spans, and the weak ones with a complementary part within the scope."""
    of = lambda *kinds: parts.where(F.col("kind").isin([KINDS.index(k) for k in kinds]))
    secret = within(of("secret"), of("access"), scope, row)
    endpoint = within(of("endpoint"), of("access", "assign").unionByName(secret), scope, row)
    return of(*BASE).unionByName(secret).unionByName(endpoint)


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["stop"])), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = 300) -> DataFrame:
    """One row per document: ``key``, and ``spans``: structs ``start, kind, stop, before`` in order, where ``before`` is the
    last end of the spans before it.

    A null or empty text has no spans; rows with null or repeated keys stay rows of their own; an empty table gives no rows; other
    columns are not read. A text is scanned whole, and its spans are one row.
    """
    found = materialize(find_parts(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")))
                        .select("key", "parts").withColumn("row", F.monotonically_increasing_id()))
    spans = link(materialize(positions(found.where(F.size("parts") > 0))), scope)
    order = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.max("stop").over(order), F.lit(0)))
    lists = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "before"))).alias("spans"))
    empty = F.array().cast(lists.schema["spans"].dataType)
    return found.join(lists, "row", "left").select(F.col("key").alias(key), F.coalesce("spans", empty).alias("spans"))


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return scanned.select(key, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    piece = lambda s: F.when(s["start"] >= s["before"], F.concat(
        F.substring(text, s["before"] + 1, s["start"] - s["before"]), F.lit(mark))).otherwise("")
    last = F.array_max(F.transform(spans, lambda s: s["stop"]))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(spans, piece), ""),
                                              F.substring(text, last + 1, F.length(text)))).otherwise(text)
