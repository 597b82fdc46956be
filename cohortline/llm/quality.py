"""Quality rules: statistics of texts and a decision list learned from labels by sequential covering.

A rule is a conjunction of thresholds on the statistics. Rules are grown one after the other on two thirds of
the labelled rows that no earlier rule covers: the condition with the largest information gain is added until
the rule covers no good row. The last third prunes the rule and decides whether it is kept. The list is
emitted as ordered ``CASE WHEN`` branches, so that scoring is a Spark expression.

Nulls and empty texts have no words; all their counts are 0 and ratios 0. Every row of the input gives one row
of the output, repeated rows and null keys too. Labels without a document, or with a null, are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm import text as tx

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_letters",
          "n_digits", "n_upper", "n_chars_all"]
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "repeated_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "distinct_words": "n_distinct / n_words",
    "words_per_line": "n_words / n_lines",
    "letters": "n_letters / n_chars_all",
    "digits": "n_digits / n_chars_all",
    "capitals": "n_upper / n_chars_all",
}


def measure(data: np.ndarray) -> tuple[int, ...]:
    """The counts of one text's UTF-8 bytes, in the order of ``COUNTS``."""
    starts, ends = tx.word_spans(data)
    n = len(starts)
    if not n:
        return (0,) * (len(COUNTS) - 1) + (int(((data & 0xC0) != 0x80).sum()),)
    words = tx.runs_hashed(data, starts, ends)
    breaks = np.concatenate([np.flatnonzero(data == 10), [len(data)]])
    line_starts = np.concatenate([[0], breaks[:-1] + 1])
    with_word = np.searchsorted(starts, breaks) > np.searchsorted(starts, line_starts)
    lines = tx.runs_hashed(data, line_starts[with_word], breaks[with_word])
    repeated = 0
    windows = tx.windows_hashed(words, WINDOW)
    if len(windows):
        _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
        again = times[back] > 1
        if again.any():
            repeated = int(tx.covered(again, WINDOW, n).sum())
    per_byte = np.bincount(data, minlength=256)
    chars = len(data) - int(per_byte[0x80:0xC0].sum())
    spaces = int(per_byte[9:14].sum() + per_byte[32])
    upper, digits = int(per_byte[65:91].sum()), int(per_byte[48:58].sum())
    letters = upper + int(per_byte[97:123].sum()) + int(per_byte[0xC0:].sum())
    return (n, chars - spaces, int(sum(per_byte[c] for c in SYMBOLS)), len(lines), len(lines) - len(np.unique(lines)),
            repeated, len(np.unique(words)), letters, digits, upper, chars)


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _counts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        rows = np.array([measure(x) for x in tx.text_bytes(column)], dtype=np.int64).reshape(-1, len(COUNTS))
        yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], names=COUNTS)


def with_counts(docs: DataFrame, text: str = "text", name: str = "counts") -> DataFrame:
    """``docs`` with a struct of the counts of the whole text."""
    return docs.withColumn(name, _counts(F.col(f"`{text}`")))


def features(counts: str = "counts") -> list[Column]:
    out = []
    for name, formula in FEATURES.items():
        for c in COUNTS:
            formula = formula.replace(c, f"`{counts}`.{c}") if c in formula.split() else formula
        top, _, below = formula.partition(" / ")
        out.append((F.coalesce(F.try_divide(F.expr(top), F.expr(below)), F.lit(0.0)) if below
                    else F.expr(top).cast("double")).alias(name))
    return out


def base_failed(counts: str = "counts") -> Column:
    n, r = F.col(f"`{counts}`.n_words"), F.col(f"`{counts}`.n_repeat_words")
    return (n < 20) | (100 * r > 30 * n)


class DecisionList:
    """Ordered rules ``[(name, op, threshold), ...]``, each of which rejects."""

    def __init__(self, rules: list[list[tuple[str, str, float]]]):
        self.rules = rules

    def expressions(self, of: str = "") -> list[str]:
        """SQL conditions over the columns of ``FEATURES``, or over the fields of the struct ``of``."""
        return [" AND ".join(f"{of and f'`{of}`.'}`{c}` {op} {float(x)!r}D" for c, op, x in rule) for rule in self.rules]

    def verdict(self, of: str = "") -> Column:
        """The number of the first rule that rejects the row, 0 if none does."""
        out = F
        for i, e in enumerate(self.expressions(of), 1):
            out = out.when(F.expr(e), i)
        return out.otherwise(0) if self.rules else F.lit(0)


def _meets(x: np.ndarray, rule, names: list[str]) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for c, op, t in rule:
        v = x[:, names.index(c)]
        ok &= (v > t) if op == ">" else (v <= t)
    return ok


def _grow(x, bad, names, cuts, max_conditions: int):
    rule, on = [], np.ones(len(x), dtype=bool)
    while len(rule) < max_conditions and (bad & on).any() and (~bad & on).any():
        p0, n0 = int((bad & on).sum()), int((~bad & on).sum())
        best, choice = 0.0, None
        for j, name in enumerate(names):
            values = x[on, j]
            is_bad = bad[on]
            order = np.sort(values[is_bad]), np.sort(values[~is_bad])
            below = [np.searchsorted(o, cuts[j], side="right") for o in order]
            for op, p, n in ((">", p0 - below[0], n0 - below[1]), ("<=", below[0], below[1])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1)) - math.log2(p0 / (p0 + n0))), 0)
                k = int(np.argmax(gain))
                if gain[k] > best + 1e-9:
                    best, choice = float(gain[k]), (name, op, float(cuts[j][k]))
        if choice is None:
            break
        rule.append(choice)
        on &= _meets(x, [choice], names)
    return rule


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], min_precision: float = 0.9, min_cover: int = 10,
                max_rules: int = 12, max_conditions: int = 4, n_cuts: int = 200) -> DecisionList:
    """Sequential covering of the rows flagged ``bad``; every third row prunes.

    A pruned rule is kept if, on the pruning rows, it covers at least ``min_cover`` rows of which a share of
    ``min_precision`` is bad. One class, or no rows, gives an empty list, which keeps everything.
    """
    rules: list = []
    holds = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_cuts + 1))) for j in range(len(names))] if len(x) else []
    while len(rules) < max_rules:
        g, h = left & ~holds, left & holds
        if not bad[g].any() or not (~bad[g]).any():
            break
        rule = _grow(x[g], bad[g], names, cuts, max_conditions)
        best = None
        for size in range(len(rule), 0, -1):
            on = _meets(x[h], rule[:size], names)
            p, n = int((bad[h] & on).sum()), int((~bad[h] & on).sum())
            worth = (p - n) / (p + n) if p + n else -1.0
            if p + n >= min_cover and p >= min_precision * (p + n) and (best is None or worth > best[0]):
                best = (worth, rule[:size])
        if best is None:
            break
        rules.append(best[1])
        left &= ~_meets(x, best[1], names)
    return DecisionList(rules)


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id",
             sample_rows: int = 12_000) -> DataFrame:
    """Features and label of a sample of at most ``sample_rows`` labels, chosen by a hash of the key."""
    chosen = (labels.select(F.col(key).alias("label_key"), F.col(label).cast("int").alias("label_value"))
              .dropna().orderBy(F.xxhash64("label_key"), "label_key", "label_value").limit(sample_rows))
    rows = docs.select(F.col(key).alias("row_key"), "text").join(F.broadcast(chosen), F.col("row_key") == F.col("label_key"))
    return with_counts(rows).select("label_key", "label_value", *features())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", sample_rows: int = 12_000,
        **options) -> DecisionList:
    """Learn a list from the labelled documents; label 0 is bad. The sample, some numbers a row, goes to the driver."""
    names = list(FEATURES)
    table = labelled(docs, labels, label, key, sample_rows).limit(sample_rows).toPandas()
    table = table.sort_values(["label_key", "label_value", *names])
    return learn_rules(table[names].to_numpy(dtype=float), table["label_value"].to_numpy() == 0, names, **options)


def judge(docs: DataFrame, rules: DecisionList, name: str = "judged") -> DataFrame:
    """``docs`` with struct ``name``: counts, ``base_failed``, ``rule`` (0: none) and ``kept``.

    A null or empty text has counts of 0 and fails the base rules; repeated rows are judged alike; an empty table gives no
    rows. Other columns, whatever their names, stay as they are; ``name`` must not be one of them.
    """
    if tx.unused(docs.columns, name) != name:
        raise ValueError(f"there is a column {name} already")
    counts = tx.unused(docs.columns, "counts")
    values = tx.unused(docs.columns, "features")
    counted = with_counts(docs, name=counts).withColumn(values, F.struct(*features(counts)))
    failed = base_failed(counts)
    rule = rules.verdict(values)
    out = F.struct(*[F.col(f"`{counts}`.{c}") for c in COUNTS], failed.alias("base_failed"), rule.alias("rule"),
                   (~failed & (rule == 0)).alias("kept"))
    return counted.withColumn(name, out).drop(counts, values)
