"""Column expressions: tolerant casts, dates, codings, censoring and stable hashes.

All are built-in Spark expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEVER = 80  # week code of a threshold that was never crossed


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column, dtype: str = "double", whole: bool = True) -> Column:
    """Text or number to ``dtype``; what cannot be read, and NaN, becomes null; half-even rounding."""
    x = _col(c).try_cast("double")
    x = F.when(~F.isnan(x), x)
    if whole:
        x = F.bround(x, 0)
    return x if dtype == "double" else x.try_cast(dtype)


def coerce_numeric(df: DataFrame, types: Mapping[str, str], whole: bool = True) -> DataFrame:
    """Apply :func:`to_number` to the named columns that the table has."""
    return df.withColumns({c: to_number(f"`{c}`", t, whole) for c, t in types.items() if c in df.columns})


def to_day(c: str | Column, fmt: str = "M/d/yy H:mm:ss", century_pivot: int = 69) -> Column:
    """Text to date, null where it does not parse.

    With a two-digit year, values from ``century_pivot`` on belong to the 1900s.
    """
    d = F.try_to_date(_col(c), fmt)
    if "yy" in fmt and "yyyy" not in fmt:
        d = F.when(F.year(d) >= 2000 + century_pivot, F.add_months(d, -1200)).otherwise(d)
    return d


def parse_dates(df: DataFrame, cols: Sequence[str], fmt: str = "M/d/yy H:mm:ss",
                century_pivot: int = 69) -> DataFrame:
    return df.withColumns({c: to_day(c, fmt, century_pivot) for c in cols if c in df.columns})


def cast_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast to text; nulls stay null."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def slice_columns(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Columns ``start`` to ``stop - 1`` by position."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[start:stop]])


def censor(c: str | Column, limit: int, code: int = NEVER) -> Column:
    """Keep the value up to ``limit``, else the censoring code."""
    return F.when(_col(c) <= limit, _col(c)).otherwise(F.lit(code))


def encode_flag(c: str | Column, *values: str) -> Column:
    """True where the category is one of ``values``; a missing category is false."""
    x = _col(c)
    test = (x == values[0]) if len(values) == 1 else x.isin(*values)
    return F.coalesce(test, F.lit(False))


def encode_map(c: str | Column, mapping: Mapping[str, float]) -> Column:
    """Category to number; categories outside the map become null."""
    out = None
    for k, v in mapping.items():
        cond = _col(c) == F.lit(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out


def week_class(c: str | Column, early: int = 24, late: int = 40) -> Column:
    """0 up to ``early``, 1 up to ``late``, 2 after that or never."""
    x = _col(c)
    return F.when(x <= early, 0).when(x <= late, 1).otherwise(2)


def lived_at_least(days: int | Column, birth: str = "birth_date", death: str = "death_date") -> Column:
    """Known to have lived that many days; no death date gives false."""
    return F.coalesce(F.datediff(F.col(death), F.col(birth)) >= days, F.lit(False))


def by_sex(sex: str | Column, cutoffs: Mapping[str, int]) -> Column:
    """The cutoff week of a row's sex; null for a sex without one."""
    return encode_map(sex, cutoffs)


def any_flag(*flags: Column) -> Column:
    """Logical OR with missing flags taken as false."""
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f.cast("boolean"), F.lit(False))
    return out


def hash32(key: str | Column, seed: int) -> Column:
    """A stable 32-bit hash of a key; the same whatever the partitioning, engine or run."""
    text = F.concat(F.lit(f"{seed}:"), _col(key).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


HASH_SPAN = 1 << 32
