"""Column cleaning: trimming, casting, padding, clipping, rounding, predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every string column, driven by the schema."""
    return df.select([
        F.trim(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def strict_cast(column: Column, kind: str) -> Column:
    """Cast that fails on text it cannot read."""
    return F.when(column.isNotNull(), F.coalesce(
        column.try_cast(kind),
        F.raise_error(F.concat(F.lit(f"not a {kind}: "), column.cast("string"))).cast(kind),
    ))


def tolerant_cast(column: Column, kind: str) -> Column:
    """Cast that gives null on text it cannot read; NaN becomes null too."""
    value = column.try_cast(kind)
    return F.nanvl(value, F.lit(None).cast(kind)) if kind in ("double", "float") else value


def no_nan(column: Column) -> Column:
    return F.nanvl(column, F.lit(None).cast("double"))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in every floating-point column; other columns are passed on as they are."""
    odd = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(df.schema[c].dataType)) for c in odd}) if odd else df


def zero_pad(column: Column, width: int) -> Column:
    """Left-pad with zeros; longer text is left alone."""
    text = column.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def composite_key(*columns: Column) -> Column:
    return F.concat(*columns)


def drop_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def in_list(column: Column, values: Iterable) -> Column:
    return column.isin(list(values))


def has_prefix(column: Column, prefix: str) -> Column:
    return column.startswith(prefix)


def blank(column: Column) -> Column:
    """True for null and for empty or space-only text."""
    return column.isNull() | (F.trim(column) == "")


def parse_date(column: Column, pattern: str = "yyyyMMdd") -> Column:
    """Date from text, null when it cannot be read."""
    return F.try_to_timestamp(column, F.lit(pattern)).cast("date")


def clip_lower(column: Column, low: float) -> Column:
    """Lower bound that leaves null as null."""
    return F.when(column.isNotNull(), F.greatest(column, F.lit(float(low))))


def round_to(column: Column, digits: int) -> Column:
    """Half-up rounding."""
    return F.round(column, digits)


def settle(column: Column, digits: int) -> Column:
    """Half-up rounding of sums and averages, which carry noise: it is removed six digits further down first.

    The order in which a cluster adds doubles is not fixed; without the inner rounding a
    value on a tie would fall either way from run to run. Values as they were read need ``round_to``.
    """
    return F.round(F.round(column, digits + 6), digits)


def fixed(column: Column, digits: int) -> Column:
    """Text with a fixed number of decimals."""
    return settle(column, digits).cast(f"decimal(28,{digits})").cast("string")


def present(df: DataFrame, columns: list[str]) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    have = set(df.columns)
    return [c for c in columns if c in have]


def active_features(df: DataFrame, candidates: list[str]) -> list[str]:
    """Candidates that exist and hold at least one value; one aggregate pass for all of them."""
    names = present(df, candidates)
    if not names:
        return []
    counts = df.agg(*[F.count(no_nan(F.col(c).cast("double"))).alias(c) for c in names]).first()
    return [c for c in names if counts[c] > 0]


def split_years(df: DataFrame, train: list[int], year: str = "year") -> tuple[DataFrame, DataFrame]:
    """Rows of the training years, and the others."""
    inside = F.col(year).isin(train)
    return df.where(inside), df.where(~inside)
