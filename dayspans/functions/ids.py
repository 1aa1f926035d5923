"""Identifiers: column expressions that bring dirty participant ids to one form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes in the order in which they are tried; a study passes its own.
PREFIXES = ("study", "study_", "study-", "p_", "p", "pilot_")


def _drop_zeros(digits: Column) -> Column:
    short = F.ltrim(digits, F.lit("0"))
    return F.when((short == "") & (digits != ""), "0").otherwise(short)


def _first_number(s: Column) -> Column:
    return F.regexp_extract(s, "[0-9]+", 0)


def standardize_id(raw: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """ID1: trim, drop the first matching prefix and a trailing p, then the first number without leading zeros, else letters and digits."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    cut = s
    for p in reversed(prefixes):
        cut = F.when(F.lower(s).startswith(p), F.substring(s, len(p) + 1, 1_000)).otherwise(cut)
    cut = F.regexp_replace(cut, "[pP]$", "")
    n = _first_number(cut)
    return F.when(n != "", _drop_zeros(n)).otherwise(F.regexp_replace(cut, "[^A-Za-z0-9]", ""))


def clean_id(raw: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """ID2: every prefix is dropped in turn; the first number without leading zeros, else what is left."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    s = reduce(lambda x, p: F.when(F.lower(x).startswith(p), F.substring(x, len(p) + 1, 1_000)).otherwise(x), prefixes, s)
    s = F.regexp_replace(s, "[pP]$", "")
    n = _first_number(s)
    return F.when(n != "", _drop_zeros(n)).otherwise(s)


def padded_id(raw: Column, width: int = 3) -> Column:
    """ID3: digits only, filled up to ``width``; letters and digits where there are no digits."""
    d = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(d == "", F.regexp_replace(raw, "[^A-Za-z0-9]", "")).when(F.length(d) < width, F.lpad(d, width, "0")).otherwise(d)


def short_id(raw: Column, width: int = 2) -> Column:
    """ID4: digits only, leading zeros off, filled up to at least ``width``."""
    d = F.ltrim(F.regexp_replace(raw, "[^0-9]", ""), F.lit("0"))
    return F.when(F.length(d) < width, F.lpad(d, width, "0")).otherwise(d)


def integer_id(raw: Column) -> Column:
    """ID5: as a whole number where it is one, else unchanged."""
    return F.coalesce(raw.try_cast("bigint").cast("string"), raw)


def composite_id(source: Column, raw: Column) -> Column:
    """ID7: source and id in one."""
    return F.concat_ws("_", source, raw.cast("string"))


def source_of(raw: Column) -> Column:
    """ID9: what stands before the first underscore, in lower case."""
    return F.lower(F.split_part(raw, F.lit("_"), F.lit(1)))


def surrogate_id(*parts: Column, length: int = 64) -> Column:
    """ID8: a key that the row's own values give, the same on every run."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length)


def id_mapping(df: DataFrame, raw: str, clean: Column) -> DataFrame:
    """ID6: the distinct pairs of raw and clean id."""
    return df.select(F.col(raw), clean.alias("clean_id")).distinct()


def composite_check(df: DataFrame, source: str, raw: str) -> DataFrame:
    """ID7: whether the composite id is as distinct as the pair it is made of."""
    pairs = df.select(source, raw, composite_id(F.col(source), F.col(raw)).alias("c")).distinct()
    return pairs.agg(F.count("*").alias("n_pairs"), F.countDistinct("c").alias("n_composite"))
