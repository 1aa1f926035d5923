"""Tables of several studies brought to one schema by mappings that say, per column, where it comes from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .questionnaires import zscore

#: Types that a column may have where a wider one is asked for: each with those after it.
WIDER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType), (T.DateType, T.TimestampNTZType)


def fits(found: T.DataType, wanted: T.DataType) -> bool:
    """Whether values of one type can be taken as another without losing any: the same, an untyped null, or a wider one of its kind."""
    if isinstance(found, T.NullType) or found == wanted:
        return True
    return any(type(found) in order and type(wanted) in order and order.index(type(found)) <= order.index(type(wanted)) for order in WIDER)


def to_schema(df: DataFrame, schema: str | T.StructType, mapping: Mapping[str, str | Column], required: Sequence[str] = ()) -> DataFrame:
    """PO1, PO2: exactly the columns of ``schema``, each from ``mapping``: a column of ``df`` by its name, or an expression.

    A column without a source, or whose named source ``df`` lacks, is null, unless it is ``required``: that is an error, as
    are mapped columns that the schema lacks and types that would lose values. All errors are reported at once.
    """
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    wrong = [f"{name}: not in the schema" for name in mapping if name not in {f.name for f in fields}]
    sources: dict[str, Column] = {}
    for f in fields:
        source = mapping.get(f.name)
        if isinstance(source, str):
            source = F.col(f"`{source}`") if source in df.columns else None
        if source is None and f.name in required:
            wrong.append(f"{f.name}: no source")
        sources[f.name] = F.lit(None).cast(f.dataType) if source is None else source
    found = df.select(*[c.alias(n) for n, c in sources.items()]).schema
    wrong += [f"{f.name}: {found[f.name].dataType.simpleString()} does not fit {f.dataType.simpleString()}" for f in fields if not fits(found[f.name].dataType, f.dataType)]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(*[sources[f.name].cast(f.dataType).alias(f.name) for f in fields])


def standardised(df: DataFrame, scores: Mapping[str, str], by: Sequence[str] = (), signs: Mapping[str, int] | None = None) -> DataFrame:
    """PO1, PO2: adds a z score per raw score (``scores``: new column -> raw one), times its sign.

    With ``by``, within these keys by the sample deviation; otherwise over all rows by the population's. A single value, or
    values without spread, have 0; a null stays null.
    """
    for into, raw in scores.items():
        df = zscore(df, raw, list(by), into, ddof=1 if by else 0).withColumn(into, F.col(into) * (signs or {}).get(into, 1))
    return df


def pool(parts: Sequence[DataFrame]) -> DataFrame:
    """PO3: the rows of all parts, which must have the same columns of the same types."""
    first, *others = parts
    for p in others:
        if p.dtypes != first.dtypes:
            raise ValueError(f"the parts differ: {sorted(set(first.dtypes) ^ set(p.dtypes))}")
        first = first.unionByName(p)
    return first
