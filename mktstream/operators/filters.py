"""Selections and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mktstream.functions.values import RTYPE_SCHEMA, SCHEMA_RTYPE
from mktstream.sources.layouts import HEADER


def schema_filter(records: DataFrame, schema: str | None) -> DataFrame:
    """Records of the schema's record type; tbbo and mbp-1 share theirs."""
    return records if schema is None else records.where(F.col("rtype") == SCHEMA_RTYPE[schema])


def limit_records(records: DataFrame, n: int | None, order: list[str | Column]) -> DataFrame:
    """The first n records in stream order; a filter goes before."""
    if n is None:
        return records
    if n < 1:
        raise ValueError("the limit must not be zero")
    return records.orderBy(*order).limit(n)


def typed(records: DataFrame, rtype: int, strict: bool = True) -> DataFrame:
    """Records of one type; with strict any other is an error, else it is left out."""
    if not strict:
        return records.where(F.col("rtype") == rtype)
    return records.where(F.when(F.col("rtype") == rtype, True).otherwise(F.raise_error(F.concat(F.lit("unexpected record type "), F.col("rtype").cast("string"))).cast("boolean")))


def of_kind(mixed: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind of a table of mixed types, as a table with the columns of that kind."""
    first = [c for c in ("ts_recv",) if c in mixed.schema[kind].dataType.names]
    rest = [c for c in mixed.schema[kind].dataType.names if c not in first]
    further = [c for c in ("ts_out", "position", "symbol") if c in mixed.columns]
    return mixed.where(F.col(kind).isNotNull()).select(*[f"{kind}.{c}" for c in first], *HEADER, *[f"{kind}.{c}" for c in rest], *further)


def data_records(records: DataFrame) -> DataFrame:
    """Records that belong to a schema: no errors, system messages or symbol mappings."""
    return records.where(F.col("rtype").isin(*RTYPE_SCHEMA))


def flattened(records: DataFrame, column: str = "levels", count: int = 10) -> DataFrame:
    """An array of price levels laid out as columns with the level as a suffix."""
    names = records.schema[column].dataType.elementType.names
    return records.select(*[c for c in records.columns if c != column], *[F.try_element_at(column, F.lit(i + 1))[n].alias(f"{n}_{i:02}") for i in range(count) for n in names])
