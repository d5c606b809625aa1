"""Running values over a stream's order without putting the stream into one task."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each column of the order is cut in so many ranges at most, besides those of its frequent values.
MOST_CUTS = 256
#: How exact the quantiles are at which it is cut; only the evenness of the ranges depends on it.
ERROR = 0.002
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _exact(stream: DataFrame, order: list[str]) -> list[tuple[Column, bool]]:
    """Columns in the same order whose values doubles hold exactly, and whether they are whole numbers; none after one that isn't."""
    kinds, out = dict(stream.dtypes), []
    for c in order:
        col = F.col(c)
        if kinds[c] == "bigint":
            out += [(F.shiftright(col, 32), True), (col.bitwiseAND(F.lit(0xFFFFFFFF)), True)]
        else:
            if c == order[0] or kinds[c] in WHOLE:
                out.append((col, kinds[c] in WHOLE))
            if kinds[c] not in WHOLE:
                break
    return out


def with_cut(stream: DataFrame, order: list[str]) -> DataFrame:
    """stream with __cut, the number of the range of the order that a row lies in; no range holds much more than its share of the rows.

    The bounds are quantiles of each column that one pass gives, at most MOST_CUTS numbers a column; rows find
    theirs by binary search. A value that takes several quantiles has a range of its own, which is cut by the next
    column. Rows that are equal in all columns lie in one range, and ranges follow each other as the order does.
    """
    parts = min(MOST_CUTS, int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = _exact(stream, order) if parts > 1 else []
    names, ranges = [f"__of_order{i}" for i in range(len(columns))], [f"__range{i}" for i in range(len(columns))]
    split = stream.withColumns({name: col.cast("double") for name, (col, _) in zip(names, columns)})
    found = split.select(*names).approxQuantile(names, [i / parts for i in range(1, parts)], ERROR) if columns else []
    cut, width = F.lit(0).cast("long"), 1
    for name, place, (_, whole), quantiles in reversed(list(zip(names, ranges, columns, found))):
        times = Counter(int(q) for q in quantiles)
        often = sorted(v for v, n in times.items() if n > 1 and whole)
        bounds = sorted({*times, *(v + 1 for v in often)})
        if not bounds:
            continue
        split = Bucketizer(splits=[-math.inf, *map(float, bounds), math.inf], inputCol=name, outputCol=place).transform(split)
        own = F.col(place).cast("long")
        cut = own * width + F.when(own.isin([bounds.index(v) + 1 for v in often]), cut).otherwise(0) if often and width > 1 else own * width
        width *= len(bounds) + 1
    return split.withColumn("__cut", cut).drop(*names, *ranges)


def running(stream: DataFrame, name: str, value: Column, order: list[str], take: Callable[[Column], Column], total: Callable[[Column], Column], join: Callable[[Column, Column], Column], keys: list[str] | None = None) -> DataFrame:
    """stream with `name`: what take makes of value over the rows of the same keys up to and with the row.

    order: the columns of the order, the first one numeric and without nulls. take works over a window, total sums up a group of rows
    (it may use `__order`, the order as a struct), join puts together what earlier ranges gave and what the own
    range gives. Only one row a range (and key) is carried from range to range.
    """
    keys = keys or []
    rows = with_cut(stream, order).withColumn("__value", value)
    inside = Window.partitionBy(*keys, "__cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    of_range = rows.withColumn("__order", F.struct(*order)).groupBy(*keys, "__cut").agg(total(F.col("__value")).alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    carried = of_range.withColumn("__carried", take(F.col("__total")).over(before))
    carried = carried.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__cut").alias("__of_cut"), "__carried")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys], F.col("__cut") == F.col("__of_cut"))
    own = rows.withColumn("__own", take(F.col("__value")).over(inside)).join(carried, same, "left")
    return own.withColumn(name, join(F.col("__carried"), F.col("__own"))).drop("__cut", "__value", "__own", "__carried", "__of_cut", *[f"__of_{k}" for k in keys])


def running_max(stream: DataFrame, name: str, value: Column, position: str) -> DataFrame:
    """The largest value so far."""
    return running(stream, name, value, [position], F.max, F.max, F.greatest)


def running_last(stream: DataFrame, name: str, value: Column, position: str, keys: list[str]) -> DataFrame:
    """The last value so far that isn't null, by keys."""
    last = lambda c: F.last(c, ignorenulls=True)
    return running(stream, name, value, [position], last, lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("__order"))), lambda a, b: F.coalesce(b, a), keys)


def numbered(stream: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Each row's number in the order, from 1; the order must tell all rows apart."""
    return running(stream, name, F.lit(1).cast("long"), order, F.sum, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b)
