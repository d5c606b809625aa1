"""Records of older versions as those of newer ones: by projections, and batch by batch while they are read."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mktstream.functions.values import UNDEF_PRICE, UNDEF_STAT_QUANTITY, UNDEF_STAT_QUANTITY_V1
from mktstream.sources.layouts import arrow_type, spark_schema

# The versions that policies lead to, fields that older records lack and that don't become zero or empty,
# and codes told by texts (how the text begins, how it ends, whether it begins where it ends, code).
POLICIES = {"as_is": None, "upgrade_to_v2": 2, "upgrade_to_v3": 3}
DEFAULTS = {"leg_price": UNDEF_PRICE, "leg_delta": UNDEF_PRICE, "leg_side": "N", "code": 255, "is_last": 255, "stype_in": 255, "stype_out": 255}
ERROR_TEXTS = [
    ("User or API key deactivated", "", True, 2), ("User has reached their open connection limit", "", True, 3), ("Failed to resolve symbol", "", False, 4),
    ("Internal error", "", True, 6), ("Slow client detected for ", "", False, 7),
]
SYSTEM_TEXTS = [
    ("Heartbeat", "", True, 0), ("End of interval for ", "", False, 4), ("Subscription request ", " succeeded", False, 1), ("Warning: slow reading", "", False, 2),
    ("Finished ", " replay", False, 3),
]
TEXTS = {"error": ("err", ERROR_TEXTS), "system": ("msg", SYSTEM_TEXTS)}


def check_policy(policy: str, version: int) -> int:
    """The version that comes out: as_is, upgrade_to_v2 or upgrade_to_v3."""
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    target = POLICIES[policy] or version
    if target < version:
        raise ValueError(f"{policy} on version {version}")
    return target


def _code(text: Column, rules: list[tuple[str, str, bool, int]]) -> Column:
    code = F.lit(255)
    for start, end, whole, value in reversed(rules):
        code = F.when(text == start if whole else text.startswith(start) & text.endswith(end), value).otherwise(code)
    return code.cast("short")


def error_code(err: Column) -> Column:
    return _code(err, ERROR_TEXTS)


def system_code(msg: Column) -> Column:
    return _code(msg, SYSTEM_TEXTS)


def stat_quantity(quantity: Column) -> Column:
    return F.when(quantity == UNDEF_STAT_QUANTITY_V1, F.lit(UNDEF_STAT_QUANTITY)).otherwise(quantity.cast("long"))


def _default(name: str, text: bool):
    return DEFAULTS.get(name, "" if text else 0)


def upgrade(records: DataFrame, kind: str, to: str) -> DataFrame:
    """records of a kind in the layout `to` (such as definition or definition_v2); further columns stay, as ts_out.

    Columns that the target lacks go, those that the source lacks get the target's defaults.
    """
    target = spark_schema(to)
    own = set(records.columns)
    extra = [c for c in records.columns if c not in target.names and c in ("ts_out", "symbol", "position")]
    out = []
    for f in target:
        if f.name == "quantity" and to == "statistics":
            value = stat_quantity(F.col("quantity"))
        elif f.name in own:
            value = F.col(f.name)
        elif f.name == "code" and kind in TEXTS:
            value = _code(F.col(TEXTS[kind][0]), TEXTS[kind][1])
        else:
            value = F.lit(_default(f.name, f.dataType.simpleString() == "string"))
        out.append(value.cast(f.dataType).alias(f.name))
    return records.select(*out, *extra)


def upgrade_columns(columns: dict[str, pa.Array], kind: str, source: str, to: str) -> dict[str, pa.Array]:
    """upgrade() of the Arrow columns of a batch, from one layout to another; ts_out stays."""
    if source == to:
        return columns
    n = len(next(iter(columns.values())))
    out = {}
    for f in spark_schema(to):
        kind_of = arrow_type(f.dataType)
        if f.name == "quantity" and source == "statistics_v1" and to == "statistics":
            q = columns["quantity"].cast(pa.int64())
            value = pc.if_else(pc.equal(q, UNDEF_STAT_QUANTITY_V1), pa.scalar(UNDEF_STAT_QUANTITY, pa.int64()), q)
        elif f.name in columns:
            value = columns[f.name]
        elif f.name == "code" and kind in TEXTS:
            column, rules = TEXTS[kind]
            text, value = columns[column], pa.array([255] * n, pa.int64())
            for start, end, whole, code in reversed(rules):
                hit = pc.equal(text, start) if whole else pc.and_(pc.starts_with(text, start), pc.ends_with(text, end))
                value = pc.if_else(hit, pa.scalar(code, pa.int64()), value)
        else:
            value = pa.array([_default(f.name, pa.types.is_string(kind_of))] * n, kind_of)
        out[f.name] = value.cast(kind_of)
    return out | ({"ts_out": columns["ts_out"]} if "ts_out" in columns else {})
