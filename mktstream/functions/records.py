"""Single records as Python objects, for looking at rows and building small inputs."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pyarrow as pa

from mktstream.functions import values as V
from mktstream.plans.metadata import ConversionError
from mktstream.plans.upgrade import DEFAULTS, upgrade_columns
from mktstream.sources.codec import from_arrow, layout_of, to_arrow
from mktstream.sources.layouts import LAYOUTS, arrow_type, fields, index_column, layout_name, spark_schema

_TIMES = ("ts_event", "ts_recv", "ts_ref", "ts_out", "expiration", "activation", "start_ts", "end_ts", "auction_time")


class Record:
    """A record of a layout: its columns as attributes, raw as in the file (unsigned 64-bit numbers as they are)."""

    def __init__(self, layout: str, **values):
        self.layout = layout
        kinds = {name: kind for name, kind in fields(layout)}
        for f in spark_schema(layout):
            text = f.dataType.simpleString() == "string"
            default = V.UNDEF_PRICE if "px" in f.name or f.name.endswith("price") and kinds.get(f.name) == "i64" else V.UNDEF_TIMESTAMP if f.name in _TIMES else DEFAULTS.get(f.name, "" if text else 0)
            setattr(self, f.name, values.pop(f.name, default))
        self.ts_out = values.pop("ts_out", None)
        if values:
            raise ConversionError(f"{layout} has no {', '.join(values)}")

    @classmethod
    def from_bytes(cls, data: bytes, version: int | None = None, ts_out: bool = False) -> Record:
        if len(data) < 16 or data[0] * 4 != len(data):
            raise ConversionError(f"{len(data)} bytes are no record")
        layout = layout_of(data[1], len(data), version, ts_out)
        if layout is None:
            raise ConversionError(f"no record type {data[1]:#x}")
        return cls.of_columns(layout, {c: v[0].as_py() for c, v in to_arrow(data, 0, 1, layout, ts_out, strict=True).items()})

    @classmethod
    def of_columns(cls, layout: str, columns: dict) -> Record:
        """From columns as a table has them, with unsigned 64-bit times as their bits in a long."""
        return cls(layout, **{c: v % 2**64 if c in _TIMES and v is not None else v for c, v in columns.items()})

    def __bytes__(self) -> bytes:
        signed = lambda v: v - 2**64 if isinstance(v, int) and v >= 2**63 else v
        schema = spark_schema(self.layout)
        columns = {f.name: pa.array([signed(getattr(self, f.name))], arrow_type(f.dataType)) for f in schema}
        if self.ts_out is not None:
            columns["ts_out"] = pa.array([signed(self.ts_out)], pa.int64())
        return from_arrow(pa.RecordBatch.from_pydict(columns), self.layout, self.ts_out is not None)

    def upgraded(self, version: int = 3) -> Record:
        """The record in the layout of a newer version; one that is as new already stays as it is."""
        kind = self.layout.split("_v")[0]
        to = layout_name(kind, version)
        if LAYOUTS[to][0] <= LAYOUTS[self.layout][0]:
            return self
        data = bytes(self)
        columns = upgrade_columns(to_arrow(data, 0, 1, self.layout, self.ts_out is not None), kind, self.layout, to)
        return Record.of_columns(to, {c: v[0].as_py() for c, v in columns.items()})

    @property
    def record_size(self) -> int:
        return len(bytes(self))

    @property
    def index_ts(self) -> int:
        return getattr(self, index_column(self.layout))

    @property
    def publisher(self) -> str | None:
        return V.PUBLISHERS[self.publisher_id - 1] if 0 < self.publisher_id <= len(V.PUBLISHERS) else None

    def px_float(self, field: str) -> float:
        """A fixed-point field as a float, NaN if undefined."""
        v = getattr(self, field)
        return float("nan") if v == V.UNDEF_PRICE else v / V.FIXED_PRICE_SCALE

    def ts_datetime(self, field: str) -> datetime | None:
        """A time with microseconds in UTC, None if undefined."""
        v = getattr(self, field)
        return None if v == V.UNDEF_TIMESTAMP else datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=v // 1000)

    def __eq__(self, other) -> bool:
        return isinstance(other, Record) and bytes(self) == bytes(other)

    def __hash__(self) -> int:
        return hash(bytes(self))

    def __repr__(self) -> str:
        def shown(name: str, value) -> str:
            if name in _TIMES and isinstance(value, int):
                return "UNDEF_TIMESTAMP" if value == V.UNDEF_TIMESTAMP else str(self.ts_datetime(name))
            return "UNDEF_PRICE" if value == V.UNDEF_PRICE else repr(value)

        return f"{self.layout}({', '.join(f'{f.name}={shown(f.name, getattr(self, f.name))}' for f in spark_schema(self.layout))})"
