"""Stream metadata: its fields, bytes, JSON, merging, splitting and symbol intervals."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta, timezone

import zstandard
from pyspark.sql import DataFrame, SparkSession

from mktstream.functions import values as V

# The first bytes, widths and marks for absent fields.
MAGIC = b"DBN"
NULL_SCHEMA = 0xFFFF
NULL_STYPE = 0xFF
START_OFFSET = 26
SYMBOL_WIDTH = {0: 22, 1: 22, 2: 71, 3: 71}
RESERVED = {1: 47, 2: 53, 3: 53}
LEGACY_MAGIC, LEGACY_FIXED, LEGACY_RESERVED = b"DBZ\x01", 96, 39

Interval = tuple[date, date, str]


class FormatError(ValueError):
    """Bytes or values that the format doesn't allow."""


class DecodeError(FormatError):
    """Bytes that are no record or metadata."""


class EncodeError(FormatError):
    """Values that cannot be written."""


class ConversionError(FormatError):
    """A value that a type or enumeration doesn't have."""


@dataclass(frozen=True)
class Metadata:
    dataset: str
    start: int
    stype_out: str = "instrument_id"
    schema: str | None = None
    end: int | None = None
    limit: int | None = None
    stype_in: str | None = "raw_symbol"
    ts_out: bool = False
    version: int = 3
    symbols: tuple[str, ...] = ()
    partial: tuple[str, ...] = ()
    not_found: tuple[str, ...] = ()
    mappings: dict[str, list[Interval]] = field(default_factory=dict)

    def __post_init__(self):
        if self.version not in SYMBOL_WIDTH:
            raise FormatError(f"version {self.version}")

    @property
    def symbol_width(self) -> int:
        return SYMBOL_WIDTH[self.version]

    def upgraded(self, version: int = 3) -> Metadata:
        if version < self.version:
            raise FormatError(f"cannot turn version {self.version} into {version}")
        return replace(self, version=version)

    def is_inverse(self) -> bool:
        """Whether symbols are mapped from instrument ids; both ways as ids count as not inverse."""
        if self.stype_out == "instrument_id":
            return False
        if self.stype_in == "instrument_id":
            return True
        raise FormatError("neither input nor output symbols are instrument ids")

    def intervals(self) -> list[tuple[int, date, date, str, int]]:
        """(instrument_id, start, end, symbol, ordinal) of every mapping interval with a symbol, in order."""
        inverse, out = self.is_inverse(), []
        for raw, spans in self.mappings.items():
            for start, end, symbol in spans:
                if symbol:
                    number, name = (raw, symbol) if inverse else (symbol, raw)
                    out.append((int(number), start, end, name, len(out)))
        return out

    def at_date(self, day: date) -> list[tuple[int, str]]:
        """(instrument_id, symbol) on a day: each mapping's first covering interval, none if that is empty."""
        midnight = int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp()) * 10**9
        if day < ns_date(self.start) or (self.end is not None and midnight >= self.end):
            raise FormatError(f"{day} is outside the range of the metadata")
        inverse, out = self.is_inverse(), {}
        for raw, spans in self.mappings.items():
            symbol = next((s for a, b, s in spans if a <= day < b), "")
            if symbol:
                number, name = (raw, symbol) if inverse else (symbol, raw)
                out[int(number)] = name
        return list(out.items())

    def encode(self) -> bytes:
        if not self.version:
            raise EncodeError("the legacy format is only read")
        if not self.dataset.isascii() or len(self.dataset) > 16:
            raise EncodeError(f"dataset {self.dataset!r}")
        out = [_fixed(self.dataset, 16, full=True), struct.pack("<H", V.SCHEMAS[self.schema] if self.schema else NULL_SCHEMA)]
        out.append(struct.pack("<QQQ", self.start, V.UNDEF_TIMESTAMP if self.end is None else self.end, self.limit or 0))
        if self.version == 1:
            out.append(struct.pack("<Q", 0xFFFFFFFFFFFFFFFF))
        out.append(struct.pack("<BBB", V.STYPES[self.stype_in] if self.stype_in else NULL_STYPE, V.STYPES[self.stype_out], self.ts_out))
        if self.version > 1:
            out.append(struct.pack("<H", self.symbol_width))
        out.append(bytes(RESERVED[self.version]) + struct.pack("<I", 0))
        for names in (self.symbols, self.partial, self.not_found):
            out.append(struct.pack("<I", len(names)) + b"".join(_fixed(n, self.symbol_width) for n in names))
        out.append(struct.pack("<I", len(self.mappings)))
        for raw, spans in self.mappings.items():
            out.append(_fixed(raw, self.symbol_width) + struct.pack("<I", len(spans)))
            for a, b, symbol in spans:
                out.append(struct.pack("<II", _date_int(a), _date_int(b)) + _fixed(symbol, self.symbol_width))
        body = b"".join(out)
        if self.version > 2:
            body += bytes(-len(body) % 8)
        return MAGIC + struct.pack("<BI", self.version, len(body)) + body

    @classmethod
    def decode(cls, data: bytes, upgrade_policy: str = "as_is") -> tuple[Metadata, int]:
        """The metadata at the start of data, and the offset of the first record."""
        from mktstream.plans.upgrade import check_policy

        if data[:3] != MAGIC:
            raise DecodeError("no metadata at the start")
        version, length = data[3], struct.unpack_from("<I", data, 4)[0]
        if version not in RESERVED:
            raise DecodeError(f"version {version}")
        if len(data) < 8 + length:
            raise EOFError(8 + length)
        body = _Fields(data, 8)
        dataset, schema = body.take("16s").rstrip(b"\0").decode(), body.take("H")
        start, end, limit = body.take("QQQ")
        if version == 1:
            body.take("Q")
        stype_in, stype_out, ts_out = body.take("BBB")
        width = body.take("H") if version > 1 else SYMBOL_WIDTH[1]
        body.at += RESERVED[version]
        rest = body.symbols(width)
        made = cls(dataset, start, _NAME_OF_STYPE[stype_out], None if schema == NULL_SCHEMA else _NAME_OF_SCHEMA[schema], None if end == V.UNDEF_TIMESTAMP else end, limit or None, None if stype_in == NULL_STYPE else _NAME_OF_STYPE[stype_in], bool(ts_out), version, *rest)
        return made.upgraded(check_policy(upgrade_policy, version)), 8 + length

    @classmethod
    def decode_legacy(cls, data: bytes) -> Metadata:
        """The metadata of the format before version 1: the content of its skippable frame. Records are as those of version 1."""
        if data[:4] != LEGACY_MAGIC or len(data) < LEGACY_FIXED:
            raise DecodeError("no legacy metadata")
        body = _Fields(data, 4)
        dataset, schema = body.take("16s").rstrip(b"\0").decode(), body.take("H")
        start, end, limit, _ = body.take("QQQQ")
        _, stype_in, stype_out = body.take("BBB")
        rest = zstandard.ZstdDecompressor().decompressobj().decompress(data[body.at + LEGACY_RESERVED :])
        return cls(dataset, start, _NAME_OF_STYPE[stype_out], _NAME_OF_SCHEMA[schema], end or None, limit or None, _NAME_OF_STYPE[stype_in], False, 0, *_Fields(rest, 0).symbols(SYMBOL_WIDTH[0]))

    def to_json(self, pretty_ts: bool = False, indent: bool = False) -> str:
        day = (lambda d: d.isoformat()) if pretty_ts else _date_int
        time = (lambda n: ns_text(n)) if pretty_ts else str
        doc = {
            "version": self.version, "dataset": self.dataset, "schema": self.schema, "start": time(self.start), "end": None if self.end is None else time(self.end),
            "limit": None if self.limit is None else str(self.limit), "stype_in": self.stype_in, "stype_out": self.stype_out, "ts_out": self.ts_out,
            "symbols": list(self.symbols), "partial": list(self.partial), "not_found": list(self.not_found),
            "mappings": [{"raw_symbol": r, "intervals": [{"start_date": day(a), "end_date": day(b), "symbol": s} for a, b, s in spans]} for r, spans in self.mappings.items()],
        }
        return json.dumps(doc, indent=4 if indent else None, separators=None if indent else (",", ":"))


_NAME_OF_SCHEMA, _NAME_OF_STYPE = {v: k for k, v in V.SCHEMAS.items()}, {v: k for k, v in V.STYPES.items()}


class _Fields:
    """Little-endian fields read one after the other."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, form: str):
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out if len(out) > 1 else out[0]

    def text(self, width: int) -> str:
        return self.take(f"{width}s").split(b"\0")[0].decode()

    def symbols(self, width: int) -> tuple:
        """symbols, partial, not_found and mappings, after a length that has to be 0."""
        if self.take("I"):
            raise DecodeError("schema definitions aren't known")
        lists = [tuple(self.text(width) for _ in range(self.take("I"))) for _ in range(3)]
        mappings = {}
        for _ in range(self.take("I")):
            raw = self.text(width)
            mappings[raw] = [(_int_date(self.take("I")), _int_date(self.take("I")), self.text(width)) for _ in range(self.take("I"))]
        return *lists, mappings


def mappings_of_json(text: str) -> dict[str, list[Interval]]:
    """Mappings from JSON as symbology services give it: raw symbol to a list of objects with d0, d1 (ISO dates) and s."""
    return {raw: [(date.fromisoformat(i["d0"]), date.fromisoformat(i["d1"]), i["s"]) for i in spans] for raw, spans in json.loads(text).items()}


def filtered(meta: Metadata, schema: str | None = None, limit: int | None = None) -> Metadata:
    """The metadata of a stream after a schema filter and a limit."""
    meta = replace(meta, schema=schema) if schema else meta
    return replace(meta, limit=min(limit, meta.limit or limit)) if limit else meta


def _fixed(text: str, width: int, full: bool = False) -> bytes:
    if not text.isascii() or len(text) > width - (not full):
        raise EncodeError(f"{text!r} doesn't fit {width} bytes")
    return text.encode().ljust(width, b"\0")


def _date_int(d: date) -> int:
    return d.year * 10_000 + d.month * 100 + d.day


def _int_date(n: int) -> date:
    return date(n // 10_000, n // 100 % 100, n % 100)


def ns_date(ns: int) -> date:
    return date(1970, 1, 1) + timedelta(days=ns // (86400 * 10**9))


def ns_text(ns: int) -> str:
    return (datetime(1970, 1, 1) + timedelta(seconds=ns // 10**9)).strftime("%Y-%m-%dT%H:%M:%S") + f".{ns % 10**9:09}Z"


def merge(parts: list[Metadata]) -> Metadata:
    """One metadata for the merged streams; lists are sorted."""
    if not parts:
        raise FormatError("nothing to merge")
    first = parts[0]
    for p in parts[1:]:
        for name in ("version", "dataset", "stype_in", "stype_out", "ts_out"):
            if getattr(p, name) != getattr(first, name):
                raise FormatError(f"{name} differs")
    ends = [p.end for p in parts if p.end is not None]
    mappings: dict[str, list[Interval]] = {}
    for p in parts:
        for raw, spans in p.mappings.items():
            mappings[raw] = merge_intervals(mappings[raw], spans) if raw in mappings else list(spans)
    union = lambda name: tuple(sorted({s for p in parts for s in getattr(p, name)}))
    return replace(
        first, schema=first.schema if all(p.schema == first.schema for p in parts) else None, start=min(p.start for p in parts), end=max(ends, default=None),
        limit=None, symbols=union("symbols"), partial=union("partial"), not_found=union("not_found"), mappings=dict(sorted(mappings.items())),
    )


def merge_intervals(left: list[Interval], right: list[Interval]) -> list[Interval]:
    """Two sorted lists as one, intervals that overlap under one symbol joined; another symbol there is an error.

    Only the heads of the two lists are compared: what two heads join to isn't compared with what follows.
    """
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        (a, b, s), (c, d, t) = left[i], right[j]
        if (a, b) != (c, d) and b <= c:
            out.append(left[i])
            i += 1
        elif (a, b) != (c, d) and d <= a:
            out.append(right[j])
            j += 1
        elif s == t:
            out.append((min(a, c), max(b, d), s))
            i, j = i + 1, j + 1
        else:
            raise FormatError(f"{s} and {t} at once")
    return out + left[i:] + right[j:]


def split_by_time(meta: Metadata, first: date, after: date) -> Metadata:
    """The metadata of one part of a split: clamped to [first, after), intervals clipped, unused symbols gone; not_found stays."""
    ns = lambda d: int(datetime(d.year, d.month, d.day, tzinfo=timezone.utc).timestamp()) * 10**9
    start, end = max(meta.start, ns(first)), min(V.UNDEF_TIMESTAMP if meta.end is None else meta.end, ns(after))
    low, high = ns_date(start), ns_date(end + 86400 * 10**9 - 1)
    mappings = {}
    for raw, spans in meta.mappings.items():
        clipped = [(max(a, low), min(b, high), s) for a, b, s in spans]
        kept = [(a, b, s) for a, b, s in clipped if a < high and b > low]
        if kept:
            mappings[raw] = kept
    return replace(meta, start=start, end=end, mappings=mappings, symbols=tuple(s for s in meta.symbols if s in mappings), partial=tuple(s for s in meta.partial if s in mappings))


def split_by_symbol(meta: Metadata, symbol: str) -> Metadata:
    """Only what belongs to the symbol as a raw symbol; of inverse metadata no mapping stays. not_found stays."""
    only = lambda names: tuple(s for s in names if s == symbol)
    return replace(meta, symbols=only(meta.symbols), partial=only(meta.partial), mappings={r: s for r, s in meta.mappings.items() if r == symbol})


def split_by_schema(meta: Metadata, schema: str | None) -> Metadata:
    return replace(meta, schema=schema)


def interval_frame(spark: SparkSession, meta: Metadata) -> DataFrame:
    """The symbol intervals as a table."""
    return spark.createDataFrame(meta.intervals(), "instrument_id bigint, start_date date, end_date date, symbol string, ordinal int")
