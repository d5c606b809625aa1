"""Bytes of record streams to Arrow batches and back, in NumPy."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import zstandard

from mktstream.plans.metadata import LEGACY_MAGIC, MAGIC, DecodeError, EncodeError, Metadata
from mktstream.plans.upgrade import upgrade_columns
from mktstream.sources.layouts import HEADER, KIND, LAYOUTS, dtype, fields, layout_name, text_columns

ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
CHUNK = 4 << 20
#: Text of each byte as a one-character code; NUL stands for nothing.
CHARACTERS = pa.array(["", *map(chr, range(1, 256))])


def sniff(head: bytes) -> str:
    """legacy, plain, zstd, or for records without metadata fragment, by the first twelve bytes."""
    if head[1:4] == b"\x2a\x4d\x18" and 0x50 <= head[0] <= 0x5F and head[8:12] == LEGACY_MAGIC:
        return "legacy"
    return "plain" if head[:3] == MAGIC else "zstd" if head[:4] == ZSTD_MAGIC else "fragment"


def opened(stream: io.BufferedIOBase, compression: str | None = None) -> io.BufferedReader:
    """The stream, decompressed if it is zstd (one frame or several); compression: zstd or none, else by its first bytes."""
    if compression == "zstd" or compression is None and stream.peek(4)[:4] == ZSTD_MAGIC:
        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True), CHUNK)
    return stream


def read_metadata(stream: io.BufferedIOBase) -> Metadata:
    head = stream.read(8)
    if head[:3] != MAGIC or len(head) < 8:
        raise DecodeError("no metadata at the start")
    return Metadata.decode(head + stream.read(int.from_bytes(head[4:8], "little")))[0]


class Records:
    """An open file of records: stream stands at the first one, which lies at `start` of the decompressed bytes."""

    def __init__(self, f: io.BufferedReader, options: dict):
        kind = sniff(f.peek(12)[:12])
        self.meta: Metadata | None = None
        self.compressed = kind != "plain" and kind != "fragment"
        fragment = options.get("has_metadata", "").lower() == "false"
        if kind == "legacy":
            self.meta = Metadata.decode_legacy(f.read(8 + int.from_bytes(f.peek(8)[4:8], "little"))[8:])
            self.stream, self.start = opened(f, "zstd"), 0
        else:
            self.stream, self.start = opened(f, options.get("compression")), 0
            self.compressed = self.stream is not f
            if not fragment and self.stream.peek(3)[:3] == MAGIC:
                head = self.stream.read(8)
                length = int.from_bytes(head[4:8], "little")
                self.meta, self.start = Metadata.decode(head + self.stream.read(length))
            elif options.get("has_metadata", "").lower() == "true":
                raise DecodeError("no metadata at the start")
        #: The version of the records; None: to be told from their sizes.
        self.version = max(1, self.meta.version) if self.meta else int(options["input_version"]) if "input_version" in options else None
        self.ts_out = self.meta.ts_out if self.meta else options.get("ts_out", "false").lower() == "true"


def metadata_of(path: str, options: dict | None = None) -> Metadata:
    with open(path, "rb") as f:
        meta = Records(f, options or {}).meta
    if meta is None:
        raise DecodeError(f"{path} has no metadata")
    return meta


def runs(data: bytes | memoryview) -> list[tuple[int, int, int, int]]:
    """(offset, record size, type, count) of each run of records of one type and size; an unfinished record at the end is left out."""
    view = np.frombuffer(data, np.uint8)
    out, at, n = [], 0, len(view)
    while at + 16 <= n:
        first, rtype = data[at], data[at + 1]
        size = first * 4
        if size < 16:
            raise DecodeError(f"a record of {size} bytes")
        most, count, probe = (n - at) // size, 1, 16
        if not most:
            break
        # Longer and longer stretches are compared at once, so neither one long run nor very many short ones take long.
        while count < most:
            next_ = at + count * size
            if data[next_] != first or data[next_ + 1] != rtype:
                break
            k = min(probe, most - count)
            heads = view[next_ : next_ + k * size].reshape(k, size)
            same = (heads[:, 0] == first) & (heads[:, 1] == rtype)
            if not same.all():
                count += int(same.argmin())
                break
            count, probe = count + k, probe * 2
        out.append((at, size, rtype, count))
        at += size * count
    return out


class Gathered:
    """The whole records of some bytes by type and size: where each lies, in order, and the bytes that all take."""

    def __init__(self, data: bytes):
        found = runs(data)
        self.data, self.n = data, sum(r[3] for r in found)
        self.used = found[-1][0] + found[-1][1] * found[-1][3] if found else 0
        self.offsets = np.concatenate([np.arange(o, o + size * n, size) for o, size, _, n in found]) if found else np.zeros(0, np.int64)
        counts = [r[3] for r in found]
        self.sizes, self.rtypes = np.repeat([r[1] for r in found], counts).astype(np.int64), np.repeat([r[2] for r in found], counts).astype(np.int64)

    def groups(self) -> list[tuple[int, int, np.ndarray]]:
        """(type, size, numbers of the records) of each type and size."""
        keys = self.rtypes << 16 | self.sizes
        return [(int(k >> 16), int(k & 0xFFFF), np.flatnonzero(keys == k)) for k in np.unique(keys)]

    def bytes_of(self, numbers: np.ndarray, size: int) -> bytes:
        """The records of the numbers, one behind the other."""
        at = self.offsets[numbers]
        if len(at) and at[-1] - at[0] == size * (len(at) - 1):
            return self.data[at[0] : at[-1] + size]
        return np.frombuffer(self.data, np.uint8)[at[:, None] + np.arange(size)].tobytes()


def layout_of(rtype: int, size: int, version: int | None, ts_out: bool) -> str | None:
    """The layout of a type in a version, or the one that has this size; None for unknown types."""
    kind = KIND.get(rtype)
    if kind is None:
        return None
    bare = size - 8 * ts_out
    for v in (version or 3, 3, 2, 1):
        name = layout_name(kind, v)
        if LAYOUTS[name][0] == bare:
            return name
    raise DecodeError(f"a record of type {rtype:#x} with {size} bytes")


def _column(values: np.ndarray, kind: str, strict: bool = False) -> pa.Array:
    if kind == "c":
        return pa.DictionaryArray.from_arrays(pa.array(values.view("u1")), CHARACTERS).cast(pa.string())
    if kind[0] == "s":
        return _texts(values, int(kind[1:]), strict)
    wide = {"u8": np.int16, "i8": np.int16, "u16": np.int32, "i16": np.int16, "u32": np.int64, "i32": np.int32, "u64": np.int64, "i64": np.int64}[kind]
    return pa.array(values.view("<i8") if kind == "u64" else values.astype(wide))


def _texts(values: np.ndarray, width: int, strict: bool) -> pa.Array:
    """Texts up to their first NUL. One without NUL, or that isn't UTF-8, is empty, or with strict an error."""
    grid = values.view("u1").reshape(len(values), width)
    nul = grid == 0
    ends = np.where(nul.any(axis=1), nul.argmax(axis=1), 0 if not strict else -1)
    if strict and (ends < 0).any():
        raise DecodeError("a text without its end")
    flat = grid[np.arange(width) < ends[:, None]].tobytes()
    offsets = np.concatenate([[0], np.cumsum(ends)]).astype(np.int32)
    out = pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat)])
    try:
        return out.cast(pa.string())
    except pa.ArrowInvalid:
        if strict:
            raise DecodeError("a text that isn't UTF-8") from None
        return pa.array([_valid(b) for b in out.to_pylist()], pa.string())


def _valid(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return ""


_HEADER_KINDS = {"ts_event": "u64", "rtype": "u8", "publisher_id": "u16", "instrument_id": "u32", "ts_out": "u64"}


def to_arrow(data: bytes, offset: int, count: int, name: str, ts_out: bool, strict: bool = False) -> dict[str, pa.Array]:
    """Columns of a run of records, in text order."""
    rows = np.frombuffer(data, dtype(name, ts_out), count, offset)
    kinds = dict(fields(name)) | _HEADER_KINDS
    return {c: _column(np.ascontiguousarray(rows[c]), kinds[c], strict) for c in [*text_columns(name), *(["ts_out"] if ts_out else [])]}


def from_arrow(batch: pa.RecordBatch, name: str, ts_out: bool = False) -> bytes:
    """The bytes of records whose columns are those of the layout. A null text is empty, a null number an error."""
    kind = dtype(name, ts_out)
    rows = np.zeros(batch.num_rows, kind)
    rows["length"] = kind.itemsize // 4
    kinds = dict(fields(name)) | _HEADER_KINDS
    for c in [*text_columns(name), *(["ts_out"] if ts_out else [])]:
        values = batch.column(batch.schema.names.index(c))
        if kinds[c] == "c" or kinds[c][0] == "s":
            known = values.fill_null("").dictionary_encode()
            texts = [t.encode("latin-1" if kinds[c] == "c" else "utf-8") for t in known.dictionary.to_pylist()]
            width = 1 if kinds[c] == "c" else int(kinds[c][1:]) - 1
            if any(len(t) > width for t in texts):
                raise EncodeError(f"{c} doesn't fit {width} bytes")
            rows[c] = np.array(texts or [b""], kind[c])[np.asarray(known.indices)] if len(values) else []
        elif values.null_count:
            raise EncodeError(f"{c} is null")
        else:
            rows[c] = np.asarray(values).astype(np.int64).astype(kind[c])
    return rows.tobytes()


def mixed_batch(records: Gathered, layouts: dict[int, tuple[str, str]], ts_out: bool, schema: pa.Schema, strict: bool = False) -> pa.RecordBatch:
    """Records of several types as rows of a table of mixed types (layouts.mixed_schema), in their order.

    layouts: by number of a group of records.groups() the layout they have and the one they get.
    """
    heads, places, structs = {c: [] for c in (*HEADER, "index_ts", *(["ts_out"] if ts_out else []))}, [], {}
    for g, (rtype, size, numbers) in enumerate(records.groups()):
        if g not in layouts:
            continue
        source, to = layouts[g]
        columns = upgrade_columns(to_arrow(records.bytes_of(numbers, size), 0, len(numbers), source, ts_out, strict), KIND[rtype], source, to)
        columns["index_ts"] = columns.get("ts_recv", columns["ts_event"])
        for c, parts in heads.items():
            parts.append(columns[c].cast(schema.field(c).type))
        places.append(numbers)
        own = schema.field(KIND[rtype]).type
        structs.setdefault(KIND[rtype], []).append((numbers, pa.StructArray.from_arrays([columns[f.name] for f in own], fields=list(own))))
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    order, n = np.argsort(place, kind="stable"), len(place)
    row_of = np.full(records.n, -1)
    row_of[place[order]] = np.arange(n)
    out = {c: pa.concat_arrays(parts).take(pa.array(order)) if parts else pa.nulls(0, schema.field(c).type) for c, parts in heads.items()}
    for kind, parts in structs.items():
        values = pa.concat_arrays([s for _, s in parts])
        at = np.full(n, -1)
        at[row_of[np.concatenate([numbers for numbers, _ in parts])]] = np.arange(len(values))
        out[kind] = values.take(pa.array(at, mask=at < 0))
    return pa.RecordBatch.from_arrays([out[f.name] if f.name in out else pa.nulls(n, f.type) for f in schema], schema=schema)


def mixed_bytes(batch: pa.RecordBatch, version: int, ts_out: bool) -> bytes:
    """The bytes of rows of a table of mixed types, in their order."""
    rtypes = np.asarray(batch.column("rtype")).astype(np.int64)
    kinds = [KIND[int(r)] for r in np.unique(rtypes)]
    sizes, made = np.zeros(len(rtypes), np.int64), []
    for kind in dict.fromkeys(kinds):
        numbers = np.flatnonzero(np.isin(rtypes, [r for r, k in KIND.items() if k == kind]))
        rows = batch.take(pa.array(numbers))
        own = rows.column(kind)
        columns = {c: rows.column(c) for c in (*HEADER, *(["ts_out"] if ts_out else []))} | {f.name: v for f, v in zip(own.type, own.flatten())}
        name = layout_name(kind, version)
        data = from_arrow(pa.RecordBatch.from_pydict(columns), name, ts_out)
        size = LAYOUTS[name][0] + 8 * ts_out
        sizes[numbers] = size
        made.append((numbers, size, np.frombuffer(data, np.uint8).reshape(-1, size)))
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for numbers, size, data in made:
        out[starts[numbers][:, None] + np.arange(size)] = data
    return out.tobytes()


def compressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3, write_checksum=True).compress(data)


def update_range(stream: io.BufferedRandom, version: int, start: int, end: int | None, limit: int | None) -> None:
    """Overwrite start, end and limit of an open, uncompressed file; nothing else moves."""
    stream.seek(26)
    stream.write(start.to_bytes(8, "little") + (0xFFFFFFFFFFFFFFFF if end is None else end).to_bytes(8, "little") + (limit or 0).to_bytes(8, "little"))
