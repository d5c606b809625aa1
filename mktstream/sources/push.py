"""A decoder that is given bytes as they come, for streams that are no files."""

from __future__ import annotations

import zstandard

from mktstream.functions.records import Record
from mktstream.plans.metadata import MAGIC, DecodeError, Metadata
from mktstream.plans.upgrade import POLICIES, check_policy, upgrade_columns
from mktstream.sources.codec import ZSTD_MAGIC, layout_of, runs, to_arrow
from mktstream.sources.layouts import KIND, LAYOUTS, layout_name


class PushDecoder:
    """Takes bytes with write() and gives what they hold whole with decode(): the metadata first, then records.

    has_metadata: whether the stream begins with metadata. Without, input_version (None: told from record sizes) and ts_out
    hold. compression: zstd, none, or None to sniff. Records are upgraded under the policy; what is unfinished stays in buffer().
    """

    def __init__(self, has_metadata: bool = True, ts_out: bool = False, input_version: int | None = None, upgrade_policy: str = "upgrade_to_v3", compression: str | None = None):
        if upgrade_policy not in POLICIES:
            raise ValueError(f"no such policy: {upgrade_policy}")
        self.waits, self.ts_out, self.version, self.policy = has_metadata, ts_out, input_version, upgrade_policy
        self.metadata: Metadata | None = None
        self.compression, self._zstd, self._raw, self._held = compression, None, b"", b""

    def write(self, data: bytes) -> None:
        if self.compression is None:
            self._raw += data
            if len(self._raw) < 4:
                return
            self.compression, data, self._raw = "zstd" if self._raw[:4] == ZSTD_MAGIC else "none", self._raw, b""
        if self.compression == "none":
            self._held += data
            return
        while data:  # frame by frame
            self._zstd = self._zstd or zstandard.ZstdDecompressor().decompressobj()
            self._held += self._zstd.decompress(data)
            data = self._zstd.unused_data
            if self._zstd.eof:
                self._zstd = None
            else:
                break

    def buffer(self) -> bytes:
        """What has been written and not decoded yet."""
        return self._raw + self._held

    def skip(self, n: int) -> None:
        """Leave out n bytes of what is held; fewer are an error."""
        if n > len(self._held):
            raise DecodeError(f"{len(self._held)} bytes are held, {n} should be skipped")
        self._held = self._held[n:]

    def reset(self) -> None:
        """Forget what is held; metadata and version stay."""
        self._raw = self._held = b""

    def _head(self) -> bool:
        """Take the metadata off; False if they aren't whole yet."""
        if len(self._held) < 8:
            return False
        if self._held[:3] != MAGIC:
            raise DecodeError("no metadata at the start")
        if len(self._held) < 8 + int.from_bytes(self._held[4:8], "little"):
            return False
        meta, used = Metadata.decode(self._held)
        self.version, self.ts_out, self._held, self.waits = meta.version, meta.ts_out, self._held[used:], False
        self.metadata = meta.upgraded(check_policy(self.policy, meta.version))
        return True

    def decode(self) -> list[Metadata | Record]:
        out: list[Metadata | Record] = []
        if self.waits:
            if not self._head():
                return out
            out.append(self.metadata)
        used = 0
        for offset, size, rtype, count in runs(self._held):
            used = offset + size * count
            source = layout_of(rtype, size, self.version, self.ts_out)
            if source is None:
                raise DecodeError(f"no record type {rtype:#x}")
            newer = layout_name(KIND[rtype], POLICIES[self.policy] or 1)
            to = newer if LAYOUTS[newer][0] > LAYOUTS[source][0] else source
            columns = upgrade_columns(to_arrow(self._held, offset, count, source, self.ts_out), KIND[rtype], source, to)
            rows = zip(*[v.to_pylist() for v in columns.values()])
            out += [Record.of_columns(to, dict(zip(columns, row))) for row in rows]
        self._held = self._held[used:]
        return out
