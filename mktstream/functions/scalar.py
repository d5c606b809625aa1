"""Column expressions for prices, times, flags, enumerations and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mktstream.functions import values as V

NS = 1_000_000_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fmt_px(px: Column | str) -> Column:
    """A 1e-9 price as text with nine decimals; the undefined price by its name."""
    exact = (_c(px).cast("decimal(20,0)") * F.lit("0.000000001").cast("decimal(10,9)")).cast("decimal(29,9)")
    return F.when(_c(px) == V.UNDEF_PRICE, F.lit("UNDEF_PRICE")).otherwise(exact.cast("string"))


def fmt_px_precision(px: Column | str, precision: int, compat: bool = False) -> Column:
    """A price cut (not rounded) to 1 to 9 decimals; 0 gives whole units, or with compat the raw number."""
    p = _c(px)
    if precision == 0 and compat:
        return F.when(p == V.UNDEF_PRICE, F.lit("UNDEF_PRICE")).otherwise(p.cast("string"))
    full = fmt_px(p)
    cut = F.length(full) - (9 - precision) - (1 if precision == 0 else 0)
    return F.when(p == V.UNDEF_PRICE, full).otherwise(F.substring(full, F.lit(1), cut))


def px_to_double(px: Column | str) -> Column:
    return F.when(_c(px) == V.UNDEF_PRICE, F.lit(float("nan"))).otherwise(_c(px) / F.lit(float(NS)))


def px_to_decimal(px: Column | str) -> Column:
    return F.when(_c(px) != V.UNDEF_PRICE, (_c(px).cast("decimal(20,0)") * F.lit("0.000000001").cast("decimal(10,9)")).cast("decimal(20,9)"))


def unsigned(bits: Column | str) -> Column:
    """The unsigned number of 64 bits kept in a long."""
    d = _c(bits).cast("decimal(20,0)")
    return F.when(_c(bits) < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def unsigned_order(bits: Column | str) -> Column:
    """A long that sorts as the unsigned number does."""
    return _c(bits).bitwiseXOR(F.lit(-(1 << 63)))


def is_undef_ts(ts: Column | str) -> Column:
    return _c(ts) == -1


def ts_to_timestamp(ts: Column | str) -> Column:
    """UTC time with microseconds; undefined gives null, 0 is 1970."""
    micros = ((_c(ts) - F.pmod(_c(ts), F.lit(1000))).cast("decimal(20,0)") / 1000).cast("long")
    return F.when(~is_undef_ts(ts), F.timestamp_micros(micros))


def index_date(ts: Column | str) -> Column:
    """UTC date of a time; null if undefined."""
    return F.when(~is_undef_ts(ts), F.date_from_unix_date(((_c(ts) - F.pmod(_c(ts), F.lit(86400 * NS))).cast("decimal(20,0)") / (86400 * NS)).cast("int")))


def fmt_ts(ts: Column | str) -> Column:
    """YYYY-MM-DDTHH:MM:SS.nnnnnnnnnZ; 0 gives empty text."""
    t = _c(ts)
    nano = F.pmod(t, F.lit(NS))
    second = F.timestamp_seconds(((t - nano).cast("decimal(20,0)") / NS).cast("long"))
    return F.when(t == 0, F.lit("")).otherwise(F.concat(F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(nano.cast("string"), 9, "0"), F.lit("Z")))


def pretty_ts(ts: Column | str) -> Column:
    """fmt_ts, but null for 0 and undefined."""
    return F.when((_c(ts) != 0) & ~is_undef_ts(ts), fmt_ts(ts))


def date_int(d: Column | str) -> Column:
    return F.date_format(_c(d), "yyyyMMdd").cast("int")


def date_of_int(n: Column | str) -> Column:
    return F.to_date(_c(n).cast("string"), "yyyyMMdd")


def delta_interval(ns: Column | str) -> Column:
    """A nanosecond difference as an interval of microseconds (cut toward zero)."""
    micros = F.when(_c(ns) < 0, -F.floor(-_c(ns) / F.lit(1000))).otherwise(F.floor(_c(ns) / F.lit(1000)))
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros.cast("decimal(20,6)") / 1000000).cast("decimal(18,6)"))


def escaped_char(c: Column | str) -> Column:
    """A one-character code for text: NUL is empty, control characters and bytes beyond ASCII are escaped."""
    x = _c(c)
    code = F.ascii(x)
    named = F.when(x == "\t", "\\t").when(x == "\n", "\\n").when(x == "\r", "\\r").when(x == "'", "\\'").when(x == '"', '\\"').when(x == "\\", "\\\\")
    return F.when((x == "") | (x == "\0"), F.lit("")).otherwise(F.coalesce(named, F.when((code >= 0x20) & (code < 0x7F), x), F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(code)), 2, "0"))))


def has_flag(flags: Column | str, name: str) -> Column:
    return _c(flags).bitwiseAND(F.lit(V.FLAGS[name])) != 0


def set_flag(flags: Column | str, name: str) -> Column:
    return _c(flags).bitwiseOR(F.lit(V.FLAGS[name]))


def clear_flags(flags: Column | str) -> Column:
    """No flag set."""
    return (_c(flags) * 0).cast("short")


def any_flag(flags: Column | str) -> Column:
    return _c(flags) != 0


def fmt_flags(flags: Column | str) -> Column:
    """`LAST | TOB (192)`; the number alone if none is set."""
    names = [F.when(has_flag(flags, n), F.lit(n)) for n in V.FLAGS]
    text = F.concat_ws(" | ", *names)
    return F.when(text == "", _c(flags).cast("string")).otherwise(F.concat(text, F.lit(" ("), _c(flags).cast("string"), F.lit(")")))


def lookup(x: Column | str, mapping: dict, strict: bool = False) -> Column:
    """The mapping's value; without one null, or with strict an error."""
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    found = F.try_element_at(table, _c(x))
    if not strict:
        return found
    return F.when(_c(x).isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no such value: "), _c(x).cast("string"))))


def schema_of_rtype(rtype: Column | str) -> Column:
    return lookup(_c(rtype).cast("int"), V.RTYPE_SCHEMA)


def rtype_of_schema(schema: Column | str) -> Column:
    return lookup(schema, V.SCHEMA_RTYPE)


def rtype_name(rtype: Column | str) -> Column:
    return lookup(_c(rtype).cast("int"), {c: n for n, c in V.RTYPES.items()})


def interval_seconds(rtype: Column | str) -> Column:
    return lookup(rtype_name(rtype), V.INTERVAL_SECONDS)


def parse_stype(name: Column | str) -> Column:
    return lookup(name, V.STYPES | {a: V.STYPES[n] for a, n in V.STYPE_ALIASES.items()}, strict=True)


def tri_state(c: Column | str) -> Column:
    """Y and N as a boolean, else null."""
    return F.when(_c(c) == "Y", True).when(_c(c) == "N", False)


def of_tri_state(b: Column | str) -> Column:
    return F.when(_c(b), "Y").when(~_c(b), "N").otherwise("~")


def is_option(c: Column | str) -> Column:
    return _c(c).isin("C", "P", "T")


def is_future(c: Column | str) -> Column:
    return _c(c).isin("F", "S")


def is_spread(c: Column | str) -> Column:
    return _c(c).isin("M", "S", "T")


def is_heartbeat(code: Column | str, msg: Column | str) -> Column:
    """By the code, or where that is none of SYSTEM_CODES by the text."""
    return F.when(_c(code).isin(*V.SYSTEM_CODES), _c(code) == 0).otherwise(_c(msg) == "Heartbeat")


def publisher_part(publisher_id: Column | str, part: str) -> Column:
    """Dataset or venue of a publisher number."""
    table = {i: p.rpartition(".")[0 if part == "dataset" else 2] for i, p in enumerate(V.PUBLISHERS, 1)}
    return lookup(_c(publisher_id).cast("int"), table)


def publisher_of(dataset: Column | str, venue: Column | str) -> Column:
    return lookup(F.concat_ws(".", _c(dataset), _c(venue)), {p: i for i, p in enumerate(V.PUBLISHERS, 1)}, strict=True)


def publishers_of(dataset: Column | str) -> Column:
    """The numbers of a dataset's publishers, ascending; null for an unknown dataset."""
    table: dict[str, list[int]] = {d: [] for d in V.DATASETS}
    for i, p in enumerate(V.PUBLISHERS, 1):
        table[p.rpartition(".")[0]].append(i)
    return F.try_element_at(F.create_map(*[x for d, ids in table.items() for x in (F.lit(d), F.array(*map(F.lit, ids)).cast("array<int>"))]), _c(dataset))


def enum_name(code: Column | str, enum: str, strict: bool = False) -> Column:
    """The name of a code of one of functions.enums.ENUMS; unknown codes give null, or with strict an error."""
    from mktstream.functions.enums import ENUMS

    return lookup(code, ENUMS[enum], strict)


def enum_code(name: Column | str, enum: str, strict: bool = False) -> Column:
    """The code of a name, which is compared in lower case with - for _."""
    from mktstream.functions.enums import ENUMS, plain

    return lookup(F.translate(F.lower(_c(name)), "_", "-"), {plain(n): c for c, n in ENUMS[enum].items()}, strict)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
