"""CSV, TSV and JSON lines of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mktstream.functions.scalar import escaped_char, fmt_px, pretty_ts, unsigned
from mktstream.sources.layouts import HEADER, KINDS, fields, layout_name, text_columns

_TIMES = ("ts_event", "ts_recv", "ts_ref", "ts_out", "expiration", "activation", "start_ts", "end_ts", "auction_time")


def kinds_of(name: str) -> dict[str, str]:
    return dict(fields(name)) | {"ts_event": "u64", "rtype": "u8", "publisher_id": "u16", "instrument_id": "u32", "ts_out": "u64"}


def is_price(column: str, kind: str) -> bool:
    """Fixed-point prices are signed 64-bit numbers, but for the quantity of statistics."""
    return kind == "i64" and column != "quantity"


def field_text(column: str, kind: str, pretty_px: bool = False, pretty_ts_: bool = False) -> Column:
    """One field as CSV has it, before quoting; null stands for an empty field."""
    c = F.col(column)
    if column in _TIMES:
        return F.coalesce(pretty_ts(c), F.lit("")) if pretty_ts_ else unsigned(c).cast("string")
    if is_price(column, kind) and pretty_px:
        return F.when(c == 9223372036854775807, F.lit("")).otherwise(fmt_px(c))
    if kind == "c":
        return escaped_char(c)
    return unsigned(c).cast("string") if kind == "u64" else c.cast("string")


def quoted(text: Column, sep: str) -> Column:
    """A field in quotes, those inside doubled, where it holds the separator, a quote or an end of line."""
    needs = text.contains(sep) | text.contains('"') | text.contains("\n") | text.contains("\r")
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def header(name: str, ts_out: bool = False, symbol: bool = False, sep: str = ",") -> str:
    return sep.join([*text_columns(name), *(["ts_out"] if ts_out else []), *(["symbol"] if symbol else [])])


def csv_line(name: str, sep: str = ",", pretty_px: bool = False, pretty_ts_: bool = False, ts_out: bool = False, symbol: bool = False) -> Column:
    """The line of a record; symbol: a last field, empty where it is null."""
    kinds = kinds_of(name)
    text = lambda c: F.coalesce(field_text(c, kinds[c], pretty_px, pretty_ts_), F.lit(""))
    parts = [quoted(text(c), sep) if kinds[c][0] in "cs" else text(c) for c in [*text_columns(name), *(["ts_out"] if ts_out else [])]]
    if symbol:
        parts.append(quoted(F.coalesce("symbol", F.lit("")), sep))
    return F.concat_ws(sep, *parts)


def csv_lines(records: DataFrame, name: str, sep: str = ",", pretty_px: bool = False, pretty_ts_: bool = False, ts_out: bool = False, symbol: bool = False) -> DataFrame:
    """One column `value` with the line of each record."""
    return records.select(csv_line(name, sep, pretty_px, pretty_ts_, ts_out, symbol).alias("value"))


def json_value(column: str, kind: str, pretty_px: bool, pretty_ts_: bool, of: str = "") -> Column:
    """One value: 64-bit numbers, prices and times as strings, smaller numbers bare, NUL null. of: where the column lies.

    Characters beyond printable ASCII are escaped as in CSV, so those beyond ASCII (as \\xff) are no JSON escapes.
    """
    c = F.col(of + column)
    string = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    null = F.lit("null")
    if column in _TIMES:
        return F.coalesce(string(pretty_ts(c)), null) if pretty_ts_ else string(unsigned(c).cast("string"))
    if is_price(column, kind):
        return F.when(c == 9223372036854775807, null).otherwise(string(fmt_px(c))) if pretty_px else string(c.cast("string"))
    if kind == "c":
        return F.when(c.isNull() | (c == "") | (c == "\0"), null).otherwise(string(F.when(c == "'", c).otherwise(escaped_char(c))))
    if kind[0] == "s":
        text = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))
        return text.substr(F.lit(6), F.length(text) - 6)
    return string((unsigned(c) if kind == "u64" else c).cast("string")) if kind in ("u64", "i64") else c.cast("string")


def json_object(name: str, pretty_px: bool = False, pretty_ts_: bool = False, ts_out: bool = False, symbol: bool = False, of: str = "") -> Column:
    """A JSON object of a record's columns, its header under hd and price levels under levels. of: where columns beside the header lie."""
    kinds = kinds_of(name)
    pair = lambda key, value: F.concat(F.lit(f'"{key}":'), value)
    value = lambda c: json_value(c, kinds[c], pretty_px, pretty_ts_, "" if c in HEADER else of)
    plain = [c for c in text_columns(name) if c not in HEADER]
    level = [c for c in plain if c[-3:-2] == "_" and c[-2:].isdigit() and c[:3] in ("bid", "ask")]
    head = F.concat(F.lit('"hd":{'), F.concat_ws(",", *[pair(c, value(c)) for c in HEADER]), F.lit("}"))
    parts = []
    for c in plain:
        if c in level:
            continue
        parts.append(pair(c, value(c)))
        if c == "ts_recv":
            parts.append(head)
    if "ts_recv" not in plain:
        parts.insert(0, head)
    if level:
        rows = [F.concat(F.lit("{"), F.concat_ws(",", *[pair(c[:-3], value(c)) for c in level if c.endswith(f"_{i:02}")]), F.lit("}")) for i in range(len(level) // 6)]
        parts.append(F.concat(F.lit('"levels":['), F.concat_ws(",", *rows), F.lit("]")))
    if ts_out:
        parts.append(pair("ts_out", json_value("ts_out", "u64", pretty_px, pretty_ts_)))
    if symbol:
        text = F.to_json(F.struct(F.col("symbol").alias("v")))
        parts.append(pair("symbol", F.when(F.col("symbol").isNull(), F.lit("null")).otherwise(text.substr(F.lit(6), F.length(text) - 6))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_lines(records: DataFrame, name: str, pretty_px: bool = False, pretty_ts_: bool = False, ts_out: bool = False, symbol: bool = False) -> DataFrame:
    """One column `value` with a JSON object for each record."""
    return records.select(json_object(name, pretty_px, pretty_ts_, ts_out, symbol).alias("value"))


def mixed_json(version: int = 3, pretty_px: bool = False, pretty_ts_: bool = False, ts_out: bool = False, symbol: bool = False) -> Column:
    """json_object() of a row of a table of mixed types, by the kind of its record."""
    return F.coalesce(*[F.when(F.col(kind).isNotNull(), json_object(layout_name(kind, version), pretty_px, pretty_ts_, ts_out, symbol, f"{kind}.")) for kind in KINDS])


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """Lines as text files; the records' order should be set before."""
    lines.write.mode(mode).option("compression", compression or "none").text(path)
