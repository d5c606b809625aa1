"""Record layouts: fields in file order, and columns in text order, for each record type and version."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from mktstream.functions.values import RTYPES, SCHEMA_RTYPE

HEADER = "ts_event rtype publisher_id instrument_id".split()

# Size in bytes with the header, fields after the header (u8 to i64 numbers, c one character,
# sN text, xN reserved, quote and cquote price levels), and the order of text columns.
LAYOUTS = {
    "mbo": (
        56,
        """
        order_id:u64 price:i64 size:u32 flags:u8 channel_id:u8 action:c side:c ts_recv:u64 ts_in_delta:i32 sequence:u32
        """,
        """
        ts_recv HDR action side price size channel_id order_id flags ts_in_delta sequence
        """,
    ),
    "trade": (
        48,
        """
        price:i64 size:u32 action:c side:c flags:u8 depth:u8 ts_recv:u64 ts_in_delta:i32 sequence:u32
        """,
        """
        ts_recv HDR action side depth price size flags ts_in_delta sequence
        """,
    ),
    "mbp1": (
        80,
        """
        price:i64 size:u32 action:c side:c flags:u8 depth:u8 ts_recv:u64 ts_in_delta:i32 sequence:u32 levels:quote*1
        """,
        """
        ts_recv HDR action side depth price size flags ts_in_delta sequence bid_px_00 ask_px_00 bid_sz_00 ask_sz_00 bid_ct_00 ask_ct_00
        """,
    ),
    "mbp10": (
        368,
        """
        price:i64 size:u32 action:c side:c flags:u8 depth:u8 ts_recv:u64 ts_in_delta:i32 sequence:u32 levels:quote*10
        """,
        """
        ts_recv HDR action side depth price size flags ts_in_delta sequence LEVELS
        """,
    ),
    "bbo": (
        80,
        """
        price:i64 size:u32 _reserved1:u8 side:c flags:u8 _reserved2:u8 ts_recv:u64 _reserved3:x4 sequence:u32 levels:quote*1
        """,
        """
        ts_recv HDR side price size flags sequence bid_px_00 ask_px_00 bid_sz_00 ask_sz_00 bid_ct_00 ask_ct_00
        """,
    ),
    "cmbp1": (
        80,
        """
        price:i64 size:u32 action:c side:c flags:u8 _reserved1:x1 ts_recv:u64 ts_in_delta:i32 _reserved2:x4 levels:cquote*1
        """,
        """
        ts_recv HDR action side price size flags ts_in_delta bid_px_00 ask_px_00 bid_sz_00 ask_sz_00 bid_pb_00 ask_pb_00
        """,
    ),
    "cbbo": (
        80,
        """
        price:i64 size:u32 _reserved1:u8 side:c flags:u8 _reserved2:u8 ts_recv:u64 _reserved3:x8 levels:cquote*1
        """,
        """
        ts_recv HDR side price size flags bid_px_00 ask_px_00 bid_sz_00 ask_sz_00 bid_pb_00 ask_pb_00
        """,
    ),
    "ohlcv": (
        56,
        """
        open:i64 high:i64 low:i64 close:i64 volume:u64
        """,
        """
        HDR open high low close volume
        """,
    ),
    "status": (
        40,
        """
        ts_recv:u64 action:u16 reason:u16 trading_event:u16 is_trading:c is_quoting:c is_short_sell_restricted:c _reserved:x7
        """,
        """
        ts_recv HDR action reason trading_event is_trading is_quoting is_short_sell_restricted
        """,
    ),
    "definition": (
        520,
        """
        ts_recv:u64 min_price_increment:i64 display_factor:i64 expiration:u64 activation:u64 high_limit_price:i64 low_limit_price:i64 max_price_variation:i64
        unit_of_measure_qty:i64 min_price_increment_amount:i64 price_ratio:i64 strike_price:i64 raw_instrument_id:u64 leg_price:i64 leg_delta:i64
        inst_attrib_value:i32 underlying_id:u32 market_depth_implied:i32 market_depth:i32 market_segment_id:u32 max_trade_vol:u32 min_lot_size:i32
        min_lot_size_block:i32 min_lot_size_round_lot:i32 min_trade_vol:u32 contract_multiplier:i32 decay_quantity:i32 original_contract_size:i32
        leg_instrument_id:u32 leg_ratio_price_numerator:i32 leg_ratio_price_denominator:i32 leg_ratio_qty_numerator:i32 leg_ratio_qty_denominator:i32
        leg_underlying_id:u32 appl_id:i16 maturity_year:u16 decay_start_date:u16 channel_id:u16 leg_count:u16 leg_index:u16 currency:s4 settl_currency:s4
        secsubtype:s6 raw_symbol:s71 group:s21 exchange:s5 asset:s11 cfi:s7 security_type:s7 unit_of_measure:s31 underlying:s21 strike_price_currency:s4
        leg_raw_symbol:s71 instrument_class:c match_algorithm:c main_fraction:u8 price_display_format:u8 sub_fraction:u8 underlying_product:u8
        security_update_action:c maturity_month:u8 maturity_day:u8 maturity_week:u8 user_defined_instrument:c contract_multiplier_unit:i8
        flow_schedule_type:i8 tick_rule:u8 leg_instrument_class:c leg_side:c _reserved:x17
        """,
        """
        ts_recv HDR raw_symbol security_update_action instrument_class min_price_increment display_factor expiration activation high_limit_price
        low_limit_price max_price_variation unit_of_measure_qty min_price_increment_amount price_ratio inst_attrib_value underlying_id raw_instrument_id
        market_depth_implied market_depth market_segment_id max_trade_vol min_lot_size min_lot_size_block min_lot_size_round_lot min_trade_vol
        contract_multiplier decay_quantity original_contract_size appl_id maturity_year decay_start_date channel_id currency settl_currency secsubtype group
        exchange asset cfi security_type unit_of_measure underlying strike_price_currency strike_price match_algorithm main_fraction price_display_format
        sub_fraction underlying_product maturity_month maturity_day maturity_week user_defined_instrument contract_multiplier_unit flow_schedule_type
        tick_rule leg_count leg_index leg_instrument_id leg_raw_symbol leg_instrument_class leg_side leg_price leg_delta leg_ratio_price_numerator
        leg_ratio_price_denominator leg_ratio_qty_numerator leg_ratio_qty_denominator leg_underlying_id
        """,
    ),
    "imbalance": (
        112,
        """
        ts_recv:u64 ref_price:i64 auction_time:u64 cont_book_clr_price:i64 auct_interest_clr_price:i64 ssr_filling_price:i64 ind_match_price:i64
        upper_collar:i64 lower_collar:i64 paired_qty:u32 total_imbalance_qty:u32 market_imbalance_qty:u32 unpaired_qty:u32 auction_type:c side:c
        auction_status:u8 freeze_status:u8 num_extensions:u8 unpaired_side:c significant_imbalance:c _reserved:x1
        """,
        """
        ts_recv HDR ref_price auction_time cont_book_clr_price auct_interest_clr_price ssr_filling_price ind_match_price upper_collar lower_collar paired_qty
        total_imbalance_qty market_imbalance_qty unpaired_qty auction_type side auction_status freeze_status num_extensions unpaired_side
        significant_imbalance
        """,
    ),
    "statistics": (
        80,
        """
        ts_recv:u64 ts_ref:u64 price:i64 quantity:i64 sequence:u32 ts_in_delta:i32 stat_type:u16 channel_id:u16 update_action:u8 stat_flags:u8 _reserved:x18
        """,
        """
        ts_recv HDR ts_ref price quantity sequence ts_in_delta stat_type channel_id update_action stat_flags
        """,
    ),
    "error": (
        320,
        """
        err:s302 code:u8 is_last:u8
        """,
        """
        HDR err code is_last
        """,
    ),
    "symbol_mapping": (
        176,
        """
        stype_in:u8 stype_in_symbol:s71 stype_out:u8 stype_out_symbol:s71 start_ts:u64 end_ts:u64
        """,
        """
        HDR stype_in stype_in_symbol stype_out stype_out_symbol start_ts end_ts
        """,
    ),
    "system": (
        320,
        """
        msg:s303 code:u8
        """,
        """
        HDR msg code
        """,
    ),
    "definition_v1": (
        360,
        """
        ts_recv:u64 min_price_increment:i64 display_factor:i64 expiration:u64 activation:u64 high_limit_price:i64 low_limit_price:i64 max_price_variation:i64
        trading_reference_price:i64 unit_of_measure_qty:i64 min_price_increment_amount:i64 price_ratio:i64 inst_attrib_value:i32 underlying_id:u32
        raw_instrument_id:u32 market_depth_implied:i32 market_depth:i32 market_segment_id:u32 max_trade_vol:u32 min_lot_size:i32 min_lot_size_block:i32
        min_lot_size_round_lot:i32 min_trade_vol:u32 _reserved2:x4 contract_multiplier:i32 decay_quantity:i32 original_contract_size:i32 _reserved3:x4
        trading_reference_date:u16 appl_id:i16 maturity_year:u16 decay_start_date:u16 channel_id:u16 currency:s4 settl_currency:s4 secsubtype:s6
        raw_symbol:s22 group:s21 exchange:s5 asset:s7 cfi:s7 security_type:s7 unit_of_measure:s31 underlying:s21 strike_price_currency:s4 instrument_class:c
        _reserved4:x2 strike_price:i64 _reserved5:x6 match_algorithm:c md_security_trading_status:u8 main_fraction:u8 price_display_format:u8
        settl_price_type:u8 sub_fraction:u8 underlying_product:u8 security_update_action:c maturity_month:u8 maturity_day:u8 maturity_week:u8
        user_defined_instrument:c contract_multiplier_unit:i8 flow_schedule_type:i8 tick_rule:u8 _dummy:x3
        """,
        """
        ts_recv HDR raw_symbol security_update_action instrument_class min_price_increment display_factor expiration activation high_limit_price
        low_limit_price max_price_variation trading_reference_price unit_of_measure_qty min_price_increment_amount price_ratio inst_attrib_value underlying_id
        raw_instrument_id market_depth_implied market_depth market_segment_id max_trade_vol min_lot_size min_lot_size_block min_lot_size_round_lot
        min_trade_vol contract_multiplier decay_quantity original_contract_size trading_reference_date appl_id maturity_year decay_start_date channel_id
        currency settl_currency secsubtype group exchange asset cfi security_type unit_of_measure underlying strike_price_currency strike_price
        match_algorithm md_security_trading_status main_fraction price_display_format settl_price_type sub_fraction underlying_product maturity_month
        maturity_day maturity_week user_defined_instrument contract_multiplier_unit flow_schedule_type tick_rule
        """,
    ),
    "definition_v2": (
        400,
        """
        ts_recv:u64 min_price_increment:i64 display_factor:i64 expiration:u64 activation:u64 high_limit_price:i64 low_limit_price:i64 max_price_variation:i64
        trading_reference_price:i64 unit_of_measure_qty:i64 min_price_increment_amount:i64 price_ratio:i64 strike_price:i64 inst_attrib_value:i32
        underlying_id:u32 raw_instrument_id:u32 market_depth_implied:i32 market_depth:i32 market_segment_id:u32 max_trade_vol:u32 min_lot_size:i32
        min_lot_size_block:i32 min_lot_size_round_lot:i32 min_trade_vol:u32 contract_multiplier:i32 decay_quantity:i32 original_contract_size:i32
        trading_reference_date:u16 appl_id:i16 maturity_year:u16 decay_start_date:u16 channel_id:u16 currency:s4 settl_currency:s4 secsubtype:s6
        raw_symbol:s71 group:s21 exchange:s5 asset:s7 cfi:s7 security_type:s7 unit_of_measure:s31 underlying:s21 strike_price_currency:s4
        instrument_class:c match_algorithm:c md_security_trading_status:u8 main_fraction:u8 price_display_format:u8 settl_price_type:u8 sub_fraction:u8
        underlying_product:u8 security_update_action:c maturity_month:u8 maturity_day:u8 maturity_week:u8 user_defined_instrument:c
        contract_multiplier_unit:i8 flow_schedule_type:i8 tick_rule:u8 _reserved:x10
        """,
        """
        ts_recv HDR raw_symbol security_update_action instrument_class min_price_increment display_factor expiration activation high_limit_price
        low_limit_price max_price_variation trading_reference_price unit_of_measure_qty min_price_increment_amount price_ratio inst_attrib_value underlying_id
        raw_instrument_id market_depth_implied market_depth market_segment_id max_trade_vol min_lot_size min_lot_size_block min_lot_size_round_lot
        min_trade_vol contract_multiplier decay_quantity original_contract_size trading_reference_date appl_id maturity_year decay_start_date channel_id
        currency settl_currency secsubtype group exchange asset cfi security_type unit_of_measure underlying strike_price_currency strike_price
        match_algorithm md_security_trading_status main_fraction price_display_format settl_price_type sub_fraction underlying_product maturity_month
        maturity_day maturity_week user_defined_instrument contract_multiplier_unit flow_schedule_type tick_rule
        """,
    ),
    "statistics_v1": (
        64,
        """
        ts_recv:u64 ts_ref:u64 price:i64 quantity:i32 sequence:u32 ts_in_delta:i32 stat_type:u16 channel_id:u16 update_action:u8 stat_flags:u8 _reserved:x6
        """,
        """
        ts_recv HDR ts_ref price quantity sequence ts_in_delta stat_type channel_id update_action stat_flags
        """,
    ),
    "error_v1": (
        80,
        """
        err:s64
        """,
        """
        HDR err
        """,
    ),
    "symbol_mapping_v1": (
        80,
        """
        stype_in_symbol:s22 stype_out_symbol:s22 _dummy:x4 start_ts:u64 end_ts:u64
        """,
        """
        HDR stype_in_symbol stype_out_symbol start_ts end_ts
        """,
    ),
    "system_v1": (
        80,
        """
        msg:s64
        """,
        """
        HDR msg
        """,
    ),
}

_QUOTE = "bid_px:i64 ask_px:i64 bid_sz:u32 ask_sz:u32 bid_ct:u32 ask_ct:u32"
_CQUOTE = "bid_px:i64 ask_px:i64 bid_sz:u32 ask_sz:u32 bid_pb:u16 r1:x2 ask_pb:u16 r2:x2"
_NUMBERS = {"u8": "u1", "i8": "i1", "u16": "<u2", "i16": "<i2", "u32": "<u4", "i32": "<i4", "u64": "<u8", "i64": "<i8"}
_TYPES = {"u8": T.ShortType(), "i8": T.ShortType(), "u16": T.IntegerType(), "i16": T.ShortType(), "u32": T.LongType(), "i32": T.IntegerType(), "u64": T.LongType(), "i64": T.LongType()}

#: Record kind of each record type.
KIND = {
    RTYPES["mbp-0"]: "trade", RTYPES["mbp-1"]: "mbp1", RTYPES["mbp-10"]: "mbp10", RTYPES["status"]: "status", RTYPES["instrument-def"]: "definition",
    RTYPES["imbalance"]: "imbalance", RTYPES["error"]: "error", RTYPES["symbol-mapping"]: "symbol_mapping", RTYPES["system"]: "system",
    RTYPES["statistics"]: "statistics", RTYPES["mbo"]: "mbo", RTYPES["cmbp-1"]: "cmbp1", RTYPES["tcbbo"]: "cmbp1", RTYPES["cbbo-1s"]: "cbbo",
    RTYPES["cbbo-1m"]: "cbbo", RTYPES["bbo-1s"]: "bbo", RTYPES["bbo-1m"]: "bbo",
} | {code: "ohlcv" for name, code in RTYPES.items() if name.startswith("ohlcv")}

#: The first version in which a kind has the layout of its plain name.
_SINCE = {"definition": 3, "statistics": 3, "error": 2, "symbol_mapping": 2, "system": 2}


def layout_name(kind: str, version: int) -> str:
    if version >= _SINCE.get(kind, 1):
        return kind
    return "definition_v2" if kind == "definition" and version == 2 else f"{kind}_v1"


def fields(name: str) -> list[tuple[str, str]]:
    """(field, type) after the header, price levels laid flat with the level as a suffix."""
    out = []
    for part in LAYOUTS[name][1].split():
        field, kind = part.split(":")
        if "quote" in kind:
            count = int(kind.split("*")[1])
            for i in range(count):
                out += [(f"{f}_{i:02}", k) for f, k in (x.split(":") for x in (_CQUOTE if kind[0] == "c" else _QUOTE).split())]
        else:
            out.append((field, kind))
    return out


def dtype(name: str, ts_out: bool = False) -> np.dtype:
    """The bytes of one record."""
    parts = [("length", "u1"), ("rtype", "u1"), ("publisher_id", "<u2"), ("instrument_id", "<u4"), ("ts_event", "<u8")]
    for field, kind in fields(name):
        parts.append((field, _NUMBERS.get(kind) or ("S1" if kind == "c" else f"{'S' if kind[0] == 's' else 'V'}{kind[1:]}")))
    d = np.dtype(parts)
    if d.itemsize != LAYOUTS[name][0]:
        raise ValueError(f"{name}: {d.itemsize} bytes")
    return np.dtype(parts + [("ts_out", "<u8")]) if ts_out else d


def text_columns(name: str) -> list[str]:
    out: list[str] = []
    for column in LAYOUTS[name][2].split():
        out += HEADER if column == "HDR" else [f"{f.split(':')[0]}_{i:02}" for i in range(10) for f in _QUOTE.split()] if column == "LEVELS" else [column]
    return out


def spark_schema(name: str, ts_out: bool = False) -> T.StructType:
    """Columns in text order. Unsigned 64-bit numbers are kept as their bits in a long."""
    kinds = dict(fields(name)) | {"ts_event": "u64", "rtype": "u8", "publisher_id": "u16", "instrument_id": "u32"}
    out = T.StructType()
    for c in text_columns(name):
        out.add(c, _TYPES.get(kinds[c], T.StringType()), True, {"kind": kinds[c]})
    return out.add("ts_out", T.LongType()) if ts_out else out


def arrow_type(kind: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}[kind.simpleString()]


#: Records that belong to no schema can be asked for by the name of their type.
CONTROL_RTYPE = {name: RTYPES[name] for name in ("error", "symbol-mapping", "system")}


def rtype_of(schema: str) -> int:
    return SCHEMA_RTYPE[schema] if schema in SCHEMA_RTYPE else CONTROL_RTYPE[schema]


def schema_layout(schema: str, version: int = 3) -> str:
    return layout_name(KIND[rtype_of(schema)], version)


#: Record kinds in the order of the columns of a table of mixed types.
KINDS = list(dict.fromkeys(KIND.values()))


def mixed_schema(version: int = 3, ts_out: bool = False) -> T.StructType:
    """A table of records of all types: header, the time that orders a stream, and for each kind of record a struct of
    its further columns, null for records of other kinds."""
    out = T.StructType([spark_schema("mbo")[c] for c in HEADER]).add("index_ts", T.LongType())
    for kind in KINDS:
        out.add(kind, T.StructType([f for f in spark_schema(layout_name(kind, version)) if f.name not in HEADER]))
    return out.add("ts_out", T.LongType()) if ts_out else out


def index_column(name: str) -> str:
    """The column that orders a stream."""
    return "ts_recv" if "ts_recv" in text_columns(name) else "ts_event"


def describe(name: str) -> list[dict[str, object]]:
    """Of each field in file order: its column, number type, and whether it is a price, a time, hidden, or a text; and its place among the text columns."""
    columns, out = text_columns(name), []
    for field, kind in [("ts_event", "u64"), ("rtype", "u8"), ("publisher_id", "u16"), ("instrument_id", "u32"), *fields(name)]:
        is_time = kind == "u64" and (field.startswith("ts_") or field.endswith(("_ts", "_time", "expiration", "activation")))
        out.append({
            "column": field, "dtype": _NUMBERS.get(kind, f"S{kind[1:] or 1}"), "price": kind == "i64" and field != "quantity", "timestamp": is_time,
            "hidden": field not in columns, "text": kind[0] in "cs", "order": columns.index(field) if field in columns else None,
        })
    return out
