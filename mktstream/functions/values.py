"""Values that the record format fixes: codes, names, sentinels."""

from __future__ import annotations

# Fixed values, all of them: they have to be as they are for files and text to be read elsewhere.

UNDEF_PRICE = 9223372036854775807
UNDEF_ORDER_SIZE = 4294967295
UNDEF_TIMESTAMP = 18446744073709551615
UNDEF_STAT_QUANTITY_V1 = 2147483647
UNDEF_STAT_QUANTITY = 9223372036854775807
FIXED_PRICE_SCALE = 1_000_000_000

SCHEMAS = {
    "mbo": 0, "mbp-1": 1, "mbp-10": 2, "tbbo": 3, "trades": 4, "ohlcv-1s": 5, "ohlcv-1m": 6, "ohlcv-1h": 7, "ohlcv-1d": 8, "definition": 9,
    "statistics": 10, "status": 11, "imbalance": 12, "ohlcv-eod": 13, "cmbp-1": 14, "cbbo-1s": 15, "cbbo-1m": 16, "tcbbo": 17, "bbo-1s": 18, "bbo-1m": 19,
}
RTYPES = {
    "mbp-0": 0x00, "mbp-1": 0x01, "mbp-10": 0x0A, "ohlcv-deprecated": 0x11, "status": 0x12, "instrument-def": 0x13, "imbalance": 0x14, "error": 0x15,
    "symbol-mapping": 0x16, "system": 0x17, "statistics": 0x18, "ohlcv-1s": 0x20, "ohlcv-1m": 0x21, "ohlcv-1h": 0x22, "ohlcv-1d": 0x23, "ohlcv-eod": 0x24,
    "mbo": 0xA0, "cmbp-1": 0xB1, "cbbo-1s": 0xC0, "cbbo-1m": 0xC1, "tcbbo": 0xC2, "bbo-1s": 0xC3, "bbo-1m": 0xC4,
}
#: The record type that carries a schema; tbbo shares the one of mbp-1.
SCHEMA_RTYPE = {s: RTYPES[{"trades": "mbp-0", "tbbo": "mbp-1", "definition": "instrument-def"}.get(s, s)] for s in SCHEMAS}
#: The schema that a record type splits into: never tbbo, none for control records.
RTYPE_SCHEMA = {r: s for s, r in SCHEMA_RTYPE.items() if s != "tbbo"}
INTERVAL_SECONDS = {
    "ohlcv-1s": 1, "cbbo-1s": 1, "bbo-1s": 1, "ohlcv-1m": 60, "cbbo-1m": 60, "bbo-1m": 60, "ohlcv-1h": 3600, "ohlcv-1d": 86400, "ohlcv-eod": 86400,
}

STYPES = {
    "instrument_id": 0, "raw_symbol": 1, "smart": 2, "continuous": 3, "parent": 4, "nasdaq_symbol": 5, "cms_symbol": 6, "isin": 7, "us_code": 8,
    "bbg_comp_id": 9, "bbg_comp_ticker": 10, "figi": 11, "figi_ticker": 12,
}
STYPE_ALIASES = {"product_id": "instrument_id", "native": "raw_symbol", "nasdaq": "nasdaq_symbol", "cms": "cms_symbol"}

SIDES = {"A": "ask", "B": "bid", "N": "none"}
ACTIONS = {"M": "modify", "T": "trade", "F": "fill", "C": "cancel", "A": "add", "R": "clear", "N": "none"}
INSTRUMENT_CLASSES = {
    "B": "bond", "C": "call", "F": "future", "K": "stock", "M": "mixed_spread", "P": "put", "S": "future_spread", "T": "option_spread", "X": "fx_spot",
    "Y": "commodity_spot",
}
MATCH_ALGORITHMS = {
    " ": "undefined", "F": "fifo", "K": "configurable", "C": "pro_rata", "T": "fifo_lmm", "O": "threshold_pro_rata", "S": "fifo_top_lmm",
    "Q": "threshold_pro_rata_lmm", "Y": "eurodollar_futures", "P": "time_pro_rata", "V": "institutional_prioritization",
}
USER_DEFINED = {"N": "no", "Y": "yes"}
UPDATE_ACTIONS = {"A": "add", "M": "modify", "D": "delete", "~": "invalid"}
TRI_STATES = {"~": "not_available", "N": "no", "Y": "yes"}
STAT_TYPES = {
    1: "opening_price", 2: "indicative_opening_price", 3: "settlement_price", 4: "trading_session_low_price", 5: "trading_session_high_price",
    6: "cleared_volume", 7: "lowest_offer", 8: "highest_bid", 9: "open_interest", 10: "fixing_price", 11: "close_price", 12: "net_change", 13: "vwap",
    14: "volatility", 15: "delta", 16: "uncrossing_price", 17: "upper_price_limit", 18: "lower_price_limit", 19: "block_volume",
    10001: "venue_specific_volume_1",
}
STAT_UPDATE_ACTIONS = {1: "new", 2: "delete"}
STATUS_ACTIONS = {
    0: "none", 1: "pre_open", 2: "pre_cross", 3: "quoting", 4: "cross", 5: "rotation", 6: "new_price_indication", 7: "trading", 8: "halt", 9: "pause",
    10: "suspend", 11: "pre_close", 12: "close", 13: "post_close", 14: "ssr_change", 15: "not_available_for_trading",
}
STATUS_REASONS = {
    0: "none", 1: "scheduled", 2: "surveillance_intervention", 3: "market_event", 4: "instrument_activation", 5: "instrument_expiration",
    6: "recovery_in_process", 10: "regulatory", 11: "administrative", 12: "non_compliance", 13: "filings_not_current", 14: "sec_trading_suspension",
    15: "new_issue", 16: "issue_available", 17: "issues_reviewed", 18: "filing_reqs_satisfied", 30: "news_pending", 31: "news_released",
    32: "news_and_resumption_times", 33: "news_not_forthcoming", 40: "order_imbalance", 50: "luld_pause", 60: "operational",
    70: "additional_information_requested", 80: "merger_effective", 90: "etf", 100: "corporate_action", 110: "new_security_offering",
    120: "market_wide_halt_level1", 121: "market_wide_halt_level2", 122: "market_wide_halt_level3", 123: "market_wide_halt_carryover",
    124: "market_wide_halt_resumption", 130: "quotation_not_available",
}
TRADING_EVENTS = {0: "none", 1: "no_cancel", 2: "change_trading_session", 3: "implied_matching_on", 4: "implied_matching_off"}
ERROR_CODES = {
    1: "auth_failed", 2: "api_key_deactivated", 3: "connection_limit_exceeded", 4: "symbol_resolution_failed", 5: "invalid_subscription",
    6: "internal_error", 7: "skipped_records_after_slow_reading", 255: "unset",
}
SYSTEM_CODES = {0: "heartbeat", 1: "subscription_ack", 2: "slow_reader_warning", 3: "replay_completed", 4: "end_of_interval", 255: "unset"}
FLAGS = {"LAST": 128, "TOB": 64, "SNAPSHOT": 32, "MBP": 16, "BAD_TS_RECV": 8, "MAYBE_BAD_BOOK": 4, "PUBLISHER_SPECIFIC": 2}

#: By number, from 1.
VENUES = """
GLBX XNAS XBOS XPSX BATS BATY EDGA EDGX XNYS XCIS XASE ARCX XCHI IEXG FINN FINC
FINY MEMX EPRL AMXO XBOX XCBO EMLD EDGO GMNI XISX MCRY XMIO ARCO OPRA MPRL XNDQ
XBXO C2OX XPHL BATO MXOP IFEU NDEX DBEQ SPHR LTSE XOFF ASPN ASMT ASPI EQUS IFUS
IFLL XEUR XEEE XCBF OCEA
""".split()
DATASETS = """
GLBX.MDP3 XNAS.ITCH XBOS.ITCH XPSX.ITCH BATS.PITCH BATY.PITCH EDGA.PITCH EDGX.PITCH XNYS.PILLAR XCIS.PILLAR
XASE.PILLAR XCHI.PILLAR XCIS.BBO XCIS.TRADES MEMX.MEMOIR EPRL.DOM FINN.NLS FINY.TRADES OPRA.PILLAR DBEQ.BASIC
ARCX.PILLAR IEXG.TOPS EQUS.PLUS XNYS.BBO XNYS.TRADES XNAS.QBBO XNAS.NLS IFEU.IMPACT NDEX.IMPACT EQUS.ALL
XNAS.BASIC EQUS.SUMMARY XCIS.TRADESBBO XNYS.TRADESBBO EQUS.MINI IFUS.IMPACT IFLL.IMPACT XEUR.EOBI XEEE.EOBI XCBF.PITCH
OCEA.MEMOIR
""".split()
#: dataset.venue by publisher number, from 1.
PUBLISHERS = """
GLBX.MDP3.GLBX XNAS.ITCH.XNAS XBOS.ITCH.XBOS XPSX.ITCH.XPSX BATS.PITCH.BATS BATY.PITCH.BATY EDGA.PITCH.EDGA
EDGX.PITCH.EDGX XNYS.PILLAR.XNYS XCIS.PILLAR.XCIS XASE.PILLAR.XASE XCHI.PILLAR.XCHI XCIS.BBO.XCIS XCIS.TRADES.XCIS
MEMX.MEMOIR.MEMX EPRL.DOM.EPRL XNAS.NLS.FINN XNAS.NLS.FINC XNYS.TRADES.FINY OPRA.PILLAR.AMXO OPRA.PILLAR.XBOX
OPRA.PILLAR.XCBO OPRA.PILLAR.EMLD OPRA.PILLAR.EDGO OPRA.PILLAR.GMNI OPRA.PILLAR.XISX OPRA.PILLAR.MCRY OPRA.PILLAR.XMIO
OPRA.PILLAR.ARCO OPRA.PILLAR.OPRA OPRA.PILLAR.MPRL OPRA.PILLAR.XNDQ OPRA.PILLAR.XBXO OPRA.PILLAR.C2OX OPRA.PILLAR.XPHL
OPRA.PILLAR.BATO OPRA.PILLAR.MXOP IEXG.TOPS.IEXG DBEQ.BASIC.XCHI DBEQ.BASIC.XCIS DBEQ.BASIC.IEXG DBEQ.BASIC.EPRL
ARCX.PILLAR.ARCX XNYS.BBO.XNYS XNYS.TRADES.XNYS XNAS.QBBO.XNAS XNAS.NLS.XNAS EQUS.PLUS.XCHI EQUS.PLUS.XCIS
EQUS.PLUS.IEXG EQUS.PLUS.EPRL EQUS.PLUS.XNAS EQUS.PLUS.XNYS EQUS.PLUS.FINN EQUS.PLUS.FINY EQUS.PLUS.FINC
IFEU.IMPACT.IFEU NDEX.IMPACT.NDEX DBEQ.BASIC.DBEQ EQUS.PLUS.EQUS OPRA.PILLAR.SPHR EQUS.ALL.XCHI EQUS.ALL.XCIS
EQUS.ALL.IEXG EQUS.ALL.EPRL EQUS.ALL.XNAS EQUS.ALL.XNYS EQUS.ALL.FINN EQUS.ALL.FINY EQUS.ALL.FINC
EQUS.ALL.BATS EQUS.ALL.BATY EQUS.ALL.EDGA EQUS.ALL.EDGX EQUS.ALL.XBOS EQUS.ALL.XPSX EQUS.ALL.MEMX
EQUS.ALL.XASE EQUS.ALL.ARCX EQUS.ALL.LTSE XNAS.BASIC.XNAS XNAS.BASIC.FINN XNAS.BASIC.FINC IFEU.IMPACT.XOFF
NDEX.IMPACT.XOFF XNAS.NLS.XBOS XNAS.NLS.XPSX XNAS.BASIC.XBOS XNAS.BASIC.XPSX EQUS.SUMMARY.EQUS XCIS.TRADESBBO.XCIS
XNYS.TRADESBBO.XNYS XNAS.BASIC.EQUS EQUS.ALL.EQUS EQUS.MINI.EQUS XNYS.TRADES.EQUS IFUS.IMPACT.IFUS IFUS.IMPACT.XOFF
IFLL.IMPACT.IFLL IFLL.IMPACT.XOFF XEUR.EOBI.XEUR XEEE.EOBI.XEEE XEUR.EOBI.XOFF XEEE.EOBI.XOFF XCBF.PITCH.XCBF
XCBF.PITCH.XOFF OCEA.MEMOIR.OCEA
""".split()
