"""Enumerations as driver-side values: parsing, coercion and listing."""

from __future__ import annotations

from mktstream.functions import values as V
from mktstream.plans.metadata import ConversionError


def _by_code(names: dict[str, int]) -> dict[int, str]:
    return {code: name for name, code in names.items()}


#: Code to name, by enumeration.
ENUMS: dict[str, dict] = {
    "schema": _by_code(V.SCHEMAS), "rtype": _by_code(V.RTYPES), "stype": _by_code(V.STYPES), "side": V.SIDES, "action": V.ACTIONS,
    "instrument_class": V.INSTRUMENT_CLASSES, "match_algorithm": V.MATCH_ALGORITHMS, "user_defined_instrument": V.USER_DEFINED,
    "security_update_action": V.UPDATE_ACTIONS, "tri_state": V.TRI_STATES, "stat_type": V.STAT_TYPES, "stat_update_action": V.STAT_UPDATE_ACTIONS,
    "status_action": V.STATUS_ACTIONS, "status_reason": V.STATUS_REASONS, "trading_event": V.TRADING_EVENTS, "error_code": V.ERROR_CODES,
    "system_code": V.SYSTEM_CODES, "encoding": {0: "dbn", 1: "csv", 2: "json"}, "compression": {0: "none", 1: "zstd"},
    "venue": dict(enumerate(V.VENUES, 1)), "dataset": dict(enumerate(V.DATASETS, 1)), "publisher": dict(enumerate(V.PUBLISHERS, 1)),
    "upgrade_policy": {0: "as_is", 1: "upgrade_to_v2", 2: "upgrade_to_v3"},
}
ALIASES = {"stype": V.STYPE_ALIASES}


def plain(name: str) -> str:
    """A name as it is compared: lower case, - for _."""
    return name.lower().replace("_", "-")


def parse(enum: str, name: str):
    """The code of a name exactly as it is written."""
    name = ALIASES.get(enum, {}).get(name, name)
    for code, known in ENUMS[enum].items():
        if known == name:
            return code
    raise ConversionError(f"{name!r} is no {enum}")


def coerce(enum: str, value):
    """The code of a value: a code, or a name in any case with - or _."""
    if value in ENUMS[enum]:
        return value
    if isinstance(value, str):
        aliases = {plain(a): n for a, n in ALIASES.get(enum, {}).items()}
        wanted = plain(aliases.get(plain(value), value))
        for code, known in ENUMS[enum].items():
            if plain(known) == wanted:
                return code
    raise ConversionError(f"{value!r} is no {enum}")


def variants(enum: str) -> list[str]:
    return list(ENUMS[enum].values())


def publishers_of(dataset: str) -> list[int]:
    """The numbers of a dataset's publishers."""
    if dataset not in V.DATASETS:
        raise ConversionError(f"{dataset!r} is no dataset")
    return [i for i, p in enumerate(V.PUBLISHERS, 1) if p.rpartition(".")[0] == dataset]
