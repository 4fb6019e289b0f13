"""Cells, validators and small values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two-letter country codes of ISO 3166-1.
ISO2 = (
    "AD AE AF AG AI AL AM AO AQ AR AS AT AU AW AX AZ BA BB BD BE BF BG BH BI BJ BL BM BN BO BQ BR BS BT BV BW BY BZ "
    "CA CC CD CF CG CH CI CK CL CM CN CO CR CU CV CW CX CY CZ DE DJ DK DM DO DZ EC EE EG EH ER ES ET FI FJ FK FM FO FR "
    "GA GB GD GE GF GG GH GI GL GM GN GP GQ GR GS GT GU GW GY HK HM HN HR HT HU ID IE IL IM IN IO IQ IR IS IT JE JM JO JP "
    "KE KG KH KI KM KN KP KR KW KY KZ LA LB LC LI LK LR LS LT LU LV LY MA MC MD ME MF MG MH MK ML MM MN MO MP MQ MR MS MT MU MV MW MX MY MZ "
    "NA NC NE NF NG NI NL NO NP NR NU NZ OM PA PE PF PG PH PK PL PM PN PR PS PT PW PY QA RE RO RS RU RW "
    "SA SB SC SD SE SG SH SI SJ SK SL SM SN SO SR SS ST SV SX SY SZ TC TD TF TG TH TJ TK TL TM TN TO TR TT TV TW TZ "
    "UA UG UM US UY UZ VA VC VE VG VI VN VU WF WS YE YT ZA ZM ZW"
).split()

#: The shapes that qualified strings must have.
SHAPES = {
    "url": r"^https?://[^\s/?#]+\S*$",
    "blake3": r"^[0-9a-f]{64}$",
    "file": r"^blake3:[0-9a-f]{64}$",
    "reference": r"^[a-z][a-z0-9+.-]*://[A-Za-z0-9._-]+/[0-9]+$",
}

BLANK = r"^\s+|\s+$"
WHOLE = r"^[+-]?\d+$"
DECIMAL = r"^[+-]?(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def valid_string(c: Column, unit: str) -> Column:
    """Whether a string satisfies its qualifier; null is fine."""
    ok = c.isin(*ISO2) if unit == "iso2" else c.rlike(SHAPES[unit])
    return F.coalesce(ok, F.lit(True))


def trimmed(cell: Column) -> Column:
    """A cell without surrounding space; empty is null."""
    t = F.regexp_replace(cell, BLANK, "")
    return F.when(t != "", t)


def cell_kind(cell: Column) -> Column:
    """What a cell holds: null, Bool, Int, Float (only with a dot) or String."""
    t = trimmed(cell)
    whole = t.rlike(WHOLE) & t.try_cast("bigint").isNotNull()
    return F.when(t.isNull(), "null").when(t.isin("true", "false"), "Bool").when(whole, "Int").when(t.rlike(DECIMAL), "Float").otherwise("String")


def cell_as(cell: Column, base: str) -> Column:
    """A cell as a value of a declared type; null where it does not convert."""
    t, kind = trimmed(cell), cell_kind(cell)
    if base == "Int":
        return F.when(kind == "Int", t.try_cast("bigint"))
    if base == "Float":
        return F.when(kind.isin("Int", "Float"), t.try_cast("double"))
    if base == "Bool":
        return F.when(kind == "Bool", t.try_cast("boolean"))
    return t


def no_negative_zero(c: Column) -> Column:
    return F.when(c == 0.0, F.lit(0.0)).otherwise(c)
