"""Text functions as column expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The white space that trimming and collapsing take off.
BLANK = r"[\t\n\x0B\f\r    -     　﻿]"
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_REFERENCE = re.compile(r"&(#x?[0-9a-f]+|[a-z]+);", re.I)


def trim(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return trim(F.regexp_replace(text, f"{BLANK}+", " "))


def decode_entity(text: str) -> str:
    """One pass over numeric references (as 16-bit units) and six names; all others stay."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#":
            return NAMED.get(name.lower(), m[0])
        digits, radix = (name[2:], 16) if name[1] in "xX" else (name[1:], 10)
        try:
            return chr(int(digits, radix) & 0xFFFF)
        except ValueError:
            return m[0]

    out = _REFERENCE.sub(one, text)
    return out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


@F.arrow_udf(StringType())
def _decode(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else decode_entity(x) for x in text.to_pylist()], pa.string())


def decode_entities(text: Column) -> Column:
    """Character references decoded; only texts with '&' go through Python."""
    return F.when(text.contains("&"), _decode(F.when(text.contains("&"), text))).otherwise(text)


def escape_html(text: Column) -> Column:
    """'&', '<', '>' and '"' as references."""
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def escape_regex(text: Column) -> Column:
    """Regex metacharacters with a backslash."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def percent(share: Column) -> Column:
    """Percent text: one decimal, more (up to 10) until a digit shows; '0.0' for nothing."""
    out = F.format_string("%.10f", share.cast("double"))
    for d in range(9, 0, -1):
        out = F.when(F.round(share.cast("double"), d) != 0, F.format_string(f"%.{d}f", share.cast("double"))).otherwise(out)
    return F.when(share > 0, out).otherwise(F.lit("0.0"))


def duration(ms: Column) -> Column:
    """'Ns', 'Nm Ns' or 'Nh Nm Ns'."""
    s = F.floor(ms / 1000 + 0.5).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(h > 0, F.format_string("%dh %dm %ds", h, m, s % 60)).otherwise(F.format_string("%dm %ds", m, s % 60))


def thousands(n: Column) -> Column:
    """A count with separators."""
    return F.format_number(n, 0)


def stamp(ts: Column) -> Column:
    """'YYYY-MM-DD HH:MM' in the session's time zone."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def share(part: Column, whole: Column) -> Column:
    """Percent text of part in whole, null if whole is 0."""
    return F.when(whole > 0, percent(part / whole * 100))
