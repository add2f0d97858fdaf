"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Pure ASCII texts take the fast built-in, which does just that for them."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def unit_hash(*parts: Column) -> Column:
    """A 32-bit number from the MD5 of the parts joined by `|`; any SQL engine can compute the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")
