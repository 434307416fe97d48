"""Two bits a base: byte strings of whole groups of four bases after one byte for the length modulo 4."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dna


def pack(seq: Column) -> Column:
    """First byte: length modulo 4; then four bases a byte, the last group padded with A."""
    d = dna.digits(seq)
    padded = F.rpad(d, (F.ceil(F.length(d) / 4) * 4).cast("int"), F.lit("0"))
    groups = F.transform(F.sequence(F.lit(1), F.length(padded), F.lit(4)), lambda i: F.lpad(F.conv(F.substring(padded, i, F.lit(4)), 4, 16), 2, "0"))
    body = F.when(F.length(seq) > 0, F.array_join(groups, "")).otherwise("")
    return F.unhex(F.concat(F.lpad(F.hex(F.length(seq) % 4), 2, "0"), body))


def unpack(packed: Column) -> Column:
    h = F.hex(packed)
    rest = F.conv(F.substring(h, 1, 2), 16, 10).cast("int")
    at = F.sequence(F.lit(3), F.length(h), F.lit(2))
    body = F.when(F.length(h) > 2, F.array_join(F.transform(at, lambda i: F.lpad(F.conv(F.substring(h, i, F.lit(2)), 16, 4), 4, "0")), "")).otherwise("")
    size = F.length(body) - F.when(rest > 0, 4 - rest).otherwise(0)
    return dna.bases(F.substring(body, F.lit(1), size))
