"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Location given to addresses that no range covers.
UNKNOWN_LAT, UNKNOWN_LON = 48.0, 22.0


def unsigned(data: Column, offset: Column | int, width: int) -> Column:
    """Big-endian unsigned integer of ``width`` bytes at a zero-based byte offset of a BINARY column."""
    start = offset + F.lit(1) if isinstance(offset, Column) else F.lit(offset + 1)
    return F.conv(F.hex(data.substr(start.cast("int"), F.lit(width))), 16, 10).cast("bigint")


def bits(word: str, low: int, width: int) -> Column:
    """``width`` bits of a whole-number column, from bit ``low`` up."""
    return F.shiftright(F.col(word), low).bitwiseAND(F.lit((1 << width) - 1))


def dotted(address: Column) -> Column:
    """IPv4 text form of a 32-bit value."""
    return F.concat_ws(".", *[F.shiftright(address, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def once(value: Column) -> Column:
    """The same value, computed once per row: filters on it are not rewritten into copies of its expression."""
    return F.explode(F.array(value))


def ip_to_long(ip: Column) -> Column:
    """IPv4 text to its 32-bit value; NULL for anything else."""
    parts = F.split(ip, r"\.")
    octets = [F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    valid = F.size(parts) == 4
    for octet in octets:
        valid = valid & octet.between(0, 255)
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(valid, value)


# The geohash alphabet.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash2(lat: Column, lon: Column) -> Column:
    """Two-character geohash: five longitude and five latitude bits, interleaved longitude first."""
    x = F.least(F.floor((lon + 180) / 360 * 32), F.lit(31)).cast("int")
    y = F.least(F.floor((lat + 90) / 180 * 32), F.lit(31)).cast("int")

    def bit(value: Column, position: int) -> Column:
        return F.shiftright(value, position).bitwiseAND(F.lit(1))

    high = bit(x, 4) * 16 + bit(y, 4) * 8 + bit(x, 3) * 4 + bit(y, 3) * 2 + bit(x, 2)
    low = bit(y, 2) * 16 + bit(x, 1) * 8 + bit(y, 1) * 4 + bit(x, 0) * 2 + bit(y, 0)
    letters = F.lit(GEOHASH_ALPHABET)
    return F.concat(letters.substr(high + F.lit(1), F.lit(1)), letters.substr(low + F.lit(1), F.lit(1)))
