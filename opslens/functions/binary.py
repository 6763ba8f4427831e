"""Binary values: hex text, security identifiers, hashes, GUID text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hex_text(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.hex(c))


def sid_text(sid: Column) -> Column:
    """Security identifier as ``S-r-a-s1-s2...``; groups are little endian."""
    def byte(position: Column | int) -> Column:
        at = position if isinstance(position, Column) else F.lit(position)
        return F.hex(F.substr(sid, at, F.lit(1)))

    def number(digits: Column) -> Column:
        return F.conv(digits, 16, 10)

    groups = F.call_function("div", F.octet_length(sid) - 8, F.lit(4))
    indexes = F.filter(F.sequence(F.lit(0), F.greatest(groups, F.lit(1)).cast("int")), lambda i: i < groups)
    parts = F.transform(
        indexes,
        lambda i: number(F.concat(*[byte(F.lit(9 + k) + i * 4) for k in (3, 2, 1, 0)])),
    )
    authority = number(F.concat(*[byte(k) for k in range(3, 9)]))
    return F.array_join(F.concat(F.array(F.lit("S"), number(byte(1)), authority), parts), "-")


def hash_text(c: Column) -> Column:
    """Upper-case hex SHA-1 of the lower-case text."""
    return F.concat(F.lit("0x"), F.upper(F.sha1(F.lower(c))))


def guid_hex(guid: Column) -> Column:
    """GUID text to the hex form in which job steps quote it (first three groups byte-swapped)."""
    g = F.upper(F.replace(guid, F.lit("-"), F.lit("")))

    def swapped(positions: list[int]) -> list[Column]:
        return [F.substring(g, p, 2) for p in positions]

    return F.concat(F.lit("0x"), *swapped([7, 5, 3, 1]), *swapped([11, 9]), *swapped([15, 13]),
                    F.substring(g, 17, 16))
