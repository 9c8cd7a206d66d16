"""IP addresses as sortable values, and the test for public ones."""

from __future__ import annotations

from functools import reduce
from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import CLOSED_V4, OPEN_V4, OPEN_V6, PRIVATE_V6, RESERVED_V6
from .staging import let, record

_OCTET = "(0|[1-9][0-9]{0,2})"
_V4 = f"^{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}$"


def v4_number(ip: Column) -> Column:
    """Dotted quad as BIGINT, NULL when it is not one."""
    parts = F.split(ip, "\\.")
    octets = [F.get(parts, F.lit(i)).try_cast("int") for i in range(4)]
    valid = ip.rlike(_V4) & reduce(lambda a, b: a & b, [o <= 255 for o in octets])
    number = reduce(lambda acc, o: acc * 256 + o, octets, F.lit(0).cast("bigint"))
    return F.when(valid, number)


def v6_hex(ip: Column) -> Column:
    """IPv6 text as 32 hex digits, NULL when it is not an address. A zone suffix is cut."""
    def groups(part: Column) -> Column:
        return F.array_remove(F.split(part, ":"), "")

    def padded(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda g: F.lpad(g, 4, "0")), "")

    def without_quad(text: Column) -> Column:
        """A dotted-quad tail becomes two hex groups."""
        packed = F.lpad(F.lower(F.hex(v4_number(F.substring_index(text, ":", -1)))), 8, "0")
        joined = let(packed, lambda h: F.concat(
            F.regexp_extract(text, "^(.*:)[^:]*$", 1),
            F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))
        return F.when(text.contains("."), joined).otherwise(text)

    def digits(plain: Column) -> Column:
        short = plain.contains("::")
        halves = record(
            left=groups(F.when(short, F.substring_index(plain, "::", 1)).otherwise(plain)),
            right=groups(F.when(short, F.substring_index(plain, "::", -1)).otherwise(F.lit(""))),
        )
        piece = "([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?"

        def joined(h: Column) -> Column:
            count = F.size(h["left"]) + F.size(h["right"])
            valid = F.when(short, (count <= 7) & plain.rlike(f"^{piece}::{piece}$")).otherwise(
                (count == 8) & plain.rlike("^[0-9a-f]{1,4}(:[0-9a-f]{1,4}){7}$"))
            zeros = F.repeat(F.lit("0"), (F.lit(8) - count) * 4)
            return F.when(valid, F.concat(padded(h["left"]), zeros, padded(h["right"])))

        return let(halves, joined)

    text = F.lower(F.regexp_replace(ip, "%.+$", ""))
    return let(text, lambda t: let(without_quad(t), digits))


def _in_v4(number: Column, networks: tuple[str, ...]) -> Column:
    """Fixed ranges as an OR of comparisons: no range join, nothing to broadcast."""
    nets = [ip_network(n) for n in networks]
    return reduce(lambda a, b: a | b, [
        number.between(int(n.network_address), int(n.broadcast_address)) for n in nets])


def _in_v6(digits: Column, networks: tuple[str, ...]) -> Column:
    nets = [ip_network(n) for n in networks]
    return reduce(lambda a, b: a | b, [
        digits.between(f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}")
        for n in nets])


def closed_address(ip: Column) -> Column:
    """True for private, local, multicast, reserved or unreadable addresses."""
    def closed4(n: Column) -> Column:
        return _in_v4(n, CLOSED_V4) & ~_in_v4(n, OPEN_V4)

    def closed6(h: Column) -> Column:
        return (_in_v6(h, PRIVATE_V6) & ~_in_v6(h, OPEN_V6)) | _in_v6(h, RESERVED_V6)

    return F.coalesce(
        let(v4_number(ip), closed4), let(v6_hex(ip), closed6), F.lit(True))
