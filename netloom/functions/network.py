"""Rules over addresses, status codes and header lists, as column expressions."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IPv4 blocks that are not public, as address and prefix length.
PRIVATE_BLOCKS = (("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("192.0.0.0", 24), ("100.64.0.0", 10), ("224.0.0.0", 3))
#: Names of the local machine and network, and IPv6 blocks that are not public.
PRIVATE_NAMES = r"^(localhost|localhost\.localdomain|.*\.(localhost|internal|local))$"
PRIVATE_BLOCKS6 = ("::/127", "fc00::/7", "fe80::/10", "64:ff9b::/32", "100::/64")
MAPPED_BLOCK = "::ffff:0:0/96"
_QUAD = r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})"


def ipv4_number(address: Column) -> Column:
    """An IPv4 address as a number; null where a part exceeds 255 or the text is no address."""
    parts = [F.regexp_extract(address, f"^{_QUAD}$", i).try_cast("bigint") for i in range(1, 5)]
    inside = reduce(lambda x, y: x & y, [p <= 255 for p in parts])
    return F.when(inside, reduce(lambda x, y: x * 256 + y, parts))


def is_private_ipv4(address: Column) -> Column:
    """In a block that is not public, or no valid address."""
    number = ipv4_number(address)
    blocks = [(reduce(lambda x, y: x * 256 + int(y), a.split("."), 0) >> (32 - bits), 32 - bits) for a, bits in PRIVATE_BLOCKS]
    return number.isNull() | reduce(lambda x, y: x | y, [F.shiftright(number, free) == prefix for prefix, free in blocks])


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv6_groups(address: Column) -> Column:
    """An IPv6 address as eight numbers of 16 bits, a dotted quad at its end as two of them; null if it is none."""

    def spelled(tail: Column) -> Column:
        hex_tail = F.concat_ws(":", F.hex(F.shiftright(tail, 16)), F.hex(tail.bitwiseAND(65535)))
        return F.when(tail.isNotNull(), F.concat(F.regexp_replace(address, f"{_QUAD}$", ""), hex_tail)).otherwise(address)

    def filled(halves: Column) -> Column:
        groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")
        sides = F.struct(groups(halves[0]).alias("l"), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("r"), F.size(halves).alias("n"))
        zeros = lambda s: F.array_repeat(F.lit("0"), F.when(s["n"] == 2, F.greatest(8 - F.size(s["l"]) - F.size(s["r"]), F.lit(0))).otherwise(0))
        known = lambda s: (s["n"] <= 2) & ((s["n"] == 1) | (F.size(s["l"]) + F.size(s["r"]) < 8))
        return _let(sides, lambda s: F.when(known(s), F.concat(s["l"], zeros(s), s["r"])))

    fits = lambda gs: (F.size(gs) == 8) & F.forall(gs, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
    text = _let(ipv4_number(F.regexp_extract(address, f":({_QUAD})$", 1)), spelled)
    return _let(_let(F.split(text, "::"), filled), lambda gs: F.when(fits(gs), F.transform(gs, lambda g: F.conv(g, 16, 10).cast("int"))))


def in_block6(groups: Column, block: str) -> Column:
    """Whether an address (as ipv6_groups has it) lies in a block."""
    net = ipaddress.ip_network(block)
    number, out = int(net.network_address), F.lit(True)
    for i in range(0, net.prefixlen, 16):
        free = max(0, 16 - (net.prefixlen - i))
        out = out & (F.shiftright(groups[i // 16], free) == ((number >> (112 - i)) & 0xFFFF) >> free)
    return out


def is_private_ipv6(address: Column) -> Column:
    """In a block that is not public, or no valid address; one that maps an IPv4 address goes by that."""

    def judged(groups: Column) -> Column:
        quad = F.concat_ws(".", *[F.shiftright(groups[6 + i // 2], 8 * (1 - i % 2)).bitwiseAND(255).cast("string") for i in range(4)])
        listed = reduce(lambda x, y: x | y, [in_block6(groups, b) for b in PRIVATE_BLOCKS6])
        return groups.isNull() | F.when(in_block6(groups, MAPPED_BLOCK), _let(quad, is_private_ipv4)).otherwise(listed)

    return _let(ipv6_groups(address), judged)


def is_private_host(host: Column) -> Column:
    """Names and addresses of the machine itself or of its own network; a host that is missing counts as one."""
    h = F.lower(host)
    inner = F.trim(F.regexp_extract(h, r"^\[(.*)\]$", 1))
    told = F.when(h.rlike(PRIVATE_NAMES), True).when(h.rlike(r"^\[.*\]$"), is_private_ipv6(inner)).when(h.rlike(f"^{_QUAD}$"), is_private_ipv4(h)).otherwise(False)
    return F.when(F.coalesce(h, F.lit("")) == "", True).otherwise(told)


def status_class(status: Column) -> Column:
    """error: 400 and above, or 0; warning: redirects other than 304; else ok. A missing status is ok."""
    return F.when((status >= 400) | (status == 0), "error").when((status >= 300) & (status < 400) & (status != 304), "warning").otherwise("ok")


def time_label(ms: Column, status: Column) -> Column:
    """Duration in whole milliseconds, with the status of what did not simply succeed."""
    base = F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms"))
    return F.when((status >= 300) | (status < 0), F.concat(base, F.lit(" ("), status.cast("string"), F.lit(")"))).when(status == 0, F.concat(base, F.lit(" (request canceled)"))).otherwise(base)


def document_part(url: Column) -> Column:
    """A url without query and fragment."""
    return F.regexp_extract(url, r"^([^?#]*)", 1)


def merge_headers(headers: Column, more: Column) -> Column:
    """headers with the values of more where a name matches whatever its case; names that are new follow.

    Both are arrays of (name, value). The last value given for a name counts.
    """
    same = lambda n: F.filter(more, lambda m: F.lower(m["name"]) == F.lower(n))
    renewed = F.transform(headers, lambda h: F.when(F.size(same(h["name"])) > 0, F.struct(h["name"].alias("name"), F.element_at(same(h["name"]), -1)["value"].alias("value"))).otherwise(h))
    return F.concat(renewed, F.filter(more, lambda m: ~F.exists(headers, lambda h: F.lower(h["name"]) == F.lower(m["name"]))))


def ordered_times(start: Column, first_byte: Column, end: Column) -> tuple[Column, Column]:
    """first_byte and end, moved so that start <= first_byte <= end; a missing time stays missing."""
    first = F.when(first_byte.isNotNull(), F.greatest(first_byte, start))
    return first, F.when(end.isNotNull(), F.greatest(end, start, first))


def request_bytes(method: Column, url: Column, version: Column, headers: Column) -> Column:
    """Estimated size of a request as text: its line, its headers (name, value) and an empty line."""
    line = F.length(method) + F.length(url) + F.length(F.when(version != "", version).otherwise("HTTP/1.1")) + 4
    fields = F.aggregate(headers, F.lit(0), lambda n, h: n + F.length(h["name"]) + F.length(h["value"]) + 4)
    return F.when((method != "") & (url != ""), line).otherwise(0) + F.coalesce(fields, F.lit(0)) + 2
