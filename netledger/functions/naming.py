"""Names of hosts, addresses and ports as column expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from netledger.functions import rule_tables as tables
from netledger.functions.timebins import as_col


def qualify_domain(name: Column | str) -> Column:
    """Trim and append the root dot where it is missing."""
    plain = F.trim(as_col(name))
    return F.when(plain.endswith("."), plain).otherwise(F.concat(plain, F.lit(".")))


def _registrable(parts: Column) -> Column:
    """Last two labels, or last three where the last label is a two-letter country code."""
    n = F.size(parts)
    keep = F.when(F.length(F.element_at(parts, -1)) == 2, F.lit(3)).otherwise(F.lit(2))
    keep = F.least(n, keep)
    return F.concat(F.array_join(F.slice(parts, n - keep + 1, keep), "."), F.lit("."))


def _labels(name: Column | str) -> Column:
    return F.split(F.regexp_replace(F.trim(as_col(name)), r"^\.+|\.+$", ""), r"\.")


def primary_domain(name: Column | str) -> Column:
    return _registrable(_labels(name))


def health_primary_domain(name: Column | str) -> Column:
    """As primary_domain; unwraps cached-page hosts (a-b-com.cdn.ampproject.org) and a few hand-set aliases."""
    parts = _labels(name)
    cached = (F.size(parts) == 4) & (
        F.array_join(F.slice(parts, 2, 3), ".") == "cdn.ampproject.org"
    )
    source = F.when(cached, F.split(F.element_at(parts, 1), "-")).otherwise(parts)
    result = _registrable(source)
    for alias, target in tables.patterns(tables.PRIMARY_DOMAIN_ALIASES):
        result = F.when(as_col(name) == alias, F.lit(target)).otherwise(result)
    return result


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv4_number(ip: Column | str) -> Column:
    """IPv4 text as a number; NULL for anything else."""
    text = as_col(ip)
    number = F.aggregate(
        F.split(text, r"\."), F.lit(0).cast("bigint"), lambda high, octet: high * 256 + octet.try_cast("bigint")
    )
    return F.when(text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)


def ipv6_groups(ip: Column | str) -> Column:
    """IPv6 text of any spelling as eight four-digit groups in lower case; NULL for anything else.

    "::" stands for as many zero groups as are missing, and the last two groups may be written as an IPv4 address.
    """
    groups = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def without_tail(text: Column, tail: Column) -> Column:
        return F.when(tail == "", text).otherwise(_bound(
            F.lpad(F.lower(F.hex(ipv4_number(tail))), 8, "0"),
            lambda digits: F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail)),
                                    F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))))

    def joined(halves: Column, head: Column, rest: Column) -> Column:
        missing = F.when(F.size(halves) == 2, F.greatest(8 - F.size(head) - F.size(rest), F.lit(1))).otherwise(F.lit(0))
        return F.concat(head, F.array_repeat(F.lit("0"), missing), rest)

    def filled(halves: Column) -> Column:
        head = groups(F.get(halves, F.lit(0)))
        rest = F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        return _bound(head, lambda h: _bound(rest, lambda r: joined(halves, h, r)))

    def padded(parts: Column) -> Column:
        readable = (F.size(parts) == 8) & F.forall(parts, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(readable, F.array_join(F.transform(parts, lambda g: F.lpad(g, 4, "0")), ":"))

    def spelled_out(plain: Column) -> Column:
        return F.when(plain.contains(":"), _bound(_bound(F.split(plain, "::"), filled), padded))

    return _bound(F.lower(F.trim(as_col(ip))), lambda text: _bound(
        _bound(F.regexp_extract(text, r":(\d+\.\d+\.\d+\.\d+)$", 1), lambda tail: without_tail(text, tail)), spelled_out))


def ip_is_local(ip: Column | str) -> Column:
    """True where the address is not globally reachable, in any spelling; False for unreadable text."""
    nets = [ipaddress.ip_network(block) for block in tables.lines(tables.NOT_GLOBAL_IPV4)]
    in_block = lambda number: reduce(
        lambda a, b: a | b, [number.between(int(net.network_address), int(net.broadcast_address)) for net in nets])
    pattern6 = "|".join(tables.lines(tables.NOT_GLOBAL_IPV6))
    # The first is NULL for what is no IPv4 address.
    return F.coalesce(_bound(ipv4_number(ip), in_block), ipv6_groups(ip).rlike(pattern6), F.lit(False))


def protocol_name(protocol: Column | str, port: Column | str) -> Column:
    proto, port = as_col(protocol), as_col(port)
    result = F.lit(tables.OTHER_PROTOCOL)
    for number, name in tables.OTHER_NAMES.items():
        result = F.when(proto == number, F.lit(name)).otherwise(result)
    named: dict[tuple[int, str], list[int]] = {}
    for line in tables.lines(tables.PORT_NAMES):
        key, name = line.split(" | ")
        number, p = key.split()
        named.setdefault((int(number), name), []).append(int(p))
    for (number, name), ports in named.items():
        result = F.when((proto == number) & port.isin(ports), F.lit(name)).otherwise(result)
    return result


def is_health(name: Column | str) -> Column:
    """A health token occurs and no known false positive does."""
    text = F.lower(as_col(name))

    def any_of(words: list[str]) -> Column:
        return text.rlike("|".join(w.replace(".", r"\.") for w in words))

    return any_of(tables.HEALTH_TOKENS.split()) & ~any_of(tables.lines(tables.HEALTH_EXCLUSIONS))
