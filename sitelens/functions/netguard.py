"""Which hosts a crawler must not reach: private, local and reserved addresses and names."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import host_of

# Blocked host names and IPv4 ranges.
BLOCKED_HOSTS = ["localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "metadata.google.internal"]
BLOCKED_RANGES = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4"]
_V4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def ipv4_to_int(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return reduce(lambda total, k: total * 256 + F.get(parts, F.lit(k)).cast("long"), range(1, 4), F.get(parts, F.lit(0)).cast("long"))


def in_range(ip: Column, cidr: str) -> Column:
    start, bits = cidr.split("/")
    first = reduce(lambda t, p: t * 256 + int(p), start.split("."), 0)
    size = 1 << (32 - int(bits))
    return ipv4_to_int(ip).between(first // size * size, first // size * size + size - 1)


def is_private_ip(ip: Column) -> Column:
    """True of private and reserved addresses, and of what is no address."""
    bare = F.regexp_replace(F.lower(ip), r"^\[|\]$", "")
    mapped = F.regexp_extract(bare, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    v4 = F.when(bare.rlike(_V4), bare).when(mapped.rlike(_V4), mapped)
    local_v6 = bare.isin("::", "::1") | bare.rlike(r"^f[cd]") | bare.rlike(r"^fe[89ab]")
    private_v4 = reduce(Column.__or__, [in_range(v4, r) for r in BLOCKED_RANGES])
    return F.coalesce(F.when(v4.isNotNull(), private_v4).when(bare.contains(":"), local_v6).otherwise(True), F.lit(True))


def is_private_address(ip: str) -> bool:
    """The same of one address, for a fetcher."""
    try:
        address = ipaddress.ip_address(ip.strip("[]").split("%")[0])
    except ValueError:
        return True
    address = getattr(address, "ipv4_mapped", None) or address
    if address.version == 4:
        return any(address in ipaddress.ip_network(r) for r in BLOCKED_RANGES)
    return address in (ipaddress.ip_address("::"), ipaddress.ip_address("::1")) or any(address in ipaddress.ip_network(r) for r in ("fc00::/7", "fe80::/10"))


def url_verdict(url: Column) -> Column:
    """Null if the URL may be fetched as far as can be told without DNS, else why not."""
    bracketed = F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?\[([0-9A-Fa-f:.]+)\]", 1)
    host = F.when(bracketed != "", bracketed).otherwise(host_of(url))
    is_ip = host.rlike(_V4) | host.contains(":")
    return (
        F.when(url.isNull() | (host == ""), "INVALID_URL")
        .when(~F.lower(url).rlike("^https?:"), "PROTOCOL")
        .when(host.isin(BLOCKED_HOSTS) | F.endswith(host, F.lit(".localhost")), "BLOCKED_HOST")
        .when(is_ip & is_private_ip(host), "PRIVATE_IP")
    )
