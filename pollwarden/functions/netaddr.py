"""IPv4 predicates as column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: four decimal octets, no leading zeros, nothing around them.
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


def ipv4_number(ip: Column) -> Column:
    """Dotted quad to integer; NULL when the text is not an address."""
    text = F.trim(ip)
    parts = F.split(text, r"\.")
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value * 256 + F.try_element_at(parts, F.lit(i + 1)).try_cast("long")
    return F.when(text.rlike(IPV4), value)


def in_cidr(ip: Column, cidr: str) -> Column:
    net = ipaddress.ip_network(cidr, strict=False)
    low, high = int(net.network_address), int(net.broadcast_address)
    return F.coalesce(ipv4_number(ip).between(low, high), F.lit(False))


def allowed_host(ip: Column, hosts: list[str], cidr: str) -> Column:
    """Listed by name, or inside the lab network."""
    return F.coalesce(F.trim(ip).isin(hosts), F.lit(False)) | in_cidr(ip, cidr)
