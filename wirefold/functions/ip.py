"""IPv4 expressions over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
NO_IP = 4294967295

# IPv4 ranges that are not public (first, last).
PRIVATE = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.168.0.0", "192.168.255.255"),
]


def number(text: str) -> int:
    a, b, c, d = map(int, text.split("."))
    return a << 24 | b << 16 | c << 8 | d


def to_number(ip: Column) -> Column:
    """Numeric sort key; what is no IPv4 address sorts last."""
    part = F.split(ip, r"\.")
    value = sum((F.element_at(part, i + 1).cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(ip.rlike(IPV4), value).otherwise(F.lit(NO_IP))


def subnet(ip: Column, bits: int = 24) -> Column:
    """Network of an address in CIDR notation; null if it is no IPv4 address."""
    net = F.shiftleft(F.shiftright(to_number(ip), 32 - bits), 32 - bits)
    octets = [F.shiftright(net, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(ip.rlike(IPV4), F.concat(F.concat_ws(".", *octets), F.lit(f"/{bits}")))


def private(ip: Column) -> Column:
    n = to_number(ip)
    out = F.lit(False)
    for low, high in PRIVATE:
        out = out | n.between(number(low), number(high))
    return F.coalesce(out, F.lit(False))


def initial_ttl(ttl: Column) -> Column:
    """Likely initial time to live."""
    return F.when(ttl <= 64, 64).when(ttl <= 128, 128).when(ttl <= 255, 255)


def ttl_class(ttl: Column) -> Column:
    return F.when(ttl <= 64, "unix-like").when(ttl <= 128, "windows").when(ttl <= 255, "network")
