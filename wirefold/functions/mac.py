"""Hardware-address expressions (text columns like ``aa:bb:cc:dd:ee:ff``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of virtual interfaces that set the local bit without
# being randomized.
VIRTUAL_PREFIXES = ["02:42", "02:50:56", "52:54:00"]
MAC = r"^[0-9a-f]{2}(:[0-9a-f]{2}){5}$"


def normalised(mac: Column) -> Column:
    """Lower-case, colon-separated form; null if it is no address."""
    bare = F.lower(F.regexp_replace(mac, "[:.-]", ""))
    pairs = F.regexp_replace(bare, "(..)(?!$)", "$1:")
    return F.when(bare.rlike("^[0-9a-f]{12}$"), pairs)


def prefix(mac: Column, octets: int = 3) -> Column:
    """Upper-case vendor prefix of so many octets."""
    return F.upper(F.substring(mac, 1, 3 * octets - 1))


def local_bit(mac: Column) -> Column:
    """The locally-administered bit, whatever the prefix."""
    return F.conv(F.substring(mac, 1, 2), 16, 10).cast("int").bitwiseAND(F.lit(2)) != 0


def randomized(mac: Column) -> Column:
    """Locally administered and not a known virtual interface."""
    virtual = F.lit(False)
    for p in VIRTUAL_PREFIXES:
        virtual = virtual | F.lower(mac).startswith(p)
    return local_bit(mac) & ~virtual


def unicast(mac: Column) -> Column:
    """A well-formed address that is neither broadcast nor all zero."""
    low = F.lower(mac)
    return F.coalesce(low.rlike(MAC) & ~low.isin("ff:ff:ff:ff:ff:ff", "00:00:00:00:00:00"), F.lit(False))


def eui64(mac: Column) -> Column:
    """Interface identifier (16 hex digits) that SLAAC derives from an address."""
    bare = F.regexp_replace(F.lower(mac), ":", "")
    flipped = F.lpad(F.lower(F.hex(F.conv(F.substring(bare, 1, 2), 16, 10).cast("int").bitwiseXOR(F.lit(2)).cast("long"))), 2, "0")
    return F.concat(flipped, F.substring(bare, 3, 4), F.lit("fffe"), F.substring(bare, 7, 6))
