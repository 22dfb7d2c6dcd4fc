"""TLS fingerprints as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Version codes and protocol shorthands of the fingerprints.
VERSIONS = {0x0301: "10", 0x0302: "11", 0x0303: "12", 0x0304: "13"}
ALPN = {"h2": "h2", "http/1.1": "h1", "h3": "h3"}


def without_grease(values: Column) -> Column:
    """Drop reserved values: both bytes equal and ending in the digit a."""
    return F.filter(values, lambda v: ~((v.bitwiseAND(F.lit(0x0F0F)) == 0x0A0A) & (F.shiftright(v, 8) == v.bitwiseAND(F.lit(255)))))


def _joined(values: Column, sign: str) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), sign)


def ja3_text(version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column) -> Column:
    parts = [_joined(without_grease(x), "-") for x in (ciphers, extensions, curves)]
    return F.concat_ws(",", version.cast("string"), *parts, _joined(formats, "-"))


def ja3(*args: Column) -> Column:
    return F.md5(ja3_text(*args))


def ja4(version: Column, ciphers: Column, extensions: Column, sni: Column, alpn: Column) -> Column:
    """Variant with decimal values, all extensions and no signature algorithms."""
    c, e = without_grease(ciphers), without_grease(extensions)
    code = F.lit("00")
    for number, text in VERSIONS.items():
        code = F.when(version == number, text).otherwise(code)
    first = F.when(alpn.isNull(), "00")
    for name, short in ALPN.items():
        first = first.when(alpn == name, short)
    first = first.otherwise(F.rpad(F.substring(alpn, 1, 2), 2, "0"))
    count = [F.lpad(F.least(F.size(x), F.lit(99)).cast("string"), 2, "0") for x in (c, e)]
    named = F.when(F.coalesce(sni, F.lit("")) != "", "d").otherwise("i")
    digest = [F.substring(F.sha2(_joined(F.array_sort(x), ","), 256), 1, 12) for x in (c, e)]
    return F.concat_ws("_", F.concat(F.lit("t"), code, named, *count, first), *digest)


def option_digest(options: Column, numeric: bool = True) -> Column:
    """md5 of a comma list of option numbers, sorted as numbers or as text."""
    parts = F.split(options, ",")
    if numeric:
        ordered = F.array_join(F.transform(F.array_sort(F.transform(parts, lambda x: x.cast("int"))), lambda x: x.cast("string")), ",")
    else:
        ordered = F.array_join(F.array_sort(parts), ",")
    return F.md5(ordered)
