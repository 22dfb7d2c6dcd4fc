"""Service banners: what a server's first bytes say, by the service its port suggests.

All native column expressions on the payload's bytes (as hexadecimal text) and
on its text, in which bytes beyond ASCII are replaced.  A payload that does not
fit its service gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a payload that are looked at.
LIMIT = 2048
FIELDS = {
    "service": "string", "software": "string", "version": "string", "proto_version": "string", "smb_version": "string", "connect_return_code": "int",
    "as_number": "int", "raw_banner": "string",
}
# White space and its complement, ASCII only.
_S, _N = r"[\t-\r\x1c-\x20]", r"[^\t-\r\x1c-\x20]"
_SERVER = rf"(?d)Server:{_S}*(.+?)(?:\r?\n)"


class Payload:
    """A payload as text, hexadecimal text and length."""

    def __init__(self, payload: Column) -> None:
        cut = F.substring(payload, 1, LIMIT)
        self.size = F.length(cut)
        self.text = F.regexp_replace(F.decode(cut, "ISO-8859-1"), r"[^\x00-\x7F]", "\N{REPLACEMENT CHARACTER}")
        self.low = F.lower(self.text)
        self.hexed = F.lower(F.hex(cut))

    def bytes(self, at: int, n: int) -> Column:
        """Hexadecimal text of ``n`` bytes from ``at`` on, or what there is of them."""
        return F.substring(self.hexed, 2 * at + 1, 2 * n)

    def number(self, at: int, n: int = 1) -> Column:
        return F.conv(self.bytes(at, n), 16, 10).cast("long")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_S}+|{_S}+\z", "")


def _group(text: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, n))


def _hit(service: str, raw: Column, **fields: Column | str) -> Column:
    known = {"service": service, "raw_banner": raw} | fields
    one = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    return F.struct(*[one(known.get(name), kind).alias(name) for name, kind in FIELDS.items()])


def _ssh(p: Payload) -> Column:
    head = rf"\ASSH-({_N}+)-({_N}+)"
    named = F.regexp_extract(p.text, head, 2)
    parts = rf"(?d)\A(.+?)[-_](\d{_N}*)"
    hit = _hit("ssh", _trimmed(p.text), software=F.coalesce(_group(named, parts), named), version=_group(named, parts, 2), proto_version=F.regexp_extract(p.text, head, 1))
    return F.when(p.text.rlike(head), hit)


def _ftp(p: Payload) -> Column:
    both, name = rf"220[ -]\(?(\w{_N}+?)(?:{_S}|_)+(\d[\d.]*{_N}*)", rf"220[ -]\(?(\w{{2,}}{_N}*)"
    greeting = lambda c: c.isin("Welcome", "Service")
    versioned = p.text.rlike(both) & ~greeting(F.regexp_extract(p.text, both, 1))
    alone = _group(p.text, name)
    software = F.when(versioned, _group(p.text, both)).when(~p.text.rlike(both) & ~greeting(alone), alone)
    return F.when(p.text.startswith("220 ") | p.text.startswith("220-"), _hit("ftp", _trimmed(p.text), software=software, version=F.when(versioned, _group(p.text, both, 2))))


def _smtp(p: Payload) -> Column:
    return F.when(p.text.startswith("220") & F.upper(p.text).contains("SMTP"), _hit("smtp", _trimmed(p.text), software=_group(p.text, rf"(?:ESMTP|SMTP){_S}+({_N}+)")))


def _imap(p: Payload) -> Column:
    return F.when(p.text.startswith("* OK"), _hit("imap", _trimmed(p.text), software=_group(p.text, rf"\]{_S}+({_N}+)")))


def _pop3(p: Payload) -> Column:
    return F.when(p.text.startswith("+OK"), _hit("pop3", _trimmed(p.text), software=_group(p.text, rf"\+OK{_S}+({_N}+)")))


def _telnet(p: Payload) -> Column:
    return F.when(p.bytes(0, 2).isin("fffb", "fffd"), _hit("telnet", p.hexed)).when(p.low.contains("login:"), _hit("telnet", _trimmed(p.low)))


def _vnc(p: Payload) -> Column:
    head = rf"\ARFB{_S}+(\d{{3}}\.\d{{3}})"
    return F.when(p.text.rlike(head), _hit("vnc", _trimmed(p.text), version=_group(p.text, head)))


def _irc(p: Payload) -> Column:
    return F.when(p.text.contains("NOTICE") | p.text.rlike(rf"\A:{_N}+{_S}+\d{{3}}"), _hit("irc", _trimmed(p.text)))


def _mysql(p: Payload) -> Column:
    rest = F.substring(p.text, 6, LIMIT)
    stated = F.substring_index(rest, "\0", 1)
    maria = stated.contains("MariaDB")
    hit = _hit("mysql", stated, software=F.when(maria, "MariaDB").otherwise("MySQL"), version=F.when(maria, F.coalesce(_group(stated, r"(\d+\.\d+\.\d+)-MariaDB"), stated)).otherwise(stated))
    return F.when((p.size >= 6) & (p.bytes(4, 1) == "0a") & rest.contains("\0"), hit)


def _postgresql(p: Payload) -> Column:
    """The server's version is in the first status message of that name; messages follow one another."""

    def step(state: Column, i: Column) -> Column:
        n = F.conv(p.hexed.substr(2 * i + 3, F.lit(8)), 16, 10).cast("long")
        message = (p.text.substr(i + 1, F.lit(1)) == "S") & (i + 4 < p.size)
        body = p.text.substr(i + 6, F.greatest(n - 4, F.lit(0)).cast("int"))
        name = "server_version\0"
        found = F.when(message & body.startswith(name), F.substring_index(F.substring(body, len(name) + 1, LIMIT), "\0", 1))
        moved = F.struct(F.when(message, i + 1 + n).otherwise(i + 1).cast("long").alias("next"), found.alias("version"))
        return F.when(state["version"].isNotNull() | (i != state["next"]), state).otherwise(moved)

    start = F.struct(F.lit(0).cast("long").alias("next"), F.lit(None).cast("string").alias("version"))
    version = F.aggregate(F.sequence(F.lit(0), p.size - 1), start, step, lambda s: s["version"])
    return F.when(p.text.substr(1, 1).isin("R", "S", "E"), _hit("postgresql", p.hexed, software="PostgreSQL", version=version))


def _mssql(p: Payload) -> Column:
    return F.when(p.bytes(0, 1) == "04", _hit("mssql", p.hexed, software="MSSQL"))


def _mongodb(p: Payload) -> Column:
    known = p.bytes(12, 4).isin("01000000", "dd070000")
    return F.when((p.size >= 16) & known, _hit("mongodb", p.hexed, software="MongoDB", version=_group(p.text, rf'"version"{_S}*:{_S}*"([\d.]+)"')))


def _redis(p: Payload) -> Column:
    return F.when(p.text.substr(1, 1).isin(*"+-$*:"), _hit("redis", _trimmed(p.text), version=_group(p.text, r"redis_version:([\d.]+)")))


def _smb(p: Payload) -> Column:
    magic = p.bytes(4, 4)
    return F.when(magic.isin("fe534d42", "ff534d42"), _hit("smb", p.bytes(0, 32), smb_version=F.when(magic == "fe534d42", "2").otherwise("1")))


def _rdp(p: Payload) -> Column:
    return F.when((p.bytes(0, 1) == "03") & (p.bytes(5, 1) == "d0"), _hit("rdp", p.hexed))


def _served(service: str, fits: Callable[[Payload], Column]) -> Callable[[Payload], Column]:
    """Text protocols that name their software in a Server line."""
    return lambda p: F.when(fits(p), _hit(service, _trimmed(p.text), software=_trimmed(_group(p.text, _SERVER))))


def _jetdirect(p: Payload) -> Column:
    return F.when(p.text.startswith("@PJL"), _hit("jetdirect", _trimmed(p.text)))


def _lpd(p: Payload) -> Column:
    return F.when(p.low.contains("printer") | p.low.contains("queue") | p.low.contains("lpd"), _hit("lpd", _trimmed(p.low)))


def _mqtt(p: Payload) -> Column:
    return F.when((p.size >= 4) & (p.bytes(0, 1) == "20"), _hit("mqtt", p.bytes(0, 4), connect_return_code=p.number(3)))


def _ldap(p: Payload) -> Column:
    tags = F.transform(F.sequence(F.lit(2), F.greatest(F.least(p.size, F.lit(16)) - 1, F.lit(2))), lambda i: p.hexed.substr(2 * i + 1, F.lit(2)))
    return F.when((p.size >= 6) & (p.bytes(0, 1) == "30") & F.exists(tags, lambda x: x.isin("61", "65")), _hit("ldap", p.bytes(0, 16)))


def _cassandra(p: Payload) -> Column:
    return F.when((p.number(0) >= 128) & p.bytes(3, 1).isin("02", "06"), _hit("cassandra", p.bytes(0, 8)))


def _http(p: Payload) -> Column:
    return p.text.startswith("HTTP/")


def _elasticsearch(p: Payload) -> Column:
    return F.when(_http(p) & p.text.contains('"cluster_name"'), _hit("elasticsearch", _trimmed(p.text), software="Elasticsearch", version=_group(p.text, rf'"number"{_S}*:{_S}*"([\d.]+)"')))


def _amqp(p: Payload) -> Column:
    spoken = F.when(p.size >= 8, F.concat_ws(".", *[p.number(i).cast("string") for i in (5, 6, 7)]))
    return F.when((p.size >= 4) & (p.bytes(0, 4) == "414d5150"), _hit("amqp", p.bytes(0, 8), proto_version=spoken)).when((p.size >= 4) & (p.bytes(0, 1) == "01"), _hit("amqp", p.bytes(0, 16)))


def _docker(p: Payload) -> Column:
    return F.when(_http(p) & p.text.contains('"ApiVersion"'), _hit("docker_api", _trimmed(p.text), software="Docker", version=_group(p.text, rf'"ApiVersion"{_S}*:{_S}*"([^"]+)"')))


def _kubernetes(p: Payload) -> Column:
    says = (p.text.contains('"major"') & p.text.contains('"minor"')) | p.text.contains('"kind":"Status"') | p.text.contains('"kind": "Status"')
    return F.when(_http(p) & says, _hit("kubernetes_api", _trimmed(p.text), software="Kubernetes", version=_group(p.text, rf'"gitVersion"{_S}*:{_S}*"([^"]+)"')))


def _socks(p: Payload) -> Column:
    return F.when((p.size >= 2) & (p.bytes(0, 1) == "05"), _hit("socks", p.bytes(0, 2), version="5")).when(p.bytes(0, 2) == "005a", _hit("socks", p.bytes(0, 8), version="4"))


def _bgp(p: Payload) -> Column:
    opened = (p.size >= 21) & (p.bytes(0, 16) == "ff" * 16) & (p.bytes(18, 1) == "01")
    return F.when(opened, _hit("bgp", p.bytes(0, 21), version=p.number(19).cast("string"), as_number=F.when(p.size >= 22, p.number(20, 2))))


def _pptp(p: Payload) -> Column:
    return F.when((p.size >= 12) & (p.bytes(8, 4) == "00010002"), _hit("pptp", p.bytes(0, 32)))


def _unifi(p: Payload) -> Column:
    software = F.coalesce(_trimmed(_group(p.text, _SERVER)), F.lit("UniFi Protect"))
    hello = (p.bytes(0, 1) == "16") & (p.size >= 5)
    return F.when(hello, _hit("unifiprotect", p.bytes(0, 8), software="UniFi Protect")).when(_http(p), _hit("unifiprotect", _trimmed(F.substring(p.text, 1, 256)), software=software))


MATCHERS: dict[str, Callable[[Payload], Column]] = {
    "ssh": _ssh, "ftp": _ftp, "smtp": _smtp, "imap": _imap, "pop3": _pop3, "telnet": _telnet, "vnc": _vnc, "irc": _irc, "mysql": _mysql,
    "postgresql": _postgresql, "mssql": _mssql, "mongodb": _mongodb, "redis": _redis, "smb": _smb, "rdp": _rdp,
    "ipp": _served("ipp", lambda p: p.low.contains("application/ipp")), "jetdirect": _jetdirect, "lpd": _lpd, "mqtt": _mqtt,
    "sip": _served("sip", lambda p: p.text.startswith("SIP/") | p.text.contains("SIP/2.0")), "rtsp": _served("rtsp", lambda p: p.text.startswith("RTSP/")),
    "ldap": _ldap, "cassandra": _cassandra, "elasticsearch": _elasticsearch, "amqp": _amqp, "docker_api": _docker, "kubernetes_api": _kubernetes,
    "socks": _socks, "bgp": _bgp, "pptp": _pptp, "unifiprotect": _unifi,
}


def identified(df: DataFrame, service: str = "service", payload: str = "payload") -> DataFrame:
    """Adds ``banner``, a struct of FIELDS, or null where the payload does not fit.

    Empty or null payloads and unknown services give null; a service's name
    may be in any case.
    """
    p, name = Payload(F.col(payload)), F.lower(F.col(service))
    out = F.lit(None)
    for key, match in MATCHERS.items():
        out = F.when(name == key, match(p)) if key == "ssh" else out.when(name == key, match(p))
    return df.withColumn("banner", F.when(p.size > 0, out))
