"""Service banners and fingerprint feeds over texts and payloads made of keys.

Spark builds the bytes and matches them; the SQL states the fields straight
from the keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups
from ..operators.banners import FIELDS, MATCHERS, identified
from ..sources import feeds
from ..sources.json_array import read_array
from ..sources.shared import fresh
from .base import query
from .records import hexed, n, zeros

_V = "concat(k, '.', user_id % 10)"  # a version
_DV = "k || '.' || (user_id % 10)"
_JSON = "concat('HTTP/1.1 200 OK', char(10), '{{{}: \"', k, '.', user_id % 10, '\"}}')"
_DJSON = "'HTTP/1.1 200 OK' || chr(10) || '{{{}: \"' || k || '.' || (user_id % 10) || '\"}}'"


def _text(spark: str) -> list[str]:
    return [hexed(spark)]


_MAGIC = f"concat({n('254 + k % 2')}, '534d42')"
_STATUS = f"concat(hex('server_version'), '00', {hexed(_V)}, '00')"

#: Service: hexadecimal parts of its payload (Spark), and the fields that follow (SQL).
#: ``raw`` is the payload's own hexadecimal text, up to a number of bytes.
CASES: dict[str, tuple[list[str], dict[str, str]]] = {
    "ssh": (_text(f"concat('SSH-2.0-OpenSSH_', {_V}, 'p1 Ubuntu', char(13), char(10))"), {"software": "'OpenSSH'", "version": f"{_DV} || 'p1'", "proto_version": "'2.0'", "raw_banner": f"'SSH-2.0-OpenSSH_' || {_DV} || 'p1 Ubuntu'"}),
    "ftp": (_text(f"concat('220 (vsFTPd ', {_V}, ' x)')"), {"software": "'vsFTPd'", "version": _DV, "raw_banner": f"'220 (vsFTPd ' || {_DV} || ' x)'"}),
    "smtp": (_text("concat('220 mx', k, ' ESMTP Postfix', user_id % 10)"), {"software": "'Postfix' || (user_id % 10)", "raw_banner": "'220 mx' || k || ' ESMTP Postfix' || (user_id % 10)"}),
    "imap": (_text("concat('* OK [', k, '] Dovecot ready')"), {"software": "'Dovecot'", "raw_banner": "'* OK [' || k || '] Dovecot ready'"}),
    "pop3": (_text("concat('+OK host', k, ' ready')"), {"software": "'host' || k", "raw_banner": "'+OK host' || k || ' ready'"}),
    "telnet": (_text("concat('Router', k, ' Login: ')"), {"raw_banner": "'router' || k || ' login:'"}),
    "vnc": (_text("concat('RFB 003.', lpad(cast(k AS string), 3, '0'), char(10))"), {"version": "'003.' || lpad(k::VARCHAR, 3, '0')", "raw_banner": "'RFB 003.' || lpad(k::VARCHAR, 3, '0')"}),
    "irc": (_text("concat(':irc', k, ' 001 me')"), {"raw_banner": "':irc' || k || ' 001 me'"}),
    "mysql": (["4a0000000a", hexed(f"if(k % 2 = 0, {_V}, concat('5.5.5-10.', {_V}, '-MariaDB'))"), "00", zeros(8)], {"software": "CASE WHEN k % 2 = 0 THEN 'MySQL' ELSE 'MariaDB' END", "version": f"CASE WHEN k % 2 = 0 THEN {_DV} ELSE '10.' || {_DV} END", "raw_banner": f"CASE WHEN k % 2 = 0 THEN {_DV} ELSE '5.5.5-10.' || {_DV} || '-MariaDB' END"}),
    "postgresql": (["5200000008", zeros(4), "53", n(f"length({_V}) + 20", 4), _STATUS], {"software": "'PostgreSQL'", "version": _DV, "raw_banner": "raw"}),
    "mssql": (["0401", n("k", 2)], {"software": "'MSSQL'", "raw_banner": "raw"}),
    "mongodb": ([n("k", 4), zeros(8), "dd070000", hexed(f"concat('\"version\" : \"', {_V}, '\"')")], {"software": "'MongoDB'", "version": _DV, "raw_banner": "raw"}),
    "redis": (_text(f"concat('$9', char(13), char(10), 'redis_version:', {_V})"), {"version": _DV, "raw_banner": f"'$9' || chr(13) || chr(10) || 'redis_version:' || {_DV}"}),
    "smb": (["00000040", _MAGIC, n("user_id", 4), zeros(30)], {"smb_version": "CASE WHEN k % 2 = 0 THEN '2' ELSE '1' END", "raw_banner": "substr(raw, 1, 64)"}),
    "rdp": (["030000130ed0", n("k", 2)], {"raw_banner": "raw"}),
    "ipp": (_text("concat('HTTP/1.1 200', char(10), 'Content-Type: application/IPP', char(10), 'Server: CUPS/', k, ' ', char(10))"), {"software": "'CUPS/' || k", "raw_banner": "'HTTP/1.1 200' || chr(10) || 'Content-Type: application/IPP' || chr(10) || 'Server: CUPS/' || k"}),
    "jetdirect": (_text("concat('@PJL INFO ', k)"), {"raw_banner": "'@PJL INFO ' || k"}),
    "lpd": (_text("concat('No QUEUE ', k)"), {"raw_banner": "'no queue ' || k"}),
    "mqtt": (["200200", n("k")], {"connect_return_code": "k", "raw_banner": "raw"}),
    "sip": (_text("concat('SIP/2.0 200 OK', char(10), 'Server: Asterisk ', k, char(10))"), {"software": "'Asterisk ' || k", "raw_banner": "'SIP/2.0 200 OK' || chr(10) || 'Server: Asterisk ' || k"}),
    "rtsp": (_text("concat('RTSP/1.0 200 OK', char(10), 'CSeq: ', k)"), {"raw_banner": "'RTSP/1.0 200 OK' || chr(10) || 'CSeq: ' || k"}),
    "ldap": (["300c020101", "61", n("k"), zeros(12)], {"raw_banner": "substr(raw, 1, 32)"}),
    "cassandra": ([n("128 + k % 100"), "0000", "06", n("k", 6)], {"raw_banner": "substr(raw, 1, 16)"}),
    "elasticsearch": (_text(_JSON.format('"cluster_name":"c","number"')), {"software": "'Elasticsearch'", "version": _DV, "raw_banner": _DJSON.format('"cluster_name":"c","number"')}),
    "amqp": (["414d5150", "00", n("k % 10"), n("user_id % 10"), "01", "ff"], {"proto_version": "(k % 10) || '.' || (user_id % 10) || '.1'", "raw_banner": "substr(raw, 1, 16)"}),
    "docker_api": (_text(_JSON.format('"ApiVersion"')), {"software": "'Docker'", "version": _DV, "raw_banner": _DJSON.format('"ApiVersion"')}),
    "kubernetes_api": (_text(_JSON.format('"kind": "Status","gitVersion"')), {"software": "'Kubernetes'", "version": _DV, "raw_banner": _DJSON.format('"kind": "Status","gitVersion"')}),
    "socks": (["05", n("k")], {"version": "'5'", "raw_banner": "raw"}),
    "bgp": (["ff" * 16, "001d01", n("k % 5"), n("user_id % 65536", 2), n("k")], {"version": "(k % 5)::VARCHAR", "as_number": "user_id % 65536", "raw_banner": "substr(raw, 1, 42)"}),
    "pptp": ([n("k", 8), "00010002", zeros(30)], {"raw_banner": "substr(raw, 1, 64)"}),
    "unifiprotect": (["160303", n("k", 2), zeros(6)], {"software": "'UniFi Protect'", "raw_banner": "substr(raw, 1, 16)"}),
}
#: SQL of the payloads whose hexadecimal text is part of the result.
_BYTE = "printf('%02x', {})"
_WIDE = "printf('%0{}x', {})"
_RAW = {
    "postgresql": f"'5200000008' || '00000000' || '53' || {_WIDE.format(8, f'length({_DV}) + 20')} || lower(hex('server_version')) || '00' || lower(hex({_DV})) || '00'",
    "mssql": f"'0401' || {_WIDE.format(4, 'k')}", "mongodb": f"{_WIDE.format(8, 'k')} || repeat('00', 8) || 'dd070000' || lower(hex('\"version\" : \"' || {_DV} || '\"'))",
    "smb": f"'00000040' || CASE WHEN k % 2 = 0 THEN 'fe' ELSE 'ff' END || '534d42' || {_WIDE.format(8, 'user_id')} || repeat('00', 30)", "rdp": f"'030000130ed0' || {_WIDE.format(4, 'k')}",
    "mqtt": f"'200200' || {_BYTE.format('k')}", "ldap": f"'300c02010161' || {_BYTE.format('k')} || repeat('00', 12)", "cassandra": f"{_BYTE.format('128 + k % 100')} || '000006' || {_WIDE.format(12, 'k')}",
    "amqp": f"'414d515000' || {_BYTE.format('k % 10')} || {_BYTE.format('user_id % 10')} || '01ff'", "socks": f"'05' || {_BYTE.format('k')}",
    "bgp": f"repeat('ff', 16) || '001d01' || {_BYTE.format('k % 5')} || {_WIDE.format(4, 'user_id % 65536')} || {_BYTE.format('k')}", "pptp": f"{_WIDE.format(16, 'k')} || '00010002' || repeat('00', 30)",
    "unifiprotect": f"'160303' || {_WIDE.format(4, 'k')} || repeat('00', 6)",
}


def _sql() -> str:
    names = list(CASES)
    service = "CASE s " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(names)) + " END"
    raw = "CASE s " + " ".join(f"WHEN {names.index(name)} THEN {sql}" for name, sql in _RAW.items()) + " END"
    fields = []
    for field, kind in FIELDS.items():
        if field != "service":
            some = " ".join(f"WHEN {i} THEN {CASES[name][1][field]}" for i, name in enumerate(names) if field in CASES[name][1])
            fields.append(f"CASE WHEN user_id % 7 > 0 THEN CASE s {some} END END::{'INT' if kind == 'int' else 'VARCHAR'} AS {field}")
    return f"""SELECT packet_id, service AS hint, CASE WHEN user_id % 7 > 0 THEN service END AS service, {", ".join(fields)}
  FROM (SELECT *, {service} AS service, {raw} AS raw FROM (SELECT packet_id, k, user_id, packet_id % {len(names)} AS s FROM packets))"""


@query("p21_service_banners", _sql())
def _(t):
    assert set(CASES) == set(MATCHERS)
    s, payload, hint = F.col("packet_id") % len(CASES), F.lit(None), F.lit(None)
    for i, (name, (parts, _)) in enumerate(CASES.items()):
        one = F.concat(*[F.lit(x) if all(c in "0123456789abcdef" for c in x) else F.expr(x) for x in parts])
        payload, hint = (F.when(s == i, one), F.when(s == i, name)) if i == 0 else (payload.when(s == i, one), hint.when(s == i, name))
    broken = F.when(F.col("user_id") % 7 > 0, payload).otherwise("7f")
    rows = t.packets.select("packet_id", hint.alias("hint"), F.unhex(broken).alias("payload"))
    return identified(rows, "hint").select("packet_id", "hint", *[F.col(f"banner.{name}").alias(name) for name in FIELDS])


@query("s13_fingerprint_feed", """SELECT l_orderkey, l_linenumber, l_linenumber % 3 < 2 AS known, CASE WHEN l_linenumber % 3 < 2 THEN p_name END AS description,
    CASE WHEN l_linenumber % 3 < 2 THEN 'maker' || (p_partkey % 9) END AS vendor, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber || '.' || (l_suppkey % 10) END AS version
  FROM lineitem JOIN part ON p_partkey = l_partkey""")
def _(t):
    # A feed of a fingerprint for each part, as XML files; its pattern has a literal, classes and an optional group.
    part = t.raw("part")
    text = F.format_string('<fingerprint pattern="^(?:server|SRV) part-%s/?(?:v(\\d+\\.\\d))?$"><description>%s</description><param pos="0" name="vendor" value="maker%s"/><param pos="1" name="version"/></fingerprint>',
                           F.col("p_partkey").cast("string"), "p_name", (F.col("p_partkey") % 9).cast("string"))
    folder = fresh(t.spark, "fingerprints")
    # A file, with one root element, for each thousand parts.
    files = part.select(F.floor(F.col("p_partkey") / 1000).alias("file"), text.alias("rule")).groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("rule")), "\n").alias("rules"))
    files.select("file", F.concat(F.lit("<fingerprints>\n"), "rules", F.lit("\n</fingerprints>")).alias("value")).repartition("file").write.partitionBy("file").text(folder)
    key = F.concat(F.lit("part-"), F.col("l_partkey").cast("string"))
    versioned = F.concat(F.lit("server "), key, F.lit("/v"), F.col("l_linenumber").cast("string"), F.lit("."), (F.col("l_suppkey") % 10).cast("string"))
    banner = F.when(F.col("l_linenumber") % 3 == 0, versioned).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("SRV "), key)).otherwise(F.concat(key, F.lit(" alone")))
    rows = t.raw("lineitem").select("l_orderkey", "l_linenumber", banner.alias("banner"))
    out = lookups.fingerprint_join(rows, "banner", feeds.recog_rules(t.spark, folder))
    return out.select("l_orderkey", "l_linenumber", F.col("description").isNotNull().alias("known"), "description", F.col("stated")["vendor"].alias("vendor"), F.col("stated")["version"].alias("version"))


@query("s14_json_array", "SELECT o_orderkey AS id, o_orderpriority || '\"[' || (o_custkey % 7) || ',]\\' AS name, [o_custkey, o_orderkey % 5] AS tags FROM orders")
def _(t):
    # Files of an array each; the names hold quotes, brackets, commas and backslashes.
    name = F.concat("o_orderpriority", F.lit('"['), (F.col("o_custkey") % 7).cast("string"), F.lit(",]\\"))
    row = F.struct(F.col("o_orderkey").alias("id"), name.alias("name"), F.array("o_custkey", F.col("o_orderkey") % 5).alias("tags"))
    files = t.raw("orders").groupBy(F.floor(F.col("o_orderkey") / 4000).alias("file")).agg(F.to_json(F.collect_list(row)).alias("value"))
    folder = fresh(t.spark, "arrays")
    files.repartition("file").write.partitionBy("file").text(folder)
    return read_array(t.spark, folder, "id long, name string, tags array<long>", split=1 << 15)
