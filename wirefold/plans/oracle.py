"""SQL twins of the adapter views, prefixed to a query's own SQL as needed."""

from __future__ import annotations

import re

from ..sources import adapters as A


def literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def pick(index: str, values: list) -> str:
    return f"list_extract([{', '.join(map(literal, values))}], (({index}) % {len(values)} + 1)::INT)"


def mapped(key: str, values: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in values.items()) + " END"


def mac_of(n: str) -> str:
    return (
        f"(CASE WHEN ({n}) % 5 = 0 THEN 'd2' ELSE '00' END || ':1a:2b:' || printf('%02x', (({n}) // 65536) % 256) || ':' "
        f"|| printf('%02x', (({n}) // 256) % 256) || ':' || printf('%02x', ({n}) % 256))"
    )


def values(rows: list[tuple], names: str) -> str:
    """A constant table as a FROM item."""
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS {names}"


_IP = "'10.0.' || (k % 4) || '.' || (k % 20 + 1)"
_RULE = pick("substr(o_orderpriority, 1, 1)::INT - 1", A.RULES)

VIEWS = {
    "packets": f"""
  SELECT event_id AS packet_id, epoch_us(ts) AS us, user_id, {mac_of("user_id")} AS hw_addr, k, {mapped("event_type", A.PROTOCOLS)} AS protocol,
         {_IP} AS ip_addr, k % 2 + 1 AS op, CASE WHEN k % 3 = 0 THEN {_IP} ELSE '10.0.0.1' END AS target_ip, {pick("k", [64, 128, 255])} AS ttl,
         {pick("k", A.DOMAINS)} AS query_name, 'eth' || (user_id % 2) AS interface, (k + 1) / 100.0::DOUBLE AS certainty, {pick("k", A.PORTS)} AS port,
         {pick("user_id", A.HOSTNAMES)} AS hostname, {pick("k", A.OPT55)} AS opt55, {pick("k", A.OPT60)} AS opt60, {pick("k", A.AGENTS)} AS user_agent,
         {pick("k", A.SERVICES)} AS service, {pick("k", A.BANNERS)} AS banner, value
  FROM (SELECT *, (props::JSON->>'k')::INT AS k FROM events)""",
    "devices": f"""
  SELECT {mac_of("c_custkey")} AS mac, c_name AS owner, 'nation-' || c_nationkey AS location, {mapped("c_mktsegment", A.CRITICALITY)} AS criticality,
         {pick("c_custkey", A.AUTHORIZATION)} AS "authorization", CASE WHEN c_custkey % 4 = 0 THEN ['prod', 'core'] WHEN c_custkey % 4 = 1 THEN ['lab'] ELSE [] END AS tags,
         CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal > 0 END AS is_online, {pick("c_custkey", [300, 300, 600, 1200])} AS threshold,
         {pick("c_custkey", A.CATEGORIES)} AS device_type, CASE WHEN c_custkey % 6 <> 0 THEN 'host-' || c_custkey END AS hostname, c_custkey AS custkey
  FROM customer""",
    "findings": f"""
  SELECT o_orderkey AS id, {mac_of("o_custkey")} AS hw_addr, {_RULE} AS rule, {mapped(_RULE, A.SEVERITIES)} AS severity, o_orderstatus = 'F' AS resolved,
         epoch_us(o_orderdate) AS us, CASE WHEN o_orderkey % 9 = 0 THEN 'snoozed' WHEN o_orderkey % 4 = 0 THEN 'acknowledged' ELSE 'open' END AS status,
         CASE WHEN o_orderkey % 9 = 0 THEN epoch_us(o_orderdate) + (o_orderkey % 5) * 86400000000 * 300 END AS snoozed_until,
         {_RULE} || ' on ' || {mac_of("o_custkey")} || ' #' || (o_orderkey % 50) AS message
  FROM orders""",
    "evidence": f"""
  SELECT (l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey * 1000 + l_suppkey % 1000 AS id, {mac_of("l_orderkey % 500")} AS hw_addr, {pick("l_linenumber", A.SOURCES)} AS source,
         least(l_discount * 10, 1.0::DOUBLE) AS certainty, {pick("l_suppkey", A.VENDORS)} AS vendor, {pick("l_partkey", A.CATEGORIES)} AS category,
         {pick("l_partkey + l_suppkey", A.PLATFORMS)} AS platform,
         CASE WHEN ((l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 97) % 3 = 0 THEN 'host-' || (l_orderkey % 40) END AS hostname,
         {pick("l_suppkey", A.MODELS)} AS model, epoch_us(l_shipdate) AS us
  FROM lineitem""",
    "hosts": """
  SELECT *, CASE WHEN packets > 60 THEN 'known' ELSE 'new' END AS disposition FROM (
    SELECT hw_addr, arg_max(ip_addr, (us, packet_id)) AS ip_addr, min(us) AS discovered_us, max(us) AS last_us,
           max(CASE WHEN hw_addr LIKE 'd2%' THEN 1 ELSE 0 END) AS randomized, count(*) AS packets
    FROM packets GROUP BY hw_addr)""",
    "urls": """
  SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages""",
}


def _fusion_views() -> dict[str, str]:
    """Fusion in plain SQL: weights, candidates, winners, verdicts."""
    from ..operators import fusion as V

    weights = values(list(V.WEIGHTS.items()), "w(source, weight)")
    junk = ", ".join(map(literal, V.JUNK))
    bonus = "CASE families WHEN 1 THEN 1.0 WHEN 2 THEN 1.1 WHEN 3 THEN 1.2 ELSE 1.25 END::DOUBLE"
    multi = " OR ".join(f"lower(vendor) LIKE '%{v}%'" for v in V.MULTI_PRODUCT)
    kin = "CASE WHEN source LIKE 'satori%' OR source LIKE 'huginn%' THEN 'fingerprint_db' ELSE source END"

    def fused(rows: str, fields: list[str]) -> str:
        long = " UNION ALL ".join(f"SELECT hw_addr, source, certainty, weight, us, '{f}' AS field, {f} AS value FROM {rows}" for f in fields)
        return f"""
  SELECT hw_addr, field, arg_max(value, ord) AS value, max(score) FILTER (n = 1) AS score FROM (
    SELECT *, least(raw, 1.0::DOUBLE) AS score, row_number() OVER (PARTITION BY hw_addr, field ORDER BY raw DESC, newest DESC, value) AS n, -n AS ord FROM (
      SELECT hw_addr, field, value, round(max(best) * {bonus.replace("families", "count(DISTINCT kin)")}, 9) AS raw, max(us) AS newest FROM (
        SELECT hw_addr, field, value, source, {kin} AS kin, max(certainty * weight) AS best, max(us) AS us FROM ({long})
        WHERE value IS NOT NULL AND lower(trim(value)) NOT IN ({junk}) GROUP BY ALL) WHERE best > 0 GROUP BY ALL)) GROUP BY ALL"""

    plain = [f for f in V.FIELDS if f != "category"]
    share = "CASE field " + " ".join(f"WHEN '{f}' THEN {x}::DOUBLE" for f, x in V.FIELD_WEIGHTS.items()) + " END"
    columns = ", ".join(f"max(value) FILTER (field = '{f}') AS {f}" for f in V.FIELDS)
    return {
        "ev_capped": """
  SELECT * EXCLUDE (n, m) FROM (SELECT *, row_number() OVER (PARTITION BY hw_addr ORDER BY us DESC, id DESC) AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY hw_addr, source ORDER BY certainty DESC, us DESC, id DESC) AS n FROM evidence) WHERE n <= 3) WHERE m <= 100""",
        "ev_weighted": f"""
  SELECT e.*, coalesce(a.weight, b.weight, 0.5)::DOUBLE AS weight FROM ev_capped e
  LEFT JOIN {weights.replace("w(source", "a(source")} ON a.source = e.source
  LEFT JOIN {weights.replace("w(source", "b(source")} ON b.source = regexp_replace(e.source, '_[^_]*$', '')""",
        "ev_plain": fused("ev_weighted", plain),
        "ev_demoted": f"""
  SELECT e.* REPLACE (CASE WHEN e.source = 'oui' AND v.multi THEN e.weight * 0.4 ELSE e.weight END AS weight)
  FROM ev_weighted e LEFT JOIN (SELECT hw_addr, ({multi.replace("vendor", "value")}) AS multi FROM ev_plain WHERE field = 'vendor') v USING (hw_addr)""",
        "ev_category": fused("ev_demoted", ["category"]),
        "verdicts": f"""
  SELECT a.hw_addr, a.evidence, a.us, f.* EXCLUDE (hw_addr, certainty), coalesce(f.certainty, 0) AS certainty
  FROM (SELECT hw_addr, count(*) AS evidence, max(us) AS us FROM evidence GROUP BY hw_addr) a
  LEFT JOIN (SELECT hw_addr, {columns}, least(100, trunc(round(sum(score * {share}) / sum({share}) * 100, 6))::INT) AS certainty
             FROM (FROM ev_plain UNION ALL FROM ev_category) GROUP BY hw_addr) f USING (hw_addr)""",
    }


VIEWS |= _fusion_views()


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the views it names (and those they name) as CTEs."""
    known = VIEWS | (extra or {})
    needed: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(known[name])
                if name not in needed:
                    needed.append(name)

    need(body)
    recursive = "RECURSIVE " if re.match(r"\s*WITH RECURSIVE\b", body) else ""
    own = re.sub(r"^\s*WITH (RECURSIVE )?", "", body) if re.match(r"\s*WITH\b", body) else ""
    parts = [f"{n} AS ({known[n]})" for n in needed]
    if not parts:
        return body
    return f"WITH {recursive}" + ",\n".join(parts) + (",\n" + own if own else "\n" + body)
