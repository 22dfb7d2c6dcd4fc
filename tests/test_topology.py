"""The topology graph against its rules in plain Python."""

import hashlib
import random

import pytest

from wirefold.operators.topology import COMPUTERS, INFRASTRUCTURE, SWITCHES, VIRTUAL, Graph

DEVICE = "hw_addr string, ip_addr string, type string, connection string, volume long"


def network(seed, routers=True, switches=True, points=True):
    rng = random.Random(seed)
    kinds = ["phone", "server", "laptop", "printer", None] * 3 + ["router"] * routers + ["switch"] * switches + ["access_point"] * 2 * points
    devices = []
    for i in range(60):
        mac = (rng.choice(VIRTUAL) if rng.random() < 0.2 else "00:1a:2b") + f":00:00:{i:02x}"
        place = f"10.0.{rng.randrange(4)}.{rng.randrange(1 if rng.random() < 0.1 and routers else 3, 250)}"
        devices.append((mac, place if rng.random() < 0.95 else None, rng.choice(kinds), rng.choice(["wired", "wireless", "unknown", None]), rng.choice([None, rng.randrange(4)])))
    macs = [d[0] for d in devices]
    links = [(rng.choice(macs), rng.choice([*macs, "gone"])) for _ in range(12)]
    overrides = {m: rng.choice([*macs, "internet", "gone"]) for m in rng.sample([*macs, "away"], 5)}
    pins = rng.sample(macs, rng.choice([0, 2]) if routers else 0)
    return devices, pins, links, sorted(overrides.items())


def graph(devices, pins, links, overrides):
    """(nodes, edges) by the rules, one at a time."""
    subnet = lambda ip: ip.rsplit(".", 1)[0] + ".0/24"
    dealt = lambda mac, some: some[int(hashlib.md5(mac.encode()).hexdigest()[:8], 16) % len(some)]
    known = {d[0]: {"ip": d[1], "type": d[2], "how": d[3] or "unknown", "volume": d[4] or 0, "subnet": subnet(d[1])} for d in devices if d[1]}
    rank = {m: 1 if m in pins else 2 if d["type"] in ("router", "gateway", "firewall") else 3 if d["ip"].endswith((".1", ".2")) else 9 for m, d in known.items()}
    best = min(rank.values())
    gates = {m for m in known if rank[m] == best < 9}
    infra = {m for m, d in known.items() if d["type"] in INFRASTRUCTURE}
    if gates - infra and infra:
        gates = (gates & infra) | {m for m, d in known.items() if d["type"] == "router"}
    infra -= gates
    clients = sorted(set(known) - gates - infra)
    switches = sorted(m for m in infra if known[m]["type"] in SWITCHES)
    points = sorted(m for m in infra if known[m]["type"] == "access_point")
    core = min(switches, key=lambda m: (-known[m]["volume"], m), default=None)
    edges = [("internet", m, "wan") for m in gates] or ([("internet", core, "wan")] if core else [])
    trunk = [(g, core, "trunk") for g in gates] + [(core, m, "trunk") for m in infra if m != core] if core else []
    joined = {frozenset(e[:2]) for e in trunk}
    pairs = {tuple(sorted(p)) for p in links if p[0] != p[1] and set(p) <= set(known)}
    edges += trunk + [(*p, "lldp") for p in pairs if frozenset(p) not in joined]
    for m in clients:
        d = known[m]
        if any(m in p and (set(p) - {m}) & infra for p in pairs):
            continue
        hosts = [h for h in clients if known[h]["subnet"] == d["subnet"] and h[:8] not in VIRTUAL and known[h]["type"] in COMPUTERS]
        gate = min((g for g in gates if known[g]["subnet"] == d["subnet"]), default=min(gates, default=None))
        local = [p for p in points if known[p]["subnet"] == d["subnet"]]
        point = dealt(m, local or points) if points else None
        if m[:8] in VIRTUAL and hosts:
            edges.append((hosts[0], m, "vm"))
        elif d["how"] == "wireless" or d["how"] != "wired" and points:
            up = point or core or gate
            edges.append((up or "internet", m, "wireless" if up else "client"))
        elif d["how"] == "wired" and switches:
            edges.append((dealt(m, switches), m, "client"))
        else:
            edges.append((core or gate or min(gates | infra, default="internet"), m, "client"))
    manual = [(p, c, "manual") for c, p in overrides if c in known and (p in known or p == "internet")]
    changed = {e[1] for e in manual}
    tiers = {m: "gateway" if m in gates or not gates and m == core else "infrastructure" if m in infra else "client" for m in known}
    return tiers, sorted([e for e in edges if e[1] not in changed] + manual)


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {}), (3, {"routers": False}), (4, {"switches": False}), (5, {"points": False}), (6, {"routers": False, "switches": False, "points": False}), (7, {"switches": False, "points": False})])
def test_graph_by_the_rules(spark, seed, options):
    devices, pins, links, overrides = network(seed, **options)
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = Graph(frame(devices, DEVICE), frame([(p,) for p in pins], "mac string"), frame(links, "a string, b string"), frame(overrides, "hw_addr string, parent string"))
    tiers, edges = graph(devices, pins, links, overrides)
    assert {r.hw_addr: r.tier for r in got.nodes.collect()} == tiers
    assert sorted(map(tuple, got.edges().collect())) == edges


def test_kinds_and_exchanges(spark):
    devices, pins, links, overrides = network(1)
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = Graph(frame(devices, DEVICE), frame([(p,) for p in pins], "mac string"), frame(links, "a string, b string"), frame(overrides, "hw_addr string, parent string")).edges()
    assert {r.kind for r in got.collect()} == {"wan", "trunk", "lldp", "client", "wireless", "vm", "manual"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "SinglePartition" not in plan


def test_empty(spark):
    frame = lambda kind: spark.createDataFrame([], kind)
    got = Graph(frame(DEVICE), frame("mac string"), frame("a string, b string"), frame("hw_addr string, parent string"))
    assert got.nodes.collect() == [] and got.edges().collect() == []
