import random
from ipaddress import ip_address, ip_network

from pyspark.sql import functions as F

from crawlspark.fixed_values import CLOSED_V4, OPEN_V4, OPEN_V6, PRIVATE_V6, RESERVED_V6
from crawlspark.functions.addresses import closed_address
from crawlspark.operators import networks, sites


def edges(names):
    """First and last address of each network, and those next to them."""
    for n in map(ip_network, names):
        for at in (int(n.network_address), int(n.broadcast_address)):
            for a in (at - 1, at, at + 1):
                if 0 <= a < 1 << n.max_prefixlen:
                    yield str(ip_address(a) if n.version == 6 and a >= 1 << 32 else type(n.network_address)(a))


def closed(spark, ips, table):
    asked = spark.createDataFrame([(i,) for i in ips], "ip string")
    return {r.ip: r.closed for r in networks.closed_by_networks(asked, table).collect()}


def test_fixed_networks_are_the_fixed_ranges(spark):
    ips = [*edges((*CLOSED_V4, *OPEN_V4, *PRIVATE_V6, *OPEN_V6, *RESERVED_V6)), "8.8.8.8", "2606:4700::1", "x", "", None, "1.2.3", "fe80::1%eth0"]
    want = {r.ip: r.c for r in spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", closed_address(F.col("ip")).alias("c")).collect()}
    got = closed(spark, ips + ips, networks.fixed_networks(spark))
    assert {k: (want[k], v) for k, v in got.items() if want[k] != v} == {} and set(got) == set(want)


def test_longest_network_decides(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(150):
        if rng.random() < 0.5:
            rows.append((f"{rng.choice([9, 60])}.{rng.choice([0, 7, 128])}.{rng.randrange(256)}.{rng.randrange(256)}/{rng.randrange(0, 33)}", rng.random() < 0.5))
        else:
            rows.append((f"2001:{rng.choice(['db8', '7'])}::{rng.randrange(1 << 16):x}/{rng.randrange(0, 129)}", rng.random() < 0.5))
    ips = [f"{rng.choice([9, 60, 61])}.{rng.choice([0, 7, 128, 129])}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(150)]
    ips += [f"2001:{rng.choice(['db8', '7', '8'])}::{rng.randrange(1 << 16):x}" for _ in range(150)]
    parsed = [(ip_network(n, strict=False), c) for n, c in rows]
    want = {}
    for ip in ips:
        held = [(n.prefixlen, c) for n, c in parsed if n.version == ip_address(ip).version and ip_address(ip) in n]
        want[ip] = bool(held) and max(held)[1]
    table = spark.createDataFrame(rows, "network string, closed boolean")
    assert closed(spark, ips, table) == want and len(set(want.values())) == 2


def test_rows_that_are_no_network(spark):
    rows = [("9.9.9.9", True), (" 9.9.9.0/24 ", False), ("x/8", True), ("9.0.0.0/33", True), ("9.0.0.0/", True), ("/8", True), (None, True),
            ("9.0.0.0/8", None), ("::/129", True), ("9.0.0.0/1x", True)]
    table = spark.createDataFrame(rows, "network string, closed boolean")
    ips = ["9.9.9.9", "9.9.9.8", "9.1.1.1", "::1", None]
    assert closed(spark, ips, table) == {"9.9.9.9": True, "9.9.9.8": False, "9.1.1.1": False, "::1": False, None: True}
    assert closed(spark, ips, table.limit(0)) == {**dict.fromkeys(ips, False), None: True}
    assert closed(spark, [], table) == {}


def test_hosts_by_a_table(spark):
    ips = spark.createDataFrame([("a", "60.1.1.1"), ("a", "8.8.8.8"), ("b", "8.8.8.8"), ("c", "10.0.0.1"), ("d", None)], "host string, ip string")
    hosts = spark.createDataFrame([(h,) for h in "abcde"], "host string")
    table = networks.fixed_networks(spark).union(spark.createDataFrame([("60.0.0.0/6", True)], "network string, closed boolean"))
    got = {r.host: (r.resolved, r.public) for r in sites.public_ip_join(hosts, ips, table).collect()}
    assert got == {"a": (True, False), "b": (True, True), "c": (True, False), "d": (True, False), "e": (False, False)}


def test_a_million_networks_meet_by_equality(spark):
    n = F.col("id")
    quad = F.concat_ws(".", F.shiftright(n, 16), F.shiftright(n, 8) % 256, n % 256, F.lit(0))
    table = spark.range(1_000_000).select(F.concat(quad, F.lit("/24")).alias("network"), (n % 2 == 0).alias("closed"))
    ips = spark.range(5_000).select(F.concat_ws(".", F.shiftright(n * 190, 16), F.shiftright(n * 190 + n % 2, 8) % 256, (n * 190 + n % 2) % 256, n % 256).alias("ip"))
    out = networks.closed_by_networks(ips, table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Broadcast" not in plan
    assert {r.closed: r["count"] for r in out.groupBy("closed").count().collect()} == {True: 2_500, False: 2_500}
