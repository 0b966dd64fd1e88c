"""Places of IPv4 and IPv6 addresses against looking through all ranges."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from visitory.operators import places

RANGE = "low string, high string, country string, subdivision1_code string, city int"


def _number(text):
    try:
        a = ipaddress.ip_address(text.strip().split("%")[0])
    except ValueError:
        return None
    return int(a) if a.version == 6 else (0xFFFF << 32) + int(a)


def _signed(n):
    return tuple(x - (1 << 63) for x in (n >> 64, n & (1 << 64) - 1))


def test_bits(spark):
    texts = ["1.2.3.4", "0.0.0.0", "255.255.255.255", "::", "::1", "2001:db8::ff00:42:8329", "fe80::1%eth0", "::ffff:10.0.0.1", "1:2:3:4:5:6:7:8", "FFFF:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "8000::", "64:ff9b::192.0.2.33", " 9.9.9.9 ", "1::8"]
    texts += ["", "x", "1.2.3", "256.1.1.1", "1.2.3.4.5", "1:2:3", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", ":::", "1:2:3:4:5:6:7::8:9", ":1:2:3:4:5:6:7", "g::", "1:2:3:4:5:6:7:"]
    got = {r.t: r.b for r in spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", places.bits(F.col("t")).alias("b")).collect()}
    assert got.pop(None) is None
    for t, b in got.items():
        n = _number(t)
        assert (tuple(b) if b else None) == (None if n is None else _signed(n)), t


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_looking_through_all_ranges(spark, seed):
    rnd, ranges = random.Random(seed), []
    for k in range(120):
        if k % 2:
            low = rnd.randrange(1 << 16) << 16 | rnd.randrange(1 << 16)
            high = min((1 << 32) - 1, low + rnd.choice([0, 5, 255, 70_000, 1 << 24]))
            ends = ipaddress.IPv4Address(low), ipaddress.IPv4Address(high)
        else:
            low = (0x2001 << 112) + (rnd.randrange(4) << 96) + rnd.randrange(1 << 20) * (1 << rnd.choice([0, 40, 64]))
            ends = ipaddress.IPv6Address(low), ipaddress.IPv6Address(min((1 << 128) - 1, low + (1 << rnd.choice([0, 16, 64, 100])) - 1))
        ranges.append((str(ends[0]), str(ends[1]), f"c{k}", None if k % 3 else f"r{k}", k))
    ranges += [("::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "all", None, None)] if seed == 1 else []
    ranges += [("bad", "1.1.1.1", "no", None, 1), ("2.0.0.0", "1.0.0.0", "no", None, 1), (ranges[0][0], ranges[0][1], "zz", None, 1)]
    asked = []
    for r in ranges[:120]:
        for n in (int(ipaddress.ip_address(r[0])), int(ipaddress.ip_address(r[1]))):
            kind = ipaddress.IPv6Address if ":" in r[0] else ipaddress.IPv4Address
            asked += [str(kind(max(0, min(n + d, int(kind("ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff" if ":" in r[0] else "255.255.255.255")))))) for d in (-1, 0, 1)]
    asked += ["nonsense", None] + [asked[0]] * 30
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "k long, remote_ip string")
    got = {r.k: (r.country, r.subdivision1_code, r.city) for r in places.with_place(rows, spark.createDataFrame(ranges, RANGE)).collect()}
    assert len(got) == len(asked)
    held = [(_number(a), _number(b), (c, s, i)) for a, b, c, s, i in ranges if _number(a) is not None and _number(b) is not None and _number(a) <= _number(b)]
    for k, t in enumerate(asked):
        n = None if t is None else _number(t)
        around = [(b - a, a, p) for a, b, p in held if n is not None and a <= n <= b]
        least = min(((w, a) for w, a, _ in around), default=None)
        want = {p for w, a, p in around if (w, a) == least} or {(None, None, None)}
        assert got[k] in want, (t, got[k], want)


def test_no_ranges_or_rows(spark):
    rows, none = spark.createDataFrame([(1, "1.1.1.1")], "k long, remote_ip string"), spark.createDataFrame([], RANGE)
    assert [(r.k, r.country) for r in places.with_place(rows, none).collect()] == [(1, None)]
    assert places.with_place(rows.limit(0), spark.createDataFrame([("1.0.0.0", "2.0.0.0", "c", None, None)], RANGE)).count() == 0
