"""Differences of documents, bounded JSON, addresses and domains, against plain Python."""

import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from sievewright.functions import addresses
from sievewright.operators import differences, domains
from sievewright.sources import bounded


def invented(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind < 5:
        return rng.choice([None, True, False, 0, 1, -2.5, 1.0, 1e3, "", "x", 'q"\\\n', "日本\U0001f600", " "])
    if kind == 5:
        return [invented(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "$c", "d e", 'f"g', "日", "0"]): invented(rng, depth + 1) for _ in range(rng.randrange(5))}


def mutated(rng, value):
    if rng.random() < 0.15:
        return invented(rng, 2)
    if isinstance(value, list):
        return [mutated(rng, v) for v in value if rng.random() < 0.9]
    if isinstance(value, dict):
        return {k: mutated(rng, v) for k, v in value.items() if rng.random() < 0.9}
    return value


def plain_diff(a, b, path="$"):
    if isinstance(a, list) and isinstance(b, list):
        pairs = [(f"{path}[{i}]", a[i : i + 1], b[i : i + 1]) for i in range(max(len(a), len(b)))]
    elif isinstance(a, dict) and isinstance(b, dict):
        name = lambda k: f"{path}.{k}" if k and all(c.isascii() and (c.isalnum() or c in "_$") for c in k) and not k[0].isdigit() else f"{path}[{json.dumps(k, ensure_ascii=False)}]"
        pairs = [(name(k), [a[k]] if k in a else [], [b[k]] if k in b else []) for k in sorted({*a, *b})]
    else:
        same = type(a) is type(b) or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool))
        return [] if same and a == b else [(path, "changed")]
    out = []
    for where, x, y in pairs:
        out += [(where, "removed")] if not y else [(where, "added")] if not x else plain_diff(x[0], y[0], where)
    return out


def test_diff_is_plain(spark):
    rng = random.Random(5)
    left = {k: {"root": [invented(rng), invented(rng)]} for k in range(150)}
    right = {k: mutated(rng, v) for k, v in left.items()}
    frame = lambda docs: spark.createDataFrame([(k, json.dumps(v, ensure_ascii=rng.random() < 0.5), 1) for k, v in docs.items()], "id int, doc string, path int")
    got = sorted((r["id"], r.path, r.kind) for r in differences.json_diff(frame(left), frame(right), "id", "doc", 10).collect())
    assert got == sorted((k, *d) for k in left for d in plain_diff(left[k], right[k])) and len({k for k, *_ in got}) > 50


def test_diff_vectors(spark):
    rows = [(1, '{"value":{"listings":[{"lightweightFingerprint":"a"}]}}', '{"value":{"listings":[{"lightweightFingerprint":"b"}]}}'), (2, '{"secret":"same"}', '{ "secret" : "same" }'), (3, None, "1"), (4, "{", "{"), (5, "[1]", None)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {(r["id"], r.path, r.kind) for r in differences.json_diff(df.selectExpr("id", "a d"), df.selectExpr("id", "b d"), "id", "d").collect()}
    assert got == {(1, "$.value.listings[0].lightweightFingerprint", "changed"), (3, "$", "added"), (5, "$", "removed")}
    told = {r["id"]: (r.changed, r.differences) for r in differences.shadow_diff(df, "id", F.col("a"), F.col("b")).collect()}
    assert told == {1: (True, 1), 2: (False, 0), 3: (True, 1), 4: (False, 0), 5: (True, 1)}


def test_diff_bounds(spark):
    deep = lambda x: json.loads("[" * 6 + str(x) + "]" * 6)
    df = spark.createDataFrame([(1, json.dumps([deep(1), *range(9)]), json.dumps([deep(2), *range(1, 10)]))], "id int, a string, b string")
    diff = lambda **k: [r.path for r in differences.json_diff(df.selectExpr("id", "a d"), df.selectExpr("id", "b d"), "id", "d", **k).collect()]
    assert sorted(diff(depth=3))[:2] == ["$[0][0][0]", "$[1]"] and len(diff(depth=3)) == 10
    assert diff(depth=3, most=4) == ["$[0][0][0]", "$[1]", "$[2]", "$[3]"]
    assert differences.json_diff(df.where("false").selectExpr("id", "a d"), df.where("false").selectExpr("id", "b d"), "id", "d").collect() == []


def plain_measure(value, depth=0):
    if isinstance(value, str):
        return depth, 1, len(value.encode("utf-16-le")) // 2
    kids = [*value.values()] if isinstance(value, dict) else value if isinstance(value, list) else []
    found = [plain_measure(v, depth + 1) for v in kids]
    keys = [len(k.encode("utf-16-le")) // 2 for k in value] if isinstance(value, dict) else []
    return max([depth, *(f[0] for f in found)]), 1 + sum(f[1] for f in found), max([0, *keys, *(f[2] for f in found)])


def test_measures_are_plain():
    rng = random.Random(8)
    for k in range(400):
        value = invented(rng)
        text = json.dumps(value, ensure_ascii=k % 2 == 0, indent=[None, 1, "\t"][k % 3])
        assert bounded.measure(text.encode()) == plain_measure(value), text


def test_bounds(spark):
    rows = [(b"\xff", "invalid_utf8"), (b"[[[1]]]", "depth_limit"), (b"[1,2,3]", None), (b"[" + b"1," * 9 + b"1]", "node_limit"), (b'"' + b"x" * 11 + b'"', "string_limit"), (b'{"' + b"k" * 11 + b'":1}', "string_limit"), (b"x" * 41, "byte_limit"), (b"{", "invalid_json"), (b"", "invalid_json"), (None, "invalid_json"), (b'{"a":[[]]}', None), (b"[[[]]]", None), (b'"\\u0041\\n\\\\\\""', None)]
    df = spark.createDataFrame([(k, r, 0) for k, (r, _) in enumerate(rows)], "id int, body binary, _raw int")
    out = bounded.bounded_json(df, "body", bounded.Limits(40, 2, 10, 10)).collect()
    assert {r["id"]: r.error for r in out} == {k: e for k, (_, e) in enumerate(rows)}
    three = bounded.bounded_json(spark.createDataFrame([("[1,2,3]",)], "body string"), "body", bounded.Limits(20, 2, 3, 10)).first()
    assert (three.error, three.nodes, three.depth) == ("node_limit", 4, 1)
    with pytest.raises(ValueError, match="invalid_limits"):
        bounded.Limits(depth=257)
    assert bounded.bounded_json(df.where("false"), "body").collect() == []


def spelled(rng, n):
    """An address of 128 bits, spelled in one of its ways."""
    full = ipaddress.IPv6Address(n)
    forms = [str(full), full.exploded, str(full).upper()]
    if n >> 32 == 0xFFFF:
        forms.append("::ffff:" + str(ipaddress.IPv4Address(n & 0xFFFFFFFF)))
    return rng.choice(forms)


def test_addresses_are_those_of_ipaddress(spark):
    rng = random.Random(3)
    texts = [spelled(rng, rng.choice([0, 1, rng.getrandbits(128), rng.getrandbits(16) << 112, rng.getrandbits(48), 0xFFFF << 32 | rng.getrandbits(32), rng.getrandbits(64) << 64 & rng.getrandbits(128), 0x2001 << 112 | rng.getrandbits(100)])) for _ in range(300)]
    texts += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(100)] + ["::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:1.2.3.4"]
    texts += ["", ":", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "g::", "1:2:3:4:5:6:7:8::", "::1.2.3", "::1.2.3.256", "1.2.3.4:", "1.2.3", "256.1.1.1", "1:2:3:4:5:6:7:1.2.3.4"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", addresses.number(F.col("t")).alias("n"), addresses.is_public(F.col("t")).alias("p")).collect()
    nets = [ipaddress.ip_network(n) for n in (*addresses.PRIVATE_V4, *addresses.PRIVATE_V6)]
    for r in got:
        try:
            want = ipaddress.ip_address(r.t)
        except ValueError:
            assert r.n is None and not r.p, r.t
            continue
        value = int(want) if want.version == 6 else int(want) << 96
        assert (r.n.family, r.n.hi % (1 << 64), r.n.lo % (1 << 64)) == (want.version, value >> 64, value % (1 << 64)), r.t
        assert r.p == (not any(want in n for n in nets if n.version == want.version) and (want.version == 4 or want in ipaddress.ip_network("2000::/3"))), r.t


def test_address_policy(spark):
    refused = ["0.0.0.0", "10.0.0.1", "100.64.0.1", "127.0.0.1", "169.254.169.254", "172.16.0.1", "192.168.1.1", "192.0.2.1", "198.51.100.1", "203.0.113.1", "224.0.0.1", "255.255.255.255", "::", "::1", "fc00::1", "fe80::1", "ff02::1", "2001:10::1", "2001:20::1", "2001:30::1", "2001:db8::1", "2002:7f00:1::"]
    rows = [(a, False) for a in refused] + [("fe80::1%eth0", False), ("8.8.8.8", True), ("2606:4700:4700::1111", True), (None, False)]
    assert all(r.p == r.want for r in spark.createDataFrame(rows, "a string, want boolean").select("want", addresses.is_public(F.col("a")).alias("p")).collect())
    same = spark.createDataFrame([("2606:4700:4700:0:0:0:0:1111", "2606:4700:4700::1111")], "a string, b string")
    assert same.select(addresses.same_address(F.col("a"), F.col("b"))).first()[0]


def test_longest_match(spark):
    rng = random.Random(6)
    nets = sorted({str(ipaddress.ip_network((0x2001 << 112 | rng.getrandbits(20) << 92, b), strict=False)) for b in (16, 24, 32, 36) for _ in range(20)} | {str(ipaddress.ip_network((rng.getrandbits(32), b), strict=False)) for b in (0, 1, 4, 8) for _ in range(4)})
    hosts = [str(ipaddress.IPv6Address(0x2001 << 112 | rng.getrandbits(20) << 92 | rng.getrandbits(90))) for _ in range(100)] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(60)] + ["none", None]
    table = addresses.networks(spark.createDataFrame([(n, n) for n in [*nets, "1.2.3.4/33", "x/3", "::1", "::/129"]], "label string, net string"), "net")
    assert table.count() == len(nets)
    rows = spark.createDataFrame([(h, k) for k, h in enumerate(hosts)], "a string, bits_of int")
    for r in addresses.longest_match(rows, "a", table).collect():
        held = [ipaddress.ip_network(n) for n in nets if r.a not in (None, "none") and ipaddress.ip_address(r.a) in ipaddress.ip_network(n)]
        assert (r.bits, r.label) == ((lambda n: (n.prefixlen, str(n)))(max(held, key=lambda n: n.prefixlen)) if held else (None, None))


def test_registrable_domains(spark):
    lines = ["// comment", "", "com", "uk", "co.uk", "*.ck", "!www.ck", "*.kawasaki.jp", "jp", "!city.kawasaki.jp", "blogspot.com"]
    table = domains.rules(spark.createDataFrame([(x, x != "blogspot.com") for x in lines], "rule string, icann boolean"), section="icann")
    cases = {"example.com": ("com", "example.com", True), "A.B.Example.COM.": ("com", "example.com", True), "com": ("com", None, True), "x.co.uk": ("co.uk", "x.co.uk", True), "co.uk": ("co.uk", None, True), "x.uk": ("uk", "x.uk", True), "a.b.ck": ("b.ck", "a.b.ck", True), "b.ck": ("b.ck", None, True), "www.ck": ("ck", "www.ck", True), "x.www.ck": ("ck", "www.ck", True), "ck": ("ck", None, False), "a.b.kawasaki.jp": ("b.kawasaki.jp", "a.b.kawasaki.jp", True), "x.city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp", True), "me.blogspot.com": ("blogspot.com", "me.blogspot.com", False), "a.unknown": ("unknown", "a.unknown", False), "1.2.3.4": (None, None, None), "": (None, None, None), "a..b": (None, None, None), "-x.com": (None, None, None), None: (None, None, None)}
    rows = spark.createDataFrame([(h, 1) for h in [*cases, "example.com"]], "host string, suffix_of int")
    got = [(r.host, (r.suffix, r.domain, r.icann)) for r in domains.registrable(rows, "host", table).collect()]
    assert len(got) == len(cases) + 1 and [(h, found) for h, found in got if found != cases[h]] == []


def test_employer_domains(spark):
    rows = [("jobs.lever.co", "lever.co", True, "a", "b", False, "shared_ats_domain_is_not_employer_identity"), ("a.x.com", "x.com", True, "a.x.com", "a.x.com", False, "primary_domain_not_registrable"), ("x.com", "x.com", False, "x.com", "x.com", False, "primary_domain_not_registrable"), ("x.com", "x.com", True, "jobs.x.com", "notx.com", False, "ownership_evidence_domain_mismatch"), ("x.com", "x.com", True, "x.com", "jobs.x.com", False, None), ("acme.test", None, None, "acme.test", "acme.test", True, None)]
    df = spark.createDataFrame(rows, "d string, r string, i boolean, c string, e string, s boolean, want string")
    assert all(r.got == r.want for r in df.select("want", domains.employer_domain_error(*map(F.col, "drices")).alias("got")).collect())
