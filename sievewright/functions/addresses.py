"""IP addresses of both families as numbers, and networks by prefix: 128 bits are two longs."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.urls import PRIVATE_V4, v4_number

# IPv6 networks that are not public; only addresses of the first one are.
GLOBAL_V6 = "2000::/3"
PRIVATE_V6 = ("::/128", "::1/128", "2001::/32", "2001:0:2::/48", "2001:10::/28", "2001:20::/28", "2001:30::/28", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10", "ff00::/8")

_QUAD = r"((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)"


def _unsigned(high: Column, low: Column) -> Column:
    """Two 32-bit halves as one long, the upper half's first bit as its sign."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; written out, an expression used in many places grows with every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def v6_words(address: Column) -> Column:
    """The eight 16-bit words of an IPv6 address, null if it is none: zero runs, and an IPv4 address in the last two words, included."""
    pair = lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF)))))
    spelled = lambda quad: F.when(quad != "", F.concat(F.substring(address, F.lit(1), F.length(address) - F.length(quad)), _let(v4_number(quad), pair))).otherwise(address)
    part = lambda half: F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def filled(sides: Column) -> Column:
        missing = 8 - F.size(sides["left"]) - F.size(sides["right"])
        fits = F.when(sides["n"] == 2, missing >= 1).otherwise((sides["n"] == 1) & (missing == 0))
        words = F.concat(sides["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), sides["right"])
        return F.when(fits & F.forall(words, lambda w: w.rlike("^[0-9a-fA-F]{1,4}$")), F.transform(words, lambda w: F.conv(w, 16, 10).cast("long")))

    sides = lambda halves: F.struct(F.size(halves).alias("n"), part(F.get(halves, F.lit(0))).alias("left"), part(F.get(halves, F.lit(1))).alias("right"))
    text = _let(F.regexp_extract(address, rf"(?<=:){_QUAD}$", 0), spelled)
    return _let(_let(F.split(text, "::"), sides), filled)


def number(address: Column) -> Column:
    """``family, hi, lo`` of an address, null if it is none. An IPv4 address is its 32 bits at the upper end of ``hi``, ``lo`` is 0."""

    def six(words: Column) -> Column:
        half = lambda i: _unsigned(words[i] * 65_536 + words[i + 1], words[i + 2] * 65_536 + words[i + 3])
        return F.when(words.isNotNull(), F.struct(F.lit(6).alias("family"), half(0).alias("hi"), half(4).alias("lo")))

    four = lambda quad: F.when(quad.isNotNull(), F.struct(F.lit(4).alias("family"), F.shiftleft(quad, 32).alias("hi"), F.lit(0).cast("long").alias("lo")))
    return F.coalesce(_let(v4_number(address), four), _let(v6_words(address), six))


def masked(value: Column, bits: Column) -> Column:
    """The first ``bits`` bits of an address, as ``hi`` and ``lo``."""
    ones = F.lit(-1).cast("long")
    mask = lambda n: F.when(n <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", ones, (64 - F.least(n, F.lit(64))).cast("int")))
    return F.struct(value["hi"].bitwiseAND(mask(bits)).alias("hi"), value["lo"].bitwiseAND(mask(bits - 64)).alias("lo"))


def networks(rows: DataFrame, network: str) -> DataFrame:
    """Rows with ``family, bits, hi, lo`` of their network in ``address/bits`` form; rows whose network is none are left out."""
    text = F.col(network)
    value, bits = number(F.substring_index(text, "/", 1)), F.substring_index(text, "/", -1)
    told = rows.withColumn("_v", value).withColumn("_b", F.when(text.contains("/") & bits.rlike(r"^\d{1,3}$"), bits.cast("int")))
    most = F.when(F.col("_v.family") == 4, 32).otherwise(128)
    told = told.where(F.col("_v").isNotNull() & F.col("_b").between(0, most)).withColumn("_m", masked(F.col("_v"), F.col("_b")))
    return told.select(*rows.columns, F.col("_v.family").alias("family"), F.col("_b").alias("bits"), "_m.hi", "_m.lo")


def valued(rows: DataFrame, address: str, name: str) -> DataFrame:
    """``rows`` with the :func:`number` of an address, worked out once a row: filters and later uses see the column, not what makes it."""
    return rows.withColumn(name, F.explode(F.array(number(F.col(address)))))


def longest_match(rows: DataFrame, address: str, nets: DataFrame, value: str | None = None) -> DataFrame:
    """Rows joined to the network with the longest prefix that holds their address; null columns where none does.

    ``nets`` as :func:`networks` gives them, one row a network. An address meets networks by equality of (family, bits, masked address) for each prefix
    length that occurs, of which there are 162 at most; no row is compared with a range. ``value`` names the addresses' numbers if the rows have them.
    """
    lengths = [r.bits for r in nets.select("bits").distinct().collect()]  # 129 at most
    keys = ["family", "bits", "hi", "lo"]
    extra = [c for c in nets.columns if c not in keys]
    given = valued(rows, address, "_v") if value is None else rows.withColumn("_v", F.col(value))
    given = given.select("*", F.col("_v.family").alias("_f"), F.col("_v.hi").alias("_h"), F.col("_v.lo").alias("_l")).drop("_v")
    known = given.where("_f is not null").select("_f", "_h", "_l").distinct()
    tried = known.withColumn("bits", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).where("bits <= 32 or _f = 6")
    tried = tried.withColumn("_m", masked(F.struct(F.col("_h").alias("hi"), F.col("_l").alias("lo")), F.col("bits"))).select("_f", "_h", "_l", F.col("_f").alias("family"), "bits", "_m.hi", "_m.lo")
    best = tried.join(nets, keys).groupBy("_f", "_h", "_l").agg(F.max_by(F.struct("bits", *extra), "bits").alias("_n")).select("_f", "_h", "_l", "_n.*")
    return given.join(best, ["_f", "_h", "_l"], "left").drop("_f", "_h", "_l")


def _within(value: Column, network: str) -> Column:
    net = ipaddress.ip_network(network)
    bits, whole = net.prefixlen, int(net.network_address)
    hi, lo = (whole << 32, 0) if net.version == 4 else (whole >> 64, whole & ((1 << 64) - 1))
    signed = lambda n: F.lit(n - (1 << 64) if n >> 63 else n).cast("long")
    mask = lambda n: signed(((1 << 64) - 1) ^ ((1 << (64 - max(0, min(n, 64)))) - 1))
    return (value["family"] == net.version) & (value["hi"].bitwiseAND(mask(bits)) == signed(hi)) & (value["lo"].bitwiseAND(mask(bits - 64)) == signed(lo))


def is_public(address: Column, private: Iterable[str] = PRIVATE_V4 + PRIVATE_V6) -> Column:
    """Whether an address of either family may be asked: false for what is no address, too."""

    return _let(number(address), lambda value: public_number(value, private))


def public_number(value: Column, private: Iterable[str] = PRIVATE_V4 + PRIVATE_V6) -> Column:
    """:func:`is_public` of an address's :func:`number`."""
    held = F.lit(False)
    for network in private:
        held = held | _within(value, network)
    return F.coalesce(~held & ((value["family"] == 4) | _within(value, GLOBAL_V6)), F.lit(False))


def same_address(a: Column, b: Column) -> Column:
    """Whether two spellings are one address."""
    return F.coalesce(number(a) == number(b), F.lit(False))
