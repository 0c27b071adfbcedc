"""Addresses a fetcher must not reach, and where a request came from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# IPv4 ranges that aren't public, in the order they are checked.
RANGES = [
    ("0.0.0.0", 8, "this network"),
    ("10.0.0.0", 8, "private"),
    ("100.64.0.0", 10, "carrier-grade nat"),
    ("127.0.0.0", 8, "loopback"),
    ("169.254.0.0", 16, "link-local"),
    ("172.16.0.0", 12, "private"),
    ("192.0.0.0", 24, "protocol assignments"),
    ("192.0.2.0", 24, "documentation"),
    ("192.168.0.0", 16, "private"),
    ("198.18.0.0", 15, "benchmarking"),
    ("198.51.100.0", 24, "documentation"),
    ("203.0.113.0", 24, "documentation"),
    ("224.0.0.0", 4, "multicast"),
    ("240.0.0.0", 4, "reserved"),
]


def _number(text: str) -> int:
    a, b, c, d = map(int, text.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def blocked_ranges(spark: SparkSession) -> DataFrame:
    """(ord, low, high, reason): fourteen rows."""
    rows = [(i, _number(b), _number(b) + (1 << (32 - n)) - 1, r) for i, (b, n, r) in enumerate(RANGES)]
    return spark.createDataFrame(rows, "ord int, low long, high long, reason string")


def ipv4_number(text: Column) -> Column:
    """An address of one to four parts, decimal, octal (leading 0) or hexadecimal (0x), as a number; the last
    part fills the bytes left; null if it is none."""
    p = F.split(text, r"\.", -1)
    n = F.size(p)

    def part(x: Column) -> Column:
        return (
            F.when(x.rlike("^0[xX][0-9a-fA-F]{1,8}$"), F.conv(F.substr(x, F.lit(3)), 16, 10))
            .when(x.rlike("^0[0-7]{1,11}$"), F.conv(x, 8, 10))
            .when(x.rlike("^(0|[1-9][0-9]{0,9})$"), x)
            .cast("long")
        )

    v = F.transform(p, part)
    last = F.element_at(v, -1)
    room = F.pow(F.lit(256.0), 5 - n)
    ok = n.between(1, 4) & F.forall(v, lambda x: x.isNotNull()) & F.forall(F.slice(v, F.lit(1), n - 1), lambda x: x <= 255) & (last < room)
    lead = F.aggregate(F.slice(v, F.lit(1), n - 1), F.struct(F.lit(0).cast("long").alias("s"), F.lit(24).alias("k")), lambda a, x: F.struct((a["s"] + x * F.pow(F.lit(2), a["k"]).cast("long")).alias("s"), (a["k"] - 8).alias("k")))
    return F.when(ok, lead["s"] + last)


def check_ipv4(addresses: DataFrame, number: str) -> DataFrame:
    """addresses with ``reason``, that of the first range the number lies in, null where it is public.

    A range join with a table of fourteen rows.
    """
    spark = addresses.sparkSession
    keyed = addresses.withColumn("_row", F.monotonically_increasing_id())
    ranges = F.broadcast(blocked_ranges(spark))
    hit = keyed.join(ranges, (F.col(number) >= F.col("low")) & (F.col(number) <= F.col("high")), "left")
    first = hit.groupBy(*keyed.columns).agg(F.min(F.struct("ord", "reason")).alias("r"))
    return first.select(*addresses.columns, F.when(F.col("r.ord").isNotNull(), F.col("r.reason")).alias("reason"))


def ipv4_reason(number: Column) -> Column:
    """That of the first range the number lies in, null where it is public."""
    out = None
    for base, bits, reason in RANGES:
        inside = F.shiftrightunsigned(number, 32 - bits) == _number(base) >> (32 - bits)
        out = F.when(inside, reason) if out is None else out.when(inside, reason)
    return out


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is computed once however often f names it."""
    return F.transform(F.array(x), f)[0]


_QUAD = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def ipv6_groups(text: Column) -> Column:
    """The eight groups of an IPv6 address, bracketed or not, a zone left out, with or without an IPv4 tail; null if it is none."""
    bare = F.substring_index(F.regexp_replace(text, r"^\[(.*)\]$", "$1"), "%", 1)

    def without_quad(s: Column) -> Column:
        tail = F.substring_index(s, ":", -1)
        octet = [F.split(tail, r"\.")[i].cast("int") for i in range(4)]
        groups = F.concat(F.hex(octet[0] * 256 + octet[1]), F.lit(":"), F.hex(octet[2] * 256 + octet[3]))
        return F.when(~s.contains("."), s).when(tail.rlike(rf"^{_QUAD}(\.{_QUAD}){{3}}$"), F.concat(F.substr(s, F.lit(1), F.length(s) - F.length(tail)), groups))

    def listed(half: Column) -> Column:
        return F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

    def filled(x: Column) -> Column:
        head, rest, parts = x["head"], x["rest"], x["parts"]
        total = F.size(head) + F.size(rest)
        known = F.forall(F.concat(head, rest), lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
        ok = known & ((parts == 1) & (total == 8) | (parts == 2) & (total <= 7))
        return F.when(ok, F.transform(F.concat(head, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - total)), rest), lambda g: F.conv(g, 16, 10).cast("long")))

    def split(s: Column) -> Column:
        halves = F.split(s, "::", -1)
        return F.struct(listed(F.get(halves, F.lit(0))).alias("head"), listed(F.get(halves, F.lit(1))).alias("rest"), F.when(s.contains(":"), F.size(halves)).alias("parts"))

    return _once(_once(_once(bare, without_quad), split), filled)


def ipv6_reason(groups: Column) -> Column:
    """Why an IPv6 address isn't public, null if it is: its own range, or that of the IPv4 address it stands for."""
    g = [groups[i] for i in range(8)]
    zero = lambda a, b: F.forall(F.slice(groups, a + 1, b - a), lambda x: x == 0)
    inner = lambda how, i: F.concat(F.lit(f"{how}: "), ipv4_reason(g[i] * 65536 + g[i + 1]))
    # Ranges that aren't public, and forms that hold an IPv4 address.
    return (
        F.when(zero(0, 8), "unspecified")
        .when(zero(0, 7) & (g[7] == 1), "loopback")
        .when(F.shiftright(g[0], 6) == 0x3FA, "link-local")
        .when(F.shiftright(g[0], 9) == 0x7E, "unique-local")
        .when(F.shiftright(g[0], 8) == 0xFF, "multicast")
        .when((g[0] == 0x2001) & (g[1] == 0xDB8), "documentation")
        .when(zero(0, 5) & (g[5] == 0xFFFF), inner("mapped", 6))
        .when((g[0] == 0x64) & (g[1] == 0xFF9B) & zero(2, 6), inner("nat64", 6))
        .when(zero(0, 6), inner("compatible", 6))
        .when(g[0] == 0x2002, inner("6to4", 1))
    )


def address_reason(text: Column) -> Column:
    """Why an address, IPv4 or IPv6, must not be reached; null if it may."""
    six = _once(ipv6_groups(text), lambda g: F.when(g.isNull(), "no address").otherwise(ipv6_reason(g)))
    four = _once(ipv4_number(text), lambda n: F.when(n.isNull(), "no address").otherwise(ipv4_reason(n)))
    return F.when(text.contains(":"), six).otherwise(four)


def hostname_refused(host: Column) -> Column:
    h = F.regexp_replace(F.lower(host), r"\.$", "")
    return (h == "localhost") | h.endswith(".localhost") | (h == "")


def client_ip(forwarded: Column, real: Column) -> Column:
    """The first forwarded address, the real one, or unknown."""
    first = F.trim(F.substring_index(forwarded, ",", 1))
    return F.coalesce(F.when(first != "", first), F.when(F.trim(real) != "", F.trim(real)), F.lit("unknown"))


def hop_allowed(scheme: Column, credentials: Column, host: Column, reasons: Column) -> Column:
    """First cause to refuse a hop, null if none: scheme, credentials, host, then any address with a reason."""
    return (
        F.when(~F.lower(scheme).isin("http", "https"), "scheme")
        .when(F.coalesce(credentials, F.lit("")) != "", "credentials")
        .when(hostname_refused(host), "host")
        .when(F.size(reasons) == 0, "unresolved")
        .when(F.exists(reasons, lambda r: r.isNotNull()), "address")
    )
