"""Networks as a relation: which of them an address lies in, the longest prefix first.

An address is a text of bits, a network a beginning of one. An address is asked for by its beginnings of those lengths that occur among the networks, which are at most 33 and 129, so
the join is an equi-join on (family, bits), whatever the number of networks. IPv4 addresses inside IPv6 ones (::ffff:a.b.c.d) count as IPv4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUR = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"
SIX = r"(?i)^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$"
_MAPPED = r"(?i)^::ffff:(\d+\.\d+\.\d+\.\d+)$"


def _padded(value: Column, base: int, width: int) -> Column:
    return F.lpad(F.conv(value, base, 2), width, "0")


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """What make gives for a value that is worked out once."""
    return F.transform(F.array(value), make)[0]


def _four(address: Column) -> Column:
    return F.when(address.rlike(FOUR), F.array_join(F.transform(F.split(address, r"\."), lambda x: _padded(x, 10, 8)), ""))


def _six(address: Column) -> Column:
    """128 bits: a trailing IPv4 part becomes two groups, and :: as many zero groups as are missing."""
    tail = r"(\d+\.\d+\.\d+\.\d+)$"
    pair = lambda b: F.concat(F.conv(F.substring(b, 1, 16), 2, 16), F.lit(":"), F.conv(F.substring(b, 17, 16), 2, 16))
    plain = F.when(address.rlike(tail), F.concat(F.regexp_replace(address, tail, ""), _let(_four(F.regexp_extract(address, tail, 1)), pair))).otherwise(address)
    groups = lambda half: F.filter(F.split(half, ":", -1), lambda x: x != "")

    def told(halves: Column) -> Column:
        first, last = groups(halves[0]), groups(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
        missing = 8 - F.size(first) - F.size(last)
        whole = F.when(F.size(halves) == 1, missing == 0).otherwise(missing >= 1)
        return F.when(whole, F.concat(first, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), last))

    right = lambda x: x.rlike(SIX) & (x != "")  # noqa: E731  a stray colon would be lost with the empty groups
    return _let(plain, lambda x: F.when(right(x), F.array_join(F.transform(_let(F.split(x, "::", -1), told), lambda y: _padded(y, 16, 16)), "")))


def bits(address: Column) -> Column:
    """struct<family, bits> of an address; null if it is none. A zone (fe80::1%eth0) is left out."""
    one = lambda x: F.when(x.rlike(FOUR), F.struct(F.lit(4).alias("family"), _four(x).alias("bits"))).otherwise(_let(_six(x), lambda b: F.when(b.isNotNull(), F.struct(F.lit(6).alias("family"), b.alias("bits")))))
    return _let(F.regexp_replace(F.regexp_replace(F.trim(address), "%.*$", ""), _MAPPED, "$1"), one)


def parsed(networks: DataFrame, column: str = "network") -> DataFrame:
    """The networks with (family, size, prefix); an address without a length is a network of itself. Ones that can't be read are left out. Bits beyond the length don't matter."""
    told = networks.select("*", F.explode(F.array(bits(F.substring_index(column, "/", 1)))).alias("_at"), F.try_element_at(F.split(column, "/"), F.lit(2)).alias("_said"))  # exploded, so that bits are worked out once
    most = F.when(F.col("_at.family") == 4, 32).otherwise(128)
    size = F.when(F.col("_said").isNull(), most).otherwise(F.col("_said").try_cast("int"))
    told = told.withColumns({"family": F.col("_at.family"), "size": size}).where(F.col("_at").isNotNull() & F.col("size").between(0, most))
    return told.withColumn("prefix", F.substring(F.col("_at.bits"), F.lit(1), F.col("size"))).drop("_at", "_said")


def matches(addresses: DataFrame, networks: DataFrame, column: str = "addr") -> DataFrame:
    """Every pair of a distinct address and a network that holds it: (addr, size) and the networks' columns."""
    known = parsed(networks)
    lengths = known.select("family", "size").distinct().groupBy("family").agg(F.collect_set("size").alias("sizes"))  # two rows
    told = addresses.select(F.col(column).alias("addr")).where("addr IS NOT NULL").distinct().select("addr", F.explode(F.array(bits(F.col("addr")))).alias("_at")).where("_at IS NOT NULL")
    asked = told.select("addr", F.col("_at.family").alias("family"), F.col("_at.bits").alias("_bits")).join(F.broadcast(lengths), "family")
    each = asked.select("addr", "family", "_bits", F.explode("sizes").alias("size")).select("addr", "family", "size", F.substring("_bits", F.lit(1), F.col("size")).alias("prefix"))
    return each.join(known, ["family", "size", "prefix"]).drop("prefix")


def longest(addresses: DataFrame, networks: DataFrame, column: str = "addr") -> DataFrame:
    """Of each distinct address the narrowest network that holds it; of equal ones the first by its text."""
    told = matches(addresses, networks, column)
    rest = [x for x in told.columns if x not in ("addr", "size")]
    return told.groupBy("addr").agg(F.min(F.struct((-F.col("size")).alias("_order"), "network", *(x for x in rest if x != "network"))).alias("_x")).select("addr", (-F.col("_x._order")).alias("size"), *(F.col(f"_x.{x}") for x in rest))


def without(events: DataFrame, networks: DataFrame, column: str = "addr") -> DataFrame:
    """Events whose address lies in none of the networks; addresses that can't be read, and null ones, stay."""
    inside = matches(events, networks, column).select("addr").distinct()
    return events.join(inside, events[column] == inside["addr"], "left_anti")
