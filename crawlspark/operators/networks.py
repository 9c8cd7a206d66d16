"""Addresses against a table of networks, v4 and v6, of any size.

A network is the first bits of its addresses, so an address lies in it if its own first bits are
equal. An address meets the table once per prefix length that occurs in it (33 and 129 at most),
by equality of the bits; there is no range join. The longest network that holds an address
decides, as in a routing table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import CLOSED_V4, OPEN_V4, OPEN_V6, PRIVATE_V6, RESERVED_V6
from ..functions.addresses import v4_number, v6_hex
from ..functions.staging import let
from ..functions.text import strip
from ..session import BROADCAST_BYTES, cut_lineage

# bytes of a network's row besides its bits
ROW_BYTES = 32


def fixed_networks(spark: SparkSession) -> DataFrame:
    """network, closed: the ranges closed_address() knows, as a table to add own networks to."""
    closed = [(n, True) for n in (*CLOSED_V4, *PRIVATE_V6, *RESERVED_V6)]
    return spark.createDataFrame(closed + [(n, False) for n in (*OPEN_V4, *OPEN_V6)], "network string, closed boolean")


def address_bits(ip: Column) -> Column:
    """4 or 6 and the bits of an address, as text; NULL when it is none."""
    def binary(hex_: Column, at: int) -> Column:
        return F.lpad(F.conv(F.substring(hex_, at, 16), 16, 2), 64, "0")

    v4 = let(v4_number(ip), lambda n: F.concat(F.lit("4"), F.lpad(F.bin(n), 32, "0")))
    v6 = let(v6_hex(ip), lambda h: F.concat(F.lit("6"), binary(h, 1), binary(h, 17)))
    return F.coalesce(v4, v6)


def network_keys(networks: DataFrame) -> DataFrame:
    """key, length, closed: one row per network, known by its first bits.

    A network without a length is one address; bits behind the length are not looked at. Of equal
    networks the closed one counts. Rows that are no network, or have a NULL, are left out.
    """
    text = strip(F.col("network"))
    size = F.when(F.col("_bits").startswith("4"), 32).otherwise(128)
    length = F.when(text.contains("/"), F.when(
        text.rlike("^[^/]+/[0-9]{1,3}$"), F.substring_index(text, "/", -1).cast("int"))).otherwise(size)
    return (
        networks.withColumn("_bits", address_bits(F.substring_index(text, "/", 1)))
        .withColumn("length", length)
        .filter((F.col("length") <= size) & F.col("closed").isNotNull())
        .select(F.left("_bits", F.col("length") + 1).alias("key"), "length", "closed")
        .groupBy("key", "length").agg(F.bool_or("closed").alias("closed"))
    )


def closed_by_networks(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """addresses (ip) → ip, closed: one row per distinct address.

    networks (network, closed): the longest one that holds an address decides, without one it is
    open. What is no address, NULL included, is closed. The table is broadcast only if it measures
    small; else addresses are shuffled by their first bits, where a frequent network's partition
    may be split.
    """
    known = cut_lineage(network_keys(networks))
    # one row per prefix length that occurs: 162 at most
    lengths = known.groupBy(F.left("key", F.lit(1)).alias("family"), "length").agg(F.count("*").alias("n")).collect()
    if sum(r.n * (r.length + ROW_BYTES) for r in lengths) <= BROADCAST_BYTES:
        known = F.broadcast(known)

    def prefixes(family: str) -> Column:
        found = sorted(r.length for r in lengths if r.family == family)
        return F.transform(F.array(*map(F.lit, found)) if found else F.array().cast("array<int>"),
                           lambda k: F.left("_bits", k + 1))

    keys = F.when(F.col("_bits").startswith("4"), prefixes("4")).when(F.col("_bits").startswith("6"), prefixes("6"))
    matched = (
        addresses.select("ip").distinct().withColumn("_bits", address_bits(F.col("ip")))
        .select("ip", F.col("_bits").isNull().alias("_none"), F.explode_outer(keys).alias("key"))
        .join(known, "key", "left")
    )
    return matched.groupBy("ip").agg(
        (F.bool_or("_none") | F.coalesce(F.max_by("closed", "length"), F.lit(False))).alias("closed"))
