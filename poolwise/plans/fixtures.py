"""Factor designs over the given tables, shared by the queries, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from poolwise.operators.prep import band, recode
from poolwise.sources.tables import read_table
from poolwise.spec import FactorSpec

# one profile: every level is above 0
SINGLE = FactorSpec(["qty", "disc", "tax", "flag"], [6, 5, 4, 4])
# many profiles: zero discount, zero tax and small quantities are inactive
MULTI = FactorSpec(["qty", "disc", "tax"], [6, 4, 3])
# treatment: the line status
TREAT = FactorSpec(["status", "disc", "tax"], [2, 5, 4])
# treatment and a second two-level factor, with inactive levels elsewhere
TREAT2 = FactorSpec(["status", "returned", "disc"], [2, 2, 4])
# strata: factors of an order, the customer's segment is the stratum
ORDERS = FactorSpec(["priority", "ostatus", "quartile"], [6, 4, 5])
# lines: fewer levels, a line per pool
SLOPES = FactorSpec(["disc", "tax", "flag"], [5, 4, 4])
# wide: part size and type on top
WIDE = FactorSpec(["qty", "disc", "tax", "flag", "size", "ptype"], [6, 5, 4, 4, 6, 7])
# eight factors of three levels
EIGHT = FactorSpec(["qty", "disc", "tax", "flag", "line", "season", "size", "ptype"], [4] * 8)
# events: type and six-hour band
EVENTS = FactorSpec(["etype", "daypart"], [6, 5])

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
FLAGS = {"A": 1, "N": 2, "R": 3}
STATUSES = {"F": 1, "O": 2, "P": 3}
PART_TYPES = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
EVENT_TYPES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def outcome():
    return F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) / 50


def qty_level():
    return F.ceil(F.col("l_quantity") / 10).cast("int")


def disc_level():
    return band("l_discount", [0.025, 0.05, 0.075], [1, 2, 3, 4])


def tax_level():
    return band("l_tax", [0.025, 0.05], [1, 2, 3])


def flag_level():
    return recode("l_returnflag", FLAGS)


def lineitem_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        qty_level().alias("qty"), disc_level().alias("disc"), tax_level().alias("tax"), flag_level().alias("flag"),
        outcome().alias("y"))


def lineitem_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_quantity") <= 5, 0).otherwise(qty_level()).alias("qty"),
        band("l_discount", [0.0, 0.035, 0.075], [0, 1, 2, 3]).alias("disc"),
        band("l_tax", [0.0, 0.045], [0, 1, 2]).alias("tax"), outcome().alias("y"))


def lineitem_treatment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        recode("l_linestatus", {"F": 0, "O": 1}).alias("status"), disc_level().alias("disc"), tax_level().alias("tax"),
        outcome().alias("y"))


def lineitem_treatment2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        recode("l_linestatus", {"F": 0, "O": 1}).alias("status"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"),
        band("l_discount", [0.0, 0.035, 0.075], [0, 1, 2, 3]).alias("disc"), outcome().alias("y"))


def lineitem_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        disc_level().alias("disc"), tax_level().alias("tax"), flag_level().alias("flag"),
        (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10000).alias("y"))


def orders_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's segment; the total is cut at fixed quarter marks of its range."""
    orders = read_table(spark, sf_dir, "orders")
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (orders.join(customers, orders.o_custkey == customers.c_custkey)
            .select(F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
                    recode("o_orderstatus", STATUSES).alias("ostatus"),
                    F.quarter("o_orderdate").alias("quartile"),
                    F.col("c_mktsegment").alias("segment"), (F.col("o_totalprice") / 100000).alias("y")))


def lineitem_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.ceil(F.col("p_size") / 10).cast("int").alias("size"),
        recode("p_type", PART_TYPES).alias("ptype"))
    return (read_table(spark, sf_dir, "lineitem")
            .select("l_partkey", qty_level().alias("qty"), disc_level().alias("disc"), tax_level().alias("tax"),
                    flag_level().alias("flag"), outcome().alias("y"))
            .join(parts, "l_partkey").drop("l_partkey"))


def lineitem_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), band("p_size", [17, 34], [1, 2, 3]).alias("size"),
        F.ceil(recode("p_type", PART_TYPES) / 2).cast("int").alias("ptype"))
    return (read_table(spark, sf_dir, "lineitem")
            .select("l_partkey", band("l_quantity", [16, 33], [1, 2, 3]).alias("qty"), band("l_discount", [0.035, 0.065], [1, 2, 3]).alias("disc"),
                    tax_level().alias("tax"), flag_level().alias("flag"), band("l_linenumber", [2, 5], [1, 2, 3]).alias("line"),
                    band(F.month("l_shipdate"), [4, 8], [1, 2, 3]).alias("season"), outcome().alias("y"))
            .join(parts, "l_partkey").drop("l_partkey"))


def events_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        recode("event_type", EVENT_TYPES).alias("etype"),
        (F.floor(F.hour("ts") / 6) + 1).cast("int").alias("daypart"),
        F.col("value").alias("value"), F.sqrt("value").alias("root_value"), F.length("props").cast("double").alias("props_size"))
