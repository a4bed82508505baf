"""Event streams derived from the driver's tables by plain column arithmetic.

`event_seq` of the quote stream is a struct of line columns: it only breaks ties of time, so a
comparable struct serves and no global or per-supplier row numbering is needed.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contract import coded
from ..schema import FLOW_SPAN, KEY, MARKET_SPAN, MONTH, SEQ, TIME

# The reference instants of the two countdowns and their scale.
FLOW_END = "TIMESTAMP_NTZ'2024-01-31 00:00:00'"
FLOW_MICROS_PER_SECOND = 30 * 86400 * 1_000_000 / FLOW_SPAN
MARKET_END = "DATE'2001-12-31'"
MARKET_DAYS = 2560.0


@dataclass(frozen=True)
class Streams:
    market: DataFrame
    transaction: DataFrame
    order: DataFrame
    label: DataFrame

    @property
    def spine(self):
        return self.label.select(KEY)


def table(spark, path, name):
    return spark.read.parquet(f"{path}/{name}.parquet")


def _flow(spark, path):
    left = F.expr(f"timestampdiff(MICROSECOND, CAST(ts AS TIMESTAMP_NTZ), {FLOW_END})")
    return table(spark, path, "events").select(
        F.col("user_id").alias(KEY),
        F.col("event_id").alias(SEQ),
        (left / F.lit(FLOW_MICROS_PER_SECOND)).alias(TIME),
        "event_type",
        "value",
    )


def transaction(spark, path):
    return (
        _flow(spark, path)
        .filter(F.col("event_type").isin("purchase", "view", "click"))
        .select(
            KEY,
            SEQ,
            TIME,
            (1 + F.col("value") / 1000).alias("price"),
            (1 + F.col(SEQ) % 97).alias("volume"),
            F.when(F.col(SEQ) % 5 < 3, 0).otherwise(1).alias("side"),
        )
    )


def order(spark, path):
    return (
        _flow(spark, path)
        .filter(F.col("event_type") != "purchase")
        .select(
            KEY,
            SEQ,
            TIME,
            (1 + F.col("value") / 2000).alias("price"),
            (1 + F.col(SEQ) % 89).alias("volume"),
            (F.col(SEQ) % 2).cast("int").alias("side"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("order_action"),
        )
    )


def market(spark, path):
    c = F.col
    days = F.datediff(F.expr(MARKET_END), c("l_shipdate").cast("date"))
    unit = c("l_extendedprice") / c("l_quantity") / 1000
    step = 0.001 * (1 + c("l_linenumber"))
    empty = c("l_orderkey") % 97 == 0
    ask = F.when(empty, 0.0).otherwise(unit * (1 + step))
    bid = unit * (1 - step)
    trades = c("l_linenumber") % 3
    # with time and supplier these fix every quote column, so remaining ties are identical rows
    tie_break = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    return table(spark, path, "lineitem").select(
        c("l_suppkey").alias(KEY),
        F.struct(*tie_break).alias(SEQ),
        (days * (MARKET_SPAN / MARKET_DAYS)).alias(TIME),
        F.when(trades > 0, unit).alias("transaction_avgprice"),
        (trades * c("l_quantity")).cast("int").alias("transaction_volume"),
        trades.alias("transaction_count"),
        ask.alias("ask_price_1"),
        F.when(empty, 0).otherwise(c("l_quantity").cast("int")).alias("ask_volume_1"),
        bid.alias("bid_price_1"),
        (1 + c("l_partkey") % 50).alias("bid_volume_1"),
        (ask * 1.001).alias("ask_price_2"),
        (1 + c("l_orderkey") % 60).alias("ask_volume_2"),
        (bid * 0.999).alias("bid_price_2"),
        (1 + (c("l_partkey") + c("l_linenumber")) % 40).alias("bid_volume_2"),
    )


def label(spark, path):
    ids = table(spark, path, "events").select(F.col("user_id").alias(KEY)).distinct()
    return ids.select(
        KEY,
        (F.col(KEY) % 12).cast("int").alias(MONTH),
        ((F.col(KEY) * 7919 % 2001 - 1000) / 1000000.0).alias("target"),
    )


def predictions(spark, path):
    c = F.col
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    return table(spark, path, "orders").select(
        c("o_orderkey").alias(KEY),
        ((year - 1995) * 12 + month - 1).alias(MONTH),
        ((c("o_totalprice") - 150000) / 1000000).alias("target"),
        ((c("o_totalprice") - 150000) / 5000000 + (c("o_custkey") % 101 - 50) / 1000.0).alias("pred_a"),
        ((c("o_totalprice") - 150000) / 4000000 + (c("o_orderkey") % 89 - 44) / 1000.0).alias("pred_b"),
    )


def streams(spark, path):
    """The streams; a read of a row with an unknown side or action fails."""
    trades, orders = coded(transaction(spark, path), "side"), coded(order(spark, path), "side", "order_action")
    return Streams(market(spark, path), trades, orders, label(spark, path))
