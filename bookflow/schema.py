"""Column names and types of the event streams.

Time is a countdown: `seconds_before_predict` falls towards 0, so chronological order is
descending seconds, and equal seconds are ordered by `event_seq`, which ingest writes.
"""

from pyspark.sql import types as T

KEY = "sample_id"
TIME = "seconds_before_predict"
SEQ = "event_seq"
MONTH = "month"

BUY, SELL = 0, 1
NEW, CANCEL = 0, 1

MARKET_SPAN = 600.0
FLOW_SPAN = 60.0

MARKET = T.StructType(
    [
        T.StructField(KEY, T.IntegerType()),
        T.StructField(TIME, T.FloatType()),
        T.StructField("transaction_avgprice", T.FloatType()),
        T.StructField("transaction_volume", T.IntegerType()),
        T.StructField("transaction_count", T.IntegerType()),
        T.StructField("ask_price_1", T.FloatType()),
        T.StructField("ask_volume_1", T.IntegerType()),
        T.StructField("bid_price_1", T.FloatType()),
        T.StructField("bid_volume_1", T.IntegerType()),
        T.StructField("ask_price_2", T.FloatType()),
        T.StructField("ask_volume_2", T.IntegerType()),
        T.StructField("bid_price_2", T.FloatType()),
        T.StructField("bid_volume_2", T.IntegerType()),
    ]
)

TRANSACTION = T.StructType(
    [
        T.StructField(KEY, T.IntegerType()),
        T.StructField(TIME, T.FloatType()),
        T.StructField("price", T.FloatType()),
        T.StructField("volume", T.IntegerType()),
        T.StructField("side", T.ByteType()),
    ]
)

ORDER = T.StructType(TRANSACTION.fields + [T.StructField("order_action", T.ByteType())])

LABEL = T.StructType(
    [
        T.StructField(KEY, T.IntegerType()),
        T.StructField(MONTH, T.ShortType()),
        T.StructField("target", T.FloatType()),
    ]
)
