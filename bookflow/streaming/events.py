"""Structured Streaming forms of the stream-shaped behaviours.

`complete_samples` emits a sample once, when no more of its events can come; `look_back` aggregates tumbling or sliding
windows of fixed length; `complete_keys` emits a key once a later key proves it complete. `drained` runs any of them over all
files there are and then closes the stream: a last row far behind the others moves the watermark past every open sample or
window, so the trailing ones come out too. Each batch writes a folder of its own, so a batch that is repeated after a failure
overwrites its own output. Rows later than the watermark are left out, and counted as the state operators count them: a row
of a look-back once per window, and rows of one task that fall into one window as one.

Files of a stored table may come in any order of time. `disorder` measures how far back a file reaches behind those read
before it, and `stored` takes that as the delay: files in order of time leave only open windows and sessions in the state,
files in no order are right all the same. A row that is late in spite of that is an error.
"""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.lineage import checkpoint_root


def micros(column):
    """SQL text of the microseconds of a time stored without a zone: read as UTC, whatever the zone of the session."""
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))"


MICROS = micros("ts")


def event_stream(spark, path, name="events", files_per_batch=1):
    """Stream of the Parquet files of one table, oldest file first; `ts` is its time if it has such a column."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    # a table is a file or a folder of files
    raw = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{path}/{name}.parquet*")
    )
    return raw.withColumn("ts", F.timestamp_micros(F.expr(MICROS))) if "ts" in raw.columns else raw


def complete_samples(events, key, gap, delay):
    """One row per session of a key, which ends when no event follows within `gap`; rows may come `delay` late."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), F.col(key))
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"), F.max("ts").alias("last_ts"))
        .select(key, F.col("w.start").alias("start"), "last_ts", "events", "value")
    )


def look_back(events, keys, length, slide=None, delay="0 seconds"):
    """Counts and sums per window of fixed length; slide gives overlapping windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        events.withWatermark("ts", delay)
        .groupBy(w.alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("start"), *keys, "events", "value")
    )


def complete_keys(rows, key, delay, aggregates):
    """One row per key, given out once a row of a key greater by more than `delay` has come; keys are integers from 0.

    The key is the clock: its number is the event time in milliseconds. The state holds the trailing keys only, those within
    `delay` of the greatest. A row of a key that is already out is late; a row without a key is of none and left out.
    """
    return (
        rows.where(F.col(key).isNotNull())
        .withColumn("_clock", F.timestamp_millis(F.col(key).cast("long") + 1))  # what is not after 0 is late from the start
        .withWatermark("_clock", f"{delay + 1} milliseconds")
        .groupBy("_clock", key)
        .agg(*aggregates)
        .drop("_clock")
    )


def disorder(spark, path, name, clock):
    """How far the number `clock` of a row of a stored table lies at most behind one of an earlier file; 0 if files are in order.

    Files come in the order in which they were written. Those of one time may come in any order, so each counts as later than
    the others. One row per file is sorted, whatever the number of rows.
    """
    rows = spark.read.parquet(f"{path}/{name}.parquet").select(F.expr(clock).alias("t"), "_metadata.file_path", "_metadata.file_modification_time")
    files = rows.groupBy("file_modification_time", "file_path").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    times = files.groupBy("file_modification_time").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    seen = F.max("last").over(Window.orderBy("file_modification_time").rowsBetween(Window.unboundedPreceding, -1))
    before = times.select("first", "last", seen.alias("seen"))
    several = files.groupBy("file_modification_time").agg(F.count(F.lit(1)).alias("n"), (F.max("last") - F.min("first")).alias("span"))
    apart = several.where("n > 1").agg(F.max("span").alias("d")).first().d
    behind = before.agg(F.max(F.col("seen") - F.col("first")).alias("d")).first().d
    return max(0, apart or 0, behind or 0)


def stored(spark, path, build, reach=172_800, name="events"):
    """Rows of build(stream, delay) over all files of a table, in whatever order they come.

    `reach`, in seconds, must exceed window length and gap.
    """
    behind = 1 + disorder(spark, path, name, MICROS) // 1_000_000
    out, late = drained(spark, path, lambda s: build(s, f"{behind} seconds"), f"{behind + reach} seconds", name)
    return _none_late(out, late, path, name)


def stored_keys(spark, path, name, key, aggregates):
    """Rows of `complete_keys` over all files of a table, in whatever order they come."""
    behind = disorder(spark, path, name, key)
    out, late = drained(spark, path, lambda s: complete_keys(s, key, behind, aggregates), 2 * behind + 2, name, key)
    return _none_late(out, late, path, name)  # the closing key itself stays open


def _none_late(out, late, path, name):
    if late:
        raise RuntimeError(f"rows of {path}/{name}.parquet came too late and are missing in the result: {late} as counted by the state")
    return out


def drained(spark, path, build, closing="2 days", name="events", clock="ts"):
    """(rows of build(stream) over all files of a table, number of rows that came too late, 0 only if none did).

    `closing` must exceed window length, gap and delay together. It is a length of time, or a number if `clock` is one.
    """
    root = f"{checkpoint_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    table = spark.read.parquet(f"{path}/{name}.parquet")
    table.limit(0).write.parquet(f"{root}/closing/{name}.parquet")
    batches = len(table.inputFiles()) + 100
    late = _run(build(event_stream(spark, path, name).unionByName(event_stream(spark, f"{root}/closing", name))), root, batches)
    last = table.agg(F.max(clock).alias(clock)).where(F.col(clock).isNotNull())
    end = F.expr(f"{clock} + INTERVAL {closing}") if isinstance(closing, str) else F.col(clock) + closing
    end = last.select(*[(end if n == clock else F.lit(None)).cast(t).alias(n) for n, t in table.dtypes])
    end.write.mode("append").parquet(f"{root}/closing/{name}.parquet")
    late += _run(build(event_stream(spark, path, name).unionByName(event_stream(spark, f"{root}/closing", name))), root, batches)
    return spark.read.parquet(f"{root}/rows").drop("batch"), late


def _run(stream, root, batches):
    # the reports of all batches are read for late rows; Spark keeps 100 unless told otherwise
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    conf = stream.sparkSession.conf
    before = conf.get(kept)
    conf.set(kept, max(int(before), batches))
    try:
        query = (
            stream.writeStream.outputMode("append")
            .option("checkpointLocation", f"{root}/state")
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}"))
            .start()
        )
    finally:
        conf.set(kept, before)
    query.awaitTermination()
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
