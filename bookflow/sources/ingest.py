"""Reading event files, labels and CSV features; one-time conversion of Arrow files to Parquet."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import contract
from ..schema import KEY, SEQ, TIME
from .arrow_source import ROWS_PER_TASK, read_arrow


def read_events(spark, path, columns=None):
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def id_range(df, start=None, end=None, key=KEY):
    """Rows with start <= id < end; Parquet statistics skip the files outside."""
    if start is not None:
        df = df.filter(F.col(key) >= start)
    return df if end is None else df.filter(F.col(key) < end)


def numeric_columns(df, exclude=("sample_id", "target", "label", "month", "id")):
    """Feature columns of a table by type; `exclude` holds names that are never features."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def read_feature_csv(spark, path, schema=None):
    """CSV with a header; without a schema the types are inferred, which reads the file once more.

    Returns (table of sample_id and numeric feature columns, their names).
    """
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    names = numeric_columns(df)
    return df.select(KEY, *names), names


def same_columns(left, right):
    """Names of two feature tables must match one to one, in order."""
    if list(left) != list(right):
        raise ValueError(f"column schema differs: {sorted(set(left) ^ set(right))}")
    return list(left)


def keep_ids(df, ids, key=KEY):
    return df.join(ids.select(key), key, "left_semi")


def convert_arrow_files(spark, files, schema, rows_per_slice=ROWS_PER_TASK):
    """DataFrame of Arrow IPC (feather) files with `event_seq`, the row number in file order.

    A task reads `rows_per_slice` rows of the columns of `schema`, however large a file's record batches are.
    """
    return read_arrow(spark, files, schema, rows_per_slice)


def ingest_arrow(spark, files, schema, path, span, codes=("side",), may_miss=(), rows_per_slice=ROWS_PER_TASK):
    """Arrow files as a Parquet table at `path`, checked by the pass that writes it; returns the counts of all rules.

    A broken rule is an error, and the table is then left without its `contract` row, as an unfinished one.
    """
    rows, seen = contract.observed(read_arrow(spark, files, schema, rows_per_slice), span, codes, may_miss)
    rows.write.mode("errorifexists").parquet(f"{path}/data")
    counts = seen.get
    if bad := contract.broken(counts):
        raise ValueError(f"input contract broken: {bad}")
    spark.createDataFrame([tuple(counts.values())], list(counts)).write.json(f"{path}/contract")
    return counts


def write_bucketed(df, table, buckets, key=KEY):
    """Table bucketed by sample and sorted in time, so per-sample windows and joins need no shuffle."""
    sort = [key, TIME, SEQ] if TIME in df.columns else [key]
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(*sort).saveAsTable(table)


def bucketed(df, buckets, key=KEY):
    """`df` as a table of its own bucketed and sorted by `key`: joins and aggregations by the key need no exchange."""
    table = f"bucketed_{uuid.uuid4().hex}"
    write_bucketed(df, table, buckets, key)
    return df.sparkSession.table(table)
