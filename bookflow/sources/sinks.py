"""Writing feature packs, prepared datasets and submissions."""

import uuid
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.expr import finite_or_zero
from ..operators.contract import manifest
from ..schema import KEY

MANIFEST = "manifest"
DATA = "data"


def write_pack(df, path):
    """Parquet table plus a one-row manifest beside it; refuses duplicate ids and bad values.

    The manifest is computed from the written files and written last, so a folder without one is
    an unfinished pack.
    """
    df.write.mode("errorifexists").parquet(f"{path}/{DATA}")
    m = manifest(df.sparkSession.read.parquet(f"{path}/{DATA}"))
    row = m.head()
    if row.rows != row.ids or row.bad_values:
        raise ValueError(f"not a valid pack: {row}")
    df.sparkSession.createDataFrame([row], m.schema).write.json(f"{path}/{MANIFEST}")
    return row


def read_pack(spark, path, verify=True):
    """Table of a pack; verify recomputes the manifest and compares it."""
    df = spark.read.parquet(f"{path}/{DATA}")
    if verify:
        now = manifest(df)
        kept = spark.read.schema(now.schema).json(f"{path}/{MANIFEST}").head()
        if kept is None or tuple(kept) != tuple(now.head()):
            raise ValueError(f"manifest of {path} does not match its data")
    return df


def write_arrow(df, path, compression="lz4"):
    """One Arrow IPC file of one record batch for each partition, in `path`, a folder that all executors share; returns the files in partition order.

    A task writes under a name of its own attempt and reports it, so files of failed or doubled attempts are in no list.
    """
    schema = to_arrow_schema(df.schema)

    def write(batches):
        whole = pa.Table.from_batches(batches, schema).combine_chunks()
        if whole.num_rows:
            store, folder = pa_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa_fs.LocalFileSystem(), path)
            store.create_dir(folder, recursive=True)
            part = TaskContext.get().partitionId()
            name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
            with store.open_output_stream(f"{folder}/{name}") as sink, pa.ipc.new_file(sink, schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as out:
                out.write_batch(whole.to_batches()[0])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{path}/{name}"])], ["part", "file"])

    # one row per file, as for any manifest of a folder
    return [r.file for r in df.mapInArrow(write, "part int, file string").orderBy("part").collect()]


def prepared(base, packs, label, drop=()):
    """Wide dataset: label rows joined to base and packs by id, missing and non-finite values 0.

    Adds `nodata`, set where a sample has neither trades nor quotes. Column names must be unique.
    """
    tables = [base, *packs]
    names = [n for t in tables for n in t.columns if n != KEY]
    if len(set(names)) != len(names):
        raise ValueError("packs share column names")
    wide = reduce(lambda a, b: a.join(b, KEY, "left"), tables, label)
    keep = [n for n in names if n not in set(drop)]
    number = lambda n: finite_or_zero(F.col(n).cast("double")).alias(n)
    nodata = (F.coalesce("tx_n", F.lit(0)) == 0) & (F.coalesce("mk_nbars", F.lit(0)) == 0)
    return wide.select(*label.columns, *[number(n) for n in keep], nodata.alias("nodata"))


def write_prepared(df, path, partition_by=None):
    w = df.write.mode("errorifexists")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def submission(template, predictions, value="target"):
    """Predictions in template order; a missing, extra, repeated or non-finite one raises.

    template: sample_id, position; predictions: sample_id and the value column.
    """
    p = predictions.groupBy(KEY).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("_k"))
    t = template.withColumn("_t", F.lit(True)).join(p, KEY, "full_outer")
    x = F.col(value)
    bad = F.col("_t").isNull() | F.col("_k").isNull() | (F.col("_k") > 1)
    bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = F.when(bad, F.raise_error(F.lit("submission ids or values do not fit the template"))).otherwise(F.lit(True))
    return t.filter(ok).select("position", KEY, value)


def write_submission(rows, path, value="target"):
    """CSV part files in template order, written by range so no task holds them all."""
    rows.orderBy("position").select(KEY, value).write.mode("errorifexists").option("header", True).csv(path)


def float_pack(df):
    """Doubles stored as floats, as packs are kept on disk."""
    return df.select(
        *[F.col(f.name).cast("float") if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema]
    )
